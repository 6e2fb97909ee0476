"""Each stage of the corpus pipeline against a plain version of what it has to do."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as pipe
import pytest
from pyspark.sql import functions as F
from textloom.llm import packing, secrets

from .conftest import CLASHES, write
from .test_near_secrets_warc import brute_spans
from .test_sharding_mixing_packing import check_pieces, expected_targets

W = re.compile(r"[^\x20\x09-\x0d]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    words = W.findall(text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def alike(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in pipe.STAGES:
        stage(spark, docs, sf).write.parquet(f"{root}/{name}")
        after = spark.read.parquet(f"{root}/{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_and_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "near-duplicates", "secrets", "mixing", "packing"]
    assert all(sorted(after.columns) == sorted(COLUMNS) for _, _, after in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, sf, stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [d for d, t in labels.items() if t == 0]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert sum(d not in kept for d, t in labels.items() if t == 1) >= 0.5 * sum(labels.values())
    assert after.exceptAll(before).count() == 0


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    texts = {r.doc_id: shingles(r.text) for r in before.collect()}
    kept = [r.doc_id for r in after.collect()]
    assert len(set(kept)) == len(kept)
    for i, a in enumerate(kept):
        assert not any(alike(texts[a], texts[b]) >= 0.85 for b in kept[:i])
    for d in set(texts) - set(kept):
        assert any(alike(texts[d], texts[k]) >= 0.4 for k in texts if k < d)


def test_secrets_are_replaced(stages):
    _, before, after = stages[2]
    got = {r.doc_id: r.text for r in after.collect()}
    rows = before.collect()
    assert len(got) == len(rows)
    for r in rows:
        want, at = "", 0
        for a, _, b, _ in brute_spans(r.text):
            if a >= at:
                want += r.text[at:a] + "[SECRET]"
            at = max(at, b)
        assert got[r.doc_id] == want + r.text[at:]
    assert all(not brute_spans(t) for t in got.values())


def test_mix_takes_its_targets(stages):
    _, before, after = stages[3]
    sizes, texts = Counter(), {}
    for r in before.collect():
        sizes[r.source] += len(W.findall(r.text))
        texts[r.doc_id] = r
    taken, times = Counter(), defaultdict(int)
    for r in after.collect():
        words, own = W.findall(r.text), W.findall(texts[r.doc_id].text)
        taken[r.source] += len(words)
        times[r.doc_id] += 1
        assert r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id].text or Counter(words) <= Counter(own)
    assert all(abs(taken[s] - t) <= 1 for s, t in expected_targets(dict(sizes)).items())
    assert max(times.values()) <= 2


def test_mix_stands_in_the_order_of_its_slots(spark, sf, tmp_path):
    """In every first part of what the stage writes, file after file, each source has its share of the words, but for a few
    blocks and the length of a document."""
    import pyarrow.parquet as pq

    rows = [(i, " ".join(f"w{i}" for _ in range(40 + i * 37 % 160)), "en", f"s{i % 5}") for i in range(3000)]
    path = write(spark, tmp_path, rows, extra=False)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    pipe.mix_sources(spark, docs, path).write.parquet(f"{tmp_path}/out")
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = expected_targets(dict(sizes))
    total, seen, done = sum(want.values()), 0, Counter()
    for f in sorted((tmp_path / "out").glob("*.parquet")):
        t = pq.read_table(f)
        for text, source in zip(t["text"].to_pylist(), t["source"].to_pylist(), strict=True):
            done[source] += len(text.split())
            seen += len(text.split())
            assert all(abs(done[s] - seen * w / total) <= 8 * 1024 for s, w in want.items())
    assert seen == pytest.approx(total, abs=len(want))


def test_mix_is_the_same_in_another_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (Counter(map(tuple, pipe.mix_sources(spark, docs.repartition(n, "doc_id"), sf).collect())) for n in (2, 7))
    assert a == b


def test_sequences_hold_every_piece(stages):
    _, before, after = stages[4]
    check_pieces(after.collect(), [(r.doc_id, r.text) for r in before.collect()], packing.FastIds(packing.tokenizer_path()))


def test_odd_documents_run_through(spark, tmp_path, odd_rows):
    path = write(spark, tmp_path, odd_rows)
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    got = pipe.run(spark, path).collect()
    assert {1, 2, 6, 7, None} <= {r.doc_id for r in got}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in pipe.STAGES[:-1]:  # every column stays, whatever its name
        after = stage(spark, docs, path)
        assert after.columns == docs.columns
        assert all(r[c] == "x" for r in after.collect() for c in CLASHES if c in after.columns)
    none = spark.read.parquet(f"{path}/documents.parquet").where(F.lit(False))
    none.write.parquet(f"{path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{path}/none/labels.parquet")
    assert pipe.run(spark, f"{path}/none").collect() == []
    assert secrets.RULES[0].kind == "assign"

"""Every registered query against its SQL twin on a small scale, and the driver's contract."""

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
from textloom.operators import timeline
from textloom.plans import catalogue, documents, runs, scalars, services

import __spark_entry__

assert services.QUERIES is catalogue.QUERIES and documents.FILES and scalars.v and runs.run_states
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)):
            return ""
        return f"{float(x):.6g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(name, spark, duck, sf):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def documents(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_queries_without_sql_are_tested_below():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"chunk_split", "repeat_collapse", "incremental_commit", "vocabulary_counts"}


def test_repeats_against_python(spark, sf):
    texts = documents(spark, sf)
    want = {i: hashlib.md5(re.sub(r"(.{1,12}?)\1{9,}", lambda m: 4 * m[1], t + "ha" * (i % 30)).encode()).hexdigest() for i, t in texts.items()}
    assert {r.doc_id: r.text for r in catalogue.QUERIES["repeat_collapse"](spark, sf).collect()} == want


def test_chunks_hold_whole_texts(spark, sf):
    count = lambda t: len(re.findall(r"[^\W\d_]+|\d|[^\s\w]+|_", t))
    by = {}
    for r in catalogue.QUERIES["chunk_split"](spark, sf).collect():
        by.setdefault(r.doc_id, []).append((r.chunk, r.value, r.chunks))
    for i, t in documents(spark, sf).items():
        parts = [v for _, v, _ in sorted(by[i])]
        assert all(n == len(parts) for _, _, n in by[i])
        clean = t
        if count(t) > 256:
            assert len(parts) > 1 and all(count(p) <= 256 for p in parts)
            for a, b in (("..", "."), ("。。", "。"), ("，，", "，"), ("!!", "!"), ("??", "?")):
                clean = clean.replace(a, b)
        assert "".join(parts) == clean


def test_commits_hold_whole_turns(spark, sf):
    """Of growing hypotheses every letter is committed once, in order."""
    turns = {r.conv_id * 1000 + r.turn: r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = {}
    for r in sorted(catalogue.QUERIES["incremental_commit"](spark, sf).collect(), key=lambda r: (r.key, r.n)):
        got[r.key] = got.get(r.key, "") + r.text
    squeeze = lambda t: "".join(t.split())
    # units committed at the same time have no order in a table
    assert {k: sorted(squeeze(t)) for k, t in got.items()} == {k: sorted(squeeze(t)) for k, t in turns.items() if squeeze(t)}


def test_vocabulary_counts_equal_the_tokenizer(spark, sf):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    of = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = {i: len(of.encode(t, add_special_tokens=False).ids) for i, t in documents(spark, sf).items()}
    assert {r.doc_id: r.tokens for r in catalogue.QUERIES["vocabulary_counts"](spark, sf).collect()} == want


def test_pack_batches_fill_their_budget(spark, sf):
    got = catalogue.QUERIES["pack_batches"](spark, sf).toPandas()
    for _, p in got.groupby("doc_id"):
        sums = p.groupby("batch")["cost"].agg(["sum", "size"])
        assert ((sums["sum"] <= 512) | (sums["size"] == 1)).all()
        costs = p.sort_values("ord")
        for a, b in zip(sorted(set(p.batch))[:-1], sorted(set(p.batch))[1:], strict=True):
            assert sums.loc[a, "sum"] + costs[costs.batch == b]["cost"].iloc[0] > 512


def test_region_links_of_every_box(spark, tmp_path):
    """All boxes are linked, those of orders above 4000 too: against brute force."""
    line = [(o, n, (o * 37 + n * 11) % 900) for o in [*range(1, 400, 7), *range(3990, 4400, 5), *range(90000, 90400, 3)] for n in range(1, 4)]
    spark.createDataFrame(line, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    boxes = sorted((o * 8 + n, o % 97, p % 400, n * 20) for o, n, p in line)
    want = {(m, i, j) for i, m, x, y in boxes for j, k, u, v in boxes if i < j and m == k and abs(x - u) <= 34 and abs(y - v) <= 16}
    got = catalogue.QUERIES["region_links"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.image, r.a, r.b) for r in got} == want
    assert any(a > 4000 * 8 + 7 for _, a, _ in want)


def against_sql(name: str, spark, path, **tables) -> list:
    """The rows of a query over small tables; SQL gives the same."""
    con = duckdb.connect()
    for t, (made, schema) in tables.items():
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(path)).toPandas()
    assert rows(got) == rows(con.execute(catalogue.ORACLES[name]).df())
    return rows(got)


def test_equal_boxes_are_dealt_out_once(spark, tmp_path, monkeypatch):
    """Two lines of 300 orders have three boxes each: all links come, and 6 rows meet instead of 600."""
    met = []
    real = timeline.near_pairs
    monkeypatch.setattr(timeline, "near_pairs", lambda boxes, *a, **k: met.append(boxes.count()) or real(boxes, *a, **k))
    line = [(97 * i, n, (0, 400, 30, 60)[i % 4]) for i in range(300) for n in (1, 2)]
    got = against_sql("region_links", spark, tmp_path, lineitem=(line, "l_orderkey long, l_linenumber int, l_partkey long"))
    assert len(got) == 2 * (300 * 299 // 2 - 150 * 75)  # 0 and 60 are too far apart
    assert met == [6]


def test_links_take_few_bytes(spark, tmp_path):
    """All links of 3,000 orders, a hundred to a box, come: written as they come, two and more of them go to a byte."""
    line = [(97 * o, 1, i % 30) for i, o in enumerate(random.Random(5).sample(range(10**6), 3000))]
    spark.createDataFrame(line, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    catalogue.QUERIES["region_links"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/links")
    got = spark.read.parquet(f"{tmp_path}/links")
    assert got.count() == got.distinct().count() == got.where("image = 0 AND a < b").count() == 3000 * 2999 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "links").glob("*.parquet")) < 0.5 * (3000 * 2999 // 2)


def test_glossary_of_letters_with_two_capitals(spark, tmp_path):
    words = ["Erßie one", "ERẞIE", "ΣΑΣ x", "σας", "İx", "ix", "ﬁn", "ŉa", "a\x0bb c", "straße", "STRASSE", ""]
    user = ([(i, w) for i, w in enumerate(words[::2])], "item_id long, text string")
    got = against_sql("glossary_merge", spark, tmp_path, benchmark=user, documents=([(i, w) for i, w in enumerate(words)], "doc_id long, text string"))
    assert ("ERẞIE", "Erßie") in got


def test_html_references_without_an_end(spark, tmp_path):
    pages = ["<p>a &am</p><p>b &a", "<p>x &amp; y &amp</p>", "<title>T &copy; &a</title><h1>q &amp;am</h1>", "<p>&quot;a&quot; &</p>"]
    got = against_sql("html_blocks", spark, tmp_path, pages=([(i, p) for i, p in enumerate(pages)], "page_id long, html string"))
    assert any("a &am" in r for r in got)


def test_html_texts_cut_within_a_reference(spark, tmp_path):
    whole = "a &quot;b&quot; &copy; c &middot; d &amp; e"
    pages = [f"<title>{whole[:n]}</title><h1>{whole[:n]} x</h1><p>{whole}</p>" for n in range(1, len(whole) + 1)] + ["<p>&quotx &copyx; &ampx; &ampquot;</p>"]
    got = against_sql("html_blocks", spark, tmp_path, pages=([(i, p) for i, p in enumerate(pages)], "page_id long, html string"))
    assert any("a &quot" in r for r in got) and any('a "b"' in r for r in got)


def test_speech_of_several_lines(spark, tmp_path):
    turns = [(1, 0, "One two.\nThree four five six seven. Eight nine."), (1, 1, "a  b\n\nc"), (2, 0, "no\tno two three four five six seven\teight")]
    got = against_sql("speech_cleanup", spark, tmp_path, conversations=(turns, "conv_id long, turn int, text string"))
    assert any("One two.\nThree" in c for r in got for c in r)


def test_rest_to_the_nearest_second(spark, tmp_path):
    events = [(1, "a", "2024-01-31 00:00:01", 10.7), (2, "a", "2024-01-31 00:00:02", 0.2), (3, "b", "2024-01-31 00:00:01", 2.5), (4, "c", "2024-01-31 00:00:01", 3.5), (5, "d", "2024-01-31 00:00:01", None)]
    made = spark.createDataFrame(events, "event_id long, event_type string, ts string, value double").selectExpr("event_id", "event_type", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "value")
    assert len(against_sql("cool_downs", spark, tmp_path, events=(made.collect(), made.schema))) == 4
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = {r.model: r.until for r in catalogue.QUERIES["cool_downs"](spark, str(tmp_path)).collect()}  # rows() has six digits
    assert got == dict(con.execute(f"SELECT model, until FROM ({catalogue.ORACLES['cool_downs']})").fetchall())
    assert got["a"] == 1706659212


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

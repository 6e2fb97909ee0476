import collections
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from textloom.llm import ann, language, quality, toxicity

from .conftest import ODD, write

MIDDLE = "/root/testdata/sf0.01"
W = re.compile(r"[^\x20\x09-\x0d]+")


# --- nearest neighbours -----------------------------------------------------------------------------------------------


def brute_nearest(rows, q, k=10):
    own = next(v for i, v in rows if i == q)
    found = sorted((float(np.sqrt(((np.array(v, float) - np.array(own, float)) ** 2).sum())), i) for i, v in rows if i != q and len(v) == len(own))
    return found[:k]


def test_nearest_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 200)
    e = spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding) for r in e]
    got = ann.op1_hnsw_shards(spark, MIDDLE).toPandas()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        want = brute_nearest(rows, q)
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11))
        assert list(zip(g["score"], g["vec_id"], strict=True)) == sorted(zip(g["score"], g["vec_id"], strict=True))
        exact = dict((i, s) for s, i in brute_nearest(rows, q, len(rows)))
        assert all(abs(exact[v] - s) < 1e-12 for v, s in zip(g["vec_id"], g["score"], strict=True))
        hits += len({i for _, i in want} & set(g["vec_id"]))
        total += 10
    assert got["query_id"].nunique() == sum(i % 100 == 0 for i, _ in rows)
    assert hits / total >= 0.95


def kinds_of_vectors():
    """One shard of production size of each kind that is hard: an offset, a small spread about it, tight clusters of many and
    of few, components that overflow float squares, few dimensions."""
    rng, n = np.random.default_rng(0), ann.SHARD
    base, centres, few = rng.normal(size=(n, 64)), rng.normal(size=(400, 64)), rng.normal(size=(n // 10, 64))
    yield "offset", (base + 1000).astype(np.float32)
    yield "small spread", (base * 0.01 + 100).astype(np.float32)
    yield "tight clusters", (centres[rng.integers(0, 400, n)] + 1e-4 * rng.normal(size=(n, 64))).astype(np.float32)
    yield "small clusters", (few[rng.integers(0, n // 10, n)] + 1e-2 * rng.normal(size=(n, 64))).astype(np.float32)
    yield "huge", (base * 1e30).astype(np.float32)
    yield "huge double", base * 1e200
    yield "flat", rng.normal(size=(n, 3)).astype(np.float32)


@pytest.mark.parametrize(("kind", "v"), list(kinds_of_vectors()), ids=[k for k, _ in kinds_of_vectors()])
def test_recall_and_reach_of_a_whole_shard(kind, v):
    v = np.unique(v, axis=0)
    np.random.default_rng(1).shuffle(v)
    levels = ann.build(v)
    for members, links in levels:  # every node of every level can be reached from the first of the top level
        seen = np.zeros(len(v), bool)
        flat = np.full((len(v), links.shape[1]), -1)
        flat[members] = links
        ann.reached(flat, int(levels[-1][0][0]), seen)
        assert seen[members].all()
    offsets = np.arange(len(v) + 1)
    shard = {"v": v, "ids": np.arange(len(v)), "offsets": offsets, "levels": levels}
    ask, hits = np.arange(0, len(v), 100)[:100], 0
    got = collections.defaultdict(list)
    for q, i, score in ann.found_by(shard, ask, v[ask], 10):
        got[q].append((score, i))
    for q in ask:
        exact = ann.euclidean(v, v[q])
        exact[q] = np.inf
        assert got[q] == sorted(got[q]) and all(exact[i] == s for s, i in got[q])
        hits += len({i for _, i in got[q]} & set(np.argsort(exact, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 10 * len(ask), kind


@pytest.mark.parametrize("offset", [100.0, 1000.0])
def test_nearest_with_an_offset(spark, tmp_path, offset):
    """Through the query: all vectors with a common offset, against brute force on what float32 keeps of them."""
    e = spark.read.parquet(f"{MIDDLE}/embeddings.parquet")
    e.withColumn("embedding", F.transform("embedding", lambda x: (x + F.lit(offset)).cast("float"))).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()
    v, ids = np.array([r.embedding for r in rows], np.float32), np.array([r.vec_id for r in rows])
    got = ann.op1_hnsw_shards(spark, str(tmp_path)).toPandas()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        exact = ann.euclidean(v, v[ids == q][0])
        exact[ids == q] = np.inf
        hits += (g["score"].to_numpy() <= np.sort(exact)[9]).sum()
        total += 10
    assert hits >= 0.95 * total


def test_nearest_of_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [3.0]), (300, []), (9, [1.0, 0.5]), *[(1000 + i, [0.0, 1.0]) for i in range(1, 60)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x")).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in ann.op1_hnsw_shards(spark, f"{tmp_path}/a").orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == [1, 100, 9, 7, *range(1001, 1007)]
    assert got[100] == [0, 1, 9, 7, *range(1001, 1007)]
    assert got[200] == [8] and set(got) == {0, 100, 200}
    huge = [(i, [3e38 * (-1) ** i, 1e20 * i]) for i in range(0, 130)] + [(500 + i, [1.0, 2.0]) for i in range(40)] + [(600, [1.0, 2.0])]
    spark.createDataFrame(huge, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/h/embeddings.parquet")
    rows = ann.op1_hnsw_shards(spark, f"{tmp_path}/h").collect()
    assert all(np.isfinite(r.score) for r in rows)
    assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 600] == list(range(500, 510))
    assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 0] == list(range(2, 22, 2))
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert ann.op1_hnsw_shards(spark, f"{tmp_path}/b").collect() == []


# --- toxicity ---------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    random.seed(4)
    word = lambda n: "".join(random.choice("abc") for _ in range(n))
    terms = [toxicity.Term(word(random.randrange(3, 8)), False, random.randrange(3), 1.0) for _ in range(12)]
    stems = [toxicity.Term(word(4), True, 1, 1.0)]
    lexicon, prefix = toxicity.Lexicon(terms), toxicity.Lexicon(stems)
    for _ in range(2000):
        w = word(random.randrange(1, 9))
        best = min((d for t in terms if (d := distance(w, t.text)) <= t.edits), default=None)
        got = lexicon.find(w)
        assert (got and got[1]) == best, w
        stem = min((d for k in range(len(w) + 1) if (d := distance(w[:k], stems[0].text)) <= 1), default=None)
        assert ((found := prefix.find(w)) and found[1]) == stem, w


def test_quotation_counts_less():
    hits = toxicity.Hits(toxicity.Lexicon([toxicity.Term("idiot", False, 1, 5.0)]))
    plain = toxicity.features("you are an idiot and that is all", hits)[0]
    quoted = toxicity.features('he said "you are an idiot" and that is all', hits)[0]
    assert plain[0] > quoted[0] and quoted[1] > plain[1]
    assert [hits[w] for w in ("1diot", "idiott!", "idol", "ox")] == [(0, 1), (0, 1), None, None]


def plain_score(model, text):
    """The score as it is defined, with edit distances in place of the automaton."""
    import math

    def best(word):
        bare = word.strip(toxicity.STRIP)

        def among(w):
            found = []
            for n, t in enumerate(model.terms):
                d = min(distance(w[:k], t.text) for k in range(len(w) + 1)) if t.stem else distance(w, t.text)
                if d <= t.edits:
                    found.append((d, t.stem, n))
            # the fewest edits; a whole term before a beginning of equal edits
            return min(found) if found else None

        hit = among(bare) if len(bare) >= 3 else None
        plain = word.translate(toxicity.LEET).strip(toxicity.STRIP)
        if hit is None and len(bare) >= 4 and not bare.isalpha() and plain.isalpha() and sum(map(str.isalpha, bare)) >= 2:
            hit = among(plain)
            hit = hit and (hit[0] + 1, hit[1], hit[2])
        return hit and (hit[2], hit[0])

    words = text.lower().split()
    hits = [(i, h) for i, w in enumerate(words) if (h := best(w))]
    if not hits:
        return 1 / (1 + math.exp(-model.intercept))
    abuse = quotes = near = most = 0.0
    for j, (i, (n, edits)) in enumerate(hits):
        q = toxicity.quoted(words, i)
        others = sum(1 for k, _ in hits[max(0, j - toxicity.WINDOW) : j + toxicity.WINDOW + 1] if k != i and abs(k - i) <= toxicity.WINDOW)
        weight = model.terms[n].weight * (0.6 if edits else 1.0)
        abuse, quotes, near = abuse + weight * (1 - q) * (1 + 0.25 * min(others, 4)), quotes + weight * q, near + bool(edits)
        most = max(most, model.terms[n].weight * (1 - q))
    x = [math.log1p(abuse), math.log1p(quotes), math.log1p(100 * len(hits) / len(words)), math.log1p(near), most, math.log1p(len(hits)), 1.0]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.coefficients, strict=True)) - model.intercept))


def test_scores_equal_plain_ones():
    terms = [toxicity.Term("idiot", False, 1, 4.0), toxicity.Term("scum", True, 0, 3.0), toxicity.Term("worthless", False, 2, 5.0), toxicity.Term("stupid", True, 1, 2.5)]
    model = toxicity.Model(terms, np.array([0.9, -0.7, 0.4, 0.2, 0.3, 0.5, -0.1]), -2.0)
    random.seed(11)
    pool = "you are an idiot idiott 1d10t scum scumbag wortless w0rthless stupid stupids stupdity he said the cat 'idiot' \"scum house and then some".split()
    score = model.scorer()
    for _ in range(150):
        text = " ".join(random.choice(pool) for _ in range(random.randrange(0, 25)))
        assert score(text) == pytest.approx(plain_score(model, text), abs=1e-12), text


def test_held_out_accuracy(spark):
    got = toxicity.op3_lexicon_automata(spark, MIDDLE).toPandas().merge(spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas(), on="doc_id")
    import zlib

    assert all((zlib.crc32(str(d).encode()) % 4 == 2) == h for d, h in zip(got.doc_id, got.held_out, strict=True))
    out = got[got.held_out]
    bad, good = out[out.toxic == 1], out[out.toxic == 0]
    assert (bad.predicted == 1).mean() >= 0.8 and (good.predicted == 0).mean() >= 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_of_odd_rows(spark, tmp_path, odd_rows):
    path = write(spark, tmp_path, odd_rows)
    none = write(spark, tmp_path / "none", [])
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{none}/labels.parquet")
    assert toxicity.op3_lexicon_automata(spark, none).collect() == []
    for n, labels in enumerate(([], [(1, 1), (2, None), (None, 1), (3, 0), (6, 0)], [(1, 0), (6, 0)])):
        spark.createDataFrame(labels, "doc_id long, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
        got = toxicity.op3_lexicon_automata(spark, path).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got), n


# --- quality ----------------------------------------------------------------------------------------------------------


def base(text):
    words = W.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_base_statistics(spark, sf, odd, empty, tmp_path):
    random.seed(6)
    texts = [" ".join(random.choice("ab") for _ in range(random.randrange(0, 30))) + random.choice(("", "\na\na\n \n", "\t#*é😀|<")) for _ in range(200)]
    write(spark, tmp_path, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for path in (sf, odd, str(tmp_path)):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
        got = quality.op5_covariance_outliers(spark, path).collect()
        assert collections.Counter(tuple(r)[:6] for r in got) == collections.Counter((d, *base(t)) for d, t in docs)
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept is False if r.base_failed else r.kept is not None
    assert quality.op5_covariance_outliers(spark, empty).collect() == []


def test_outliers_are_junk_and_clean_rows_stay(spark):
    got = quality.op5_covariance_outliers(spark, MIDDLE).toPandas().merge(spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas(), on="doc_id")
    judged = got[~got.base_failed]
    assert (~judged[judged.quality == 0].kept).mean() >= 0.9
    assert judged[judged.quality == 1].kept.mean() >= 0.99


def test_factor_and_distance_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 5))
    cov, mean, x = a @ a.T + np.eye(5), rng.normal(size=5), rng.normal(size=(20, 5))
    groups = spark.createDataFrame([(0, *map(float, mean), *[float(cov[i, j]) for i in range(5) for j in range(i + 1)])], ["g", *[f"m{i}" for i in range(5)], *[f"c{i}{j}" for i in range(5) for j in range(i + 1)]])
    rows = spark.createDataFrame([(0, *map(float, r)) for r in x], ["g", *quality.DIMS])
    got = quality.with_distance(rows, quality.factored(groups)).toPandas()
    y = got[list(quality.DIMS)].to_numpy() - mean
    assert np.allclose(got["d2"], np.einsum("ni,ij,nj->n", y, np.linalg.inv(cov), y))


def chi_floor(x):
    return np.cov(x.T, bias=True) + np.diag(np.square(quality.FLOORS) / 4)


def test_least_determinant_against_many_starts(spark):
    """The covariance's determinant is no larger than what concentration steps reach from 500 random starts, and planted
    outliers, correlated ones too, stay out of the half."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(5, 5))
    clean = rng.normal(size=(150, 5)) @ a.T
    junk = rng.normal(size=(50, 5)) * 0.2 + a @ np.array([6.0, -6, 6, -6, 6])
    x = np.concatenate([clean, junk])
    rows = spark.createDataFrame([(7, *map(float, r)) for r in x], ["g", *quality.DIMS])
    got = quality.minimum_covariance(rows).first()
    low = np.array([[got[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    mine = 2 * np.log(np.diag(low)).sum()
    h, best = len(x) // 2, np.inf
    for _ in range(500):
        pick = rng.choice(len(x), 6, replace=False)
        for _ in range(30):
            mean, cov = x[pick].mean(0), chi_floor(x[pick])
            y = x - mean
            again = np.argsort(np.einsum("ni,ij,nj->n", y, np.linalg.inv(cov), y))[:h]
            if set(again) == set(pick):
                break
            pick = again
        best = min(best, np.linalg.slogdet(chi_floor(x[pick]))[1])
    assert mine <= best + 0.05
    y = x - np.array([got[f"m{i}"] for i in range(5)])
    d = np.einsum("ni,ij,nj->n", y, np.linalg.inv(low @ low.T), y)
    assert d[150:].min() > np.median(d[:150])


def test_small_groups_take_after_their_language(spark):
    """There is no size at which a group's estimate jumps: one row gives almost the parent's, many rows their own."""
    d = range(5)
    names = ["g", "n", *[f"m{i}" for i in d], *[f"c{i}{j}" for i in d for j in range(i + 1)]]
    at = lambda g, n, m, c: (g, n, *[float(m)] * 5, *[float(c) if i == j else 0.0 for i in d for j in range(i + 1)])
    child = spark.createDataFrame([at(1, 1, 10, 1), at(2, 50, 10, 1), at(3, 10**6, 10, 1)], names)
    parent = spark.createDataFrame([at(9, 10**6, 0, 4)], names)
    got = {r.g: (r.m0, r.c00) for r in quality.shrunk(child, parent, spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "g long, p long")).collect()}
    assert got[1][0] < 0.2 and got[2] == (5.0, 27.5) and got[3][0] == pytest.approx(10, abs=1e-3) and got[3][1] == pytest.approx(1, abs=0.01)


# --- language ---------------------------------------------------------------------------------------------------------


def test_languages(spark):
    got = language.op7_evidence_fusion(spark, MIDDLE).toPandas()
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", F.col("lang").alias("true")).toPandas()
    mine = got[got.kind == "document"].merge(docs, on="doc_id")
    assert len(mine) == len(docs) and (mine.lang == mine.true).mean() >= 0.98
    pages = got[got.kind == "page"]
    assert pages.page_id.is_unique and (pages.lang == pages.declared).mean() >= 0.95
    assert got.probability.between(0, 1.000001).all()


def test_other_evidence_decides_where_text_is_silent(spark):
    base = [("page", None, i, [-9.0, -90.0] if i % 2 else [-90.0, -9.0], "en" if i % 2 else "fr", "com/en" if i % 2 else "com/fr", "a.com", f"{'e' if i % 2 else 'f'}.a.com") for i in range(40)]
    silent = [("page", None, 100, [0.0, 0.0], "fr", None, None, None), ("page", None, 101, [0.0, 0.0], None, None, "a.com", "e.a.com"), ("page", None, 102, [0.0, 0.0], None, "com/fr", None, None), ("page", None, 103, [0.0, 0.0], None, None, None, None)]
    df = spark.createDataFrame(base + silent, "kind string, doc_id long, page_id long, logs array<double>, declared string, address string, domain string, host string")
    got = {r.page_id: r.lang for r in language.fuse(df, ["en", "fr"]).collect()}
    assert got[100] == "fr" and got[101] == "en" and got[102] == "fr" and got[103] in ("en", "fr")


def plain_fusion(rows, n):
    """The fused log evidence of (logs, declared, address, domain, host), row by row."""
    soft = lambda a: np.exp(np.array(a) - max(a)) / np.exp(np.array(a) - max(a)).sum()
    cool = [language.TEMPER * np.array(r[0]) for r in rows]
    post = [soft(c) for c in cool]
    root = (sum(post) + 1) / (len(rows) + n)
    total_of = lambda k, v: sum((p for r, p in zip(rows, post, strict=True) if r[k] == v), np.zeros(n))
    out = []
    for r, c, p in zip(rows, cool, post, strict=True):
        prior = root
        if r[4] is not None:
            domain = root
            if r[3] is not None:
                d = total_of(3, r[3])
                domain = (d + language.SMOOTH_HOST * root) / (d.sum() + language.SMOOTH_HOST)
            h = total_of(4, r[4])
            prior = (np.maximum(h - p, 0) + language.SMOOTH_HOST * domain) / (h.sum() - 1 + language.SMOOTH_HOST)
        logs = c + np.log(np.maximum(prior, 1e-12))
        for k in (1, 2):
            if r[k] is not None:
                others, whole = np.maximum(total_of(k, r[k]) - p, 0), np.maximum(sum(post) - p, 0)
                logs = logs + language.TRUST * np.log((others + language.SMOOTH_CODE) / (whole + language.SMOOTH_CODE * n))
        out.append(soft(logs))
    return out


@pytest.mark.parametrize("sent", [10**6, 0])
def test_fusion_equals_a_plain_one(spark, monkeypatch, sent):
    from textloom.operators import joins

    monkeypatch.setattr(joins, "SENT", sent)  # hot keys dealt out, or all sent
    random.seed(5)
    pick = lambda *v: random.choice([*v, None])
    rows = [([random.uniform(-30, 0) for _ in range(3)], pick("en", "fr"), pick("com/en", "fr/"), *(lambda h: (h and h[2:], h))(pick("a.x.com", "b.x.com", "c.y.fr"))) for _ in range(80)]
    df = spark.createDataFrame([("page", None, i, *r) for i, r in enumerate(rows)], "kind string, doc_id long, page_id long, logs array<double>, declared string, address string, domain string, host string")
    got = {r.page_id: (r.lang, r.probability) for r in language.fuse(df, ["l0", "l1", "l2"]).collect()}
    for i, p in enumerate(plain_fusion(rows, 3)):
        assert got[i] == (f"l{p.argmax()}", pytest.approx(p.max(), abs=1e-9)), i


def test_languages_of_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [])
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert language.op7_evidence_fusion(spark, str(tmp_path)).collect() == []
    spark.createDataFrame([(1, "http://a.de/x", "<html lang=de><p>und")], "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert [(r.page_id, r.lang) for r in language.op7_evidence_fusion(spark, str(tmp_path)).collect()] == [(1, "und")]


def test_languages_of_odd_rows(spark, tmp_path):
    path = write(spark, tmp_path, ODD)
    pages = [(1, None, None), (2, "no address", "<html lang=de>"), (None, "http://h/en/x", "<p>x"), (2, "http://u@h.de:80/fr?x", "<HTML class='a' lang='FR-ca'><script>x</script>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    got = language.op7_evidence_fusion(spark, path).toPandas()
    assert len(got) == len(ODD) + 4 and got.lang.notna().all()
    assert set(got.declared.dropna()) == {"de", "fr"} and set(got[got.kind == "page"].host.dropna()) == {"h", "h.de"}
    assert isinstance(got, pd.DataFrame)


@pytest.mark.parametrize("text", ["", "Hello wörld " * 20000, "\ud800 lone", "日本語 текст ελ"])
def test_trigrams_of_any_text(text):
    assert (language.trigrams(text) < language.LETTERS**3).all()


def test_tasks_of_scores_go_without_pandas():
    """Each worker of an executor would hold 44 MB for it."""
    import subprocess
    import sys
    from pathlib import Path

    says = "import sys; from textloom.llm import toxicity; assert 'pandas' not in sys.modules"
    subprocess.run([sys.executable, "-c", says], check=True, cwd=Path(__file__).resolve().parents[2])


def test_terms_counted_in_parts(spark):
    """More beginnings of words than a task counts at once: the parts are added up."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i:06d}" for i in range(30_000)]
    rows = [(" ".join(words[k : k + 5_000]), k % 2) for k in (0, 5_000, 10_000, 15_000, 20_000, 25_000, 0, 5_000)]
    got = {(r.term, r.stem): r for r in toxicity.candidates(spark.createDataFrame(rows, "text string, toxic int").coalesce(1)).collect()}
    assert all(got[w, False].toxic + got[w, False].clean == (2 if i < 10_000 else 1) for i, w in enumerate(words))
    assert len(got) > toxicity.COUNTED

"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, kept as flat neighbour arrays.

Distinct vectors are dealt to shards of about SHARD members by hash, so each shard is a sample of all. A shard's graph is
loaded in bulk: a level at a time, neighbours chosen by the diversity heuristic of HNSW from each node's nearest members
of that level, plus their reverse links. Up to this size a matrix product finds these members in less time than searches
for each insertion would. Every node can be reached from the first of the top level: one that pruning has cut off is
linked again by a spare place of the nearest node that can be reached. All distances are double and taken from differences
of components, so a common offset or tight clusters cancel nothing.

Query blocks are searched in every shard and the shard results merged. An index goes to a task once for GROUP blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, table, text_batches

SHARD, LINKS, NEAR, EF, BLOCK, GROUP = 16384, 16, 64, 256, 512, 32
STEP = 4  #: candidates that a query expands at once
BASE = 6  #: one member in so many is also a member of the next level
K, QUERIES = 10, 100
INDEX = "id int, n int, dim int, wide boolean, vectors binary, ids binary, offsets binary, members binary, links binary"


def scaled(v: np.ndarray) -> np.ndarray:
    """v about its mean, as double, shrunk where squares could overflow; the order of distances stays."""
    v = v.astype(np.float64)
    big = np.abs(v).max(initial=0)
    v = v / (big if big > 1e100 else 1.0)
    return v - v.mean(axis=0)


def rows_at_once(width: int, dim: int) -> int:
    """Rows to work on at once, so that `width` vectors for each take about 32 MB whatever their length."""
    return int(np.clip((32 << 20) // (8 * max(width * dim, 1)), 8, BLOCK))


def nearest_members(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, squared distances) of the `most` nearest others of each row of v, nearest first. A product of matrices
    finds a few more, differences order them."""
    n = len(v)
    c = min(most, n - 1)
    near, own = np.empty((n, c), np.int64), np.empty((n, c))
    norms, step = (v * v).sum(1), rows_at_once(c + 8, v.shape[1])
    for a in range(0, n, step):
        block = v[a : a + step]
        d = norms[None] - 2 * block @ v.T
        d[np.arange(len(block)), np.arange(a, a + len(block))] = np.inf
        wide = min(c + 8, n - 1)
        some = np.argpartition(d, wide - 1, axis=1)[:, :wide]
        exact = ((v[some] - block[:, None]) ** 2).sum(2)
        order = np.argsort(exact, axis=1, kind="stable")[:, :c]
        near[a : a + step], own[a : a + step] = np.take_along_axis(some, order, 1), np.take_along_axis(exact, order, 1)
    return near, own


def chosen(v: np.ndarray, near: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """For each row of v the places (columns of `near`) of up to `most` neighbours: one is taken if it is closer to the row
    than to any taken before; what room is left goes to the closest of the others. -1 fills up."""
    n, c = near.shape
    out, step = np.full((n, min(most, c)), -1), rows_at_once(c, v.shape[1])
    for a in range(0, n, step):
        rel = v[near[a : a + step]] - v[a : a + step, None]
        sq = own[a : a + step]
        apart = sq[:, :, None] + sq[:, None] - 2 * rel @ rel.transpose(0, 2, 1)
        taken, count = np.zeros(sq.shape, bool), np.zeros(len(sq), int)
        for j in range(c):
            taken[:, j] = (count < most) & ~(taken[:, :j] & (apart[:, j, :j] < sq[:, j : j + 1])).any(axis=1)
            count += taken[:, j]
        out[a : a + step] = np.argsort(np.where(taken, 0, c) + np.arange(c), axis=1)[:, :most]
    return out


def reached(links: np.ndarray, start: int, seen: np.ndarray) -> None:
    """Marks in `seen` what can be reached from `start`."""
    seen[start] = True
    front = np.array([start])
    while len(front):
        to = np.unique(links[front])
        front = to[(to >= 0) & ~seen[np.maximum(to, 0)]]
        seen[front] = True


def build(vectors: np.ndarray, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from 0 up: (members, flat neighbours): neighbours are positions in `vectors`, a row per member. The last
    neighbour of a row is the spare place."""
    n, x = len(vectors), scaled(vectors)
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(BASE)).astype(int)
    root = int(level.argmax()) if n else 0
    out = []
    for at in range(int(level.max(initial=0)) + 1):
        members = np.flatnonzero(level >= at)
        most = 2 * LINKS if at == 0 else LINKS
        v, half = x[members], most // 2
        links = np.full((len(members), most + 1), -1)
        if len(members) > 1:
            near, own = nearest_members(v, NEAR)
            places = chosen(v, near, own, half)
            mine, dist = np.take_along_axis(near, places, 1), np.take_along_axis(own, places, 1)
            links[:, : mine.shape[1]] = mine
            # reverse links: the closest first, as far as there is room
            src, dst = np.repeat(np.arange(len(members)), mine.shape[1]), mine.ravel()
            order = np.lexsort((src, dist.ravel(), dst))
            src, dst = src[order], dst[order]
            place = np.arange(len(dst)) - np.searchsorted(dst, dst)
            fits = place < most - half
            links[dst[fits], half + place[fits]] = src[fits]
            links[:, :most] = np.sort(links[:, :most], axis=1)
            links[:, 1:most][links[:, 1:most] == links[:, : most - 1]] = -1  # linked both ways
            seen = np.zeros(len(members), bool)
            reached(links, int(np.searchsorted(members, root)), seen)
            while not seen.all():
                lost, hosts = int(np.argmin(seen)), np.flatnonzero(seen & (links[:, most] < 0))
                links[hosts[((v[hosts] - v[lost]) ** 2).sum(1).argmin()], most] = lost
                reached(links, lost, seen)
        out.append((members, np.where(links >= 0, members[links], -1).astype(np.int32)))
    return out


def search(queries: np.ndarray, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], ef: int = EF) -> tuple[np.ndarray, np.ndarray]:
    """(positions, squared distances) of the `ef` nearest found of each query, -1 and inf filling up. All queries step
    together: each expands its nearest unexpanded candidates until none is left among its best `ef`."""
    q, n = len(queries), len(vectors)
    top = levels[-1][0]
    beam = np.full((q, ef), -1)
    dist = np.full((q, ef), np.inf)
    start = top[: min(ef, len(top))]
    beam[:, : len(start)] = start
    dist[:, : len(start)] = ((queries[:, None] - vectors[start][None]) ** 2).sum(2)
    for at in range(len(levels) - 1, -1, -1):
        members, links = levels[at]
        row = np.full(n, -1)
        row[members] = np.arange(len(members))
        seen = np.zeros((q, n + 1), bool)  # the last column takes what is no neighbour
        seen[:, n] = True
        seen[np.arange(q)[:, None], np.where(beam >= 0, beam, n)] = True
        open_ = beam >= 0
        while True:
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                break
            best = np.where(open_[live], dist[live], np.inf)
            pick = np.argpartition(best, STEP - 1, axis=1)[:, :STEP] if ef > STEP else np.argsort(best, axis=1)
            good = np.isfinite(np.take_along_axis(best, pick, 1))
            open_[live[:, None], pick] &= ~good
            to = np.where(good[:, :, None], links[row[beam[live[:, None], pick]]], -1).reshape(len(live), -1)
            to = np.where(to >= 0, to, n)
            fresh = ~seen[live[:, None], to]
            to = np.sort(np.where(fresh, to, n), axis=1)
            fresh = (to < n) & np.concatenate((np.ones((len(live), 1), bool), to[:, 1:] != to[:, :-1]), axis=1)
            seen[live[:, None], to] = True
            r, c = np.nonzero(fresh)
            d = np.full(to.shape, np.inf)
            d[r, c] = ((vectors[to[r, c]] - queries[live[r]]) ** 2).sum(1)
            alln, alld = np.concatenate([beam[live], np.where(fresh, to, -1)], 1), np.concatenate([dist[live], d], 1)
            allo = np.concatenate([open_[live], fresh], 1)
            order = np.argpartition(alld, ef - 1, axis=1)[:, :ef]
            beam[live], dist[live], open_[live] = (np.take_along_axis(x, order, 1) for x in (alln, alld, allo))
    return beam, dist


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to b in double; components beyond the root of the largest double are scaled first."""
    d = np.abs(a.astype(np.float64) - b.astype(np.float64))
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.sqrt((d * d).sum(1))
        big = d.max(axis=1, initial=0)
        return np.where(np.isfinite(out), out, big * np.sqrt(((d / np.maximum(big, 1)[:, None]) ** 2).sum(1)))


def usable(v: Column) -> Column:
    """Not null, empty, zero, or with a null or non-finite component."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0)


def classes(vectors: DataFrame, most: int) -> DataFrame:
    """(vec, ids): each distinct vector with the `most` least vec_ids that have it. Two steps, so that a vector that a
    third of all rows share is gathered in 1024 parts."""
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, most)
    part = vectors.groupBy("vec", F.pmod(F.xxhash64("vec_id"), F.lit(1024)).alias("salt")).agg(least(F.collect_list("vec_id")).alias("ids"))
    return part.groupBy("vec").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def index(of: DataFrame, shards: int, wide: bool) -> DataFrame:
    """A row per shard of (id, vec, ids), ids from 0: INDEX, its arrays as little-endian binary."""

    def made(shard: int, vecs: list, ids: list, counts: list) -> pa.RecordBatch:
        v, i, c = np.concatenate(vecs), np.concatenate(ids), np.concatenate(counts)
        levels = build(v, shard)
        pack = lambda parts: b"".join(np.concatenate([[len(p)], np.ravel(p)]).astype("<i4").tobytes() for p in parts)
        columns = [shard, len(v), v.shape[1], wide, v.astype("<f8" if wide else "<f4").tobytes(), i.astype("<i8").tobytes(), np.concatenate([[0], np.cumsum(c)]).astype("<i4").tobytes(), pack([m for m, _ in levels]), pack([k for _, k in levels])]
        kinds = [pa.int32()] * 3 + [pa.bool_()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    def run(batches):
        shard, vecs, ids, counts = None, [], [], []
        for batch in batches:
            s = batch.column("id").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True]))) if len(s) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if s[a] != shard and vecs:
                    yield made(shard, vecs, ids, counts)
                    vecs, ids, counts = [], [], []
                shard, part = int(s[a]), batch.slice(a, b - a)
                vecs.append(flat(part.column("vec")).reshape(b - a, -1))
                ids.append(flat(part.column("ids")))
                counts.append(part.column("ids").value_lengths().to_numpy())
        if vecs:
            yield made(shard, vecs, ids, counts)

    dealt = of.select("id", "vec", "ids").repartitionById(shards, "id")
    return dealt.sortWithinPartitions("id", F.element_at("ids", 1)).mapInArrow(run, INDEX)


def levels_of(members: np.ndarray, links: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out, i, j = [], 0, 0
    while i < len(members):
        n, rows = members[i], links[j]
        width = (LINKS if out else 2 * LINKS) + 1
        out.append((members[i + 1 : i + 1 + n], links[j + 1 : j + 1 + rows * width].reshape(rows, width)))
        i, j = i + 1 + n, j + 1 + rows * width
    return out


def found_by(shard: dict, ask: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score) of the k best of all that a shard's search has found, ties to the lesser id."""
    v, ids, offsets = shard["v"], shard["ids"], shard["offsets"]
    shift = float(np.abs(v).max(initial=0))
    by = shift if shift > 1e100 else 1.0
    x, step = v.astype(np.float64) / by, rows_at_once(2 * STEP * LINKS, v.shape[1])
    parts = [search(q[a : a + step].astype(np.float64) / by, x, shard["levels"]) for a in range(0, len(q), step)]
    beam, dist = (np.concatenate(p) for p in zip(*parts, strict=True))
    out = []
    for i, (b, d) in enumerate(zip(beam, dist, strict=True)):
        # the k + 1 best vectors have k ids besides the query's own; those as near as the last of them tie with it
        last = np.sort(d)[min(k, len(d) - 1)]
        b = b[(b >= 0) & (d <= last * (1 + 1e-9))]
        scores = euclidean(v[b], q[i])
        mine = sorted((s, int(x)) for s, c in zip(scores.tolist(), b.tolist(), strict=True) for x in ids[offsets[c] : offsets[c + 1]] if x != ask[i])
        out += [(int(ask[i]), x, s) for s, x in mine[:k]]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each of queries (query_id, vec) among vectors (vec_id,
    vec), by Euclidean distance in double precision, the query's own id left out, ties to the lesser vec_id. Vectors of
    another length than the query's are no candidates. Components are float or double."""
    text_batches(vectors.sparkSession)
    wide = vectors.schema["vec"].dataType.elementType == T.DoubleType()
    of = keep(classes(vectors, k + 1).withColumn("dim", F.size("vec")), "vectors", wide=True)
    count = F.ceil(F.count("*") / SHARD).cast("int")
    before = Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)  # a row per length
    plan = of.groupBy("dim").agg(count.alias("shards")).withColumn("first", F.coalesce(F.sum("shards").over(before), F.lit(0)).cast("int"))
    plan = F.broadcast(keep(plan, "plan"))
    total = plan.agg(F.sum("shards")).first()[0] or 0
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dealt = of.join(plan, "dim").withColumn("id", (F.col("first") + F.pmod(F.xxhash64("vec"), F.col("shards"))).cast("int"))
    made = keep(index(dealt, total, wide), "index", wide=True)

    queries = keep(queries.withColumn("dim", F.size("vec")), "queries")
    blocks = -(-queries.count() // BLOCK) or 1
    grouped = queries.groupBy("dim", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("query_id").alias("asked"), F.flatten(F.collect_list("vec")).alias("query_vecs"))
    groups = -(-blocks // GROUP)
    part = lambda id_, group: (id_ * groups + group).cast("int")
    asked = grouped.join(plan, "dim").withColumn("id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)))
    asked = asked.select(part(F.col("id"), F.pmod(F.col("block"), F.lit(groups))).alias("part"), (F.col("block") + 1).alias("turn"), "asked", "query_vecs")
    sent = made.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: part(F.col("id"), g)))).withColumn("turn", F.lit(0))

    def run(batches):
        shard: dict = {}
        for batch in batches:
            raw = {c: batch.column(c) for c in batch.schema.names}
            binary = lambda c, i, kind, raw=raw: np.frombuffer(raw[c][i].as_buffer(), kind)
            for i in range(batch.num_rows):
                if raw["turn"][i].as_py() == 0:
                    v = binary("vectors", i, "<f8" if raw["wide"][i].as_py() else "<f4").reshape(raw["n"][i].as_py(), -1)
                    levels = levels_of(binary("members", i, "<i4").copy(), binary("links", i, "<i4").copy())
                    shard = {"part": raw["part"][i].as_py(), "v": v.copy(), "ids": binary("ids", i, "<i8").copy(), "offsets": binary("offsets", i, "<i4").copy(), "levels": levels}
                elif shard and shard["part"] == raw["part"][i].as_py():
                    ask = raw["asked"][i].values.to_numpy(zero_copy_only=False)
                    q = raw["query_vecs"][i].values.to_numpy(zero_copy_only=False).reshape(len(ask), -1)
                    out = found_by(shard, ask, q, k)
                    yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    both = sent.unionByName(asked, allowMissingColumns=True).repartitionById(total * groups, "part").sortWithinPartitions("part", "turn")
    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of all vectors to each vector whose id is divisible by 100.

    Rows with a null id take no part; rows of one vec_id and vector count once, and a query whose id has several vectors
    asks with the least; an empty table gives no rows; extra columns are not read.
    """
    e = table(spark, sf_dir, "embeddings")
    kind = e.schema["embedding"].dataType.elementType
    vec = e["embedding"] if kind in (T.FloatType(), T.DoubleType()) else e["embedding"].cast("array<double>")
    vectors = e.select(e["vec_id"].cast("long").alias("vec_id"), vec.alias("vec")).where(usable(F.col("vec")) & F.col("vec_id").isNotNull())
    queries = vectors.where(F.col("vec_id") % QUERIES == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    return nearest(vectors, queries)

"""SimHash near-duplicates through pivot distance tables.

Every fingerprint carries its Hamming distances to fixed reference fingerprints. Two fingerprints within r of each other
differ by at most r in each of these distances, so a pair with a larger difference anywhere is discarded unread, and only
survivors are compared bit by bit. That alone would still look at every pair, so pairs are first confined to buckets that
lose none of them: for radius r, fingerprints cut into r + a sections agree in a sections at least. The more fingerprints,
the larger a, so that buckets stay small: two sections have 25 bits, three 32, four 37. Buckets above HOT members are cut into chunks along the first distance and chunk pairs are dealt out as tasks of their own.
"""

from __future__ import annotations

from itertools import combinations
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest, fresh, keep, keyed_join, ordered_sums, release, salted_join, table, temporaries, text_batches
from .graph import components

PIVOTS = 16
HOT = 600
SENT = 2_000_000  # nodes, at most, that are sent to every task
RADIUS, SHINGLE = 3, 3
STAGE_SHINGLE, STAGE_WORDS, STAGE_SIMILARITY, ANCHORS = 5, 4, 0.8, 6
SEED = 42


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of 64-bit hashes (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles, A-Z lower-cased; of the whole sequence if it has fewer words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have bit 0 to 63 set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 64):  # 255 rows add up within a byte
        bits = np.unpackbits(h[at : at + 255 * 64].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):
            total += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    return total


def fingerprint(h: np.ndarray, words: int = 1) -> np.ndarray:
    """`words` 64-bit words whose bits are 1 where over half of the hashes (and of their further hashes) have a 1."""
    out = np.zeros(words, np.uint64)
    if len(h):
        for k in range(words):
            on = bit_counts(h if k == 0 else mixed(h, k)) * 2 > len(h)
            out[k] = np.packbits(on, bitorder="little").view("<u8")[0]
    return out


def pivots(words: int) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random bits, the same in every run."""
    return mixed(np.arange(1, PIVOTS * words + 1, dtype=np.uint64), 1000).reshape(PIVOTS, words)


def distances(bits: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The table of Hamming distances of fingerprints (n x words) to the references."""
    return np.stack([np.bitwise_count(bits ^ r).sum(axis=1) for r in refs], axis=1).astype(np.int16)


def star(bits: np.ndarray, table_: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the position of the first one of its component, links being within `radius`."""
    n = len(bits)
    order = np.argsort(table_[:, 0], kind="stable")
    bits, dist = bits[order], table_[order]
    first, root = dist[:, 0], np.full(n, -1)
    free = np.arange(n)
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start] = start
        todo = [start]
        while todo:
            x = todo.pop()
            free = free[root[free] < 0]
            low, high = np.searchsorted(first[free], (first[x] - radius, first[x] + radius + 1))
            near = free[low:high]
            near = near[(np.abs(dist[near] - dist[x]) <= radius).all(axis=1)]
            near = near[np.bitwise_count(bits[near] ^ bits[x]).sum(axis=1) <= radius]
            root[near] = start
            todo += near.tolist()
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def accompanied(bits: np.ndarray, table_: np.ndarray, radius: int) -> np.ndarray:
    """Which fingerprints have another one within `radius`."""
    at = star(bits, table_, radius)
    return np.bincount(at, minlength=len(at))[at] > 1


def bucket_links(rows: DataFrame, words: int, radius: int, ends: bool = False) -> DataFrame:
    """Links (a, b) among the members of each bucket of (key, node, bits, dist), dealt and sorted by key: a star for each
    component that a bucket has. Buckets are read as a stream; the largest has 2 x HOT members.

    ends: instead, of buckets of (.., side) each node that has a link, once. A bucket of two sides, which are buckets too,
    leaves out those that have one on their own side."""

    def run(batches):
        key, side = np.zeros(0, np.int64), np.zeros(0, np.int64)
        node, bits, dist = np.zeros(0, np.int64), np.zeros((0, words), np.uint64), np.zeros((0, PIVOTS), np.int16)

        def flush(end: int) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.concatenate(([True], key[1:end] != key[: end - 1], [True])))
            a, b = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s > 1 and ends:
                    new, own = accompanied(bits[s:e], dist[s:e], radius), side[s:e]
                    for k in np.unique(own) if own.min() < own.max() else ():
                        mine = np.flatnonzero(own == k)
                        new[mine[accompanied(bits[s:e][mine], dist[s:e][mine], radius)]] = False
                    a.append(node[s:e][new])
                elif e - s > 1:
                    at = star(bits[s:e], dist[s:e], radius)
                    to = np.flatnonzero(at != np.arange(e - s))
                    a.append(node[s:e][to])
                    b.append(node[s:e][at[to]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in ((a,) if ends else (a, b))], names=["node"] if ends else ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.to_pydict()
            key = np.concatenate([key, raw["key"]]).astype(np.int64)
            side = np.concatenate([side, raw["side"]]).astype(np.int64) if ends else side
            node = np.concatenate([node, raw["node"]]).astype(np.int64)
            bits = np.concatenate([bits, np.frombuffer(b"".join(raw["bits"]), "<u8").reshape(-1, words)])
            dist = np.concatenate([dist, np.frombuffer(b"".join(raw["dist"]), "<i2").reshape(-1, PIVOTS)])
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield flush(whole)
                key, side, node, bits, dist = key[whole:], side[whole:], node[whole:], bits[whole:], dist[whole:]
        if len(key):
            yield flush(len(key))

    dealt = rows.select("key", "node", "bits", "dist", *(["side"] if ends else [])).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "node long" if ends else "a long, b long")


def links(keyed: DataFrame, words: int, radius: int, ends: bool = False) -> DataFrame:
    """Links that connect all (key, node, bits, dist) that share a key and differ in at most `radius` bits. ends: instead,
    the nodes that such a link has, (node), some of them more than once. In a group that is cut into chunks those with a link
    in their own chunk come once for each key, not for each pair of chunks."""
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key")
    many = keep(many, "hot-buckets")
    found = bucket_links(keyed.join(many, "key", "left_anti").withColumn("side", F.lit(0).cast("long")), words, radius, ends)
    if many.isEmpty():
        return found
    hot = keyed.join(many, "key", "left_semi").withColumn("_one", F.lit(1).cast("long"))
    hot = keep(ordered_sums(hot, ["key"], ["d0", "node"], "_one", "hot").withColumn("chunk", F.floor(F.col("before") / HOT)).select("key", "chunk", "d0", "node", "bits", "dist"), "hot-chunks")
    spans = hot.groupBy("key", "chunk").agg(F.min("d0").alias("low"), F.max("d0").alias("high"))
    other = spans.select("key", F.col("chunk").alias("chunk2"), F.col("low").alias("low2"))
    near = spans.join(other, "key").where(f"chunk2 >= chunk and low2 - high <= {radius}").select("key", "chunk", "chunk2")
    sides = near.select("key", "chunk", F.xxhash64("key", "chunk", "chunk2").alias("pair")).unionByName(near.where("chunk < chunk2").select("key", F.col("chunk2").alias("chunk"), F.xxhash64("key", "chunk", "chunk2").alias("pair")))
    pairs = hot.join(sides, ["key", "chunk"]).select(F.col("pair").alias("key"), "node", "bits", "dist", F.col("chunk").alias("side"))
    return found.unionByName(bucket_links(pairs, words, radius, ends))


def matches(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of hashes the position of the first one of its component, links being Jaccard similarities of
    `similarity` or more. What two sets share is counted through the lists of the sets that hold a hash."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    _, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(n), size), times[ids] > 1
    owner, ids = owner[shared], ids[shared]
    cuts = np.searchsorted(owner, np.arange(n + 1))
    holders = owner[np.argsort(ids, kind="stable")]
    first = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(times)))))
    root, listed, free = np.full(n, -1), n, n
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start] = start
        free -= 1
        todo = [start]
        while todo and free:
            if 2 * free < listed:  # lists of those only that have no component yet
                open_ = root[holders] < 0
                first = np.concatenate(([0], np.cumsum(open_)))[first]
                holders, listed = holders[open_], free
            x = todo.pop()
            own = ids[cuts[x] : cuts[x + 1]]
            count = first[own + 1] - first[own]
            at = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            common = np.bincount(holders[at], minlength=n)
            near = np.flatnonzero((root < 0) & (common >= similarity * (size + size[x] - common) - 1e-9))
            root[near] = start
            free -= len(near)
            todo += near.tolist()
    return root


def bucket_matches(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among the members of each bucket of (key, node, shingles), as `bucket_links` gives them, but by the
    Jaccard similarity of the shingle sets."""

    def run(batches):
        key, node, sets = [], [], []

        def flush(end: int) -> pa.RecordBatch:
            a, b, s = [], [], 0
            for e in range(1, end + 1):
                if e == end or key[e] != key[s]:
                    if e - s > 1:
                        for i, at in enumerate(matches(sets[s:e], similarity).tolist()):
                            if at != i:
                                a.append(node[s + i])
                                b.append(node[s + at])
                    s = e
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.to_pydict()
            key += raw["key"]
            node += raw["node"]
            sets += [np.frombuffer(x, "<u8") for x in raw["shingles"]]
            whole = len(key) - 1
            while whole and key[whole - 1] == key[-1]:
                whole -= 1
            if whole:
                yield flush(whole)
                del key[:whole], node[:whole], sets[:whole]
        if key:
            yield flush(len(key))
            del key, node, sets
        release()

    dealt = rows.select("key", "node", "shingles").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def verified_links(keyed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that connect all (key, node) that share a key and whose shingles in `sets` (node, size, shingles) have a
    Jaccard similarity of `similarity` or more. Buckets above HOT are cut into chunks along the size of the sets; chunk
    pairs whose sizes alone rule such a similarity out are skipped. A set counts more, the larger it is. Of buckets with the
    same members one is read."""
    weighed = keyed.join(sets.select("node", "size", (F.floor(F.col("size") / 500) + 1).cast("long").alias("weight")), "node")
    weighed = keep(weighed.select("key", "node", "size", "weight"), "weighed")
    members = [F.count("*").alias("rows"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")]
    buckets = weighed.groupBy("key").agg(F.sum("weight").alias("n"), *members).where("rows > 1")
    buckets = keep(buckets.groupBy("rows", "x", "y").agg(F.min("key").alias("key"), F.max("n").alias("n")).select("key", "n"), "buckets")
    many = buckets.where(F.col("n") > HOT).select("key")
    shingles = sets.select("node", "shingles")
    few = weighed.join(buckets.where(F.col("n") <= HOT).select("key"), "key", "left_semi").select("key", "node")
    found = bucket_matches(few.join(shingles, "node"), similarity)
    if many.isEmpty():
        return found
    hot = weighed.join(many, "key", "left_semi")
    hot = keep(ordered_sums(hot, ["key"], ["size", "node"], "weight", "hot-sets").withColumn("chunk", F.floor(F.col("before") / HOT)).select("key", "chunk", "size", "node"), "hot-set-chunks")
    ends = hot.groupBy("key", "chunk").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    other = ends.select("key", F.col("chunk").alias("chunk2"), F.col("low").alias("low2"))
    near = ends.join(other, "key").where((F.col("chunk2") >= F.col("chunk")) & (F.col("low2") * similarity <= F.col("high") + 1e-9)).select("key", "chunk", "chunk2")
    pair = F.xxhash64("key", "chunk", "chunk2").alias("pair")
    sides = near.select("key", "chunk", pair).unionByName(near.where("chunk < chunk2").select("key", F.col("chunk2").alias("chunk"), pair))
    pairs = hot.join(sides, ["key", "chunk"]).select(F.col("pair").alias("key"), "node").join(shingles, "node")
    return found.unionByName(bucket_matches(pairs, similarity))


def candidate_radius(words: int, similarity: float) -> int:
    """Differing bits of 64 x words that texts of this Jaccard similarity stay within, but for six standard deviations: the
    angle of their shingle sets, and a share of 0.04 for small sets with as many ones as zeros."""
    n, share = 64 * words, acos(2 * similarity / (1 + similarity)) / pi + 0.04
    return min(n, int(n * share + 6 * sqrt(n * share * (1 - share))))


def prints(docs: DataFrame, shingle: int, words: int = 1, anchors: int = 0) -> DataFrame:
    """(doc_id, content, node, bits, dist, d0, anchors, shingles) of (doc_id, text, content); bits and dist are little-endian
    binary, d0 is the first distance, node a long that stands for bits: the fingerprint itself, if it is one word.

    anchors: the least values of so many further hashes over the shingles, for buckets where the radius is too wide for
    sections; two texts share any one of them with a probability equal to their shingle sets' Jaccard similarity.
    With anchors, a shingle counts once in bits however often it stands, shingles is the set of their hashes, sorted, and
    node stands for that set; without, shingles is null.
    """
    fields = [("doc_id", pa.int64()), ("content", pa.string()), ("node", pa.int64()), ("bits", pa.binary()), ("dist", pa.binary()), ("d0", pa.int32()), ("anchors", pa.list_(pa.int64())), ("shingles", pa.binary())]
    refs = pivots(words)
    text_batches(docs.sparkSession)

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            bits, least, sets = [], [], []
            for t in batch.column("text"):
                h = shingle_hashes(t.as_py() or "", shingle)
                if anchors:
                    h = np.unique(h)
                sets.append(h.astype("<u8").tobytes() if anchors else None)
                bits.append(fingerprint(h, words))
                least.append([int(mixed(h, 100 + j).min().view(np.int64)) if len(h) else j for j in range(anchors)])
            all_ = np.stack(bits) if bits else np.zeros((0, words), np.uint64)
            dist = distances(all_, refs).astype("<i2")
            raw = [b.astype("<u8").tobytes() for b in bits]
            node = np.array([xxh64_intdigest(b, SEED) for b in sets], np.uint64) if anchors else all_[:, 0] if words == 1 else np.array([xxh64_intdigest(b, SEED) for b in raw], np.uint64)
            columns = [batch.column("doc_id"), batch.column("content"), pa.array(node.view(np.int64)), pa.array(raw, pa.binary()), pa.array([d.tobytes() for d in dist], pa.binary()), pa.array(dist[:, 0], pa.int32()), pa.array(least, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f[1]) for c, f in zip(columns, fields, strict=True)], names=[f[0] for f in fields])
        release()

    return docs.mapInArrow(run, "doc_id long, content string, node long, bits binary, dist binary, d0 int, anchors array<long>, shingles binary")


def sections_for(fingerprints: int, radius: int) -> int:
    """How many sections to agree in: two, or as many more as keep a bucket of evenly spread fingerprints small."""
    agree = 2
    while agree < 5 and fingerprints >> (64 * agree // (radius + agree)) > 4:
        agree += 1
    return agree


def section_keys(bits: Column, radius: int, agree: int = 2) -> Column:
    """Bucket keys of a 64-bit fingerprint (long): each choice of `agree` among radius + agree sections, of which at least
    so many differ in no bit. The number of sections changes the work, never the links."""
    n = radius + agree
    cuts = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*[F.xxhash64(F.lit(i), bits.bitwiseAND(F.lit(signed(sum(c))))) for i, c in enumerate(combinations(masks, agree))])


def near_classes(printed: DataFrame, found: DataFrame) -> DataFrame:
    """printed (written, with node) plus root, which names a row's class: the least node that links (a, b) found connect to
    the row's; and component_id: the least doc_id of the class."""
    firsts = keep(printed.groupBy("node").agg(F.min("doc_id").alias("first")), "firsts")
    roots = keep(components(found), "components")
    joined = keep(roots.join(firsts, "node"), "roots")
    least = keep(joined.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    linked = keyed_join(joined, least, ["root"]).select("node", "root", "component_id")
    of = firsts.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    return salted_join(printed, of, ["node"])  # copies of a text share a node


def simhash_classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, content, fingerprint, component_id) of (doc_id, text): links at `radius` of 64 bits or fewer, exactly."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("content"), "text")
    made = prints(text, shingle).drop("anchors", "shingles")
    printed = keep(made, "prints", wide=True)
    distinct = keep(printed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("bits", "dist", "d0")]), "fingerprints")
    keys = section_keys(F.col("node"), radius, sections_for(distinct.count(), radius))
    keyed = keep(distinct.select(F.explode(keys).alias("key"), "node", "bits", "dist", "d0"), "keyed", wide=True)
    return near_classes(printed, links(keyed, 1, radius)).withColumn("fingerprint", F.lower(F.lpad(F.hex("node"), 16, "0")))


def near_duplicates(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY, words: int = STAGE_WORDS, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, content, root, component_id) of (doc_id, text): texts link if their sets of shingles have a Jaccard
    similarity of `similarity` or more. Candidates share an anchor and have another text there whose fingerprint of 64 x words
    bits lies within a radius that all but loses none; only their whole sets decide. content is the digest of the text."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("content"), "text")
    printed = keep(prints(text, shingle, words, anchors), "prints", wide=True)
    distinct = printed.select("node", "bits", "dist", "d0", F.explode("anchors").alias("anchor")).groupBy("node", "anchor").agg(*[F.first(c).alias(c) for c in ("bits", "dist", "d0")])
    keyed = keep(distinct.select(F.col("anchor").alias("key"), "node", "bits", "dist", "d0"), "keyed", wide=True)
    candidates = keep(links(keyed, words, candidate_radius(words, similarity), ends=True).distinct(), "candidates")
    if candidates.count() <= SENT:  # spares a shuffle of every text's set
        candidates = F.broadcast(candidates)
    sets = printed.select("node", "shingles").join(candidates, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = keep(sets.withColumn("size", F.length("shingles") / 8), "sets", wide=True)
    found = verified_links(keyed.select("key", "node"), sets, similarity)
    return near_classes(printed.drop("anchors", "shingles"), found)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one document of each near-duplicate class: that with the least doc_id (of rows of the
    class that share it, one; classes of unrelated texts that share it keep one each). Rows with a null doc_id stay only
    where their whole class has none, one for each text. Null and empty texts are two texts of one class; every column
    of docs stays, of any name; an empty table stays empty."""
    doc, content, n = fresh("_doc", docs), fresh("_content", docs), fresh("_n", docs)
    with temporaries(docs.sparkSession) as outlives:
        classes = outlives(near_duplicates(docs.select("doc_id", "text"), **options), "classes")
    w = classes.groupBy("doc_id", "content", "root", "component_id").agg(F.count("*").alias("n"))
    mine = w.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    alone = F.when(F.col("component_id").isNull(), F.col("content"))
    one = mine.groupBy("root", alone.alias("_alone")).agg(F.min(F.struct("content", "n", "doc_id")).alias("k")).select("k.*")
    # a missing doc_id is no key of a join
    key = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    keys = keep(one.select(key(F.col("doc_id")).alias(doc), F.col("content").alias(content), F.col("n").alias(n)), "kept")
    named = docs.withColumns({doc: key(docs["doc_id"].cast("long")), content: digest(docs["text"])})
    out = named.join(keys.where(F.col(n) == 1).drop(n), [doc, content], "left_semi").drop(doc, content)
    several = keys.where(F.col(n) > 1).drop(n)
    if not several.isEmpty():
        out = out.unionByName(keyed_join(named, keep(several, "repeated"), [doc, content], "left_semi").dropDuplicates([doc, content]).drop(doc, content))
    return out


def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document.

    A null, empty or blank text has the fingerprint zero and links like any other; null doc_ids get the class of their
    text but never name one; repeated rows are returned as often as they stand; an empty table gives no rows.
    """
    return simhash_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from textloom.llm import mixing, packing, sharding

W = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2)])
def test_hilbert_curve_visits_each_cell_by_unit_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[range(1 << bits)] * dims), -1).reshape(-1, dims)
    at = sharding.hilbert_index(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def check_shards(rows, docs):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    counts = [len(by[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    last = -1
    for s in range(8):
        run = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in run] == list(range(len(run)))
        for r in run:
            assert r.hilbert >= last
            last = r.hilbert


def test_shards(spark, sf, odd, empty, odd_rows):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_shards(sharding.op2_hilbert_shards(spark, sf).collect(), docs)
    check_shards(sharding.op2_hilbert_shards(spark, odd).collect(), [r[:2] for r in odd_rows])
    assert sharding.op2_hilbert_shards(spark, empty).collect() == []


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


def check_slots(rows):
    """A document's slots take its words; a slot takes a block at most; and at any point of the schedule each source has had
    its share of the words, but for a few blocks."""
    target, took = {}, defaultdict(Counter)
    for r in rows:
        mine = [tuple(map(int, x.split(":"))) for x in (r.slots or "").split(",") if x]
        assert sum(n for _, n in mine) == r.taken and r.first_slot == (mine[0][0] if mine else None) and mine == sorted(mine)
        target[r.source] = r.target
        for s, n in mine:
            took[s][r.source] += n
    assert all(len(c) == 1 and sum(c.values()) <= mixing.BLOCK for c in took.values())
    total, done, seen = sum(target.values()), Counter(), 0
    for slot in sorted(took):
        done += took[slot]
        seen += sum(took[slot].values())
        assert all(abs(done[s] - seen * t / total) <= 6 * mixing.BLOCK for s, t in target.items())
    assert set(took) >= set(range(int(total // mixing.BLOCK) - len(target)))


def check_mix(rows, docs):
    check_slots(rows)
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(W.findall(t or ""))
    want = expected_targets(dict(sizes))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, len(W.findall(t or ""))) for d, t, _ in docs)
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1


def test_mix(spark, sf, odd, empty, odd_rows):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = mixing.op4_low_discrepancy_mix(spark, sf).collect()
    check_mix(rows, docs)
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.op4_low_discrepancy_mix(spark, sf).collect()))
    check_mix(mixing.op4_low_discrepancy_mix(spark, odd).collect(), [(r[0], r[1], r[3]) for r in odd_rows])
    assert mixing.op4_low_discrepancy_mix(spark, empty).collect() == []


def test_targets_of_many_sources(spark):
    """Thousands of sources of all sizes, empty ones too: against the step by step rule."""
    random.seed(12)
    sizes = {f"s{i:05d}": int(random.paretovariate(0.6)) if i % 11 else 0 for i in range(3000)} | {None: 5000}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows.withColumn("source_key", mixing.F.xxhash64("source"))).collect()}
    want = expected_targets(sizes)
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9) for s in want)


def test_shards_prune_files(spark, sf, tmp_path):
    """Files that curve order has cut have small boxes: a query for one language and a narrow range of sizes meets the
    statistics of a few of them."""
    import pyarrow.parquet as pq

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "source", mixing.F.length("text").cast("long").alias("size"))
    cut = sharding.cut_runs(sharding.hilbert_order(docs, ["size"], ["lang", "source"]), ["hilbert", "doc_id"], 8)
    sharding.write_shards(cut, str(tmp_path / "s"), rows_per_file=25)
    files = list((tmp_path / "s").rglob("*.parquet"))
    boxes = []
    for f in files:
        t = pq.read_table(f, columns=["lang", "size"])
        boxes.append((set(t["lang"].to_pylist()), min(t["size"].to_pylist()), max(t["size"].to_pylist())))
    mid = sorted(s for _, a, b in boxes for s in (a, b))[len(boxes)]
    met = sum(min(ls) <= "fr" <= max(ls) and a <= 1.1 * mid and b >= 0.9 * mid for ls, a, b in boxes)
    assert len(files) >= 30 and met <= 0.6 * len(files)


def test_van_der_corput_reverses_bits(spark):
    got = {r.id: r.p for r in spark.range(64).withColumn("p", mixing.van_der_corput(mixing.F.col("id"), 6)).collect()}
    assert got == {i: int(f"{i:06b}"[::-1], 2) for i in range(64)}


def test_plan_slots_are_dealt_evenly(spark, sf):
    """In any first part of the schedule a source has its share of slots within a few."""
    goals = spark.createDataFrame([(1, 50_000), (2, 20_000), (3, 30_000)], "source_key long, quota long")
    slots = sorted((r.slot, r.source_key, r.block_no) for r in mixing.schedule(goals, 100).collect())
    assert Counter(k for _, k, _ in slots) == {1: 500, 2: 200, 3: 300}
    for n in (100, 333, 700):
        seen = Counter(k for _, k, _ in slots[:n])
        assert all(abs(seen[k] - n * share) <= 6 for k, share in ((1, 0.5), (2, 0.2), (3, 0.3)))


def test_fast_ids_equal_the_tokenizer(odd_rows):
    coder = packing.FastIds(packing.tokenizer_path())
    random.seed(3)
    texts = [r[1] or "" for r in odd_rows]
    texts += ["".join(chr(random.choice((random.randrange(32, 127), random.randrange(0xA0, 0x250), random.randrange(9, 14)))) for _ in range(200)) for _ in range(200)]
    texts += ["".join(chr(random.randrange(1, 0x3000)) for _ in range(50)) for _ in range(50)]
    texts += [" ".join("".join(chr(random.choice((random.randrange(32, 127), random.randrange(0x80, 0x180)))) for _ in range(8)) for _ in range(200)) for _ in range(20)]
    texts += ["don't ''s 's'st I'LL 3.14 __x__ a_b ½ ª º ʰ", "\x1c\x1f\x85\xa0  x", "ǅ ǆ İ ı ẞ ß"]
    for t in texts:
        assert coder.encode(t) == np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def check_pieces(rows, docs, coder):
    want = Counter()
    for d, t in docs:
        ids = coder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(d, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    return len(by), sum(k[3] * n for k, n in want.items())


def test_packing(spark, sf, odd, empty, odd_rows):
    coder = packing.FastIds(packing.tokenizer_path())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bins, total = check_pieces(packing.op9_minimum_bin_slack(spark, sf).collect(), docs, coder)
    assert bins <= -(-total // 2048) * 1.02 + 1
    check_pieces(packing.op9_minimum_bin_slack(spark, odd).collect(), [r[:2] for r in odd_rows], coder)
    assert packing.op9_minimum_bin_slack(spark, empty).collect() == []


def test_fullest_is_the_best_subset_sum():
    random.seed(5)
    for _ in range(200):
        counts = Counter(random.randrange(1, 30) for _ in range(random.randrange(1, 8)))
        room = random.randrange(0, 60)
        sums = {0}
        for x, n in counts.items():
            for _ in range(n):
                sums |= {s + x for s in sums}
        got = packing.fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(x) <= counts[x] for x in got)

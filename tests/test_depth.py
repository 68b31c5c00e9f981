import random
from collections import Counter

from tilewright.operators import depth as D


def dense(blocks, length):
    out = [0] * length
    for s, e in blocks:
        for i in range(max(s, 0), min(e, length)):
            out[i] += 1
    return out


def runs(depths):
    out, start = [], 0
    for i in range(1, len(depths) + 1):
        if i == len(depths) or depths[i] != depths[start]:
            out.append((start, i, depths[start]))
            start = i
    return out


def test_depth_and_its_statistics(spark):
    rng = random.Random(2)
    refs = {"hot": 900, "b": 80, "none": 50}
    blocks = [("hot", s := rng.randrange(880), s + rng.randrange(1, 60)) for _ in range(200)] + [("b", 10, 500), ("b", 90, 95), ("gone", 1, 5), ("b", 0, 20)]
    r = spark.createDataFrame([*refs.items(), ("zero", 0)], "reference_id string, ref_length long")
    seg = D.depth_segments(spark.createDataFrame(blocks, "reference_id string, s long, e long"), r).cache()
    want = {k: dense([(s, e) for t, s, e in blocks if t == k], n) for k, n in refs.items()}
    got = {}
    for x in seg.collect():
        got.setdefault(x.reference_id, []).append((x.seg_start, x.seg_end, x.depth))
    assert {k: sorted(v) for k, v in got.items()} == {k: runs(v) for k, v in want.items()}
    for x in D.probe_coverage_stats(seg, proximity=7).collect():
        d = want[x.reference_id]
        n = len(d)
        s = sorted(d)
        assert x.median_depth == (s[(n - 1) // 2] + s[n // 2]) / 2 and x.covered_bases == sum(v > 0 for v in d)
        near = sum(any(d[j] for j in range(max(0, i - 7), min(n, i + 8))) for i in range(n))
        assert abs(x.pct_near_probe - near / n * 100) < 1e-9
        gaps = [b - a for a, b, v in runs(d) if v == 0]
        assert (x.num_gaps, x.max_gap_length) == (len(gaps), max(gaps, default=0))
    curves = {}
    for x in D.depth_curves(seg).collect():
        curves.setdefault(x.reference_id, {})[x.depth_threshold] = x.pct_covered
    for k, d in want.items():
        assert set(curves[k]) == set(range(1, max(max(d), 1) + 1))
        assert all(abs(p - sum(v >= t for v in d) / len(d) * 100) < 1e-9 for t, p in curves[k].items())
    for x in D.binned_depth(seg, points=9).collect():
        part = want[x.reference_id][x.bin_start : x.bin_end]
        assert abs(x.mean_depth - sum(part) / len(part)) < 1e-9


def test_overlap_join_gives_each_pair_once(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.choice("ab"), s := rng.randrange(500), s + rng.randrange(0, 120)) for _ in range(n)]
    left, right = list(set(make(60))), list(set(make(60)))
    schema = "reference_id string, s long, e long"
    got = Counter((x.reference_id, x.s, x.e, x.r_s, x.r_e) for x in D.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), bin_size=30).collect())
    want = Counter((r, s, e, s2, e2) for r, s, e in left for r2, s2, e2 in right if r == r2 and s < e and s2 < e2 and s < e2 and s2 < e)
    assert got == want


def test_low_coverage_regions_are_widened_and_clipped(spark):
    seg = spark.createDataFrame([("a", 0, 2, 0), ("a", 2, 50, 9), ("a", 50, 52, 1), ("a", 52, 100, 9), ("b", 0, 5, 0), ("c", 0, 40, 0), ("c", 40, 60, 7)], "reference_id string, seg_start long, seg_end long, depth long")
    got = sorted(tuple(x) for x in D.low_coverage_regions(seg, 2, 10).collect())
    assert got == [("a", 0, 10), ("a", 46, 56), ("b", 0, 5), ("c", 0, 40)]


def test_lengths_meet_heavy_references_in_slices(spark):
    seg = spark.createDataFrame([("a", i, i + 1, i % 3) for i in range(60)] + [("b", 0, 7, 0)], "reference_id string, seg_start long, seg_end long, depth long")
    got = D.with_length(seg, seg, per_slice=8).collect()
    assert len(got) == 61 and {(x.reference_id, x.len) for x in got} == {("a", 60), ("b", 7)}


def test_deep_steps_are_filled_in_stretches(spark):
    seg = spark.createDataFrame([("a", 0, 10, 25_003), ("a", 10, 20, 5)], "reference_id string, seg_start long, seg_end long, depth long")
    got = {x.depth_threshold: x.pct_covered for x in D.depth_curves(seg).collect()}
    assert len(got) == 25_003 and got[5] == 100.0 and got[6] == got[25_003] == 50.0
    assert sorted(x.depth_threshold for x in D.depth_curves(seg, most=7).collect()) == [1, 2, 3, 4, 5, 6, 7]

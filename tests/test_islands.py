import random

from tilewright.operators.islands import islands_and_gaps
from tilewright.operators.running import global_rank, running_totals

SCHEMA = "t string, a long, b long, seg_kind string"


def brute(rows):
    out = set()
    by = {}
    for t, a, b, _ in rows:
        if t is not None and a is not None and b is not None and a < b:
            by.setdefault(t, []).append((a, b))
    for t, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(t, "period", a, b) for a, b in merged}
        out |= {(t, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def check(spark, rows, partitions):
    got = [tuple(r) for r in islands_and_gaps(spark.createDataFrame(rows, SCHEMA), "t", "a", "b", partitions).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    for partitions, wide in ((1, 20), (5, 4), (7, 300)):
        rows = [(rng.choice(["hot"] * 6 + ["b", "c", "d"]), s := rng.randrange(3000), s + rng.randrange(-2, wide), "x") for _ in range(600)]
        check(spark, rows + rows[:100], partitions)


def test_one_long_span_over_many_partitions(spark):
    rows = [("hot", 0, 5000, None)] + [("hot", i * 10, i * 10 + 3, None) for i in range(1, 450)] + [("hot", 6000 + 10 * i, 6005 + 10 * i, None) for i in range(50)]
    check(spark, rows, 8)


def test_nulls_touching_nested_negative_and_empty(spark):
    rows = [(None, 1, 2, None), ("a", None, 2, None), ("a", 1, None, None), ("a", 5, 5, None), ("a", 9, 3, None), ("a", -10, -5, None), ("a", -5, 2, None), ("a", -9, -8, None), ("a", 2**62, 2**62 + 5, None), ("", 1, 2, None)]
    check(spark, rows, 3)
    assert islands_and_gaps(spark.createDataFrame([], SCHEMA), "t", "a", "b").count() == 0


def test_copies(spark):
    check(spark, [("a", 3, 9, None)] * 400 + [("a", 12, 15, None)], 4)


def test_running_totals_and_rank(spark):
    rng = random.Random(5)
    rows = [("hot", i, rng.randrange(-5, 9)) for i in range(300)] + [(f"k{i}", j, i + j) for i in range(8) for j in range(i)]
    got = {(r.k, r.at): (r.total, r.prev_at, r.prev_total) for r in running_totals(spark.createDataFrame(rows, "k string, at long, v long"), "k", "at", "v", 7).collect()}
    last = {}
    want = {}
    for k, at, v in sorted(rows):
        p_at, p = last.get(k, (None, None))
        want[k, at] = ((p or 0) + v, p_at, p)
        last[k] = (at, (p or 0) + v)
    assert got == want
    ranked = global_rank(spark.createDataFrame([(x,) for x in rng.sample(range(10_000), 500)], "x long"), ["x"]).orderBy("x").collect()
    assert [r["rank"] for r in ranked] == list(range(500))

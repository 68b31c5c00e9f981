import random

from tilewright.llm.topn import top_items

SCHEMA = "p string, m string, s double, t string, i long, item_rank string, bound long"


def brute(rows, n):
    groups = {}
    for p, m, s, t, i, *_ in rows:
        if i is not None and s is not None and s == s:
            groups.setdefault((p, m), {})[i] = (-s, t is None, t or "", i)
    out = set()
    for (p, m), items in groups.items():
        for k, key in enumerate(sorted(items.values())[:n], 1):
            out.add((p, m, k, key[3]))
    return out


def check(spark, rows, n=5, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = [(r.p, r.m, r.item_rank, r.i) for r in top_items(df, ["p", "m"], "s", "t", "i", n).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, n)


def test_random_with_ties_copies_and_nulls(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        p = rng.choice(["hot"] * 5 + [f"p{k}" for k in range(60)] + [None])
        s = rng.choice([1.0, 2.0, 2.0, 50.5, None, float("nan"), 0.0, -0.0, -3.0])
        rows.append((p, rng.choice(["x", "x", None]), s, rng.choice(["t1", "t2", "T", None, ""]), i, "c", 1))
    rows += rows[:400] + [rows[7]] * 300 + [("hot", "x", 99.0, "t", None, None, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        check(spark, rows)
        check(spark, rows, n=1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_scores_equal(spark):
    check(spark, [("g", "x", 100.0, "t", i, None, None) for i in range(500)])


def test_empty_and_few(spark):
    assert top_items(spark.createDataFrame([], SCHEMA), ["p", "m"], "s", "t", "i").count() == 0
    check(spark, [("g", "x", 1.0, None, 1, None, None)])


def test_copies_that_differ_count_with_the_best(spark):
    rows = [("g", "x", float(s), "t", 1, None, None) for s in range(5)] + [("g", "x", 0.5, "t", i, None, None) for i in range(2, 9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((r.item_rank, r.i, r.s) for r in top_items(df, ["p", "m"], "s", "t", "i", 3).collect())
    assert got == [(1, 1, 4.0), (2, 2, 0.5), (3, 3, 0.5)]


def test_a_group_cut_by_many_boundaries(spark):
    rows = [("hot", "x", float(i % 97), f"t{i % 7}", i, None, None) for i in range(4000)] + [(f"p{i % 300}", "x", float(i % 5), "t", 10_000 + i, None, None) for i in range(2000)]
    check(spark, rows, n=50, parts=8)


def test_wide_keys_and_kept_columns(spark):
    big = 9_007_199_254_740_993
    df = spark.createDataFrame([(big, 1.0, "t", 1, "a"), (None, 2.0, None, 2, None), (big, 3.0, "t", 3, "c")], "g long, s double, t string, i long, tie string")
    got = sorted((str(r.g), r.item_rank, r.i, r.tie) for r in top_items(df, ["g"], "s", "t", "i", 2, keep=["tie"]).collect())
    assert got == [(str(big), 1, 3, "c"), (str(big), 2, 1, "a"), ("None", 1, 2, None)]

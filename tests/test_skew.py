import random
from collections import Counter

from pyspark.sql import functions as F

from tilewright.operators.skew import heavy_keys, range_split_aggregate, salted_join

SCHEMA = "k string, i long, v long, n string"


def test_heavy_key_is_split_and_counts_are_whole(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", i, rng.randrange(9), None) for i in range(4000)]
    df = spark.createDataFrame(rows + rows[:700], SCHEMA)
    out = range_split_aggregate(df, ["k"], ["i"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, unique=True, partitions=6)
    got = {r.k: (r.n, r.s) for r in out.collect()}
    count, total = Counter(r[0] for r in rows), Counter()
    for k, _, v, _ in rows:
        total[k] += v
    assert got == {k: (count[k], total[k]) for k in count}
    parts = df.repartitionByRange(6, "k", "i").select(F.spark_partition_id().alias("p"), "k").where("k = 'hot'").distinct().count()
    assert parts >= 2


def test_without_unique_copies_count(spark):
    df = spark.createDataFrame([("a", 1, 1, None)] * 5, SCHEMA)
    assert range_split_aggregate(df, ["k"], ["i"], {"n": F.count(F.lit(1))}).collect()[0].n == 5


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1, 1, "x"), ("a", None, 1, "x"), ("a", 2, None, None)], SCHEMA)
    assert [tuple(r) for r in range_split_aggregate(df, ["k"], ["i"], {"n": F.count(F.lit(1))}, unique=True).collect()] == [("a", 1)]
    assert range_split_aggregate(df.limit(0), ["k"], ["i"], {"n": F.count(F.lit(1))}).count() == 0


def test_clashing_column_names(spark):
    df = spark.createDataFrame([("a", 1, 5)], "k string, i long, n long")
    assert range_split_aggregate(df, ["k"], ["i"], {"n": F.sum("n")}).collect()[0].n == 5


def test_heavy_keys_at_the_bound(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 1), ("c", 97)], "k string, n long")
    assert sorted(r.k for r in heavy_keys(counts, "k", "n", 50).collect()) == ["a", "c"]
    assert heavy_keys(counts.limit(0), "k", "n", 50).count() == 0


def test_salted_join_keeps_every_row_and_null_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(None, 1), ("x", 2)], "k string, i long")
    right = spark.createDataFrame([("hot", 7), (None, 9)], "k string, b long")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = Counter((r.k, r.b) for r in salted_join(left, right, ["k"], counts, "n", per_slice=50).collect())
    assert got == {("hot", 7): 500, (None, 9): 1, ("x", None): 1}

"""Per-key results where a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.scratch import shuffle_width


def range_split_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, Column],
    unique: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Aggregate per key with every heavy key spread over as many partitions as its rows fill.

    Rows are range partitioned on (keys, order): Spark samples quantiles of that
    composite key, so the boundaries fall inside a heavy key and its rows run on over
    neighbouring partitions. Each partition reduces its rows to one state per key; only
    the keys cut by a boundary have more than one state, and the closing aggregation
    merges those. What is shuffled after the range exchange is (keys + partitions)
    states, however the rows are spread over the keys.

    unique: the (keys, order) tuple is an identity that may be delivered repeatedly; it
    counts once. Copies are folded on the map side before any row is shuffled, so a
    group of copies of any size stays one row per map task.

    Nulls: a row with a null in keys is dropped, and with unique also one with a null in
    order; otherwise nulls in order sort first. aggs see the columns of df. An empty
    table gives an empty result. Columns beside keys, order and those in aggs don't
    matter. With unique, aggs must depend on columns that the copies share; they are
    taken from an arbitrary copy.
    """
    n = partitions or shuffle_width(df.sparkSession, df)
    rows = df.dropna(subset=[*keys, *order] if unique else [*keys])
    if unique:
        rows = rows.dropDuplicates([*keys, *order])
    ranged = rows.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)])
    return ranged.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])


def heavy_keys(counts: DataFrame, key: str, n: str, one_in: int) -> DataFrame:
    """Keys of a (key, n) table that hold at least 1/one_in of the sum of n.

    The comparison is in whole numbers. The sum is a scalar subquery of one row.
    """
    total = counts.agg(F.sum(n).alias("total"))
    return counts.where(F.col(n) * F.lit(one_in) >= total.scalar()).select(key)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], counts: DataFrame, n: str, per_slice: int = 1_000_000) -> DataFrame:
    """Left join of left with right, which has at most one row per key, on null-safe keys.

    counts: (on, n), the rows of left per key. A key with more than per_slice rows in left
    is cut into n / per_slice slices, and its row of right is repeated once per slice; so no
    task gets more than about per_slice rows of one key. The list of such keys has at most
    rows / per_slice entries (1,000 for a billion rows), which bounds what is broadcast.
    """
    heavy = counts.where(F.col(n) > per_slice).select(*[F.col(c).alias(f"_h_{c}") for c in on], F.ceil(F.col(n) / per_slice).cast("int").alias("_slices"))
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])

    def match(prefix: str, side: DataFrame, key_prefix: str = ""):
        cond = None
        for c in on:
            one = side[f"{key_prefix}{c}"].eqNullSafe(F.col(f"{prefix}{c}"))
            cond = one if cond is None else cond & one
        return cond

    sliced = left.join(F.broadcast(heavy), match("_h_", left), "left").withColumn("_slice", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_slices")).cast("int"), F.lit(0)))
    spread = right.join(F.broadcast(heavy), match("_h_", right, "_r_"), "left").withColumn("_slice_r", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices") - 1, F.lit(0)))))
    sliced = sliced.drop("_slices", *[f"_h_{c}" for c in on])
    spread = spread.drop("_slices", *[f"_h_{c}" for c in on])
    joined = sliced.join(spread, match("_r_", sliced) & (F.col("_slice") == F.col("_slice_r")), "left")
    return joined.drop("_slice", "_slice_r", *[f"_r_{c}" for c in on])


def spread_join(left: DataFrame, right: DataFrame, on: str, per_cell: int = 10_000, most_listed: int = 1_000_000) -> DataFrame:
    """Inner join of two sides that both may have very many rows of a key.

    A key with more than per_cell rows on a side becomes a grid of cells: each row of that
    side lies in one slice and meets every slice of the other, so a cell has about per_cell
    rows of either side at most, and its product is bounded. Above per_cell x most_listed
    rows the limit rises with the rows, so that no more than most_listed keys of a side are
    heavy, which bounds the list that is broadcast. Rows with a null key are dropped.
    """
    total = lambda df: df.agg(F.count(F.lit(1))).scalar()
    limit = lambda df: F.greatest(F.lit(float(per_cell)), total(df) / most_listed)
    bucket = F.pmod(F.xxhash64(on), F.lit(1 << 18)).alias("_bucket")

    def cells(df: DataFrame, name: str) -> DataFrame:
        # a key can be heavy only if its bucket is; so mostly no key is counted
        full = df.where(F.col(on).isNotNull()).select(F.col(on).alias("_on"), bucket)
        coarse = full.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_limit", limit(df)).where("_n > _limit").select("_bucket", "_limit")  # 262,144 rows at most
        counts = full.join(F.broadcast(coarse), "_bucket").groupBy("_on").agg(F.count(F.lit(1)).alias("_n"), F.first("_limit").alias("_limit"))
        return counts.where("_n > _limit").select("_on", F.ceil(F.col("_n") / F.col("_limit")).cast("int").alias(f"{name}_cells"))

    heavy = cells(left, "_a").join(cells(right, "_b"), "_on", "full").select("_on", *[F.coalesce(f"{c}_cells", F.lit(1)).alias(f"{c}_cells") for c in ("_a", "_b")])

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        met = df.where(F.col(on).isNotNull()).join(F.broadcast(heavy), F.col(on) == F.col("_on"), "left")
        mine = F.pmod(F.monotonically_increasing_id(), F.coalesce(F.col(f"{own}_cells"), F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{other}_cells"), F.lit(1)) - 1))
        return met.withColumn(f"{own}_slice", mine).withColumn(f"{other}_slice", every).drop("_on", "_a_cells", "_b_cells")

    return placed(left, "_a", "_b").join(placed(right, "_b", "_a"), [on, "_a_slice", "_b_slice"]).drop("_a_slice", "_b_slice")

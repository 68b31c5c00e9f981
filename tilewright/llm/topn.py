"""The N best items of every group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.scratch import materialize, shuffle_width


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before it; a null equals a null."""
    c = column.combine_chunks()
    differ = np.ones(len(c), bool)
    null = c.is_null().to_numpy(zero_copy_only=False)
    unequal = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
    differ[1:] = unequal | (null[1:] != null[:-1])
    return differ


def _best_of_partition(batches: Iterator[pa.RecordBatch], n_names: int, n: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of a partition sorted by group and order, the rows no worse than each group's n-th best item, each item once, with their rank.

    Only the last group of a batch can go on in the next; its best rows so far lead the next batch.
    """
    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        led = 0
        if carry is not None:
            led, rows = carry.num_rows, pa.concat_tables([carry, rows])
        size = rows.num_rows
        fresh = np.zeros(size, bool)
        fresh[0] = True
        for k in range(n_names):
            fresh |= _changes(rows.column(k))
        group = np.cumsum(fresh)
        item = pc.dictionary_encode(rows["item"].combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, at = np.unique(group * size + item, return_index=True)  # of copies the best comes first
        once = np.zeros(size, bool)
        once[at] = True
        count = np.cumsum(once)
        begin = np.flatnonzero(fresh)
        rank = count - (count[begin] - once[begin])[group - 1]
        good = once & (rank <= n)
        out = np.flatnonzero(good & (np.arange(size) >= led))
        if len(out):
            yield rows.take(pa.array(out)), rank[out]
        carry = rows.take(pa.array(np.flatnonzero(good & (group == group[-1])))).combine_chunks()


def top_items(df: DataFrame, group: Sequence[str], score: str, tie: str, item: str, n: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """(*group, item_rank, item, score, tie, *keep): the n best items of each group.

    Order: score descending, tie ascending (nulls last), item ascending; item identifies a
    row, and one delivered repeatedly counts once, with its best copy. Rows with a null item,
    or a score that is null or NaN, don't count. A null in a group column is a group value
    like others. Clashing or extra columns don't matter; an empty table gives an empty result.

    Lower bounds: the n-th best item of a group within any partition is no better than the
    group's n-th best overall. So each input partition, sorted by group and order, lets only
    rows through that are no worse than its own n-th best: n rows of a group at most, each
    item once, before anything is shuffled. What is left is range partitioned on (group, a
    hash of the item) with sampled quantiles, and each partition again takes its n-th best of
    each group as a bound. A group that lies in one partition is done. A group cut by a
    boundary has a bound in each of its partitions; the best of these is joined to its rows,
    those that are no worse pass, and the survivors are ranked. Only a partition's first and
    last group can be cut, so the bounds joined are two a partition at most. The bound is the
    whole order (score, tie, item): equal scores let no row through.
    """
    names = [f"g{k}" for k in range(len(group))]
    wanted = [F.col(c).alias(a) for c, a in zip(group, names)]
    value = F.col(score).cast("double")
    rows = df.select(*wanted, F.when(value == 0, F.lit(0.0)).otherwise(value).alias("score"), F.col(tie).alias("tie"), F.col(item).alias("item"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    rows = rows.where(F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    best_first = [F.desc("score"), F.asc_nulls_last("tie"), F.asc("item")]
    kinds = rows.schema
    shape = T.StructType([*kinds.fields, T.StructField("rank", T.LongType()), T.StructField("pid", T.IntegerType())])
    n_names = len(names)

    def pass_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _ in _best_of_partition(batches, n_names, n):
            yield from found.to_batches()

    def pass_ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        for found, rank in _best_of_partition(batches, n_names, n):
            found = found.append_column("rank", pa.array(rank.astype(np.int64))).append_column("pid", pa.array(np.full(len(rank), pid, np.int32)))
            yield from found.to_batches()

    local = materialize(rows.sortWithinPartitions(*names, *best_first).mapInArrow(pass_best, kinds), "best")
    spread = F.xxhash64("item")
    ranged = local.withColumn("_h", spread).repartitionByRange(shuffle_width(df.sparkSession), *names, "_h").drop("_h")
    ranked = materialize(ranged.sortWithinPartitions(*names, *best_first).mapInArrow(pass_ranked, shape), "ranked")

    order = F.struct((-F.col("score")).alias("s"), F.col("tie").isNull().alias("z"), F.col("tie").alias("t"), F.col("item").alias("i"))  # smaller is better
    whole = F.struct(*names)
    ends = ranked.groupBy("pid").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    ends = ends.select("pid", F.explode(F.array_distinct(F.array("first", "last"))).alias("g"))
    cut = ends.groupBy("g").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(*[F.col(f"g.{c}").alias(f"c_{c}") for c in names])
    cut = F.broadcast(cut)  # one a partition at most

    def same(other: str) -> Column:
        cond = F.lit(True)
        for c in names:
            cond &= F.col(c).eqNullSafe(F.col(f"{other}{c}"))
        return cond

    shared = ranked.join(cut, same("c_"), "left_semi")
    bound = shared.where(F.col("rank") == n).groupBy(*[F.col(c).alias(f"b_{c}") for c in names]).agg(F.min(order).alias("bound"))
    alive = shared.join(F.broadcast(bound), same("b_"), "left").where(F.col("bound").isNull() | (order <= F.col("bound")))
    by_rank = Window.partitionBy(*names).orderBy(*best_first)
    stitched = alive.withColumn("rank", F.row_number().over(by_rank).cast("long")).where(F.col("rank") <= n)
    done = ranked.join(cut, same("c_"), "left_anti")
    result = done.drop("pid").unionByName(stitched.select(*done.drop("pid").columns))
    return result.select(*[F.col(a).alias(c) for c, a in zip(group, names)], F.col("rank").alias("item_rank"), F.col("item").alias(item), F.col("score").alias(score), F.col("tie").alias(tie), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])

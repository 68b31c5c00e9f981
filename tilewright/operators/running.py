"""Running totals along an order within a key, with heavy keys cut over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.scratch import materialize, shuffle_width

_NAMES = ["pid", "key", "at", "total", "prev_at", "prev_total"]


def _local_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid = TaskContext.get().partitionId()
    key_before, at_before, total_before = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, at, value = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        fresh = np.zeros(n, bool)
        goes_on = key_before is not None and key[0].as_py() == key_before
        fresh[0] = not goes_on
        if n > 1:
            fresh[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        total = np.cumsum(value)
        starts = np.flatnonzero(fresh)
        base = np.zeros(n, np.int64)
        base[starts] = total[starts] - value[starts]
        seen = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        total = total - np.where(seen >= 0, base[np.maximum(seen, 0)], -total_before if goes_on else 0)
        prev_at, prev_total = np.append(at_before, at[:-1]), np.append(total_before, total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, pid, np.int32)), key, pa.array(at), pa.array(total), pa.array(prev_at, mask=fresh), pa.array(prev_total, mask=fresh)], names=_NAMES)
        key_before, at_before, total_before = key[n - 1].as_py(), int(at[-1]), int(total[-1])


def running_totals(df: DataFrame, key: str, at: str, value: str, partitions: int | None = None) -> DataFrame:
    """(key, at, total, prev_at, prev_total): the sum of value up to each row, and the row before it.

    df has one row per (key, at). It is range sorted by both over all keys, so a key with
    very many rows fills several partitions; each partition sums up its own rows, and what
    reaches in from the partitions before is added from one summary row per partition.
    prev_at and prev_total are null on a key's first row. Rows with a null are dropped.
    """
    n = partitions or shuffle_width(df.sparkSession, df)
    rows = df.select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"), F.col(value).cast("long").alias("value")).dropna()
    shape = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("key", df.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in _NAMES[2:])])
    local = materialize(rows.repartitionByRange(n, "key", "at").sortWithinPartitions("key", "at").mapInArrow(_local_totals, shape), "totals")
    last = F.max(F.struct("key", "at", "total"))
    summary = local.groupBy("pid").agg(F.min(F.struct("key", "at")).alias("f"), last.alias("l"))
    summary = summary.select("pid", F.col("f.key").alias("first"), F.col("f.at").alias("first_at"), F.col("l.key").alias("last"), F.col("l.at").alias("last_at"), F.col("l.total").alias("last_total"))
    in_order = Window.orderBy("pid")  # as many rows as partitions
    so_far = Window.partitionBy("last").orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = summary.withColumn("upto", F.sum("last_total").over(so_far))
    reaches = F.lag("last").over(in_order) == F.col("first")
    carried = summary.select("pid", "first", "first_at", F.when(reaches, F.lag("upto").over(in_order)).alias("carry"), F.when(reaches, F.lag("last_at").over(in_order)).alias("carry_at"))
    seen = local.join(F.broadcast(carried), "pid")
    edge = (F.col("key") == F.col("first")) & F.col("carry").isNotNull()
    cut = edge & (F.col("at") == F.col("first_at"))
    return seen.select(
        F.col("key").alias(key),
        F.col("at").alias(at),
        F.when(edge, F.col("total") + F.col("carry")).otherwise(F.col("total")).alias("total"),
        F.when(cut, F.col("carry_at")).otherwise(F.col("prev_at")).alias("prev_at"),
        F.when(cut, F.col("carry")).otherwise(F.when(edge, F.col("prev_total") + F.col("carry")).otherwise(F.col("prev_total"))).alias("prev_total"),
    )


def global_rank(df: DataFrame, by: list[str], name: str = "ranked") -> DataFrame:
    """df, written once in the global order of by, with its place in that order as rank, from 0.

    Rows are range partitioned and sorted; the partitions' row counts, as many rows as
    partitions, are summed up in order. Rows that are equal in by come in any order.
    """
    n = shuffle_width(df.sparkSession, df)
    rows = materialize(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id()), name)
    pid = F.shiftright("_mid", 33)  # the partition, which the ids carry above their 33 low bits
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = rows.withColumn("_pid", pid).join(F.broadcast(parts), "_pid")
    return placed.withColumn("rank", F.col("_offset") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_pid", "_mid", "_offset")

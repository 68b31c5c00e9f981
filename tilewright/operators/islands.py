"""Merging intervals per entity into periods, and the gaps between them."""

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


def _segment_max(values: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Running maximum of values that starts anew in each segment (segments are numbered upwards)."""
    distinct, rank = np.unique(values, return_inverse=True)
    base = segment * len(distinct)
    return distinct[np.maximum.accumulate(base + rank) - base]


def _local_islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Islands of one range partition, whose rows come sorted by entity and start.

    The last island of a batch stays open and leads the next batch as a row of its own.
    """
    pid = TaskContext.get().partitionId()
    open_row: pa.Table | None = None
    names = ["pid", "entity", "s", "e", "prev_e"]

    def out(entity, s, e, prev):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(s), pid, np.int32)), entity, s, e, prev], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.table({"entity": batch.column(0), "s": batch.column(1), "e": batch.column(2), "prev": pa.nulls(batch.num_rows, pa.int64())})
        rows = (rows if open_row is None else pa.concat_tables([open_row, rows])).combine_chunks()
        entity, s, e = rows["entity"].chunk(0), rows["s"].to_numpy(), rows["e"].to_numpy()
        n = len(s)
        changed = np.zeros(n, bool)
        if n > 1:
            changed[1:] = pc.not_equal(entity[1:], entity[:-1]).to_numpy(zero_copy_only=False)
        high = _segment_max(e, np.cumsum(changed))
        starts = np.ones(n, bool)
        starts[1:] = changed[1:] | (s[1:] > high[:-1])
        first = np.flatnonzero(starts)
        ends = high[np.append(first[1:], n) - 1]
        fresh = changed[first]
        fresh[0] = True
        prev = np.append(0, ends[:-1])
        prev_e = pa.array(prev, mask=fresh)
        if open_row is not None:
            prev_e = pa.concat_arrays([open_row["prev"].chunk(0), prev_e[1:]])
        ent, starts_s, ends_e = entity.take(pa.array(first)), pa.array(s[first]), pa.array(ends)
        last = len(first) - 1
        if last:
            yield out(ent[:last], starts_s[:last], ends_e[:last], prev_e[:last])
        open_row = pa.table({"entity": ent[last:], "s": starts_s[last:], "e": ends_e[last:], "prev": prev_e[last:]}).combine_chunks()
    if open_row is not None:
        yield out(*[open_row[c].combine_chunks() for c in ("entity", "s", "e", "prev")])


def islands_and_gaps(df: DataFrame, entity: str, start: str, end: str, partitions: int | None = None) -> DataFrame:
    """Periods and gaps per entity: (entity, seg_kind, seg_start, seg_end), half-open.

    Intervals that overlap, nest or touch form one period; a gap is the stretch between
    two neighbouring periods. Rows with a null in any of the three columns and rows with
    start >= end don't count; repeated rows change nothing; an empty table gives an
    empty result; other columns don't matter.

    The intervals are range sorted over all entities by (entity, start, end), so one
    entity with a large share of the rows fills many partitions. Each partition merges
    its own rows into local islands (written once; everything after works on these).
    One summary row per partition (first entity, last entity, its latest start and end)
    is prefix-combined in partition order, which gives the furthest end and the open
    island that reach into each partition; a second look at the islands with this
    carried state finds those that continue an earlier island and labels them with its
    start. The summaries number as many as the partitions, whatever the data.
    """
    spark = df.sparkSession
    n = partitions or shuffle_width(spark, df)
    kind = df.schema[entity].dataType
    spans = df.select(F.col(entity).alias("entity"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).dropna().where("s < e")
    # copies, and spans from one start, are folded before the range exchange: a start is one row then, so any entity can be cut
    longest = spans.groupBy("entity", "s").agg(F.max("e").alias("e"))
    ranged = longest.repartitionByRange(n, "entity", "s").sortWithinPartitions("entity", "s")
    shape = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("entity", kind), *(T.StructField(c, T.LongType()) for c in ("s", "e", "prev_e"))])
    local = materialize(ranged.mapInArrow(_local_islands, shape), "islands")

    last = F.max(F.struct("entity", "s", "e"))
    summary = local.groupBy("pid").agg(F.min("entity").alias("first"), last.alias("last")).select("pid", "first", F.col("last.entity").alias("last"), F.col("last.s").alias("last_s"), F.col("last.e").alias("last_e"))
    in_order = Window.orderBy("pid")  # as many rows as partitions
    so_far = Window.partitionBy("last").orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.when(F.lag("last").over(in_order) == F.col("first"), F.lag("far").over(in_order))
    carried = summary.withColumn("far", F.max("last_e").over(so_far)).withColumn("carry_e", reach)
    own_start = F.when(~F.coalesce((F.col("last") == F.col("first")) & (F.col("last_s") <= F.col("carry_e")), F.lit(False)), F.col("last_s"))
    label = F.when(F.lag("last").over(in_order) == F.col("first"), F.lag("open_s").over(in_order))
    carried = carried.withColumn("open_s", F.max(own_start).over(so_far)).withColumn("carry_s", label).select("pid", "first", "carry_e", "carry_s")

    seen = local.join(F.broadcast(carried), "pid")
    at_edge = F.col("entity") == F.col("first")
    goes_on = F.coalesce(at_edge & (F.col("s") <= F.col("carry_e")), F.lit(False))
    seen = seen.select("entity", "e", "s", goes_on.alias("goes_on"), F.when(goes_on, F.col("carry_s")).otherwise(F.col("s")).alias("label"), F.greatest("prev_e", F.when(at_edge, F.col("carry_e"))).alias("before"))
    periods = seen.groupBy("entity", "label").agg(F.max("e").alias("seg_end")).select(F.col("entity").alias(entity), F.lit("period").alias("seg_kind"), F.col("label").alias("seg_start"), "seg_end")
    gaps = seen.where(~F.col("goes_on") & F.col("before").isNotNull()).select(F.col("entity").alias(entity), F.lit("gap").alias("seg_kind"), F.col("before").alias("seg_start"), F.col("s").alias("seg_end"))
    return periods.unionByName(gaps)

"""An extension beyond the batch work: read counts kept up to date as alignment files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.alignment import SECONDARY, SUPPLEMENTARY


def windowed_read_counts(alns: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, reference_id, reads) over a stream of alignments by aligned_at.

    A redelivered aln_id counts once within the watermark; rows later than it are left out.
    Works on a batch table too, where the watermark has no effect.
    """
    flag = F.coalesce("flag", F.lit(0)).bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY))
    rows = alns.where((F.col("rname") != "*") & (flag == 0)).withWatermark("aligned_at", late).dropDuplicates(["aln_id", "aligned_at"])
    counted = rows.groupBy(F.window("aligned_at", window).alias("w"), F.col("rname").alias("reference_id")).agg(F.count(F.lit(1)).alias("reads"))
    return counted.select(F.col("w.start").alias("window_start"), "reference_id", "reads")

"""Depth along references as run-length intervals, and what is computed from them.

Intervals are 0-based and half-open. References come as (reference_id, ref_length).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.alignment import SECONDARY, SUPPLEMENTARY, aligned_blocks
from tilewright.operators.islands import islands_and_gaps
from tilewright.operators.running import running_totals
from tilewright.operators.skew import salted_join


_MARK = 1 << 40
#: Thresholds of a depth curve that are made by one row.
STRETCH = 10_000


def mapped(alns: DataFrame, secondary: bool = False, supplementary: bool = False) -> DataFrame:
    """Alignments on a reference, once per aln_id where there is one; primary ones unless asked for others."""
    dropped = (0 if secondary else SECONDARY) | (0 if supplementary else SUPPLEMENTARY)
    rows = alns.where((F.col("rname") != "*") & (F.coalesce("flag", F.lit(0)).bitwiseAND(F.lit(dropped)) == 0))
    return rows.where(F.col("aln_id").isNotNull()).dropDuplicates(["aln_id"]) if "aln_id" in rows.columns else rows


def alignment_blocks(alns: DataFrame) -> DataFrame:
    """(reference_id, s, e): aligned stretches of each alignment with a CIGAR; a position before the first counts as the first."""
    start = F.greatest(F.col("pos") - 1, F.lit(0))
    blocks = alns.where(F.col("cigar").isNotNull() & (F.col("cigar") != "*") & F.col("pos").isNotNull())
    return blocks.select(F.col("rname").alias("reference_id"), F.explode(aligned_blocks(start, "cigar")).alias("b")).select("reference_id", "b.s", "b.e")


def depth_segments(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """(reference_id, seg_start, seg_end, depth): maximal runs of one depth along each whole reference.

    blocks: (reference_id, s, e), clipped to the reference; references without a length are
    left out, and ones without blocks are one run of depth 0. Each block adds one at its
    start and takes one away at its end; these changes are summed per place before they are
    shuffled, and their running total is the depth. Work follows the number of blocks, not
    of bases, there is no join, and a reference with most of the blocks is spread over
    partitions.
    """
    known = refs.select("reference_id", F.col("ref_length").cast("long").alias("len")).where("len > 0").dropDuplicates(["reference_id"])
    # a reference's start and end add to the total above any depth, which tells where along it the depth counts
    mark = lambda at, n: F.struct(at.alias("at"), F.lit(n * _MARK).alias("change"))
    ends = known.select("reference_id", F.explode(F.array(mark(F.lit(0).cast("long"), 1), mark(F.col("len"), 2))).alias("x"))
    step = lambda c, n: F.struct(F.col(c).cast("long").alias("at"), F.lit(n).cast("long").alias("change"))
    changes = blocks.select("reference_id", F.explode(F.array(step("s", 1), step("e", -1))).alias("x"))
    events = changes.unionByName(ends).select("reference_id", "x.at", "x.change").groupBy("reference_id", "at").agg(F.sum("change").alias("change")).where("change <> 0")
    totals = running_totals(events, "reference_id", "at", "change")
    inside = F.col("prev_at").isNotNull() & (F.col("prev_total") >= _MARK) & (F.col("prev_total") < 2 * _MARK)
    return totals.where(inside).select("reference_id", F.col("prev_at").alias("seg_start"), F.col("at").alias("seg_end"), (F.col("prev_total") - _MARK).alias("depth"))


def _pct(cond, length):
    return F.sum(F.when(cond, F.col("n")).otherwise(0)) / length * 100


def coverage_stats(segments: DataFrame) -> DataFrame:
    """(reference_id, ref_length, avg_coverage, pct_covered_5x, pct_covered_20x)."""
    s = segments.withColumn("n", F.col("seg_end") - F.col("seg_start"))
    length = F.sum("n")
    return s.groupBy("reference_id").agg(length.alias("ref_length"), (F.sum(F.col("depth") * F.col("n")) / length).alias("avg_coverage"), _pct(F.col("depth") >= 5, length).alias("pct_covered_5x"), _pct(F.col("depth") >= 20, length).alias("pct_covered_20x"))


def depth_histogram(segments: DataFrame) -> DataFrame:
    """(reference_id, depth, bases)."""
    return segments.groupBy("reference_id", "depth").agg(F.sum(F.col("seg_end") - F.col("seg_start")).alias("bases"))


def lengths(segments: DataFrame) -> DataFrame:
    """(reference_id, len, n): length and number of segments of each reference."""
    return segments.groupBy("reference_id").agg(F.max("seg_end").alias("len"), F.count(F.lit(1)).alias("n"))


def with_length(rows: DataFrame, segments: DataFrame, per_slice: int = 1_000_000) -> DataFrame:
    """rows (reference_id, ..), no more of a reference than it has segments, with its length as len; references with very many are cut into slices."""
    known = lengths(segments)
    return salted_join(rows, known.select("reference_id", "len"), ["reference_id"], known, "n", per_slice)


def near_covered(segments: DataFrame, proximity: int) -> DataFrame:
    """(reference_id, near_bases): bases within proximity of a covered one.

    Only a reference's last stretch can reach over its end, so what is over is taken off
    the sum; lengths meet references after these are one row each.
    """
    wide = segments.where("depth > 0").select("reference_id", F.greatest(F.col("seg_start") - proximity, F.lit(0).cast("long")).alias("s"), (F.col("seg_end") + proximity).alias("e"))
    merged = islands_and_gaps(wide, "reference_id", "s", "e").where("seg_kind = 'period'")
    near = merged.groupBy("reference_id").agg(F.sum(F.col("seg_end") - F.col("seg_start")).alias("bases"), F.max("seg_end").alias("last"))
    over = F.greatest(F.col("last") - F.col("len"), F.lit(0).cast("long"))
    return near.join(lengths(segments), "reference_id").select("reference_id", (F.col("bases") - over).alias("near_bases"))


def probe_coverage_stats(segments: DataFrame, proximity: int = 100) -> DataFrame:
    """Breadth, depth, median, gaps and proximity per reference. The median is that of the depths of all positions."""
    hist = depth_histogram(segments)
    by_depth = Window.partitionBy("reference_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("reference_id")  # one row per depth that occurs
    ranked = hist.select("reference_id", "depth", F.sum("bases").over(by_depth).alias("upto"), F.sum("bases").over(whole).alias("len"))
    low = F.min(F.when(F.col("upto") > F.floor((F.col("len") - 1) / 2), F.col("depth")))
    high = F.min(F.when(F.col("upto") > F.floor(F.col("len") / 2), F.col("depth")))
    median = ranked.groupBy("reference_id").agg(((low + high) / 2).alias("median_depth"))
    s = segments.withColumn("n", F.col("seg_end") - F.col("seg_start"))
    length, gap = F.sum("n"), F.when(F.col("depth") == 0, F.col("n"))
    stats = s.groupBy("reference_id").agg(
        length.alias("ref_length"),
        F.sum(F.when(F.col("depth") >= 1, F.col("n")).otherwise(0)).alias("covered_bases"),
        _pct(F.col("depth") >= 1, length).alias("pct_covered_1x"),
        (F.sum(F.col("depth") * F.col("n")) / length).alias("mean_depth"),
        *[_pct(F.col("depth") >= t, length).alias(f"pct_covered_{t}x") for t in (2, 5, 10)],
        F.coalesce(F.max(gap), F.lit(0)).cast("long").alias("max_gap_length"),
        F.count(gap).alias("num_gaps"),
    )
    near = near_covered(segments, proximity)
    joined = stats.join(median, "reference_id").join(near, "reference_id", "left")
    return joined.withColumn("pct_near_probe", F.coalesce("near_bases", F.lit(0)) / F.col("ref_length") * 100).drop("near_bases")


def gap_regions(segments: DataFrame, min_length: int = 1) -> DataFrame:
    """(reference_id, gap_start, gap_end, gap_length, is_terminal): maximal runs without depth."""
    gaps = with_length(segments.where((F.col("depth") == 0) & (F.col("seg_end") - F.col("seg_start") >= min_length)), segments)
    return gaps.select("reference_id", F.col("seg_start").alias("gap_start"), F.col("seg_end").alias("gap_end"), (F.col("seg_end") - F.col("seg_start")).alias("gap_length"), ((F.col("seg_start") == 0) | (F.col("seg_end") == F.col("len"))).alias("is_terminal"))


def depth_curves(segments: DataFrame, most: int | None = None) -> DataFrame:
    """(reference_id, depth_threshold, pct_covered): percent of positions at least so deep, for 1 up to the deepest; (1, 0) without depth."""
    hist = depth_histogram(segments)
    down = Window.partitionBy("reference_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy("reference_id").orderBy("depth")  # one row per depth that occurs
    whole = Window.partitionBy("reference_id")
    steps = hist.select("reference_id", "depth", F.sum("bases").over(down).alias("n"), F.sum("bases").over(whole).alias("len"), F.coalesce(F.lag("depth").over(up), F.lit(0)).alias("below"), F.max("depth").over(whole).alias("deepest"))
    flat = steps.where("deepest = 0").select("reference_id", F.lit(1).cast("long").alias("depth_threshold"), F.lit(0.0).alias("pct_covered"))
    # a deep step is filled in stretches, so that no row holds more than one of them
    upto = F.least(F.col("depth"), F.lit(most).cast("long")) if most else F.col("depth")
    stretch = steps.where("depth > 0").withColumn("upto", upto).where(F.col("below") < F.col("upto")).select("reference_id", "upto", (F.col("n") / F.col("len") * 100).alias("pct_covered"), F.explode(F.sequence(F.col("below") + 1, F.col("upto"), F.lit(STRETCH).cast("long"))).alias("low"))
    filled = stretch.select("reference_id", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + STRETCH - 1, F.col("upto")))).alias("depth_threshold"), "pct_covered")
    return filled.unionByName(flat)


def threshold_coverage(segments: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """(reference_id, pct_<t>x, ..): percent of positions at least so deep, at each threshold."""
    s = segments.withColumn("n", F.col("seg_end") - F.col("seg_start"))
    return s.groupBy("reference_id").agg(*[_pct(F.col("depth") >= t, F.sum("n")).alias(f"pct_{t}x") for t in thresholds])


def low_coverage_regions(segments: DataFrame, min_depth: int, probe_length: int) -> DataFrame:
    """(reference_id, region_start, region_end): runs below min_depth, short ones widened about their centre to a probe's length, and merged where they overlap."""
    low = islands_and_gaps(segments.where(F.col("depth") < min_depth), "reference_id", "seg_start", "seg_end").where("seg_kind = 'period'")
    runs = with_length(low.select("reference_id", F.col("seg_start").alias("s"), F.col("seg_end").alias("e")), segments)
    start = F.greatest(F.floor((F.col("s") + F.col("e")) / 2) - F.floor(F.lit(probe_length) / 2), F.lit(0).cast("long"))
    end = F.least(start + probe_length, F.col("len"))
    short = (F.col("e") - F.col("s")) < probe_length
    start = F.when((end == F.col("len")) & (F.col("len") >= probe_length), F.col("len") - probe_length).otherwise(start)
    wide = runs.select("reference_id", F.when(short, start).otherwise(F.col("s")).alias("s"), F.when(short, end).otherwise(F.col("e")).alias("e"))
    # only a real overlap merges: the last base instead of the end
    merged = islands_and_gaps(wide.withColumn("e", F.col("e") - 1), "reference_id", "s", "e").where("seg_kind = 'period'")
    return merged.select("reference_id", F.col("seg_start").alias("region_start"), (F.col("seg_end") + 1).alias("region_end"))


def binned_depth(segments: DataFrame, points: int = 200) -> DataFrame:
    """(reference_id, bin, bin_start, bin_end, mean_depth): depth averaged over at most points equal bins of each reference."""
    width = F.greatest(F.ceil(F.col("len") / points), F.lit(1)).cast("long")
    s = with_length(segments, segments).withColumn("w", width)
    bins = s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("seg_start") / F.col("w")), F.floor((F.col("seg_end") - 1) / F.col("w")))))
    overlap = F.least("seg_end", (F.col("bin") + 1) * F.col("w")) - F.greatest("seg_start", F.col("bin") * F.col("w"))
    return bins.groupBy("reference_id", "bin").agg(F.min(F.col("bin") * F.col("w")).alias("bin_start"), F.max(F.least((F.col("bin") + 1) * F.col("w"), F.col("len"))).alias("bin_end"), (F.sum(F.col("depth") * overlap) / F.sum(overlap)).alias("mean_depth"))


def overlap_join(left: DataFrame, right: DataFrame, bin_size: int = 1_000) -> DataFrame:
    """Pairs of intervals of one reference that overlap: (reference_id, s, e, *left, r_s, r_e).

    Both sides are (reference_id, s, e, ..). Each interval goes to the bins that it touches,
    bins meet by equality, and a pair counts in the first bin that both share: no pair twice,
    and no join on inequality alone.
    """
    spread = lambda df: df.where("s < e").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("s") / bin_size), F.floor((F.col("e") - 1) / bin_size))))
    r = spread(right.select(F.col("reference_id"), F.col("s"), F.col("e"))).select("reference_id", "_bin", F.col("s").alias("r_s"), F.col("e").alias("r_e"))
    joined = spread(left).join(r, ["reference_id", "_bin"])
    first = F.floor(F.greatest("s", "r_s") / bin_size)
    return joined.where((F.col("s") < F.col("r_e")) & (F.col("r_s") < F.col("e")) & (F.col("_bin") == first)).drop("_bin")


def covered_periods(segments: DataFrame) -> DataFrame:
    """(reference_id, s, e): maximal stretches with depth."""
    merged = islands_and_gaps(segments.where("depth > 0"), "reference_id", "seg_start", "seg_end").where("seg_kind = 'period'")
    return merged.select("reference_id", F.col("seg_start").alias("s"), F.col("seg_end").alias("e"))


def covered_fraction(intervals: DataFrame, segments: DataFrame) -> DataFrame:
    """intervals (reference_id, s, e) with the fraction of each that segments cover."""
    covered = covered_periods(segments)
    met = overlap_join(intervals.select("reference_id", "s", "e").distinct(), covered)
    part = met.groupBy("reference_id", "s", "e").agg(F.sum(F.least("e", "r_e") - F.greatest("s", "r_s")).alias("bases"))
    return intervals.join(part, ["reference_id", "s", "e"], "left").withColumn("covered_fraction", F.coalesce("bases", F.lit(0)) / (F.col("e") - F.col("s"))).drop("bases")

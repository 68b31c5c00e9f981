"""Choosing probes: greedy cover, baits for bare stretches, near-duplicate probes."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.sequence import gc_content
from tilewright.operators.depth import covered_fraction, depth_segments, gap_regions, overlap_join
from tilewright.operators.running import global_rank, running_totals
from tilewright.operators.skew import salted_join
from tilewright.operators.tiling import CHUNK, chunked
from tilewright.scratch import drop_table, shuffle_width, write_table

#: Rounds of the greedy cover whose picks lie in tables of their own.
FOLD = 50


def extended_hits(hits: DataFrame, refs: DataFrame, extension: int, per_slice: int = 1_000_000) -> DataFrame:
    """hits with (s, e) widened on both sides and kept inside the reference; references with very many hits are cut into slices."""
    counts = hits.groupBy("reference_id").agg(F.count(F.lit(1)).alias("n"))
    met = salted_join(hits, refs.select("reference_id", F.col("ref_length").alias("_len")).dropDuplicates(["reference_id"]), ["reference_id"], counts, "n", per_slice)
    wide = met.where(F.col("_len").isNotNull()).withColumn("s", F.greatest(F.col("s") - extension, F.lit(0))).withColumn("e", F.least(F.col("e") + extension, F.col("_len")))
    return wide.drop("_len")


def greedy_cover(hits: DataFrame, refs: DataFrame, fraction: float = 1.0) -> DataFrame:
    """(probe_id, round, gain): the probes that a greedy cover picks until nothing more can be covered.

    hits (probe_id, reference_id, s, e); refs (reference_id, ref_length). The classic loop
    takes the probe with the most uncovered bases, then the smallest id, one at a time. A
    probe that beats every other with which it shares an uncovered base will be taken before
    those, with the gain that it has now; so all such probes are taken at once, which gives
    the same probes as the loop in far fewer rounds.

    References are cut where a hit begins or ends. Each probe is joined to its pieces once;
    a round keeps the best probe of each uncovered piece, and takes the probes that are best
    on all of theirs. Pieces meet probes, never probes each other. Each round with pieces
    left takes a probe, so the rounds end by themselves; what they took is gathered into one
    table every FOLD rounds, so plans stay small however many there are.

    fraction: the loop stops once this share of every reference is covered (of those that
    can be; if one can't, nothing more is left out). As gains never rise, the loop's order is
    that of (gain, id), so the last pick that any reference needs is found by running totals.
    """
    spark = hits.sparkSession
    hits = hits.select("probe_id", "reference_id", "s", "e").where("s < e").distinct()
    edges = hits.select("reference_id", F.explode(F.array("s", "e")).alias("at")).distinct()
    cuts = edges.join(refs.select("reference_id", F.col("ref_length").alias("len")), "reference_id").where("at >= 0 and at <= len").withColumn("one", F.lit(1))
    pieces = running_totals(cuts, "reference_id", "at", "one").where("prev_at IS NOT NULL").select("reference_id", F.col("prev_at").alias("s"), F.col("at").alias("e"))
    held = overlap_join(hits.select("reference_id", "s", "e", "probe_id"), pieces).select("probe_id", "reference_id", F.col("r_s").alias("piece"), (F.col("r_e") - F.col("r_s")).alias("bases")).distinct()
    state, state_at = write_table(held, "cover")
    picked: list[tuple[DataFrame, str]] = []
    shares: list[tuple[DataFrame, str]] = []
    for k in itertools.count():
        gain = state.groupBy("probe_id").agg(F.sum("bases").alias("gain"), F.count(F.lit(1)).alias("pieces"))
        rated = state.join(gain, "probe_id")
        best = rated.groupBy("reference_id", "piece").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("probe_id").alias("p"))).alias("b")).select(F.col("b.p").alias("probe_id"))
        wins = best.groupBy("probe_id").agg(F.count(F.lit(1)).alias("won")).join(gain, "probe_id").where("won = pieces")
        taken, taken_at = write_table(wins.select("probe_id", F.lit(k).alias("round"), "gain"), "picked")
        if taken.isEmpty():
            break
        picked.append((taken, taken_at))
        if fraction < 1:
            new = state.join(taken.select("probe_id"), "probe_id", "left_semi").groupBy("probe_id", "reference_id").agg(F.sum("bases").alias("bases"))
            shares.append(write_table(new, "shares"))
        gone = state.join(taken.select("probe_id"), "probe_id", "left_semi").select("reference_id", "piece").distinct()
        following, following_at = write_table(state.join(gone, ["reference_id", "piece"], "left_anti"), "cover")
        drop_table(spark, state_at)
        state, state_at = following, following_at
        if len(picked) > FOLD:
            picked = _folded(picked)
        if len(shares) > FOLD:
            shares = _folded(shares)
    if not picked:
        return hits.limit(0).select("probe_id", F.lit(0).alias("round"), F.lit(0).cast("long").alias("gain"))
    return _enough(_union(picked), _union(shares), refs, fraction) if fraction < 1 else _union(picked)


def _enough(picked: DataFrame, shares: DataFrame, refs: DataFrame, fraction: float) -> DataFrame:
    """The picks up to the last one that any reference needs; all of them if a reference never has enough."""
    ranked = global_rank(picked.withColumn("_g", -F.col("gain")), ["_g", "probe_id"], "order").select("probe_id", "round", "gain", "rank")
    known = refs.where("ref_length > 0").select("reference_id", F.col("ref_length").alias("len")).dropDuplicates(["reference_id"])
    upto = running_totals(shares.join(ranked.select("probe_id", "rank"), "probe_id"), "reference_id", "rank", "bases")
    first = upto.join(known, "reference_id").where(F.col("total") >= F.col("len") * fraction).groupBy("reference_id").agg(F.min("rank").alias("at"))
    last = known.join(first, "reference_id", "left").agg(F.when(F.count(F.when(F.col("at").isNull(), 1)) == 0, F.max("at")).alias("at"))
    return ranked.where(F.col("rank") <= F.coalesce(last.scalar(), F.lit((1 << 63) - 1))).select("probe_id", "round", "gain")


def _folded(tables: list[tuple[DataFrame, str]]) -> list[tuple[DataFrame, str]]:
    spark = tables[0][0].sparkSession
    whole = write_table(_union(tables).coalesce(shuffle_width(spark)), "folded")
    for _, path in tables:
        drop_table(spark, path)
    return [whole]


def _union(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df for df, _ in tables))


def gap_baits(hits: DataFrame, refs: DataFrame, length: int) -> DataFrame:
    """(reference_id, bait, start, end): baits of the given length laid from the left over each stretch that no hit covers, kept inside the reference."""
    runs = depth_segments(hits.select("reference_id", "s", "e"), refs).where("depth = 0")
    lengths = refs.select("reference_id", F.col("ref_length").cast("long").alias("len"))
    laid = runs.join(lengths, "reference_id").select("reference_id", "len", F.explode(F.sequence(F.col("seg_start"), F.col("seg_end") - 1, F.lit(length).cast("long"))).alias("at"))
    start = F.greatest(F.least(F.col("at"), F.col("len") - length), F.lit(0).cast("long"))
    return laid.select("reference_id", F.col("at").alias("bait"), start.alias("start"), F.least(start + length, F.col("len")).alias("end"))


def collapse_identical(probes: DataFrame, probe_id: str, probe: str) -> DataFrame:
    """(probe_id, probe, copies): one probe, the smallest id, for each text."""
    return probes.where(F.col(probe).isNotNull()).groupBy(F.upper(F.col(probe)).alias(probe)).agg(F.min(probe_id).alias(probe_id), F.count(F.lit(1)).alias("copies")).select(probe_id, probe, "copies")


def ranked_centroids(centroids: DataFrame, sizes: DataFrame) -> DataFrame:
    """centroids (probe_id, ..) with size, the largest cluster first; one that sizes (probe_id, size) doesn't list counts 1."""
    return centroids.join(sizes.select("probe_id", "size"), "probe_id", "left").withColumn("size", F.coalesce("size", F.lit(1)).cast("long")).orderBy(F.desc("size"), "probe_id")


def gap_details(segments: DataFrame, targets: DataFrame, min_length: int, individual: DataFrame | None = None) -> DataFrame:
    """(target_id, gap_start, gap_end, gap_length, is_terminal, gc_content, gap_type, individual_coverage, gap_sequence) of the bare stretches of at least min_length, gap_start from 1.

    segments as depth_segments gives them; targets (target_id, seq); targets without a
    sequence are left out. individual: segments without competition, which tell a gap that
    no probe reaches (true_gap) from one whose probes went elsewhere (multimapper_gap); null
    without them. A gap meets its target's chunks, never the whole sequence.
    """
    gaps = gap_regions(segments, min_length).withColumnRenamed("reference_id", "target_id")
    last = F.floor((F.col("gap_end") - 1) / CHUNK).cast("int")
    spread = gaps.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("gap_start") / CHUNK).cast("int"), last)))
    met = spread.join(chunked(targets, F.lit(0)).select("target_id", "chunk", "text"), ["target_id", "chunk"])
    low = F.greatest(F.col("gap_start") - F.col("chunk") * CHUNK, F.lit(0).cast("long"))
    part = F.substring("text", (low + 1).cast("int"), (F.least(F.col("gap_end") - F.col("chunk") * CHUNK, F.lit(CHUNK).cast("long")) - low).cast("int"))
    keys = ["target_id", "gap_start", "gap_end", "gap_length", "is_terminal"]
    texts = met.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", part.alias("part")))), lambda x: x["part"]), "").alias("gap_sequence"))
    if individual is None:
        typed = texts.withColumn("individual_coverage", F.lit(None).cast("double")).withColumn("gap_type", F.lit(None).cast("string"))
    else:
        reached = covered_fraction(texts.select(F.col("target_id").alias("reference_id"), F.col("gap_start").alias("s"), F.col("gap_end").alias("e")), individual)
        reached = reached.select(F.col("reference_id").alias("target_id"), F.col("s").alias("gap_start"), F.col("covered_fraction").alias("individual_coverage"))
        typed = texts.join(reached, ["target_id", "gap_start"]).withColumn("gap_type", F.when(F.col("individual_coverage") == 0, "true_gap").otherwise("multimapper_gap"))
    return typed.select("target_id", (F.col("gap_start") + 1).alias("gap_start"), "gap_end", "gap_length", "is_terminal", gc_content("gap_sequence").alias("gc_content"), "gap_type", "individual_coverage", "gap_sequence")


def ordered_gaps(gaps: DataFrame) -> DataFrame:
    """Gaps in their order for people: those that no probe reaches first, then the longest first."""
    return gaps.orderBy(F.when(F.col("gap_type") == "true_gap", 0).otherwise(1), F.desc("gap_length"), "target_id", "gap_start")


def percentile_coverage(stats: DataFrame, value: str, percent: float) -> DataFrame:
    """One row: the value at place floor(n * percent / 100) of the sorted values, counted from 0 and at most the last.

    The values are ranked by range partitioning; of the ranks one is kept.
    """
    known = global_rank(stats.where(F.col(value).isNotNull()).select(value), [value], "values")
    total = known.agg(F.count(F.lit(1)).alias("t"))
    place = F.least(F.floor(total.scalar() * percent / 100), total.scalar() - 1)
    return known.where(F.col("rank") == place).select(value)

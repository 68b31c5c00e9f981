"""Cross-reactivity of probes: hits as percentages, summaries, probes on several targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_percentages(hits: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Homology (matches over the probe) and identity (matches over the alignment), in percent, of hits from threshold on; a probe's hit on itself is dropped."""
    pct = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100).otherwise(F.lit(0.0))
    found = hits.withColumn("homology_pct", pct("matching_bases", "probe_length")).withColumn("identity_pct", pct("matching_bases", "alignment_length"))
    return found.where((F.col("homology_pct") >= threshold) & ~((F.col("hit_mode") == "self") & (F.col("probe_id") == F.col("target_id"))))


def summarize_hits(hits: DataFrame, probes: DataFrame, modes: Sequence[str]) -> DataFrame:
    """(probe_id, hit_mode, max_homology_pct, best_hit, num_hits) for every probe and mode; 0, null and 0 without hits.

    The best hit has the highest homology, then the smallest target id. probes: (probe_id).
    """
    every = probes.select("probe_id").distinct().select("probe_id", F.explode(F.array(*[F.lit(m) for m in modes])).alias("hit_mode"))
    best = F.min(F.struct((-F.col("homology_pct")).alias("h"), F.col("target_id").alias("t")))
    found = hits.where(F.col("homology_pct").isNotNull()).groupBy("probe_id", "hit_mode").agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
    joined = every.join(found, ["probe_id", "hit_mode"], "left")
    return joined.select("probe_id", "hit_mode", F.coalesce(-F.col("b.h"), F.lit(0.0)).alias("max_homology_pct"), F.col("b.t").alias("best_hit"), F.coalesce("n", F.lit(0)).cast("long").alias("num_hits"))


def multi_mapping(placements: DataFrame) -> DataFrame:
    """(probe_id, num_targets, targets): probes on more than one target, with the sorted list. placements: (probe_id, target_id)."""
    targets = placements.distinct().groupBy("probe_id").agg(F.array_sort(F.collect_set("target_id")).alias("t"))
    return targets.where(F.size("t") > 1).select("probe_id", F.size("t").cast("long").alias("num_targets"), F.concat_ws(",", "t").alias("targets"))


def probes_per_target(placements: DataFrame) -> DataFrame:
    """(target_id, n_probes)."""
    return placements.distinct().groupBy("target_id").agg(F.count(F.lit(1)).alias("n_probes"))


def hits_from_records(records: DataFrame, hit_mode: str, threshold: float = 0.0) -> DataFrame:
    """(probe_id, target_id, hit_mode, homology_pct, identity_pct, query_coverage_pct, matching_bases, alignment_length, probe_length) of unified PAF and BLAST records, from threshold on."""
    named = records.select(F.col("query_name").alias("probe_id"), F.col("target_name").alias("target_id"), F.lit(hit_mode).alias("hit_mode"), "matching_bases", F.col("block_length").alias("alignment_length"), F.col("query_length").alias("probe_length"), (F.col("query_end") - F.col("query_start")).alias("aligned"))
    covered = F.when(F.col("probe_length") > 0, F.col("aligned") / F.col("probe_length") * 100).otherwise(F.lit(0.0))
    found = hit_percentages(named, threshold).withColumn("query_coverage_pct", covered)
    return found.select("probe_id", "target_id", "hit_mode", "homology_pct", "identity_pct", "query_coverage_pct", "matching_bases", "alignment_length", "probe_length")


def ordered_hits(hits: DataFrame) -> DataFrame:
    """Hits in their order for people: by probe and mode, the best first."""
    return hits.orderBy("probe_id", "hit_mode", F.desc("homology_pct"), "target_id")

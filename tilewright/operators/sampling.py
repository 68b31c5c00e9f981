"""Seeded sampling of fragments and reads.

Every random number is a hash of the seed, the row's id and a stream number, so a result
depends neither on partitions nor on retries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.alignment import cigar_ref_length, paired_bases
from tilewright.functions.thermo import boltzmann_score, delta_g
from tilewright.operators.running import global_rank, running_totals

WEIGHT_UNITS = 1 << 44


def uniform(seed: int, row_id: Column | str, stream: int) -> Column:
    """A number in [0, 1)."""
    key = F.col(row_id) if isinstance(row_id, str) else row_id
    digest = F.md5(F.concat(F.lit(f"{seed}|{stream}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def normal(seed: int, row_id: Column | str, stream: int) -> Column:
    """A standard normal number, from streams stream and stream + 1."""
    radius = F.sqrt(-2.0 * F.ln(1.0 - uniform(seed, row_id, stream)))
    return radius * F.cos(2.0 * math.pi * uniform(seed, row_id, stream + 1))


def target_weights(refs: DataFrame, distractor_fraction: float) -> DataFrame:
    """(reference_id, category, weight): samples weigh 1, other targets 0, distractors together the given share of all.

    refs (reference_id, category). The share must lie in [0, 1).
    """
    if not 0 <= distractor_fraction < 1:
        raise ValueError("distractor_fraction must lie in [0, 1)")
    # the two counts are one row
    counts = refs.agg(F.count(F.when(F.col("category") == "sample", 1)).alias("n_s"), F.count(F.when(F.col("category") == "distractor", 1)).alias("n_d")).withColumn("k", F.lit(1))
    share = F.lit(distractor_fraction) * F.col("n_s") / (F.col("n_d") * F.lit(1.0 - distractor_fraction))
    weight = F.when(F.col("category") == "sample", F.lit(1.0)).when(F.col("category") == "distractor", share).otherwise(F.lit(0.0))
    known = refs.where(F.col("category").isin("sample", "nonsample_target", "distractor")).withColumn("k", F.lit(1))
    return known.join(F.broadcast(counts), "k").select("reference_id", "category", weight.alias("weight"))


def score_hits(alns: DataFrame, weights: DataFrame, temp_c: float, na_molar: float, thermo: bool = True) -> DataFrame:
    """(probe_id, reference_id, s, e, score): alignments of probes on weighted references.

    alns as SAM fields; weights (reference_id, weight), of which only those above 0 take
    part. The score is the weight, times the Boltzmann factor of the bases that pair if
    thermo. Secondary and supplementary alignments are hits like others. Rows without a
    reference, CIGAR or position are left out, without a sequence too if thermo.
    """
    rows = alns.where((F.col("rname") != "*") & (F.col("cigar") != "*") & F.col("pos").isNotNull())
    if "aln_id" in alns.columns:
        rows = rows.dropDuplicates(["aln_id"])
    rows = rows.join(weights.where("weight > 0").select(F.col("reference_id").alias("rname"), "weight"), "rname")
    score = F.col("weight")
    if thermo:
        rows = rows.where("seq <> '*'").withColumn("_paired", paired_bases("seq", "cigar", "md"))
        score = score * boltzmann_score(delta_g("_paired", temp_c, na_molar), temp_c)
    start = F.greatest(F.col("pos") - 1, F.lit(0))
    return rows.select(F.col("qname").alias("probe_id"), F.col("rname").alias("reference_id"), start.alias("s"), (start + cigar_ref_length("cigar")).alias("e"), score.alias("score"))


def weighted_choice(draws: DataFrame, u: str, items: DataFrame, order: list[str], weight: str) -> DataFrame:
    """Each row of draws with the row of items that its number u in [0, 1) falls on, items taking room by weight.

    The items are laid end to end in the order given, their running total cut into as many
    equal bins as there are items, and draws and items meet by bin: no join on inequality
    alone, and a heavy item's draws are spread over its many bins. Items weighing nothing,
    null or NaN are never drawn; without any other item the result is empty. Three numbers
    (the sum of the weights, its whole-number form, and the count) go through the driver.
    """
    some = items.where((F.col(weight) > 0) & ~F.isnan(weight))
    mass = some.agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n")).first()
    if not mass["n"]:
        return draws.withColumn("_k", F.lit(0)).join(some.withColumn("_k", F.lit(1)), "_k").drop("_k")
    ranked = global_rank(some, order, "items")
    units = F.greatest(F.round(F.col(weight) / F.lit(mass["w"]) * WEIGHT_UNITS), F.lit(1.0)).cast("long")
    steps = running_totals(ranked.select(F.lit(0).alias("g"), "rank", units.alias("units")), "g", "rank", "units")
    spans = steps.select("rank", F.coalesce("prev_total", F.lit(0)).alias("_lo"), F.col("total").alias("_hi"))
    whole = spans.agg(F.max("_hi").alias("t")).first()["t"]
    bin_size = max(1, whole // mass["n"])
    placed = ranked.join(spans, "rank").drop("rank").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / bin_size), F.floor((F.col("_hi") - 1) / bin_size))))
    at = draws.withColumn("_at", F.floor(F.col(u) * F.lit(whole))).withColumn("_bin", F.floor(F.col("_at") / bin_size))
    return at.join(placed, "_bin").where((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))).drop("_bin", "_at", "_lo", "_hi")


def split_pools(draws: DataFrame, draw_id: str, capture_fraction: float) -> DataFrame:
    """draws with pool 'capture' for exactly the rounded share of them, in the order of a hash, and 'background' for the rest."""
    share = min(1.0, max(0.0, capture_fraction))
    ranked = global_rank(draws.withColumn("_h", F.xxhash64(draw_id)), ["_h", draw_id], "draws").drop("_h")
    n = int(math.floor(draws.count() * share + 0.5))
    return ranked.withColumn("pool", F.when(F.col("rank") < n, "capture").otherwise("background")).drop("rank")


def capture_fragments(draws: DataFrame, hits: DataFrame, seed: int, mean: int, shortest: int, longest: int) -> DataFrame:
    """(draw_id, probe_id, reference_id, start, length): a fragment around a probe's hit for each draw.

    draws (draw_id); hits (probe_id, reference_id, s, e, score, ref_length). Probes are drawn
    evenly and their hits by score. Lengths are normal about mean, a sixth of the range as
    deviation, within the range and the reference; the centre lies up to a quarter of the
    length off the hit's, moved inside the reference.
    """
    if not shortest <= mean <= longest:
        raise ValueError("mean must lie between shortest and longest")
    totals = hits.groupBy("probe_id").agg(F.sum("score").alias("_all"))
    items = hits.join(totals, "probe_id").withColumn("_w", F.col("score") / F.col("_all")).where("_all > 0").drop("_all")
    chosen = weighted_choice(draws.withColumn("_u", uniform(seed, "draw_id", 0)), "_u", items, ["probe_id", "reference_id", "s", "e"], "_w")
    wanted = F.round(F.lit(float(mean)) + normal(seed, "draw_id", 1) * F.lit((longest - shortest) / 6.0))
    length = F.least(F.greatest(F.least(wanted, F.lit(float(longest))), F.lit(float(shortest))).cast("long"), F.col("ref_length"))
    sized = chosen.withColumn("length", length)
    centre = (F.col("s") + F.col("e")) / 2 + (uniform(seed, "draw_id", 3) * 2 - 1) * F.col("length") / 4
    start = F.least(F.greatest(F.floor(centre - F.col("length") / 2), F.lit(0)), F.col("ref_length") - F.col("length"))
    return sized.select("draw_id", "probe_id", "reference_id", start.cast("long").alias("start"), "length")


def background_fragments(draws: DataFrame, refs: DataFrame, seed: int, mean: int, shortest: int, longest: int) -> DataFrame:
    """(draw_id, reference_id, start, length): a fragment anywhere for each draw, references weighing weight times length.

    refs (reference_id, weight, ref_length). A draw on a reference shorter than its fragment gives no row.
    """
    items = refs.withColumn("_w", F.col("weight") * F.col("ref_length"))
    chosen = weighted_choice(draws.withColumn("_u", uniform(seed, "draw_id", 10)), "_u", items, ["reference_id"], "_w")
    wanted = F.round(F.lit(float(mean)) + normal(seed, "draw_id", 11) * F.lit((longest - shortest) / 6.0))
    sized = chosen.withColumn("length", F.greatest(F.least(wanted, F.lit(float(longest))), F.lit(float(shortest))).cast("long")).where(F.col("length") <= F.col("ref_length"))
    start = F.floor(uniform(seed, "draw_id", 13) * (F.col("ref_length") - F.col("length") + 1))
    return sized.select("draw_id", "reference_id", start.cast("long").alias("start"), "length")


def resample(draws: DataFrame, reads: DataFrame, read_id: str, seed: int) -> DataFrame:
    """(draw_id, *reads): one read for each draw, with replacement; paired reads stay together as one row."""
    return weighted_choice(draws.withColumn("_u", uniform(seed, "draw_id", 20)), "_u", reads.withColumn("_w", F.lit(1.0)), [read_id], "_w").drop("_u", "_w")

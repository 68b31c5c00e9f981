"""Similar targets of different species, what they make indistinguishable, and species calls.

Owners come as (target_id, species_id); a target may have several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.scratch import drop_table, materialize, write_table


def target_identity(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits of targets on targets with identity = matching bases over the shorter length, in percent, from threshold on; not with itself."""
    identity = F.col("matching_bases") / F.least("len_a", "len_b") * 100
    return hits.withColumn("identity_pct", identity).where((F.col("identity_pct") >= threshold) & (F.col("target_a") != F.col("target_b")))


def cross_species_edges(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """(target_id, similar_id, species_id, similar_species): similar targets that share no species, in both directions, with each owner of either.

    A target may have several owners; a pair with any owner in common is not a crossing one.
    """
    links = pairs.select("target_a", "target_b").dropna().where("target_a <> target_b").select(F.least("target_a", "target_b").alias("a"), F.greatest("target_a", "target_b").alias("b")).distinct()
    own = lambda c: owners.select(F.col("target_id").alias(c), F.col("species_id").alias(f"species_{c}")).distinct()
    owned = links.join(own("a"), "a").join(own("b"), "b")
    kin = owned.where("species_a = species_b").select("a", "b").distinct()
    crossing = owned.join(kin, ["a", "b"], "left_anti")
    return crossing.select(F.explode(F.array(*[F.struct(F.col(x).alias("target_id"), F.col(y).alias("similar_id"), F.col(f"species_{x}").alias("species_id"), F.col(f"species_{y}").alias("similar_species")) for x, y in (("a", "b"), ("b", "a"))])).alias("e")).select("e.*")


def confusion_matrix(edges: DataFrame, owners: DataFrame, most_species: int = 1_000) -> DataFrame:
    """(species_id, n_targets per other species in the order of their ids): one row for each species with all its counts, zeros too.

    A row is as long as there are species; more than most_species of them are an error, for which confusion_cells is the form.
    """
    ids = [r[0] for r in owners.select("species_id").distinct().orderBy("species_id").limit(most_species + 1).collect()]
    if len(ids) > most_species:
        raise ValueError(f"more than {most_species} species: use confusion_cells")
    counts = owners.select("species_id").distinct().join(confusion_cells(edges), "species_id", "left").groupBy("species_id")
    return counts.agg(*[F.coalesce(F.sum(F.when(F.col("other_species") == s, F.col("n"))), F.lit(0)).cast("long").alias(s) for s in ids])


def confusion_cells(edges: DataFrame) -> DataFrame:
    """(species_id, other_species, n): pairs of similar targets; the matrix in long form, without its zeros."""
    return edges.groupBy("species_id", F.col("similar_species").alias("other_species")).agg(F.count(F.lit(1)).alias("n"))


def discriminability(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Per species: targets, those without a similar one elsewhere, their share, and the species it is confused with."""
    shared = edges.select("target_id").distinct().withColumn("shared", F.lit(1))
    counts = owners.join(shared, "target_id", "left").groupBy("species_id").agg(F.count(F.lit(1)).alias("total_targets"), F.count(F.when(F.col("shared").isNull(), 1)).alias("unique_targets"))
    others = confusion_cells(edges).groupBy("species_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("other_species").alias("o")))).alias("l"))
    listed = others.select("species_id", F.concat_ws(",", F.transform("l", lambda x: F.concat(x["o"], F.lit(":"), (-x["k"]).cast("string")))).alias("confusable_species"))
    return counts.join(listed, "species_id", "left").select("species_id", "total_targets", "unique_targets", (F.col("total_targets") - F.col("unique_targets")).alias("shared_targets"), (F.col("unique_targets") / F.col("total_targets")).alias("discriminability_score"), "confusable_species")


def panel_tiers(scores: DataFrame) -> DataFrame:
    """One row: species that can be told apart fully, partly, and not at all."""
    n = lambda cond: F.count(F.when(cond, 1))
    s = F.col("discriminability_score")
    return scores.agg(n(s >= 1).alias("fully"), n((s > 0) & (s < 1)).alias("partly"), n(s == 0).alias("not_at_all"))


def species_evidence(edges: DataFrame, owners: DataFrame, detected: DataFrame) -> DataFrame:
    """Per species: unique and shared targets, how many of each are detected, and their reads. detected: (target_id, reads)."""
    shared = edges.select("target_id").distinct().withColumn("shared", F.lit(1))
    t = owners.select("target_id", "species_id").distinct().join(shared, "target_id", "left").join(detected.select("target_id", "reads"), "target_id", "left")
    is_shared, hit = F.col("shared").isNotNull(), F.col("reads").isNotNull()
    n = lambda cond: F.count(F.when(cond, 1))
    return t.groupBy("species_id").agg(F.count(F.lit(1)).alias("total_targets"), n(~is_shared).alias("unique_targets"), n(is_shared).alias("shared_targets"), n(~is_shared & hit).alias("unique_detected"), n(is_shared & hit).alias("shared_detected"), n(hit).alias("total_detected"), F.coalesce(F.sum("reads"), F.lit(0)).cast("long").alias("total_reads"))


def _present(evidence: DataFrame, unique_hits: DataFrame, min_unique: int) -> DataFrame:
    """(species_id, order): species with min_unique detected unique targets that no present species before them owns.

    Whether an owner before is present may hang on others before it. A round decides those
    species that have enough or too few targets however the undecided turn out; the first
    undecided one always is, so the rounds end. Where targets have one owner there is no round.
    """
    rank = evidence.select("species_id", F.struct((-F.col("unique_detected")).alias("u"), (-F.col("total_reads")).alias("r"), F.col("species_id").alias("s")).alias("order"), "unique_detected").where("unique_detected > 0")
    held = unique_hits.join(rank.select("species_id", "order"), "species_id")
    earlier = held.select("target_id", F.col("species_id").alias("other"), F.col("order").alias("other_order"))
    contested = held.join(earlier, "target_id").where("other_order < order").select("species_id", "target_id", "other")
    # per species: targets without a contest count at once
    free = held.join(contested.select("species_id", "target_id").distinct(), ["species_id", "target_id"], "left_anti").groupBy("species_id").agg(F.count(F.lit(1)).alias("free"))
    base = rank.join(free, "species_id", "left").select("species_id", "order", F.coalesce("free", F.lit(0)).alias("free"), "unique_detected")
    verdict = F.when(F.col("free") >= min_unique, True).when(F.col("unique_detected") < min_unique, False)
    state, state_at = write_table(base.withColumn("present", verdict), "calls")
    contested, contested_at = write_table(contested, "contested")
    while not state.where("present IS NULL").isEmpty():
        seen = contested.join(state.select(F.col("species_id").alias("other"), "present"), "other")
        targets = seen.groupBy("species_id", "target_id").agg(F.max(F.col("present").eqNullSafe(True)).alias("taken"), F.max(F.col("present").isNull()).alias("open"))
        sums = targets.groupBy("species_id").agg(F.count(F.when(~F.col("taken") & ~F.col("open"), 1)).alias("won"), F.count(F.when(~F.col("taken"), 1)).alias("may"))
        now = state.join(sums, "species_id", "left").withColumn("present", F.coalesce("present", F.when(F.col("free") + F.coalesce("won", F.lit(0)) >= min_unique, True).when(F.col("free") + F.coalesce("may", F.lit(0)) < min_unique, False))).select(state.columns)
        following, following_at = write_table(now, "calls")
        drop_table(state.sparkSession, state_at)
        state, state_at = following, following_at
    return state.where("present").select("species_id", "order")


def call_species(edges: DataFrame, owners: DataFrame, detected: DataFrame, min_unique: int = 1) -> DataFrame:
    """Evidence per species with its call and reason, and the present species that explain it.

    Species are judged from the strongest evidence down (unique detections, reads, id). One
    with min_unique unexplained unique detections is present and explains, for those after
    it, its own targets and those similar to them. Of the others, a species is ABSENT if all
    its detections are explained, and AMBIGUOUS if not. Targets may have several owners.
    Nothing is collected.
    """
    owners = materialize(owners.select("target_id", "species_id").distinct(), "owners")
    edges, detected = materialize(edges, "edges"), materialize(detected.select("target_id", "reads"), "detected")
    evidence = materialize(species_evidence(edges, owners, detected), "evidence")
    hit = owners.join(detected.select("target_id").distinct(), "target_id", "left_semi")
    similar = edges.select("target_id", "similar_id").distinct()
    shared = similar.select("target_id").distinct()
    unique_hits = hit.join(shared, "target_id", "left_anti")
    there = _present(evidence, unique_hits, min_unique)
    called = evidence.join(there.select("species_id", F.lit(True).alias("present")), "species_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    # what present species explain: their own targets, and those similar to them
    by = there.select(F.col("species_id").alias("by"), F.col("order").alias("by_order"))
    own = owners.withColumnRenamed("species_id", "by").join(by, "by")
    near = similar.join(own.withColumnRenamed("target_id", "similar_id"), "similar_id").select("target_id", "by", "by_order", F.lit(1).alias("near"))
    explained = own.select("target_id", "by", "by_order", F.lit(0).alias("near")).unionByName(near)
    first = explained.groupBy("target_id").agg(F.min("by_order").alias("by_order"))
    order = F.struct((-F.col("unique_detected")).alias("u"), (-F.col("total_reads")).alias("r"), F.col("species_id").alias("s"))
    judged = hit.join(called.where("NOT present").select("species_id", order.alias("order")), "species_id")
    open_hits = judged.join(first, "target_id", "left").where(F.col("by_order").isNull() | (F.col("by_order") > F.col("order"))).join(shared.withColumn("shared", F.lit(1)), "target_id", "left")
    counts = open_hits.groupBy("species_id").agg(F.count(F.when(F.col("shared").isNull(), 1)).alias("open_unique"), F.count("shared").alias("open_shared"))
    explainers = judged.join(near, "target_id").where("by_order < order").groupBy("species_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("by"))).alias("explainers"))
    e = called.join(counts, "species_id", "left").join(explainers, "species_id", "left").withColumn("open_unique", F.coalesce("open_unique", F.lit(0))).withColumn("open_shared", F.coalesce("open_shared", F.lit(0)))
    none_unique = F.col("open_unique") == 0
    reason = (
        F.when(F.col("total_detected") == 0, "no_detections")
        .when(F.col("present"), "unique_markers_detected")
        .when((F.col("unique_targets") == 0) & none_unique & (F.col("open_shared") > 0), "no_unique_markers")
        .when(none_unique & (F.col("open_shared") == 0), "cross_reactivity_explained")
        .otherwise("insufficient_unique_evidence")
    )
    e = e.withColumn("reason", reason)
    call = F.when(F.col("reason") == "unique_markers_detected", "PRESENT").when(F.col("reason").isin("no_detections", "cross_reactivity_explained"), "ABSENT").otherwise("AMBIGUOUS")
    return e.select("species_id", call.alias("call"), "total_targets", "unique_targets", "shared_targets", "unique_detected", "shared_detected", "total_detected", "total_reads", F.when(F.col("reason") == "cross_reactivity_explained", F.col("explainers")).alias("explained_by"), "reason")

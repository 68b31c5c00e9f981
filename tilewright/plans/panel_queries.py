"""Queries on detection, similarity, cross-reactivity and the sweep, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions.sequence import source_id
from tilewright.operators import crossreact as X
from tilewright.operators import depth as D
from tilewright.operators import detection as N
from tilewright.operators import similarity as Y
from tilewright.plans.depth_queries import _READS, _share, read_segments
from tilewright.scratch import materialize
from tilewright.tables import table

_N = "(seg_end - seg_start)"


def refs(spark, d):
    return table(spark, d, "ref_targets").select(F.col("rname").alias("reference_id"), "group_name", "category", "ord")


def alns(spark, d):
    return table(spark, d, "sam_alignments")


def detected(spark, d):
    """Written once, a row for each reference, as most queries read it more than once."""
    return materialize(N.reads_per_reference(alns(spark, d)), "detected")


def owners(spark, d):
    """Targets with the species (group) that owns them."""
    return N.with_groups(refs(spark, d)).where(F.col("category").isin("sample", "nonsample_target")).select(F.col("reference_id").alias("target_id"), F.col("group_name").alias("species_id"))


def clean_id(c):
    return F.nullif(F.regexp_extract(F.regexp_replace(F.regexp_replace(F.col(c), r"^[ \t]+", ""), "^>", ""), r"^[^ \t]*", 0), F.lit(""))


def similar_pairs(spark, d):
    rows = table(spark, d, "target_similarity").select(clean_id("target_a").alias("target_a"), clean_id("target_b").alias("target_b"), "matching_bases", "len_a", "len_b")
    return Y.target_identity(rows, 90.0)


def edges(spark, d):
    return Y.cross_species_edges(similar_pairs(spark, d), owners(spark, d))


def detected_targets(spark, d, min_reads=1):
    return detected(spark, d).where(F.col("reads") >= min_reads).select(F.col("reference_id").alias("target_id"), "reads")


def a1_reads_per_reference(spark, d):
    return detected(spark, d)


def a2_read_mappings(spark, d):
    return N.read_mappings(alns(spark, d))


def a3_mapped_read_ids(spark, d):
    return N.mapped_read_ids(alns(spark, d))


def j5_unmapped_reads(spark, d):
    names = alns(spark, d).select("qname").dropna().distinct()
    return names.join(N.mapped_read_ids(alns(spark, d)), "qname", "left_anti")


def j4_reads_on_sample_targets(spark, d):
    sample = refs(spark, d).where("category = 'sample'").select(F.col("reference_id").alias("rname"))
    return alns(spark, d).join(sample, "rname", "left_semi").select("aln_id", "qname", "rname").distinct()


def a4_count_per_source(spark, d):
    return N.fragments_per_source(N.read_mappings(alns(spark, d)))


def a5_category_counts(spark, d):
    return N.category_counts(alns(spark, d).select("qname").dropna().distinct(), refs(spark, d))


def a6_fragment_class(spark, d):
    sources = alns(spark, d).select("qname", source_id("qname").alias("reference_id")).distinct().where("reference_id IS NOT NULL")
    return sources.join(refs(spark, d).select("reference_id", "category"), "reference_id", "left").select("qname", F.coalesce("category", F.lit("unknown")).alias("fragment_class"))


def j8_mapping_accuracy(spark, d):
    return N.mapping_accuracy(N.read_mappings(alns(spark, d)), refs(spark, d))


def a7_reads_per_group(spark, d):
    joined = detected(spark, d).join(N.with_groups(refs(spark, d)), "reference_id", "left")
    return joined.groupBy(F.coalesce("group_name", "reference_id").alias("group_name")).agg(F.sum("reads").alias("reads"))


def a11_group_detail(spark, d):
    return N.group_detail(detected(spark, d), refs(spark, d))


def a8_confusion_all(spark, d):
    """a8_confusion_metrics by its earlier name."""
    return a8_confusion_metrics(spark, d)


def a8_confusion_metrics(spark, d, min_reads=1):
    """Over all detected references, or those with min_reads."""
    return N.confusion_metrics(N.group_detail(detected(spark, d).where(F.col("reads") >= min_reads), refs(spark, d)))


def a9_unknown_detected(spark, d):
    known = refs(spark, d).where(F.col("category").isin("sample", "nonsample_target", "distractor"))
    return detected(spark, d).join(known, "reference_id", "left_anti").select("reference_id", "reads")


def a10_detail_rows(spark, d):
    mappings = materialize(N.read_mappings(alns(spark, d)), "mappings")
    found = materialize(N.reads_of_mappings(mappings), "detected")
    return N.detail_rows(found, refs(spark, d), N.fragments_per_source(mappings).withColumnRenamed("source_id", "reference_id"), D.coverage_stats(read_segments(spark, d)))


def a12_flow_counts(spark, d):
    names = alns(spark, d).select("qname").dropna().distinct().agg(F.count(F.lit(1)).alias("reads_sequenced"))
    mapped = N.mapping_accuracy(N.read_mappings(alns(spark, d)), refs(spark, d))
    both = names.select("reads_sequenced", F.lit(1).alias("k")).join(mapped.withColumn("k", F.lit(1)), "k")
    n = F.col("reads_correctly_mapped") + F.col("reads_incorrectly_mapped")
    return both.select("reads_sequenced", n.alias("reads_mapped"), F.greatest(F.col("reads_sequenced") - n, F.lit(0)).alias("reads_unmapped"))


def j10_target_identity(spark, d):
    return similar_pairs(spark, d).select("target_a", "target_b", F.round("identity_pct", 9).alias("identity_pct"))


def j11_cross_species_edges(spark, d):
    return edges(spark, d)


def a19_discriminability(spark, d):
    return Y.discriminability(edges(spark, d), owners(spark, d))


def a20_confusion_cells(spark, d):
    return Y.confusion_cells(edges(spark, d))


def a21_panel_tiers(spark, d):
    return Y.panel_tiers(Y.discriminability(edges(spark, d), owners(spark, d)))


def a29_species_evidence(spark, d, min_reads=1):
    return Y.species_evidence(edges(spark, d), owners(spark, d), detected_targets(spark, d, min_reads))


def g7_species_calls(spark, d, min_reads=1, min_unique=1):
    return Y.call_species(edges(spark, d), owners(spark, d), detected_targets(spark, d, min_reads), min_unique=min_unique)


def a29_species_evidence_all(spark, d):
    """a29_species_evidence by its earlier name."""
    return a29_species_evidence(spark, d)


def g7_species_calls_all(spark, d):
    """g7_species_calls by its earlier name."""
    return g7_species_calls(spark, d)


def j15_renamed_reads(spark, d):
    return N.renamed_reads(alns(spark, d), alns(spark, d))


def s9_groups_on_both_sides(spark, d):
    known = N.with_groups(refs(spark, d))
    targets = known.where(F.col("category").isin("sample", "nonsample_target")).select("group_name")
    return targets.intersect(known.where("category = 'distractor'").select("group_name"))


def s9_unlisted_references(spark, d):
    """References that alignments name and the dictionary doesn't; a complete dictionary leaves none."""
    return alns(spark, d).where("rname <> '*'").select(F.col("rname").alias("reference_id")).distinct().join(refs(spark, d), "reference_id", "left_anti")


def s9_all_names(spark, d):
    probes = table(spark, d, "probe_alns").select(F.col("target").alias("reference_id"))
    return alns(spark, d).select(F.col("rname").alias("reference_id")).unionByName(probes).where("reference_id <> '*'").distinct()


def j9_fragments_per_group(spark, d):
    """Fragments of each target, summed over the sources that belong to its group."""
    known = N.with_groups(refs(spark, d))
    sources = a4_count_per_source(spark, d).withColumnRenamed("source_id", "reference_id").join(known, "reference_id").groupBy("group_name").agg(F.sum("fragments").alias("fragments"))
    targets = known.where(F.col("category").isin("sample", "nonsample_target"))
    return targets.join(sources, "group_name", "left").select("reference_id", F.coalesce("fragments", F.lit(0)).cast("long").alias("fragments"))


def hits(spark, d):
    return table(spark, d, "xreact_hits").dropDuplicates(["hit_id"])


def a17_hit_percentages(spark, d):
    return X.hit_percentages(hits(spark, d), 50.0).select("hit_id", F.round("homology_pct", 9).alias("homology_pct"), F.round("identity_pct", 9).alias("identity_pct"))


def a18_probe_summary(spark, d):
    return X.summarize_hits(hits(spark, d), table(spark, d, "probe_alns").select(F.col("probe_name").alias("probe_id")).unionByName(hits(spark, d).select("probe_id")), ["against", "self"])


def a15_multi_mapping(spark, d):
    placed = table(spark, d, "probe_alns").where("target <> '*'").select(F.col("probe_name").alias("probe_id"), F.col("target").alias("target_id"))
    return X.multi_mapping(placed)


def a16_probes_per_target(spark, d):
    placed = table(spark, d, "probe_alns").where("target <> '*'").select(F.col("probe_name").alias("probe_id"), F.col("target").alias("target_id"))
    return X.probes_per_target(placed)


QUERIES = {
    f.__name__: f
    for f in (
        *(a1_reads_per_reference, a2_read_mappings, a3_mapped_read_ids, j4_reads_on_sample_targets, j5_unmapped_reads, a4_count_per_source, a5_category_counts, a6_fragment_class, j8_mapping_accuracy, a7_reads_per_group),
        *(a8_confusion_metrics, a9_unknown_detected, a10_detail_rows, a11_group_detail, a12_flow_counts, j10_target_identity, j11_cross_species_edges, a19_discriminability, a20_confusion_cells, a21_panel_tiers),
        *(a29_species_evidence, j9_fragments_per_group, j15_renamed_reads, s9_groups_on_both_sides, s9_unlisted_references, s9_all_names, g7_species_calls, a17_hit_percentages, a18_probe_summary, a15_multi_mapping, a16_probes_per_target),
        *(a8_confusion_all, a29_species_evidence_all, g7_species_calls_all),
    )
}

_MAP = "map AS (SELECT qname, arg_min(rname, aln_id) AS reference_id FROM sam_alignments WHERE rname <> '*' AND (coalesce(flag, 0) & 2304) = 0 AND qname IS NOT NULL GROUP BY qname)"
_DET = f"{_MAP}, det AS (SELECT reference_id, count(*) AS reads FROM map GROUP BY ALL)"
_SRC = r"nullif(regexp_extract(qname, '^(\S*)_fragment_', 1), '')"
_KNOWN = "known AS (SELECT rname AS reference_id, coalesce(group_name, rname) AS group_name, category FROM ref_targets)"
_ACC = f"""{_MAP}, {_KNOWN}, tgt AS (SELECT * FROM known WHERE category IN ('sample', 'nonsample_target')),
acc AS (SELECT coalesce(s.group_name, src) = coalesce(m.group_name, mapped) AS same FROM (SELECT {_SRC} AS src, reference_id AS mapped FROM map) LEFT JOIN tgt s ON s.reference_id = src LEFT JOIN tgt m ON m.reference_id = mapped WHERE src IS NOT NULL)"""


def _groups(det: str) -> str:
    return f"""grp AS (SELECT CASE WHEN category = 'distractor' THEN 'distractor' ELSE 'target' END AS side, group_name, bool_or(category = 'sample') AS is_sample, count(*) AS member_count, count(reads) AS detected_member_count, CAST(coalesce(sum(reads), 0) AS BIGINT) AS total_reads
  FROM known LEFT JOIN {det} USING (reference_id) WHERE category IN ('sample', 'nonsample_target', 'distractor') GROUP BY ALL),
gd AS (SELECT group_name, CASE WHEN is_sample THEN 'sample' ELSE side END AS category, is_sample AS expected, detected_member_count > 0 AS detected,
  CASE WHEN side = 'distractor' THEN CASE WHEN detected_member_count > 0 THEN 'FP_distractor' ELSE 'TN_distractor' END WHEN is_sample THEN CASE WHEN detected_member_count > 0 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN detected_member_count > 0 THEN 'FP_target' ELSE 'TN_target' END END AS classification,
  member_count, detected_member_count, total_reads FROM grp)"""


def _clean(c: str) -> str:
    return rf"nullif(regexp_extract(regexp_replace(regexp_replace({c}, '^[ \t]+', ''), '^>', ''), '^[^ \t]*'), '')"


_SIM = f"sim AS (SELECT * FROM (SELECT {_clean('target_a')} AS target_a, {_clean('target_b')} AS target_b, matching_bases / CAST(least(len_a, len_b) AS DOUBLE) * 100 AS identity_pct FROM target_similarity) WHERE identity_pct >= 90.0 AND target_a <> target_b)"
_OWN = "own AS (SELECT rname AS target_id, coalesce(group_name, rname) AS species_id FROM ref_targets WHERE category IN ('sample', 'nonsample_target'))"
_EDGES = f"""{_SIM}, {_OWN}, und AS (SELECT DISTINCT least(target_a, target_b) AS a, greatest(target_a, target_b) AS b FROM sim),
crs AS (SELECT a, b, x.species_id AS sa, y.species_id AS sb FROM und JOIN own x ON x.target_id = a JOIN own y ON y.target_id = b WHERE x.species_id <> y.species_id),
edges AS (SELECT a AS target_id, b AS similar_id, sa AS species_id, sb AS similar_species FROM crs UNION ALL SELECT b, a, sb, sa FROM crs)"""
_DISC = f"""{_EDGES}, cells AS (SELECT species_id, similar_species AS other_species, count(*) AS n FROM edges GROUP BY ALL),
cnt AS (SELECT species_id, count(*) AS total_targets, count(*) FILTER (target_id NOT IN (SELECT target_id FROM edges)) AS unique_targets FROM own GROUP BY ALL),
lst AS (SELECT species_id, string_agg(other_species || ':' || n, ',' ORDER BY n DESC, other_species) AS confusable_species FROM cells GROUP BY ALL),
disc AS (SELECT species_id, total_targets, unique_targets, total_targets - unique_targets AS shared_targets, unique_targets / CAST(total_targets AS DOUBLE) AS discriminability_score, confusable_species FROM cnt LEFT JOIN lst USING (species_id))"""
_EVID = f"""{_DET}, {_EDGES}, dt AS (SELECT reference_id AS target_id, reads FROM det), o AS (SELECT own.*, reads, target_id IN (SELECT target_id FROM edges) AS shared FROM own LEFT JOIN dt USING (target_id)),
ev AS (SELECT species_id, count(*) AS total_targets, count(*) FILTER (NOT shared) AS unique_targets, count(*) FILTER (shared) AS shared_targets, count(*) FILTER (NOT shared AND reads IS NOT NULL) AS unique_detected, count(*) FILTER (shared AND reads IS NOT NULL) AS shared_detected,
  count(reads) AS total_detected, CAST(coalesce(sum(reads), 0) AS BIGINT) AS total_reads FROM o GROUP BY ALL)"""
_HITS = "(SELECT DISTINCT ON (hit_id) * FROM xreact_hits)"


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / CAST({b} AS DOUBLE) ELSE 0.0 END"


def _n(c: str) -> str:
    return f"count(*) FILTER (classification = '{c}')"


ORACLE = {
    "j15_renamed_reads": f"WITH f AS (SELECT regexp_replace(qname, '/[12]$', '') AS bare, arg_min(rname, aln_id) AS mapped FROM sam_alignments WHERE rname <> '*' AND (coalesce(flag, 0) & 2304) = 0 AND qname IS NOT NULL GROUP BY ALL), n AS (SELECT DISTINCT qname, regexp_replace(qname, '/[12]$', '') AS bare FROM sam_alignments WHERE qname IS NOT NULL) SELECT qname, coalesce(mapped, {_SRC}, bare) AS source_id FROM n LEFT JOIN f USING (bare)",
    "s9_groups_on_both_sides": f"WITH {_KNOWN} SELECT group_name FROM known WHERE category IN ('sample', 'nonsample_target') INTERSECT SELECT group_name FROM known WHERE category = 'distractor'",
    "s9_unlisted_references": "SELECT DISTINCT rname AS reference_id FROM sam_alignments WHERE rname <> '*' AND rname NOT IN (SELECT rname FROM ref_targets)",
    "s9_all_names": "SELECT rname AS reference_id FROM sam_alignments WHERE rname <> '*' UNION SELECT target FROM probe_alns WHERE target <> '*'",
    "j9_fragments_per_group": f"WITH {_MAP}, {_KNOWN}, s AS (SELECT group_name, count(*) AS n FROM map JOIN known ON known.reference_id = {_SRC} GROUP BY ALL) SELECT reference_id, coalesce(n, 0) AS fragments FROM known LEFT JOIN s USING (group_name) WHERE category IN ('sample', 'nonsample_target')",
    "a1_reads_per_reference": f"WITH {_DET} SELECT * FROM det",
    "a2_read_mappings": f"WITH {_MAP} SELECT * FROM map",
    "a3_mapped_read_ids": "SELECT DISTINCT qname FROM sam_alignments WHERE rname <> '*' AND qname IS NOT NULL",
    "j4_reads_on_sample_targets": "SELECT DISTINCT aln_id, qname, rname FROM sam_alignments WHERE rname IN (SELECT rname FROM ref_targets WHERE category = 'sample')",
    "j5_unmapped_reads": "SELECT DISTINCT qname FROM sam_alignments WHERE qname IS NOT NULL EXCEPT SELECT qname FROM sam_alignments WHERE rname <> '*'",
    "a4_count_per_source": f"WITH {_MAP} SELECT {_SRC} AS source_id, count(*) AS fragments FROM map WHERE {_SRC} IS NOT NULL GROUP BY ALL",
    "a5_category_counts": f"SELECT coalesce(category, 'unknown') AS category, count(*) AS n FROM (SELECT DISTINCT qname FROM sam_alignments WHERE qname IS NOT NULL) LEFT JOIN ref_targets ON rname = {_SRC} WHERE {_SRC} IS NOT NULL GROUP BY ALL",
    "a6_fragment_class": f"SELECT qname, coalesce(category, 'unknown') AS fragment_class FROM (SELECT DISTINCT qname FROM sam_alignments) LEFT JOIN ref_targets ON rname = {_SRC} WHERE {_SRC} IS NOT NULL",
    "j8_mapping_accuracy": f"WITH {_ACC} SELECT count(*) FILTER (same) AS reads_correctly_mapped, count(*) FILTER (NOT same) AS reads_incorrectly_mapped FROM acc",
    "a7_reads_per_group": f"WITH {_DET}, {_KNOWN} SELECT coalesce(group_name, reference_id) AS group_name, CAST(sum(reads) AS BIGINT) AS reads FROM det LEFT JOIN known USING (reference_id) GROUP BY ALL",
    "a11_group_detail": f"WITH {_DET}, {_KNOWN}, {_groups('det')} SELECT * FROM gd",
    "a8_confusion_metrics": f"""WITH {_DET}, {_KNOWN}, {_groups('det')},
c AS (SELECT {_n('TP')} AS tp_count, {_n('FN')} AS fn_count, {_n('FP_target')} AS fp_target_count, {_n('FP_distractor')} AS fp_distractor_count, {_n('TN_target')} AS tn_target_count, {_n('TN_distractor')} AS tn_distractor_count FROM gd),
t AS (SELECT *, fp_target_count + fp_distractor_count AS fp_total, tn_target_count + tn_distractor_count AS tn_total FROM c),
r AS (SELECT *, {_rate('tp_count', '(tp_count + fn_count)')} AS sensitivity, {_rate('tn_total', '(tn_total + fp_total)')} AS specificity, {_rate('tp_count', '(tp_count + fp_total)')} AS precision FROM t)
SELECT *, CASE WHEN precision + sensitivity > 0 THEN 2.0::DOUBLE * precision * sensitivity / (precision + sensitivity) ELSE 0.0 END AS f1_score FROM r""",
    "a9_unknown_detected": f"WITH {_DET} SELECT * FROM det WHERE reference_id NOT IN (SELECT rname FROM ref_targets WHERE category IN ('sample', 'nonsample_target', 'distractor'))",
    "a10_detail_rows": f"""{_READS}, {_DET}, {_KNOWN}, {_groups('det')}, gen AS (SELECT {_SRC} AS reference_id, count(*) AS fragments FROM map GROUP BY ALL),
cov AS (SELECT reference_id, CAST(sum({_N}) AS BIGINT) AS ref_length, sum(depth * {_N}) / CAST(sum({_N}) AS DOUBLE) AS avg_coverage, {_share('depth >= 5')} AS pct_covered_5x, {_share('depth >= 20')} AS pct_covered_20x FROM seg GROUP BY reference_id),
rws AS (SELECT reference_id, coalesce(group_name, reference_id) AS group_name, coalesce(category, 'unknown') AS category, true AS detected, reads AS reads_assigned, CASE category WHEN 'sample' THEN 'TP' WHEN 'nonsample_target' THEN 'FP_target' WHEN 'distractor' THEN 'FP_distractor' ELSE 'UNKNOWN' END AS classification FROM det LEFT JOIN known USING (reference_id) WHERE category IS DISTINCT FROM 'untargeted'
  UNION ALL SELECT reference_id, group_name, category, reads IS NOT NULL, coalesce(reads, 0), CASE WHEN category = 'sample' THEN 'FN' ELSE 'untargeted' END FROM known LEFT JOIN det USING (reference_id) WHERE category = 'untargeted' OR (category = 'sample' AND group_name IN (SELECT group_name FROM gd WHERE classification = 'FN')))
SELECT reference_id, group_name, category, detected, coalesce(fragments, 0) AS fragments_generated, reads_assigned, classification, coalesce(ref_length, 0) AS ref_length, coalesce(avg_coverage, 0.0) AS avg_coverage, coalesce(pct_covered_5x, 0.0) AS pct_covered_5x, coalesce(pct_covered_20x, 0.0) AS pct_covered_20x
FROM rws LEFT JOIN gen USING (reference_id) LEFT JOIN cov USING (reference_id)""",
    "a12_flow_counts": f"WITH {_ACC}, s AS (SELECT count(DISTINCT qname) AS n FROM sam_alignments) SELECT n AS reads_sequenced, (SELECT count(*) FROM acc) AS reads_mapped, greatest(n - (SELECT count(*) FROM acc), 0) AS reads_unmapped FROM s",
    "j10_target_identity": f"WITH {_SIM} SELECT target_a, target_b, round(identity_pct, 9) AS identity_pct FROM sim",
    "j11_cross_species_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "a19_discriminability": f"WITH {_DISC} SELECT * FROM disc",
    "a20_confusion_cells": f"WITH {_DISC} SELECT * FROM cells",
    "a21_panel_tiers": f"WITH {_DISC} SELECT count(*) FILTER (discriminability_score >= 1) AS fully, count(*) FILTER (discriminability_score > 0 AND discriminability_score < 1) AS partly, count(*) FILTER (discriminability_score = 0) AS not_at_all FROM disc",
    "a29_species_evidence": f"WITH {_EVID} SELECT * FROM ev",
    "g7_species_calls": f"""WITH {_EVID}, pres AS (SELECT species_id FROM ev WHERE total_detected > 0 AND unique_detected >= 1),
ex AS (SELECT species_id, count(DISTINCT target_id) AS n, string_agg(DISTINCT similar_species, ',' ORDER BY similar_species) AS explainers FROM edges WHERE target_id IN (SELECT target_id FROM dt) AND similar_species IN (SELECT species_id FROM pres) GROUP BY ALL),
j AS (SELECT ev.*, explainers, shared_detected - coalesce(n, 0) AS open, species_id IN (SELECT species_id FROM pres) AS present FROM ev LEFT JOIN ex USING (species_id)),
r AS (SELECT *, CASE WHEN total_detected = 0 THEN 'no_detections' WHEN present THEN 'unique_markers_detected' WHEN unique_targets = 0 AND unique_detected = 0 AND open > 0 THEN 'no_unique_markers' WHEN unique_detected = 0 AND open = 0 THEN 'cross_reactivity_explained' ELSE 'insufficient_unique_evidence' END AS reason FROM j)
SELECT species_id, CASE WHEN reason = 'unique_markers_detected' THEN 'PRESENT' WHEN reason IN ('no_detections', 'cross_reactivity_explained') THEN 'ABSENT' ELSE 'AMBIGUOUS' END AS call, total_targets, unique_targets, shared_targets, unique_detected, shared_detected, total_detected, total_reads, CASE WHEN reason = 'cross_reactivity_explained' THEN explainers END AS explained_by, reason FROM r""",
    "a17_hit_percentages": f"SELECT hit_id, round(h, 9) AS homology_pct, round(i, 9) AS identity_pct FROM (SELECT *, {_rate('matching_bases', 'probe_length')} * 100 AS h, {_rate('matching_bases', 'alignment_length')} * 100 AS i FROM {_HITS}) WHERE h >= 50 AND NOT (hit_mode = 'self' AND probe_id = target_id)",
    "a18_probe_summary": f"""WITH p AS (SELECT DISTINCT probe_name AS probe_id FROM probe_alns WHERE probe_name IS NOT NULL UNION SELECT probe_id FROM xreact_hits), e AS (SELECT probe_id, unnest(['against', 'self']) AS hit_mode FROM p),
f AS (SELECT probe_id, hit_mode, max(homology_pct) AS h, count(*) AS n FROM {_HITS} WHERE homology_pct IS NOT NULL GROUP BY ALL),
b AS (SELECT probe_id, hit_mode, min(target_id) AS t FROM {_HITS} x JOIN f USING (probe_id, hit_mode) WHERE x.homology_pct = f.h GROUP BY ALL)
SELECT probe_id, hit_mode, coalesce(h, 0.0) AS max_homology_pct, t AS best_hit, coalesce(n, 0) AS num_hits FROM e LEFT JOIN f USING (probe_id, hit_mode) LEFT JOIN b USING (probe_id, hit_mode)""",
    "a15_multi_mapping": "SELECT probe_name AS probe_id, count(DISTINCT target) AS num_targets, string_agg(DISTINCT target, ',' ORDER BY target) AS targets FROM probe_alns WHERE target <> '*' GROUP BY probe_name HAVING count(DISTINCT target) > 1",
    "a16_probes_per_target": "SELECT target AS target_id, count(*) AS n_probes FROM (SELECT DISTINCT probe_name, target FROM probe_alns WHERE target <> '*') GROUP BY target",
}
ORACLE |= {f"{name}_all": ORACLE[full] for name, full in (("a8_confusion", "a8_confusion_metrics"), ("a29_species_evidence", "a29_species_evidence"), ("g7_species_calls", "g7_species_calls"))}

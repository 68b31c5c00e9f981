"""Queries on sampling, probe choice, parameter sweeps and report tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.functions.labels import combination_label
from tilewright.functions.thermo import GAS, boltzmann_score, delta_g
from tilewright.operators import depth as D
from tilewright.operators import design as G
from tilewright.operators import detection as N
from tilewright.operators import sampling as R
from tilewright.operators.running import running_totals
from tilewright.plans.depth_queries import _READS, _SPANS, probe_segments, probe_spans, read_segments, references
from tilewright.plans.panel_queries import _DET, _KNOWN, _groups, a8_confusion_metrics, alns, detected, hits, refs
from tilewright.plans.sequence_queries import _R, reads
from tilewright.tables import table

SEED = 42


def draws(spark, d):
    return alns(spark, d).select(F.col("aln_id").alias("draw_id")).dropna().distinct()


def weighted_refs(spark, d):
    return R.target_weights(refs(spark, d), 0.5).join(references(spark, d), "reference_id")


def r1_target_weights(spark, d):
    return R.target_weights(refs(spark, d), 0.5).select("reference_id", F.round("weight", 9).alias("weight"))


def r2_hit_scores(spark, d):
    scored = R.score_hits(alns(spark, d), R.target_weights(refs(spark, d), 0.5), 65.0, 0.05)
    return scored.select("probe_id", "reference_id", "s", "e", F.round(F.ln("score"), 6).alias("log_score"))


def r2_simple_hit_scores(spark, d):
    scored = R.score_hits(alns(spark, d), R.target_weights(refs(spark, d), 0.5), 65.0, 0.05, thermo=False)
    return scored.select("probe_id", "reference_id", "s", "e", F.round("score", 9).alias("score"))


def f25_sweep_labels(spark, d):
    rows = table(spark, d, "sweep_summary").select("ct", "hybridization_temperature", "capture_fraction", "num_sequences").distinct()
    return rows.select("*", combination_label(ct="ct", temp="hybridization_temperature", cf="capture_fraction", n="num_sequences").alias("label"))


def d12_individual_coverage(spark, d):
    """Breadth of each target by all spans placed on it, and by only those of probes that have no longer span elsewhere."""
    spans = probe_spans(spark, d)
    best = spans.groupBy("probe_name").agg(F.min(F.struct((F.col("s") - F.col("e")).alias("k"), "reference_id")).alias("b")).select("probe_name", F.col("b.reference_id").alias("reference_id"))
    winners = spans.join(best, ["probe_name", "reference_id"], "left_semi").select("reference_id", "s", "e")
    side = lambda seg, name: seg.groupBy("reference_id").agg((F.sum(F.when(F.col("depth") > 0, F.col("seg_end") - F.col("seg_start")).otherwise(0)) / F.sum(F.col("seg_end") - F.col("seg_start")) * 100).alias(name))
    combined = D.depth_segments(winners, references(spark, d))
    return side(probe_segments(spark, d), "individual_pct").join(side(combined, "combined_pct"), "reference_id")


def r3_capture_fragments(spark, d):
    weights = weighted_refs(spark, d).where("weight > 0").select("reference_id", F.col("weight").alias("score"), "ref_length")
    pool = R.split_pools(draws(spark, d), "draw_id", 0.8).where("pool = 'capture'").select("draw_id")
    return R.capture_fragments(pool, probe_spans(spark, d).withColumnRenamed("probe_name", "probe_id").join(weights, "reference_id"), SEED, 300, 100, 600)


def r4_background_fragments(spark, d):
    pool = R.split_pools(draws(spark, d), "draw_id", 0.8).where("pool = 'background'").select("draw_id")
    return R.background_fragments(pool, weighted_refs(spark, d), SEED, 300, 100, 600)


def r5_pool_sizes(spark, d):
    return R.split_pools(draws(spark, d), "draw_id", 0.8).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


def r6_resampled_reads(spark, d):
    return R.resample(draws(spark, d), reads(spark, d).withColumnRenamed("aln_id", "read_id"), "read_id", SEED).select("draw_id", "read_id")


def g2_greedy_cover(spark, d):
    return G.greedy_cover(probe_spans(spark, d).withColumnRenamed("probe_name", "probe_id"), references(spark, d))


def g3_gap_baits(spark, d):
    return G.gap_baits(probe_spans(spark, d), references(spark, d), 120)


def g5_collapse_identical(spark, d):
    return G.collapse_identical(reads(spark, d), "aln_id", "seq")


def a23_percentile_coverage(spark, d):
    return G.percentile_coverage(D.probe_coverage_stats(probe_segments(spark, d)).select("pct_covered_1x"), "pct_covered_1x", 60)


def a24_median_probe_length(spark, d):
    return hits(spark, d).select("probe_id", "probe_length").distinct().agg(F.coalesce(F.floor(F.median("probe_length")), F.lit(120)).cast("long").alias("median_length"))


def a28_refine_summary(spark, d):
    stats = D.probe_coverage_stats(probe_segments(spark, d))
    below = stats.agg(F.count(F.lit(1)).alias("num_targets"), F.count(F.when(F.col("pct_covered_1x") < 50, 1)).alias("num_below_threshold"))
    return below.withColumn("pct_covered", F.when(F.col("num_targets") > 0, (F.col("num_targets") - F.col("num_below_threshold")) / F.col("num_targets") * 100).otherwise(F.lit(100.0)))


def g9_temperature_sweep(spark, d):
    grid = reads(spark, d).select("seq", F.explode(F.array(*[F.lit(t) for t in (55.0, 60.0, 65.0, 70.0)])).alias("temp_c"))
    scored = grid.withColumn("log_score", F.ln(boltzmann_score(delta_g("seq", F.col("temp_c"), 0.05), F.col("temp_c"))))
    return scored.groupBy("temp_c").agg(F.count(F.lit(1)).alias("n_probes"), F.round(F.avg("log_score"), 6).alias("mean_log_score"))


PARAMETERS = ["ct", "hybridization_temperature", "capture_fraction", "num_sequences"]


def g9_sweep_by_parameters(spark, d):
    rows = table(spark, d, "sweep_summary").dropDuplicates(["row_id"])
    return rows.groupBy(*PARAMETERS).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("avg_depth"), 6).alias("mean_depth"), F.round(F.avg("pct_covered_5x"), 6).alias("mean_covered_5x"), F.sum("reads_mapped").alias("reads_mapped"))


def v1_flow_links(spark, d):
    counts = N.category_counts(alns(spark, d).select("qname").dropna().distinct(), refs(spark, d))
    mapped = N.category_counts(N.read_mappings(alns(spark, d)), refs(spark, d))
    step = lambda df, a, b: df.select(F.lit(a).alias("step"), F.col("category").alias("source"), F.lit(b).alias("target"), "n")
    return step(counts, "sequenced", "reads").unionByName(step(mapped, "mapped", "mapped reads"))


def v2_metric_bars(spark, d):
    return a8_confusion_metrics(spark, d).unpivot([], ["sensitivity", "specificity", "precision", "f1_score"], "metric", "value")


def v2_metric_bars_all(spark, d):
    """v2_metric_bars by its earlier name."""
    return v2_metric_bars(spark, d)


def v3_top_groups(spark, d):
    return N.group_detail(detected(spark, d), refs(spark, d)).orderBy(F.desc("total_reads"), "group_name", "category").limit(40).select("group_name", "category", "total_reads")


def v5_worst_targets(spark, d):
    return D.probe_coverage_stats(probe_segments(spark, d)).orderBy("pct_covered_1x", "reference_id").limit(20).select("reference_id", "pct_covered_1x", "num_gaps")


def v5_tiered_coverage(spark, d):
    return D.probe_coverage_stats(probe_segments(spark, d)).unpivot(["reference_id"], ["pct_covered_1x", "pct_covered_2x", "pct_covered_5x", "pct_covered_10x"], "tier", "pct")


def v6_pangenome_offsets(spark, d):
    r = table(spark, d, "ref_targets").select(F.lit(0).alias("k"), "ord", "rname", "ref_length")
    totals = running_totals(r, "k", "ord", "ref_length").select("ord", F.coalesce("prev_total", F.lit(0)).cast("long").alias("offset"))
    return r.join(totals, "ord").select(F.col("rname").alias("reference_id"), "offset")


def v7_coverage_gain(spark, d):
    side = lambda df, name: D.coverage_stats(df).select("reference_id", F.col("avg_coverage").alias(name))
    return side(read_segments(spark, d), "read_depth").join(side(probe_segments(spark, d), "probe_depth"), "reference_id").withColumn("gain", F.col("read_depth") - F.col("probe_depth"))


def v10_homology_matrix(spark, d):
    return hits(spark, d).where("homology_pct IS NOT NULL").groupBy("target_id", "probe_id").agg(F.max("homology_pct").alias("max_homology_pct"))


def v11_key_thresholds(spark, d):
    return D.threshold_coverage(read_segments(spark, d), (1, 5, 10, 20, 50, 100))


def v12_build_steps(spark, d):
    from tilewright.plans.sequence_queries import a22_fasta_stats

    return _dropped(a22_fasta_stats(spark, d))


def v12_build_chain(spark, d):
    """v12_build_steps of all steps of the build."""
    from tilewright.plans.sequence_queries import a22_build_chain

    return _dropped(a22_build_chain(spark, d))


def _dropped(steps):
    by_step = Window.orderBy("step_no")  # a row for each step
    before = F.lag("sequences").over(by_step)
    return steps.select("step_no", "step", "sequences", (before - F.col("sequences")).alias("dropped"), F.when(before > 0, F.col("sequences") / before * 100).alias("pct_kept"))


def k6_detected_list(spark, d):
    return detected(spark, d).orderBy("reads", "reference_id")


def k9_results_json(spark, d):
    return a8_confusion_metrics(spark, d).select(F.to_json(F.struct(F.struct("tp_count", "fn_count", "fp_total", "tn_total").alias("counts"))).alias("document"))


def k9_results_json_all(spark, d):
    """k9_results_json by its earlier name."""
    return k9_results_json(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        *(r1_target_weights, r2_hit_scores, r2_simple_hit_scores, f25_sweep_labels, d12_individual_coverage, r3_capture_fragments, r4_background_fragments, r5_pool_sizes, r6_resampled_reads, g2_greedy_cover, g3_gap_baits, g5_collapse_identical, a23_percentile_coverage, a24_median_probe_length, a28_refine_summary),
        *(g9_temperature_sweep, g9_sweep_by_parameters, v1_flow_links, v2_metric_bars, v3_top_groups, v5_worst_targets, v5_tiered_coverage, v6_pangenome_offsets, v7_coverage_gain, v10_homology_matrix, v11_key_thresholds, v12_build_steps),
        *(k6_detected_list, k9_results_json, v2_metric_bars_all, k9_results_json_all, v12_build_chain),
    )
}


def _uniform(key: str, stream: int) -> str:
    return f"CAST('0x' || substr(md5('{SEED}|{stream}|' || {key}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


def _oracle() -> dict[str, str]:
    from tilewright.plans.depth_queries import ORACLE as depth
    from tilewright.plans.depth_queries import _PROBES, _REFS, _blocks, _segments, sql_primary
    from tilewright.plans.panel_queries import _MAP, _SRC
    from tilewright.plans.panel_queries import ORACLE as panel
    from tilewright.plans.sequence_queries import _DG, PAIRED
    from tilewright.plans.sequence_queries import ORACLE as sequence

    stats, confusion, steps = depth["a14_probe_coverage_stats"], panel["a8_confusion_metrics"], sequence["a22_fasta_stats"]
    both = f"WITH {_REFS}, {_PROBES}, {_segments('pseg', 'spans')}, {_blocks(sql_primary())}, {_segments('seg', 'blocks')}"
    avg = "sum(depth * (seg_end - seg_start)) / CAST(sum(seg_end - seg_start) AS DOUBLE)"
    thresholds = ", ".join(f"sum(CASE WHEN depth >= {t} THEN seg_end - seg_start ELSE 0 END) / CAST(sum(seg_end - seg_start) AS DOUBLE) * 100 AS pct_{t}x" for t in (1, 5, 10, 20, 50, 100))
    flow = lambda name, target, source: f"SELECT '{name}' AS step, coalesce(category, 'unknown') AS source, '{target}' AS target, count(*) AS n FROM {source} LEFT JOIN ref_targets ON rname = {_SRC} WHERE {_SRC} IS NOT NULL GROUP BY ALL"
    _WT = "w AS (SELECT rname, CASE category WHEN 'sample' THEN 1.0::DOUBLE WHEN 'distractor' THEN 0.5::DOUBLE * s / (n * 0.5::DOUBLE) ELSE 0.0::DOUBLE END AS weight FROM ref_targets, (SELECT count(*) FILTER (category = 'sample') AS s, count(*) FILTER (category = 'distractor') AS n FROM ref_targets) WHERE category IN ('sample', 'nonsample_target', 'distractor'))"
    _LEN = "CAST(list_sum(list_transform(list_zip(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1), regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2)), lambda x: CASE WHEN x[2] IN ('M', 'D', 'N', '=', 'X') THEN CAST(x[1] AS BIGINT) ELSE 0 END)) AS BIGINT)"
    pct = "sum(CASE WHEN depth > 0 THEN seg_end - seg_start ELSE 0 END) / CAST(sum(seg_end - seg_start) AS DOUBLE) * 100"
    bars = lambda sql: f"UNPIVOT (SELECT sensitivity, specificity, precision, f1_score FROM ({sql})) ON sensitivity, specificity, precision, f1_score INTO NAME metric VALUE value"
    document = lambda sql: f"""SELECT '{{"counts":{{"tp_count":' || tp_count || ',"fn_count":' || fn_count || ',"fp_total":' || fp_total || ',"tn_total":' || tn_total || '}}}}' AS document FROM ({sql})"""
    n_unit = "CAST(greatest(round(1.0::DOUBLE / n * 17592186044416), 1) AS BIGINT)"
    return {
        "f25_sweep_labels": "SELECT ct, hybridization_temperature, capture_fraction, num_sequences, concat_ws('_', " + ", ".join(rf"'{name}=' || regexp_replace(regexp_replace(printf('%.6f', CAST({c} AS DOUBLE)), '(\.[0-9]*?)0+$', '\1'), '\.$', '')" for name, c in (("ct", "ct"), ("temp", "hybridization_temperature"), ("cf", "capture_fraction"), ("n", "num_sequences"))) + ") AS label FROM (SELECT DISTINCT ct, hybridization_temperature, capture_fraction, num_sequences FROM sweep_summary)",
        "r2_hit_scores": f"WITH {_WT}, a AS (SELECT DISTINCT ON (aln_id) * FROM sam_alignments WHERE rname <> '*' AND cigar <> '*' AND pos IS NOT NULL AND seq <> '*'), b AS (SELECT a.qname, a.rname, a.pos, a.cigar, weight, q.paired AS seq FROM a JOIN {PAIRED} q USING (aln_id) JOIN w USING (rname) WHERE weight > 0) SELECT qname AS probe_id, rname AS reference_id, greatest(pos - 1, 0) AS s, greatest(pos - 1, 0) + {_LEN} AS e, round(ln(weight * greatest(1.0::DOUBLE, exp(-{_DG} / ({GAS}::DOUBLE * (65.0::DOUBLE + 273.15::DOUBLE))))), 6) AS log_score FROM b",
        "r6_resampled_reads": f"WITH d AS (SELECT DISTINCT aln_id AS draw_id FROM sam_alignments WHERE aln_id IS NOT NULL), r AS (SELECT aln_id AS read_id, row_number() OVER (ORDER BY aln_id) - 1 AS k, count(*) OVER () AS n FROM {_R}), u AS (SELECT draw_id, CAST(floor({_uniform('draw_id', 20)} * (SELECT max(n * {n_unit}) FROM r)) AS BIGINT) // (SELECT max({n_unit}) FROM r) AS k FROM d) SELECT draw_id, read_id FROM u JOIN r USING (k)",
        "v2_metric_bars_all": bars(panel["a8_confusion_all"]),
        "k9_results_json_all": document(panel["a8_confusion_all"]),
        "r2_simple_hit_scores": f"WITH {_WT}, a AS (SELECT DISTINCT ON (aln_id) * FROM sam_alignments WHERE rname <> '*' AND cigar <> '*' AND pos IS NOT NULL) SELECT qname AS probe_id, rname AS reference_id, greatest(pos - 1, 0) AS s, greatest(pos - 1, 0) + {_LEN} AS e, round(weight, 9) AS score FROM a JOIN w USING (rname) WHERE weight > 0",
        "d12_individual_coverage": f"WITH {_REFS}, {_PROBES}, best AS (SELECT probe_name, reference_id FROM spans QUALIFY row_number() OVER (PARTITION BY probe_name ORDER BY s - e, reference_id) = 1), win AS (SELECT reference_id, s, e FROM spans JOIN best USING (probe_name, reference_id)), {_segments('seg', 'spans')}, {_segments('wseg', 'win')}, a AS (SELECT reference_id, {pct} AS individual_pct FROM seg GROUP BY ALL), b AS (SELECT reference_id, {pct} AS combined_pct FROM wseg GROUP BY ALL) SELECT * FROM a JOIN b USING (reference_id)",
        "r1_target_weights": "WITH c AS (SELECT count(*) FILTER (category = 'sample') AS s, count(*) FILTER (category = 'distractor') AS n FROM ref_targets) SELECT rname AS reference_id, round(CASE category WHEN 'sample' THEN 1.0::DOUBLE WHEN 'distractor' THEN 0.5::DOUBLE * s / (n * 0.5::DOUBLE) ELSE 0.0::DOUBLE END, 9) AS weight FROM ref_targets, c WHERE category IN ('sample', 'nonsample_target', 'distractor')",
        "r5_pool_sizes": "WITH n AS (SELECT count(DISTINCT aln_id) AS n FROM sam_alignments) SELECT 'capture' AS pool, CAST(floor(n * 0.8::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS n FROM n UNION ALL SELECT 'background', n - CAST(floor(n * 0.8::DOUBLE + 0.5::DOUBLE) AS BIGINT) FROM n",
        "g3_gap_baits": f"{_SPANS}, b AS (SELECT reference_id, len, unnest(generate_series(seg_start, seg_end - 1, 120)) AS bait FROM seg JOIN refs USING (reference_id) WHERE depth = 0) SELECT reference_id, bait, greatest(least(bait, len - 120), 0) AS start, least(greatest(least(bait, len - 120), 0) + 120, len) AS \"end\" FROM b",
        "g5_collapse_identical": f"SELECT min(aln_id) AS aln_id, upper(seq) AS seq, count(*) AS copies FROM {_R} GROUP BY upper(seq)",
        "a23_percentile_coverage": f"WITH s AS ({stats}), r AS (SELECT pct_covered_1x, row_number() OVER (ORDER BY pct_covered_1x) - 1 AS k, count(*) OVER () AS n FROM s) SELECT pct_covered_1x FROM r WHERE k = least(CAST(floor(n * 60 / 100.0) AS BIGINT), n - 1)",
        "a24_median_probe_length": "SELECT CAST(coalesce(floor(median(probe_length)), 120) AS BIGINT) AS median_length FROM (SELECT DISTINCT probe_id, probe_length FROM xreact_hits)",
        "a28_refine_summary": f"WITH s AS ({stats}), c AS (SELECT count(*) AS num_targets, count(*) FILTER (pct_covered_1x < 50) AS num_below_threshold FROM s) SELECT *, CASE WHEN num_targets > 0 THEN (num_targets - num_below_threshold) / CAST(num_targets AS DOUBLE) * 100 ELSE 100.0 END AS pct_covered FROM c",
        "g9_temperature_sweep": f"WITH g AS (SELECT seq, unnest([55.0::DOUBLE, 60.0::DOUBLE, 65.0::DOUBLE, 70.0::DOUBLE]) AS temp_c FROM {_R}) SELECT temp_c, count(*) AS n_probes, round(avg(ln(greatest(1.0::DOUBLE, exp(-{_DG.replace('65.0::DOUBLE', 'temp_c')} / (1.98720425864e-3::DOUBLE * (temp_c + 273.15::DOUBLE)))))), 6) AS mean_log_score FROM g GROUP BY temp_c",
        "g9_sweep_by_parameters": "SELECT ct, hybridization_temperature, capture_fraction, num_sequences, count(*) AS n_rows, round(avg(avg_depth), 6) AS mean_depth, round(avg(pct_covered_5x), 6) AS mean_covered_5x, CAST(sum(reads_mapped) AS BIGINT) AS reads_mapped FROM (SELECT DISTINCT ON (row_id) * FROM sweep_summary) GROUP BY ALL",
        "v1_flow_links": f"WITH {_MAP} {flow('sequenced', 'reads', '(SELECT DISTINCT qname FROM sam_alignments WHERE qname IS NOT NULL)')} UNION ALL {flow('mapped', 'mapped reads', 'map')}",
        "v2_metric_bars": f"UNPIVOT (SELECT sensitivity, specificity, precision, f1_score FROM ({confusion})) ON sensitivity, specificity, precision, f1_score INTO NAME metric VALUE value",
        "v3_top_groups": f"WITH {_DET}, {_KNOWN}, {_groups('det')} SELECT group_name, category, total_reads FROM gd ORDER BY total_reads DESC, group_name, category LIMIT 40",
        "v5_worst_targets": f"SELECT reference_id, pct_covered_1x, num_gaps FROM ({stats}) ORDER BY pct_covered_1x, reference_id LIMIT 20",
        "v5_tiered_coverage": f"UNPIVOT (SELECT reference_id, pct_covered_1x, pct_covered_2x, pct_covered_5x, pct_covered_10x FROM ({stats})) ON pct_covered_1x, pct_covered_2x, pct_covered_5x, pct_covered_10x INTO NAME tier VALUE pct",
        "v6_pangenome_offsets": "SELECT rname AS reference_id, CAST(coalesce(sum(ref_length) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM ref_targets",
        "v7_coverage_gain": f"{both}, a AS (SELECT reference_id, {avg} AS x FROM seg GROUP BY ALL), b AS (SELECT reference_id, {avg} AS y FROM pseg GROUP BY ALL) SELECT reference_id, x AS read_depth, y AS probe_depth, x - y AS gain FROM a JOIN b USING (reference_id)",
        "v10_homology_matrix": "SELECT target_id, probe_id, max(homology_pct) AS max_homology_pct FROM xreact_hits WHERE homology_pct IS NOT NULL GROUP BY ALL",
        "v11_key_thresholds": f"{_READS} SELECT reference_id, {thresholds} FROM seg GROUP BY reference_id",
        "v12_build_steps": f"WITH s AS ({steps}) SELECT step_no, step, sequences, lag(sequences) OVER (ORDER BY step_no) - sequences AS dropped, sequences / CAST(nullif(lag(sequences) OVER (ORDER BY step_no), 0) AS DOUBLE) * 100 AS pct_kept FROM s",
        "k6_detected_list": f"WITH {_DET} SELECT * FROM det",
        "k9_results_json": f"""SELECT '{{"counts":{{"tp_count":' || tp_count || ',"fn_count":' || fn_count || ',"fp_total":' || fp_total || ',"tn_total":' || tn_total || '}}}}' AS document FROM ({confusion})""",
    }


ORACLE = _oracle()

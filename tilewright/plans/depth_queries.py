"""Queries on depth, coverage and gaps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions.alignment import aligned_blocks, cigar_ref_length
from tilewright.operators import depth as D
from tilewright.tables import table


def references(spark, d):
    return table(spark, d, "ref_targets").select(F.col("rname").alias("reference_id"), "ref_length")


def read_segments(spark, d):
    return D.depth_segments(D.alignment_blocks(D.mapped(table(spark, d, "sam_alignments"))), references(spark, d))


def probe_spans(spark, d):
    """(reference_id, probe_name, s, e): placed spans, each once."""
    spans = table(spark, d, "probe_alns").where((F.col("target") != "*") & (F.col("ref_start") < F.col("ref_end")))
    return spans.select(F.col("target").alias("reference_id"), "probe_name", F.greatest("ref_start", F.lit(0)).alias("s"), F.col("ref_end").alias("e")).distinct()


def probe_segments(spark, d):
    return D.depth_segments(probe_spans(spark, d).select("reference_id", "s", "e"), references(spark, d))


def f15_cigar_ref_length(spark, d):
    return table(spark, d, "sam_alignments").where("cigar <> '*'").select("aln_id", cigar_ref_length("cigar").alias("ref_len"), F.size(aligned_blocks(F.lit(0), "cigar")).cast("long").alias("n_blocks")).distinct()


def d1_read_depth(spark, d):
    return read_segments(spark, d)


def d2_probe_depth(spark, d):
    return probe_segments(spark, d)


def d2_alignment_depth_with_secondary(spark, d):
    return D.depth_segments(D.alignment_blocks(D.mapped(table(spark, d, "sam_alignments"), secondary=True)), references(spark, d))


def a13_coverage_stats(spark, d):
    return D.coverage_stats(read_segments(spark, d))


def a14_probe_coverage_stats(spark, d):
    return D.probe_coverage_stats(probe_segments(spark, d), proximity=100)


def d4_gaps(spark, d):
    return D.gap_regions(probe_segments(spark, d), min_length=50)


def d5_near_covered(spark, d):
    return D.near_covered(read_segments(spark, d), 150)


def a25_depth_curves(spark, d):
    return D.depth_curves(read_segments(spark, d))


def a26_depth_histogram(spark, d):
    return D.depth_histogram(read_segments(spark, d))


def d6_low_coverage_regions(spark, d):
    return D.low_coverage_regions(probe_segments(spark, d), min_depth=2, probe_length=120)


def d13_binned_depth(spark, d):
    return D.binned_depth(read_segments(spark, d), points=50)


def j13_contributing_probes(spark, d):
    met = D.overlap_join(probe_spans(spark, d), D.covered_periods(read_segments(spark, d)))
    return met.select("reference_id", "probe_name").distinct().groupBy("reference_id").agg(F.count("probe_name").alias("probes_contributing"))


def j16_gap_types(spark, d):
    gaps = D.gap_regions(probe_segments(spark, d), min_length=50).select("reference_id", F.col("gap_start").alias("s"), F.col("gap_end").alias("e"))
    typed = D.covered_fraction(gaps, read_segments(spark, d))
    return typed.select("reference_id", F.col("s").alias("gap_start"), F.col("e").alias("gap_end"), F.round("covered_fraction", 9).alias("covered_fraction"), F.when(F.col("covered_fraction") == 0, "true_gap").otherwise("multimapper_gap").alias("gap_type"))


def k10_coverage_intervals(spark, d):
    return read_segments(spark, d).select("reference_id", (F.col("seg_start") + 1).alias("start"), F.col("seg_end").alias("end"), "depth")


QUERIES = {f.__name__: f for f in (f15_cigar_ref_length, d1_read_depth, d2_probe_depth, d2_alignment_depth_with_secondary, a13_coverage_stats, a14_probe_coverage_stats, d4_gaps, d5_near_covered, a25_depth_curves, a26_depth_histogram, d6_low_coverage_regions, d13_binned_depth, j13_contributing_probes, j16_gap_types, k10_coverage_intervals)}

_RE = "'([0-9]+)([MIDNSHP=X])'"


def sql_primary(dropped: int = 2304) -> str:
    return f"SELECT DISTINCT ON (aln_id) * FROM sam_alignments WHERE rname <> '*' AND (coalesce(flag, 0) & {dropped}) = 0 AND aln_id IS NOT NULL"


def _blocks(rows: str) -> str:
    return f"""ops AS (SELECT aln_id, rname, greatest(pos - 1, 0) AS start, unnest(regexp_extract_all(cigar, {_RE}, 1)) AS n, unnest(regexp_extract_all(cigar, {_RE}, 2)) AS op,
    generate_subscripts(regexp_extract_all(cigar, {_RE}, 1), 1) AS i FROM ({rows}) WHERE cigar <> '*' AND pos IS NOT NULL),
walk AS (SELECT *, CAST(n AS BIGINT) AS len, coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN CAST(n AS BIGINT) ELSE 0 END) OVER (PARTITION BY aln_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ops),
blocks AS (SELECT rname AS reference_id, CAST(start + off AS BIGINT) AS s, CAST(start + off + len AS BIGINT) AS e FROM walk WHERE op IN ('M', '=', 'X'))"""


_PROBES = "spans AS (SELECT DISTINCT target AS reference_id, probe_name, greatest(ref_start, 0) AS s, ref_end AS e FROM probe_alns WHERE target <> '*' AND ref_start < ref_end)"
_REFS = "refs AS (SELECT rname AS reference_id, ref_length AS len FROM ref_targets WHERE ref_length > 0)"


def _segments(name: str, source: str) -> str:
    return f"""{name}_ev AS (SELECT reference_id, least(s, len) AS pt, 1 AS d FROM {source} JOIN refs USING (reference_id) UNION ALL SELECT reference_id, least(e, len), -1 FROM {source} JOIN refs USING (reference_id)
    UNION ALL SELECT reference_id, 0, 0 FROM refs UNION ALL SELECT reference_id, len, 0 FROM refs),
{name}_sum AS (SELECT reference_id, pt, sum(d) AS d FROM {name}_ev GROUP BY ALL),
{name}_run AS (SELECT reference_id, lag(pt) OVER w AS seg_start, pt AS seg_end, CAST(sum(d) OVER w - d AS BIGINT) AS depth FROM {name}_sum JOIN refs USING (reference_id) WHERE d <> 0 OR pt = 0 OR pt = len WINDOW w AS (PARTITION BY reference_id ORDER BY pt ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT * FROM {name}_run WHERE seg_start IS NOT NULL)"""


_READS = f"WITH {_REFS}, {_blocks(sql_primary())}, {_segments('seg', 'blocks')}"
_SPANS = f"WITH {_REFS}, {_PROBES}, {_segments('seg', 'spans')}"
_BOTH = f"WITH {_REFS}, {_PROBES}, {_segments('pseg', 'spans')}, {_blocks(sql_primary())}, {_segments('seg', 'blocks')}"


def _merge(source: str, touch: str) -> str:
    """Periods of source (reference_id, s, e)."""
    return f"""(SELECT reference_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY reference_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM (
    SELECT *, CASE WHEN s {touch} coalesce(max(e) OVER (PARTITION BY reference_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM {source})) GROUP BY reference_id, k)"""


def _near(proximity: int) -> str:
    return f"(SELECT reference_id, CAST(sum(e - s) AS BIGINT) AS near_bases FROM {_merge(f'(SELECT reference_id, greatest(seg_start - {proximity}, 0) AS s, least(seg_end + {proximity}, len) AS e FROM seg JOIN refs USING (reference_id) WHERE depth > 0)', '>')} GROUP BY reference_id)"


_ALL = "SELECT reference_id, seg_start, seg_end, depth FROM seg"
_N = "(seg_end - seg_start)"


def _share(cond: str) -> str:
    return f"sum(CASE WHEN {cond} THEN {_N} ELSE 0 END) / CAST(sum({_N}) AS DOUBLE) * 100"


ORACLE = {
    "f15_cigar_ref_length": f"""SELECT DISTINCT aln_id, CAST(list_sum(list_transform(list_zip(regexp_extract_all(cigar, {_RE}, 1), regexp_extract_all(cigar, {_RE}, 2)), lambda x: CASE WHEN x[2] IN ('M', 'D', 'N', '=', 'X') THEN CAST(x[1] AS BIGINT) ELSE 0 END)) AS BIGINT) AS ref_len,
    len(list_filter(regexp_extract_all(cigar, {_RE}, 2), lambda o: o IN ('M', '=', 'X'))) AS n_blocks FROM sam_alignments WHERE cigar <> '*'""",
    "d1_read_depth": f"{_READS} {_ALL}",
    "d2_probe_depth": f"{_SPANS} {_ALL}",
    "d2_alignment_depth_with_secondary": f"WITH {_REFS}, {_blocks(sql_primary(2048))}, {_segments('seg', 'blocks')} {_ALL}",
    "a13_coverage_stats": f"{_READS} SELECT reference_id, CAST(sum({_N}) AS BIGINT) AS ref_length, sum(depth * {_N}) / CAST(sum({_N}) AS DOUBLE) AS avg_coverage, {_share('depth >= 5')} AS pct_covered_5x, {_share('depth >= 20')} AS pct_covered_20x FROM seg GROUP BY reference_id",
    "a14_probe_coverage_stats": f"""{_SPANS}, hist AS (SELECT reference_id, depth, sum({_N}) AS n FROM seg GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY reference_id ORDER BY depth) AS upto, sum(n) OVER (PARTITION BY reference_id) AS len FROM hist),
med AS (SELECT reference_id, (min(CASE WHEN upto > (len - 1) // 2 THEN depth END) + min(CASE WHEN upto > len // 2 THEN depth END)) / 2.0::DOUBLE AS median_depth FROM cum GROUP BY reference_id)
SELECT reference_id, CAST(sum({_N}) AS BIGINT) AS ref_length, CAST(sum(CASE WHEN depth >= 1 THEN {_N} ELSE 0 END) AS BIGINT) AS covered_bases, {_share('depth >= 1')} AS pct_covered_1x, sum(depth * {_N}) / CAST(sum({_N}) AS DOUBLE) AS mean_depth, any_value(median_depth) AS median_depth,
    {_share('depth >= 2')} AS pct_covered_2x, {_share('depth >= 5')} AS pct_covered_5x, {_share('depth >= 10')} AS pct_covered_10x, coalesce(max(CASE WHEN depth = 0 THEN {_N} END), 0) AS max_gap_length, count(*) FILTER (depth = 0) AS num_gaps, coalesce(any_value(near_bases), 0) / CAST(sum({_N}) AS DOUBLE) * 100 AS pct_near_probe
FROM seg JOIN med USING (reference_id) LEFT JOIN {_near(100)} USING (reference_id) GROUP BY reference_id""",
    "d4_gaps": f"{_SPANS} SELECT reference_id, seg_start AS gap_start, seg_end AS gap_end, {_N} AS gap_length, (seg_start = 0 OR seg_end = len) AS is_terminal FROM seg JOIN refs USING (reference_id) WHERE depth = 0 AND {_N} >= 50",
    "d5_near_covered": f"{_READS} SELECT reference_id, near_bases FROM {_near(150)}",
    "a25_depth_curves": f"""{_READS}, h AS (SELECT reference_id, depth, sum({_N}) AS n FROM seg GROUP BY ALL), m AS (SELECT reference_id, max(depth) AS deepest, sum(n) AS len FROM h GROUP BY ALL),
t AS (SELECT reference_id, len, deepest, unnest(generate_series(1, greatest(deepest, 1))) AS depth_threshold FROM m),
c AS (SELECT *, sum(n) OVER (PARTITION BY reference_id ORDER BY depth DESC) AS cum FROM h)
SELECT t.reference_id, t.depth_threshold, CASE WHEN deepest = 0 THEN 0.0::DOUBLE ELSE (SELECT max(cum) FROM c WHERE c.reference_id = t.reference_id AND c.depth >= t.depth_threshold) / CAST(len AS DOUBLE) * 100 END AS pct_covered FROM t""",
    "a26_depth_histogram": f"{_READS} SELECT reference_id, depth, CAST(sum({_N}) AS BIGINT) AS bases FROM seg GROUP BY ALL",
    "d6_low_coverage_regions": f"""{_SPANS}, low AS (SELECT * FROM {_merge("(SELECT reference_id, seg_start AS s, seg_end AS e FROM seg WHERE depth < 2)", ">")} JOIN refs USING (reference_id)),
w AS (SELECT *, greatest((s + e) // 2 - 60, 0) AS a FROM low), x AS (SELECT *, least(a + 120, len) AS b FROM w),
y AS (SELECT reference_id, CASE WHEN e - s >= 120 THEN s WHEN b = len AND len >= 120 THEN len - 120 ELSE a END AS s, CASE WHEN e - s >= 120 THEN e ELSE b END AS e FROM x)
SELECT reference_id, s AS region_start, e AS region_end FROM {_merge("y", ">=")}""",
    "d13_binned_depth": f"""{_READS}, w AS (SELECT *, greatest(CAST(ceil(len / 50.0) AS BIGINT), 1) AS w FROM seg JOIN refs USING (reference_id)),
b AS (SELECT *, unnest(generate_series(seg_start // w, (seg_end - 1) // w)) AS bin FROM w),
o AS (SELECT *, least(seg_end, (bin + 1) * w) - greatest(seg_start, bin * w) AS ov FROM b)
SELECT reference_id, bin, min(bin * w) AS bin_start, max(least((bin + 1) * w, len)) AS bin_end, sum(depth * ov) / CAST(sum(ov) AS DOUBLE) AS mean_depth FROM o GROUP BY reference_id, bin""",
    "j13_contributing_probes": f"{_BOTH} SELECT reference_id, count(DISTINCT probe_name) AS probes_contributing FROM spans p WHERE EXISTS (SELECT 1 FROM seg s WHERE s.reference_id = p.reference_id AND s.depth > 0 AND p.s < s.seg_end AND s.seg_start < p.e) GROUP BY reference_id",
    "j16_gap_types": f"""{_BOTH}, g AS (SELECT reference_id, seg_start AS a, seg_end AS b FROM pseg WHERE depth = 0 AND seg_end - seg_start >= 50),
o AS (SELECT g.reference_id, a, b, sum(least(b, seg_end) - greatest(a, seg_start)) AS bases FROM g JOIN seg ON seg.reference_id = g.reference_id AND depth > 0 AND a < seg_end AND seg_start < b GROUP BY ALL)
SELECT reference_id, a AS gap_start, b AS gap_end, round(coalesce(bases, 0) / CAST(b - a AS DOUBLE), 9) AS covered_fraction, CASE WHEN bases IS NULL THEN 'true_gap' ELSE 'multimapper_gap' END AS gap_type FROM g LEFT JOIN o USING (reference_id, a, b)""",
    "k10_coverage_intervals": f'{_READS} SELECT reference_id, seg_start + 1 AS start, seg_end AS "end", depth FROM seg',
}

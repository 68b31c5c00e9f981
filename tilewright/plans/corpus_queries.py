"""Queries of the numbered problems that belong to the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators.islands import islands_and_gaps
from tilewright.operators.rejects import BLAST, MOST, PAF, parse_hit_lines, rejects, valid_records
from tilewright.operators.skew import heavy_keys, range_split_aggregate
from tilewright.scratch import materialize
from tilewright.tables import table


def counted_alignments(spark, d):
    flag = F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(F.lit(0x100 | 0x800))
    return table(spark, d, "sam_alignments").where((F.col("rname") != "*") & ~F.col("cigar").eqNullSafe("*") & (flag == 0))


def p1_reads_per_ref(spark, d):
    aggs = {"n_reads": F.count(F.lit(1)), "first_pos": F.min("pos"), "last_pos": F.max("pos")}
    return range_split_aggregate(counted_alignments(spark, d), ["rname"], ["aln_id"], aggs, unique=True).withColumnRenamed("rname", "reference_id")


def p1_sweep_per_ref(spark, d):
    aggs = {"n_rows": F.count(F.lit(1)), "reads_mapped": F.sum("reads_mapped"), "mean_depth": F.round(F.avg("avg_depth"), 6), "max_depth": F.max("avg_depth"), "min_covered_20x": F.min("pct_covered_20x"), "last_computed_at": F.max("computed_at")}
    return range_split_aggregate(table(spark, d, "sweep_summary"), ["reference_id"], ["row_id"], aggs, unique=True)


def p1_found(spark, d):
    parts = []
    for name, rows, key, order in (("sam_alignments", counted_alignments(spark, d), "rname", "aln_id"), ("sweep_summary", table(spark, d, "sweep_summary"), "reference_id", "row_id")):
        counts = materialize(range_split_aggregate(rows, [key], [order], {"n": F.count(F.lit(1))}, unique=True), "counts")
        parts.append(heavy_keys(counts, key, "n", 50).select(F.lit(name).alias("table_name"), F.col(key).alias("reference_id")))
    return parts[0].unionByName(parts[1])


def p3_found(spark, d):
    alns = table(spark, d, "probe_alns").where(F.col("target") != "*")
    return islands_and_gaps(alns, "target", "ref_start", "ref_end")


def p4_found(spark, d):
    return rejects(parse_hit_lines(table(spark, d, "raw_hit_lines")))


def p4_paf_records(spark, d):
    return valid_records(parse_hit_lines(table(spark, d, "raw_hit_lines")), "paf")


def p4_blast_records(spark, d):
    return valid_records(parse_hit_lines(table(spark, d, "raw_hit_lines")), "blast")


QUERIES = {f.__name__: f for f in (p1_found, p1_reads_per_ref, p1_sweep_per_ref, p3_found, p4_found, p4_paf_records, p4_blast_records)}

_ALNS = "SELECT DISTINCT ON (aln_id) aln_id, rname, pos FROM sam_alignments WHERE rname <> '*' AND cigar IS DISTINCT FROM '*' AND (coalesce(flag, 0) & 2304) = 0 AND aln_id IS NOT NULL"
_SWEEP = "SELECT DISTINCT ON (row_id) * FROM sweep_summary WHERE reference_id IS NOT NULL AND row_id IS NOT NULL"

_QUOTED, _BARE = '"(?:[^"]|"")*"', '[^"\\t][^\\t]*'


def _number(k: int) -> str:
    """Field k as a number, null if it is none or too large."""
    return f"CASE WHEN regexp_full_match(f[{k}], '0*[0-9]{{1,10}}') AND CAST(right(f[{k}], 10) AS BIGINT) <= {MOST} THEN CAST(right(f[{k}], 10) AS BIGINT) END"


def _parsed(line_format: str, columns: list[tuple[str, str]]) -> str:
    """The lines of one format: reason ('' for a valid one) and values. Fields are cut by a regular expression, each with the tab before it."""
    n = len(columns)
    cells = ", ".join(f"{_number(k)} AS {name}" if kind == "I" else f"f[{k}] AS {name}" for k, (name, kind) in enumerate(columns, 1))
    known = " AND ".join(f"{name} IS NOT NULL" if kind == "I" else f"{name} IN ('+', '-')" if kind == "S" else f"{name} <> ''" for name, kind in columns)
    if line_format == "paf":
        count = f"len(f) < {n} OR len(list_filter(f[{n + 1}:], lambda x: NOT regexp_matches(x, '^[A-Za-z][A-Za-z0-9]:[AifZHB]:'))) > 0"
        sane = "target_start <= target_end AND target_end <= target_length AND matching_bases <= block_length"
    else:
        count, sane = f"len(f) <> {n}", "query_start >= 1 AND matching_bases <= alignment_length"
    return f"""(SELECT *, CASE WHEN torn THEN 'broken_quote' WHEN miscounted THEN 'column_count' WHEN NOT coalesce({known} AND query_start <= query_end AND query_end <= query_length AND {sane}, false) THEN 'bad_value' ELSE '' END AS reason FROM (
  SELECT line_id, torn, {count} AS miscounted, {cells} FROM (
    SELECT line_id, NOT regexp_full_match(line, '({_QUOTED}|{_BARE}|)(\\t({_QUOTED}|{_BARE}|))*') AS torn,
      list_transform(regexp_extract_all(chr(9) || line, '\\t({_QUOTED}|{_BARE}|)', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, len(x) - 2), '""', '"') ELSE x END) AS f
    FROM (SELECT line_id, regexp_replace(raw_line, '\\r$', '') AS line FROM raw_hit_lines WHERE line_format = '{line_format}') WHERE line <> '' AND NOT starts_with(line, '#'))))"""


_PAF, _BLAST = _parsed("paf", PAF), _parsed("blast", BLAST)

ORACLE = {
    "p4_found": f"SELECT line_id, reason FROM {_PAF} WHERE reason <> '' UNION ALL SELECT line_id, reason FROM {_BLAST} WHERE reason <> '' UNION ALL SELECT line_id, 'unknown_format' FROM raw_hit_lines WHERE coalesce(line_format, '') NOT IN ('paf', 'blast') AND regexp_replace(raw_line, '\\r$', '') <> '' AND NOT starts_with(raw_line, '#')",
    "p4_paf_records": f"SELECT line_id, {', '.join(name for name, _ in PAF)} FROM {_PAF} WHERE reason = ''",
    "p4_blast_records": f"SELECT line_id, {', '.join(name for name, _ in BLAST)} FROM {_BLAST} WHERE reason = ''",
    "p1_reads_per_ref": f"SELECT rname AS reference_id, count(*) AS n_reads, min(pos) AS first_pos, max(pos) AS last_pos FROM ({_ALNS}) GROUP BY rname",
    "p1_sweep_per_ref": f"SELECT reference_id, count(*) AS n_rows, CAST(sum(reads_mapped) AS BIGINT) AS reads_mapped, round(avg(avg_depth), 6) AS mean_depth, max(avg_depth) AS max_depth, min(pct_covered_20x) AS min_covered_20x, max(computed_at) AS last_computed_at FROM ({_SWEEP}) GROUP BY reference_id",
    "p1_found": f"""
WITH a AS (SELECT rname AS k, count(*) AS n FROM ({_ALNS}) GROUP BY rname),
     s AS (SELECT reference_id AS k, count(*) AS n FROM ({_SWEEP}) GROUP BY reference_id)
SELECT 'sam_alignments' AS table_name, k AS reference_id FROM a WHERE n * 50 >= (SELECT sum(n) FROM a)
UNION ALL
SELECT 'sweep_summary' AS table_name, k AS reference_id FROM s WHERE n * 50 >= (SELECT sum(n) FROM s)""",
    "p3_found": """
WITH ok AS (SELECT target, ref_start AS s, ref_end AS e FROM probe_alns WHERE target <> '*' AND ref_start < ref_end),
     m AS (SELECT *, max(e) OVER (PARTITION BY target ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
     i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
     p AS (SELECT target, k, min(s) AS s, max(e) AS e FROM i GROUP BY target, k),
     g AS (SELECT target, e AS s, lead(s) OVER (PARTITION BY target ORDER BY s) AS e FROM p)
SELECT target, 'period' AS seg_kind, s AS seg_start, e AS seg_end FROM p
UNION ALL
SELECT target, 'gap' AS seg_kind, s AS seg_start, e AS seg_end FROM g WHERE e IS NOT NULL""",
}

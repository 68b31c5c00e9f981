"""SQL for DuckDB of the queries in queries.py that SQL can express."""

_RANKED = """SELECT probe_id, hit_mode, hit_id, homology_pct, target_id, row_number() OVER (PARTITION BY probe_id, hit_mode ORDER BY homology_pct DESC, target_id ASC NULLS LAST, hit_id) AS hit_rank
  FROM (SELECT DISTINCT ON (hit_id) * FROM xreact_hits WHERE homology_pct IS NOT NULL AND hit_id IS NOT NULL)"""

ORACLE = {
    "p2_found": r"""
WITH RECURSIVE ids AS (
  SELECT nullif(regexp_extract(regexp_replace(regexp_replace(target_a, '^[ \t]+', ''), '^>', ''), '^[^ \t]*'), '') AS a,
         nullif(regexp_extract(regexp_replace(regexp_replace(target_b, '^[ \t]+', ''), '^>', ''), '^[^ \t]*'), '') AS b
  FROM target_similarity WHERE identity_pct >= 90.0),
e AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM ids UNION ALL SELECT b, a FROM ids) WHERE a <> b),
r AS (SELECT a AS v, a AS lab FROM e UNION SELECT e.b, r.lab FROM r JOIN e ON r.v = e.a AND r.lab < e.b)
SELECT min(lab) AS group_id, v AS target_id FROM r GROUP BY v""",
    "p5_found": f"SELECT probe_id, hit_mode, hit_rank, hit_id FROM ({_RANKED}) WHERE hit_rank <= 5",
    "p5_best_hit": f"SELECT probe_id, hit_mode, homology_pct AS max_homology_pct, target_id AS best_hit FROM ({_RANKED}) WHERE hit_rank = 1",
}

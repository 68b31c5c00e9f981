"""Queries where genomes own targets, targets have several owners, and on gap details and results, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions.sdust import masked_fraction
from tilewright.operators import crossreact as X
from tilewright.operators import depth as D
from tilewright.operators import design as G
from tilewright.operators import detection as N
from tilewright.operators import similarity as Y
from tilewright.operators import tiling
from tilewright.operators.minhash import near_duplicates
from tilewright.operators.rejects import parse_hit_lines, valid_records
from tilewright.operators.running import global_rank
from tilewright.plans import corpus_queries, depth_queries, design_queries, panel_queries, sequence_queries
from tilewright.plans.panel_queries import alns, clean_id, detected, edges, owners, refs, similar_pairs
from tilewright.sources.alignments import unify_hits
from tilewright.tables import table

RUN, WHEN, SEED = "run", "2026-01-01T00:00:00", "42"


def genomes(spark, d):
    """Every reference as a genome."""
    return refs(spark, d).select(F.col("reference_id").alias("genome_id"), "category")


def _both_ways(pairs):
    ways = F.array(*[F.struct(F.col(a).alias("genome_id"), F.col(b).alias("target_id")) for a, b in (("target_a", "target_b"), ("target_b", "target_a"))])
    return pairs.select(F.explode(ways).alias("l")).select("l.*")


def links(spark, d):
    """(genome_id, target_id): each grouped target belongs to itself as a genome, and to those that it is much like."""
    own = refs(spark, d).where("group_name IS NOT NULL AND category IN ('sample', 'nonsample_target')").select(F.col("reference_id").alias("genome_id"), F.col("reference_id").alias("target_id"))
    return own.unionByName(_both_ways(similar_pairs(spark, d))).distinct()


def shared_owners(spark, d):
    """(target_id, species_id): the owner of each target, and those of targets that it is nearly the same as."""
    close = _both_ways(Y.target_identity(_similarity(spark, d), 97.0)).distinct()
    other = close.join(owners(spark, d).withColumnRenamed("target_id", "genome_id"), "genome_id").select("target_id", "species_id")
    return owners(spark, d).unionByName(other.join(owners(spark, d), "target_id", "left_semi")).distinct()


def _similarity(spark, d):
    return table(spark, d, "target_similarity").select(clean_id("target_a").alias("target_a"), clean_id("target_b").alias("target_b"), "matching_bases", "len_a", "len_b")


def j7_sample_targets(spark, d):
    return N.sample_targets(genomes(spark, d), links(spark, d))


def j8_accuracy_by_genome(spark, d):
    return N.accuracy_by_genome(N.read_mappings(alns(spark, d)), links(spark, d))


def j9_fragments_by_genome(spark, d):
    counted = panel_queries.a4_count_per_source(spark, d).withColumnRenamed("source_id", "reference_id")
    return N.fragments_by_genome(counted, links(spark, d), refs(spark, d).where("category IN ('sample', 'nonsample_target')"))


def a6_class_by_genome(spark, d):
    return N.classify_by_genome(alns(spark, d).select("qname").distinct(), genomes(spark, d), links(spark, d))


def j11_edges_of_shared_targets(spark, d):
    return Y.cross_species_edges(similar_pairs(spark, d), shared_owners(spark, d))


def a19_discriminability_shared(spark, d):
    return Y.discriminability(j11_edges_of_shared_targets(spark, d), shared_owners(spark, d))


def g7_calls_of_shared_targets(spark, d):
    return Y.call_species(j11_edges_of_shared_targets(spark, d), shared_owners(spark, d), panel_queries.detected_targets(spark, d))


def a17_hits_from_lines(spark, d):
    parsed = parse_hit_lines(table(spark, d, "raw_hit_lines"))
    return X.hits_from_records(unify_hits(valid_records(parsed, "paf"), valid_records(parsed, "blast")), "against", 50.0)


def _placed(spark, d):
    """(probe_id, reference_id, s, e, distance): places of reads on documents."""
    probes = sequence_queries.reads(spark, d).select(F.col("aln_id").alias("probe_id"), F.col("seq").alias("probe"))
    found = tiling.seed_matches(probes, _targets(spark, d), 14, 40)
    sized = found.join(probes.select("probe_id", F.length("probe").alias("size")), "probe_id")
    return sized.select("probe_id", F.col("target_id").alias("reference_id"), F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e"), "distance")


def _targets(spark, d):
    return sequence_queries.document_sequences(spark, d).select(F.col("doc_id").alias("target_id"), "seq")


def _lengths(spark, d):
    return _targets(spark, d).select(F.col("target_id").alias("reference_id"), F.length("seq").cast("long").alias("ref_length"))


def f29_covered_spans(spark, d):
    """What each place covers if it reaches 20 bases further on both sides."""
    near = _placed(spark, d).where("distance <= 20")
    return G.extended_hits(near, _lengths(spark, d), 20).select("probe_id", F.col("reference_id").alias("target_id"), F.col("s").alias("span_start"), F.col("e").alias("span_end"))


def d11_gap_details(spark, d):
    """Stretches of documents that no read covers, each read at its nearest place only, and whether a read of several places would cover them."""
    placed = _placed(spark, d)
    best = placed.groupBy("probe_id").agg(F.min(F.struct("distance", "reference_id", "s", "e")).alias("b")).select("b.reference_id", "b.s", "b.e")
    known = _lengths(spark, d)
    gaps = G.gap_details(D.depth_segments(best, known), _targets(spark, d), 50, D.depth_segments(placed.select("reference_id", "s", "e"), known))
    return gaps.withColumn("individual_coverage", F.round("individual_coverage", 9)).withColumn("gc_content", F.round("gc_content", 9))


def d11_gap_dust(spark, d):
    """The share of low-complexity bases of the same gaps."""
    placed = _placed(spark, d)
    best = placed.groupBy("probe_id").agg(F.min(F.struct("distance", "reference_id", "s", "e")).alias("b")).select("b.reference_id", "b.s", "b.e")
    gaps = G.gap_details(D.depth_segments(best, _lengths(spark, d)), _targets(spark, d), 50)
    return gaps.select("target_id", "gap_start", F.round(masked_fraction("gap_sequence"), 9).alias("dust_score"))


def g1_near_duplicate_reads(spark, d):
    """Every read with the kept one that it is a near copy of."""
    return near_duplicates(sequence_queries.reads(spark, d), "aln_id", "seq", 0.8)


def v8_gap_order(spark, d):
    typed = depth_queries.j16_gap_types(spark, d).select("reference_id", "gap_start", "gap_end", "gap_type", F.when(F.col("gap_type") == "true_gap", 0).otherwise(1).alias("k"), (F.col("gap_start") - F.col("gap_end")).alias("shorter"))
    return global_rank(typed, ["k", "shorter", "reference_id", "gap_start"], "gaps").select((F.col("rank") + 1).alias("place"), "reference_id", "gap_start", "gap_end", "gap_type")


def v13_refine_long(spark, d):
    s = design_queries.a28_refine_summary(spark, d).select((F.col("num_targets") - F.col("num_below_threshold")).alias("Covered"), F.col("num_below_threshold").alias("Below threshold"))
    return s.unpivot([], ["Covered", "Below threshold"], "category", "count")


def v14_target_composition(spark, d):
    scores = Y.discriminability(edges(spark, d), owners(spark, d)).select("species_id", F.col("shared_targets").alias("Shared"), F.col("unique_targets").alias("Unique"))
    return scores.unpivot(["species_id"], ["Shared", "Unique"], "type", "count")


def a27_ranked_centroids(spark, d):
    groups = G.collapse_identical(sequence_queries.reads(spark, d), "aln_id", "seq").select(F.col("aln_id").alias("probe_id"), F.col("copies").alias("size"))
    ranked = G.ranked_centroids(groups.select("probe_id"), groups).withColumn("smaller", -F.col("size"))
    return global_rank(ranked, ["smaller", "probe_id"], "centroids").select((F.col("rank") + 1).alias("place"), "probe_id", "size")


def _results(spark, d):
    """Reads with any alignment stand for the captured fragments."""
    names = alns(spark, d).select("qname").dropna().distinct()
    groups = N.group_detail(detected(spark, d), refs(spark, d))
    accuracy = N.accuracy_by_genome(N.read_mappings(alns(spark, d)), links(spark, d))
    return N.results_row(names, N.mapped_read_ids(alns(spark, d)), a6_class_by_genome(spark, d), accuracy, groups, RUN, WHEN, SEED, reads_sequenced=names)


def k7_results(spark, d):
    return _results(spark, d)


def k9_document(spark, d):
    return N.results_document(_results(spark, d))


def k9_details(spark, d):
    """Who is behind the counts of the document; the rows themselves are those of a10_detail_rows."""
    none = refs(spark, d).where("false").select("reference_id")
    return N.detail_documents(N.group_detail(detected(spark, d), refs(spark, d)), none, panel_queries.a9_unknown_detected(spark, d), refs(spark, d).where("category = 'untargeted'")).select("section", "name")


QUERIES = {
    f.__name__: f
    for f in (
        *(j7_sample_targets, j8_accuracy_by_genome, j9_fragments_by_genome, a6_class_by_genome, j11_edges_of_shared_targets, a19_discriminability_shared, g7_calls_of_shared_targets, a17_hits_from_lines),
        *(g1_near_duplicate_reads, f29_covered_spans, d11_gap_details, d11_gap_dust, v8_gap_order, v13_refine_long, v14_target_composition, a27_ranked_centroids, k7_results, k9_document, k9_details),
    )
}

_P = panel_queries
_LINKS = f"""{_P._SIM}, links AS (SELECT rname AS genome_id, rname AS target_id FROM ref_targets WHERE group_name IS NOT NULL AND category IN ('sample', 'nonsample_target') UNION SELECT target_a, target_b FROM sim UNION SELECT target_b, target_a FROM sim)"""
_SHARED = f"""{_P._SIM}, {_P._OWN.replace('own AS', 'own1 AS')}, own AS (SELECT * FROM own1 UNION SELECT o.target_id, p.species_id FROM (SELECT target_a AS a, target_b AS b FROM sim WHERE identity_pct >= 97 UNION SELECT target_b, target_a FROM sim WHERE identity_pct >= 97) JOIN own1 p ON p.target_id = a JOIN own1 o ON o.target_id = b),
und AS (SELECT DISTINCT least(target_a, target_b) AS a, greatest(target_a, target_b) AS b FROM sim), pairs AS (SELECT a, b, x.species_id AS sa, y.species_id AS sb FROM und JOIN own x ON x.target_id = a JOIN own y ON y.target_id = b),
crs AS (SELECT * FROM pairs WHERE (a, b) NOT IN (SELECT (a, b) FROM pairs WHERE sa = sb)),
edges AS (SELECT a AS target_id, b AS similar_id, sa AS species_id, sb AS similar_species FROM crs UNION ALL SELECT b, a, sb, sa FROM crs)"""
_CLASS = f"(SELECT qname, CASE WHEN category = 'sample' AND {_P._SRC} NOT IN (SELECT genome_id FROM links) THEN 'untargeted' ELSE coalesce(category, 'unknown') END AS fragment_class FROM (SELECT DISTINCT qname FROM sam_alignments) LEFT JOIN ref_targets ON rname = {_P._SRC} WHERE {_P._SRC} IS NOT NULL)"
_GENOME_ACC = f"(SELECT count(*) FILTER (ok) AS reads_correctly_mapped, count(*) FILTER (NOT ok) AS reads_incorrectly_mapped FROM (SELECT EXISTS (SELECT 1 FROM links WHERE genome_id = src AND target_id = reference_id) AS ok FROM (SELECT {_P._SRC} AS src, reference_id FROM map) WHERE src IS NOT NULL))"
_PAIR = f"WITH {sequence_queries._places('SELECT aln_id, NULL AS strand, upper(seq) AS seq FROM ' + sequence_queries._R)}, placed AS (SELECT aln_id, doc_id AS reference_id, start AS s, start + len(seq) AS e, distance FROM z JOIN p USING (aln_id)), refs AS (SELECT doc_id AS reference_id, len(seq) AS len FROM {sequence_queries._DOCS})"
_COUNT = lambda suffix: ", ".join(f"count(*) FILTER (fragment_class = '{c}') AS {c}_{suffix}" for c in ("sample", "nonsample_target", "distractor", "untargeted"))
_RESULT = f"""WITH {_P._DET}, {_P._KNOWN}, {_P._groups('det')}, {_LINKS}, cls AS {_CLASS}, acc AS {_GENOME_ACC}, names AS (SELECT DISTINCT qname FROM sam_alignments WHERE qname IS NOT NULL), got AS (SELECT DISTINCT qname FROM sam_alignments WHERE rname <> '*' AND qname IS NOT NULL),
g AS (SELECT count(*) AS fragments_generated, {_COUNT('generated')} FROM names LEFT JOIN cls USING (qname)), c AS (SELECT count(*) AS fragments_captured, {_COUNT('captured')} FROM got LEFT JOIN cls USING (qname)), m AS ({_P.ORACLE['a8_confusion_metrics']})
SELECT '{RUN}' AS run_name, '{WHEN}' AS timestamp, fragments_generated AS num_fragments, '{SEED}' AS seed, fragments_generated, fragments_captured, {_P._rate('fragments_captured', 'fragments_generated')} AS capture_rate,
  {', '.join(N.RESULTS[7:17])}, tp_count + fn_count AS sample_total, fp_target_count + tn_target_count AS nonsample_target_total, fp_distractor_count + tn_distractor_count AS distractors_total, {', '.join(N.RESULTS[20:32])},
  fragments_generated AS reads_sequenced, 0::BIGINT AS reads_after_filter, reads_correctly_mapped + reads_incorrectly_mapped AS reads_mapped, greatest(fragments_generated - reads_correctly_mapped - reads_incorrectly_mapped, 0) AS reads_unmapped FROM g, c, acc, m"""


def _section(name: str, columns) -> str:
    return f"{name} := struct_pack({', '.join(f'{c} := {c}' for c in columns)})"


ORACLE = {
    "j7_sample_targets": f"WITH {_LINKS} SELECT DISTINCT target_id AS reference_id FROM links WHERE genome_id IN (SELECT rname FROM ref_targets WHERE category = 'sample')",
    "j8_accuracy_by_genome": f"WITH {_P._MAP}, {_LINKS} SELECT * FROM {_GENOME_ACC}",
    "j9_fragments_by_genome": f"WITH {_P._MAP}, {_LINKS}, n AS (SELECT {_P._SRC} AS src, count(*) AS n FROM map GROUP BY ALL), l AS (SELECT target_id, coalesce(sum(n), 0) AS s FROM links LEFT JOIN n ON src = genome_id GROUP BY target_id) SELECT rname AS reference_id, CAST(coalesce(s, n, 0) AS BIGINT) AS fragments FROM ref_targets LEFT JOIN l ON target_id = rname LEFT JOIN n ON src = rname WHERE category IN ('sample', 'nonsample_target')",
    "a6_class_by_genome": f"WITH {_LINKS} SELECT * FROM {_CLASS}",
    "j11_edges_of_shared_targets": f"WITH {_SHARED} SELECT * FROM edges",
    "a19_discriminability_shared": f"WITH {_P._DISC.replace(_P._EDGES, _SHARED)} SELECT * FROM disc",
    "a17_hits_from_lines": f"""WITH u AS (SELECT query_name, target_name, query_length, query_start, query_end, matching_bases, block_length AS size FROM {corpus_queries._PAF} WHERE reason = '' UNION ALL SELECT query_name, target_name, query_length, query_start - 1, query_end, matching_bases, alignment_length FROM {corpus_queries._BLAST} WHERE reason = '')
SELECT query_name AS probe_id, target_name AS target_id, 'against' AS hit_mode, {_P._rate('matching_bases', 'query_length')} * 100 AS homology_pct, {_P._rate('matching_bases', 'size')} * 100 AS identity_pct, {_P._rate('query_end - query_start', 'query_length')} * 100 AS query_coverage_pct, matching_bases, size AS alignment_length, query_length AS probe_length FROM u WHERE {_P._rate('matching_bases', 'query_length')} * 100 >= 50""",
    "f29_covered_spans": f"{_PAIR} SELECT aln_id AS probe_id, reference_id AS target_id, CAST(greatest(s - 20, 0) AS BIGINT) AS span_start, CAST(least(e + 20, len) AS BIGINT) AS span_end FROM placed JOIN refs USING (reference_id) WHERE distance <= 20",
    "d11_gap_details": f"""{_PAIR}, best AS (SELECT reference_id, s, e FROM placed QUALIFY row_number() OVER (PARTITION BY aln_id ORDER BY distance, reference_id, s, e) = 1), {depth_queries._segments('seg', 'best')}, {depth_queries._segments('iseg', 'placed')},
g AS (SELECT reference_id, seg_start AS a, seg_end AS b, len FROM seg JOIN refs USING (reference_id) WHERE depth = 0 AND seg_end - seg_start >= 50),
o AS (SELECT g.reference_id, a, b, sum(least(b, seg_end) - greatest(a, seg_start)) AS bases FROM g JOIN iseg ON iseg.reference_id = g.reference_id AND depth > 0 AND a < seg_end AND seg_start < b GROUP BY ALL),
t AS (SELECT g.*, coalesce(bases, 0) AS bases, substr(t.seq, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS seq FROM g LEFT JOIN o USING (reference_id, a, b) JOIN {sequence_queries._DOCS} t ON t.doc_id = g.reference_id)
SELECT reference_id AS target_id, CAST(a + 1 AS BIGINT) AS gap_start, CAST(b AS BIGINT) AS gap_end, CAST(b - a AS BIGINT) AS gap_length, (a = 0 OR b = len) AS is_terminal, round({sequence_queries._n('GCgc')} / CAST({sequence_queries._n('ACGTacgt')} AS DOUBLE), 9) AS gc_content, CASE WHEN bases = 0 THEN 'true_gap' ELSE 'multimapper_gap' END AS gap_type, round(bases / CAST(b - a AS DOUBLE), 9) AS individual_coverage, seq AS gap_sequence FROM t""",
    "v8_gap_order": f"SELECT row_number() OVER (ORDER BY CASE gap_type WHEN 'true_gap' THEN 0 ELSE 1 END, gap_start - gap_end, reference_id, gap_start) AS place, reference_id, gap_start, gap_end, gap_type FROM ({depth_queries.ORACLE['j16_gap_types']})",
    "v13_refine_long": f"SELECT 'Covered' AS category, num_targets - num_below_threshold AS count FROM ({design_queries.ORACLE['a28_refine_summary']}) UNION ALL SELECT 'Below threshold', num_below_threshold FROM ({design_queries.ORACLE['a28_refine_summary']})",
    "v14_target_composition": f"WITH {_P._DISC} SELECT species_id, 'Shared' AS type, shared_targets AS count FROM disc UNION ALL SELECT species_id, 'Unique', unique_targets FROM disc",
    "a27_ranked_centroids": f"SELECT row_number() OVER (ORDER BY size DESC, probe_id) AS place, probe_id, size FROM (SELECT min(aln_id) AS probe_id, count(*) AS size FROM {sequence_queries._R} GROUP BY upper(seq))",
    "k7_results": _RESULT,
    "k9_document": f"SELECT CAST(to_json(struct_pack({_section('run_info', N.RESULTS[:4])}, {_section('capture_stats', N.RESULTS[4:15])}, {_section('read_level', (*N.RESULTS[15:17], *N.RESULTS[34:36], *N.RESULTS[32:34]))}, {_section('metrics', N.RESULTS[20:32])})) AS VARCHAR) AS document FROM ({_RESULT})",
    "k9_details": f"WITH {_P._DET}, {_P._KNOWN}, {_P._groups('det')} SELECT CASE classification WHEN 'TP' THEN 'true_positives' WHEN 'FN' THEN 'false_negatives' WHEN 'FP_target' THEN 'fp_targets' WHEN 'FP_distractor' THEN 'fp_distractors' WHEN 'TN_target' THEN 'tn_targets' ELSE 'tn_distractors' END AS section, group_name AS name FROM gd UNION ALL SELECT 'untargeted_genomes', rname FROM ref_targets WHERE category = 'untargeted' UNION ALL SELECT 'unknown_detected', reference_id FROM det WHERE reference_id NOT IN (SELECT rname FROM ref_targets WHERE category IN ('sample', 'nonsample_target', 'distractor'))",
}

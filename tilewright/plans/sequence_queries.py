"""Queries on sequences: scalar functions, tiling, energies, low complexity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import sequence as S
from tilewright.functions.alignment import paired_bases
from tilewright.functions.sdust import dust_scores, masked_fraction, masked_text, sdust, window_scores
from tilewright.functions.thermo import GAS, INITIATION, SALT, STACKS, boltzmann_score, delta_g
from tilewright.operators import tiling
from tilewright.operators.design import collapse_identical
from tilewright.tables import table


def reads(spark, d):
    """(aln_id, seq): each delivered read once."""
    return table(spark, d, "sam_alignments").where("seq <> '*'").select("aln_id", "seq").distinct()


def document_sequences(spark, d):
    """(doc_id, seq): the nucleotide letters of each document, a stand-in for long targets."""
    return table(spark, d, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("seq")).where("seq <> ''")


def f1_source_id(spark, d):
    return table(spark, d, "sam_alignments").select("aln_id", S.source_id("qname").alias("source_id")).distinct()


def f2_reverse_complement(spark, d):
    return reads(spark, d).select("aln_id", S.reverse_complement("seq").alias("rc"))


def f3_hamming(spark, d):
    return reads(spark, d).select("aln_id", S.hamming_n("seq", S.reverse_complement("seq")).alias("mismatches"))


def f4_composition(spark, d):
    return reads(spark, d).select("aln_id", S.gc_fraction("seq").alias("gc_fraction"), S.gc_content("seq").alias("gc_content"), S.n_fraction("seq").alias("n_fraction"))


def f7_probe_filters(spark, d):
    r = reads(spark, d)
    return r.where((S.n_fraction("seq") <= 0.1) & (F.length("seq") >= 50) & S.gc_fraction("seq").between(0.35, 0.65)).select("aln_id")


def f10_complexity_filter(spark, d):
    return reads(spark, d).where(masked_fraction("seq") <= 0.1).select("aln_id")


def f11_sdust(spark, d):
    return document_sequences(spark, d).select("doc_id", F.explode(sdust("seq")).alias("m")).select("doc_id", F.col("m.s").alias("mask_start"), F.col("m.e").alias("mask_end"))


def f12_masked_fraction(spark, d):
    return document_sequences(spark, d).select("doc_id", masked_fraction("seq").alias("masked_fraction"))


def f13_window_score(spark, d):
    """(aln_id, window_start, score): every window of 64 bases of each read, or the read if it is shorter."""
    return reads(spark, d).select("aln_id", F.posexplode(window_scores("seq")).alias("k", "score")).select("aln_id", F.col("k").cast("long").alias("window_start"), "score")


def f13_window_score_all(spark, d):
    """f13_window_score by its earlier name."""
    return f13_window_score(spark, d)


def f13_masked_text(spark, d):
    return document_sequences(spark, d).select("doc_id", masked_text("seq").alias("masked"))


def f13_dust_scores(spark, d):
    scored = document_sequences(spark, d).select("doc_id", dust_scores("seq").alias("s"))
    return scored.select("doc_id", F.round("s.mean_score", 9).alias("mean_score"), F.round("s.mean_below", 9).alias("mean_below"))


def f14_fix_n(spark, d):
    return reads(spark, d).select("aln_id", S.fix_n("seq").alias("fixed"), F.length(F.regexp_replace("seq", "[^N]", "")).alias("n_fixed"))


def f17_paired_bases(spark, d):
    alns = table(spark, d, "sam_alignments").where("seq <> '*' AND cigar <> '*'").select("aln_id", "seq", "cigar", "md").distinct()
    return alns.select("aln_id", paired_bases("seq", "cigar", "md").alias("paired"))


def f18_delta_g(spark, d):
    return reads(spark, d).select("aln_id", F.round(delta_g("seq", 65.0, 0.05), 6).alias("delta_g"))


def f19_boltzmann(spark, d):
    return reads(spark, d).select("aln_id", F.round(F.ln(boltzmann_score(delta_g("seq", 65.0, 0.05), 65.0)), 6).alias("log_score"))


def f20_ct_fractions(spark, d):
    rows = table(spark, d, "sweep_summary").select("row_id", "ct").distinct()
    return rows.select("row_id", F.round(S.ct_to_target_fraction("ct"), 12).alias("target_fraction"), F.round(S.ct_to_distractor_fraction("ct"), 12).alias("distractor_fraction"))


def f23_trim_reads(spark, d):
    return reads(spark, d).select("aln_id", F.substring("seq", 1, 50).alias("trimmed"))


def f27_kmer_code(spark, d):
    """(aln_id, start, code): every 16-mer of each read."""
    starts = F.sequence(F.lit(1), F.length("seq") - 15)
    cut = reads(spark, d).where(F.length("seq") >= 16).select("aln_id", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("seq"), i, F.lit(16)))).alias("start", "kmer"))
    return cut.select("aln_id", F.col("start").cast("long").alias("start"), S.kmer_code("kmer").alias("code"))


def f27_kmer_codes_all(spark, d):
    """f27_kmer_code by its earlier name."""
    return f27_kmer_code(spark, d)


def d7_tiles(spark, d):
    return tiling.tile_probes(document_sequences(spark, d), "doc_id", "seq", 120, -60)


def d8_kmers(spark, d):
    return tiling.enumerate_kmers(document_sequences(spark, d), "doc_id", "seq", 60, 30)


def d9_candidates(spark, d):
    return tiling.candidate_probes(document_sequences(spark, d), "doc_id", "seq", 100, 50)


def a22_fasta_stats(spark, d):
    r = reads(spark, d)
    steps = [("input", r), ("length", r.where(F.length("seq") >= 50)), ("gc", r.where((F.length("seq") >= 50) & S.gc_fraction("seq").between(0.35, 0.65)))]
    parts = [df.agg(F.lit(k).cast("long").alias("step_no"), F.lit(name).alias("step"), F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("bases")) for k, (name, df) in enumerate(steps)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def a22_build_chain(spark, d, probe_length=50, step=0):
    """The steps of building probes from reads, in the order of the original: (step_no, step, sequences, bases).

    Collapsing and deduplicating join identical texts, as collapse_identical does.
    """
    clean = reads(spark, d).where(S.n_fraction("seq") <= 0.1)
    collapsed = collapse_identical(clean, "aln_id", "seq")
    long = collapsed.where(F.length("seq") >= probe_length)
    built = tiling.tile_probes(long, "aln_id", "seq", probe_length, step).select("probe_id", F.col("probe").alias("seq"))
    gc = built.where(S.gc_fraction("seq").between(0.35, 0.65))
    complex_ = gc.where(masked_fraction("seq") <= 0.1)
    steps = [("input", reads(spark, d)), ("n_filtered", clean), ("collapsed", collapsed), ("length_filtered", long), ("built", built), ("gc_filtered", gc), ("complexity_filtered", complex_), ("deduplicated", collapse_identical(complex_, "probe_id", "seq"))]
    count = lambda k, name, df: df.agg(F.lit(k).cast("long").alias("step_no"), F.lit(name).alias("step"), F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("bases"))
    return reduce(DataFrame.unionByName, (count(k, name, df) for k, (name, df) in enumerate(steps)))


def j12_seed_matches(spark, d):
    probes = reads(spark, d).select(F.col("aln_id").alias("probe_id"), F.col("seq").alias("probe"))
    targets = document_sequences(spark, d).select(F.col("doc_id").alias("target_id"), "seq")
    return tiling.seed_matches(probes, targets, 14, 40)


def j12_both_strands(spark, d):
    """j12_seed_matches with the places of reverse complements."""
    probes = reads(spark, d).select(F.col("aln_id").alias("probe_id"), F.col("seq").alias("probe"))
    targets = document_sequences(spark, d).select(F.col("doc_id").alias("target_id"), "seq")
    return tiling.seed_matches_both_strands(probes, targets, 14, 40)


QUERIES = {f.__name__: f for f in (f1_source_id, f2_reverse_complement, f3_hamming, f4_composition, f7_probe_filters, f10_complexity_filter, f11_sdust, f12_masked_fraction, f13_window_score, f13_masked_text, f13_dust_scores, f14_fix_n, f17_paired_bases, f18_delta_g, f19_boltzmann, f20_ct_fractions, f23_trim_reads, f27_kmer_code, d7_tiles, d8_kmers, d9_candidates, a22_fasta_stats, j12_seed_matches, j12_both_strands, f13_window_score_all, f27_kmer_codes_all, a22_build_chain)}

_R = "(SELECT DISTINCT aln_id, seq FROM sam_alignments WHERE seq <> '*')"
_DOCS = "(SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents WHERE regexp_replace(text, '[^ACGTacgt]', '', 'g') <> '')"
_RC = "translate(reverse(regexp_replace(upper(seq), '[^ACGT]', 'N', 'g')), 'ACGT', 'TGCA')"


def _n(letters: str) -> str:
    return f"len(regexp_replace(seq, '[^{letters}]', '', 'g'))"


_GC = f"(CASE WHEN len(seq) = 0 THEN 0.0 ELSE {_n('GCgc')} / CAST(len(seq) AS DOUBLE) END)"
_NF = f"(CASE WHEN len(seq) = 0 THEN 0.0 ELSE (len(seq) - {_n('ACGTacgt')}) / CAST(len(seq) AS DOUBLE) END)"


def _stack_case(k: int) -> str:
    return "CASE substr(upper(seq), i, 2) " + " ".join(f"WHEN '{p}' THEN {v[k]}" for p, v in STACKS.items()) + " ELSE 0 END"


_BASES = "regexp_replace(upper(seq), '[^ACGT]', '', 'g')"


def _ends(k: int) -> str:
    one = lambda x: f"CASE WHEN {x} IN ('G', 'C') THEN {INITIATION['GC'][k]} ELSE {INITIATION['AT'][k]} END"
    return f"{one(f'left({_BASES}, 1)')} + {one(f'right({_BASES}, 1)')}"


_STACKED = "len(list_filter(generate_series(1, len(seq) - 1), lambda i: regexp_full_match(substr(upper(seq), i, 2), '[ACGT]{2}')))"
_DG = f"""(CASE WHEN {_STACKED} > 0 THEN CAST(list_sum(list_transform(generate_series(1, len(seq) - 1), lambda i: CAST({_stack_case(0)} AS DOUBLE))) AS DOUBLE) + {_ends(0)}
  - (65.0::DOUBLE + 273.15::DOUBLE) * (list_sum(list_transform(generate_series(1, len(seq) - 1), lambda i: CAST({_stack_case(1)} AS DOUBLE))) + {_ends(1)} + {SALT}::DOUBLE * (len({_BASES}) - 1) * ln(0.05::DOUBLE)) / 1000 ELSE 0.0 END)"""


def _starts(size: int, stride: int) -> str:
    return f"list_distinct(list_concat(generate_series(0, len(seq) - {size}, {stride}), [len(seq) - {size}]))"


def _kmers(size: int, stride: int) -> str:
    return f"(SELECT doc_id, start, substr(seq, start + 1, {size}) AS kmer FROM (SELECT doc_id, seq, CAST(unnest({_starts(size, stride)}) AS BIGINT) AS start FROM {_DOCS} WHERE len(seq) >= {size}))"


_TARGET = "(0.01::DOUBLE * pow(2.0::DOUBLE, 20.0::DOUBLE - ct))"
_STEPS = [("0", "input", "true"), ("1", "length", "len(seq) >= 50"), ("2", "gc", f"len(seq) >= 50 AND {_GC} BETWEEN 0.35 AND 0.65")]

#: (aln_id, paired): the aligned bases of each read by its CIGAR, N for those that MD names as unlike the reference.
PAIRED = r"""(WITH a AS (SELECT DISTINCT aln_id, seq, cigar, md FROM sam_alignments WHERE seq <> '*' AND cigar <> '*'),
ops AS (SELECT *, unnest(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1)) AS n, unnest(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2)) AS op, generate_subscripts(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1), 1) AS i FROM a),
walk AS (SELECT *, CAST(n AS BIGINT) AS size, coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN CAST(n AS BIGINT) ELSE 0 END) OVER (PARTITION BY aln_id, cigar, seq, md ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ops),
bases AS (SELECT aln_id, cigar, seq, md, string_agg(CASE WHEN op = 'X' THEN repeat('N', len(substr(seq, CAST(off AS BIGINT) + 1, size))) ELSE upper(substr(seq, CAST(off AS BIGINT) + 1, size)) END, '' ORDER BY i) AS b FROM walk WHERE op IN ('M', '=', 'X') GROUP BY ALL),
tok AS (SELECT aln_id, cigar, seq, md, unnest(regexp_extract_all(md, '[0-9]+|\^[A-Za-z]+|[A-Za-z]')) AS t, generate_subscripts(regexp_extract_all(md, '[0-9]+|\^[A-Za-z]+|[A-Za-z]'), 1) AS i FROM a WHERE md IS NOT NULL),
pos AS (SELECT *, coalesce(sum(CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS BIGINT) WHEN len(t) = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY aln_id, cigar, seq, md ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM tok),
mis AS (SELECT aln_id, cigar, seq, md, list(CAST(p AS BIGINT)) AS ps FROM pos WHERE len(t) = 1 AND regexp_full_match(t, '[A-Za-z]') GROUP BY ALL)
SELECT a.aln_id, CASE WHEN ps IS NULL THEN coalesce(b, '') ELSE array_to_string(list_transform(generate_series(1, len(b)), lambda k: CASE WHEN list_contains(ps, k - 1) THEN 'N' ELSE b[k] END), '') END AS paired
FROM a LEFT JOIN bases USING (aln_id, cigar, seq) LEFT JOIN mis ON mis.aln_id = a.aln_id AND mis.cigar = a.cigar AND mis.seq = a.seq AND mis.md = a.md WHERE bases.md IS NOT DISTINCT FROM a.md)"""


def _places(source: str) -> str:
    """Places of the texts in source (aln_id, strand, seq) on documents, with their distance."""
    return f"""p AS ({source}), pw AS (SELECT DISTINCT seq, i, substr(seq, i, 14) AS w FROM (SELECT seq, unnest(generate_series(1, len(seq) - 13)) AS i FROM p WHERE len(seq) >= 14)),
tw AS (SELECT doc_id, len(seq) AS t_len, j, substr(seq, j, 14) AS w FROM (SELECT doc_id, seq, unnest(generate_series(1, len(seq) - 13)) AS j FROM {_DOCS} WHERE len(seq) >= 14)),
m AS (SELECT DISTINCT seq, doc_id, j - i AS start FROM pw JOIN tw USING (w) WHERE j >= i AND j - i + len(seq) <= t_len AND NOT contains(w, 'N')),
x AS (SELECT m.seq, m.doc_id, start, substr(t.seq, start + 1, len(m.seq)) AS win FROM m JOIN {_DOCS} t ON t.doc_id = m.doc_id),
y AS (SELECT *, len(list_filter(generate_series(1, len(seq)), lambda i: substr(seq, i, 1) <> substr(win, i, 1) OR substr(seq, i, 1) = 'N')) AS distance FROM x),
z AS (SELECT aln_id, strand, doc_id, start, distance FROM y JOIN p USING (seq) WHERE distance <= 40)"""


ORACLE = {
    "j12_both_strands": f"WITH {_places(f"SELECT aln_id, '+' AS strand, upper(seq) AS seq FROM {_R} UNION SELECT aln_id, CASE WHEN {_RC} = upper(seq) THEN '+' ELSE '-' END, {_RC} FROM {_R}")} SELECT aln_id AS probe_id, doc_id AS target_id, arg_min(strand, distance * 2 + CASE strand WHEN '+' THEN 0 ELSE 1 END) AS strand, CAST(start AS BIGINT) AS start, CAST(min(distance) AS INTEGER) AS distance FROM z GROUP BY aln_id, doc_id, start",
    "f1_source_id": r"SELECT DISTINCT aln_id, nullif(regexp_extract(qname, '^(\S*)_fragment_', 1), '') AS source_id FROM sam_alignments",
    "f2_reverse_complement": f"SELECT aln_id, {_RC} AS rc FROM {_R}",
    "f3_hamming": f"SELECT aln_id, CAST(len(list_filter(generate_series(1, len(seq)), lambda i: substr(upper(seq), i, 1) <> substr({_RC}, i, 1) OR substr(upper(seq), i, 1) = 'N')) AS INTEGER) AS mismatches FROM {_R}",
    "f4_composition": f"SELECT aln_id, {_GC} AS gc_fraction, CASE WHEN {_n('ACGTacgt')} = 0 THEN 0.0 ELSE {_n('GCgc')} / CAST({_n('ACGTacgt')} AS DOUBLE) END AS gc_content, {_NF} AS n_fraction FROM {_R}",
    "f7_probe_filters": f"SELECT aln_id FROM {_R} WHERE {_NF} <= 0.1 AND len(seq) >= 50 AND {_GC} BETWEEN 0.35 AND 0.65",
    "f13_window_score": f"""WITH w AS (SELECT aln_id, seq, unnest(generate_series(0, greatest(len(seq) - 64, 0))) AS a FROM {_R}),
t AS (SELECT aln_id, a, unnest(list_transform(generate_series(1, greatest(least(len(seq), 64) - 2, 1)), lambda i: substr(upper(seq), a + i, 3))) AS w FROM w),
c AS (SELECT aln_id, a, w, count(*) FILTER (regexp_full_match(w, '[ACGT]{{3}}')) AS k FROM t GROUP BY ALL)
SELECT aln_id, a AS window_start, CASE WHEN sum(k) > 1 THEN sum(k * (k - 1) / 2.0::DOUBLE) / (sum(k) - 1) ELSE 0.0 END AS score FROM c GROUP BY aln_id, a""",
    "f14_fix_n": f"SELECT aln_id, list_reduce(list_transform(generate_series(0, len(seq)), lambda i: CASE WHEN i = 0 THEN '' ELSE substr(seq, i, 2) END), lambda acc, x: acc || CASE WHEN left(x, 1) <> 'N' THEN left(x, 1) {' '.join(f'WHEN right(acc, 1) <> {b!r} AND substr(x, 2, 1) <> {b!r} THEN {b!r}' for b in 'TACG')} ELSE 'T' END) AS fixed, CAST(len(regexp_replace(seq, '[^N]', '', 'g')) AS INTEGER) AS n_fixed FROM {_R}",
    "f17_paired_bases": f"SELECT aln_id, paired FROM {PAIRED}",
    "f18_delta_g": f"SELECT aln_id, round({_DG}, 6) AS delta_g FROM {_R}",
    "f19_boltzmann": f"SELECT aln_id, round(ln(greatest(1.0::DOUBLE, exp(-{_DG} / ({GAS}::DOUBLE * (65.0::DOUBLE + 273.15::DOUBLE))))), 6) AS log_score FROM {_R}",
    "f20_ct_fractions": f"SELECT row_id, round({_TARGET}, 12) AS target_fraction, round(CASE WHEN {_TARGET} > 0 AND {_TARGET} < 1 THEN 1.0::DOUBLE - {_TARGET} END, 12) AS distractor_fraction FROM (SELECT DISTINCT row_id, ct FROM sweep_summary)",
    "f23_trim_reads": f"SELECT aln_id, substr(seq, 1, 50) AS trimmed FROM {_R}",
    "f27_kmer_code": f"SELECT aln_id, CAST(start AS BIGINT) AS start, CASE WHEN regexp_full_match(k, '[ACGT]+') THEN CAST(list_sum(list_transform(generate_series(1, 16), lambda i: (strpos('ACGT', substr(k, i, 1)) - 1) * CAST(pow(4, 16 - i) AS BIGINT))) AS BIGINT) END AS code FROM (SELECT aln_id, start, substr(upper(seq), CAST(start AS BIGINT) + 1, 16) AS k FROM (SELECT aln_id, seq, unnest(generate_series(0, len(seq) - 16)) AS start FROM {_R} WHERE len(seq) >= 16))",
    "d7_tiles": f"""WITH t AS (SELECT doc_id, seq, unnest(CASE WHEN len(seq) <= 120 THEN [0] ELSE list_sort({_starts(120, 60)}) END) AS start FROM {_DOCS}),
k AS (SELECT doc_id, start, substr(seq, start + 1, 120) AS probe, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS tile FROM t)
SELECT doc_id, tile, CAST(start AS BIGINT) AS start, 'probe_' || doc_id || '|tile_' || tile AS probe_id, probe FROM k""",
    "d8_kmers": f"SELECT * FROM {_kmers(60, 30)}",
    "d9_candidates": f"SELECT kmer AS probe, doc_id, start FROM {_kmers(100, 50)} QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY doc_id, start) = 1",
    "a22_fasta_stats": " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS step_no, '{name}' AS step, count(*) AS sequences, CAST(coalesce(sum(len(seq)), 0) AS BIGINT) AS bases FROM {_R} WHERE {cond}" for k, name, cond in _STEPS),
    "j12_seed_matches": f"""WITH p AS (SELECT aln_id, upper(seq) AS seq FROM {_R}), pw AS (SELECT aln_id, seq, i, substr(seq, i, 14) AS w FROM (SELECT aln_id, seq, unnest(generate_series(1, len(seq) - 13)) AS i FROM p WHERE len(seq) >= 14)),
tw AS (SELECT doc_id, j, substr(seq, j, 14) AS w FROM (SELECT doc_id, seq, unnest(generate_series(1, len(seq) - 13)) AS j FROM {_DOCS} WHERE len(seq) >= 14)),
m AS (SELECT DISTINCT aln_id, pw.seq, doc_id, j - i AS start FROM pw JOIN tw USING (w) WHERE j >= i AND NOT contains(w, 'N')),
x AS (SELECT aln_id, m.seq, m.doc_id, start, substr(t.seq, start + 1, len(m.seq)) AS win FROM m JOIN {_DOCS} t ON t.doc_id = m.doc_id),
y AS (SELECT *, len(list_filter(generate_series(1, len(seq)), lambda i: substr(seq, i, 1) <> substr(win, i, 1) OR substr(seq, i, 1) = 'N')) AS distance FROM x WHERE len(win) = len(seq))
SELECT aln_id AS probe_id, doc_id AS target_id, CAST(start AS BIGINT) AS start, CAST(distance AS INTEGER) AS distance FROM y WHERE distance <= 40""",
}
ORACLE |= {"f13_window_score_all": ORACLE["f13_window_score"], "f27_kmer_codes_all": ORACLE["f27_kmer_code"]}

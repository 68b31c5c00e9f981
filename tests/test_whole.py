"""Queries beside those that make a cut."""

import pytest

import __spark_entry__ as entry
from sql_check import differs


@pytest.mark.parametrize("name", ["a8_confusion_all", "a29_species_evidence_all", "g7_species_calls_all", "v2_metric_bars_all", "k9_results_json_all"])
def test_query_equals_its_sql(spark, small, name):
    assert differs(spark, name, small) is None


def test_every_detected_reference_counts(spark, small):
    q = entry.queries()
    targets = {r.reference_id for r in spark.read.parquet(f"{small}/ref_targets.parquet").where("category IN ('sample', 'nonsample_target')").selectExpr("rname AS reference_id").collect()}
    seen = [r for r in q["a1_reads_per_reference"](spark, small).collect() if r.reference_id in targets]
    assert any(r.reads < 3 for r in seen)
    evidence = q["a29_species_evidence_all"](spark, small).collect()
    assert sum(r.total_detected for r in evidence) == len(seen) and sum(r.total_reads for r in evidence) == sum(r.reads for r in seen)


def test_whole_reads_and_build(spark, small, tmp_path):
    texts = {1: "ACGTTGCAAC" * 7, 2: "ACGTTGCAAC" * 7, 3: "A" * 60, 4: "N" * 20 + "ACGTTGCAAC" * 4, 5: "ACGTACGTACGTACGTT", 6: "AAACCTTGGATCAGTTCAGGACTTACGGTCTAACCGTATGCAAGTCCATGGCTAATCG", 7: "GGGGCCCCGGCCGCGCGGCC" * 3}
    spark.createDataFrame(list(texts.items()), "aln_id long, seq string").write.parquet(str(tmp_path / "sam_alignments.parquet"))
    q, d = entry.queries(), str(tmp_path)
    codes = {(r.aln_id, r.start): r.code for r in q["f27_kmer_codes_all"](spark, d).collect()}
    want = {(i, k): int(w.translate(str.maketrans("ACGT", "0123")), 4) if set(w := t[k : k + 16]) <= set("ACGT") else None for i, t in texts.items() for k in range(len(t) - 15)}
    assert codes == want
    assert {r.aln_id for r in q["f13_window_score_all"](spark, d).collect()} == set(texts)
    steps = {r.step: (r.sequences, r.bases) for r in q["a22_build_chain"](spark, d).collect()}
    n = lambda *ids: (len(ids), sum(len(texts[i]) for i in ids))
    assert {k: steps[k] for k in ("input", "n_filtered", "collapsed", "length_filtered")} == {"input": n(*texts), "n_filtered": n(1, 2, 3, 5, 6, 7), "collapsed": n(1, 3, 5, 6, 7), "length_filtered": n(1, 3, 6, 7)}
    # two tiles of 50 each; those of 3 have no G or C and those of 7 nothing else, and the last of 1 repeats the first
    assert steps["built"] == (8, 400) and steps["gc_filtered"][0] == 4 and steps["complexity_filtered"][0] <= 4
    assert steps["deduplicated"][0] <= steps["complexity_filtered"][0]
    assert [r.step_no for r in q["v12_build_chain"](spark, d).orderBy("step_no").collect()] == list(range(8))

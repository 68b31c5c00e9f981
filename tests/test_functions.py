import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import sequence as S
from tilewright.functions.alignment import _paired, aligned_blocks, cigar_ref_length, md_mismatches
from tilewright.functions.sdust import dust_masks, dust_scores, masked_fraction, window_score
from tilewright.functions.thermo import boltzmann_score, delta_g


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(expr.alias("x")).collect()[0].x


def test_source_ids(spark):
    rows = [("a_fragment_2_fragment_5 x", "a_fragment_2"), ("plain", None), (None, None), ("t|1_fragment_9/1", "t|1")]
    got = spark.createDataFrame(rows, "s string, w string").select("w", S.source_id("s").alias("x")).collect()
    assert all(r.x == r.w for r in got)


def test_sequence_functions(spark):
    assert one(spark, "acgtRn", S.reverse_complement("s")) == "NNACGT"
    assert one(spark, "", S.gc_fraction("s")) == 0.0 and one(spark, None, S.gc_fraction("s")) is None
    assert one(spark, "GCNN", S.gc_fraction("s")) == 0.5 and one(spark, "GCNN", S.gc_content("s")) == 1.0 and one(spark, "GCNN", S.n_fraction("s")) == 0.5
    assert one(spark, "NNN", S.hamming_n("s", F.lit("ATG"))) == 3 and one(spark, "N", S.hamming_n("s", F.lit("N"))) == 1
    assert one(spark, "", S.hamming_n("s", F.lit("A"))) == 0 and one(spark, "ACGTA", S.hamming_n("s", F.lit("ACCT"))) == 1
    assert one(spark, "ACGT", S.kmer_code("s")) == 27 and one(spark, "ACN", S.kmer_code("s")) is None


def test_fix_n_differs_from_both_neighbours(spark):
    def brute(s):
        out = ""
        for i, c in enumerate(s):
            right = s[i + 1] if i + 1 < len(s) else ""
            out += next((b for b in "TACG" if b != out[-1:] and b != right), "T") if c == "N" else c
        return out

    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGTNNR") for _ in range(rng.randrange(12))) for _ in range(200)]
    got = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", S.fix_n("s").alias("x")).collect()
    assert all(r.x == brute(r.s) for r in got)


def test_cigar_and_md(spark):
    assert one(spark, "5S10M2D3I4N6=1X", cigar_ref_length("s")) == 23
    assert [tuple(b) for b in one(spark, "5S10M2D3I4N6=1X", aligned_blocks(F.lit(100), "s"))] == [(100, 110), (116, 122), (122, 123)]
    assert one(spark, "*", cigar_ref_length("s")) == 0 and one(spark, None, cigar_ref_length("s")) is None
    assert md_mismatches("10A5^TT3") == {10: "A"} and md_mismatches("0C0G2") == {0: "C", 1: "G"} and md_mismatches(None) == {}
    assert _paired("TTACGTA", "2S3M1I1M", "1G2") == "ANGA" and _paired("AC", "1=1X", None) == "AN" and _paired("*", "5M", None) is None


def test_energies(spark):
    # GC on GC at 70 degrees and 1 M
    want = (-9.8 + 2 * 0.1) - 343.15 * (-24.4 + 2 * -2.8) / 1000
    assert abs(one(spark, "GC", delta_g("s", 70.0, 1.0)) - want) < 1e-9
    assert one(spark, "ANT", delta_g("s", 70.0, 1.0)) == 0.0 and one(spark, "", delta_g("s", 70.0, 1.0)) == 0.0
    assert one(spark, "AA", boltzmann_score(delta_g("s", 65.0, 0.05), 65.0)) == 1.0
    assert one(spark, "GCGCGCGCGC", boltzmann_score(delta_g("s", 65.0, 1.0), 65.0)) > 1.0


def test_ct(spark):
    assert abs(one(spark, 25.0, S.ct_to_target_fraction("s"), "double") - 0.01 / 32) < 1e-12
    assert one(spark, 5.0, S.ct_to_distractor_fraction("s"), "double") is None
    assert abs(S.calibrate_efficiency(20, 0.01, 21, 0.005) - 1.0) < 1e-12
    for bad in ((20, 0.01, 20, 0.02), (20, 1.0, 25, 0.1), (20, 0.001, 25, 0.01)):
        with pytest.raises(ValueError):
            S.calibrate_efficiency(*bad)


def test_distractor_share():
    assert S.resolve_distractor_fraction() == 0.9 and S.resolve_distractor_fraction(0.25) == 0.25
    assert abs(S.resolve_distractor_fraction(ct=25.0) - (1 - 0.01 / 32)) < 1e-12
    for bad in ({"fraction": 1.5}, {"ct": 2.0}):
        with pytest.raises(ValueError):
            S.resolve_distractor_fraction(**bad)


def test_long_sequences_are_cut_without_a_trace(monkeypatch, spark):
    from tilewright.functions import sdust as U

    rng = random.Random(4)
    s = "".join(rng.choice("ACGT") * rng.randrange(1, 6) if rng.random() < 0.5 else "".join(rng.choice("ACGT") for _ in range(20)) for _ in range(300))
    whole, scores = U.dust_masks([s, "ACG"]), U._window_scores([s, "ACG"], 64)
    shown = one(spark, s, U.masked_text("s"))
    assert shown.upper() == s and [(a, b) for a, b in whole[0] if not shown[a:b].islower()] == [] and sum(c.islower() for c in shown) == sum(b - a for a, b in whole[0])
    assert one(spark, None, U.masked_text("s")) is None
    monkeypatch.setattr(U, "PIECE", 200)
    assert U.dust_masks([s, "ACG"]) == whole and len(whole[0]) > 5
    assert all((a == b).all() for a, b in zip(U._window_scores([s, "ACG"], 64), scores))


def test_dust_against_its_definition():
    def score(s, i, j):
        t = [s[k : k + 3] for k in range(i, j - 2)]
        if len(t) < 2 or any(c not in "ACGT" for x in t for c in x):
            return 0.0
        return sum(t.count(x) * (t.count(x) - 1) / 2 for x in set(t)) / (len(t) - 1)

    rng = random.Random(7)
    for _ in range(40):
        s = "".join(rng.choice("AAAACGTN" if rng.random() < 0.9 else "AT") for _ in range(rng.randrange(30)))
        spans = {(i, j): score(s, i, j) for i in range(len(s)) for j in range(i + 4, len(s) + 1)}
        want = [0] * len(s)
        for (i, j), v in spans.items():
            if v > 2 and all(spans[a, b] <= v for a in range(i, j) for b in range(a + 4, j + 1)):
                want[i:j] = [1] * (j - i)
        got = [0] * len(s)
        for a, b in dust_masks(["ACG", s, "TT"])[1]:
            got[a:b] = [1] * (b - a)
        assert got == want
    assert dust_masks(["A" * 16, "ACGT" * 4, "AC", ""]) == [[(0, 16)], [], [], []]


def test_dust_columns(spark):
    assert one(spark, "A" * 10, masked_fraction("s")) == 1.0 and one(spark, "", masked_fraction("s")) == 0.0
    assert one(spark, "ACGTACGTACGTACGT", window_score("s")) == 18 / 13 and one(spark, None, window_score("s")) == 0.0
    rng = random.Random(3)
    for text in ("A" * 40 + "".join(rng.choice("ACGT") for _ in range(150)), "ACGGTNNACGTTAC", "AC", ""):
        scores = []
        for i in range(len(text)):
            end = min(max(0, i - 32) + 64, len(text))
            part = text[max(0, end - 64) : end]
            t = [x for x in (part[k : k + 3] for k in range(len(part) - 2)) if "N" not in x]
            scores.append(sum(t.count(x) * (t.count(x) - 1) / 2 for x in set(t)) / (len(t) - 1) if len(t) > 1 else 0.0)
        low = [x for x in scores if x < 2]
        got = one(spark, text, dust_scores("s"))
        assert abs(got.mean_score - sum(scores) / max(1, len(scores))) < 1e-9 and abs(got.mean_below - sum(low) / max(1, len(low))) < 1e-9


def test_labels(spark):
    from tilewright.functions.labels import aligner_preset, combination_label, header_value, trimmed_number

    assert [one(spark, v, trimmed_number("s"), "double") for v in (0.5, 10.0, 100.0, 0.000001, None)] == ["0.5", "10", "100", "0.000001", None]
    assert one(spark, 0.25, combination_label(ct=F.lit(20.0), cf="s", n=F.lit(None).cast("double")), "double") == "ct=20_cf=0.25"
    assert one(spark, "badread", aligner_preset("s", F.lit("nanopore"))) == "map-ont" and one(spark, "art", aligner_preset("s", F.lit(""))) == "sr"
    assert one(spark, "x_fragment_1 start=5 length=90", header_value("s", "length")) == 90 and one(spark, "x", header_value("s", "start")) is None

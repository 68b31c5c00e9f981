import inspect
import math
import random
from collections import Counter

import pytest

from tilewright.operators import crossreact as X
from tilewright.operators import design as G
from tilewright.operators import detection as N
from tilewright.operators import sampling as R
from tilewright.operators import similarity as Y
from tilewright.operators import tiling
from tilewright.sources.lists import link_by_prefix, parse_sample_tokens


def greedy(hits):
    left = {}
    for p, r, s, e in hits:
        left.setdefault(p, set()).update((r, i) for i in range(s, e))
    done, out = set(), {}
    while True:
        gains = sorted((-len(v - done), p) for p, v in left.items())
        if not gains or gains[0][0] == 0:
            return out
        g, p = gains[0]
        out[p] = -g
        done |= left.pop(p)


def test_greedy_cover_is_the_loops(spark):
    rng = random.Random(9)
    for n in (5, 40):
        hits = [(f"p{rng.randrange(n):02d}", rng.choice("ab"), s := rng.randrange(200), s + rng.randrange(1, 50)) for _ in range(n)]
        refs = spark.createDataFrame([("a", 300), ("b", 300)], "reference_id string, ref_length long")
        got = {r.probe_id: r.gain for r in G.greedy_cover(spark.createDataFrame(hits, "probe_id string, reference_id string, s long, e long"), refs).collect()}
        assert got == greedy(hits)
    assert G.greedy_cover(spark.createDataFrame([], "probe_id string, reference_id string, s long, e long"), refs).count() == 0


def test_greedy_cover_goes_on_to_the_end(spark, monkeypatch):
    """A chain of falling gains, in which each probe takes bases from the next: one probe a round."""
    monkeypatch.setattr(G, "FOLD", 2)
    assert "most_rounds" not in inspect.signature(G.greedy_cover).parameters
    hits, at = [], 0
    for i in range(7):
        hits.append((f"p{i}", "a", at, at + 100 - i))
        at += 99 - i
    refs = spark.createDataFrame([("a", 1000)], "reference_id string, ref_length long")
    got = {r.probe_id: (r.round, r.gain) for r in G.greedy_cover(spark.createDataFrame(hits, "probe_id string, reference_id string, s long, e long"), refs).collect()}
    assert {p: g for p, (_, g) in got.items()} == greedy(hits)
    assert max(k for k, _ in got.values()) >= 3


def test_confusion_metrics(spark):
    refs = spark.createDataFrame([("s1", "g1", "sample"), ("s2", "g1", "sample"), ("s3", None, "sample"), ("t1", "g1", "nonsample_target"), ("d1", "d", "distractor"), ("d2", None, "distractor"), ("u", None, "untargeted")], "reference_id string, group_name string, category string")
    seen = spark.createDataFrame([("s1", 5), ("s3", 1), ("d1", 2), ("zz", 4)], "reference_id string, reads long")
    m = N.confusion_metrics(N.group_detail(seen, refs)).collect()[0]
    assert (m.tp_count, m.fn_count, m.fp_total, m.tn_total) == (2, 0, 1, 1)
    assert (m.sensitivity, m.specificity, m.precision) == (1.0, 0.5, 2 / 3) and abs(m.f1_score - 0.8) < 1e-12
    none = N.confusion_metrics(N.group_detail(seen.limit(0), refs.limit(0))).collect()[0]
    assert none.f1_score == 0.0 and none.tp_count == 0


def test_species_calls(spark):
    owners = spark.createDataFrame([("a1", "SpA"), ("a2", "SpA"), ("a3", "SpA"), ("b1", "SpB"), ("c1", "SpC"), ("d1", "SpD"), ("d2", "SpD"), ("e1", "SpE"), ("f1", "SpF")], "target_id string, species_id string")
    pairs = spark.createDataFrame([("a3", "b1"), ("b1", "a3"), ("a3", "a3"), ("e1", "f1"), ("f1", None)], "target_a string, target_b string")
    seen = spark.createDataFrame([("a1", 9), ("a2", 4), ("a3", 1), ("b1", 2), ("d1", 3), ("e1", 5)], "target_id string, reads long")
    edges = Y.cross_species_edges(pairs, owners)
    got = {r.species_id: (r.call, r.reason, r.explained_by) for r in Y.call_species(edges, owners, seen, min_unique=2).collect()}
    assert got == {
        "SpA": ("PRESENT", "unique_markers_detected", None),
        "SpB": ("ABSENT", "cross_reactivity_explained", "SpA"),
        "SpC": ("ABSENT", "no_detections", None),
        "SpD": ("AMBIGUOUS", "insufficient_unique_evidence", None),
        "SpE": ("AMBIGUOUS", "no_unique_markers", None),
        "SpF": ("ABSENT", "no_detections", None),
    }


def test_probe_summaries_keep_probes_without_hits(spark):
    hits = spark.createDataFrame([("p", "against", "t2", 80.0), ("p", "against", "t1", 80.0), ("p", "self", "x", None)], "probe_id string, hit_mode string, target_id string, homology_pct double")
    probes = spark.createDataFrame([("p",), ("q",)], "probe_id string")
    got = {(r.probe_id, r.hit_mode): (r.max_homology_pct, r.best_hit, r.num_hits) for r in X.summarize_hits(hits, probes, ["against", "self"]).collect()}
    assert got == {("p", "against"): (80.0, "t1", 2), ("p", "self"): (0.0, None, 0), ("q", "against"): (0.0, None, 0), ("q", "self"): (0.0, None, 0)}


def test_tiles(spark):
    seqs = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "ACG"), ("c", ""), ("d", None), ("e", "ACGTACGT")], "id string, s string")
    got = sorted((r.id, r.tile, r.start, r.probe) for r in tiling.tile_probes(seqs, "id", "s", 4).collect())
    assert got == [("a", 1, 0, "ACGT"), ("a", 2, 4, "ACGT"), ("a", 3, 6, "GTAC"), ("b", 1, 0, "ACG"), ("e", 1, 0, "ACGT"), ("e", 2, 4, "ACGT")]
    with pytest.raises(ValueError):
        tiling.tile_probes(seqs, "id", "s", 4, -4)
    first = {r.probe: (r.id, r.start) for r in tiling.candidate_probes(seqs, "id", "s", 4, 4).collect()}
    assert first == {"ACGT": ("a", 0), "GTAC": ("a", 6)}


def test_seeds_meet_both_strands(spark):
    targets = spark.createDataFrame([("t", "TTTTACGGATCCTTGACAAAA"), ("u", "GGGGGTCAAGGATCCGTGGGG")], "target_id string, seq string")
    probes = spark.createDataFrame([("p", "acggatccttga"), ("q", "TCAAGGATCCGT"), ("own", "GGATCC"), ("n", "ACGGATNCTTGA"), ("p", "ACGGATCCTTGA")], "probe_id string, probe string")
    got = sorted(map(tuple, tiling.seed_matches_both_strands(probes, targets, 5, 1).collect()))
    assert got == sorted([("p", "t", "+", 4, 0), ("p", "u", "-", 5, 0), ("q", "t", "-", 4, 0), ("q", "u", "+", 5, 0), ("own", "t", "+", 6, 0), ("own", "u", "+", 9, 0), ("n", "t", "+", 4, 1), ("n", "u", "-", 5, 1)])


def test_sampling_follows_weights(spark):
    draws = spark.range(6000).withColumnRenamed("id", "draw_id")
    items = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.0), ("d", None)], "item string, w double")
    picked = R.weighted_choice(draws.withColumn("u", R.uniform(7, "draw_id", 0)), "u", items, ["item"], "w")
    n = Counter(r.item for r in picked.collect())
    assert sum(n.values()) == 6000 and set(n) == {"a", "b"}
    assert abs(n["a"] - 4500) < 4 * math.sqrt(6000 * 0.75 * 0.25)
    assert R.weighted_choice(draws.withColumn("u", R.uniform(7, "draw_id", 0)), "u", items.where("w = 0"), ["item"], "w").count() == 0


def test_fragments_stay_inside(spark):
    draws = spark.range(500).withColumnRenamed("id", "draw_id")
    hits = spark.createDataFrame([("p", "r", 0, 50, 1.0, 400), ("q", "r", 380, 400, 2.0, 400), ("q", "s", 5, 60, 2.0, 90)], "probe_id string, reference_id string, s long, e long, score double, ref_length long")
    rows = R.capture_fragments(draws, hits, 1, 200, 100, 300).collect()
    lengths = {"r": 400, "s": 90}
    assert len(rows) == 500 and all(0 <= x.start and x.start + x.length <= lengths[x.reference_id] for x in rows)
    again = R.capture_fragments(draws.repartition(3), hits.repartition(2), 1, 200, 100, 300).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    pools = Counter(r.pool for r in R.split_pools(draws, "draw_id", 0.3).collect())
    assert pools == {"capture": 150, "background": 350}


def test_weights(spark):
    refs = spark.createDataFrame([("a", "sample"), ("b", "distractor"), ("c", "distractor"), ("d", "nonsample_target"), ("e", "untargeted")], "reference_id string, category string")
    assert {r.reference_id: r.weight for r in R.target_weights(refs, 0.5).collect()} == {"a": 1.0, "b": 0.5, "c": 0.5, "d": 0.0}
    with pytest.raises(ValueError):
        R.target_weights(refs, 1.0)


def test_samples_and_prefix_links(spark):
    assert parse_sample_tokens(["t1", "2.5", "t2"]) == [("t1", 2.5), ("t2", 1.0)]
    for bad in ([], ["2", "t"], ["t", "1", "2"]):
        with pytest.raises(ValueError):
            parse_sample_tokens(bad)
    links = link_by_prefix(spark.createDataFrame([("g1",), ("g2",), ("g3",)], "genome_id string"), spark.createDataFrame([("g1|a",), ("g1|a|b",), ("g2",), ("g22|x",), ("g3|y",)], "target_id string"), spark.createDataFrame([("g3", "z")], "genome_id string, target_id string"))
    assert sorted(map(tuple, links.collect())) == [("g1", "g1|a"), ("g1", "g1|a|b"), ("g2", "g2"), ("g3", "z")]


def test_hit_scores(spark):
    alns = spark.createDataFrame([(1, "p", 0, "r", 5, "10M", "GCGCGCGCGC", "10"), (1, "p", 0, "r", 5, "10M", "GCGCGCGCGC", "10"), (2, "q", 256, "r", 1, "2M2D2M", "ATAT", "4"), (3, "z", 0, "none", 1, "4M", "ATAT", "4"), (4, "u", 4, "*", 0, "*", "A", None), (5, "n", 0, "r", 1, "4M", "*", None)], "aln_id long, qname string, flag int, rname string, pos long, cigar string, seq string, md string")
    weights = spark.createDataFrame([("r", 0.5), ("none", 0.0)], "reference_id string, weight double")
    got = {x.probe_id: x for x in R.score_hits(alns, weights, 65.0, 1.0).collect()}
    assert set(got) == {"p", "q"} and got["p"].score > 0.5 and (got["p"].s, got["p"].e) == (4, 14)
    assert (got["q"].s, got["q"].e, got["q"].score) == (0, 6, 0.5)
    assert {x.probe_id: x.score for x in R.score_hits(alns, weights, 65.0, 1.0, thermo=False).collect()} == {"p": 0.5, "q": 0.5, "n": 0.5}

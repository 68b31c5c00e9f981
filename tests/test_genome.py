import random

import pytest
from pyspark.sql import functions as F

from sql_check import differs
from tilewright.operators import depth as D
from tilewright.operators import design as G
from tilewright.operators import detection as N
from tilewright.operators import similarity as Y
from tilewright.operators.skew import spread_join
from tilewright.operators.tiling import CHUNK, seed_matches, seed_matches_both_strands


@pytest.mark.parametrize("name", ["j8_accuracy_by_genome", "j9_fragments_by_genome", "a6_class_by_genome", "j11_edges_of_shared_targets", "a19_discriminability_shared", "a17_hits_from_lines", "d11_gap_details", "k7_results", "k9_document", "v8_gap_order"])
def test_query_equals_its_sql(spark, small, name):
    assert differs(spark, name, small) is None


def calls(own, similar, reads, k):
    """Species one after the other, the strongest first."""
    shared = {t for pair in similar for t in pair}
    species = sorted({s for _, s in own})
    targets = {s: {t for t, x in own if x == s} for s in species}
    uniq = {s: [t for t in targets[s] if t not in shared and t in reads] for s in species}
    order = sorted(species, key=lambda s: (-len(uniq[s]), -sum(reads.get(t, 0) for t in targets[s]), s))
    near = {}
    for a, b in similar:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    explained, present, out = set(), [], {}
    for s in order:
        seen = [t for t in targets[s] if t in reads]
        open_u = [t for t in uniq[s] if t not in explained]
        open_s = [t for t in seen if t in shared and t not in explained]
        if not seen:
            out[s] = ("ABSENT", "no_detections", None)
        elif len(open_u) >= k:
            out[s] = ("PRESENT", "unique_markers_detected", None)
            for t in targets[s]:
                explained |= {t} | near.get(t, set())
            present.append(s)
        elif not any(t not in shared for t in targets[s]) and not open_u and open_s:
            out[s] = ("AMBIGUOUS", "no_unique_markers", None)
        elif not open_u and not open_s:
            by = {p for t in seen for n in near.get(t, ()) for p in present if (n, p) in own}
            out[s] = ("ABSENT", "cross_reactivity_explained", ",".join(sorted(by)) or None)
        else:
            out[s] = ("AMBIGUOUS", "insufficient_unique_evidence", None)
    return out


def test_species_calls_where_targets_have_several_owners(spark):
    rng = random.Random(8)
    seen = set()
    for k in (1, 2, 1, 1):
        targets = [f"t{i:02d}" for i in range(40)]
        own = {(t, rng.choice("ABCDEFG")) for t in targets for _ in range(rng.choice([1, 1, 2, 3]))}
        owners = {t: {s for x, s in own if x == t} for t in targets}
        pairs = {tuple(sorted(rng.sample(targets, 2))) for _ in range(12)}
        similar = {(a, b) for a, b in pairs if not owners[a] & owners[b]}
        reads = {t: rng.randrange(1, 50) for t in targets if rng.random() < 0.4}
        o = spark.createDataFrame(sorted(own), "target_id string, species_id string")
        edges = Y.cross_species_edges(spark.createDataFrame(sorted(pairs), "target_a string, target_b string"), o)
        assert {(r.target_id, r.similar_id) for r in edges.collect()} == {p for a, b in similar for p in ((a, b), (b, a))}
        got = Y.call_species(edges, o, spark.createDataFrame(sorted(reads.items()), "target_id string, reads long"), k).collect()
        want = calls(own, similar, reads, k)
        assert {r.species_id: (r.call, r.reason, r.explained_by or None) for r in got} == want
        seen |= {v[1] for v in want.values()}
    assert len(seen) >= 3


def test_confusion_matrix_has_all_species(spark):
    own = spark.createDataFrame([("t1", "A"), ("t2", "B"), ("t3", "C")], "target_id string, species_id string")
    edges = Y.cross_species_edges(spark.createDataFrame([("t1", "t2")], "target_a string, target_b string"), own)
    assert {r.species_id: (r.A, r.B, r.C) for r in Y.confusion_matrix(edges, own).collect()} == {"A": (0, 1, 0), "B": (1, 0, 0), "C": (0, 0, 0)}
    with pytest.raises(ValueError):
        Y.confusion_matrix(edges, own, most_species=2)


def test_cover_stops_at_a_fraction(spark):
    def loop(hits, lengths, share):
        bare = {r: set(range(n)) for r, n in lengths.items()}
        probes, out = {p for p, *_ in hits}, []
        while not all((n - len(bare[r])) / n >= share for r, n in lengths.items()):
            gain = {p: sum(len(bare[r] & set(range(s, e))) for r in bare for s, e in [(min((h[2] for h in hits if h[0] == p and h[1] == r), default=0), max((h[3] for h in hits if h[0] == p and h[1] == r), default=0))]) for p in probes}
            best = min(probes, key=lambda p: (-gain[p], p), default=None)
            if best is None or not gain[best]:
                break
            out.append((best, gain[best]))
            probes.discard(best)
            for p, r, s, e in hits:
                if p == best:
                    bare[r] -= set(range(s, e))
        return out

    rng = random.Random(6)
    lengths = {"a": 120, "b": 60}
    hits = [(f"p{i:02d}", r := rng.choice("ab"), s := rng.randrange(lengths[r] - 10), min(lengths[r], s + rng.randrange(5, 30))) for i in range(40)]
    df, refs = spark.createDataFrame(hits, "probe_id string, reference_id string, s long, e long"), spark.createDataFrame(list(lengths.items()), "reference_id string, ref_length long")
    for share in (0.4, 0.7, 1.0):
        got = sorted(((r.probe_id, r.gain) for r in G.greedy_cover(df, refs, share).collect()), key=lambda x: (-x[1], x[0]))
        assert got == loop(hits, lengths, share)
    wide = {(r.probe_id, r.s, r.e) for r in G.extended_hits(df, refs, 7, per_slice=5).collect()}
    assert wide == {(p, max(0, s - 7), min(lengths[r], e + 7)) for p, r, s, e in hits}


def test_gap_details_over_chunks(spark):
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(2 * CHUNK + 5_000))
    targets = spark.createDataFrame([("t", seq), ("u", "ACGTACGT")], "target_id string, seq string")
    refs = targets.select(F.col("target_id").alias("reference_id"), F.length("seq").cast("long").alias("ref_length"))
    make = lambda rows: D.depth_segments(spark.createDataFrame(rows, "reference_id string, s long, e long"), refs)
    got = G.gap_details(make([("t", 100, 300), ("t", 2 * CHUNK + 10, 2 * CHUNK + 20)]), targets, 8, make([("t", 400, 500)])).collect()
    rows = {(r.target_id, r.gap_start): r for r in got}
    assert {k: (r.gap_end, r.is_terminal, r.gap_type) for k, r in rows.items()} == {("t", 1): (100, True, "true_gap"), ("t", 301): (2 * CHUNK + 10, False, "multimapper_gap"), ("t", 2 * CHUNK + 21): (len(seq), True, "true_gap"), ("u", 1): (8, True, "true_gap")}
    assert all(r.gap_sequence == (seq if r.target_id == "t" else "ACGTACGT")[r.gap_start - 1 : r.gap_end] for r in got)
    assert [r.gap_type for r in G.ordered_gaps(G.gap_details(make([("t", 100, 300)]), targets, 8)).collect()] == [None] * 3


def test_results_row_and_documents(spark, small):
    import json

    import __spark_entry__ as entry

    q = entry.queries()
    row = q["k7_results"](spark, small)
    assert tuple(row.columns) == N.RESULTS and len(N.RESULTS) == 36
    doc = json.loads(q["k9_document"](spark, small).collect()[0].document)
    assert list(doc) == ["run_info", "capture_stats", "read_level", "metrics"] and doc["metrics"]["tp_count"] == row.collect()[0].tp_count
    order = [r.classification for r in N.ordered_detail(q["a10_detail_rows"](spark, small)).collect()]
    assert order == sorted(order, key=N.CLASS_ORDER.index)


def test_spread_join_of_heavy_keys(spark):
    left = [("hot", i) for i in range(90)] + [("a", 1), ("b", 2), (None, 3)]
    right = [("hot", i) for i in range(70)] + [("a", 7), ("a", 8), (None, 9)]
    got = spread_join(spark.createDataFrame(left, "w string, x long"), spark.createDataFrame(right, "w string, y long"), "w", per_cell=20)
    rows = [tuple(r) for r in got.select("w", "x", "y").collect()]
    assert len(rows) == len(set(rows)) == 90 * 70 + 2 and set(rows) == {(k, x, y) for k, x in left for m, y in right if k and k == m}


def test_seed_matches_against_brute_force(spark):
    """A word that a fifth of all rows have, matches over a chunk's end, both strands."""
    rng = random.Random(9)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    poly = "A" * 14
    genome = {1: base(CHUNK - 30) + base(60) + base(200), 2: "".join(base(26) + poly for _ in range(12)), 3: "ACGTN", 4: None, 5: ""}
    flip = lambda s: s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    probes = {f"p{i}": genome[2][i : i + 40] for i in range(0, 200, 9)} | {"edge": genome[1][CHUNK - 25 : CHUNK + 15], "back": flip(genome[1][CHUNK - 60 : CHUNK - 10]), "none": None, "n": "N" * 30, "tail": genome[2][-20:] + "ACGTACGTACGTTTT"}
    far = lambda a, b: sum(x != y or x == "N" for x, y in zip(a, b))

    def brute(text):
        out = {}
        for t, g in genome.items():
            for s in range(len(g or "") - len(text) + 1):
                w = g[s : s + len(text)]
                if far(text, w) <= 12 and any(text[k : k + 14] == w[k : k + 14] and "N" not in text[k : k + 14] for k in range(len(text) - 13)):
                    out[t, s] = far(text, w)
        return out

    p, t = spark.createDataFrame(list(probes.items()), "probe_id string, probe string"), spark.createDataFrame(list(genome.items()), "target_id long, seq string")
    got = [tuple(r) for r in seed_matches(p, t, 14, 12, per_cell=5).collect()]
    want = {(k, t_, s, d) for k, text in probes.items() if text for (t_, s), d in brute(text).items()}
    assert len(got) == len(set(got)) and set(got) == want and any(k == "edge" for k, *_ in got)
    both = {(r.probe_id, r.target_id, r.start): (r.distance, r.strand) for r in seed_matches_both_strands(p, t, 14, 12, per_cell=50).collect()}
    want = {}
    for k, text in probes.items():
        for strand, form in (("+", text), ("-", flip(text))) if text else ():
            for (t_, s), d in brute(form).items():
                want[k, t_, s] = min(want.get((k, t_, s), (99, "-")), (d, "+" if form == text else strand))
    assert both == want and ("back", 1, CHUNK - 60) in both

import random
from itertools import combinations

from pyspark.sql import functions as F

from tilewright.operators.minhash import jaccard_estimate, near_duplicates, signature, similar_signatures


def probes():
    rng = random.Random(3)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    texts = [base(90) for _ in range(25)]
    for t in list(texts):
        for _ in range(rng.randrange(4)):
            k = rng.randrange(90)
            texts.append(t[:k] + rng.choice("ACGTN") + t[k + 1 :])
        texts.append(t[rng.randrange(12) :])
    texts += ["A" * 90, "A" * 60, "A" * 89 + "C", texts[0].lower(), texts[0], "ACG", "", "N" * 20, "T" * 7]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(900, None)]


def test_every_pair_and_the_greedy_choice(spark):
    rows = probes()
    df = spark.createDataFrame(rows, "probe_id long, text string")
    sig = {r.probe_id: tuple(r.sig) for r in df.where("text IS NOT NULL").select("probe_id", signature("text").alias("sig")).collect()}
    same = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b]))
    one = {}
    for i in sorted(sig):
        one.setdefault(sig[i], i)
    for threshold in (0.5, 0.8, 0.95, 1.0):
        signed = spark.createDataFrame([(i, list(s)) for s, i in one.items()], "id long, sig array<int>")
        got = [tuple(r) for r in similar_signatures(signed, threshold, per_cell=4).collect()]
        want = {(a, b) for a, b in combinations(sorted(one.values()), 2) if same(a, b) >= threshold * 100}
        assert len(got) == len(set(got)) and set(got) == want
        kept = []
        for i in sorted(sig):
            if not any(same(i, k) >= threshold * 100 for k in kept):
                kept.append(i)
        out = {r.probe_id: (r.class_id, r.kept) for r in near_duplicates(df, "probe_id", "text", threshold, per_cell=4).collect()}
        assert set(out) == set(sig) and sorted(i for i, (_, k) in out.items() if k) == kept
        assert all(c in kept and same(i, c) >= threshold * 100 for i, (c, _) in out.items())


def test_estimate_and_edges(spark):
    df = spark.createDataFrame([("ACGTTGCAACGGTTAACC",)], "s string")
    assert df.select(jaccard_estimate(signature("s"), signature(F.lower("s")))).first()[0] == 1.0
    none = spark.createDataFrame([], "probe_id long, text string")
    assert near_duplicates(none, "probe_id", "text").count() == 0
    assert near_duplicates(spark.createDataFrame([(1, "ACG"), (2, "ACG")], "probe_id long, text string"), "probe_id", "text", 0.0).where("kept").count() == 2

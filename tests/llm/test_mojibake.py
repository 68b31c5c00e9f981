import math
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tilewright.llm.mojibake import BUCKETS, CHAIN_NAMES, CHAINS, LOST, Classifier, Usage, _hash_below, _fitted, find_garbled, garble, restore, train_classifier

SCHEMA = "doc_id long, text string, chain string, restored string"
@pytest.fixture(scope="module")
def docs(spark):
    """Documents that look clean, in two halves: to fit on, and to garble."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    model = train_classifier(df)
    bad = {r.doc_id for r in find_garbled(df, classifier=model).select("doc_id").collect()}
    return model, [(r.doc_id, r.text) for r in df.collect() if r.doc_id not in bad]


def test_held_out_garbled_lines_are_found_and_restored(spark):
    """One line of each document, with two letters beyond ASCII at least, garbled by the chain with the fewest cases so far."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    bad = {r.doc_id for r in find_garbled(df).select("doc_id").collect()}
    clean = sorted((r.doc_id, r.text) for r in df.collect() if r.doc_id not in bad)
    rng = random.Random(5)
    rng.shuffle(clean)
    fit, held = clean[: len(clean) // 2], clean[len(clean) // 2 :]
    model = train_classifier(spark.createDataFrame([(i, t, None, None) for i, t in fit], SCHEMA))
    rows, truth, seen = [(i, text) for i, text in held], {}, Counter()
    for i, text in held:
        lines = text.split("\n")
        at = [k for k, line in enumerate(lines) if len({c for c in line if c > "\x7f" and c.isalpha()}) >= 2]
        if not at:
            continue
        k = rng.choice(at)
        forms = [(c, g) for c, chain in enumerate(CHAINS) if c and (g := garble(lines[k], chain)) and g != lines[k]]
        rng.shuffle(forms)
        for c, g in sorted(forms, key=lambda f: seen[f[0]])[:1]:
            seen[c] += 1
            case = 1_000_000 + len(rows)
            rows.append((case, "\n".join([*lines[:k], g, *lines[k + 1 :]])))
            truth[case] = (c, text, LOST in g)
    found = {r.doc_id: r for r in find_garbled(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA), classifier=model).collect()}
    assert len(truth) > 2000 and len(seen) >= len(CHAINS) - 3
    assert sum(i in found for i in truth) / len(truth) >= 0.995
    assert len(set(found) - set(truth)) <= 0.001 * len(held)
    whole = {i: c for i, (c, _, lossy) in truth.items() if not lossy}
    right = {i for i in whole if i in found and found[i].restored == truth[i][1]}
    assert len(right) / len(whole) >= 0.99
    of_chain, right_of = Counter(whole.values()), Counter(whole[i] for i in right)
    assert {CHAIN_NAMES[c]: (right_of[c], n) for c, n in of_chain.items() if right_of[c] < 0.9 * n} == {}


def test_meant_oddities_are_left_alone(spark, docs):
    model, _ = docs
    meant = ["SÃO PAULO, MAÇÃ", "ÂGE REQUIS : 18", "√2 ≈ 1.414 ∑x ∂y ÷ π Ω", "│   └── v2 ≤ 3", "安녕하세요", "", None, "plain ascii", "x" * 300_000, "😀 👩🏽‍🔬"]
    rows = [(i, t, None, None) for i, t in enumerate(meant)]
    assert find_garbled(spark.createDataFrame(rows, SCHEMA), classifier=model).count() == 0
    assert find_garbled(spark.createDataFrame([], SCHEMA)).count() == 0


def test_replacement_characters_are_found_unrestored(spark, docs):
    model, _ = docs
    r = find_garbled(spark.createDataFrame([(1, "un d�p�t", None, None), (1, "un d�p�t", None, None)], SCHEMA), classifier=model).collect()
    assert [(x.doc_id, x.n_passages, x.n_restored, x.restored) for x in r] == [(1, 1, 0, "un d�p�t")] * 2


def test_chains_invert():
    samples = ["déjà-vu à Noël", "Źródło łąki", "Каждый зонд", "σύμφωνα", "arşivi çayı", "研究室は", "实验室"]
    for chain in CHAINS[1:]:
        for s in samples:
            g = garble(s, chain)
            if g is not None and "�" not in g and (back := restore(g, chain)) is not None:
                assert back == s


def test_one_short_passage_is_enough():
    model = Classifier(np.zeros((len(CHAINS), BUCKETS)), np.zeros((len(CHAINS), BUCKETS)), Usage({}, {}), 0.0, 8.0)
    utf8, other = CHAIN_NAMES.index("utf-8>latin-1"), CHAIN_NAMES.index("cp1251>cp1252")
    # the gain of cafÃ© on sf0.1, where 53 documents have it, so that it is likely as it is, too
    model.known = {"cafÃ©": [(3.8, (utf8,))], "Îí": [(3.8, (other,))], "plain": []}
    assert model.faults([["cafÃ©"], ["Îí", "plain"]]) == [{"cafÃ©": utf8}, {}]


def test_like_chains_share_their_evidence():
    latin, windows, turkish = ((CHAIN_NAMES.index(f"utf-8>{d}")) for d in ("latin-1", "cp1252", "cp1254"))
    model = Classifier(np.zeros((len(CHAINS), BUCKETS)), np.zeros((len(CHAINS), BUCKETS)), Usage({}, {}), 0.0, 8.0)
    model.known = {"Ã¡": [(3.0, (latin, windows, turkish))], "Ã±": [(3.0, (windows, latin))], "Ã³": [(3.0, (turkish, latin))]}
    assert model.faults([["Ã¡", "Ã±"], ["Ã³"]], alone=math.inf) == [dict.fromkeys(["Ã¡", "Ã±"], latin), {"Ã³": latin}]
    assert model.faults([["Ã¡", "Ã±"]], alone=math.inf) == [{}]


def test_chains_of_any_rank_are_tried():
    mac = CHAIN_NAMES.index("utf-8>mac_roman")
    garbled = np.full((len(CHAINS), BUCKETS), 1.0)
    garbled[mac] = 0.5  # likely, but behind all others
    model = Classifier(garbled, np.zeros((len(CHAINS), BUCKETS)), Usage({"©": 100.0}, {" ©": 100.0, "© ": 100.0}), 0.0, 8.0)
    assert mac in model.judge("¬©")[0][1]
    # a lone letter is a frequent sign in one of many encodings
    assert all(gain < 8.0 for gain, _ in model.judge("ß"))


def test_usage_is_counted_over_all_documents(spark):
    rows = [(i, "zażółć gęślą jaźń" if i == 0 else "résumé naïveté", None, None) for i in range(400)] + [(400 + i, "хорошо", None, None) for i in range(5)]
    model = train_classifier(spark.createDataFrame(rows, SCHEMA), sample_docs=40)
    assert model.usage.words == {"résumé": 399.0, "naïveté": 399.0, "хорошо": 5.0}
    assert model.usage.pairs["żó"] == 1.0 and model.usage.pairs["хо"] == 5.0


def test_escapes_of_ascii_encodings(spark, docs):
    model, _ = docs
    texts = ["夜勤の班は箱を保管する", "本网站使用缓存文件", "le café est fermé"]
    rows = [(10 * i + k, f"menu 12\n{t.encode(e).decode()} end\n+4201234567 a+b ~{{x}}", None, None) for i, t in enumerate(texts) for k, e in enumerate(("iso2022_jp", "hz", "utf-7")) if garble(t, ((e, "latin-1"),))]
    rows += [(900, "call +420123456789 or C++ +ABC- ~{name~} $B(B", None, None)]
    found = {r.doc_id: r.restored.split("\n")[1] for r in find_garbled(spark.createDataFrame(rows, SCHEMA), classifier=model).collect()}
    assert found[0] == f"{texts[0]} end" and found[11] == f"{texts[1]} end" and found[22] == f"{texts[2]} end" and 900 not in found


def test_the_sample_never_runs_empty(spark):
    n = 20_000_000
    some = spark.range(n).where(_hash_below(F.col("id"), 20_000 / 1e11 * 1e3)).count()  # a share of 2 in 10,000
    assert 0.7 * n * 2e-4 < some < 1.3 * n * 2e-4
    assert 0 < spark.range(100_000_000).where(_hash_below(F.col("id"), 20_000 / 1e11)).count() < 100
    assert spark.range(10).where(_hash_below(F.col("id"), 1.0)).count() == 10


def test_long_runs_are_counted(spark):
    rows = [(i, "研究室は古い地図を保管する" * 60, None, None) for i in range(5)]
    model = train_classifier(spark.createDataFrame(rows, SCHEMA))
    assert model.usage.pairs["研究"] >= 5 and model.usage.pairs["保管"] >= 5


def test_one_fit_a_session(spark, small):
    read = lambda: spark.read.parquet(f"{small}/documents.parquet")
    assert _fitted(read(), "doc_id", "text") is _fitted(read(), "doc_id", "text")
    assert _fitted(read().limit(3), "doc_id", "text") is not _fitted(read(), "doc_id", "text")

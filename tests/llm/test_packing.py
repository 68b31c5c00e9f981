import bisect
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tilewright.llm.bpe import count_tokens
from tilewright.llm.packing import configurations, pack_items

SCHEMA = "doc_id string, n_tokens int, container_id string, s long"


def check(spark, sizes, capacity=100, least_fill=0.0, **limits):
    rows = [(k, n, "x", 1) for k, n in sizes]
    out = pack_items(spark.createDataFrame(rows, SCHEMA), capacity=capacity, **limits).collect()
    fill, whole = Counter(), {}
    for r in out:
        fill[r.container_id] += r.piece_size
        whole.setdefault(r.doc_id, []).append((r.piece_no, r.piece_start, r.piece_size))
    assert max(fill.values(), default=0) <= capacity
    want = {}
    for k, n in sizes:
        if k is not None:
            want.setdefault(k, []).append(max(0, n or 0))
    assert set(whole) == set(want)
    for k, ns in want.items():
        assert sum(p[2] for p in whole[k]) == sum(ns)
        if len(ns) == 1:
            n, pieces = ns[0], sorted(whole[k])
            assert len(pieces) == max(1, -(-n // capacity)) and [p[1] for p in pieces] == [i * capacity for i in range(len(pieces))]
            assert all(p[2] == capacity for p in pieces[:-1])
    used = sum(1 for v in fill.values() if v)
    total = sum(fill.values())
    if total:
        assert total / (used * capacity) >= least_fill
    return used


def best_fit_decreasing(sizes, capacity):
    rooms, full = [], 0
    for n in sorted((n or 0 for k, n in sizes if k is not None), reverse=True):
        n = max(n, 0)
        if n > capacity:
            full, n = full + n // capacity, n % capacity
        if n:
            k = bisect.bisect_left(rooms, n)
            bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else capacity) - n)
    return full + len(rooms)


def test_mixed_sizes_fill_well(spark):
    rng = random.Random(3)
    sizes = [(f"d{i:05d}", rng.choice([rng.randrange(0, 20), rng.randrange(20, 60), rng.randrange(40, 101), 37])) for i in range(3000)]
    sizes += [(f"o{i}", rng.randrange(101, 900)) for i in range(40)] + [("none", None), (None, 5), ("neg", -3)]
    assert check(spark, sizes) <= 1.01 * best_fit_decreasing(sizes, 100) + 1
    assert check(spark, sizes, small=12, groups=24) <= 1.08 * best_fit_decreasing(sizes, 100)


def test_only_small_only_large_only_equal(spark):
    check(spark, [(f"d{i}", 7) for i in range(500)], small=12, least_fill=0.9)
    check(spark, [(f"d{i}", 51) for i in range(200)], small=12)
    check(spark, [(f"d{i}", 50) for i in range(200)], small=12, least_fill=1.0)
    check(spark, [(f"d{i}", 100) for i in range(20)] + [("x", 200)], small=12, least_fill=1.0)


def test_empty_zero_and_repeated(spark):
    check(spark, [])
    check(spark, [("a", 0), ("b", None)])
    check(spark, [("a", 30)] * 50 + [("b", 250)] * 3, small=12)
    check(spark, [("a", 1)])


def test_configurations_cover_exactly():
    rng = np.random.default_rng(1)
    for _ in range(20):
        width = np.unique(rng.integers(13, 101, 9))
        need = rng.integers(1, 400, len(width))
        plan = configurations(width, need, 100)
        assert (sum(t * c for t, c in plan) == need).all() and all((c * width).sum() <= 100 for _, c in plan)
        assert sum(t for t, _ in plan) <= np.ceil((need * width).sum() / 100) * 1.35 + len(width)


def test_fill_of_the_documents(spark):
    """Tokens of real texts: hardly more containers than their sum needs, or than best fit decreasing takes."""
    sized = count_tokens(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "/opt/tokenizers/byte_bpe_50k.json").persist()
    sizes = [(r.doc_id, r.n_tokens) for r in sized.collect()]
    used = pack_items(sized, capacity=2048).where("piece_size > 0").agg(F.countDistinct("container_id")).first()[0]
    sized.unpersist()
    least = -(-sum(n or 0 for _, n in sizes) // 2048)
    assert used <= 1.01 * least + 1 and used <= 1.003 * best_fit_decreasing(sizes, 2048) + 1

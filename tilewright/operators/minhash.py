"""Near-duplicate probes by MinHash signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.operators.skew import salted_join, spread_join
from tilewright.scratch import drop_table, materialize, write_table

#: Number of hash functions, letters of a word, and the prime modulus.
HASHES, WORD, PRIME = 100, 8, 2_147_483_647
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def signature(seq: Column | str, seed: int = 42) -> Column:
    """ARRAY<INT>: the least value of each hash function over the words of 8 bases; all PRIME without such a word; null for null."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, PRIME, HASHES)[:, None], rng.integers(0, PRIME, HASHES)[:, None]

    def of(text: str) -> np.ndarray:
        base = _CODE[np.frombuffer(text.upper().encode("ascii", "replace"), np.uint8)]
        n = len(base) - WORD + 1
        if n <= 0:
            return np.full(HASHES, PRIME, np.int32)
        word, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(WORD):
            word, whole = word * 4 + np.maximum(base[k : k + n], 0), whole & (base[k : k + n] >= 0)
        words = np.unique(word[whole])
        least = np.full((HASHES, 1), PRIME, np.int64)
        for lo in range(0, len(words), 10_000):
            least = np.minimum(least, ((a * words[lo : lo + 10_000] + b) % PRIME).min(axis=1, keepdims=True))
        return least[:, 0].astype(np.int32)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else of(t) for t in batch], dtype=object)

    return sign(F.col(seq) if isinstance(seq, str) else seq)


def jaccard_estimate(one: Column | str, two: Column | str) -> Column:
    """Share of the places at which two signatures are equal."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (one, two))
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x) / F.size(a)


def similar_signatures(signed: DataFrame, threshold: float, per_cell: int = 10_000) -> DataFrame:
    """(a, b) with a < b: pairs of rows of signed (id, sig), one row for each signature, that agree on at least the threshold's share of places.

    Two such signatures differ at few enough places that of one more bands than those at
    least one is the same in both; so bands meet by equality and no pair is missed. Rows of
    a band that is frequent meet in cells of per_cell by per_cell.
    """
    need = math.ceil(threshold * HASHES - 1e-9)
    bands = min(HASHES, HASHES - need + 1)
    edge = [HASHES * k // bands for k in range(bands + 1)]
    parts = F.array(*[F.xxhash64(F.lit(k), F.slice("sig", edge[k] + 1, edge[k + 1] - edge[k])) for k in range(bands)])
    banded = materialize(signed.select("id", F.explode(parts).alias("band")), "bands")
    met = spread_join(banded.select("band", F.col("id").alias("a")), banded.select("band", F.col("id").alias("b")), "band", per_cell)
    pairs = materialize(met.where("a < b").select("a", "b").distinct(), "candidates")
    for side in ("a", "b"):  # an id with very many pairs is cut into slices
        counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        pairs = salted_join(pairs, signed.select(F.col("id").alias(side), F.col("sig").alias(f"sig_{side}")), [side], counts, "n")
    return pairs.where(jaccard_estimate("sig_a", "sig_b") * HASHES >= need - 0.5).select("a", "b")


def near_duplicates(probes: DataFrame, probe_id: str, probe: str, threshold: float = 0.8, per_cell: int = 10_000) -> DataFrame:
    """(probe_id, class_id, kept): every probe with the kept one that it is a near copy of, itself if it is kept.

    Probes are taken in the order of their ids; one is kept unless its signature agrees with
    that of a kept one before it on the threshold's share of places. Null probes are left
    out; equal texts and equal signatures are one and stand for all their ids, so copies are
    never paired. A threshold of 0 or less keeps all. Each round decides the probes whose
    neighbours before them are decided, the first of those left always, so the rounds end;
    a chain of probes each like the next takes as many rounds as half its length.
    """
    rows = probes.select(F.col(probe_id).alias("id"), F.upper(F.col(probe)).alias("text")).dropna()
    if threshold <= 0:
        return rows.select(F.col("id").alias(probe_id), F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    texts = rows.groupBy("text").agg(F.min("id").alias("id"))
    signed = materialize(texts.select("text", "id", signature("text").alias("sig")), "signed")
    whole = materialize(signed.groupBy("sig").agg(F.min("id").alias("id")), "signatures")
    links, links_at = write_table(similar_signatures(whole, threshold, per_cell), "links")
    ids = whole.select("id")
    state, state_at = write_table(ids.join(links.select(F.col("b").alias("id")).distinct().withColumn("later", F.lit(1)), "id", "left").select("id", F.when(F.col("later").isNull(), True).alias("kept")), "kept")
    while not state.where("kept IS NULL").isEmpty():
        seen = links.join(state.select(F.col("id").alias("a"), F.col("kept").alias("before")), "a")
        sums = seen.groupBy(F.col("b").alias("id")).agg(F.max(F.col("before").eqNullSafe(True)).alias("near"), F.max(F.col("before").isNull()).alias("open"))
        now = state.join(sums, "id", "left").select("id", F.coalesce("kept", F.when(F.col("near"), False).when(~F.col("open"), True)).alias("kept"))
        following, following_at = write_table(now, "kept")
        drop_table(state.sparkSession, state_at)
        state, state_at = following, following_at
    kept = state.where("kept").select(F.col("id").alias("a"))
    nearest = links.join(kept, "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("first"))
    classes = state.join(nearest, "id", "left").select("id", F.when(F.col("kept"), F.col("id")).otherwise(F.col("first")).alias("class_id"), "kept")
    of_text = signed.select("text", "sig").join(whole.withColumnRenamed("id", "rep"), "sig").select("text", "rep").join(classes.withColumnRenamed("id", "rep"), "rep").select("text", "class_id")
    counts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    named = salted_join(rows, of_text, ["text"], counts, "n")
    return named.select(F.col("id").alias(probe_id), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))

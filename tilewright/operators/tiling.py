"""Cutting sequences into probes and k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.sequence import hamming_n, reverse_complement
from tilewright.operators.skew import spread_join
from tilewright.scratch import materialize


def _starts(length: Column, size: int, stride: int, anchored: bool = True) -> Column:
    """Every stride-th start from 0 that fits, and the last start that does; null where the size doesn't fit."""
    last = length - size
    steps = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    return F.when(last >= 0, F.array_distinct(F.concat(steps, F.array(last))) if anchored else steps)


def tile_probes(seqs: DataFrame, seq_id: str, seq: str, probe_length: int, step: int = 0) -> DataFrame:
    """(seq_id, tile, start, probe_id, probe): probes every probe_length + step bases, the last one ending with the sequence.

    A sequence no longer than a probe is one tile; null and empty ones give none. Sequences
    are cut within their row, so a very long one needs a row's memory only.
    """
    stride = probe_length + step
    if stride <= 0:
        raise ValueError("probe_length + step must be above 0")
    upper = F.upper(F.col(seq))
    rows = seqs.select(F.col(seq_id).alias("seq_id"), upper.alias("s")).where(F.length("s") > 0)
    starts = F.when(F.length("s") <= probe_length, F.array(F.lit(0))).otherwise(_starts(F.length("s"), probe_length, stride))
    tiles = rows.select("seq_id", "s", F.posexplode(starts).alias("k", "start"))
    name = F.concat(F.lit("probe_"), F.col("seq_id").cast("string"), F.lit("|tile_"), (F.col("k") + 1).cast("string"))
    return tiles.select(F.col("seq_id").alias(seq_id), (F.col("k") + 1).cast("long").alias("tile"), F.col("start").cast("long").alias("start"), name.alias("probe_id"), F.substring(F.col("s"), F.col("start") + 1, F.lit(probe_length)).alias("probe"))


def enumerate_kmers(seqs: DataFrame, seq_id: str, seq: str, k: int, step: int = 1) -> DataFrame:
    """(seq_id, start, kmer): k-mers every step bases and the one at the end, without those of more than k / 2 N."""
    upper = F.upper(F.col(seq))
    rows = seqs.select(F.col(seq_id).alias("seq_id"), upper.alias("s")).where(F.length("s") >= k)
    found = rows.select("seq_id", "s", F.explode(_starts(F.length("s"), k, max(1, step))).alias("start"))
    kmers = found.select(F.col("seq_id").alias(seq_id), F.col("start").cast("long").alias("start"), F.substring(F.col("s"), F.col("start") + 1, F.lit(k)).alias("kmer"))
    return kmers.where(F.length(F.regexp_replace("kmer", "[^N]", "")) <= k // 2)


def candidate_probes(seqs: DataFrame, seq_id: str, seq: str, probe_length: int, stride: int) -> DataFrame:
    """(probe, seq_id, start): the distinct tiles of all sequences with where each occurs first, in the order of (seq_id, start)."""
    tiles = enumerate_kmers(seqs, seq_id, seq, probe_length, stride)
    first = F.min(F.struct(F.col(seq_id).alias("seq_id"), F.col("start").alias("start"))).alias("first")
    return tiles.groupBy(F.col("kmer").alias("probe")).agg(first).select("probe", F.col("first.seq_id").alias(seq_id), "first.start")


#: Bases of a target that one row holds.
CHUNK = 10_000
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def chunked(targets: DataFrame, overlap: Column) -> DataFrame:
    """(target_id, chunk, t_len, text): targets in pieces of CHUNK bases, each with what follows it as far as overlap."""
    rows = targets.where(F.length("seq") > 0).select("target_id", F.upper("seq").alias("seq"), F.length("seq").alias("t_len"))
    cut = rows.select("target_id", "t_len", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.col("t_len") - 1) / CHUNK).cast("int"))).alias("chunk"))
    return cut.select("target_id", "chunk", "t_len", F.substring(F.col("seq"), F.col("chunk") * CHUNK + 1, F.lit(CHUNK) + overlap).alias("text"))


def _seeds(df: DataFrame, text: str, seed: int, most: int | None = None) -> DataFrame:
    """df, without text, with a row for each seed of text that is all bases: its place, and its letters as a number, two bits each."""
    shape = T.StructType([*(f for f in df.schema if f.name != text), T.StructField("at", T.IntegerType()), T.StructField("word", T.LongType())])
    column = df.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rest = batch.column(column).to_pylist(), batch.select([c for c in batch.schema.names if c != text])
            size = np.array([len(t) if t else 0 for t in texts], np.int64)
            start = np.cumsum(size + 1) - size - 1
            base = _CODE[np.frombuffer("".join(f"{t or ''}\n" for t in texts).encode("ascii", "replace"), np.uint8)]
            n = len(base) - seed + 1
            if n <= 0:
                continue
            word, whole = np.zeros(n, np.int64), np.ones(n, bool)
            for k in range(seed):
                here = base[k : k + n]
                word = word << 2 | np.maximum(here, 0)
                whole &= here >= 0
            found = np.flatnonzero(whole)
            row = np.searchsorted(start, found, side="right") - 1
            at = found - start[row]
            if most is not None:
                near = at < most
                found, row, at = found[near], row[near], at[near]
            for lo in range(0, len(found), 100_000):
                part = slice(lo, lo + 100_000)
                taken = rest.take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at[part].astype(np.int32)), pa.array(word[found[part]])], names=[*rest.schema.names, "at", "word"])

    return df.mapInArrow(cut, shape)


def seed_matches(probes: DataFrame, targets: DataFrame, seed: int, mismatches: int, per_cell: int = 10_000) -> DataFrame:
    """(probe_id, target_id, start, distance): ungapped places of probes on targets that share a seed in place.

    probes: (probe_id, probe); targets: (target_id, seq), one row each. Each overlapping
    seed of a probe meets the same word of a target by equality; a place found by several
    seeds counts once, and is kept if the probe fits in the target and the N-aware distance
    over the whole probe is at most mismatches. Equal probe texts are matched once and their
    ids joined back. Seeds, of 31 letters at most, with other letters than A, C, G and T
    don't count. Null and short texts match nothing; an empty table gives an empty result.
    Probes are matched as written; seed_matches_both_strands has the other strand too.

    Targets are cut into overlapping chunks, so a row holds CHUNK bases however long a
    target is, and a place meets its own chunk only. A word that is frequent on either side
    is cut into cells of per_cell by per_cell rows.
    """
    if not 0 < seed <= 31:
        raise ValueError("a seed has 1 to 31 letters")
    texts = probes.select(F.upper("probe").alias("probe")).where(F.length("probe") >= seed).distinct()
    texts = materialize(texts.select("probe", F.length("probe").alias("size"), F.monotonically_increasing_id().alias("text_id")), "texts")
    longest = F.coalesce(texts.agg(F.max("size")).scalar(), F.lit(seed))
    pieces = chunked(targets, longest)
    own = materialize(_seeds(texts, "probe", seed), "seeds")
    theirs = _seeds(pieces.select("target_id", "t_len", "chunk", F.substring("text", 1, CHUNK + seed - 1).alias("text")), "text", seed)
    theirs = materialize(theirs.select("target_id", "t_len", "word", (F.col("chunk").cast("long") * CHUNK + F.col("at")).alias("t_at")), "seeds")
    met = spread_join(own, theirs, "word", per_cell).withColumn("start", F.col("t_at") - F.col("at"))
    places = met.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("t_len"))).select("text_id", "size", "target_id", "start").distinct()
    there = pieces.select(F.col("target_id"), F.col("chunk"), "text")
    window = places.withColumn("chunk", F.floor(F.col("start") / CHUNK).cast("int")).join(there, ["target_id", "chunk"])
    window = window.select("text_id", "target_id", "start", F.substring(F.col("text"), (F.pmod(F.col("start"), F.lit(CHUNK)) + 1).cast("int"), F.col("size")).alias("window"))
    near = window.join(texts.select("text_id", "probe"), "text_id").withColumn("distance", hamming_n("probe", "window")).where(F.col("distance") <= mismatches).select("probe", "target_id", "start", "distance")
    return near.join(probes.select("probe_id", F.upper("probe").alias("probe")), "probe").select("probe_id", "target_id", "start", "distance")


def seed_matches_both_strands(probes: DataFrame, targets: DataFrame, seed: int, mismatches: int, per_cell: int = 10_000) -> DataFrame:
    """(probe_id, target_id, strand, start, distance): seed_matches of each probe as written (+) and of its reverse complement (-).

    start counts on the target as it is written. A place counts once, with the nearer
    strand, or + if both are as near. The texts of both strands are matched in one pass.
    """
    both = probes.select("probe_id", F.upper("probe").alias("probe")).select("probe_id", F.explode(F.array_distinct(F.array(F.struct(F.col("probe").alias("text"), F.col("probe").alias("own")), F.struct(reverse_complement("probe").alias("text"), F.col("probe").alias("own"))))).alias("p"))
    strand = F.when(F.col("p.text") == F.col("p.own"), "+").otherwise("-")
    keyed = both.select(F.struct("probe_id", strand.alias("strand")).alias("probe_id"), F.col("p.text").alias("probe")).distinct()
    found = seed_matches(keyed, targets, seed, mismatches, per_cell)
    nearest = found.groupBy("probe_id.probe_id", "target_id", "start").agg(F.min(F.struct("distance", "probe_id.strand")).alias("m"))
    return nearest.select("probe_id", "target_id", "m.strand", "start", "m.distance")

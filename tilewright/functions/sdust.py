"""Low-complexity masking of sequences by the triplets in a window, a batch of sequences at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.sequence import col

_CODE = np.full(256, -1, np.int64)
for _k, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _k


#: Bases of a long sequence that are looked at in one go.
PIECE = 1_000_000


class _Batch:
    """Sequences laid end to end, with a break after each; triplets by the place where they begin."""

    def __init__(self, seqs: list[str]):
        data = np.frombuffer(("\n".join(seqs) + "\n\n\n").encode("ascii", "replace"), np.uint8)
        base = _CODE[data]
        self.length = np.array([len(s) for s in seqs], np.int64)
        self.start = np.cumsum(self.length + 1) - self.length - 1
        self.size = len(data) - 2
        a, b, c = base[:-2], base[1:-1], base[2:]
        self.triplet = np.where((a >= 0) & (b >= 0) & (c >= 0), 16 * a + 4 * b + c, -1)

    def stretches(self, most: int, broken: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For d = 1, 2, ..: (d, pairs of equal triplets among the d + 1 from each place, whether all of them are bases).

        The pairs of a stretch are those of its two parts without the last and without the
        first triplet, less what both have, and the pair of the first and the last.
        """
        t, n = self.triplet, self.size
        valid = t >= 0
        shorter, pairs, whole = np.zeros(n, np.int64), np.zeros(n, np.int64), valid
        for d in range(1, min(most, n - 1) + 1):
            longer = pairs[:-1] + pairs[1:] + ((t[:-d] == t[d:]) & valid[d:])
            if d > 1:
                longer -= shorter[1:-1]
            whole = whole[:-1] & valid[d:]
            if not (broken or whole.any()):
                return
            yield d, longer, whole
            shorter, pairs = pairs, longer


def dust_masks(seqs: list[str], threshold: float = 2.0, window: int = 64) -> list[list[tuple[int, int]]]:
    """Masked intervals of each sequence, merged where they overlap or touch.

    A stretch of at most window bases scores its pairs of equal triplets over its number of
    triplets less one. It is masked if that exceeds the threshold and no stretch inside it
    scores higher. Letters other than A, C, G, T end a stretch.
    """
    if any(len(s) > PIECE + window for s in seqs):
        return _in_pieces(seqs, threshold, window)
    batch = _Batch(seqs)
    edge = np.zeros(batch.size + 3, np.int64)
    best = np.zeros(batch.size)
    for d, pairs, whole in batch.stretches(window - 3):
        score = pairs / d
        best = np.maximum(np.maximum(best[:-1], best[1:]), np.where(whole, score, 0))
        at = np.flatnonzero(whole & (score > threshold) & (score >= best))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + d + 3, -1)
    covered = np.append(np.cumsum(edge) > 0, False).astype(np.int8)
    change = np.diff(np.append(0, covered))
    s, e = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    owner = np.searchsorted(batch.start, s, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in seqs]
    for k, a, b in zip(owner.tolist(), s.tolist(), e.tolist()):
        out[k].append((a - int(batch.start[k]), b - int(batch.start[k])))
    return out


def _in_pieces(seqs: list[str], threshold: float, window: int) -> list[list[tuple[int, int]]]:
    """dust_masks of long sequences in pieces, each with a window less one of what follows, so that every stretch lies whole in one."""
    out = []
    for s in seqs:
        spans = sorted((a + k, b + k) for k in range(0, max(1, len(s)), PIECE) for a, b in dust_masks([s[k : k + PIECE + window - 1]], threshold, window)[0])
        merged: list[tuple[int, int]] = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out.append(merged)
    return out


def _over_batches(convert, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whole batches in pieces of about a million bases, nulls as they are."""
    for batch in batches:
        values, done, piece, size = batch.tolist(), [], [], 0
        for v in values:
            piece.append(v or "")
            size += len(piece[-1])
            if size > 1_000_000:
                done += convert(piece)
                piece, size = [], 0
        if piece:
            done += convert(piece)
        yield pd.Series(done, dtype=object)


_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))


def sdust(seq: Column | str, threshold: float = 2.0, window: int = 64) -> Column:
    """ARRAY<STRUCT<s, e>> of the masked intervals; empty for null and empty sequences."""

    @F.pandas_udf(_SPANS)
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _over_batches(lambda seqs: [[{"s": a, "e": b} for a, b in spans] for spans in dust_masks(seqs, threshold, window)], batches)

    return mask(col(seq))


def masked_fraction(seq: Column | str, threshold: float = 2.0, window: int = 64) -> Column:
    """Masked bases over the length; 0 for an empty sequence."""
    masked = F.aggregate(sdust(seq, threshold, window), F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    n = F.length(col(seq))
    return F.when(n > 0, masked / n).otherwise(F.when(n.isNotNull(), F.lit(0.0)))


def _window_scores(seqs: list[str], window: int) -> list[np.ndarray]:
    """Score of each window of each sequence, from left to right; one window for a sequence that is shorter."""
    if any(len(s) > PIECE + window for s in seqs):
        cut = [[s[k : k + PIECE + window - 1] for k in range(0, max(1, len(s) - window + 1), PIECE)] for s in seqs]
        return [np.concatenate([_window_scores([p], window)[0] for p in pieces]) for pieces in cut]
    batch = _Batch(seqs)
    triplets = np.minimum(batch.length, window) - 2
    wanted = set((triplets - 1)[triplets > 1].tolist())
    valid = np.append(0, np.cumsum(batch.triplet >= 0))
    out = [np.zeros(max(1, n - window + 1)) for n in batch.length.tolist()]
    for d, pairs, _ in batch.stretches(window - 3, broken=True):
        if d not in wanted:
            continue
        for k in np.flatnonzero(triplets - 1 == d).tolist():
            at = int(batch.start[k]) + np.arange(len(out[k]))
            n = valid[at + d + 1] - valid[at]
            out[k] = np.where(n > 1, pairs[at] / np.maximum(n - 1, 1), 0.0)
    return out


_MEANS = T.StructType([T.StructField("mean_score", T.DoubleType()), T.StructField("mean_below", T.DoubleType())])


def dust_scores(seq: Column | str, threshold: float = 2.0, window: int = 64) -> Column:
    """STRUCT<mean_score, mean_below>: mean over positions of the score of the window centred there, moved inside the sequence; and of the scores below the threshold. 0 where there are none."""

    def means(seqs: list[str]) -> list[dict]:
        out = []
        for s, scores in zip(seqs, _window_scores(seqs, window)):
            at = np.clip(np.arange(len(s)) - window // 2, 0, len(scores) - 1)
            each = scores[at]
            low = each[each < threshold]
            out.append({"mean_score": float(each.mean()) if len(each) else 0.0, "mean_below": float(low.mean()) if len(low) else 0.0})
        return out

    @F.pandas_udf(_MEANS)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in _over_batches(means, batches):
            yield pd.DataFrame(batch.tolist(), columns=["mean_score", "mean_below"])

    return score(col(seq))


def window_score(seq: Column | str, window: int = 64) -> Column:
    """Score of a sequence's first window: pairs of equal triplets over their number less one; 0 below two triplets or for null."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in _over_batches(lambda seqs: [float(x[0]) for x in _window_scores(seqs, window)], batches):
            yield batch.astype(float)

    return score(col(seq))


def window_scores(seq: Column | str, window: int = 64) -> Column:
    """ARRAY<DOUBLE> of the scores of all of a sequence's windows, from left to right; one for a sequence that is shorter than a window."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _over_batches(lambda seqs: _window_scores(seqs, window), batches)

    return score(col(seq))


def masked_text(seq: Column | str, threshold: float = 2.0, window: int = 64) -> Column:
    """The sequence with its masked bases in lower case and the others in upper case; null for null."""

    def cover(s: str, spans: list[tuple[int, int]]) -> str:
        parts, at, s = [], 0, s.upper()
        for a, b in spans:
            parts += [s[at:a], s[a:b].lower()]
            at = b
        return "".join([*parts, s[at:]])

    @F.pandas_udf(T.StringType())
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _over_batches(lambda seqs: [cover(s, spans) for s, spans in zip(seqs, dust_masks(seqs, threshold, window))], batches)

    return F.when(col(seq).isNotNull(), mask(col(seq)))

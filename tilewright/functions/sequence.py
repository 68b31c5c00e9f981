"""Column functions on nucleotide strings. A null input gives null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def source_id(name: Column | str) -> Column:
    """First token of a read name up to its last `_fragment_`; null where there is none."""
    return F.nullif(F.regexp_extract(col(name), r"^(\S*)_fragment_", 1), F.lit(""))


def reverse_complement(seq: Column | str) -> Column:
    """Upper case; anything but A, C, G, T becomes N."""
    return F.translate(F.reverse(F.regexp_replace(F.upper(col(seq)), "[^ACGT]", "N")), "ACGT", "TGCA")


def _count(seq: Column | str, letters: str) -> Column:
    return F.length(F.regexp_replace(col(seq), f"[^{letters}]", ""))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.when(whole.isNotNull(), F.lit(0.0)))


def gc_fraction(seq: Column | str) -> Column:
    """G and C over the length, 0 for an empty sequence."""
    return _share(_count(seq, "GCgc"), F.length(col(seq)))


def gc_content(seq: Column | str) -> Column:
    """G and C over A, C, G and T, 0 where there are none."""
    return _share(_count(seq, "GCgc"), _count(seq, "ACGTacgt"))


def n_fraction(seq: Column | str) -> Column:
    """Everything but A, C, G, T over the length, 0 for an empty sequence."""
    return _share(F.length(col(seq)) - _count(seq, "ACGTacgt"), F.length(col(seq)))


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts laid end to end, in upper case, and the length of each."""
    size = np.array([len(t) if t else 0 for t in texts], np.int64)
    data = np.frombuffer("".join(t for t in texts if t).encode("ascii", "replace"), np.uint8)
    return np.where((data >= 97) & (data <= 122), data - 32, data), size


@F.pandas_udf(T.IntegerType())
def _hamming_n(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for one, two in batches:
        (a, n_a), (b, n_b) = letters(list(one)), letters(list(two))
        n = np.minimum(n_a, n_b)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = a[np.repeat(np.cumsum(n_a) - n_a, n) + k], b[np.repeat(np.cumsum(n_b) - n_b, n) + k]
        unlike = np.append(0, np.cumsum((x != y) | (x == ord("N"))))
        end = np.cumsum(n)
        found = pd.Series(unlike[end] - unlike[end - n], dtype="Int32")
        yield found.mask((one.isna() | two.isna()).reset_index(drop=True))


def hamming_n(a: Column | str, b: Column | str) -> Column:
    """Mismatches over the shorter length; an N on either side always is one."""
    return _hamming_n(col(a), col(b))


def fix_n(seq: Column | str) -> Column:
    """Each N takes the first of T, A, C, G that differs from its neighbours: the left one as fixed, the right one as it was.

    Inside a run of N only the left neighbour counts, so T and A take turns; a run's last
    letter is chosen by both. The sequence is split where such runs begin and end.
    """
    parts = F.split(col(seq), "(?<=N)(?=[^N])|(?<=[^N])(?=N)")

    def fixed(part: Column, i: Column) -> Column:
        left, right = F.substring(F.coalesce(F.get(parts, i - 1), F.lit("")), -1, 1), F.substring(F.coalesce(F.get(parts, i + 1), F.lit("")), 1, 1)
        n = F.length(part) - 1
        turns = F.when(left == "T", F.repeat(F.lit("AT"), (n / 2).cast("int") + 1)).otherwise(F.repeat(F.lit("TA"), (n / 2).cast("int") + 1))
        inner = F.substring(turns, F.lit(1), n)
        before = F.when(n > 0, F.substring(turns, n, F.lit(1))).otherwise(left)
        fits = lambda b: (before != b) & (right != b)
        last = F.when(fits("T"), "T").when(fits("A"), "A").otherwise("C")
        return F.when(F.startswith(part, F.lit("N")), F.concat(inner, last)).otherwise(part)

    return F.array_join(F.transform(parts, fixed), "")


def kmer_code(kmer: Column | str) -> Column:
    """Base-4 number of a k-mer of A, C, G, T, up to 31 letters; null for other letters."""
    k = F.upper(col(kmer))
    return F.when(k.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(k, "ACGT", "0123"), 4, 10).cast("long"))


def ct_to_target_fraction(ct: Column | str, base_ct: float = 20.0, base_fraction: float = 0.01, efficiency: float = 1.0) -> Column:
    """Share of target molecules at a CT value, by exponential amplification from a calibrated point."""
    return F.lit(base_fraction) * F.pow(F.lit(1.0 + efficiency), F.lit(base_ct) - col(ct))


def ct_to_distractor_fraction(ct: Column | str, base_ct: float = 20.0, base_fraction: float = 0.01, efficiency: float = 1.0) -> Column:
    """One less the target fraction; null where that fraction is not inside (0, 1), which calibrated runs must reject."""
    target = ct_to_target_fraction(ct, base_ct, base_fraction, efficiency)
    return F.when((target > 0) & (target < 1), F.lit(1.0) - target)


def calibrate_efficiency(ct1: float, fraction1: float, ct2: float, fraction2: float) -> float:
    """Amplification efficiency through two calibration points; it must come out in (0, 1]."""
    if ct1 == ct2 or not (0 < fraction1 < 1 and 0 < fraction2 < 1):
        raise ValueError("calibration needs two distinct CT values and fractions inside (0, 1)")
    efficiency = (fraction1 / fraction2) ** (1.0 / (ct2 - ct1)) - 1.0
    if not 0 < efficiency <= 1:
        raise ValueError(f"efficiency {efficiency:.4g} is outside (0, 1]")
    return efficiency


def resolve_distractor_fraction(fraction: float | None = None, ct: float | None = None, base_ct: float = 20.0, base_fraction: float = 0.01, efficiency: float = 1.0) -> float:
    """The share of distractors of a run: from its CT value if there is one, else as given in [0, 1], else 0.9."""
    if ct is not None:
        target = base_fraction * (1.0 + efficiency) ** (base_ct - ct)
        if not 0 < target < 1:
            raise ValueError(f"a CT of {ct} gives a target share of {target:.4g}, outside (0, 1)")
        return 1.0 - target
    share = 0.9 if fraction is None else fraction
    if not 0 <= share <= 1:
        raise ValueError("the distractor fraction must lie in [0, 1]")
    return share

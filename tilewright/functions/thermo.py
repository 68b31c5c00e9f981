"""Nearest-neighbour duplex energies as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.sequence import col, letters

#: Fixed values (SantaLucia 1998): enthalpy kcal/mol and entropy cal/(mol K) of a stack, by its two bases from 5' to 3'.
STACKS = {
    "AA": (-7.9, -22.2), "AC": (-8.4, -22.4), "AG": (-7.8, -21.0), "AT": (-7.2, -20.4),
    "CA": (-8.5, -22.7), "CC": (-8.0, -19.9), "CG": (-10.6, -27.2), "CT": (-7.8, -21.0),
    "GA": (-8.2, -22.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "GT": (-8.4, -22.4),
    "TA": (-7.2, -21.3), "TC": (-8.2, -22.2), "TG": (-8.5, -22.7), "TT": (-7.9, -22.2),
}
#: Initiation at an end of the duplex, and the gas constant in kcal/(mol K).
INITIATION = {"GC": (0.1, -2.8), "AT": (2.3, 4.1)}
SALT, GAS = 0.368, 1.98720425864e-3


_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_STACK = np.array([STACKS[a + b] for a in "ACGT" for b in "ACGT"])
_END = np.array([INITIATION["GC" if b in "GC" else "AT"] for b in "ACGT"])


_SUMS = T.StructType([T.StructField("stacks", T.LongType()), T.StructField("bases", T.LongType()), T.StructField("enthalpy", T.DoubleType()), T.StructField("entropy", T.DoubleType())])


@F.pandas_udf(_SUMS)
def _sums(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Of the pairs of each row: neighbours and bases, and the sums over stacks and both ends."""
    for paired in batches:
        data, size = letters(list(paired))
        n = len(size)
        row, code = np.repeat(np.arange(n), size), _CODE[data]
        stacked = np.flatnonzero((row[:-1] == row[1:]) & (code[:-1] >= 0) & (code[1:] >= 0))
        values = _STACK[4 * code[stacked] + code[stacked + 1]]
        sums = [np.bincount(row[stacked], weights=values[:, k], minlength=n).astype(float) for k in (0, 1)]  # whole numbers if there is no stack
        based = np.flatnonzero(code >= 0)
        owner = row[based]
        for at in (np.append(True, owner[1:] != owner[:-1])[: len(owner)], np.append(owner[1:] != owner[:-1], True)[-len(owner) :] if len(owner) else []):
            ends = based[np.flatnonzero(at)]
            for k in (0, 1):
                sums[k][row[ends]] += _END[code[ends], k]
        yield pd.DataFrame({"stacks": np.bincount(row[stacked], minlength=n), "bases": np.bincount(owner, minlength=n), "enthalpy": sums[0], "entropy": sums[1]})


def delta_g(paired: Column | str, temp_c: Column | float, na_molar: Column | float) -> Column:
    """Free energy (kcal/mol) of a duplex, from the bases that pair (N where they don't).

    Stacks are summed over neighbouring pairs. Both ends' initiation and the salt correction
    of the entropy count only if there is a stack at all; without one the energy is 0. The
    sums don't depend on temperature and salt, and are made for a batch of rows at once.
    """
    s = col(paired)
    temp_k = (temp_c if isinstance(temp_c, Column) else F.lit(float(temp_c))) + F.lit(273.15)
    salt = F.ln(na_molar if isinstance(na_molar, Column) else F.lit(float(na_molar)))
    x = _sums(s)
    entropy = x["entropy"] + F.lit(SALT) * (x["bases"] - 1) * salt
    return F.when(s.isNotNull(), F.when(x["stacks"] > 0, x["enthalpy"] - temp_k * entropy / 1000).otherwise(F.lit(0.0)))


def boltzmann_score(energy: Column | str, temp_c: Column | float) -> Column:
    """exp(-dG / RT), at least 1: binding only ever enriches."""
    temp_k = (temp_c if isinstance(temp_c, Column) else F.lit(float(temp_c))) + F.lit(273.15)
    return F.greatest(F.lit(1.0), F.exp(-col(energy) / (F.lit(GAS) * temp_k)))

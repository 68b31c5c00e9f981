"""Column functions on SAM fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.sequence import col

UNMAPPED, SECONDARY, SUPPLEMENTARY = 0x4, 0x100, 0x800

_OPS = r"([0-9]+)([MIDNSHP=X])"


def cigar_ops(cigar: Column | str) -> Column:
    """ARRAY<STRUCT<len BIGINT, op STRING>>; unknown operations are left out."""
    c = col(cigar)
    lens, ops = F.regexp_extract_all(c, F.lit(_OPS), F.lit(1)), F.regexp_extract_all(c, F.lit(_OPS), F.lit(2))
    return F.zip_with(lens, ops, lambda n, op: F.struct(n.cast("long").alias("len"), op.alias("op")))


def cigar_ref_length(cigar: Column | str) -> Column:
    """Bases of the reference that the alignment spans (M, D, N, = and X)."""
    step = lambda acc, x: acc + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(F.lit(0).cast("long"))
    return F.aggregate(cigar_ops(cigar), F.lit(0).cast("long"), step)


def aligned_blocks(start: Column | str, cigar: Column | str) -> Column:
    """ARRAY<STRUCT<s BIGINT, e BIGINT>>: half-open stretches of the reference covered by M, = or X, from a 0-based start."""
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(F.lit(0).cast("long"))
        block = F.array(F.struct(acc["at"].alias("s"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(x["op"].isin("M", "=", "X"), F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"))

    return F.aggregate(cigar_ops(cigar), F.struct(col(start).cast("long").alias("at"), empty.alias("blocks")), step, lambda acc: acc["blocks"])


_MD = re.compile(r"([0-9]+)|\^([A-Za-z]+)|([A-Za-z])")
_CIGAR = re.compile(_OPS)


def md_mismatches(md: str | None) -> dict[int, str]:
    """{position among aligned query bases: reference base}; deleted bases take no query position."""
    found, at = {}, 0
    for number, _, base in _MD.findall(md or ""):
        if number:
            at += int(number)
        elif base:
            found[at] = base.upper()
            at += 1
    return found


def _paired(seq: str | None, cigar: str | None, md: str | None) -> str | None:
    """Aligned bases of a read; N where it doesn't pair with the reference.

    MD counts aligned bases only, so its positions are counted without clips and insertions.
    """
    if not seq or not cigar or seq == "*" or cigar == "*":
        return None
    mismatch, out, at = md_mismatches(md), [], 0
    for n, op in _CIGAR.findall(cigar):
        n = int(n)
        if op in "M=X":
            out.append("N" * len(seq[at : at + n]) if op == "X" else seq[at : at + n])
        if op in "M=XIS":
            at += n
    bases = list("".join(out).upper())
    for k in mismatch:
        if k < len(bases):
            bases[k] = "N"
    return "".join(bases)


@F.pandas_udf(T.StringType())
def paired_bases(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(seq, cigar, md): the aligned bases, N for a mismatch; null without seq or CIGAR."""
    for seq, cigar, md in batches:
        yield pd.Series([_paired(s, c, m) for s, c, m in zip(seq, cigar, md)], dtype=object)

"""Loading PAF and BLAST lines: typed records, and rejects with their reason."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAB, QUOTE, CR, HASH = 9, 34, 13, 35

#: The columns of the two formats in file order, with N for a name, S for the strand, I for a number.
PAF = [("query_name", "N"), ("query_length", "I"), ("query_start", "I"), ("query_end", "I"), ("strand", "S"), ("target_name", "N"), ("target_length", "I"), ("target_start", "I"), ("target_end", "I"), ("matching_bases", "I"), ("block_length", "I"), ("mapq", "I")]
BLAST = [("query_name", "N"), ("target_name", "N"), ("query_length", "I"), ("query_start", "I"), ("query_end", "I"), ("matching_bases", "I"), ("alignment_length", "I")]
MOST = 4294967295

RECORD = [*PAF, ("alignment_length", "I")]
_KIND = {"N": T.StringType(), "S": T.StringType(), "I": T.LongType()}


class _Lines:
    """The bytes of a batch of lines with the places of its delimiters."""

    def __init__(self, column: pa.StringArray):
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        # a zero byte at the end lets every place up to the end be looked at
        self.data = np.append(np.frombuffer(data, np.uint8)[: offsets[-1]] if data else np.zeros(0, np.uint8), np.uint8(0))
        self.start, self.end = offsets[:-1].copy(), offsets[1:].copy()
        full = self.end > self.start
        self.end = self.end - (full & (self.data[np.maximum(self.end - 1, 0)] == CR))
        digit = (self.data >= 48) & (self.data <= 57)
        self.digits = np.append(0, np.cumsum(digit))
        place = np.arange(len(self.data))
        nonzero = np.where(digit & (self.data == 48), len(self.data), place)
        self.next_nonzero = np.minimum.accumulate(nonzero[::-1])[::-1]
        self._index()

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.data[np.minimum(place, len(self.data) - 1)]

    def numbers(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the fields s..e and whether each is made of digits only and not too large."""
        ok = (e > s) & (self.digits[e] - self.digits[s] == e - s)
        lead = np.minimum(self.next_nonzero[np.minimum(s, len(self.data) - 1)], np.maximum(e - 1, s))
        size = e - lead
        ok &= size <= 10
        value = np.zeros(len(s), np.int64)
        for k in range(10):
            more = ok & (k < size)
            value = np.where(more, value * 10 + self.at(lead + k).astype(np.int64) - 48, value)
        ok &= value <= MOST
        return np.where(ok, value, 0), ok

    def _index(self) -> None:
        """Which tabs delimit fields, and which lines have a broken quote, by a prefix parity of the quotes.

        Neighbouring quotes are one run. A run of odd length that stands where a field may
        begin turns the parity over; one of odd length elsewhere ends a quoted field or is
        ordinary text, and leaves no quote open either way; one of even length changes
        nothing. So a quote is open if an odd number of runs has turned the parity since the
        line's begin or the last run that left none open: a running sum and a running
        maximum over all quotes of the batch.
        """
        quotes, tabs = np.flatnonzero(self.data == QUOTE), np.flatnonzero(self.data == TAB)
        line = np.searchsorted(self.start, quotes, side="right") - 1
        first = np.flatnonzero(np.append(True, (quotes[1:] != quotes[:-1] + 1) | (line[1:] != line[:-1]))) if len(quotes) else quotes
        size = np.diff(np.append(first, len(quotes)))
        at, line = quotes[first], line[first]
        behind = at + size
        may_open = (at == self.start[line]) | (self.data[np.maximum(at - 1, 0)] == TAB)
        odd = size % 2 == 1
        turns, closes = odd & may_open, odd & ~may_open
        upto = np.cumsum(turns)
        fresh = np.append(True, line[1:] != line[:-1])[: len(line)]
        base = np.maximum.accumulate(np.maximum(np.where(fresh, upto - turns, 0), np.append(0, np.where(closes, upto, 0)[:-1])[: len(line)]))
        was_open = (upto - turns - base) % 2 == 1
        is_open = np.where(odd, ~was_open & may_open, was_open)
        ends = (behind >= self.end[line]) | (self.at(behind) == TAB)
        last = np.append(line[1:] != line[:-1], True)[: len(line)]
        wrong = (~ends & np.where(was_open, odd, may_open & ~odd)) | (last & is_open)
        self.broken = np.bincount(line[wrong], minlength=len(self.start)) > 0

        of_tab = np.searchsorted(self.start, tabs, side="right") - 1
        run = np.searchsorted(at, tabs) - 1
        within = np.zeros(len(tabs), bool)
        if len(at):
            within = (run >= 0) & (line[run] == of_tab) & is_open[run]
        self.tabs = tabs[~within]

    def fields(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Fields of the lines in rows: (first field of each line, their number, content starts, ends, whether quoted)."""
        start, end = self.start[rows], self.end[rows]
        t0, t1 = np.searchsorted(self.tabs, start), np.searchsorted(self.tabs, end)
        count = t1 - t0 + 1
        first = np.cumsum(count) - count
        line, k = np.repeat(np.arange(len(rows)), count), _ranks(count)
        tabs = np.append(self.tabs, len(self.data))
        fs = np.where(k == 0, start[line], tabs[np.maximum(t0[line] + k - 1, 0)] + 1)
        fe = np.where(k == count[line] - 1, end[line], tabs[np.minimum(t0[line] + k, len(tabs) - 1)])
        quoted = (fe > fs) & (self.at(fs) == QUOTE)
        return first, count, fs + quoted, fe - quoted, quoted


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count in turn."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _like_tag(lines: _Lines, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    c = [lines.at(s + k) for k in range(5)]
    letter = lambda x: ((x | 32) >= 97) & ((x | 32) <= 122)
    return (e - s >= 5) & letter(c[0]) & (letter(c[1]) | ((c[1] >= 48) & (c[1] <= 57))) & (c[2] == 58) & np.isin(c[3], np.frombuffer(b"AifZHB", np.uint8)) & (c[4] == 58)


def _parse(column: pa.Array, formats: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Reason of each line ('' valid, None neither) and the columns of RECORD."""
    n = len(column)
    lines = _Lines(column)
    empty = (lines.end <= lines.start) | (lines.at(lines.start) == HASH) | np.asarray(column.is_null())
    reason = np.full(n, None, object)
    values: dict[str, np.ndarray] = {name: np.zeros(n, np.int64) for name, kind in RECORD if kind == "I"}
    present: dict[str, np.ndarray] = {name: np.zeros(n, bool) for name, _ in RECORD}
    span: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {name: (np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)) for name, kind in RECORD if kind != "I"}
    reason[~empty & ~np.isin(formats, ["paf", "blast"])] = "unknown_format"
    for form, columns in (("paf", PAF), ("blast", BLAST)):
        rows = np.flatnonzero(~empty & (formats == form))
        if not len(rows):
            continue
        first, count, fs, fe, in_quotes = lines.fields(rows)
        wrong = count < len(columns) if form == "paf" else count != len(columns)
        if form == "paf":
            extra = np.maximum(count - len(columns), 0)
            owner = np.repeat(np.arange(len(rows)), extra)
            at = np.repeat(first + len(columns), extra) + _ranks(extra)
            wrong |= np.bincount(owner[~_like_tag(lines, fs[at], fe[at])], minlength=len(rows)) > 0
        said = np.full(len(rows), "", object)
        said[wrong] = "column_count"
        said[lines.broken[rows]] = "broken_quote"
        ok = said == ""
        first, rows = first[ok], rows[ok]
        bad = np.zeros(len(rows), bool)
        got: dict[str, np.ndarray] = {}
        for k, (name, kind) in enumerate(columns):
            s, e = fs[first + k], fe[first + k]
            if kind == "I":
                got[name], fine = lines.numbers(s, e)
                bad |= ~fine
            else:
                bad |= e <= s
                if kind == "S":
                    bad |= (e - s != 1) | ~np.isin(lines.at(s), (43, 45))
                for part, found in zip(span[name], (s, e, in_quotes[first + k])):
                    part[rows] = found
        bad |= (got["query_start"] > got["query_end"]) | (got["query_end"] > got["query_length"])
        if form == "paf":
            bad |= (got["target_start"] > got["target_end"]) | (got["target_end"] > got["target_length"]) | (got["matching_bases"] > got["block_length"])
        else:
            bad |= (got["query_start"] < 1) | (got["matching_bases"] > got["alignment_length"])
        said[np.flatnonzero(ok)[bad]] = "bad_value"
        reason[np.flatnonzero(~empty & (formats == form))] = said
        for name, _ in columns:
            present[name][rows[~bad]] = True
            if name in got:
                values[name][rows] = got[name]
    out = {name: pa.array(v, mask=~present[name]) for name, v in values.items()}
    raw = lines.data.tobytes()
    for name, (s, e, quoted) in span.items():
        here = present[name]
        text = np.full(n, None, object)
        text[here] = [raw[a:b].decode() for a, b in zip(s[here].tolist(), e[here].tolist())]
        for i in np.flatnonzero(quoted & here):  # two quotes stand for one inside quotes only
            text[i] = text[i].replace('""', '"')
        out[name] = pa.array(text, pa.string())
    return reason, out


def parse_hit_lines(df: DataFrame, line_id: str = "line_id", line: str = "raw_line", line_format: str = "line_format") -> DataFrame:
    """One row for each line that is a record or a fault: (line_id, line_format, reason, *RECORD).

    reason is null for a valid line, whose typed values stand in the columns of its
    format; else the first of broken_quote, column_count, bad_value that applies, and the
    values are null. A line whose format is neither 'paf' nor 'blast' (or null) comes out
    with unknown_format. Null lines, empty lines and comments (#) give no row. Repeated
    rows are each parsed; extra columns are ignored; an empty table gives an empty result.

    The lines of an Arrow batch are indexed as one run of bytes: masks of quotes and tabs
    and a prefix parity of the quotes give the delimiters, and counts, digits and ranges are
    checked for a whole batch at once. There is no shuffle.
    """
    id_field = df.schema[line_id]
    names = [name for name, _ in RECORD]
    shape = T.StructType([T.StructField("line_id", id_field.dataType), T.StructField("line_format", T.StringType()), T.StructField("reason", T.StringType()), *(T.StructField(name, _KIND[kind]) for name, kind in RECORD)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            formats = np.array(batch.column(1).to_pylist(), object)
            reason, out = _parse(batch.column(2), formats)
            kept = np.array([r is not None for r in reason])
            said = pa.array([r or None for r in reason[kept].tolist()], pa.string())
            take = pa.array(np.flatnonzero(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), said, *(out[name].take(take) for name in names)], names=["line_id", "line_format", "reason", *names])

    return df.select(F.col(line_id), F.col(line_format), F.col(line)).mapInArrow(parse, shape)


def valid_records(parsed: DataFrame, line_format: str) -> DataFrame:
    """The valid records of one format, with that format's columns only."""
    columns = [name for name, _ in (PAF if line_format == "paf" else BLAST)]
    return parsed.where((F.col("line_format") == line_format) & F.col("reason").isNull()).select("line_id", *columns)


def rejects(parsed: DataFrame) -> DataFrame:
    """The faulty lines with their reason."""
    return parsed.where(F.col("reason").isNotNull()).select("line_id", "reason")

"""Finding text that was read in a wrong encoding, and restoring it."""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.scratch import drop_table, shuffle_width, write_table

BUCKETS = 1 << 14
#: A word or pair of characters is kept if it makes up at least this share of all; so there are at most as many of them as the share goes into 1.
WORD_SHARE, PAIR_SHARE = 1 / 250_000, 1 / 500_000
#: How many times as likely, as a logarithm, a word must be when it is undone: on its own, and next to garbled ones.
LEAST, LEAST_IN_LINE = 2.0, -3.0
#: Ways to undo a word that are so much less likely than the best, as a logarithm, don't count.
NEAR = 3.0
#: Words that are judged beforehand and kept with the model.
MOST_JUDGED = 100_000
#: Characters of a word that are counted as one.
PIECE = 200

_U1, _U2 = ("utf-8", "cp1252"), ("utf-8", "latin-1")
_READ_UTF8_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1253", "cp1254", "cp1258", "koi8-r", "cp866", "iso8859-2", "iso8859-7", "iso8859-9", "gbk", "cp932")
#: Per family of languages the encodings that are taken for one another.
_FAMILIES = [
    ("cp1252", "cp437", "cp850", "mac_roman"),
    ("cp1250", "iso8859-2", "cp852", "mac_latin2"),
    ("cp1254", "cp857"),
    ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"),
    ("cp1253", "cp737", "mac_greek"),
    ("cp932", "euc_jp"),
    ("gbk",),
]
_single_steps = dict.fromkeys(
    [
        *(("utf-8", d) for d in _READ_UTF8_AS),
        *((e, d) for family in _FAMILIES for e in family for d in family if e != d and {e, d} != {"cp1250", "iso8859-2"}),
        *((e, d) for family in _FAMILIES[1:] for e in family for d in ("cp1252", "latin-1") if not (d == "latin-1" and e in ("cp1250", "iso8859-2", "cp1254"))),
        *((e, "latin-1") for e in ("cp1252", "cp437", "mac_roman")),
        *(("cp1252", d) for d in ("cp1250", "cp1251", "cp1253", "koi8-r")),
        *((e, d) for e in ("cp1250", "iso8859-2", "cp1251", "cp1254", "cp1253") for d in ("cp437", "cp850", "mac_roman")),
        ("cp932", "gbk"),
        ("gbk", "cp932"),
        ("cp1251", "gbk"),
        *((e, "utf-8") for e in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp932", "euc_jp", "gbk", "koi8-r")),
    ]
)
#: Encodings that write everything in ASCII, with escapes; read as ASCII, whatever the reader takes for it.
_ESCAPING = ("iso2022_jp", "hz", "utf-7")
#: Chains of (written in, read in) that are told apart. The first is that of text as it was meant.
CHAINS: list[tuple[tuple[str, str], ...]] = [(), *((step,) for step in _single_steps), *((a, b) for a in (_U1, _U2) for b in (_U1, _U2)), (_U1, _U1, _U1), (_U2, _U2, _U2), *(((e, "latin-1"),) for e in _ESCAPING)]
_ESCAPED_CHAINS = [k for k, c in enumerate(CHAINS) if c and c[0][0] in _ESCAPING]
CHAIN_NAMES = ["meant", *("+".join(f"{e}>{d}" for e, d in c) for c in CHAINS[1:])]

_WORD = re.compile(r"[^ \t\r\n\f\v]*[^\x00-\x7f][^ \t\r\n\f\v]*")
#: What the escaping encodings look like: ISO-2022-JP, HZ, UTF-7.
_ESCAPED = re.compile(r"\x1b\$[@B](?:[!-~]{2})+\x1b\([BJ]|~\{(?:[!-}][!-~])+~\}|\+[A-Za-z0-9+/]{3,}(?:-|(?![A-Za-z0-9+/]))")
_PASSAGE = re.compile(r"[^ \t\r\n\f\v]+")
_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f]")
_RUN = re.compile(r"[^\x00-\x7f]+")
LOST = "�"
_DIGITS = str.maketrans("123456789", "000000000")
_DIGIT_BYTES = bytes.maketrans(b"123456789", b"000000000")


def _words(text: str) -> list[str]:
    """Runs between ASCII blanks with a character beyond ASCII, every digit as 0."""
    return [w.decode() for w in text.encode().translate(_DIGIT_BYTES).split() if not w.isascii()]


def _plain(word: str) -> str:
    """word with every digit as 0, unless its digits may be part of an escape."""
    return word if word.isascii() else word.translate(_DIGITS)


def _pieces(word: str) -> list[str]:
    """A long run, such as a line in a script without blanks, cut up so that all of it is counted."""
    return [word] if len(word) <= PIECE else [word[k : k + PIECE] for k in range(0, len(word), PIECE)]


def _escaped(text: str) -> list[str]:
    """The ASCII runs between blanks with an escape."""
    if not any(sign in text for sign in ("+", "~{", "\x1b$")):
        return []
    return [w for w in _PASSAGE.findall(text) if w.isascii() and _ESCAPED.search(w)]


@lru_cache(None)
def _single(codec: str) -> tuple[str, dict[int, int]] | None:
    """The characters of a one-byte encoding and the way back. Control bytes without one stand for themselves, as in browsers; others are lost."""
    if codec in ("utf-8", "gbk", "cp932", "euc_jp", *_ESCAPING):
        return None
    chars = "".join(bytes([b]).decode(codec, "ignore") or (chr(b) if b < 0xA0 else LOST) for b in range(256))
    return chars, {ord(c): b for b, c in enumerate(chars) if c != LOST}


@lru_cache(None)
def _chars(codec: str) -> frozenset[str]:
    """The characters of a one-byte encoding, none of others."""
    single = _single(codec)
    return frozenset(map(chr, single[1])) if single else frozenset()


def _to_bytes(text: str, codec: str) -> bytes | None:
    single = _single(codec)
    try:
        return codecs.charmap_encode(text, "strict", single[1])[0] if single else text.encode(codec)
    except UnicodeError:
        return None


def _read(data: bytes, codec: str, strict: bool) -> str | None:
    single = _single(codec)
    if single:
        return codecs.charmap_decode(data, "strict", single[0])[0]
    try:
        return data.decode(codec, "strict" if strict else "replace")
    except UnicodeError:
        return None


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """text as it looks after the chain, unreadable bytes replaced; None if it can't be written in an encoding of the chain."""
    for written, read in chain:
        data = _to_bytes(text, written)
        if data is None:
            return None
        text = _read(data, read, strict=False)
    return text


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The chain inverted; None unless every step can be undone strictly."""
    for written, read in reversed(chain):
        data = _to_bytes(text, read)
        text = None if data is None else _read(data, written, strict=True)
        # control characters aren't written in texts
        if text is None or len(chain) == 1 and _CONTROL.search(text):
            return None
    return text


@lru_cache(None)
def _letter_for_letter(chain: tuple[tuple[str, str], ...]) -> dict[int, str] | None:
    """What each character was, of a chain of one step between one-byte encodings; None for others."""
    if len(chain) != 1 or not (written := _single(chain[0][0])) or not (read := _single(chain[0][1])):
        return None
    return {char: written[0][b] for char, b in read[1].items()}


@lru_cache(None)
def _utf8_read_as(codec: str) -> re.Pattern | None:
    """What any character beyond ASCII looks like in a one-byte encoding if it was written in UTF-8: a first byte with one that follows."""
    if not (single := _single(codec)):
        return None
    kind = lambda lo, hi: "[" + "".join(re.escape(c) for c in single[0][lo:hi] if c != LOST) + "]"
    return re.compile(kind(0xC2, 0xF5) + kind(0x80, 0xC0))


def _undo_run(run: str, chain: tuple[tuple[str, str], ...], whole: bool) -> str | None:
    """A run of characters restored, unless it is whole and failed so already, or what of it the last reading can have given."""
    known = _chars(chain[-1][1])
    if known and known.isdisjoint(run):
        return None
    full = not known or known.issuperset(run)
    back = restore(run, chain) if full and not whole else None
    if back is not None or full:
        return back
    parts = ["".join(g) for _, g in groupby(run, known.__contains__)]
    undone = [restore(p, chain) if p[0] in known else None for p in parts]
    return "".join(u or p for u, p in zip(undone, parts)) if any(undone) else None


def undo(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """word restored, as a whole or run by run of characters beyond ASCII or of escapes; None if nothing of it can be."""
    if LOST in word:
        return None
    if (table := _letter_for_letter(chain)) is not None:
        back = word.translate(table)
        if LOST not in back and not _CONTROL.search(back):
            return None if back == word else back
    if chain[-1][0] == "utf-8" and (sign := _utf8_read_as(chain[-1][1])) and not sign.search(word):
        return None
    escaping, known = chain[0][0] in _ESCAPING, _chars(chain[-1][1])
    back = None if escaping or known and not known.issuperset(word) else restore(word, chain)
    if back is None:
        runs = _ESCAPED if escaping else _RUN
        undone = [restore(p, chain) if escaping else _undo_run(p, chain, p == word) for p in runs.findall(word)]
        if not any(undone):
            return None
        each = iter(undone)
        back = runs.sub(lambda m: next(each) or m.group(), word)
    return None if back == word or LOST in back else back


def _pairs(data: bytes, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte pairs that touch a byte outside ASCII, or of every pair, and where they are."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    wide = b >= 0x80
    at = np.arange(len(b) - 1) if every else np.flatnonzero(wide[:-1] | wide[1:])
    return ((b[at] << 8 | b[at + 1]) * 40503 >> 2) % BUCKETS, at


def _features(word: str) -> np.ndarray:
    return _pairs(f" {word} ".encode(), every=word.isascii())[0]


class Usage:
    """How likely a word is in text that was meant: by its own frequency, or by its pairs of characters."""

    def __init__(self, words: dict[str, float], pairs: dict[str, float]):
        self.words, self.total = words, max(1.0, sum(words.values()))
        self.pairs, self.first, self.char = pairs, Counter(), Counter()
        for pair, n in pairs.items():
            self.first[pair[0]] += n
            self.char[pair[1]] += n
        self.chars = sum(self.char.values()) + 1e5
        self.seen: dict[tuple[str, str], float] = {}

    def _log_pair(self, pair: tuple[str, str]) -> float:
        last, c = pair
        base = (self.char.get(c, 0.0) + 0.02) / self.chars
        if len(self.seen) > 500_000:
            self.seen.clear()
        got = self.seen[pair] = math.log((self.pairs.get(last + c, 0.0) + 20.0 * base) / (self.first.get(last, 0.0) + 20.0))
        return got

    def log_p(self, word: str) -> float:
        seen, sum_log = self.seen, 0.0
        for pair in zip(f" {word}", f"{word} "):
            got = seen.get(pair)
            sum_log += self._log_pair(pair) if got is None else got
        own = self.words.get(word, 0.0) / self.total
        return max(sum_log, math.log(own)) if own else sum_log

    def familiar(self, word: str) -> float:
        """Share of the pairs of characters with one beyond ASCII that are in use."""
        pairs = [a + b for a, b in zip(f" {word}", f"{word} ") if a > "\x7f" or b > "\x7f"]
        return sum(p in self.pairs for p in pairs) / max(1, len(pairs))


class Classifier:
    """Multinomial model of hashed byte pairs: for each chain, of garbled words and of the same words as they were."""

    def __init__(self, garbled: np.ndarray, meant: np.ndarray, usage: Usage, odds: float, gain: float):
        # a bucket's numbers lie together
        self.garbled, self.meant = np.ascontiguousarray(garbled.T), np.ascontiguousarray(meant.T)
        self.usage, self.odds, self.gain = usage, odds, gain
        self._sent: Broadcast | None = None
        self.known: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}, "_sent": None}

    def sent(self, spark: SparkSession) -> Broadcast:
        """The model without its judged words, broadcast once."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self)
        return self._sent

    def log_odds(self, word: str) -> np.ndarray:
        """Of each chain, against the word's being meant, in the words that the chain can garble or in all."""
        f = _features(word)
        meant = self.meant[f].sum(axis=0)
        return self.garbled[f].sum(axis=0) - np.maximum(meant, meant[0])

    def judge(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        """The ways to read the word that are worth it, the best first: how many times as likely as it is (a logarithm), and the chains that undo it so. Digits don't matter."""
        return self.judge_plain(_plain(word))

    def judge_plain(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        """judge, of a word whose digits are 0 already."""
        if (got := self.known.get(word)) is None:
            got = self._judge(word)
            if len(word) <= 400:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[word] = got
        return got

    def _judge(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        odds = self.log_odds(word)
        likely = [int(k) for k in np.argsort(-odds, kind="stable") if k and odds[k] > self.odds]
        if LOST in word:
            return [(math.inf, ((likely or [1])[0],))]
        undone: dict[str, list[int]] = {}
        for k in likely:
            if CHAINS[k][-1][1] == "utf-8":  # what is no UTF-8 is lost when it is read so
                continue
            if (back := undo(word, CHAINS[k])) is not None and (k not in _ESCAPED_CHAINS or self.usage.familiar(back) >= 0.75):
                undone.setdefault(back, []).append(k)
        if not undone:
            return []
        meant, chance = self.usage.log_p(word), math.log(len(undone))
        # almost any bytes are valid in encodings other than UTF-8, so one of many texts is likely by chance
        ways = [(self.usage.log_p(back) - meant - chance * (CHAINS[like[0]][0][0] != "utf-8"), tuple(like)) for back, like in undone.items()]
        ways.sort(key=lambda w: -w[0])
        return [w for w in ways if w[0] > max(LEAST, ways[0][0] - NEAR)]

    def suspect(self, words: Iterable[str]) -> bool:
        """Whether any of a document's words, whose digits are 0, is worth a closer look."""
        return any(self.judge_plain(w) for w in words)

    def faults(self, lines: Sequence[Sequence[str]], alone: float = 2.5) -> list[dict[str, int]]:
        """The garbled ones of a document's words, line by line, with their chain.

        A chain is named for a document if its words together put it beyond doubt, the
        likeliest chain first; a word counts for all chains that undo it to the same text. A
        word that is valid UTF-8 when it is undone needs alone only: text that was meant is
        hardly ever valid. In a line with a garbled word, others that its chain undoes are
        taken as garbled too, unless they are much likelier as they are.
        """
        ways = {w: self.judge(w) for w in {w for line in lines for w in line}}
        left = {w: found for w, found in ways.items() if found}
        named: dict[str, int] = {}
        while left:
            weight: Counter = Counter()
            for found in left.values():
                best = {}
                for gain, like in found:
                    for k in like:
                        best[k] = max(best.get(k, 0.0), gain)
                weight.update(best)
            k = max(weight, key=lambda c: (weight[c], -c))
            if weight[k] <= self.gain:
                break
            own = [w for w, found in left.items() if any(k in like for _, like in found)]
            for w in own:
                named[w] = k
                del left[w]
        named |= {w: found[0][1][0] for w, found in left.items() if found[0][0] > alone and CHAINS[found[0][1][0]][0][0] == "utf-8"}
        out = []
        for line in lines:
            mine = {w: named[w] for w in line if w in named}
            weight = Counter()
            for w, k in mine.items():
                weight[k] += max(gain for gain, like in ways[w] if k in like)
            if mine and (most := max(weight, key=lambda c: (weight[c], -c))):
                mine |= {w: most for w in set(line) if mine.get(w) != most and self.gain_of(w, most) > LEAST_IN_LINE}
            out.append(mine)
        return out

    def gain_of(self, word: str, k: int) -> float:
        """How many times as likely, as a logarithm, the word is when the chain is undone; minus infinity if it can't be."""
        word = _plain(word)
        back = undo(word, CHAINS[k])
        return -math.inf if back is None else self.usage.log_p(back) - self.usage.log_p(word)


def _counts(words: Counter) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Per chain, the weighted pair counts of the garbled words and of the same words as they were."""
    kept = [w for w in words if LOST not in w]
    weight = np.sqrt([words[w] for w in kept])
    letters = [frozenset(w) for w in kept]
    for k, chain in enumerate(CHAINS):
        codec = _single(chain[0][0]) if k else None
        known = frozenset(map(chr, codec[1])) if codec else None
        forms = [garble(w, chain) if known is None or has <= known else None for w, has in zip(kept, letters)] if k else kept
        use = [i for i, form in enumerate(forms) if form is not None]
        if not use:
            continue
        for garbled, texts in ((True, forms), (False, kept)):
            data = [f" {texts[i]} ".encode() for i in use]
            found, at = _pairs(b"".join(data), every=garbled and k in _ESCAPED_CHAINS)
            per_byte = np.repeat(weight[use], [len(x) for x in data])
            yield k, garbled, np.bincount(found, weights=per_byte[at], minlength=BUCKETS).astype(float)  # whole numbers if there is no pair


def _fit(docs: DataFrame, text: str, in_sample: Column, before: Classifier | None, least_docs: float, odds: float, gain: float, background: float = 0.1) -> Classifier:
    """Count on Spark: the distinct words of all documents and their pairs of characters; for each word of the sample, once, its pairs of bytes in every chain.

    What comes back is bounded by chains x buckets, and by WORD_SHARE and PAIR_SHARE.
    """
    spark = docs.sparkSession
    at_hand = _at_hand(before, spark) if before else None

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = at_hand() if at_hand else None
        for batch in batches:
            found, sampled = Counter(), Counter()
            for value, is_sampled in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if value and not value.isascii():
                    own = set(_words(value))
                    faulty = before.faults([own])[0] if before and before.suspect(own) else ()
                    kept = {p for w in own if w not in faulty for p in _pieces(w)}
                    found.update(kept)
                    if is_sampled:
                        sampled.update(kept)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([sampled[w] for w in found], pa.int64())], names=["word", "n", "in_sample"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
            for k, garbled, row in _counts(found):
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2 * k + garbled, np.int32)), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["model", "bucket", "n"])

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: Counter = Counter()
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if LOST not in word:
                    for a, b in zip(f" {word}", f"{word} "):
                        pairs[a + b] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["pair", "n"])

    seen = docs.select(text, in_sample.alias("sampled")).mapInArrow(words, "word string, n long, in_sample long")
    distinct, at = write_table(seen.groupBy("word").agg(F.sum("n").alias("n"), F.sum("in_sample").alias("in_sample")), "words")
    spread = distinct.where("in_sample > 0").select("word", F.col("in_sample").alias("n")).repartition(min(32, shuffle_width(spark)), F.xxhash64("word"))
    table = spread.mapInArrow(count, "model int, bucket int, n double").groupBy("model", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2 * len(CHAINS), BUCKETS))
    np.add.at(counts, (table["model"].to_numpy(), table["bucket"].to_numpy()), table["n"].to_numpy())
    # the same share for pairs never seen, however much a model has seen
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    log_p = np.log((1 - background) * share + background / BUCKETS).astype(np.float32)

    pairs = distinct.select("word", "n").mapInArrow(pair_up, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs, pairs_at = write_table(pairs, "pairs")
    usage = Usage(_frequent(distinct, "word", WORD_SHARE, least_docs), _frequent(pairs, "pair", PAIR_SHARE, 1))
    model = Classifier(log_p[1::2], log_p[0::2], usage, odds, gain)
    _judge_frequent(model, distinct)
    for path in (at, pairs_at):
        drop_table(spark, path)
    return model


def _judge_frequent(model: Classifier, distinct: DataFrame) -> None:
    """Judge the frequent words once on Spark, so that not every worker does: as many of the most frequent as stay below MOST_JUDGED. Any others are judged where they occur."""
    spark = distinct.sparkSession
    words = distinct.where(F.length("word") <= PIECE)
    counts = words.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count(F.lit(1)).alias("words")).toPandas().sort_values("n", ascending=False)  # 65,536 rows at most
    enough = counts["n"][counts["words"].cumsum() <= MOST_JUDGED]
    if enough.empty:
        return
    shared = model.sent(spark)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            ways = [shared.value.judge_plain(w) for w in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[g for g, _ in w] for w in ways], pa.list_(pa.float64())), pa.array([[list(like) for _, like in w] for w in ways], pa.list_(pa.list_(pa.int32())))], names=["word", "gains", "likes"])

    frequent = words.where(F.col("n") >= int(enough.iloc[-1])).select("word")
    spread = frequent.repartition(min(64, 4 * shuffle_width(spark)), F.xxhash64("word"))
    for row in spread.mapInArrow(judge, "word string, gains array<double>, likes array<array<int>>").collect():  # MOST_JUDGED rows at most
        model.known[row["word"]] = [(g, tuple(like)) for g, like in zip(row["gains"], row["likes"])]


def _at_hand(model: Classifier, spark: SparkSession) -> Callable[[], Classifier]:
    """How a task gets the model, with the words judged beforehand."""
    shared, judged = model.sent(spark), spark.sparkContext.broadcast(model.known)

    def get() -> Classifier:
        if not shared.value.known:
            shared.value.known.update(judged.value)
        return shared.value

    return get


def _frequent(counts: DataFrame, key: str, share: float, least: float) -> dict[str, float]:
    """n by key, where it is at least least, and share of the sum: 1 / share keys at most."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    some = counts.where(F.col("n") >= max(least, share * total)).select(key, "n").toPandas()
    return dict(zip(some[key], some["n"].astype(float)))


def _hash_below(key: Column, share: float) -> Column:
    """True for about the given share of the keys, however small: a hash of 63 bits is compared."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(min((1 << 63) - 1, int(share * (1 << 63))))


_last_fit: list[tuple[DataFrame, str, str, Classifier]] = []


def _fitted(docs: DataFrame, doc_id: str, text: str) -> Classifier:
    """The classifier of these documents, fitted once a session for the same table."""
    for known, *columns, model in _last_fit:
        if columns == [doc_id, text] and known.sparkSession is docs.sparkSession and known.sameSemantics(docs):
            return model
    _last_fit[:] = [(docs, doc_id, text, train_classifier(docs, doc_id, text))]
    return _last_fit[0][-1]


def train_classifier(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 20_000, odds: float = 0.0, gain: float = 8.0) -> Classifier:
    """Fit the chain classifier on texts of docs and on synthetically garbled forms of them.

    About sample_docs documents (all, if there are fewer), chosen by a hash of their id,
    serve as text that was meant; each of their words beyond ASCII is garbled by every chain
    that it can be written in. How often words and pairs of characters are used is counted
    over all documents. The few words that are garbled already are found by a first model,
    which knows as words only those of many documents, and are left out of the second.
    """
    n = docs.count()
    in_sample = _hash_below(F.col(doc_id), min(1.0, sample_docs / max(1, n)))
    first = _fit(docs, text, in_sample, None, max(3.0, 0.0025 * n), odds, 0.75 * gain)
    return _fit(docs, text, in_sample, first, 3.0, odds, gain)


def find_garbled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """(doc_id, chain, n_passages, n_restored, restored): documents with a passage read in a wrong encoding.

    A passage is a run of characters between blanks with one beyond ASCII, or with an escape
    of an encoding that writes in ASCII. The classifier predicts the chains of encodings; a
    chain is inverted, which must succeed strictly byte by byte, and is rejected unless the
    outcome is many times likelier, as text that was meant, than the passage is. The evidence
    of a document's passages for one chain adds up, and a passage that becomes valid UTF-8
    needs less of it. Passages with a replacement character are found though they can't be
    restored. chain is the commonest of the document; restored is the text with the
    restorable passages put right, the others as they are. Null and empty texts, and ASCII
    texts without an escape, have no passage and give no row. Repeated rows are judged each;
    other columns don't matter; an empty table gives an empty result. Texts are judged
    whole, and nothing is shuffled. Without a classifier one is fitted on docs, once a session.
    """
    at_hand = _at_hand(classifier or _fitted(docs, doc_id, text), docs.sparkSession)
    shape = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("chain", T.StringType()), T.StructField("n_passages", T.LongType()), T.StructField("n_restored", T.LongType()), T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = at_hand()
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not value or not (judges.suspect(set(_escaped(value))) or not value.isascii() and judges.suspect(set(_words(value)))):
                    continue
                lines = value.split("\n")
                words = [_WORD.findall(line) + _escaped(line) for line in lines]
                faults = judges.faults(words)
                chains = Counter(k for own, bad in zip(words, faults) for w in own if (k := bad.get(w)))
                if not chains:
                    continue
                restored = 0
                for n, (own, bad) in enumerate(zip(words, faults)):
                    if bad:
                        put_right = {w: back for w, k in bad.items() if (back := undo(w, CHAINS[k])) is not None}
                        restored += sum(w in put_right for w in own)
                        lines[n] = _PASSAGE.sub(lambda m: put_right.get(m.group(), m.group()), lines[n])
                rows.append((key, CHAIN_NAMES[chains.most_common(1)[0][0]], chains.total(), restored, "\n".join(lines)))
            if rows:
                yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(shape)}, schema=pa.schema([batch.schema.field(0).with_name("doc_id"), ("chain", pa.string()), ("n_passages", pa.int64()), ("n_restored", pa.int64()), ("restored", pa.string())]))

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, shape)

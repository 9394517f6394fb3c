"""Operator 13: collocations by Misra-Gries summaries of hashed n-grams, then exact counts.

Words are counted exactly first; a phrase can only reach the threshold if all its words do, so rarer words break
pieces. Bigrams, combined inside map tasks, are dealt by hash; each hash partition keeps a Misra-Gries summary whose
capacity exceeds its mass divided by the threshold: where it would have to take the threshold or more from all counters
together it grows instead, so every bigram that reaches the threshold survives. A second pass over the texts keeps the
maximal runs of words whose neighbours are surviving bigrams, as distinct runs with counts; longer phrases lie inside them,
are summed up by the same summaries, and all survivors are then counted exactly, as words.

What survives is told to the map tasks by a Bloom filter of fixed size (``BITS``): whatever the number of survivors, the
broadcast stays 8 MB, and a filter that fills up only prunes less.

Defined cases: null and empty texts have no words; a null lang is ``und``, the same as that value; repeated rows count
as often as they occur; empty tables give empty results; other columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions.storage import stored
from screenlake.llm.text import U, gram_hashes

_CUTS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _CUTS, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_CUTS))
_TOKEN = re.compile(rb"[^ \t\n]+|\n")
BITS = 1 << 26
MOST = 400_000  # distinct strings a task holds before it hands them on
CHUNK = 4 << 20  # bytes of text that are worked on at once


def tokens(text: bytes | None) -> list[bytes]:
    r"""Words of a text in order, with ``\n`` wherever a piece ends."""
    return _TOKEN.findall(text.translate(_PLAIN)) if text else []


class Codes(dict):
    """64-bit codes of a language's words; 0 for the end of a piece and for words that are not in the filter."""

    def __init__(self, lang: bytes, bits: np.ndarray | None):
        self.seed, self.bits = xxhash.xxh3_64_intdigest(lang), bits

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST:
            self.clear()
        self[b"\n"] = 0
        new = list(set(words).difference(self))
        h = np.fromiter((xxhash.xxh3_64_intdigest(w, self.seed) or 1 for w in new), U, len(new))
        self.update(zip(new, (h if self.bits is None else np.where(inside(self.bits, h), h, U(0))).tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def inside(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether hashes may be in the filter; never false for those put in."""
    found = np.ones(len(h), bool)
    for at in (h & U(BITS - 1), (h >> U(32)) & U(BITS - 1)):
        found &= (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1
    return found


def filter_of(hashes: DataFrame) -> Broadcast:
    """The Bloom filter of column ``h``: bits are or-ed by Spark, at most ``BITS`` / 64 rows reach the driver."""
    at = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(BITS - 1), F.shiftrightunsigned("h", 32).bitwiseAND(BITS - 1))).alias("at"))
    cells = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, U)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(U)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def grams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of ``n`` words start that cross no break, and their hashes."""
    breaks = np.concatenate([[0], np.cumsum(codes == 0)])
    at = np.flatnonzero(breaks[n:] == breaks[: len(breaks) - n]) if len(codes) >= n else np.zeros(0, np.int64)
    return at, gram_hashes(codes, n)[at]


def _chunks(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[tuple[bytes, Codes, list[bytes]]]:
    """Tokens of some megabytes of text of one language at a time."""
    codes: dict[bytes, Codes] = {}
    for batch in batches:
        held: dict[bytes, list[bytes]] = {}
        size = 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = text.as_py()
            words = held.setdefault(lang.encode(), [])
            words += tokens(text)
            words.append(b"\n")
            size += len(text or b"")
            if size > CHUNK:
                for key, words in held.items():
                    yield key, codes.setdefault(key, Codes(key, bits)), words
                held, size = {}, 0
        for key, words in held.items():
            yield key, codes.setdefault(key, Codes(key, bits)), words
        if sum(map(len, codes.values())) > 4 * MOST:
            codes.clear()


def _rows(found: dict[tuple[bytes, bytes], int], hashed: bool = False) -> pa.RecordBatch:
    langs, texts = ([k[i] for k in found] for i in (0, 1))
    cols = {"lang": pa.array(langs, pa.binary()).cast(pa.string()), "phrase": pa.array(texts, pa.binary()).cast(pa.string()), "c": pa.array(list(found.values()), pa.int64())}
    if hashed:
        seeds = {lang: Codes(lang, None).seed for lang in set(langs)}
        cols["h"] = pa.array(np.array([xxhash.xxh3_64_intdigest(w, seeds[lang]) or 1 for lang, w in found], U).view(np.int64))
    return pa.RecordBatch.from_pydict(cols)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for lang, _, words in _chunks(batches, None):
        own = Counter(words)
        own.pop(b"\n", None)
        for word, c in own.items():
            found[lang, word] += c
        if len(found) > MOST:
            yield _rows(found, True)
            found.clear()
    yield _rows(found, True)


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the sums of their counts."""
    if not len(h):
        return h, c
    turn = np.argsort(h, kind="stable")
    h, c = h[turn], c[turn]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c, first)


class Combined:
    """Hashes with counts, combined before they leave a task; holds some millions.

    The last that leaves is a summary: ``spare`` is taken off every counter, and those that reach nothing go.
    """

    def __init__(self, spare: int, most: int = 3_000_000):
        self.spare, self.most, self.held, self.size = spare, most, [], 0

    def add(self, h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((h, c))
        self.size += len(h)
        if self.size > self.most:
            self.held = [_summed(*(np.concatenate(x) for x in zip(*self.held, strict=True)))]
            self.size = len(self.held[0][0])
            if self.size > self.most // 2:
                yield from self.flush(0)

    def flush(self, spare: int) -> Iterator[pa.RecordBatch]:
        if self.held:
            h, c = _summed(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
            self.held, self.size = [], 0
            h, c = h[c > spare], c[c > spare] - spare
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "c": c.astype(np.int64)})


def _bigrams(bits: Broadcast, spare: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Combined(spare)
        for _, codes, words in _chunks(batches, bits.value):
            _, h = grams(codes.of(words), 2)
            yield from out.add(h, np.ones(len(h), np.int64))
        yield from out.flush(spare)

    return run


def misra_gries(parts: Iterator[tuple[np.ndarray, np.ndarray]], threshold: int, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The summary (hashes, counters, what was taken off every counter) of weighted hashes; each true count is at most counter + taken, and taken < threshold."""
    h, c, taken = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        nonlocal h, c, taken, capacity, held
        h, c = _summed(*(np.concatenate(x) for x in zip((h, c), *held, strict=True)))
        held = []
        if len(h) > capacity:
            off = int(np.partition(c, len(c) - capacity - 1)[len(c) - capacity - 1])
            if taken + off < threshold:
                taken, c = taken + off, c - off
                h, c = h[c > 0], c[c > 0]
            else:
                capacity = 2 * len(h)

    for part in parts:
        held.append(part)
        if sum(len(x[0]) for x in held) > max(capacity, 1 << 17):
            merge()
    if held:
        merge()
    return h, c, taken


def _summaries(threshold: int, capacity: int, lost: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, taken = misra_gries(((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches), threshold - lost, capacity)
        may = c + taken + lost >= threshold
        yield pa.RecordBatch.from_pydict({"h": h[may], "c": c[may]})

    return run


def frequent(rows: DataFrame, hashed: Callable[[int], Callable], threshold: int, mass: int, share: float = 0.0) -> DataFrame:
    """(h, c): all hashes that may occur ``threshold`` times in what ``hashed`` tells of ``rows``; ``mass`` is a bound on the number of occurrences.

    ``hashed(spare)`` is the function of a map task. All map tasks together may take a ``share`` of the threshold off a counter, the summaries of the hash partitions the rest; what the tasks took
    widens what survives. With many tasks the part of each is nothing, and what they tell is exact.
    """
    spark = rows.sparkSession
    tasks = max(1, rows.rdd.getNumPartitions())
    spare = int(share * (threshold - 1)) // tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    capacity = 2 * mass // (parts * (threshold - spare * tasks)) + 1024
    told = rows.coalesce(tasks).mapInArrow(hashed(spare), "h long, c long")  # no more tasks than were counted
    return stored(told.repartition(parts, "h").mapInArrow(_summaries(threshold, capacity, spare * tasks), "h long, c long"), "survivors")


def _runs(words_in: Broadcast, bigrams_in: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for lang, codes, words in _chunks(batches, words_in.value):
            at, h = grams(codes.of(words), 2)
            at = at[inside(bigrams_in.value, h)]
            ends = np.flatnonzero(np.concatenate([at[1:] != at[:-1] + 1, [True]])) if len(at) else at
            starts = np.concatenate([[0], ends[:-1] + 1]) if len(at) else at
            found.update((lang, b" ".join(words[a : b + 2])) for a, b in zip(at[starts].tolist(), at[ends].tolist(), strict=True))
            if len(found) > MOST:
                yield _rows(found)
                found.clear()
        yield _rows(found)

    return run


def _run_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes], np.ndarray, np.ndarray]]:
    """Words, codes and counts of runs of one language, with a break after each run."""
    codes: dict[bytes, Codes] = {}
    for batch in batches:
        held: dict[bytes, tuple[list, list, list]] = {}
        for lang, text, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words, count, size = held.setdefault(lang.encode(), ([], [], []))
            own = text.encode().split(b" ")
            words += own
            words.append(b"\n")
            count.append(c)
            size.append(len(own) + 1)
        for lang, (words, count, size) in held.items():
            own = codes.setdefault(lang, Codes(lang, None))
            yield lang, words, own.of(words), np.repeat(np.array(count, np.int64), size)


def _longer(orders: range, spare: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Combined(spare)
        for _, _, codes, count in _run_codes(batches):
            for n in orders:
                at, h = grams(codes, n)
                yield from out.add(h, count[at])
        yield from out.flush(spare)

    return run


def _exact(bits: Broadcast, orders: range) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for lang, words, codes, count in _run_codes(batches):
            for n in orders:
                at, h = grams(codes, n)
                for i in at[inside(bits.value, h)].tolist():
                    found[lang, b" ".join(words[i : i + n])] += int(count[i])
                if len(found) > MOST:
                    yield _rows(found)
                    found.clear()
        yield _rows(found)

    return run


def phrase_counts(docs: DataFrame, threshold: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(totals, counts): totals (lang, n) of all words; counts (lang, phrase, size, f) of every word and phrase of up to ``longest`` words with f >= ``threshold``."""
    said = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    told = said.mapInArrow(_count_words, "lang string, phrase string, c long, h long")
    words = stored(told.groupBy("lang", "phrase").agg(F.sum("c").alias("f"), F.any_value("h").alias("h")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    singles = words.where(F.col("f") >= threshold)
    mass = words.agg(F.sum("f")).first()[0] or 0
    common = filter_of(singles.select("h"))
    pairs = frequent(said, lambda spare: _bigrams(common, spare), threshold, mass)
    rows = said.mapInArrow(_runs(common, filter_of(pairs)), "lang string, phrase string, c long")
    runs = stored(rows.groupBy("lang", "phrase").agg(F.sum("c").alias("c")), "runs")
    more = frequent(runs, lambda spare: _longer(range(3, longest + 1), spare), threshold, mass * max(1, longest - 2), 0.5)
    both = filter_of(pairs.unionByName(more))
    exact = runs.mapInArrow(_exact(both, range(2, longest + 1)), "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= threshold)
    counts = exact.unionByName(singles.select("lang", "phrase", "f"))
    return totals, stored(counts.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"), "phrases")


def _part(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, most: int = 2000, **columns: str) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``most`` best phrases.

    a, l, r are exact counts of the phrase and of the two parts of its lowest-scoring cut; score is floor(1000 a n / (l r)) in exact decimals, which hold
    1000 a n below 10^38. A phrase that is as frequent as a longer one around it is dropped.
    """
    totals, counts = phrase_counts(docs, threshold, longest, **columns)
    words = F.split("phrase", " ")
    phrases = counts.where("size > 1")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("*", _part(words, F.lit(1), F.col("k")).alias("left"), _part(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = lambda side, count: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
    cuts = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.select("lang", "phrase", "a", "l", "r", "n", "k", (F.lit(1000).cast("decimal(4,0)") * big("a") * big("n")).cast("decimal(38,0)").alias("x"), (big("l") * big("r")).cast("decimal(38,0)").alias("y"))
    scored = scored.select("*", F.expr("x div y").alias("score"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    lowest = lowest.select("lang", "phrase", *(F.col("cut")[c].alias(c) for c in ("a", "l", "r", "n", "score")))
    parts = phrases.where("size > 2").select("lang", "size", F.col("f").alias("around"), words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    parts = parts.select("lang", "around", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inner = parts.select("lang", _part(F.col("w"), F.col("at"), F.col("m")).alias("phrase"), "around").groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    left = lowest.join(inner, ["lang", "phrase"], "left").where("around IS NULL OR 100 * around < 100 * a")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

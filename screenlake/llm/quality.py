r"""Operator 1: quality by compression bands, beside base counts of words, symbols and repeats.

A text's zstandard ratio (compressed / plain bytes) must lie in a band that depends on its length: below it the text repeats
itself, above it it is noise. The same holds for the least and the greatest ratio of its chunks of ``chunk`` bytes, the last of which
ends where the text ends; a text no longer than a chunk is its own chunk. ``learn`` takes the limits of each half-octave of length from texts
labelled good outside the held-out fold, with those of neighbouring lengths where there are few; without enough labels the
fixed points of ``BANDS`` hold, linear in log2 of the length.

Scale: one narrow pass over the table, no shuffle, and for the limits one more over two thirds of it, whose numbers, not
texts, meet the labels; memory is one batch of rows. All labelled rows are learned from.

Defined cases: null, empty and wordless texts have no words and fail the base rule; ratios of empty texts are null; labels that are null or neither 0 nor 1 are not
learned from; documents with several labels count as their least.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.functions.storage import stored
from screenlake.llm.text import plain_words
from screenlake.llm.toxicity import fold_of

#: log2 of the length in bytes, least ratio, greatest ratio
BANDS = [(5, 0.0, 9.0), (6, 0.0, 1.45), (7, 0.30, 1.25), (8, 0.32, 1.05), (9, 0.34, 0.92), (10, 0.34, 0.84), (11, 0.30, 0.80), (12, 0.27, 0.77), (13, 0.24, 0.75), (14, 0.22, 0.75), (17, 0.18, 0.75)]
SYMBOLS = b"#*$%&|<>"


def band(size: int) -> tuple[float, float]:
    x = math.log2(max(size, 1))
    if x <= BANDS[0][0]:
        return BANDS[0][1:]
    for (x0, a0, b0), (x1, a1, b1) in zip(BANDS, BANDS[1:], strict=False):
        if x <= x1:
            t = (x - x0) / (x1 - x0)
            return a0 + t * (a1 - a0), b0 + t * (b1 - b0)
    return BANDS[-1][1:]


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    wins = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(wins)
    if len(count) == n:
        return 0
    covered, end = 0, 0  # end: words before it are counted already
    for i, w in enumerate(wins):
        if count[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def length_class(size: int) -> int:
    """Half-octaves of length."""
    return math.floor(2 * math.log2(max(size, 1)))


class Limits(NamedTuple):
    """(least, greatest) of the whole ratio, the least and the greatest chunk ratio, by length class; classes beyond those known have the nearest one's."""

    known: dict[int, list[tuple[float, float]]]
    chunk: int

    def of(self, size: int) -> list[tuple[float, float]]:
        if not self.known:
            return [band(size), band(min(size, self.chunk)), band(min(size, self.chunk))]
        at = length_class(size)
        return self.known[at if at in self.known else min(self.known, key=lambda c: (abs(c - at), c))]


def fitted(rows: DataFrame, chunk: int, share: float = 0.001, slack: float = 0.02, need: int = 200) -> Limits:
    """Limits from all rows (size, ratio, least, most) of good texts: their quantiles at ``share`` and 1 - ``share``, wider by ``slack``, over as many neighbouring classes as give ``need`` rows.

    Ratios count to five places, so a quantile holds a bounded number of them; counts and limits of each class reach the driver.
    """
    octave = F.length(F.bin("size")) - 1
    upper = F.col("size") * F.col("size") >= F.call_function("shiftleft", F.lit(1).cast("long"), 2 * octave + 1)
    rows = rows.withColumn("own", 2 * octave + upper.cast("int"))  # length_class in whole numbers
    counts = {r.own: r.n for r in rows.groupBy("own").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) < need:
        return Limits({}, chunk)
    used: dict[int, list[int]] = {c: [] for c in counts}  # the classes whose limits a class takes part in
    for c in range(min(counts), max(counts) + 1):
        reach = next(r for r in range(max(counts) - min(counts) + 1) if sum(n for k, n in counts.items() if abs(k - c) <= r) >= need)
        for k in counts:
            if abs(k - c) <= reach:
                used[k].append(c)
    to = F.create_map(*[x for k, cs in used.items() for x in (F.lit(k), F.array(*map(F.lit, cs)))])
    ends = F.array(F.lit(share), F.lit(1 - share))
    told = rows.withColumn("of", F.explode(to[F.col("own")])).groupBy("of").agg(*(F.percentile(F.round(c, 5), ends).alias(c) for c in ("ratio", "least", "most"))).collect()
    return Limits({r.of: [(low * (1 - slack), high * (1 + slack)) for low, high in (r.ratio, r.least, r.most)] for r in told}, chunk)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, least double, most double, chunks long, size long, within boolean"


def _measures(limits: Limits, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, chunk = zstandard.ZstdCompressor(level=level), limits.chunk
        share = lambda part: len(press.compress(part)) / len(part)
        for batch in batches:
            rows = []
            for cell in batch.column(1).cast(pa.binary()):
                b = cell.as_py() or b""
                words = plain_words(b)
                # code points of words: bytes that begin one, without the white space
                base = [len(words), len(b.translate(None, _INNER)), len(b) - len(b.translate(None, SYMBOLS)), dup_lines(b), repeat_words(words)]
                starts = sorted({*range(0, len(b) - chunk + 1, chunk), max(0, len(b) - chunk)}) if b else []
                ratios = [share(b[k : k + chunk]) for k in starts]
                found = [share(b), min(ratios), max(ratios)] if b else [None] * 3
                within = bool(b) and all(low <= x <= high for x, (low, high) in zip(found, limits.of(len(b)), strict=True))
                rows.append((*base, *found, len(ratios), len(b), within))
            kinds = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.int64()] * 2 + [pa.bool_()]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *NAMES, "ratio", "least", "most", "chunks", "size", "within"])

    return run


_INNER = bytes([*range(0x80, 0xC0), 0x20, *range(0x09, 0x0E)])  # bytes that begin no code point, and white space


FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def learn(docs: DataFrame, labels: DataFrame, chunk: int = 512, level: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Limits:
    """Limits from all documents labelled 1 that pass the base rule, outside the held-out fold (crc32(doc_id as text) mod 3 = 1)."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("good")).where("doc_id IS NOT NULL AND good IN (0, 1)").where(fold_of(F.col("doc_id")) != 1)
    marks = marks.groupBy("doc_id").agg(F.min("good").alias("good")).where("good = 1").select("doc_id")
    # texts are measured where they lie: only their numbers meet the labels, however many there are
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").where(fold_of(F.col("doc_id")) != 1)
    kind = rows.schema["doc_id"].dataType.simpleString()
    good = rows.mapInArrow(_measures(Limits({}, chunk), level), f"doc_id {kind}, {MEASURES}").where(f"NOT ({FAILED})").join(marks, "doc_id").select("size", "ratio", "least", "most")
    return fitted(stored(good, "good-texts"), chunk)


def quality(docs: DataFrame, limits: Limits = Limits({}, 512), level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, base counts, ratio, the least and greatest ratio of its chunks, their number, size, within (all three in their bands), base_failed and kept."""
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = cut.schema["doc_id"].dataType.simpleString()
    m = cut.mapInArrow(_measures(limits, level), f"doc_id {kind}, {MEASURES}")
    failed = F.expr(FAILED)
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("within"))

"""Where short texts occur inside long ones.

Needles fall into classes by length, each up to twice as long as the one before, and are known by their first letters, as many as the least of the class has. A Bloom filter
of these beginnings tells the places of the texts where a needle may stand while texts are scanned, so neither texts nor their places are shuffled: what travels is the piece
at such a place, which is compared with the needles of that beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 1 << 28  # of a Bloom filter of pieces; one that fills up only prunes less
STARTS = 1 << 26  # of a Bloom filter of beginnings, likewise
MOST_HELD = 100_000
LONGEST = 256  # letters of a beginning


def _widths(width: int) -> list[int]:
    out = [width]
    while 2 * out[-1] <= LONGEST:
        out.append(2 * out[-1])
    return out


def _each_width(letters: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each width, a hash of so many letters from each place on; a width is twice the one before."""
    h = np.zeros(max(len(letters) - widths[0] + 1, 0), np.uint64)
    for k in range(widths[0]):
        h = h * np.uint64(0x100000001B3) + letters[k : k + len(h)]
    for w in widths:
        if w > widths[0]:
            n = max(len(letters) - w + 1, 0)
            h = h[:n] * np.uint64(pow(0x100000001B3, w // 2, 1 << 64)) + h[w // 2 : w // 2 + n]
        yield w, h


def _mixed(h: np.ndarray, seed: np.ndarray, width: int) -> np.ndarray:
    h = (h ^ seed ^ np.uint64(width)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def _letters(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, and where each text ends."""
    return np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8), texts.str.len().cumsum().to_numpy()


def _beginnings(widths: list[int]):
    """The key of a needle: a hash of its ``by`` (seed), its class and the letters that it begins with."""

    @F.pandas_udf(T.LongType())
    def key(needle: pd.Series, seed: pd.Series) -> pd.Series:
        n, out = needle.str.len().to_numpy(), np.zeros(len(needle), np.uint64)
        of = np.searchsorted(widths, n, side="right") - 1
        for k, w in enumerate(widths):
            rows = np.flatnonzero(of == k)
            if len(rows):
                letters, _ = _letters(needle.iloc[rows].str.slice(0, w))
                h = next(h for v, h in _each_width(letters, widths) if v == w)[::w]
                out[rows] = _mixed(h, seed.to_numpy()[rows].view(np.uint64), w)
        return pd.Series(out.view(np.int64))

    return key


def _bloom(keys: DataFrame, bits: int, places) -> np.ndarray:
    """The Bloom filter of column ``key``: bits are or-ed by Spark, at most ``bits`` / 64 rows reach the driver."""
    at = keys.select(F.explode(places("key")).alias("at"))
    cells = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out


def _at(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The three places of a hash in a filter."""
    return [hashes >> np.uint64(s) & np.uint64(bits - 1) for s in (0, 18, 36)]


def _holds(filled: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of ``hashes`` that may be in the filter."""
    may = np.arange(len(hashes))
    for shift in (0, 18, 36):
        at = hashes[may] >> np.uint64(shift) & np.uint64(bits - 1)
        may = may[(filled[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return may


def occurrences(needles: DataFrame, texts: DataFrame, width: int, by: list[str] | None = None, begun: bool = False) -> DataFrame:
    """(*by, needle, text, at): every place (from 0) at which a needle of ``width`` letters and more stands in a text with its ``by`` columns; ``begun``: only where texts begin with it.

    ``needles``: *by, needle; ``texts``: *by, text; both of folded letters and digits, repeats count once.
    """
    by, widths = by or [], _widths(width)
    spark, seed = needles.sparkSession, F.xxhash64(F.lit(0), *by).alias("seed")
    asked = needles.select(*by, "needle").where(F.length("needle") >= width).distinct()
    asked = asked.select(*by, "needle", _beginnings(widths)("needle", seed).alias("key"))
    held = texts.select(*by, "text").where(F.length("text") >= width).distinct()

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def places(key: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(_at(key.to_numpy().view(np.uint64), STARTS), axis=1).astype(np.int64)), dtype="object")

    known = spark.sparkContext.broadcast(_bloom(asked.select("key").distinct(), STARTS, places))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled = known.value
        for pdf in (b.iloc[k : k + 2048] for b in batches for k in range(0, len(b), 2048)):
            letters, ends = _letters(pdf["text"])
            every, size = letters.tobytes().decode("ascii"), np.diff(ends, prepend=0)
            first, seeds = ends - size, pdf["seed"].to_numpy().view(np.uint64)
            of = np.repeat(np.arange(len(pdf)), size)
            out: list[tuple] = []
            for w, h in _each_width(letters, widths):
                at = first[size >= w] if begun else np.flatnonzero(np.arange(len(h)) + w <= ends[of[: len(h)]])
                keys = _mixed(h[at], seeds[of[at]], w)
                may = _holds(filled, keys, STARTS)
                at, keys = at[may], keys[may].view(np.int64)
                row = of[at]
                last = ends[row] if w == widths[-1] else np.minimum(ends[row], at + 2 * w - 1)
                tids = pdf["tid"].to_numpy()[row]
                out += [(k, t, p, every[a:b]) for k, t, p, a, b in zip(keys.tolist(), tids.tolist(), (at - first[row]).tolist(), at.tolist(), last.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["key", "tid", "at", "piece"])

    tid = F.xxhash64("text", *by).alias("tid")
    may = held.select("text", seed, tid).mapInPandas(run, "key long, tid long, at int, piece string")
    met = asked.join(may, "key").where("startswith(piece, needle)").select(*by, "needle", "tid", "at")
    return met.join(held.withColumn("tid", tid), [*by, "tid"]).select(*by, "needle", "text", "at")


def window_hashes(letters: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` letters from each place on."""
    out = np.zeros(max(len(letters) - width + 1, 0), np.uint64)
    for k in range(width):
        out = out * np.uint64(0x100000001B3) + letters[k : k + len(out)]
    out = (out ^ out >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


def _piece_filter(pieces: DataFrame, width: int):
    """The broadcast Bloom filter of column ``piece``."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def places(piece: pd.Series) -> pd.Series:
        hashes = window_hashes(np.frombuffer("".join(piece).encode("ascii"), np.uint8), width)[::width]
        return pd.Series(list(np.stack(_at(hashes, BITS), axis=1).astype(np.int64)), dtype="object")

    return pieces.sparkSession.sparkContext.broadcast(_bloom(pieces.withColumnRenamed("piece", "key"), BITS, places))


def longest_after(pieces: DataFrame, texts: DataFrame, width: int, least: int, most: int) -> DataFrame:
    """(piece, doc, n, t): what follows a piece of ``width`` letters in the texts (doc, text), at least ``least`` letters, cut at ``most``; of each piece the longest of a document,
    ties by text, in the two documents that have the longest.

    A filter of all pieces tells the places of a text that may hold one, and a task keeps two tails a piece, so neither texts nor the places are shuffled. The filter errs on the side
    of more: what is no piece is told too, and drops out where pieces are joined.
    """
    known = _piece_filter(pieces.select("piece").where(F.length("piece") == width).distinct(), width)
    kind = texts.schema["doc"].dataType.simpleString()

    def better(held: dict[str, list[tuple]], piece: str, new: tuple) -> None:
        old = held.get(piece)
        if old is None:
            held[piece] = [new]
        elif len(old) < 2 or new[:2] > old[1][:2]:
            mine = next((k for k, x in enumerate(old) if x[2] == new[2]), None)
            if mine is None:
                old.append(new)
            elif new[:2] > old[mine][:2]:
                old[mine] = new
            old.sort(key=lambda x: x[:2], reverse=True)
            del old[2:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, held = known.value, {}
        flush = lambda: pd.DataFrame([(p, d, n, t) for p, two in held.items() for n, t, d in two], columns=["piece", "doc", "n", "t"])
        for pdf in batches:
            if not len(pdf):
                continue
            ends = pdf["text"].str.len().cumsum().to_numpy()
            every = "".join(pdf["text"])
            hashes = window_hashes(np.frombuffer(every.encode("ascii"), np.uint8), width)
            at = _holds(bits, hashes, BITS)
            row = np.searchsorted(ends, at, side="right")
            left = ends[row] - at - width
            at, row, left = (x[left >= least] for x in (at, row, left))
            docs = pdf["doc"].to_numpy()[row]
            for a, n, doc in zip(at.tolist(), np.minimum(left, most).tolist(), docs.tolist(), strict=True):
                better(held, every[a : a + width], (n, every[a + width : a + width + n], doc))
                if len(held) >= MOST_HELD:
                    yield flush()
                    held.clear()
        yield flush()

    found = texts.where(F.length("text") >= width + least).select("doc", "text").mapInPandas(run, f"piece string, doc {kind}, n int, t string")
    own = found.repartition("piece").groupBy("piece", "doc").agg(F.max(F.struct("n", "t")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("piece").orderBy(F.desc("best")))
    return own.withColumn("rank", rank).where("rank <= 2").select("piece", "doc", "best.n", "best.t")

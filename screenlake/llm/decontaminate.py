r"""Operator 5: benchmark passages found with an FM-index per training shard.

A shard is the run of documents one task holds at a time, bounded in words. Its words become numbers
(0: not a word of the benchmark), stretches that are too short to hold any window are left out, and the rest
gets a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled every
``sample`` words. All windows of the benchmark are searched backward at once; each row of a match walks by
LF steps to a sampled position. Overlapping matches merge to removal spans.

Scale: the documents are read once, in place, with no shuffle. The benchmark is a query set, cut by
hash of its item into blocks of at most ``block_words`` words, whose size is measured first; a task holds one block at a time,
and several blocks mean several passes over the same rows, each adding its spans to what a row has.

Defined cases: a null or wordless text has no words and no hit; items without words are ignored; an item
shorter than ``width`` is one window; an item that repeats counts once; a null item_id is ignored; rows that repeat stay
apart, as rows of one doc_id and unlike texts do. Columns of ``docs`` pass through ``cut_benchmark`` unchanged whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.functions.storage import stored
from screenlake.llm.text import folded_words


class WaveletMatrix:
    """Ranks and symbols of a sequence over 0..sigma-1, one array of counted bits a level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        for bit in reversed(range(max(1, (sigma - 1).bit_length()))):
            ones = ((seq >> bit) & 1).astype(bool)
            count = np.zeros(len(seq) + 1, np.int64)
            np.cumsum(ones, out=count[1:])
            self.levels.append((bit, ones, count, len(seq) - int(count[-1])))
            seq = np.concatenate((seq[~ones], seq[ones]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Times that each symbol occurs before its position i."""
        start = np.zeros_like(i)
        for bit, _, count, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            i = np.where(one, zeros + count[i], i - count[i])
            start = np.where(one, zeros + count[start], start - count[start])
        return i - start

    def at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for bit, ones, count, zeros in self.levels:
            one = ones[i]
            out |= one.astype(np.int64) << bit
            i = np.where(one, zeros + count[i], i - count[i])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be the only least one."""
    rank, step = text.astype(np.int64), 1
    while True:
        nxt = np.zeros_like(rank)
        nxt[: len(rank) - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        rank[order] = new
        if new[-1] == len(text) - 1 or step >= len(text):
            return order
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        """text: symbols from 1 up; a 0 is put at its end."""
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n, self.tree = len(text), WaveletMatrix(bwt, sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.marked = order % sample == 0
        self.kept, self.mark_rank = order[self.marked], np.cumsum(self.marked) - 1

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of a 2-D array at once: the range of suffixes that begin with each."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            c = patterns[live, k]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by LF steps to a sampled one."""
        out, at, todo, steps = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            here = self.marked[at[todo]]
            done = todo[here]
            out[done] = self.kept[self.mark_rank[at[done]]] + steps
            todo = todo[~here]
            c = self.tree.at(at[todo])
            at[todo] = self.before[c] + self.tree.rank(c, at[todo])
            steps += 1
        return out


class Windows:
    """Distinct windows of a block of the benchmark as numbers, by length, with the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in folded_words(text)]
            for k in range(max(1, len(ids) - width + 1)) if ids else ():
                found[tuple(ids[k : k + width])].add(item)
        lengths = sorted({len(w) for w in found})
        self.by_length = [(n, np.array([w for w in found if len(w) == n], np.int64), [sorted(x) for w, x in found.items() if len(w) == n]) for n in lengths]
        self.least = lengths[0] if lengths else 0


def _stretches(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and positions of the runs of known words that are long enough, each closed by the 0 that follows it."""
    known = np.concatenate(([0], ids > 0, [0])).astype(np.int8)
    edge = np.diff(known)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    start, size = start[long], end[long] - start[long] + 1
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    return ids[at], at


def scan(texts: list[bytes | None], windows: Windows, shard_words: int, sample: int = 8) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text its words, merged spans of hit words, and the items with a window in it."""
    out: list[tuple[int, list[tuple[int, int]], set[str]]] = []
    part: list[np.ndarray] = []
    get = windows.vocab.get

    def index(parts: list[np.ndarray]) -> None:
        first = len(out) - len(parts)
        begins = np.cumsum([0] + [len(p) for p in parts])
        symbols, at = _stretches(np.concatenate(parts), windows.least)
        if not len(symbols):
            return
        fm = FMIndex(symbols + 1, len(windows.vocab) + 2, sample)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, patterns, items in windows.by_length:
            low, high = fm.search(patterns + 1)
            hits = np.flatnonzero(low < high)
            many = high[hits] - low[hits]
            which = np.repeat(hits, many)
            rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[hits], many)
            pos = at[fm.locate(rows)]
            doc = np.searchsorted(begins, pos, side="right") - 1
            for d, p, w in zip(doc.tolist(), (pos - begins[doc]).tolist(), which.tolist(), strict=True):
                spans[d].append((p, p + n))
                out[first + d][2].update(items[w])
        for d, found in spans.items():
            merged = out[first + d][1]
            for a, b in sorted(found):
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))

    held = 0
    for text in texts:
        words = folded_words(text)
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        out.append((len(words), [], set()))
        part.append(np.append(ids, 0))
        held += len(ids) + 1
        if held >= shard_words:
            index(part)
            part, held = [], 0
    if part:
        index(part)
    return out


class Blocks:
    """The benchmark in blocks that fit a task; sizes are measured before any row is fetched, and the driver holds one block at a time."""

    def __init__(self, bench: DataFrame, width: int, block_words: int, item_col: str, text_col: str):
        self.rows = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
        size = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.width, self.count = width, max(1, math.ceil(size / 4 / block_words))

    def __iter__(self) -> Iterator[Windows]:
        for k in range(self.count):
            block = self.rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.count)) == k)
            yield Windows([(r.item, r.text.encode()) for r in block.distinct().collect()], self.width)


SPANS, ITEMS = "array<struct<start:bigint,end:bigint>>", "array<string>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searched(rows: DataFrame, blocks: Blocks, shard_words: int, sample: int) -> DataFrame:
    """``rows`` (with a string column text) with n_words, spans and items, row by row."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out, kept = rows.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast(ITEMS)}), rows.columns
    for turn, windows in enumerate(blocks):

        def run(batches: Iterator[pa.RecordBatch], windows: Windows = windows) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = scan(batch.column("text").cast(pa.binary()).to_pylist(), windows, shard_words, sample)
                spans = [_merged([*((x["start"], x["end"]) for x in old), *new]) for old, (_, new, _) in zip(batch.column("spans").to_pylist(), found, strict=True)]
                items = [sorted({*old, *new}) for old, (_, _, new) in zip(batch.column("items").to_pylist(), found, strict=True)]
                own = [batch.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array([n for n, _, _ in found], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span), pa.array(items, pa.list_(pa.string()))], [*kept, "n_words", "spans", "items"])

        out = out.mapInArrow(run, out.schema)
        if turn:  # a worker holds one block
            out = stored(out, "hits")
    return out


def benchmark_hits(docs: DataFrame, bench: DataFrame, width: int = 10, shard_words: int = 1 << 20, block_words: int = 1 << 20, sample: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans array<struct<start,end>> in words, items array<string>) per row of ``docs``."""
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _searched(cut, Blocks(bench, width, block_words, item_col, item_text), shard_words, sample).drop("text")


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the characters from each span's first word to its last; a line end stands for each."""
    raw = text.encode()
    fold = raw.translate(_LETTER)
    edge = np.diff(np.concatenate(([0], np.frombuffer(fold, np.uint8), [0])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : start[a]])
        last = int(end[b - 1])
    return b"\n".join([*out, raw[last:]]).decode()


_LETTER = bytes(int(0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80) for c in range(256))


def cut_benchmark(docs: DataFrame, bench: DataFrame, width: int = 10, shard_words: int = 1 << 20, block_words: int = 1 << 20, sample: int = 8, text_col: str = "text", chars_col: str = "n_chars", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with every removal span cut out of its text, until no window is left; the integer length column of a cut text, if there is one, follows.

    The spans of all blocks of the benchmark are cut at once. What a cut joins may be a window again: a text that was cut is searched
    again, in the same task where the benchmark is one block, else with the other cut texts, by all blocks.
    """
    blocks = Blocks(bench, width, block_words, item_col, item_text)
    alone = next(iter(blocks)) if blocks.count == 1 else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, todo = batch.column("text").to_pylist(), [(i, x) for i, x in enumerate(batch.column("spans").to_pylist()) if x]
            hit = batch.column("hit").to_pylist()
            while todo:
                for i, x in todo:
                    texts[i], hit[i] = _without(texts[i], [(y["start"], y["end"]) for y in x]), True
                at = [i for i, _ in todo]
                found = scan([texts[i].encode() for i in at], alone, shard_words, sample) if alone else []
                todo = [(i, [{"start": a, "end": b} for a, b in x]) for i, (_, x, _) in zip(at, found, strict=False) if x]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(hit, pa.bool_()), batch.column("spans")], ["row", "text", "hit", "spans"])

    others = [c for c in docs.columns if c != text_col]
    live, done = docs.select(F.struct(*(map(F.col, others) if others else [F.lit(0)])).alias("row"), F.col(text_col).cast("string").alias("text"), F.lit(False).alias("hit")), None
    while True:
        found = _searched(live, blocks, shard_words, sample).select("row", "text", "hit", "spans")
        new = found.mapInArrow(cut, found.schema)
        if alone:
            done = new
            break
        new = stored(new, "cut")
        rest = new.where(F.size("spans") == 0)
        done, live = rest if done is None else done.unionByName(rest), new.where(F.size("spans") > 0).select("row", "text", "hit")
        if live.isEmpty():
            break
    now = {text_col: F.col("text").cast(docs.schema[text_col].dataType)}
    if chars_col in others:
        now[chars_col] = F.when(F.col("hit"), F.length("text").cast(docs.schema[chars_col].dataType)).otherwise(F.col("row").getField(chars_col))
    return done.select(*(now[c].alias(c) if c in now else F.col("row").getField(c).alias(c) for c in docs.columns))

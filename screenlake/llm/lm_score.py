r"""Operator 7: stupid-backoff scores from n-gram counts over the whole corpus.

A document's score is the sum over its words of log10 S: where the word's n-gram of the highest ``order`` occurs elsewhere, its count over that of its
context; else ``backoff`` times the same of the next lower order; at last the word's count over all words, 1 for words met nowhere else (Brants et al., "Large
Language Models in Machine Translation"). At a document's start the orders that reach before it are backed off from. Counts
are over all documents without the scored one, else every n-gram would be known.

The relations are columnar: documents are encoded to blocks (runs of an Arrow batch up to ``block_words`` words) with local word numbers; each block
explodes to its distinct n-grams with their counts, cut by hash range into the partitions of the count table; a partition sums
what all blocks sent and joins the sums back to each block's n-grams; the block sums per document. A plain row per n-gram and block takes the same
steps, but three times the bytes.

Scale: an n-gram is sent once a block, so no word or n-gram is hot however frequent; partitions hold about
``part_grams`` n-grams, and their number follows the corpus. Two shuffles: n-grams by partition, their counts by block. A block sends a row to each partition,
so rows get shorter as the corpus grows: 1.5 million words fill 4,000 partitions with some hundred n-grams each; beyond about a million words' worth of
partitions (a few TB) ``part_grams`` should grow with the memory of a task.

Defined cases: null, empty and wordless texts score 0 with 0 words; rows that repeat count as often as they occur; a corpus of
one document knows nothing else, so all its words are unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from screenlake.functions.storage import stored
from screenlake.llm.text import U, WordHashes, mixed, plain_words

NEW = U(0x2545F4914F6CDD1D)  # stands before a document's first word


def _pack(a: np.ndarray) -> bytes:
    """An array of integers, its bytes sorted by place, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=U(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, U), dtype=U)


def _encoded(block_words: int):
    def block(ids: pa.Array, texts: list[list[bytes]], hashes: WordHashes) -> pa.RecordBatch:
        size = np.array([len(t) for t in texts], np.int32)
        h = np.concatenate([hashes.of(t) for t in texts]) if texts else np.zeros(0, U)
        words, number, count = np.unique(h, return_inverse=True, return_counts=True)
        often = np.argsort(-count, kind="stable")  # frequent words get small numbers, which pack better
        place = np.empty(len(words), np.int32)
        place[often] = np.arange(len(words), dtype=np.int32)
        name = xxhash.xxh3_64_intdigest(h.tobytes() + repr(ids.to_pylist()).encode()) >> 1
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([_pack(size)]), pa.array([_pack(words[often])]), pa.array([_pack(place[number])]), pa.array([len(h)], pa.int64())], ["block", "ids", "sizes", "words", "tokens", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            first, held, texts = 0, 0, []
            for k, t in enumerate(batch.column(1).cast(pa.binary())):
                texts.append(plain_words(t.as_py()))
                held += len(texts[-1])
                if held >= block_words or k == len(batch) - 1:
                    yield block(batch.column(0).slice(first, len(texts)), texts, hashes)
                    first, held, texts = k + 1, 0, []

    return run


def _grams(sizes: bytes, words: bytes, tokens: bytes, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(document, place in it, hashes of the n-grams of 1 to ``order`` words that it ends) of each token; those that reach before the document are of no text."""
    size, word = _unpack(sizes, np.int32), mixed(_unpack(words, U))
    h = word[_unpack(tokens, np.int32)]
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    grams = [h]
    for n in range(1, order):
        before = np.where(place > 0, np.concatenate(([NEW], grams[-1][:-1])) if len(h) else h, NEW)
        grams.append(mixed(before * U(0x9E3779B97F4A7C15) + h))
    return doc, place, grams


def _cuts(parts: int) -> np.ndarray:
    return np.array([k * (1 << 64) // parts for k in range(1, parts)], U)


def _requests(parts: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _cuts(parts)
        for batch in batches:
            for block, sizes, words, tokens in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                out = []
                for n_words, x in enumerate(_grams(sizes, words, tokens, order)[2], 1):
                    keys, n = np.unique(x, return_counts=True)
                    ends = np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)]))
                    out += [(p, block, n_words, _pack_sorted(keys[a:b]), _pack(n[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "order", "keys", "counts"])

    return run


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The count table of each (part, order): rows arrive sorted by both."""
    held: list[tuple[int, bytes, bytes]] = []
    now = None

    def told() -> pa.RecordBatch:
        keys = [_unpack_sorted(k) for _, k, _ in held]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_unpack(n, np.uint32) for _, _, n in held]), minlength=len(every))[at]
        ends = np.cumsum([len(k) for k in keys])
        out = [_pack(x.astype(np.int64)) for x in np.split(total, ends[:-1])]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in held], pa.int64()), pa.array([now[1]] * len(held), pa.int32()), pa.array([now[0]] * len(held), pa.int32()), pa.array(out, pa.binary())], ["block", "order", "part", "counts"])

    for batch in batches:
        for part, block, order, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if (part, order) != now and held:
                yield told()
                held = []
            now = (part, order)
            held.append((block, keys, counts))
    if held:
        yield told()


def _scored(total: int, order: int, backoff: float, kind: pa.DataType):
    def own(doc: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
        _, back, n = np.unique(doc.astype(np.int64) * most + at, return_inverse=True, return_counts=True)
        return n.astype(np.int32)[back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, words, tokens, told in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                doc, place, grams = _grams(sizes, words, tokens, order)
                size = _unpack(sizes, np.int32).astype(np.int64)
                rest = np.maximum(total - size, 1)[doc]
                context, unseen, known, s = None, None, np.zeros(len(doc), bool), np.zeros(len(doc))
                for n, x in enumerate(grams, 1):
                    keys, at = np.unique(x, return_inverse=True)
                    every = [_unpack(r["counts"], np.int64) for _, r in sorted({r["part"]: r for r in told or [] if r["order"] == n}.items())]
                    elsewhere = (np.concatenate(every)[at] if every else np.zeros(0, np.int64)) - own(doc, at, len(keys) + 1)
                    if n == 1:
                        unseen, s = elsewhere <= 0, backoff ** (order - 1) * np.maximum(elsewhere, 1) / rest
                        known = np.full(len(doc), order == 1)
                    else:
                        known = (place >= n - 1) & (elsewhere > 0) & (context > 0)
                        s = np.where(known, backoff ** (order - n) * elsewhere / np.maximum(context, 1), s)
                    context = np.concatenate(([0], elsewhere[:-1])) if len(elsewhere) else elsewhere
                add = lambda v: np.bincount(doc, weights=v, minlength=len(size))
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(size, pa.int64()), pa.array(add(np.log10(s)), pa.float64()), pa.array(add(~known).astype(np.int64)), pa.array(add(unseen).astype(np.int64))], ["doc_id", "n_words", "log10_score", "n_backoff", "n_unseen"])

    return run


def backoff_scores(docs: DataFrame, order: int = 2, backoff: float = 0.4, block_words: int = 1_500_000, part_grams: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log10_score, n_backoff, n_unseen) per row of ``docs``."""
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = cut.schema["doc_id"].dataType.simpleString()
    blocks = stored(cut.mapInArrow(_encoded(block_words), f"block long, ids array<{kind}>, sizes binary, words binary, tokens binary, n long"), "blocks")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    parts = max(16, order * total // part_grams)
    ask = blocks.select("block", "sizes", "words", "tokens").mapInArrow(_requests(parts, order), "part int, block long, order int, keys binary, counts binary")
    ask = ask.repartition("part").sortWithinPartitions("part", "order")
    told = ask.mapInArrow(_replies, "block long, order int, part int, counts binary")
    told = told.groupBy("block").agg(F.collect_list(F.struct("order", "part", "counts")).alias("told"))
    both = blocks.join(told, "block", "left").select("ids", "sizes", "words", "tokens", "told")
    return both.mapInArrow(_scored(total, order, backoff, to_arrow_type(cut.schema["doc_id"].dataType)), f"doc_id {kind}, n_words long, log10_score double, n_backoff long, n_unseen long")

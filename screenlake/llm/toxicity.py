r"""Operator 10: toxic passages as maximal-scoring segments of token log-odds.

Tokens weigh their log-odds between toxic and other labelled documents, counted once a document, under an
informative Dirichlet prior, the counts of both together (Monroe, Colaresi and Quinn, "Fightin' Words"). A token
stands for a word or a word's beginning of 4 to 10 bytes; a word takes the weight of its most specific learned
token. Words without one cost a fixed drift, so that clean text scores below zero. One linear scan (Ruzzo and Tompa) finds every maximal segment; a segment's score S
has the E-value K n exp(-lambda S) in a text of n tokens (Karlin and Altschul), with lambda and K from the
tokens of the other documents. The evidence of all segments, sum of max(0, lambda S - ln K' n), goes
through a logistic curve fitted on the labelled rows.

Scale: learning is one pass with map-side counts; the number of labelled rows is bounded by ``most_rows`` (by
hash of doc_id), which also bounds the lexicon: a token must tell the two sides of these rows apart. So what is broadcast is bounded. Scoring is one narrow pass over whole texts.

Defined cases: null, empty and wordless texts have no segment and the score of no evidence; labels that are null are not
learned from; with no toxic or no other label the score is 0 for all; rows that repeat count as often as they occur.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.functions.storage import stored
from screenlake.llm.text import folded_words


class Model(NamedTuple):
    weights: dict[bytes, float]
    drift: float
    scale: float  # lambda
    space: float  # K
    slope: float
    base: float


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def stems(word: bytes) -> list[bytes]:
    """A word and its longer beginnings, the most specific first; a `*` marks a beginning."""
    return [word, *(word[:k] + b"*" for k in range(min(len(word), LONGEST), SHORTEST - 1, -1))]


SHORTEST, LONGEST = 4, 10  # bytes of a stem


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told() -> Iterator[pa.RecordBatch]:
        for toxic, c in enumerate(seen):
            stem = Counter()
            for w, n in c.items():
                for x in stems(w):
                    stem[x] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(stem), pa.binary()), pa.array([toxic] * len(stem), pa.int32()), pa.array(list(stem.values()), pa.int64())], ["token", "toxic", "n"])
            c.clear()

    seen = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
            seen[toxic].update(set(folded_words(text.as_py())))
            if len(seen[0]) + len(seen[1]) > 100_000:
                yield from told()
    yield from told()


class WordWeights(dict):
    """Weights of words met so far: that of the most specific learned stem, else 0. Forgets all at 500,000 words."""

    def __init__(self, learned: dict[bytes, float]):
        self.learned = learned

    def __missing__(self, word: bytes) -> float:
        if len(self) >= 500_000:
            self.clear()
        w = self[word] = next((self.learned[x] for x in stems(word) if x in self.learned), 0.0)
        return w


def segments(at: list[int], weight: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last) where the tokens at positions ``at`` weigh ``weight`` and all others -drift.

    Ruzzo and Tompa's scan, linear by its back links; a run of drift only lowers the running sum, so only weighted tokens are visited.
    """
    kept: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    lower: list[int] = []  # of each, the nearest one to its left whose sum before is less: the scan back follows these links
    total, last = 0.0, -1
    for p, w in zip(at, weight, strict=True):
        total -= drift * (p - last - 1)
        last, before = p, total
        total += w
        if w <= 0:
            continue
        first, j = p, len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= before:
                j = lower[j]
            if j < 0 or kept[j][1] >= total:
                kept.append((before, total, first, p))
                lower.append(j)
                break
            before, first, k = kept[j][0], kept[j][2], lower[j]
            del kept[j:], lower[j:]
            j = k
    return [(r - l, a, b) for l, r, a, b in kept]


def passages(words: list[bytes], model: Model, known: WordWeights) -> tuple[float, list[tuple[float, int, int]]]:
    """The calibrated evidence of a text and its significant segments."""
    if not words or not model.weights:
        return 0.0, []
    w = np.fromiter(map(known.__getitem__, words), float, len(words))
    at = np.flatnonzero(w)
    found = segments(at.tolist(), w[at].tolist(), model.drift)
    bar = math.log(max(model.space * len(words), 1.0))
    kept = [(model.scale * s - bar, a, b) for s, a, b in found if model.scale * s > bar]
    return sum(s for s, _, _ in kept), kept


def _lambda(weights: np.ndarray, share: np.ndarray, drift: float) -> float:
    """The positive root of E exp(lambda s) = 1 over the tokens of clean text."""
    rest, low, high = 1.0 - share.sum(), 1e-6, 1.0
    f = lambda x: float((share * np.exp(np.minimum(x * weights, 600))).sum() + rest * math.exp(-x * drift)) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordWeights(model.weights)
        for batch in batches:
            x = [passages(folded_words(t.as_py()), model, known)[0] for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.float64())], ["toxic", "x"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and base by Newton's method on counted rows, with a slight pull to 0."""
    z = np.stack([x, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        step = np.linalg.solve((z * (n * p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (n * (y - p)) - 1e-3 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, prior_share: float = 0.25, least_z: float = 2.0, least_delta: float = 1.8, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows outside the held-out fold (crc32(doc_id as text) mod 3 = 1)."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fold_of(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    have = marks.count()
    if have > most_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most_rows / have * (1 << 30)))
    # about most_rows rows by now, so they may be broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marks), "doc_id").where("text is not null").groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies would make their rare words look telling; the higher label holds
    rows = stored(rows, "labelled")
    counts = stored(rows.mapInArrow(_count, "token binary, toxic int, n long").groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")), "counts")
    na, nb = counts.where(~F.endswith(F.col("token"), F.lit(b"*"))).agg(F.sum("a"), F.sum("b")).first()
    if not na or not nb:
        return Model({}, 1.0, 1.0, 1.0, 0.0, -40.0)
    # prior: a pseudo-corpus with the shares of both sides together, a part of the smaller side's size
    total = float(min(na, nb)) * prior_share
    prior = F.lit(total) * (F.col("a") + F.col("b")) / (na + nb)
    ya, yb = F.col("a") + prior, F.col("b") + prior
    delta = F.log(ya / (na + total - ya)) - F.log(yb / (nb + total - yb))
    spread = F.sqrt(1 / ya + 1 / yb)
    # the weight is the log-odds less one standard deviation, so that rare tokens weigh less than well-known ones
    best = counts.select("token", "a", "b", (delta - spread).alias("delta"), (delta / spread).alias("z")).where((F.col("z") >= least_z) & (F.col("delta") >= least_delta)).orderBy("token").collect()
    return _calibrated(rows, [(bytes(r.token), r.delta, r.b / nb) for r in best], nb)


def _calibrated(rows: DataFrame, tokens: list[tuple[bytes, float, float]], background: int) -> Model:
    weights = {t: w for t, w, _ in tokens}
    w, share = np.array([w for _, w, _ in tokens]), np.array([s for _, _, s in tokens])
    share = share / max(1.0, 4 * share.sum())  # stems overlap; their sum may not pass a quarter
    share = np.maximum(share, 1.0 / background)
    drift = max(0.05, float((w * share).sum()) + 0.05)
    scale = _lambda(w, share, drift) if len(w) and (w > 0).any() else 1.0
    # K: the share of tokens that can begin a segment
    space = max(float(share[w > 0].sum()) if len(w) else 0.0, 1.0 / background)
    model = Model(weights, drift, scale, space, 0.0, 0.0)
    bins = rows.select("text", "toxic").mapInArrow(_evidence(model), "toxic int, x double").groupBy(F.floor(F.log1p("x") * 32).alias("bin"), "toxic").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n")).collect()
    # labels that are positive without any evidence are noise, at a rate that holds everywhere
    still = {t: sum(r.n for r in bins if r.bin == 0 and r.toxic == t) for t in (0, 1)}
    noise = still[1] / max(1, still[0] + still[1]) if still[1] < still[0] else 0.0
    every = Counter()
    for r in bins:
        every[r.bin] += r.n
    x, y = np.array([r.x for r in bins]), np.array([r.toxic for r in bins])
    moved = np.array([min(noise * every[r.bin], next((s.n for s in bins if s.bin == r.bin and s.toxic == 1), 0)) for r in bins])
    n = np.array([r.n for r in bins]) + np.where(y == 1, -moved, moved)
    slope, base = _logistic(np.log1p(x), y, np.maximum(n, 0.0))
    return model._replace(slope=max(slope, 0.0), base=base)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordWeights(model.weights)
        span = pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            score, found = [], []
            for t in batch.column(1).cast(pa.binary()):
                x, kept = passages(folded_words(t.as_py()), model, known)
                score.append(1 / (1 + math.exp(-model.slope * math.log1p(x) - model.base)))
                found.append([{"score": s, "start": a, "end": b + 1} for s, a, b in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(found, span)], ["doc_id", "score", "passages"])

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages array<struct<score,start,end>> in words) per row of ``docs``."""
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = cut.schema["doc_id"].dataType.simpleString()
    return cut.mapInArrow(_scores(model), f"doc_id {kind}, score double, passages array<struct<score:double,start:bigint,end:bigint>>")


def drop_toxic(docs: DataFrame, model: Model, bar: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``bar`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordWeights(model.weights)
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            x = [passages(folded_words(t.as_py()), model, known)[0] for t in batch.column(k).cast(pa.binary())]
            keep = [1 / (1 + math.exp(-model.slope * math.log1p(v) - model.base)) < bar for v in x]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

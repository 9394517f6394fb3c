"""Operator 2: near duplicates by DartMinHash.

A document is the multiset of its five-word shingles; each shingle is an element whose weight is its
count. An element's weight is cut into regions, [0, 1), [1, 2), [2, 4), ...; each region throws hashed darts, a Poisson process of
ranks at the rate of its width, and a dart counts if it falls below the element's weight. Each dart has a hashed
coordinate; a coordinate's signature is the dart of the least rank. Two documents agree on a coordinate
with the probability of their weighted Jaccard similarity, and about k ln k + 2k darts suffice whatever
the length and the weights (Christiani, "DartMinHash: Fast Sketching for Weighted Sets").

Scale: texts of the same words are one node before anything is shuffled by band, so groups of copies of
any size cost one row each. First every member of a band's bucket is compared with the bucket's first and
last by a hash drawn anew in each band, up to 32 partners spread over its group; the links inside a component
follow. Buckets of four and more that still hold several components are then compared in full across components: their texts, in blocks of
``BLOCK`` rows, meet in a task, which passes over pairs whose signatures agree too little (at 0.8, one in a million does), checks the others exactly, joins
components as it goes and tells the links alone. Pairs inside a component are never compared, and no pair is a row unless it is a link or one of the 32.

Defined cases: null, empty and wordless texts are classes of their own row; texts of under five words
have one shingle, all their words; rows that repeat a doc_id and text share a class, and one of them is kept; rows of
one doc_id and unlike texts are documents of their own, whose class ids may be that same number; a null doc_id takes
a negative number made from its text, and one that is no integer a negative number made from the id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.functions.batches import small_batches
from screenlake.functions.graph import components
from screenlake.functions.storage import stored
from screenlake.llm.text import U, WordHashes, gram_hashes, mixed, plain_words, row_key

STEP = U(0x9E3779B97F4A7C15)


def elements(words: list[bytes], hashes: WordHashes, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles, as sorted hashes, and their counts."""
    return np.unique(gram_hashes(hashes.of(words), min(size, len(words))) if words else np.zeros(0, U), return_counts=True)


def units(words: list[bytes], hashes: WordHashes, size: int = 5) -> np.ndarray:
    """One hash for each unit of weight, for exact comparison: the c-th copy of a shingle is its own unit."""
    grams, count = elements(words, hashes, size)
    copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return mixed(np.repeat(grams, count) + copy.astype(U) * STEP)


def regions(grams: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, start, width, weight) of each region that reaches below its element's weight: [0, 1) and then each as wide as all before it."""
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    of = np.repeat(np.arange(len(grams)), levels)
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    start = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    return mixed(grams[of] + level.astype(U) * STEP), start, np.maximum(start, 1.0), weight[of].astype(float)


def _share(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers between 0 and 1."""
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signature(grams: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The dart of the least rank at each of ``k`` coordinates, as a hash."""
    reach = k * (math.log(k) + 2) / weight.sum()
    seed, start, width, most = regions(grams, weight)
    while True:
        ranks, marks, live, base, turn = [], [], np.arange(len(seed)), np.zeros(len(seed)), 0
        while len(live):
            # ranks of the next darts of all regions that are still within reach, some at a time
            some = max(1, min(64, int((reach - base.min()) * width[live].max()) + 1, 1 + 200_000 // len(live)))
            h = mixed(seed[live][:, None] + (np.arange(turn, turn + some, dtype=U) + U(1)) * STEP)
            at = base[:, None] + np.cumsum(-np.log(_share(h)), axis=1) / width[live][:, None]
            near = at < reach
            row = np.repeat(live, near.sum(axis=1))
            rank, mark = at[near], mixed(h[near] ^ U(0xD6E8FEB86659FD93))
            if start[live].any():  # in the regions of [0, 1) every dart is below the weight
                below = start[row] + width[row] * _share(mixed(mark + STEP)) < most[row]
                rank, mark = rank[below], mark[below]
            ranks.append(rank)
            marks.append(mark)
            on = near[:, -1]
            live, base, turn = live[on], at[on, -1], turn + some
        rank, mark = np.concatenate(ranks), np.concatenate(marks)
        late_first = np.argsort(-rank, kind="stable")
        out, filled = np.zeros(k, U), np.zeros(k, bool)
        where = (mark % U(k)).astype(np.int64)[late_first]
        out[where] = mark[late_first]  # of several darts at a coordinate the last assigned stays: the earliest
        filled[where] = True
        if filled.all():
            return out
        reach *= 2


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    parts, out = sig.reshape(-1, rows), np.arange(len(sig) // rows, dtype=U)
    for c in range(rows):
        out = mixed(out * STEP + parts[:, c])
    return out.view(np.int64)


def _sketches(k: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            prints, keys, marks, units = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                words = plain_words(text.as_py())
                sig = signature(*elements(words, hashes, size), k) if words else None
                prints.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                keys.append(band_keys(sig, rows) if words else None)
                marks.append((sig >> U(6)).astype(np.uint32).tobytes() if words else None)  # the bits below tell the coordinate
                units.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(units, pa.int64())], ["rid", "tag", "node", "keys", "marks", "units"])

    return run


def _reach(left: np.ndarray, right: np.ndarray, threshold: float) -> bool:
    """Whether two texts' units are as similar as ``threshold``, which counts as reached."""
    if min(len(left), len(right)) + 1e-9 < threshold * max(len(left), len(right)):
        return False
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both + 1e-9 >= threshold * (len(left) + len(right) - both)


def _similar(threshold: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, press = WordHashes(), zstandard.ZstdDecompressor()
        last, right = None, None
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != last:
                    last, right = b, units(plain_words(press.decompress(y.as_py())), hashes, size)
                keep.append(_reach(units(plain_words(press.decompress(x.as_py())), hashes, size), right, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


BLOCK, BLOCK_UNITS = 2048, 1 << 20  # texts and words of a block


def _least_agreement(k: int, threshold: float) -> int:
    """Coordinates of ``k`` on which two texts at the threshold agree but once in a million or so: five deviations below the mean."""
    return math.floor(k * threshold - 5 * math.sqrt(k * threshold * (1 - threshold)))


def _links_across(rows: list[tuple], width: int, threshold: float, size: int, hashes: WordHashes) -> list[tuple[bytes, bytes]]:
    """Links between the components of texts that meet in a block. rows: node, component, side, band, marks, zipped text; texts of one side 1 or 2 meet in another block.

    Texts that share several bands are compared in the first of them.
    """
    press, parent = zstandard.ZstdDecompressor(), {r[1]: r[1] for r in rows}

    def root(c: bytes) -> bytes:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    marks = np.stack([np.frombuffer(r[4], np.uint32) for r in rows])
    side, band = (np.array([r[k] for r in rows]) for k in (2, 3))
    least = _least_agreement(marks.shape[1], threshold)
    names = {c: k for k, c in enumerate(parent)}
    comp = np.array([names[r[1]] for r in rows])
    many = np.bincount(comp)
    known: dict[int, np.ndarray] = {}

    def unit(i: int) -> np.ndarray:
        if i not in known:
            known[i] = units(plain_words(press.decompress(rows[i][5])), hashes, size)
        return known[i]

    found, turn = [], np.lexsort((comp, many[comp]))  # small components first; the largest asks nobody
    place = np.empty(len(rows), np.int64)
    place[turn] = np.arange(len(rows))
    for i in turn:
        others = np.flatnonzero((comp != comp[i]) & (place > place[i]) & ((side != side[i]) | (side == 0)))
        same = marks[others] == marks[i]
        first = same.reshape(len(others), marks.shape[1] // width, width).all(axis=2).argmax(axis=1)
        for j in others[(same.sum(axis=1) >= least) & (first == band[i])]:
            if root(rows[i][1]) != root(rows[j][1]) and _reach(unit(i), unit(j), threshold):
                found.append(tuple(sorted((rows[i][0], rows[j][0]))))
                parent[root(rows[j][1])] = root(rows[i][1])
    return found


def _compared(width: int, threshold: float, size: int):
    """Rows sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, now = WordHashes(), [], None
        kinds = [("a", pa.binary()), ("b", pa.binary())]
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for g, *row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if g != now and held:
                    out += _links_across(held, width, threshold, size, hashes)
                    held = []
                now = g
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(kinds)], ["a", "b"])
        if held:
            out = _links_across(held, width, threshold, size, hashes)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(kinds)], ["a", "b"])

    return run


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield batch.set_column(1, "text", pa.array([press.compress(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary()))


def _across(texts: DataFrame, nodes: DataFrame, buckets: DataFrame, group: DataFrame, width: int, threshold: float, size: int) -> DataFrame:
    """(a, b): links between the components (``group``: id, component) that meet in a bucket, enough of them to join what the bucket's links join."""
    comp = group.withColumnsRenamed({"id": "node", "component": "comp"})
    tagged = stored(buckets.join(comp, "node", "left").select("node", "band", "key", "units", F.coalesce("comp", "node").alias("comp")), "buckets")
    mixed_up = tagged.groupBy("band", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("units").alias("units")).where("low <> high")
    cuts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("units") / BLOCK_UNITS)).cast("int")
    live = tagged.drop("units").join(mixed_up.select("band", "key", cuts.alias("cuts")), ["band", "key"])
    # a bucket of several blocks: each pair of blocks is a group, and a text is in as many groups as there are blocks
    live = live.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    live = stored(live.select("node", "comp", F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), side.alias("side"), "band"), "live")
    full = stored(texts.join(live.select("node").distinct().hint("merge"), "node").join(nodes.select("node", "marks"), "node"), "zipped")
    met = live.join(full.hint("merge"), "node").select("g", "node", "comp", "side", "band", "marks", "text")
    return met.repartition("g").sortWithinPartitions("g").mapInArrow(_compared(width, threshold, size), "a binary, b binary")


def near_links(docs: DataFrame, **params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(made, links, group): made has rid, tag and node, a hash of its words, of every row; links has verified pairs a < b of nodes; group (id, component) has the nodes with links."""
    with small_batches(docs.sparkSession):  # all that goes through Python is stored before this returns
        return _near_links(docs, **params)


def _near_links(docs: DataFrame, threshold: float = 0.8, bands: int = 16, rows: int = 4, size: int = 5, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    cut = docs.select(*row_key(docs, id_col, text_col), F.col(text_col).cast("string").alias("text"))
    made = stored(cut.mapInArrow(_sketches(bands * rows, rows, size), "rid long, tag long, node binary, keys array<long>, marks binary, units long"), "sketches")
    nodes = stored(made.where("node is not null").groupBy("node").agg(F.min(F.struct("rid", "tag")).alias("of"), *(F.any_value(c).alias(c) for c in ("keys", "marks", "units"))), "nodes")
    spread = nodes.select("node", "units", F.posexplode("keys").alias("band", "key"))
    order = F.struct(F.xxhash64("node", "band"), F.col("node"))
    heads = spread.groupBy("band", "key").agg(F.min(order).getField("node").alias("low"), F.max(order).getField("node").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    pairs = stored(spread.join(heads, ["band", "key"]).select("node", F.explode(F.array("low", "high")).alias("head")).where("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), "pairs")
    needed = pairs.selectExpr("explode(array(a, b)) node").distinct().join(nodes, "node").selectExpr("node", "of.rid", "of.tag")
    # a merge join at every size: the ids in pairs have no bound
    one = cut.join(needed.hint("merge"), ["rid", "tag"]).groupBy("node").agg(F.any_value("text").alias("text"))
    texts = stored(one.mapInArrow(_zipped, "node binary, text binary"), "texts")
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")  # mostly sorted by b
    links = stored(both.mapInArrow(_similar(threshold, size), "a binary, b binary"), "links")
    group = stored(components(links), "group")
    buckets = spread.join(heads.where("n > 3").select("band", "key"), ["band", "key"])  # in smaller ones the heads meet all
    more = stored(_across(texts, nodes, buckets, group, rows, threshold, size).distinct(), "links")
    # only links between components can join them further
    ca, cb = group.selectExpr("id AS a", "component AS ca"), group.selectExpr("id AS b", "component AS cb")
    joined = components(more.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    ends = group.union(more.selectExpr("explode(array(a, b)) id").distinct().join(group, "id", "left_anti").selectExpr("id", "id AS component"))
    group = ends.join(joined.selectExpr("id AS component", "component AS of"), "component", "left").select("id", F.coalesce("of", "component").alias("component"))
    return made.select("rid", "tag", "node"), links.unionByName(more), stored(group, "group")


def _classes(docs: DataFrame, **params) -> DataFrame:
    """(rid, tag, class, n_links) per row of ``docs``; class is the (rid, tag) of its least row."""
    made, links, group = near_links(docs, **params)
    count = links.selectExpr("explode(array(a, b)) node").groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    own = made.where("node is not null").groupBy("node").agg(F.min(F.struct("rid", "tag")).alias("own"))
    known = own.join(group.join(count.withColumnRenamed("node", "id"), "id").withColumnRenamed("id", "node"), "node", "left")
    least = known.where("component is not null").groupBy("component").agg(F.min("own").alias("class"))
    known = known.join(least, "component", "left").select("node", F.coalesce("class", "own").alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return made.join(known, "node", "left").select("rid", "tag", F.coalesce("class", F.struct("rid", "tag")).alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """(rid, class_id, n_links, kept) per row of ``docs``: the least rid of its connected group, its words' verified links, whether it is the row that stays."""
    return _classes(docs, **params).select("rid", F.col("class.rid").alias("class_id"), "n_links", (F.col("class") == F.struct("rid", "tag")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row of each class, the least by id and then by a hash of its text."""
    keep = _classes(docs, **params).where(F.col("class") == F.struct("rid", "tag")).select("rid", "tag").distinct()
    rows = docs.select(*row_key(docs, params.get("id_col", "doc_id"), params.get("text_col", "text")), F.struct("*").alias("row"))
    return rows.join(keep, ["rid", "tag"], "left_semi").dropDuplicates(["rid", "tag"]).select("row.*")

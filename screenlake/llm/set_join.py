"""Operator 12: documents linked by the Jaccard similarity of their shingle sets, as a size-aware heavy-light join.

A document's set is its distinct shingles; documents of one set are one node. Shingles have a fixed order, that of
their hashes. Two sets that reach the threshold share all but a few shingles, so their first ``p`` shingles meet, and by every further shingle that
both show one more is shared. Light sets, smaller than a boundary, send each subset of two of the first p + 1 shingles (and a margin);
heavy ones send single shingles into inverted lists, which the light ones near the boundary enter too. The boundary is that of the least cost, counted from the sizes of all sets.

The work of a list grows with the square of its length. Each set shows ``margin`` shingles more than it must, so a pair
shares at least ``keys_due`` keys; a set with fewer hot keys (those of more than ``most`` sets: passages found all
over a corpus) than that meets all its partners in other keys. Only sets with as many hot keys or more, whose text is mostly
common, go on, among themselves, to a second level of lists of all their shingles; those that are hot even there meet in the hot lists of their first ``p`` shingles.

Inside a list every member is paired with a first member only, by a hash of the node alone and by one of four others. Verified links give
components, and lists that still hold several components are compared across them, in blocks inside a task, which lets pairs pass
that parity bitmaps do not rule out: the bits in which two bitmaps differ are at most as many as the shingles in which the sets
differ. What passes is compared exactly. So the components are exact, and no group of near copies is spread into pairs; links inside a component are not counted.

Defined cases: null, empty and wordless texts have empty sets and link with nothing; a text of fewer words than a shingle has
one, all its words; equal sets link; repeated rows, and rows of one doc_id with unlike texts, are rows of their own; a null doc_id, or one that is no integer, takes a
negative number made from the row; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions.graph import components
from screenlake.functions.storage import removed, stored
from screenlake.llm.text import U, WordHashes, gram_hashes, mixed, row_key

LEAST_BITS, MOST_BITS = 32, 1 << 12  # bytes of a bitmap
BLOCK = 2048  # sets of a block


class Rule:
    """Sizes and overlaps at a threshold of ``num`` / ``den``, in whole numbers."""

    def __init__(self, num: int = 80, den: int = 100):
        self.num, self.den = num, den

    def smallest(self, n: int) -> int:
        """Size of the smallest set that reaches the threshold with one of ``n``."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.smallest(n) + 1

    def differ(self, total: np.ndarray) -> np.ndarray:
        """The most shingles in which two sets of that total size differ if they reach the threshold."""
        return (self.den - self.num) * total // (self.den + self.num)

    def linked(self, both: int, union: int) -> bool:
        return self.den * both >= self.num * union

    def smallest_of(self, n: Column) -> Column:
        return F.ceil(n * self.num / self.den).cast("long")


def margin(n: int) -> int:
    return 2 + n // 10


def shown(n: int, light: bool, rule: Rule) -> int:
    """Shingles of a set of ``n`` that take part in its keys."""
    return min(n, rule.prefix(n) + (2 if light else margin(n)))


def keys_due(n: Column, light: Column, rule: Rule) -> Column:
    """Keys that a set of ``n`` shares with each partner: three subsets of two, or one shingle and the margin of the smallest partner."""
    return F.when(light, 3).otherwise(3 + F.floor(rule.smallest_of(n) / 10))


def subsets(front: np.ndarray) -> np.ndarray:
    """A key for each subset of two."""
    a, b = np.triu_indices(len(front), 1)
    return mixed(front[a] * U(0x9E3779B97F4A7C15) + front[b])


def cheapest_boundary(sizes: list[tuple[int, int]], rule: Rule, scan: float = 3.0) -> int:
    """The size from which sets are heavy: the least cost of the light sets' subsets and the other sets' lists, an entry of which costs ``scan`` subsets. sizes: (size, sets)."""
    cost = lambda edge: sum(c * math.comb(shown(n, True, rule), 2) for n, c in sizes if n < edge) + scan * sum(c * shown(n, False, rule) for n, c in sizes if n >= rule.smallest(edge))
    return min(range(1, 65), key=cost)


def bitmap(grams: np.ndarray) -> bytes:
    """Parities of the shingles by hash, about one bit a shingle."""
    size = min(8 * MOST_BITS, max(8 * LEAST_BITS, 1 << (len(grams) - 1).bit_length()))
    at = np.bincount(((grams >> U(20)) & U(size // 8 - 1)).astype(np.int64) * 8 + ((grams >> U(40)) & U(7)).astype(np.int64), minlength=size) & 1
    return np.packbits(at.astype(np.uint8)).tobytes()


def folded(cells: list[bytes], size: int) -> np.ndarray:
    """Bitmaps as rows of ``size`` bytes in words of 64 bits; a longer one is the shorter one's halves apart, since bytes are hashes modulo a power of two."""
    wide = np.array([len(x) for x in cells])
    out = np.empty((len(cells), size), np.uint8)
    for w in np.unique(wide).tolist():
        at = np.flatnonzero(wide == w)
        bits = np.frombuffer(b"".join(cells[i] for i in at), np.uint8).reshape(len(at), w)
        while bits.shape[1] > size:
            half = bits.shape[1] // 2
            bits = bits[:, :half] ^ bits[:, half:]
        out[at] = bits
    return out.view(np.uint64)


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def shingles(text: bytes | None, hashes: WordHashes, size: int) -> np.ndarray:
    words = text.lower().split() if text else []
    return np.unique(gram_hashes(hashes.of(words), min(size, len(words)))) if words else np.zeros(0, U)


def _sketches(size: int, rule: Rule) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t.as_py(), hashes, size) for t in batch.column(2).cast(pa.binary())]
            cols = [
                pa.array([xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in sets], pa.binary()),
                pa.array([len(g) for g in sets], pa.int64()),
                pa.array([bitmap(g) if len(g) else None for g in sets], pa.binary()),
                pa.array([g[: shown(len(g), False, rule)].view(np.int64) if len(g) else None for g in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], ["rid", "tag", "digest", "n", "bits", "front"])

    return run


def _subset_keys(rule: Rule) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [subsets(np.array(f[: shown(n, True, rule)], np.int64).view(U)).view(np.int64) for n, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch.set_column(2, "front", pa.array(keys, pa.list_(pa.int64())))

    return run


def _all_shingles(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t.as_py(), hashes, size).view(np.int64) for t in batch.column(2).cast(pa.binary())]
            yield batch.set_column(2, "front", pa.array(sets, pa.list_(pa.int64())))

    return run


def _sifted(rule: Rule) -> Callable:
    """Pairs that sizes and bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            fit = rule.den * np.minimum(na, nb) >= rule.num * np.maximum(na, nb)
            a, b = (batch.column(k).to_pylist() for k in (4, 5))
            width = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(fit & (width == w))
                fit[at] = unlike(*(folded([s[i] for i in at], w) for s in (a, b))) <= rule.differ(na[at] + nb[at])
            yield batch.select([0, 1]).filter(pa.array(fit, pa.bool_()))

    return run


def _verified(rule: Rule, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, left = WordHashes(), None, np.zeros(0, U)
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                if a != last:
                    last, left = a, shingles(x.as_py(), hashes, size)
                right = shingles(y.as_py(), hashes, size)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(rule.linked(both, len(left) + len(right) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def candidates(rows: list[tuple], rule: Rule) -> list[tuple[int, int]]:
    """Pairs of different components that sizes and bitmaps do not rule out, where this is the first list in which they meet.

    rows: node, component, side, n, bits, the node's lists before this one as an array; of sides 1 and 2 only pairs between the two count.
    """
    rows = sorted(rows, key=lambda r: r[3])
    node, comp, side, n = (np.array([r[k] for r in rows]) for k in range(4))
    wide = np.array([len(r[4]) for r in rows])
    ends = np.searchsorted(rule.num * n, rule.den * n, "right")  # the sets from here on are too large
    found: list[tuple[int, int]] = []
    earlier: dict[int, set[int]] = {}

    def first_here(i: int, j: int) -> bool:
        a, b = (earlier.setdefault(k, set(rows[k][5].tolist())) if k not in earlier else earlier[k] for k in (i, j))
        return a.isdisjoint(b)

    for w in np.unique(wide).tolist():
        own = np.flatnonzero(wide == w)
        start, end = int(own[0]), int(ends[own[-1]])
        bits = folded([r[4] for r in rows[start:end]], w)
        for i in own.tolist():
            at = np.arange(i + 1, int(ends[i]))
            at = at[(comp[at] != comp[i]) & ((side[at] != side[i]) | (side[i] == 0))]
            if len(at):
                at = at[unlike(bits[at - start], bits[i - start]) <= rule.differ(n[at] + n[i])]
                found += [(int(min(node[i], node[j])), int(max(node[i], node[j]))) for j in at.tolist() if first_here(i, j)]
    return found


def _across(rule: Rule) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        told = lambda pairs: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in list(zip(*pairs, strict=True)) or [(), ()]], ["a", "b"])
        for batch in batches:
            out: set[tuple[int, int]] = set()
            # the lists before stay arrays: only those of pairs that bitmaps let pass are looked into
            before, ends = batch.column(6).values.to_numpy(), batch.column(6).offsets.to_numpy()
            for at, (g, *row) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
                if g != now:
                    out.update(candidates(held, rule))
                    now, held = g, []
                held.append([*row, before[ends[at] : ends[at + 1]]])
            yield told(out)
        yield told(candidates(held, rule))

    return run


class Join:
    """The distinct sets ("nodes") of a table of documents and the search for links between them."""

    def __init__(self, docs: DataFrame, rule: Rule, size: int, most: int, text_col: str, id_col: str):
        self.rule, self.size, self.most = rule, size, most
        self.docs = docs.select(*row_key(docs, id_col, text_col), F.col(text_col).cast("string").alias("text"))
        self.made = stored(self.docs.mapInArrow(_sketches(size, rule), "rid long, tag long, digest binary, n long, bits binary, front array<long>"), "sketches")
        first = self.made.where("n > 0").groupBy("digest").agg(F.min(F.struct("rid", "tag")).alias("of"), *(F.any_value(c).alias(c) for c in ("n", "bits", "front")))
        self.nodes = stored(first.select("digest", "n", "bits", "front", "of.rid", "of.tag", F.monotonically_increasing_id().alias("node")), "nodes")
        sizes = self.nodes.where("n < 128").groupBy("n").count().collect()  # the boundary lies below 64; larger sets cost the same for each
        self.edge = cheapest_boundary([tuple(r) for r in sizes], rule)

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of ``nodes`` (node), by merge joins, since they have no bound."""
        named = self.nodes.select("node", "rid", "tag").join(nodes.hint("merge"), "node")
        return self.docs.join(named.hint("merge"), ["rid", "tag"]).groupBy("node").agg(F.any_value("text").alias("text"))

    def spread(self) -> DataFrame:
        """(node, kind, key): the first level's keys; kind 1: subsets of light sets, 2: shingles."""
        light = self.nodes.where(F.col("n") < self.edge).select("node", "n", "front").mapInArrow(_subset_keys(self.rule), "node long, n long, front array<long>")
        heavy = self.nodes.where(F.col("n") >= self.rule.smallest(self.edge)).select("node", "n", "front")
        return light.select("node", F.lit(1).alias("kind"), F.explode("front").alias("key")).unionByName(heavy.select("node", F.lit(2).alias("kind"), F.explode("front").alias("key")))

    def cut(self, spread: DataFrame, due: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The lists of two members to ``most``, the hot ones' rows, the nodes that have ``due`` hot keys or more, and the table behind the first two."""
        counted = spread.select("*", F.count(F.lit(1)).over(Window.partitionBy("kind", "key")).alias("length"))
        shared = stored(counted.where("length > 1"), "shared")
        hot = shared.where(F.col("length") > self.most)
        often = hot.groupBy("node", "kind").agg(F.count(F.lit(1)).alias("c")).join(self.nodes.select("node", "n"), "node")
        return shared.where(F.col("length") <= self.most), hot, stored(often.where(F.col("c") >= due).select("node").distinct(), "rest"), shared

    def lists(self) -> DataFrame:
        """(node, kind, key, length): lists in which every linked pair meets."""
        lists, _, rest, first = self.cut(self.spread(), keys_due(F.col("n"), F.col("kind") == 1, self.rule))
        whole = self.texts(rest).join(self.nodes.select("node", "n"), "node").select("node", "n", "text").mapInArrow(_all_shingles(self.size), "node long, n long, front array<long>")
        spread = whole.select("node", F.lit(3).alias("kind"), F.posexplode("front").alias("place", "key"))
        more, hot, last, second = self.cut(spread, self.rule.smallest_of(F.col("n")))
        front = hot.join(last, "node", "left_semi").join(self.nodes.select("node", "n"), "node").where(F.col("place") <= F.col("n") - self.rule.smallest_of(F.col("n")))
        front = front.withColumn("kind", F.lit(4)).withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("kind", "key")))
        parts = (x.select("node", "kind", "key", "length") for x in (lists, more, front.where("length > 1")))
        found = stored(functools.reduce(DataFrame.unionByName, parts), "lists")
        removed(first, second, rest, last)
        return found

    def checked(self, pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (a, b)."""
        ends = pairs.selectExpr("explode(array(a, b)) node").distinct()
        texts = stored(self.texts(ends), "texts")
        both = pairs.join(texts.selectExpr("node AS a", "text AS ta"), "a").join(texts.selectExpr("node AS b", "text AS tb"), "b")
        return stored(both.select("a", "b", "ta", "tb").mapInArrow(_verified(self.rule, self.size), "a long, b long"), "links")

    def first_pairs(self, lists: DataFrame) -> DataFrame:
        order = [F.struct(F.xxhash64("node", seed).alias("o"), "node") for seed in (F.lit(4), F.pmod("key", F.lit(4)).cast("int"))]
        heads = lists.groupBy("kind", "key").agg(*(F.min(o).getField("node").alias(f"head{k}") for k, o in enumerate(order)))
        met = lists.join(heads, ["kind", "key"]).select("node", F.explode(F.array("head0", "head1")).alias("head")).where("node <> head")
        pairs = met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
        known = lambda end: self.nodes.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"s{end}"))
        both = pairs.join(known("a"), "a").join(known("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
        return stored(both.mapInArrow(_sifted(self.rule), "a long, b long"), "pairs")

    def further_pairs(self, lists: DataFrame, group: DataFrame) -> DataFrame:
        """Possible links between the components (id, component) that meet in a list of three members and more."""
        comp = group.withColumnsRenamed({"id": "node", "component": "comp"})
        tagged = stored(lists.where("length > 2").join(comp, "node", "left").select("node", "kind", "key", F.coalesce("comp", "node").alias("comp")), "tagged")
        several = tagged.groupBy("kind", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c")).where("low <> high")
        several = stored(several.select("kind", "key", F.ceil(F.col("c") / BLOCK).cast("int").alias("cuts"), F.monotonically_increasing_id().alias("id")), "several")
        # lists get small numbers: those of the partitions before, and the place in the own one
        part = F.shiftright("id", 33)
        sizes = several.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("c"))
        before = sizes.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
        kind = "int" if several.count() < 1 << 31 else "long"
        numbered = several.withColumn("part", part).join(F.broadcast(before), "part").withColumn("list", (F.col("before") + F.col("id") - F.shiftleft("part", 33)).cast(kind))
        live = stored(tagged.join(numbered.select("kind", "key", "cuts", "list"), ["kind", "key"]).select("node", "comp", "list", "cuts"), "live")
        # a list of several blocks: each pair of blocks is a group, and a set is in as many groups as there are blocks
        spread = live.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        spread = spread.select("node", "comp", "list", F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other")).alias("g"), side.alias("side"))
        # a node has no more lists than it shows keys
        known = live.groupBy("node").agg(F.sort_array(F.collect_list("list")).alias("lists")).join(self.nodes.select("node", "n", "bits"), "node")
        met = spread.join(known, "node").select("g", "node", "comp", "side", "n", "bits", F.slice("lists", 1, F.array_position("lists", F.col("list")).cast("int") - 1).alias("earlier"))
        parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = stored(met.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_across(self.rule), "a long, b long").distinct(), "candidates")
        removed(tagged, several, live)
        return found

    def components(self) -> DataFrame:
        """(id, component) of the nodes with links."""
        lists = self.lists()
        links = self.checked(self.first_pairs(lists))
        more = self.checked(self.further_pairs(lists, components(links)))
        return stored(components(links.unionByName(more)), "group")


def linked_sets(docs: DataFrame, num: int = 80, den: int = 100, size: int = 5, most: int = 64, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(rid, n_shingles, component_id) per row of ``docs``: the size of its set and the least rid reachable by links, its own included."""
    join = Join(docs, Rule(num, den), size, most, text_col, id_col)
    group = join.components().withColumnRenamed("id", "node")
    member = join.nodes.select("digest", "node").join(group, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    rows = join.made.select("rid", "n", "digest").join(member, "digest", "left")
    least = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("rid").alias("component_id"))
    return rows.join(least, "component", "left").select("rid", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rid").alias("component_id"))

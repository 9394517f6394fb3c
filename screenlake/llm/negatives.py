"""Operator 11: hard negatives found through a multiway hyperplane tree with distance ranges (GNAT).

Scores are integer inner products. A row gets one more coordinate, sqrt(M^2 - |x|^2) with M the greatest norm, and an
anchor a zero; then the squared distance of anchor and row is |a|^2 + M^2 - 2 score, so a window of scores is an annulus
around the anchor and the triangle inequality holds. Each node of the tree has up to ``ways`` split points; a row goes to
the subtree of the nearest; every split point keeps the least and the greatest distance to the rows of every sibling subtree.
A search passes over a subtree if for some split point that range misses the annulus; leaves are scanned exactly.

Split points come from a sample of at most ``most_sample`` rows (those of the least hashes), every row is indexed, and the
ranges cover all rows, so nothing is lost: recall is 1. Leaves are cut into chunks of about ``chunk`` rows; a task holds one
chunk and streams the anchors that reach it past it in blocks. The first scan, of the anchor's own chunk, gives bounds that
narrow the windows for the search of the tree.

Defined cases: rows without an id, a label or a vector, or with a null or non-finite component, take no part; fully equal
rows count once; rows that share an id but differ are rows of their own, ties by id and then by a hash of the row; shorter
vectors count as padded by zeros; scores beyond 64 bits are held at the bounds; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions.storage import stored

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
FOUND = "anchor_id long, anchor_tag long, w int, score long, id long, tag long"


class Tree:
    """Split points by node; children are nodes (>= 0) or leaves (~leaf)."""

    def __init__(self, sample: np.ndarray, most: float, ways: int, leaf_rows: float):
        """``sample``: rows as float vectors; ``most``: the greatest squared norm; leaves stand for at most ``leaf_rows`` rows of the sample."""
        self.most, self.leaves = most, 0
        self.points: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}
        self.top = self._grow(self.lifted(sample), ways, max(leaf_rows, 1.0))

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([rows, np.sqrt(np.maximum(self.most - (rows * rows).sum(axis=1), 0.0))[:, None]])

    def _grow(self, rows: np.ndarray, ways: int, leaf_rows: float) -> int:
        picked = [0] if len(rows) else []
        far = distances(rows, rows[:1])[:, 0] if len(rows) else np.zeros(0)
        while len(rows) > leaf_rows and len(picked) < ways and far.max() > 0:  # each next split point is the farthest from those before
            picked.append(int(far.argmax()))
            far = np.minimum(far, distances(rows, rows[picked[-1] :][:1])[:, 0])
        if len(picked) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        node = len(self.points)
        self.points.append(rows[picked])
        self.child.append([])
        near = distances(rows, rows[picked]).argmin(axis=1)
        self.child[node] = [self._grow(rows[near == j], ways, leaf_rows) for j in range(len(picked))]
        return node

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, float, float]]]:
        """The leaf of each lifted row, and (node, i, j, least, greatest) distances of split point i to the rows of subtree j."""
        leaf, seen, open_ = np.zeros(len(rows), np.int64), [], [(self.top, np.arange(len(rows)))]
        while open_:
            node, at = open_.pop()
            if node < 0:
                leaf[at] = ~node
                continue
            far = distances(rows[at], self.points[node])
            near = far.argmin(axis=1)
            for j, child in enumerate(self.child[node]):
                own = near == j
                if own.any():
                    seen += [(node, i, j, float(far[own, i].min()), float(far[own, i].max())) for i in range(far.shape[1])]
                    open_.append((child, at[own]))
        return leaf, seen

    def set_ranges(self, found: list[tuple[int, int, int, float, float]]) -> None:
        for node, points in enumerate(self.points):
            self.low[node], self.high[node] = np.full((len(points),) * 2, np.inf), np.full((len(points),) * 2, -np.inf)
        for node, i, j, low, high in found:
            self.low[node][i, j], self.high[node][i, j] = low, high

    def reached(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, leaf) numbers: leaves that may hold a row whose score is in one of the anchor's windows [low, high] (arrays anchors x windows; none where low > high)."""
        own = (anchors * anchors).sum(axis=1) + self.most
        slack = 1e-6 * np.sqrt(own) + 1e-6
        inner = np.sqrt(np.maximum(own[:, None] - 2.0 * high, 0.0)) - slack[:, None]
        outer = np.sqrt(np.maximum(own[:, None] - 2.0 * low, 0.0)) + slack[:, None]
        lifted = np.hstack([anchors, np.zeros((len(anchors), 1))])
        who, leaf, open_ = [], [], [(self.top, np.arange(len(anchors)), low <= high)]
        while open_:
            node, at, live = open_.pop()
            some = live.any(axis=1)
            at, live = at[some], live[some]
            if not len(at):
                continue
            if node < 0:
                who.append(at)
                leaf.append(np.full(len(at), ~node))
                continue
            far = distances(lifted[at], self.points[node])[:, None, :]
            least = np.maximum(far - outer[at][:, :, None], inner[at][:, :, None] - far)  # of the distances split point to row
            greatest = far + outer[at][:, :, None]
            for j, child in enumerate(self.child[node]):
                open_.append((child, at, live & ((least <= self.high[node][:, j]) & (greatest >= self.low[node][:, j])).all(axis=2)))
        return np.concatenate([np.zeros(0, np.int64), *who]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *leaf]).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _vectors(column: pa.Array) -> np.ndarray:
    """Binary cells of 64-bit integers as rows."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.int64).reshape(len(cells), -1) if cells else np.zeros((0, 0), np.int64)


def _packed(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch.column(3).to_pylist():
                row = np.zeros(width, np.int64)
                row[: len(cell)] = cell
                out.append(row.tobytes())
            yield batch.set_column(3, "q", pa.array(out, pa.binary()))

    return run


def _placed(tree: Tree) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, _ = tree.place(tree.lifted(_vectors(batch.column(3)).astype(float)))
            yield batch.append_column("leaf", pa.array(leaf, pa.int64()))

    return run


def _ranges(tree: Tree) -> Callable:
    names = ["node", "i", "j", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, seen = tree.place(tree.lifted(_vectors(batch.column(0)).astype(float)))
            cols = list(zip(*seen, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 3 else pa.float64()) for k, c in enumerate(cols)], names)

    return run


class Index:
    """All rows by leaf and chunk: ``rows`` has id, tag, label, q, leaf, g; ``chunks`` has leaf and cuts."""

    def __init__(self, rows: DataFrame, chunks: DataFrame, tree: Tree):
        self.rows, self.chunks, self.tree = rows, chunks, tree


def quantised(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, tag, label, v) of the rows that take part, fully equal ones once; v has floor(scale x) of each component."""
    whole = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    cut = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), whole.alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    cut = cut.where(F.forall("v", lambda x: x.isNotNull() & F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    return cut.select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).distinct().select("id", F.xxhash64("label", "v").alias("tag"), "label", "v")


def build(rows: DataFrame, most_sample: int = 4096, ways: int = 8, leaf_rows: int = 1024, most_leaves: int = 512, chunk: int = 4096) -> Index | None:
    """The index of ``quantised`` rows; None if there are none."""
    cells = stored(rows, "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, width, most = cells.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return None
    packed = cells.mapInArrow(_packed(width), "id long, tag long, label string, q binary")
    sample = np.stack([np.frombuffer(r.q, np.int64) for r in packed.orderBy(F.xxhash64("id", "tag"), "id", "tag").limit(most_sample).select("q").collect()]).astype(float)
    tree = Tree(sample, most, ways, max(leaf_rows / n, 1 / most_leaves) * len(sample))
    placed = stored(packed.mapInArrow(_placed(tree), "id long, tag long, label string, q binary, leaf long"), "placed")
    ranges = placed.select("q").mapInArrow(_ranges(tree), "node long, i long, j long, low double, high double").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    tree.set_ranges([tuple(r) for r in ranges.collect()])  # at most nodes x ways^2 rows
    chunks = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("cuts"))
    # one row for each leaf, at most some thousands whatever the input
    dealt = placed.join(F.broadcast(chunks), "leaf").withColumn("g", _group(F.col("leaf"), F.pmod(F.xxhash64("tag", "id"), F.col("cuts"))))
    return Index(stored(dealt.select("id", "tag", "label", "q", "leaf", "g"), "indexed"), stored(chunks, "chunks"), tree)


def _group(leaf: Column, part: Column) -> Column:
    return leaf * (1 << 32) + part


def _reached(tree: Tree) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names = part.schema.names
                low, high = (part.column(names.index(c)).to_pylist() for c in ("lows", "highs"))
                wide = max(map(len, low), default=0)
                pad = lambda rows, v, w=wide: np.array([r + [v] * (w - len(r)) for r in rows], float).reshape(len(rows), w)
                who, leaf = tree.reached(_vectors(part.column(names.index("q"))).astype(float), pad(low, HIGHEST), pad(high, LOWEST))
                yield part.take(pa.array(who)).append_column("leaf", pa.array(leaf, pa.int64()))

    return run


def _scores(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:  # every partial sum is a whole number below 2^53
        return (a.astype(float) @ x.T.astype(float)).astype(np.int64)
    far = a.astype(object) @ x.T.astype(object)
    return np.array([[min(max(v, LOWEST + 1), HIGHEST) for v in row] for row in far], np.int64).reshape(len(a), len(x))


def _scan(same: bool, k: int, exact: bool) -> Callable:
    """Rows by g, the chunk's rows before its anchors: the first ``k`` rows of each window of each anchor."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split(" ")[0] for c in FOUND.split(", ")]

    def search(held: list[tuple], asked: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        if held and asked:
            held.sort(key=lambda r: (r[0], r[1]))
            ids, tags, labels = (np.array([r[c] for r in held]) for c in (0, 1, 2))
            score = _scores(*(np.frombuffer(b"".join(r[3] for r in rows), np.int64).reshape(len(rows), -1) for rows in (asked, held)), exact)
            for row, (aid, atag, label, _, lows, highs) in zip(score, asked, strict=True):
                fit = np.flatnonzero(((labels == label) == same) & ~((ids == aid) & (tags == atag)))
                turn = fit[np.argsort(-row[fit], kind="stable")]
                down = -row[turn]
                for w, (low, high) in enumerate(zip(lows, highs, strict=True)):
                    a, b = np.searchsorted(down, -high if high > LOWEST else HIGHEST, "left"), np.searchsorted(down, -low if low > LOWEST else HIGHEST, "right")
                    out += [(aid, atag, w, int(row[i]), int(ids[i]), int(tags[i])) for i in turn[a : min(b, a + k)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, asked = None, [], []
        for batch in batches:
            for g, kind, *row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                if g != now:
                    yield search(held, asked)
                    now, held, asked = g, [], []
                (asked if kind else held).append(row)
                if len(asked) == 512:
                    yield search(held, asked)
                    asked = []
        yield search(held, asked)

    return run


def search(index: Index, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """The first ``k`` rows of each window of each anchor, by score and then id, among rows of the anchor's label (``same``) or of others.

    ``anchors``: id, tag, label, q, lows, highs, and g where only that chunk is to be scanned.
    """
    cols = ["id", "tag", "label", "q", "lows", "highs"]
    if "g" not in anchors.columns:
        kinds = "id long, tag long, label string, q binary, lows array<long>, highs array<long>, leaf long"
        led = anchors.select(*cols).mapInArrow(_reached(index.tree), kinds).join(F.broadcast(index.chunks), "leaf")
        anchors = led.select(*cols, F.explode(F.sequence(_group(F.col("leaf"), F.lit(0)), _group(F.col("leaf"), F.col("cuts") - 1))).alias("g"))
    none = F.lit(None).cast("array<long>")
    both = index.rows.select("g", F.lit(0).alias("kind"), "id", "tag", "label", "q", none.alias("lows"), none.alias("highs")).unionByName(anchors.select("g", F.lit(1).alias("kind"), *cols))
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(parts, "g").sortWithinPartitions("g", "kind").mapInArrow(_scan(same, k, index.tree.most < 2**53), FOUND)
    best = Window.partitionBy("anchor_id", "anchor_tag", "w").orderBy(F.desc("score"), "id", "tag")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _narrowed(anchors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``anchors`` whose windows start at the k-th row found so far, where there are so many."""
    kth = found.where(F.col("rank") == k).groupBy("anchor_id", "anchor_tag").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    both = anchors.join(kth.withColumnsRenamed({"anchor_id": "id", "anchor_tag": "tag"}), ["id", "tag"], "left")
    return both.select("id", "tag", "label", "q", F.transform("lows", lambda low, w: F.greatest(low, F.try_element_at("kth", w))).alias("lows"), "highs")


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, **params) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, rows whose id is divisible by ``every``.

    An anchor's positives are its first rows of the same label; each has the first rows of other labels with low * positive <= 100 * negative <= high * positive.
    ``rows`` comes from ``quantised``; ``params`` go to ``build``.
    """
    spark = rows.sparkSession
    index = build(rows, **params)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    every_score = [F.array(F.lit(v).cast("long")) for v in (LOWEST, HIGHEST)]
    anchors = index.rows.where(F.col("id") % every == 0).select("id", "tag", "label", "q", "g", every_score[0].alias("lows"), every_score[1].alias("highs"))
    near = _narrowed(anchors, search(index, anchors, positives, True), positives)
    liked = stored(search(index, near, positives, True), "positives")
    big = F.col("score").cast("decimal(20,0)")
    bounds = liked.select("*", F.ceil(big * low / 100).cast("long").alias("low"), F.floor(big * high / 100).cast("long").alias("high"))
    windows = bounds.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_tag").alias("tag")).agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("own"))  # at most ``positives`` of them
    asked = stored(anchors.drop("lows", "highs").join(windows, ["id", "tag"]).select("id", "tag", "label", "q", "g", F.col("own.low").alias("lows"), F.col("own.high").alias("highs")), "asked")
    far = search(index, _narrowed(asked, search(index, asked, negatives, False), negatives), negatives, False)
    named = liked.select("anchor_id", "anchor_tag", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named, ["anchor_id", "anchor_tag", "w"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

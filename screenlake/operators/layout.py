"""Ordered-sequence operators on words, lines, segments and rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions import strings as fs
from screenlake.functions.folds import fold_sorted, scan_sorted


def islands(df: DataFrame, keys: list[str], order: list[str], cut: Column, name: str = "part") -> DataFrame:
    """``df`` with a number that grows at each row where ``cut`` holds."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_cut", F.when(cut, 1).otherwise(0)).withColumn(name, F.sum("_cut").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def ordered_text(order: str = "k", text: str = "text", sep: str = " ") -> Column:
    """Aggregate: texts joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda w: w[text]), sep)


def shots(frames: DataFrame, key: str, order: str, cut: float = 12.0, still: float = 1.5) -> DataFrame:
    """(key, shot, n, move, still): the shot that holds a burst's middle frame; a mean absolute step of ``cut`` ends one."""
    line = Window.partitionBy(key).orderBy(order)
    step = F.aggregate(F.zip_with("thumb", F.lag("thumb").over(line), lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda n, x: n + x) / F.size("thumb")
    moved = frames.withColumn("move", step).withColumns({"turn": F.row_number().over(line), "all": F.count(F.lit(1)).over(Window.partitionBy(key))})
    parts = islands(moved, [key], [order], F.coalesce(F.col("move") >= cut, F.lit(False)), "shot")
    mid = parts.where(F.col("turn") == F.floor(F.col("all") / 2) + 1).select(key, "shot")
    inner = F.when(F.col("move") < cut, F.col("move"))
    return parts.join(mid, [key, "shot"]).groupBy(key, "shot").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.max(inner), F.lit(0.0)), 9).alias("move")).withColumn("still", F.col("move") < still)


def dense_moments(frames: DataFrame, key: str, order: str, pixels: float = 2.0, share: float = 0.10) -> DataFrame:
    """(key, at): a stretch's start, and each frame whose step moves a share of the pixels; stretches of under 3 give only the start."""
    line = Window.partitionBy(key).orderBy(order)
    moved = F.size(F.filter(F.zip_with("thumb", F.lag("thumb").over(line), lambda a, b: F.abs(a - b)), lambda d: d > pixels))
    f = frames.withColumns({"m": moved / F.size("thumb"), "turn": F.row_number().over(line), "all": F.count(F.lit(1)).over(Window.partitionBy(key))})
    return f.where((F.col("turn") == 1) | ((F.col("all") >= 3) & (F.col("m") >= share))).select(key, F.col(order).alias("at"))


def rows_by_gap(words: DataFrame, page: str, gap: float = 0.5) -> DataFrame:
    """``words`` with ``row``: a new row where the centre moves by more than a share of the word's own height."""
    line = Window.partitionBy(page).orderBy("y0", "x0", "line", "k")
    cy = (F.col("y0") + F.col("y1")) / 2
    w = words.withColumn("cy", cy)
    return islands(w, [page], ["y0", "x0", "line", "k"], F.coalesce(F.col("cy") - F.lag("cy").over(line) > gap * (F.col("y1") - F.col("y0")), F.lit(True)), "row")


def rows_by_rule(words: DataFrame, page: str, rule: str, height: float | None = None) -> DataFrame:
    """(page, line, k, row): words put to rows by a rule that depends on the row so far; with a column ``n``, a row of ``words`` stands for so many alike that follow one another, and keeps it.

    fixed: below the first word's centre by more than half the word's height begins a row; mean: below the running mean by more than 0.55 ``height``;
    near: from the running middle (half old, half new) by more than 0.6 ``height``; extent: the first row whose extent holds the word's middle takes it and grows.
    """
    if rule not in ("fixed", "mean", "near", "extent"):
        raise ValueError(f"no such rule: {rule}")

    many = "n" in words.columns

    def extent(now: dict, y0: float, y1: float) -> int:
        rows, live, mid = now.setdefault("rows", []), now.setdefault("live", []), (y0 + y1) / 2
        if mid >= y0:  # words come by their tops, so a row that ends above this one's is out of reach from here on
            live[:] = [i for i in live if rows[i][1] >= y0]
        at = next((i for i in (live if mid >= y0 else range(len(rows))) if rows[i][0] <= mid <= rows[i][1]), None)
        if at is None:
            rows.append([y0, y1])
            live.append(len(rows) - 1)
            return len(rows)
        rows[at] = [min(rows[at][0], y0), max(rows[at][1], y1)]
        return at + 1

    def step(now: dict, r: tuple) -> list[tuple]:
        key, line, k, y0, y1, n = r
        if rule == "extent":
            return [(key, line, k, extent(now, y0, y1), n)]
        c = (y0 + y1) / 2
        over = {"fixed": lambda: c - now["cy"] > 0.5 * max(1, y1 - y0), "mean": lambda: c - now["cy"] > 0.55 * height, "near": lambda: abs(c - now["cy"]) > 0.6 * height}[rule]
        if not now or over():
            now |= {"row": now.get("row", 0) + 1, "cy": c, "n": 1}
            n_left = n - 1
        else:
            n_left = n
        if rule == "mean":
            for now["n"] in range(now["n"] + 1, now["n"] + n_left + 1):
                now["cy"] = (now["cy"] * (now["n"] - 1) + c) / now["n"]
        elif rule == "near":
            for _ in range(n_left):
                before, now["cy"] = now["cy"], (now["cy"] + c) / 2
                if before == now["cy"]:
                    break
        return [(key, line, k, now["row"], n)]

    at = words.withColumn("at", F.col("y0") if rule == "extent" else (F.col("y0") + F.col("y1")) / 2)
    n = (F.col("n") if many else F.lit(1)).cast("long").alias("n")
    out = scan_sorted(at.select(page, "line", "k", "y0", "y1", n, "at", "x0"), page, ["at", "x0", "line", "k"], f"{page} long, line long, k long, row long, n long", lambda now, r: step(now, r[:6]), lambda now: [])
    return out if many else out.drop("n")


def anchored_clusters(points: DataFrame, key: str, x: str, line: str, tol: float) -> DataFrame:
    """(key, cluster, x, lines, far): points at most ``tol`` right of the first of their cluster, whose x it is; how many lines they have, and the greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, n, held = None, 0.0, 0, []

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["key", "cluster", "x", "lines", "far"])

        for batch in batches:
            out: list[tuple] = []
            for k, at, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == now and n and at - first <= tol:
                    held.append(of)
                    continue
                if n:
                    out.append((now, n, first, len(set(held)), max(held)))
                now, first, n, held = k, at, n + 1 if k == now else 1, [of]
            yield rows(out)
        if n:
            yield rows([(now, n, first, len(set(held)), max(held))])

    by = points.select(F.col(key).cast("long").alias("key"), F.col(x).cast("double").alias("at"), F.col(line).cast("long").alias("of"))
    return by.repartition("key").sortWithinPartitions("key", "at").mapInArrow(run, "key long, cluster long, x double, lines long, far long").withColumnRenamed("key", key)


def text_margin(words: DataFrame, page: str, tol: float) -> DataFrame:
    """(page, x): the leftmost start that most lines share."""
    n = anchored_clusters(words, page, "x0", "line", tol)
    return n.groupBy(page).agg(F.max(F.struct("lines", (-F.col("cluster")).alias("c"), "x")).getField("x").alias("x"))


def left_edge(rows: DataFrame, page: str, tie: str, tol: int = 10) -> DataFrame:
    """(page, x): the median of the first cluster of two rows and more, else of the last cluster."""
    c = clusters_1d(rows, [page], "x0", [tie], gap=tol, least=1)
    first = F.min(F.when(F.col("n") >= 2, F.struct("cluster", "x")))
    return c.groupBy(page).agg(F.floor(F.coalesce(first, F.max(F.struct("cluster", "x"))).getField("x")).alias("x"))


def guide_columns(marks: DataFrame, page: str, tol: int = 10, least: int = 2) -> DataFrame:
    """(page, x): columns of marks of two rows and more that not every row has; one beside every row is a border."""
    c = clusters_1d(marks, [page], "x0", ["line"], gap=tol, least=least).select(page, F.floor("x").alias("x"))
    n = marks.groupBy(page).agg(F.count_distinct("line").alias("all"))
    drawn = c.join(marks.select(page, "line", "x0"), page).where(F.abs(F.col("x0") - F.col("x")) <= tol).groupBy(page, "x").agg(F.count_distinct("line").alias("drawn"))
    return drawn.join(n, page).where(F.col("drawn") < F.col("all")).select(page, "x")


def column_bands(ranges: DataFrame, page: str, tol: float) -> DataFrame:
    """(page, cluster, x0, x1): ranges whose starts are within ``tol`` of the first are one column."""
    a = anchored_clusters(ranges, page, "x0", "x1", tol)  # the end rides as the line
    return a.select(page, "cluster", F.col("x").cast("long").alias("x0"), F.col("far").alias("x1"))


def clusters_1d(points: DataFrame, keys: list[str], x: str, ties: list[str], gap: int = 10, least: int = 2) -> DataFrame:
    """(keys, cluster, x, n): points at most ``gap`` apart, their median and number."""
    line = Window.partitionBy(*keys).orderBy(x, *ties)
    c = islands(points, keys, [x, *ties], F.coalesce(F.col(x) - F.lag(x).over(line) > gap, F.lit(True)), "cluster")
    return c.groupBy(*keys, "cluster").agg(F.median(x).alias("x"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def split_wide(words: DataFrame, keys: list[str], times: float = 4.0) -> DataFrame:
    """(keys, piece, text, x0, x1): lines cut where a gap passes ``times`` mean characters."""
    line = Window.partitionBy(*keys).orderBy("k")
    char = F.sum(F.col("x1") - F.col("x0")).over(Window.partitionBy(*keys)) / F.sum(F.length("text")).over(Window.partitionBy(*keys))
    w = words.withColumns({"gap": F.col("x0") - F.lag("x1").over(line), "char": char})
    return islands(w, keys, ["k"], F.coalesce(F.col("gap") > times * F.col("char"), F.lit(False)), "piece").groupBy(*keys, "piece").agg(ordered_text().alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def split_widest(words: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, label, value): a line cut at its widest gap, the last of equals, if it is at least ``least``."""
    w = words.withColumn("gap", F.col("x0") - F.lag("x1").over(Window.partitionBy(*keys).orderBy("k")))
    at = w.groupBy(*keys).agg(F.max(F.struct("gap", "k")).alias("m")).where(F.col("m.gap") >= least).select(*keys, F.col("m.k").alias("cut"))
    j = w.join(at, keys).withColumns({"left": F.when(F.col("k") < F.col("cut"), F.struct("k", "text")), "right": F.when(F.col("k") >= F.col("cut"), F.struct("k", "text"))})
    told = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), " ")
    return j.groupBy(*keys).agg(told("left").alias("label"), told("right").alias("value"))


def split_panel(words: DataFrame, panel: str, line: str, times: float = 1.2) -> DataFrame:
    """(panel, line, label, value): a panel cut at each line's widest gap, where every line of it has one of ``times`` its height."""
    one = Window.partitionBy(panel, line)
    w = words.select(panel, line, "k", "text", "x0", "x1", (F.col("y1") - F.col("y0")).alias("tall")).repartition(panel)  # one shuffle and one order serve all that follows
    w = w.withColumn("gap", F.col("x0") - F.lag("x1").over(one.orderBy("k"))).drop("x0", "x1")
    w = w.withColumns({"cut": F.max(F.struct("gap", "k")).over(one), "wide": F.coalesce(F.max("gap").over(one) >= times * F.max("tall").over(one), F.lit(False))})
    w = w.withColumn("every", F.bool_and("wide").over(Window.partitionBy(panel))).where("every AND cut.gap >= 0")
    told = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("k", "text")))), lambda x: x["text"]), " ")
    return w.groupBy(panel, line).agg(told(F.col("k") < F.col("cut.k")).alias("label"), told(F.col("k") >= F.col("cut.k")).alias("value"))


def property_block(fields: DataFrame, page: str, first: int = 12, least: int = 2, wide: int = 10) -> DataFrame:
    """(page, fields, last, block): label and value lines among a page's first rows, keys beginning with a letter and aligned."""
    f = fields.where((F.col("line") < first) & F.col("label").rlike("^[A-Za-z]"))
    return f.groupBy(page).agg(F.count(F.lit(1)).alias("fields"), F.max("line").alias("last"), ((F.count(F.lit(1)) >= least) & (F.max("x") - F.min("x") <= wide)).alias("block"))


def chat_entries(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, entry, who, said): a row with an avatar, or the first, opens an entry; the others append."""
    line = Window.partitionBy(*keys).orderBy(order)
    e = islands(rows, keys, [order], F.col("opens") | (F.row_number().over(line) == 1), "entry")
    return e.groupBy(*keys, "entry").agg(F.min_by("who", order).alias("who"), ordered_text(order, "said", " ").alias("said"))


def chat_verdict(entries: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, chat): at least two named entries, and more than half named."""
    named = F.count_if(F.coalesce(F.col("who") != "", F.lit(False)))
    return entries.groupBy(*keys).agg(((named >= least) & (named * 2 > F.count(F.lit(1)))).alias("chat"))


def joined_wraps(rows: DataFrame, page: str, edge: str, height: int) -> DataFrame:
    """(page, para, text): a row joins the one above when its first word would not have fitted there and it is near."""
    line = Window.partitionBy(page).orderBy("line")
    room = F.col(edge) - F.lag("x1").over(line)
    near = F.col("y0") - F.lag("y1").over(line) < 3 * height
    return islands(rows, [page], ["line"], ~F.coalesce((room < F.col("first")) & near, F.lit(False)), "para").groupBy(page, "para").agg(ordered_text("line", "text").alias("text"))


def clip_to_column(words: DataFrame, page: str, line: str, share: float = 0.75, gap: int = 12) -> DataFrame:
    """Words that start left of the page's 75th percentile of right edges (sorted[int(n * .75)]), or go on without a wide gap."""
    ends = words.groupBy(page, line).agg(F.max("x1").alias("e")).groupBy(page).agg(F.array_sort(F.collect_list("e")).alias("a")).select(page, F.get("a", F.floor(F.size("a") * share).cast("int")).alias("edge"))
    g = F.col("x0") - F.lag("x1").over(Window.partitionBy(page, line).orderBy("k"))
    return words.withColumn("g", g).join(ends, page).where((F.col("x0") <= F.col("edge")) | (F.col("g") < gap)).drop("g", "edge")


def text_column(words: DataFrame, page: str, width: int = 10, near: int = 3) -> DataFrame:
    """(page, bin, margin): the commonest bin of line starts (the least of equals), and the leftmost start within three bins."""
    starts = words.groupBy(page, "line").agg(F.min("x0").alias("x")).withColumn("b", F.floor(F.col("x") / width))
    top = starts.groupBy(page, "b").agg(F.count(F.lit(1)).alias("n")).groupBy(page).agg(F.max(F.struct("n", -F.col("b"))).alias("m")).select(page, (-F.col("m.col2")).alias("bin"))
    return starts.join(top, page).where(F.abs(F.col("b") - F.col("bin")) <= near).groupBy(page, "bin").agg(F.min("x").alias("margin"))


def open_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``kind``: a folder is open when the next row is deeper, closed when its chevron says so, else a file."""
    after = F.lead("depth").over(Window.partitionBy(*keys).orderBy("pos"))
    return rows.withColumn("kind", F.when(after > F.col("depth"), "expanded").when(F.col("collapsed"), "collapsed").otherwise("file"))


def depth_faults(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, faults): rows more than one deeper than the one before, and a first row that is not at depth 0."""
    before = F.lag("depth").over(Window.partitionBy(*keys).orderBy("pos"))
    return rows.withColumn("bad", F.when(before.isNull(), F.col("depth") != 0).otherwise(F.col("depth") > before + 1)).groupBy(*keys).agg(F.count_if("bad").alias("faults"))


def best_plateau(answers: DataFrame, key: str) -> DataFrame:
    """(key, margin): the middle of the widest run of equal answers over a sweep (most columns, most depth, longest)."""
    line = Window.partitionBy(key).orderBy("margin")
    runs = islands(answers, [key], ["margin"], F.coalesce(F.col("answer") != F.lag("answer").over(line), F.lit(True)), "run")
    g = runs.groupBy(key, "run").agg(F.first("columns").alias("c"), F.first("total").alias("t"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("margin")).alias("m"))
    best = g.groupBy(key).agg(F.max(F.struct("c", "t", "n", -F.col("run"), "m")).getField("m").alias("m"))
    return best.select(key, F.get("m", F.floor(F.size("m") / 2).cast("int")).alias("margin"))


def parent_paths(rows: DataFrame, keys: list[str], levels: int = 8) -> DataFrame:
    """``rows`` with ``path``: the names of the last earlier rows of each lesser depth, and its own."""
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = [F.when(F.col("depth") >= k, F.last(F.when(F.col("depth") == k, F.col("name")), ignorenulls=True).over(upto)) for k in range(levels)]
    return rows.withColumn("path", F.array_join(F.array(*parts), "/"))


def blank_corridors(words: DataFrame, page: str, bin_: int = 10, least_rows: int = 3, least: int = 3) -> DataFrame:
    """(page, start, end): runs of x-bins that are blank in every line that reaches past them, at least ``least`` wide."""
    ends = words.groupBy(page, "line").agg(F.max("x1").alias("e"))
    rows = ends.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("short")).where(F.col("n") >= least_rows)
    rows = rows.select(page, F.floor(F.col("short") / bin_).alias("last"))
    # from first bin to last; only those that begin within the shortest line count, so the others are told before they are sorted
    taken = words.select(page, F.floor(F.col("x0") / bin_).alias("a"), F.floor((F.col("x1") - 1) / bin_).alias("b"))
    within = taken.join(rows.hint("shuffle_hash"), page).where(F.col("a") <= F.col("last")).withColumn("b", F.col("b") + 1)
    line = Window.partitionBy(page).orderBy("a", "b")
    far = F.coalesce(F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    before = within.select(page, "last", far.alias("start"), F.col("a").alias("end"), F.greatest("b", far).alias("far"))
    left = before.groupBy(page, "last").agg(F.max("far").alias("start")).select(page, "start", (F.col("last") + 1).alias("end"))
    return before.select(page, "start", "end").unionByName(left).where(F.col("end") - F.col("start") >= least)


def cells_in_bands(words: DataFrame, bands: list[tuple[int, int]], keys: list[str], strays: bool = False) -> DataFrame:
    """(keys, band, text): a line's words by the band that holds their middle; strays get band -1, or with ``strays`` the one band beside them that is empty on their line."""
    x = (F.col("x0") + F.col("x1")) / 2
    band = F.lit(-1)
    for i, (a, b) in reversed(list(enumerate(bands))):
        band = F.when((x >= a) & (x < b), i).otherwise(band)
    placed = words.withColumn("band", band)
    if strays:
        filled = F.collect_set("band").over(Window.partitionBy(*keys))
        before = sum((F.when(x >= b, 1).otherwise(0) for _, b in bands), F.lit(0)) - 1  # the last band that ends left of the word
        free = F.filter(F.array(before, before + 1), lambda k: (k >= 0) & (k < len(bands)) & ~F.array_contains(F.col("filled"), k))
        placed = placed.withColumn("filled", filled).withColumn("free", free).withColumn("band", F.when((F.col("band") == -1) & (F.size("free") == 1), F.get("free", 0)).otherwise(F.col("band")))
    return placed.groupBy(*keys, "band").agg(ordered_text().alias("text"))


def kept_columns(cells: DataFrame, page: str, line: str, space: float, blank: int = 1, spaces: float = 1.5) -> DataFrame:
    """(page, band, kept): a column stays if it is blank on at most ``blank`` lines and its left or right ends deviate by ``spaces`` spaces at most (median absolute deviation)."""
    rows = cells.groupBy(page).agg(F.count_distinct(line).alias("rows"))
    mid = cells.groupBy(page, "band").agg(F.median("x0").alias("l"), F.median("x1").alias("r"), F.count_distinct(line).alias("n"))
    off = cells.join(mid, [page, "band"]).groupBy(page, "band", "n").agg(F.median(F.abs(F.col("x0") - F.col("l"))).alias("dl"), F.median(F.abs(F.col("x1") - F.col("r"))).alias("dr"))
    return off.join(rows, page).select(page, "band", ((F.col("rows") - F.col("n") <= blank) & (F.least("dl", "dr") <= spaces * space)).alias("kept"))


def full_row_island(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """(key, r): rows that fill all cells but one and are contiguous with the seed row."""
    line = Window.partitionBy(key).orderBy("r")
    parts = islands(rows, [key], ["r"], F.coalesce(F.col("ok") != F.lag("ok").over(line), F.lit(True)), "part")
    at = parts.where(F.col(seed) & F.col("ok")).select(key, "part").distinct()
    return parts.join(at, [key, "part"], "left_semi").select(key, "r")


def covered_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): overlapping or touching spans merged."""
    line = Window.partitionBy(*keys).orderBy("a", "b")
    far = F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1))
    return islands(spans.withColumn("_far", far), keys, ["a", "b"], F.coalesce(F.col("a") > F.col("_far"), F.lit(True)), "part").groupBy(*keys, "part").agg(F.min("a").alias("start"), F.max("b").alias("end")).drop("part")


def free_spans(spans: DataFrame, keys: list[str], low: int, high: int, least: int) -> DataFrame:
    """(keys, start, end): what merged spans leave free between two bounds."""
    m = covered_spans(spans, keys)
    line = Window.partitionBy(*keys).orderBy("start")
    before = m.select(*keys, F.coalesce(F.lag("end").over(line), F.lit(low).cast("long")).alias("start"), F.col("start").alias("end"))
    after = m.groupBy(*keys).agg(F.max("end").alias("start")).withColumn("end", F.lit(high).cast("long"))
    return before.unionByName(after).where(F.col("end") - F.col("start") >= least)


def merged_runs(segments: DataFrame, key: str, near: int = 3) -> DataFrame:
    """(key, axis, pos, a, b): segments within ``near`` positions that overlap become the longest; each is held against the last kept, so the fold runs per frame."""

    def fold(rows: list[tuple]) -> list[tuple]:
        out: list[list] = []
        for k, axis, pos, a, b in rows:
            for o in reversed(out):
                if o[1] == axis and pos - o[2] <= near and min(o[4], b) > max(o[3], a):
                    if b - a > o[4] - o[3]:
                        o[2:] = [pos, a, b]
                    break
            else:
                out.append([k, axis, pos, a, b])
        return [tuple(o) for o in out]

    return fold_sorted(segments.select(key, "axis", "pos", "a", "b"), key, ["axis", "pos", "a", "b"], f"{key} long, axis string, pos long, a long, b long", fold)


def one_table(words: DataFrame, page: str, x: int, least: int = 5, share: float = 0.6) -> DataFrame:
    """(page, together): rows left and right of a gap agree in number and share."""
    rows = words.groupBy(page, "line").agg(F.bool_or(F.col("x1") <= x).alias("l"), F.bool_or(F.col("x0") >= x).alias("r"))
    both = F.count_if(F.col("l") & F.col("r"))
    return rows.groupBy(page).agg(((both >= least) & (both >= share * F.least(F.count_if("l"), F.count_if("r")))).alias("together"))


def uncovered_tiles(rects: DataFrame, key: str, w: int, least: int = 1) -> DataFrame:
    """(key, y0, y1, x0, x1): the free x spans of the bands that all windows' edges cut a frame into.

    A frame is one fold over its rectangles in order of x, so bands are not dealt out; no rows come of a band that no rectangle covers.
    """
    null = -(1 << 62)  # sorts first, as null does

    def free(spans: list[tuple]) -> list[tuple[int, int]]:
        parts: list[list[int]] = []
        far = null
        for a, b in spans:
            if far == null or a == null or a > far:
                parts.append([a, b])
            else:
                parts[-1] = [min(parts[-1][0], a) if parts[-1][0] != null else a, max(parts[-1][1], b)]
            far = max(far, b)
        out, before = [], 0
        for a, b in sorted(parts):
            if a != null:
                out.append((before, a))
            before = 0 if b == null else b
        return [x for x in [*out, *([(far, w)] if far != null else [])] if x[1] - x[0] >= least]

    def fold(rows: list[tuple]) -> list[tuple]:
        ys = sorted({y for r in rows for y in r[3:5]})
        return [(rows[0][0], y0, y1, *x) for y0, y1 in zip(ys, ys[1:], strict=False) for x in free([r[1:3] for r in rows if r[3] < y1 and r[4] > y0])]

    kind = rects.schema[key].dataType.simpleString()
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(null)).alias(c)
    edge = lambda c, other: F.coalesce(c, other).cast("long").alias(c)
    boxes = rects.where("coalesce(y0, y1) IS NOT NULL").select(key, known("x0"), known("x1"), edge("y0", "y1"), edge("y1", "y0"))
    return fold_sorted(boxes, key, ["x0", "x1"], f"{key} {kind}, y0 long, y1 long, x0 long, x1 long", fold)


def prompts(lines: DataFrame, page: str, marks: str = "%$>#") -> DataFrame:
    """(page, prompt, n, marker): the first token key of most lines (two at least), and the first mark common to them all."""
    first = fs.letters(F.lower(F.substring_index(F.trim("text"), " ", 1)))
    t = lines.withColumn("p", first).where("length(p) >= 3")
    n = t.groupBy(page, "p").agg(F.count(F.lit(1)).alias("n"), *(F.bool_and(F.contains(F.col("text"), F.lit(m))).alias(f"m{i}") for i, m in enumerate(marks)))
    best = n.where("n >= 2").groupBy(page).agg(F.max(F.struct("n", F.length("p"), "p", *(f"m{i}" for i in range(len(marks))))).alias("b"))
    mark = F.lit(None).cast("string")
    for i, m in reversed(list(enumerate(marks))):
        mark = F.when(F.col(f"b.m{i}"), m).otherwise(mark)
    return best.select(page, F.col("b.p").alias("prompt"), F.col("b.n").alias("n"), mark.alias("marker"))


def first_said(readings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``readings`` with ``same_as``: the first moment that said it, null on the first."""
    line = Window.partitionBy(*keys).orderBy(*order)
    first = F.first(order[0]).over(line)
    return readings.withColumn("same_as", F.when(F.row_number().over(line) > 1, first))


def newly_readable(words: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, newly): words not among those last read on this window, in the order seen."""
    before = F.lag("words").over(Window.partitionBy(key).orderBy(order))
    low = F.transform(F.coalesce(before, F.array().cast("array<string>")), lambda w: F.lower(w))
    return words.withColumn("_b", low).select(key, order, F.filter(F.array_distinct("words"), lambda w: ~F.array_contains(F.col("_b"), F.lower(w))).alias("newly"))


def event_runs(events: DataFrame, key: str, order: list[str], same: str) -> DataFrame:
    """(key, same, first, last, n): runs of the same event as one line."""
    line = Window.partitionBy(key).orderBy(*order)
    return islands(events, [key], order, F.coalesce(F.col(same) != F.lag(same).over(line), F.lit(True)), "run").groupBy(key, "run", same).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def settled_rects(rects: DataFrame, key: str, order: str, reach: int = 3, share: float = 0.02, w: int = 1920, h: int = 1080) -> DataFrame:
    """(key, order, x0, y0, x1, y1): an unmeasured box inside a larger one within ``reach`` moments takes it when three of four sides are near."""
    b = rects.select(F.col(key).alias("_k"), F.col(order).alias("_o"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    near = sum(((F.abs(F.col(c) - F.col(f"b_{c}")) <= share * s).cast("int") for c, s in (("x0", w), ("x1", w), ("y0", h), ("y1", h))), F.lit(0))
    inside = (F.col("b_x0") <= F.col("x0")) & (F.col("b_y0") <= F.col("y0")) & (F.col("b_x1") >= F.col("x1")) & (F.col("b_y1") >= F.col("y1"))
    larger = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0")) > (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    hit = rects.where("not measured").join(b, (F.col(key) == F.col("_k")) & (F.abs(F.col(order) - F.col("_o")) <= reach)).where(inside & larger & (near >= 3)).groupBy(key, order).agg(F.min(F.struct("_o", "b_x0", "b_y0", "b_x1", "b_y1")).alias("m"))
    j = rects.join(hit, [key, order], "left")
    return j.select(key, order, *(F.coalesce(F.col(f"m.b_{c}"), F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")))


def merged_order(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, name, at): new items go after their nearest matched predecessor, leading ones before the first match, none matched at the end."""
    o = old.select(key, "name", F.col("pos").alias("o"))
    n = new.select(key, "name", F.col("pos").alias("n"))
    line = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    both = n.join(o, [key, "name"], "left").withColumns({"anchor": F.last("o", ignorenulls=True).over(line), "any": F.max("o").over(Window.partitionBy(key)), "low": F.min("o").over(Window.partitionBy(key))})
    size = old.groupBy(key).agg(F.max("pos").alias("top"))
    fresh = both.where("o is null").join(size, key, "left").select(key, "name", F.when(F.col("any").isNull(), F.coalesce("top", F.lit(0))).otherwise(F.coalesce("anchor", F.col("low") - 1)).alias("a"), F.lit(1).alias("side"), F.col("n").alias("b"))
    rows = o.select(key, "name", F.col("o").alias("a"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("b")).unionByName(fresh)
    return rows.select(key, "name", (F.row_number().over(Window.partitionBy(key).orderBy("a", "side", "b")) - 1).cast("long").alias("at"))


def unglued(crumbs: DataFrame, known: DataFrame, key: str, crumb: str = "crumb") -> DataFrame:
    """(key, crumb, left, right): a crumb that ends with a known one, cut there; the longest known end wins."""
    ends = crumbs.select(key, crumb, F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(crumb) - 3))).alias("n")).where(F.col("n") <= F.length(crumb) - 3)
    cut = ends.withColumn("right", F.substr(F.col(crumb), F.col("n") + 1)).join(known.select(F.col(crumb).alias("right")).where("length(right) >= 3").distinct(), "right")
    return cut.groupBy(key, crumb).agg(F.min(F.struct("n", "right")).alias("m")).select(key, crumb, F.expr(f"substr({crumb}, 1, m.n)").alias("left"), F.col("m.right").alias("right"))


def carried(samples: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``samples`` with ``value`` held until it is read again."""
    line = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("held", F.last(value, ignorenulls=True).over(line))


def nearest_level(ratio: Column, levels: list[float]) -> Column:
    """The index of the nearest of the body size and the heading levels; the first of equals."""
    return F.array_min(F.transform(F.array(*map(F.lit, levels)), lambda v, i: F.struct(F.abs(v - ratio).alias("d"), i.alias("i")))).getField("i")


def report_smells(lines: DataFrame, key: str, order: str) -> DataFrame:
    """(key, block, smell): smells of a report's blocks, which open on their marks."""
    b = islands(lines, [key], [order], F.col("text").rlike("^(PANE|WINDOW|MOMENT)"), "block")
    g = b.groupBy(key, "block").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").rlike("[?]")).alias("doubt"), F.bool_or(fs.odd_script(F.col("text"))).alias("odd"), F.bool_or(F.col("text").rlike("^```$")).alias("fence"))
    found = F.array_compact(F.array(F.when((F.col("n") >= 4) & (F.col("doubt") * 2 > F.col("n")), "all unsettled"), F.when(F.col("odd"), "odd script"), F.when(F.col("fence"), "bare fence")))
    return g.select(key, "block", F.explode(found).alias("smell"))


def restored_heading(header: Column, rows: Column, supplied: Column) -> Column:
    """The rows with the heading row back on top where the heading was supplied, unless its first cell is a date."""
    dated = F.get(header, 0).rlike(r"^\d{1,2}[/.]\d")
    return F.when(supplied & ~F.coalesce(dated, F.lit(False)), F.concat(F.array(header), rows)).otherwise(rows)


def loose_table(items: DataFrame, heads: DataFrame, page: str, slack: int = 14) -> DataFrame:
    """(page, line, col, text): items under the last heading that starts at or left of them (within a slack); those left of the first have none."""
    flow = heads.select(page, F.col("x0").alias("x"), F.lit(0).alias("side"), F.col("col"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("text")).union(items.select(page, (F.col("x0") + slack).alias("x"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("col"), "line", "k", "text"))
    held = flow.withColumn("col", F.last("col", ignorenulls=True).over(Window.partitionBy(page).orderBy("x", "side").rowsBetween(Window.unboundedPreceding, 0))).where("side = 1 and col is not null")
    return held.groupBy(page, "line", "col").agg(ordered_text().alias("text"))


def bar_generations(moments: DataFrame, key: str, order: list[str], bar: str = "bar") -> DataFrame:
    """(key, generation, first, words): readings of a bar until its first word changes; a shorter reading of the same bar adds what it has."""
    line = Window.partitionBy(key).orderBy(*order)
    read = moments.where(F.size(bar) > 0).withColumn("head", F.get(bar, 0))
    new = F.coalesce(F.col("head") != F.lag("head").over(line), F.lit(True)).cast("int")
    gen = read.withColumn("_new", new).withColumn("generation", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return gen.groupBy(key, "generation").agg(F.min(order[-1]).alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(bar)))).alias("words"))


def mended_path(paths: list[list[str]], root: str | None = None) -> list[str]:
    """One path from partial readings of it: the longest is the spine, and what another reads between two neighbours of the spine that both have goes there.

    The fuller reading of a crumb stands; crumbs before ``root`` go; a crumb that ends with its own child loses it; repeats are one. Nothing is added to the ends.
    """
    paths = [p for p in paths if p]
    if not paths:
        return []
    same = lambda a, b: fs.folded(a)[0] == fs.folded(b)[0] != ""
    spine = list(max(paths, key=len))
    for p in paths:
        shared = [(k, next((i for i, c in enumerate(spine) if same(c, x)), None)) for k, x in enumerate(p)]
        shared = [(k, i) for k, i in shared if i is not None]
        for k, i in shared:
            if sum(map(len, p[k].split())) >= sum(map(len, spine[i].split())) and len(p[k]) > len(spine[i]):
                spine[i] = p[k]
        for (ka, ia), (kb, ib) in reversed(list(zip(shared, shared[1:], strict=False))):
            if ib == ia + 1 and kb > ka + 1:
                spine[ib:ib] = p[ka + 1 : kb]
    if root is not None and any(same(c, root) for c in spine):
        spine = spine[next(i for i, c in enumerate(spine) if same(c, root)) :]
    out: list[str] = []
    for c, child in zip(spine, [*spine[1:], ""], strict=True):
        head = c[: len(c) - len(child)].strip(" -/>") if child and c.lower().endswith(child.lower()) else ""
        c = head if len(head) >= 3 else c
        if not (out and same(out[-1], c)):
            out.append(c)
    return out


def mended_paths(readings: DataFrame, key: str, order: str, root: str | None = None) -> DataFrame:
    """(key, path): ``mended_path`` of all readings (``path``) of one window's bar."""

    def fold(rows: list[tuple]) -> list[tuple]:
        return [(rows[0][0], mended_path([list(r[2]) for r in rows if r[2] is not None], root))]

    return fold_sorted(readings.select(key, order, "path"), key, [order], f"{key} long, path array<string>", fold)

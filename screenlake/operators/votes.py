"""Aggregations: votes, ledgers, medians, fits and censuses. All aggregate with partial sums before any shuffle where the function allows it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions import strings as fs
from screenlake.functions.folds import fold_sorted


def consensus(readings: DataFrame, key: str = "entity") -> DataFrame:
    """(key, name, status, votes): votes per reading; a cut reading gives its votes to the commonest whole one that it completes to.

    agreed when one is left, ambiguous-glyph when all rivals differ by look-alikes, consensus by a majority over the second, else disputed; ties go to the reading seen first.
    """
    n = readings.groupBy(key, "reading").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    whole = n.where(fs.cut_parts(F.col("reading")).isNull())
    cut = n.where(fs.cut_parts(F.col("reading")).isNotNull()).select(key, F.col("reading").alias("short"), F.col("n").alias("more"))
    gift = cut.join(whole, key).where(fs.completes(F.col("short"), F.col("reading"))).groupBy(key, "short", "more").agg(F.max(F.struct("n", -F.col("first"), "reading")).getField("reading").alias("reading"))
    given = gift.groupBy(key, "reading").agg(F.sum("more").alias("more"))
    poor = n.join(gift.select(key, F.col("short").alias("reading")), [key, "reading"], "left_anti")
    tally = poor.join(given, [key, "reading"], "left").select(key, "reading", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "first")
    line = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    ranked = tally.withColumns({"turn": F.row_number().over(line), "top": F.first("reading").over(line), "second": F.lead("n").over(line)})
    rivals = (F.col("reading") == F.col("top")) | fs.only_lookalikes(fs.letters(F.col("reading")), fs.letters(F.col("top")))
    out = ranked.groupBy(key).agg(F.max("top").alias("name"), F.count(F.lit(1)).alias("left"), F.bool_and(rivals).alias("alike"), F.max(F.when(F.col("turn") == 1, F.col("n"))).alias("votes"), F.max(F.when(F.col("turn") == 1, F.col("second"))).alias("next"))
    status = F.when(F.col("left") == 1, "agreed").when(F.col("alike"), "ambiguous-glyph").when(F.col("votes") > F.col("next"), "consensus").otherwise("disputed")
    return out.select(key, "name", status.alias("status"), "votes")


def merged_list(rows: DataFrame, key: str, least: int = 5) -> DataFrame:
    """(key, name, col2, col3, seen, full): one list over many frames; frames of at least ``least`` rows count, each cell is its commonest non-empty value."""
    big = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "frame"))).where(F.col("_n") >= least)
    entity = fs.flat(F.col("name"))

    def mode(c: str) -> DataFrame:
        votes = big.where(F.col(c) != "").groupBy(key, entity.alias("e"), F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return votes.groupBy(key, "e").agg(F.max(F.struct("n", "v")).getField("v").alias(c))

    seen = big.groupBy(key, entity.alias("e")).agg(F.count(F.lit(1)).alias("seen"), F.count_if(fs.cut_parts(F.col("name")).isNull()).alias("full"))
    return seen.join(mode("name"), [key, "e"], "left").join(mode("col2"), [key, "e"], "left").join(mode("col3"), [key, "e"], "left").select(key, "name", "col2", "col3", "seen", "full")


def medoid(readings: DataFrame, key: str, ratio=fs.edit_ratio) -> DataFrame:
    """(key, medoid): the reading with the greatest summed likeness to the others, 0.002 a letter on top, and 0.02 where the second engine marked it (``marked``, optional).

    Groups are the few readings of one thing; equal readings of a group are compared once and count as often as they occur. Ties by reading.
    """
    marked = F.max("marked") if "marked" in readings.columns else F.lit(False)
    n = readings.groupBy(key, "reading").agg(F.count(F.lit(1)).alias("n"), marked.alias("marked"))
    a = n.select(key, F.col("reading").alias("a"), F.col("n").alias("na"), "marked")
    b = n.select(key, F.col("reading").alias("b"), F.col("n").alias("nb"))
    like = a.join(b, key).withColumn("like", ratio(F.col("a"), F.col("b")) * (F.col("nb") - (F.col("a") == F.col("b")).cast("int")))
    score = like.groupBy(key, "a", "marked").agg((F.sum("like") + F.max(F.length("a")) * 0.002 + F.when(F.col("marked"), 0.02).otherwise(0.0)).alias("s"))
    return score.groupBy(key).agg(F.max(F.struct(F.round("s", 9).alias("s"), "a")).getField("a").alias("medoid"))


def best_reading(readings: DataFrame, key: str) -> DataFrame:
    """(key, best): most underscores, then longest fold, then most dots, then text."""
    count = lambda c: F.length("reading") - F.length(F.replace("reading", F.lit(c), F.lit("")))
    return readings.groupBy(key).agg(F.max(F.struct(count("_").alias("u"), F.length(fs.flat(F.col("reading"))).alias("n"), count(".").alias("d"), "reading")).getField("reading").alias("best"))


def coverage(panes: DataFrame, key: str) -> DataFrame:
    """(key, readings, in_structure, also, unconfirmed, video, holds): sums of the ledger and whether each pane's adds up."""
    parts = ["in_structure", "also", "unconfirmed", "video"]
    balanced = F.col("readings") == sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return panes.groupBy(key).agg(F.sum("readings").alias("readings"), *(F.sum(p).alias(p) for p in parts), F.bool_and(balanced).alias("holds"))


def cost_tally(runs: DataFrame, dims: list[str]) -> DataFrame:
    """Seconds and counts per dimension with all subtotals."""
    return runs.rollup(*dims).agg(F.round(F.sum("took"), 6).alias("seconds"), F.count(F.lit(1)).alias("n"))


def backed_share(rows: DataFrame, key: str, gate: float = 2 / 3) -> DataFrame:
    """(key, share, backed): the share of characters with a second reading behind them."""
    return rows.groupBy(key).agg(F.sum("backed").alias("b"), F.sum("chars").alias("c")).select(key, F.round(F.col("b") / F.greatest("c", F.lit(1)), 9).alias("share"), (F.col("b") >= gate * F.col("c")).alias("backed"))


def gaps(words: DataFrame, keys: list[str]) -> DataFrame:
    return words.withColumn("gap", F.lead("x0").over(Window.partitionBy(*keys).orderBy("k")) - F.col("x1"))


def space_width(words: DataFrame, page: str, line: str, default: float = 6.0) -> DataFrame:
    """(page, space): the median positive gap between words."""
    return gaps(words, [page, line]).groupBy(page).agg(F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(default)).alias("space"))


def advance(words: DataFrame, page: str, least: int = 8, even: float = 0.04) -> DataFrame:
    """(page, advance, spread, monospace): median width per character of words of three letters, and its relative MAD."""
    w = words.where(F.length("text") >= 3).select(page, ((F.col("x1") - F.col("x0")) / F.length("text")).alias("a"))
    mid = w.groupBy(page).agg(F.median("a").alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    out = w.join(mid, page).groupBy(page).agg(F.round(F.first("m"), 9).alias("advance"), F.round(F.median(F.abs(F.col("a") - F.col("m"))) / F.first("m"), 9).alias("spread"))
    return out.withColumn("monospace", F.col("spread") <= even)


def line_pitch(lines: DataFrame, page: str, y: str, even: float = 0.10) -> DataFrame:
    """(page, pitch, off, regular): the least positive gap and the median distance of gaps from its multiples."""
    g = lines.withColumn("g", F.lead(y).over(Window.partitionBy(page).orderBy(y)) - F.col(y)).where("g > 0")
    p = g.groupBy(page).agg(F.min("g").alias("pitch"))
    times = F.col("g") / F.col("pitch")
    return g.join(p, page).groupBy(page, "pitch").agg(F.round(F.median(F.abs(times - F.bround(times))), 9).alias("off")).withColumn("regular", F.col("off") <= even)


def quiet_floor(samples: DataFrame, key: str, least: int = 12, line: float = 4.0, times: float = 2.5) -> DataFrame:
    """(key, floor, line): the 5th percentile of consecutive change, and the line above which a screen is another."""
    step = F.abs(F.col("level") - F.lag("level").over(Window.partitionBy(key).orderBy("t", "seq")))
    out = samples.withColumn("d", step).where("d is not null").groupBy(key).agg(F.percentile("d", F.lit(0.05)).alias("floor"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.round(F.when(F.col("n") + 1 >= least, F.col("floor")), 9).alias("floor"), F.round(F.when(F.col("n") + 1 >= least, F.greatest(F.lit(line), times * F.col("floor"))).otherwise(line), 9).alias("line"))


def median_frame(frames: DataFrame, key: str) -> DataFrame:
    """(key, thumb): per pixel the floor of the median over a burst."""
    cells = frames.select(key, F.posexplode("thumb").alias("pos", "v")).groupBy(key, "pos").agg(F.floor(F.percentile("v", F.lit(0.5))).alias("m"))
    return cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda c: c["m"]).alias("thumb"))


def tie_map(thumb: Column, w: int, h: int) -> Column:
    """1 where a pixel equals its right and its lower neighbour, 0 in the last row and column."""
    def one(v: Column, i: Column) -> Column:
        last = (i % w == w - 1) | (i >= w * (h - 1))
        return F.when(last, 0).otherwise(((v == F.get(thumb, i + 1)) & (v == F.get(thumb, i + w))).cast("int"))

    return F.transform(thumb, one)


def cell_scores(frames: DataFrame, key: str, w: int, h: int, cw: int, ch: int) -> DataFrame:
    """(key, cell, score): mean of the tie map per cell of cw x ch pixels."""
    at = frames.select(key, F.posexplode(tie_map(F.col("thumb"), w, h)).alias("pos", "tie"))
    cell = F.floor(F.floor(F.col("pos") / w) / ch) * (w // cw) + F.floor(F.col("pos") % w / cw)
    return at.groupBy(key, cell.alias("cell")).agg(F.avg("tie").alias("score"))


def moving_cells(frames: DataFrame, key: str, order: str, w: int, cw: int, ch: int, step: float = 2.0, share: float = 0.5) -> DataFrame:
    """(key, cell, moving): mean absolute step per cell over ``step`` in at least a share of the steps."""
    line = Window.partitionBy(key).orderBy(order)
    diff = frames.withColumn("_b", F.lag("thumb").over(line)).where("_b is not null").select(key, order, F.posexplode(F.zip_with("thumb", "_b", lambda a, b: F.abs(a - b))).alias("pos", "d"))
    cell = F.floor(F.floor(F.col("pos") / w) / ch) * (w // cw) + F.floor(F.col("pos") % w / cw)
    per = diff.groupBy(key, order, cell.alias("cell")).agg(F.avg("d").alias("d"))
    return per.groupBy(key, "cell").agg((F.avg((F.col("d") > step).cast("int")) >= share).alias("moving"))


def grid_groups(cells: DataFrame, key: str) -> DataFrame:
    """(key, c, size, x0, y0, x1, y1): groups of cells (x, y) that touch by a side; c is the number of a group, in order of its first cell.

    A frame holds a bounded grid and groups never leave it: one fold, where the components of an open graph take rounds.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        left, out = {r[1:] for r in rows}, []
        for _, y, x in rows:
            if (y, x) not in left:
                continue
            left.remove((y, x))
            group, new = [], [(y, x)]
            while new:
                v, u = new.pop()
                group.append((v, u))
                for near in ((v, u + 1), (v, u - 1), (v + 1, u), (v - 1, u)):
                    if near in left:
                        left.remove(near)
                        new.append(near)
            ys, xs = zip(*group, strict=True)
            out.append((rows[0][0], len(out), len(group), min(xs), min(ys), max(xs) + 1, max(ys) + 1))
        return out

    at = cells.select(key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    return fold_sorted(at, key, ["y", "x"], f"{key} long, c long, size long, x0 long, y0 long, x1 long, y1 long", fold)


def moving_zones(frames: DataFrame, key: str, order: str, w: int, h: int, pixel: int = 8, share: float = 0.5, most: float = 0.15) -> DataFrame:
    """(key, x0, y0, x1, y1): boxes of connected pixels that change in at least a share of the steps; none if too much moves."""
    moving = moving_cells(frames, key, order, w, 1, 1, pixel, share).where("moving").select(key, F.col("cell").alias("pos"))
    few = moving.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most * w * h).select(key)
    cells = moving.join(few, key, "left_semi").select(key, (F.col("pos") % w).alias("x"), F.floor(F.col("pos") / w).alias("y"))
    return grid_groups(cells, key).drop("c", "size")


def standing_text(samples: DataFrame, key: str, still: float = 0.8) -> DataFrame:
    """(key, standing): the glyphs' median change is small beside the ground's, in every look."""
    look = samples.groupBy(key, "look").agg(F.median(F.when(F.col("glyph"), F.col("change"))).alias("g"), F.median(F.when(~F.col("glyph"), F.col("change"))).alias("b"))
    return look.groupBy(key).agg(F.bool_and(F.coalesce(F.col("g") <= still * F.col("b"), F.lit(False))).alias("standing"))


def rendered_block(cells: DataFrame, key: str, least: float = 0.55) -> DataFrame:
    """(key, best, rendered): the best mean tie over blocks."""
    return cells.groupBy(key, "block").agg(F.avg("score").alias("s")).groupBy(key).agg(F.round(F.max("s"), 9).alias("best")).withColumn("rendered", F.col("best") >= least)


def theme(frames: DataFrame, key: str, group: str) -> DataFrame:
    """(group, theme, votes): dark when the median pixel is below 128; a group's theme is the majority of its frames'."""
    one = frames.select(group, key, F.explode("thumb").alias("v")).groupBy(group, key).agg(F.median("v").alias("m"))
    vote = one.groupBy(group, F.when(F.col("m") < 128, "dark").otherwise("light").alias("theme")).agg(F.count(F.lit(1)).alias("votes"))
    return vote.groupBy(group).agg(F.max(F.struct("votes", "theme")).alias("m")).select(group, F.col("m.theme").alias("theme"), F.col("m.votes").alias("votes"))


def ink_match(cells: DataFrame, key: str) -> DataFrame:
    """(key, precision, coverage): the share of drawn cells that are real, and of real ones drawn, outside the mask."""
    c = cells.where("not masked").groupBy(key).agg(F.count_if(F.expr("drawn and real")).alias("both"), F.count_if("drawn").alias("d"), F.count_if("real").alias("r"))
    return c.select(key, F.round(F.col("both") / F.greatest("d", F.lit(1)), 9).alias("precision"), F.round(F.col("both") / F.greatest("r", F.lit(1)), 9).alias("coverage"))


def indent_fit(rows: DataFrame, key: str, most: float = 1.5) -> DataFrame:
    """(key, base, step, miss, straight): least squares of x0 on depth, and the worst residual in row heights."""
    fit = rows.groupBy(key).agg(F.regr_slope("x0", "depth").alias("step"), F.regr_intercept("x0", "depth").alias("base"), F.median(F.col("y1") - F.col("y0")).alias("h"))
    off = rows.join(fit, key).groupBy(key, "base", "step", "h").agg(F.max(F.abs(F.col("x0") - F.col("base") - F.col("step") * F.col("depth"))).alias("m"))
    return off.select(key, F.round("base", 6).alias("base"), F.round("step", 6).alias("step"), F.round(F.col("m") / F.col("h"), 6).alias("miss")).withColumn("straight", F.col("miss") <= most)


def indent_step(rows: DataFrame, key: str) -> DataFrame:
    """(key, step, wobble, clear): the median difference of the levels' means against the median deviation within them."""
    mean = rows.groupBy(key, "depth").agg(F.avg("x0").alias("m"))
    step = mean.withColumn("d", F.lead("m").over(Window.partitionBy(key).orderBy("depth")) - F.col("m")).groupBy(key).agg(F.median("d").alias("step"))
    wob = rows.join(mean, [key, "depth"]).groupBy(key, "depth").agg(F.avg(F.abs(F.col("x0") - F.col("m"))).alias("w")).groupBy(key).agg(F.median("w").alias("wobble"))
    return step.join(wob, key).select(key, F.round("step", 6).alias("step"), F.round("wobble", 6).alias("wobble"), (F.col("step") > F.col("wobble")).alias("clear"))


def lattice(rows: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """(key, slot, y): rows on an even grid. The pitch is the commonest row gap; one widest row a slot within a share of it; grown until two slots are empty."""
    line = Window.partitionBy(key).orderBy("y")
    g = rows.withColumn("g", F.lead("y").over(line) - F.col("y")).where("g > 0").groupBy(key, "g").agg(F.count(F.lit(1)).alias("n"))
    pitch = g.groupBy(key).agg(F.max(F.struct("n", -F.col("g"), "g")).getField("g").alias("pitch"))
    base = rows.groupBy(key).agg(F.min("y").alias("y_first"))
    placed = rows.join(pitch, key).join(base, key).withColumn("slot", F.bround((F.col("y") - F.col("y_first")) / F.col("pitch")))
    near = placed.where(F.abs(F.col("y") - F.col("y_first") - F.col("slot") * F.col("pitch")) <= share * F.col("pitch"))
    one = near.groupBy(key, "slot").agg(F.max(F.struct("width", -F.col("y"), "y")).getField("y").alias("y"))
    order = Window.partitionBy(key).orderBy("slot")
    jump = F.when(F.col("slot") - F.lag("slot").over(order) > 2, 1).otherwise(0)
    parts = one.withColumn("_jump", jump).withColumn("_part", F.sum("_jump").over(order))
    return parts.where("_part = 0").select(key, F.col("slot").cast("long").alias("slot"), "y")


def sweep(items: DataFrame, bars: list[int], key: str | None = None) -> DataFrame:
    """(bar, lost, kept, right): for each bar, wanted items under it, unwanted ones over it, and the rest. The bars are a short list, so each item meets each once."""
    each = items.withColumn("bar", F.explode(F.array(*map(F.lit, bars))))
    over, want = F.col("boxes") >= F.col("bar"), F.col("want") == 1
    return each.groupBy(*([key] if key else []), "bar").agg(F.count_if(want & ~over).alias("lost"), F.count_if(~want & over).alias("kept"), F.count_if((want & over) | (~want & ~over)).alias("right"))


def letter_swaps(pairs: DataFrame, a: str = "a", b: str = "b", top: int = 12) -> DataFrame:
    """(x, y, n): the commonest replacements between near readings."""
    import difflib

    def run(it):
        for pdf in it:
            out = []
            for x, y in zip(pdf[a], pdf[b], strict=True):
                if x and y and x != y:
                    out += [(x[i1:i2], y[j1:j2]) for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if op == "replace" and i2 - i1 <= 3 and j2 - j1 <= 3]
            yield pd.DataFrame(out, columns=["x", "y"])

    return pairs.select(a, b).mapInPandas(run, "x string, y string").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "x", "y").limit(top)


def label_agreement(items: DataFrame, key: str) -> DataFrame:
    """(key, right, wrong, unsure) per key and in total (a null key)."""
    unsure = F.col("verdict") == "uncertain"
    hit = F.col("verdict") == F.col("want")
    return items.rollup(key).agg(F.count_if(hit).alias("right"), F.count_if(~hit & ~unsure).alias("wrong"), F.count_if(unsure).alias("unsure"))


def row_spacing(lines: DataFrame, page: str, height: float, share: float = 0.6, least: int = 3) -> DataFrame:
    """(page, spacing): the upper median of row gaps above a share of a row's height."""
    g = lines.withColumn("g", F.lead("y0").over(Window.partitionBy(page).orderBy("y0")) - F.col("y0")).where(F.col("g") > share * height)
    s = g.groupBy(page).agg(F.array_sort(F.collect_list("g")).alias("a"))
    return s.where(F.size("a") >= least).select(page, F.get("a", F.floor(F.size("a") / 2).cast("int")).alias("spacing"))


def duplicate_blocks(blocks: DataFrame, key: str, least: int = 40, quote: int = 80) -> DataFrame:
    """(key, quote, n): runs of text that begin alike, by their first ``quote`` characters, inside one picture."""
    return blocks.where(F.length("text") >= least).groupBy(key, F.left("text", F.lit(quote)).alias("quote")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def busy_pictures(values: DataFrame, texts: DataFrame, key: str, side: int, spread: float = 18.0, levels: int = 6, text: float = 0.15, least: int = 4) -> DataFrame:
    """(key, cells, x0, y0, x1, y1): pictures, as groups of ``least`` neighbouring busy cells and more.

    A cell (cx, cy) of ``side`` pixels is busy with a deviation over ``spread`` and six grey levels of sixteen, unless text boxes cover more than a share of it.
    """
    busy = values.groupBy(key, "cx", "cy").agg(F.stddev_pop("v").alias("s"), F.count_distinct(F.floor(F.col("v") / 16)).alias("n")).where((F.col("s") > spread) & (F.col("n") >= levels)).select(key, "cx", "cy")
    lap = lambda a, b, c: F.greatest(F.least(F.col(b), (F.col(c) + 1) * side) - F.greatest(F.col(a), F.col(c) * side), F.lit(0))
    covered = busy.join(texts, key).groupBy(key, "cx", "cy").agg(F.sum(lap("x0", "x1", "cx") * lap("y0", "y1", "cy")).alias("area")).where(F.col("area") > text * side * side)

    groups = grid_groups(busy.join(covered, [key, "cx", "cy"], "left_anti").select(key, F.col("cx").alias("x"), F.col("cy").alias("y")), key).where(F.col("size") >= least)
    return groups.select(key, F.col("size").alias("cells"), *((F.col(c) * side).alias(c) for c in ("x0", "y0", "x1", "y1")))

"""Predicates on samples, words, lines and panes; thresholds are keyword arguments with measured defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hms(t: Column) -> Column:
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(t / 3600)), two(F.floor(t / 60) % 60), two(t % 60))


def seconds_of(clock: Column) -> Column:
    """H:M:S, M:S or S in seconds."""
    return F.aggregate(F.split(clock, ":"), F.lit(0).cast("long"), lambda n, p: n * 60 + p.cast("long"))


def spoken(t: Column) -> Column:
    return F.when(t < 90, F.concat(t.cast("string"), F.lit(" seconds"))).otherwise(F.concat(F.floor(t / 60).cast("string"), F.lit(" minutes")))


def screen_verdict(share: Column, camera: float = 0.08, screen: float = 0.35) -> Column:
    return F.when(share <= camera, "camera").when(share >= screen, "screen").otherwise("uncertain")


def aligned_left(words: DataFrame, keys: list[str], ties: list[str], step: int = 6, need: int = 3, least: int = 5) -> DataFrame:
    """(keys, longest, aligned): the longest run of sorted left edges that are at most ``step`` apart."""
    line = Window.partitionBy(*keys).orderBy("x0", *ties)
    gap = F.col("x0") - F.lag("x0").over(line)
    cut = words.withColumn("_cut", F.when(gap.isNull() | (gap > step), 1).otherwise(0))
    runs = cut.withColumn("_run", F.sum("_cut").over(line.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"), ((F.max("n") >= need) & (F.sum("n") >= least)).alias("aligned"))


def reader_route(area: Column, rendered: Column, texts: Column, small: int = 250_000, tree: int = 5) -> Column:
    """Which readers a pane goes to."""
    return F.when((area > 0) & (area < small), "plain text").when(rendered | (texts > 0), F.when(texts >= tree, "structural").otherwise(F.when(rendered & (texts == 0), "structural without tree").otherwise("structural without tree"))).otherwise("none")


def columnar(words: DataFrame, page: str, line: str, gap: float = 1.5, need: int = 3) -> DataFrame:
    """(page, columnar): enough lines with a gap wider than ``gap`` text heights."""
    tall = words.groupBy(page).agg(F.median(F.col("y1") - F.col("y0")).alias("_h"))
    space = F.lead("x0").over(Window.partitionBy(page, line).orderBy("k")) - F.col("x1")
    wide = words.withColumn("_gap", space).join(tall, page).groupBy(page, line).agg(F.coalesce(F.bool_or(F.col("_gap") > gap * F.col("_h")), F.lit(False)).alias("wide"))
    return wide.groupBy(page).agg((F.count_if("wide") >= need).alias("columnar"))


def looks_like_prose(text: Column, least: int = 4) -> Column:
    """Aggregate: more than half of the lines end like sentences."""
    ends = F.right(F.trim(text), F.lit(1)).isin(".", ",", ":", ";", "?", "!")
    return (F.count(F.lit(1)) >= least) & (F.avg(F.when(ends, 1).otherwise(0)) > 0.5)


def column_of_figures(text: Column, least: int = 4, share: float = 0.7) -> Column:
    """Aggregate: most lines begin with a digit and are no numbered items."""
    figure = text.rlike(r"^\s*\d") & ~text.rlike(r"^\s*\d+[.)] ")
    return (F.count(F.lit(1)) >= least) & (F.avg(F.when(figure, 1).otherwise(0)) >= share)


def text_lines(words: DataFrame, keys: list[str], gaps: float = 4.0) -> DataFrame:
    """(keys, text_line): two words, four characters, and a median gap of at most four characters."""
    gap = F.lead("x0").over(Window.partitionBy(*keys).orderBy("k")) - F.col("x1")
    g = words.withColumn("_gap", gap).groupBy(*keys)
    chars = F.sum(F.length("text"))
    return g.agg(((F.count(F.lit(1)) >= 2) & (chars >= 4) & (F.coalesce(F.median("_gap"), F.lit(0.0)) <= gaps * F.sum(F.col("x1") - F.col("x0")) / chars)).alias("text_line"))


def drawn_large(readings: DataFrame, pane: str, height: str = "h", times: float = 2.0, least: int = 4) -> DataFrame:
    """``readings`` with ``large``: confirmed and at least twice the pane's upper median height."""
    turn = F.row_number().over(Window.partitionBy(pane).orderBy(height))
    n = F.count(F.lit(1)).over(Window.partitionBy(pane))
    ranked = readings.withColumns({"_n": n, "_turn": turn})
    mid = F.max(F.when(F.col("_turn") == F.floor(F.col("_n") / 2) + 1, F.col(height))).over(Window.partitionBy(pane))
    return ranked.withColumn("large", (F.col("_n") >= least) & F.col("ok") & (F.col(height) >= times * mid)).drop("_n", "_turn")


def on_band(pairs: DataFrame, row: str, band: str, share: float = 0.6) -> DataFrame:
    """Pairs whose band covers enough of the row's height."""
    both = F.greatest(F.lit(0), F.least(f"{row}y1", f"{band}y1") - F.greatest(f"{row}y0", f"{band}y0"))
    return pairs.where(both >= share * (F.col(f"{row}y1") - F.col(f"{row}y0")))


def confirmed_words(lines: DataFrame, keys: list[str], order: str, doubt: list[str], arrow: str) -> DataFrame:
    """(keys, confirmed): tokens of the lines without a mark of doubt, up to the arrow, in order."""
    clear = lines
    for mark in doubt:
        clear = clear.where(~F.startswith(F.col("text"), F.lit(mark)))
    tokens = F.regexp_extract_all(F.substring_index("text", arrow, 1), F.lit(r"[^\s]+"), F.lit(0))
    got = clear.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), tokens.alias("w")))).alias("_w"))
    return got.select(*keys, F.filter(F.flatten(F.transform("_w", lambda x: x["w"])), lambda w: (F.length(w) >= 2) & w.rlike("[A-Za-z0-9]")).alias("confirmed"))


def pane_kind() -> Column:
    """The first reader that claims a pane, from its verdict columns."""
    return F.when(F.col("tree"), "a file tree").when(F.col("terminal"), "a terminal").when(F.col("list"), "a list of columns").when(F.col("chat"), "a chat log").when(F.col("document"), "an open document").otherwise("text, not a tree")


def program_by_words(lines: DataFrame, key: str, rules: list[tuple[str, Callable[[Column], Column]]], many: tuple[str, int]) -> DataFrame:
    """(key, program): the first program whose words any line says, else by the number of lines."""
    flags = lines.groupBy(key).agg(*(F.bool_or(test(F.col("text"))).alias(name) for name, test in rules), F.count(F.lit(1)).alias("_n"))
    out = F.when(F.col("_n") >= many[1], many[0]).otherwise("unknown")
    for name, _ in reversed(rules):
        out = F.when(F.col(name), name).otherwise(out)
    return flags.select(key, out.alias("program"))

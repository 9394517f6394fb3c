"""Quality rules: each gives (rule, place, what), a row per fault; an empty table is a pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.operators import boxes


def fault(df: DataFrame, rule: str, place: str, what) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(place).cast("string").alias("place"), what.cast("string").alias("what"))


def note_rules(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """No pasted image or style, no loose bar, no seven empty rows, paths of one root."""
    h = F.col(html)
    image = fault(pages.where(h.rlike(r"<img |data:image")), "pasted image", key, F.lit("img"))
    style = fault(pages.where(h.rlike(r"<style>")), "pasted style", key, F.lit("style"))
    bar = fault(pages.where(F.contains(h, F.lit(" | "))), "loose bar", key, F.lit("|"))
    empty = F.size(F.regexp_extract_all(h, F.lit("<p></p>"), F.lit(0)))
    rows = fault(pages.where(empty >= 7), "empty rows", key, empty)
    root = F.regexp_extract_all(h, F.lit('href="/([^"/]*)'), F.lit(1))
    foreign = pages.select(key, F.explode(root).alias("r")).groupBy(key).agg(F.count_distinct("r").alias("n")).where("n > 5")
    return image.union(style).union(bar).union(rows).union(fault(foreign, "several roots", key, F.col("n")))


def picture_rules(rects: DataFrame, key: str, w: int, h: int) -> DataFrame:
    """Boxes exist and lie inside the screen, none is swallowed (95 %) or doubled (like size, 85 %), one is filled."""
    outside = fault(rects.where((F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > w) | (F.col("y1") > h)), "outside the screen", key, F.col("id"))
    bare = fault(rects.groupBy(key).agg(F.count_if(F.col("kind") == "window").alias("n")).where("n = 0"), "nothing filled", key, F.col("n"))
    a = rects.select(key, *(F.col(c).alias(f"a_{c}") for c in ("id", "x0", "y0", "x1", "y1")))
    b = rects.select(key, *(F.col(c).alias(f"b_{c}") for c in ("id", "x0", "y0", "x1", "y1")))
    j = a.join(b, key).where("a_id <> b_id")
    alike = F.least(boxes.area("a_"), boxes.area("b_")) >= 0.85 * F.greatest(boxes.area("a_"), boxes.area("b_"))
    swallowed = fault(j.where((boxes.covered("a_", "b_") > 0.95) & ~alike), "swallowed", key, F.concat_ws("<", F.col("a_id").cast("string"), F.col("b_id").cast("string")))
    doubled = fault(j.where(alike & (boxes.covered("a_", "b_") > 0.85) & (boxes.covered("b_", "a_") > 0.85) & (F.col("a_id") < F.col("b_id"))), "doubled", key, F.concat_ws("=", F.col("a_id").cast("string"), F.col("b_id").cast("string")))
    return outside.union(bare).union(swallowed).union(doubled)


def camera_agreement(notes: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Both directions: a note that says camera where the frame shows a screen, the other way round, and either alone."""
    j = notes.select(key, F.col("verdict").alias("n")).join(frames.select(key, F.col("verdict").alias("f")), key, "full_outer")
    what = F.concat_ws("/", F.coalesce("n", F.lit("-")), F.coalesce("f", F.lit("-")))
    return fault(j.where(F.col("n").isNull() | F.col("f").isNull() | (F.col("n") != F.col("f"))), "camera disagrees", key, what)


def sidebar_dropped(words: DataFrame, filled: DataFrame, vocabulary: list[str], key: str, least: int = 2) -> DataFrame:
    """Filled boxes that hold two favourite words but no sidebar."""
    x, y = boxes.middle("w_", "x"), boxes.middle("w_", "y")
    hit = filled.join(words.where(F.lower("w_text").isin(*vocabulary)), key).where(boxes.holds("p_", x, y) & ~F.col("p_sidebar"))
    return fault(hit.groupBy(key, "p_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "sidebar dropped", key, F.col("p_id"))


def crumb_rules(crumbs: DataFrame, readings: DataFrame, key: str) -> DataFrame:
    """Placeholder, run-together and mangled crumbs; a whole reading of 20 letters that begins with a crumb excuses it, and stays as an exception."""
    c = F.col("crumb")
    rule = F.when(c.rlike("^(folder|untitled|[?]+)$"), "placeholder").when(c.rlike("[a-z]{2}[A-Z]|[a-z][0-9]{2,}[a-z]"), "run together").when(c.rlike("--+|_{2,}") | (F.length(c) > 30), "mangled")
    bad = crumbs.withColumn("rule", rule).where("rule is not null")
    good = readings.where("length(reading) >= 20").select(F.substring("reading", 1, 6).alias("k"), "reading").distinct()
    excused = bad.withColumn("k", F.substring("crumb", 1, 6)).join(good, "k").where("startswith(reading, crumb)").select(key, "crumb").distinct().withColumn("excused", F.lit(True))
    out = bad.join(excused, [key, "crumb"], "left")
    return out.select(F.when(F.col("excused"), F.concat(F.lit("excused: "), "rule")).otherwise(F.col("rule")).alias("rule"), F.col(key).cast("string").alias("place"), F.col("crumb").alias("what"))


def every_region_speaks(regions: DataFrame, read: DataFrame, quiet: DataFrame, unwritten: DataFrame, keys: list[str]) -> DataFrame:
    """Regions without exactly one outcome, and outcomes without a region."""
    marked = [df.select(*keys).distinct().withColumn(n, F.lit(1)) for n, df in (("r", read), ("q", quiet), ("u", unwritten))]
    j = regions.select(*keys).distinct().withColumn("here", F.lit(1))
    for m in marked:
        j = j.join(m, keys, "full_outer")
    n = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("q", "u")), F.coalesce(F.col("r"), F.lit(0)))
    bad = j.withColumn("n", n).where(F.col("here").isNull() | (F.col("n") != 1))
    return bad.select(F.lit("not exactly one outcome").alias("rule"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("place"), F.col("n").cast("string").alias("what"))


def proof_by_damage(good: DataFrame, rule: Callable[[DataFrame], DataFrame], damage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(verdict, examined, before, after): PROVED when damage adds faults, NOT PROVED when it adds none, UNPROVED when nothing was examined."""
    n = good.agg(F.count(F.lit(1)).alias("examined"))
    before, after = rule(good).agg(F.count(F.lit(1)).alias("before")), rule(damage(good)).agg(F.count(F.lit(1)).alias("after"))
    # three tables of one row each
    j = n.join(before, F.lit(True)).join(after, F.lit(True))
    return j.withColumn("verdict", F.when(F.col("examined") == 0, "UNPROVED").when(F.col("after") > F.col("before"), "PROVED").otherwise("NOT PROVED"))

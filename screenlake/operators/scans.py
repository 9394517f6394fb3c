"""Sources and sinks as DataFrame jobs: records, transcripts, word tables, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "kind string, seq bigint, title string, video string, text string, ts string, secs bigint, panes string, seen string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSONL records, blank lines skipped, with the file as their recording; unknown fields are left out."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), F.from_json("value", RECORD).alias("r"))
    return rows.select("file", "r.*")


def of_kind(records: DataFrame, kind: str) -> DataFrame:
    return records.where(F.col("kind") == kind)


def write_records(df: DataFrame, path: str, mode_col: str = "run_mode") -> None:
    """One folder for each way of running, so that a probe never overwrites a full run."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(mode_col).json(path)


def run_mode(at: Column, dense: Column) -> Column:
    return F.when(at.isNotNull(), "named").when(dense, "chronological").otherwise("distinct")


def diary(records: DataFrame, key: str = "video") -> DataFrame:
    """All texts of a recording in order, as one."""
    return records.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), "").alias("diary"))


CUE = r"^\*\*\[(\d+):(\d\d):(\d\d)\]\*\*\s*(.*)$"


def read_cues(lines: DataFrame, text: str = "value") -> DataFrame:
    """(.., t, said) of the lines `**[H:MM:SS]** words`; lines that are none, or say nothing, go."""
    g = lambda k: F.regexp_extract(F.col(text), CUE, k)
    t = g(1).cast("long") * 3600 + g(2).cast("long") * 60 + g(3).cast("long")
    return lines.where(F.col(text).rlike(CUE)).withColumns({"t": t, "said": F.trim(g(4))}).where("said <> ''")


def title_key(title: Column) -> Column:
    """Titles are looked up by this alone."""
    return F.lower(F.regexp_replace(F.trim(title), "[. ]+$", ""))


def by_title(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(title, path) with a null path on a miss; never another's words."""
    return wanted.withColumn("_k", title_key(F.col("title"))).join(known.select(title_key(F.col("title")).alias("_k"), "path").dropDuplicates(["_k"]), "_k", "left").drop("_k")


def stale(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose cached scan is missing or was made under another version."""
    return wanted.join(cache.select(*keys), keys, "left_anti")


def word_lines(words: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Recogniser words (text, conf, x0, y0, x1, y1, k) to lines in reading order; bad words and lines of one character go."""
    good = words.where("text <> '' and conf is not null and conf >= 0")
    out = good.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda w: w["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), (F.avg("conf") / 100).alias("score"), F.median(F.col("y1") - F.col("y0")).alias("height"))
    return out.where(F.length("text") >= least)


def without_furniture(lines: DataFrame, page: str, letters: int = 3, score: float = 0.30, top: float = 0.10, foot: float = 0.96) -> DataFrame:
    """Lines with letters and confidence that lie between the page's bands."""
    kept = lines.withColumn("tall", F.max("y1").over(Window.partitionBy(page))).where((F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")) >= letters) & (F.col("score") >= score))
    return kept.where((F.col("y0") >= top * F.col("tall")) & (F.col("y1") <= foot * F.col("tall"))).drop("tall")


def fenced(lines: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Lines inside ``` fences."""
    fence = F.startswith(F.col(text), F.lit("```"))
    upto = F.sum(fence.cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumns({"_fence": fence, "_n": upto}).where("_n % 2 = 1 and not _fence").drop("_fence", "_n")


def html_items(html: Column, tag: str) -> Column:
    """Texts of a tag's elements, tags stripped, spaces made single."""
    found = F.regexp_extract_all(html, F.lit(f"<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"\s+", " ")))


def html_first_cells(html: Column) -> Column:
    """Per table the text of the first cell of each row; rows without a cell give none."""
    tables = F.regexp_extract_all(html, F.lit("(?s)<table[^>]*>(.*?)</table>"), F.lit(1))
    rows = lambda t: F.regexp_extract_all(t, F.lit("(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    first = lambda r: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(r, "(?s)<t[dh][^>]*>(.*?)</t[dh]>", 1), "<[^>]*>", ""), r"\s+", " "))
    return F.transform(tables, lambda t: F.transform(F.filter(rows(t), lambda r: r.rlike("<t[dh][ >]")), first))


def html_boxes(html: Column, name: str) -> Column:
    """Of elements of a whole class name, the four percentages of place and size; others are skipped."""
    styles = F.regexp_extract_all(html, F.lit(f'class="(?:[^"]* )?{name}(?: [^"]*)?" style="([^"]*)"'), F.lit(1))
    side = lambda s, k: F.regexp_extract(s, rf"{k}:\s*([0-9.]+)%", 1).try_cast("double") if hasattr(s, "try_cast") else F.regexp_extract(s, rf"{k}:\s*([0-9.]+)%", 1).cast("double")
    boxes = F.transform(styles, lambda s: F.struct(*(side(s, k).alias(k) for k in ("left", "top", "width", "height"))))
    return F.filter(boxes, lambda b: b["left"].isNotNull() & b["top"].isNotNull() & b["width"].isNotNull() & b["height"].isNotNull())


def newer_only(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Source rows to copy: no target, or an older one; the target's front matter stays."""
    t = target.select(F.col(key), F.col("mtime").alias("_mtime"), F.col("front").alias("_front"))
    joined = source.join(t, key, "left")
    return joined.withColumn("action", F.when(F.col("_mtime").isNull() | (F.col("_mtime") < F.col("mtime")), "synced").otherwise("kept")).withColumn("front", F.coalesce("_front", "front")).drop("_mtime", "_front")


def work_list(library: DataFrame, done: DataFrame, key: str, redo: bool = False) -> DataFrame:
    """What is left to read, largest first."""
    rest = library if redo else library.join(done.select(key).distinct(), key, "left_anti")
    return rest.orderBy(F.desc("size"), key)


def spread_moments(videos: DataFrame, length: str, n: int, how: str = "inner") -> DataFrame:
    """(.., k, at): n evenly spaced moments; inner leaves the ends out, middle keeps to the middle 80 %, across centres on half, every k seconds from 0."""
    size = F.col(length)
    if how == "every":
        return videos.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(size / n) - 1).cast("long")))).withColumns({"k": F.col("at"), "at": (F.col("at") * n).cast("double")})
    each = videos.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    at = {"inner": size / (n + 1) * (F.col("k") + 1), "middle": size * (0.1 + 0.8 * (F.col("k") + 0.5) / n), "across": F.greatest(F.lit(0.0), size / 2 + (F.col("k") - (n - 1) / 2) * 10.0)}[how]
    return each.withColumn("at", at)


def lexicon(readings: DataFrame, name: str = "name") -> DataFrame:
    """(fold, name, sightings): whole names, the longest spelling of each fold."""
    from screenlake.functions.strings import cut_parts, flat

    n = F.col(name)
    whole = readings.where(cut_parts(n).isNull() & (F.length(n) >= 6) & ~n.rlike(r"^\d[\d.,]*\s*(KB|MB|GB|bytes)$") & ~n.rlike(r"\d{1,2}:\d{2}"))
    return whole.groupBy(flat(n).alias("fold")).agg(F.max(F.struct(F.length(n).alias("n"), n.alias("name"))).getField("name").alias("name"), F.count(F.lit(1)).alias("sightings"))

"""Typed views of the given tables as recognition output: samples, cues, words with boxes, rectangles and so on.

Each view is one projection (exploding where needed) over a table, so filters and columns reach the scan.
All numbers are integers, or doubles that both engines compute alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', date_trunc('SECOND', {ts})::timestamp_ntz)").cast("long")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, t, seq, call, frac, boxes, level, app): one look at a recording every few seconds."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("video"), epoch("ts").alias("t"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "camera").otherwise("screen").alias("call"), (F.col("value") / 100).alias("frac"), (F.col("event_id") % 40).alias("boxes"), F.col("value").alias("level"), F.col("event_type").alias("app"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, t, seq, text): what was said."""
    return table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("video"), epoch("ts").alias("t"), F.col("event_id").alias("seq"), F.col("props").alias("text"))


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, start, seq): when a screen came up."""
    return table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("video"), epoch("ts").alias("start"), F.col("event_id").alias("seq"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, ts, seq, who, said, opens): the lines of chat panes."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("video"), (F.col("turn") * 10).alias("ts"), F.col("role").alias("who"), F.posexplode(F.split("text", "\n")).alias("seq", "said"))
    return rows.where("said <> ''").withColumn("opens", F.col("seq") == 0)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, line, text)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text"))


def _parts(n: int) -> Column:
    """A line cut after every ``n``-th word; lines hold no line feed."""
    return F.split(F.regexp_replace("text", r"\G((?:[^ ]*+ ){%d}[^ ]*+) " % (n - 1), "$1\n"), "\n")


def words(spark: SparkSession, sf_dir: str, some: int = 8) -> DataFrame:
    """(doc, line, k, text, x0, x1, y0, y1): words with boxes, ten units a character.

    A word's place is that of its part of ``some`` words and the length of what stands before it there, so lines are not dealt out to be added up.
    Whole texts are dealt out by document instead, which is far less than their words; steps that go by document need no other shuffle.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc")
    none = "named_struct('n', 0L, 'parts', cast(array() AS array<struct<part: string, at: bigint>>))"
    step = "(s, p) -> named_struct('n', s.n + length(p) + 1, 'parts', concat(s.parts, array(named_struct('part', p, 'at', s.n))))"
    read = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    placed = read.withColumn("parts", _parts(some)).selectExpr("doc", "line", f"posexplode(aggregate(parts, {none}, {step}, s -> s.parts)) AS (c, p)")
    cut = placed.select("doc", "line", "c", "p", F.posexplode(F.split("p.part", " ")).alias("j", "text")).where("text <> ''")
    before = F.when(F.col("j") > 0, F.length(F.expr("substring_index(p.part, ' ', j)")) + 1).otherwise(0)
    boxed = cut.select("doc", "line", (F.col("c") * some + F.col("j")).alias("k"), "text", (F.col("p.at") + before).alias("at"))
    y0 = F.col("line").cast("long") * 20 + (F.col("doc") + F.col("line")) % 3
    return boxed.select("doc", "line", "k", "text", (F.col("at") * 10).alias("x0"), (F.col("at") * 10 + F.length("text") * 10).alias("x1"), y0.alias("y0"), (y0 + 14).alias("y1"))


def two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, line, a, b): a line as two recognisers read it."""
    m = (F.col("doc") + F.col("line")) % 5
    b = F.when(m == 1, F.replace("text", F.lit(" "), F.lit(""))).when(m == 2, F.replace("text", F.lit("l"), F.lit("1"))).when(m == 3, F.regexp_replace("text", " [^ ]*$", "")).when(m == 4, F.replace("text", F.lit("."), F.lit(","))).otherwise(F.col("text"))
    return lines(spark, sf_dir).select("doc", "line", F.col("text").alias("a"), b.alias("b"))


def console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, line, row, a, b): lines wrapped to rows of twelve words, as two recognisers read each row."""
    rows = lines(spark, sf_dir).select("doc", "line", F.posexplode(_parts(12)).alias("row", "text"))
    m = (F.col("doc") + F.col("line") + F.col("row")) % 4
    b = F.when(m == 1, F.replace("text", F.lit(" "), F.lit(""))).when(m == 2, F.replace("text", F.lit("l"), F.lit("1"))).when(m == 3, F.regexp_replace("text", " [^ ]*$", "")).otherwise(F.col("text"))
    return rows.select("doc", "line", "row", F.col("text").alias("a"), b.alias("b"))


def _numbered() -> Column:
    """Lines of an order, from 1; line numbers repeat in the table."""
    return F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(list, r, cells): table rows of three cells."""
    cells = F.array("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("list"), _numbered().alias("r"), cells.alias("cells"))


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, id, kind, x0, y0, x1, y1): windows and panes."""
    x0, y0 = F.col("l_partkey") * 37 % 1500, F.col("l_suppkey") * 53 % 800
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), _numbered().alias("id"), F.when(F.col("l_returnflag") == "N", "window").otherwise("pane").alias("kind"), x0.alias("x0"), y0.alias("y0"), (x0 + 50 + 20 * F.col("l_quantity").cast("long")).alias("x1"), (y0 + 40 + F.floor("l_extendedprice") % 400).alias("y1"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, axis, pos, a, b): straight edges."""
    a = F.col("l_suppkey") * 7 % 500
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.when(F.col("l_linestatus") == "F", "h").otherwise("v").alias("axis"), (F.col("l_partkey") % 200).alias("pos"), a.alias("a"), (a + F.col("l_quantity").cast("long")).alias("b"))


def thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, burst, thumb): grey thumbnails, 8 x 8 row by row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").cast("long").alias("burst"), F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5)).alias("thumb"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, name, reading, seen_at): names as read, some mangled."""
    m, n = F.col("p_partkey") % 4, F.col("p_name")
    reading = F.when(m == 1, F.replace(n, F.lit("o"), F.lit("0"))).when(m == 2, F.concat(F.substring(n, 1, 4), F.lit("…"), F.right(n, F.lit(4)))).when(m == 3, F.upper(n)).otherwise(n)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), n.alias("name"), reading.alias("reading"), F.col("p_size").cast("long").alias("seen_at"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, name, depth, key, x0, y0, y1, collapsed): regions, nations and suppliers as a file tree."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    key = lambda c: F.col(c).cast("long")
    none = F.lit(-1).cast("long")
    top = r.select(key("r_regionkey").alias("a"), none.alias("b"), none.alias("c"), F.col("r_name").alias("name"), F.lit(0).alias("depth"), key("r_regionkey").alias("key"))
    mid = n.select(key("n_regionkey").alias("a"), key("n_nationkey").alias("b"), none.alias("c"), F.col("n_name").alias("name"), F.lit(1).alias("depth"), key("n_nationkey").alias("key"))
    low = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(key("n_regionkey").alias("a"), key("n_nationkey").alias("b"), key("s_suppkey").alias("c"), F.col("s_name").alias("name"), F.lit(2).alias("depth"), key("s_suppkey").alias("key"))
    # the tree is one list with one order: rows are numbered inside their region, after all rows of the regions before
    every = top.union(mid).union(low)
    sizes = every.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("a", F.coalesce(F.sum("n").over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a region
    turn = F.row_number().over(Window.partitionBy("a").orderBy("b", "c"))
    rows = every.withColumn("turn", turn).join(before, "a").withColumn("pos", (F.col("before") + F.col("turn") - 1).cast("long"))
    return rows.select("pos", "name", "depth", "key", (181 + 38 * F.col("depth") + F.col("key") % 3).alias("x0"), (F.col("pos") * 40).alias("y0"), (F.col("pos") * 40 + 20).alias("y1"), (F.col("key") % 2 == 0).alias("collapsed"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, want, boxes, source)."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("item"), F.col("quality").alias("want"), F.floor(F.col("n_chars") / 40).alias("boxes"), "source")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, video, took, size, done, phase)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("video"), (F.col("o_totalprice") / 1000).alias("took"), F.col("o_totalprice").alias("size"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_orderpriority").alias("phase"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, kind, seq, text)."""
    kind = F.when(F.col("role") == "system", "header").when(F.col("role") == "user", "moment").otherwise("footer")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video"), kind.alias("kind"), F.col("turn").alias("seq"), "text")

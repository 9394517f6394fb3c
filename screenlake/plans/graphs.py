"""Queries of limits, sets and components (L01-L06, U01-U05, CC01-CC02)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from screenlake.functions.graph import components
from screenlake.plans.registry import query
from screenlake.plans.texts import flat
from screenlake.functions import strings as fs
from screenlake.operators import joins, votes
from screenlake.plans.joins import KEPT
from screenlake.sources import views


@query("L01_longest_first", "runs", "SELECT run, size, row_number() OVER (ORDER BY size DESC, run) AS turn FROM runs ORDER BY turn LIMIT 100")
def l01(spark, d):
    top = views.runs(spark, d).orderBy(F.desc("size"), "run").limit(100)
    return top.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("size"), "run"))).select("run", "size", "turn")


@query("L02_sharpest", "thumbs", "SELECT burst, arg_max(frame, [list_max(thumb), -frame]) AS sharpest FROM thumbs GROUP BY burst")
def l02(spark, d):
    return views.thumbs(spark, d).groupBy("burst").agg(F.max_by("frame", F.struct(F.array_max("thumb"), -F.col("frame"))).alias("sharpest"))


@query("L03_top_with_rest", "lines", "SELECT doc, line, text, greatest(0, n - 8) AS more FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line) AS turn, count(*) OVER (PARTITION BY doc) AS n FROM lines) WHERE turn <= 8")
def l03(spark, d):
    w = Window.partitionBy("doc")
    n = views.lines(spark, d).withColumns({"turn": F.row_number().over(w.orderBy("line")), "n": F.count(F.lit(1)).over(w)})
    return n.where("turn <= 8").select("doc", "line", "text", F.greatest(F.lit(0), F.col("n") - 8).alias("more"))


@query("L04_moment_limit", "samples", "SELECT video, seq FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, seq) AS turn FROM samples) WHERE turn <= 12 OR video % 10 = 0")
def l04(spark, d):
    s = views.samples(spark, d).withColumn("turn", F.row_number().over(Window.partitionBy("video").orderBy("t", "seq")))
    return s.where("turn <= 12 or video % 10 = 0").select("video", "seq")


@query("L05_reading_order", "words", "SELECT doc, line, k, row_number() OVER (PARTITION BY doc ORDER BY y0, x0, line, k) AS turn FROM words")
def l05(spark, d):
    return views.words(spark, d).select("doc", "line", "k", F.row_number().over(Window.partitionBy("doc").orderBy("y0", "x0", "line", "k")).alias("turn"))


def blobs(spark, d):
    """Groups of neighbouring pixels above a bar, of each frame."""
    p = views.thumbs(spark, d).select("frame", F.posexplode("thumb").alias("pos", "v")).where("v > 140")
    return votes.grid_groups(p.select("frame", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).alias("y")), "frame")


GRID = "p AS (SELECT frame, i % 8 AS x, i // 8 AS y, frame * 64 + i AS id FROM (SELECT frame, generate_subscripts(thumb, 1) - 1 AS i, unnest(thumb) AS v FROM thumbs) WHERE v > 140), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.frame = b.frame AND abs(a.x - b.x) + abs(a.y - b.y) = 1)"


@query("CC01_components", "thumbs", f"{GRID}, r AS (WITH RECURSIVE r(id, n) AS (SELECT id, id FROM p UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.n) SELECT id, min(n) AS c FROM r GROUP BY id) SELECT frame, count(*) AS size, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM p JOIN r ON p.id = r.id GROUP BY frame, c")
def cc01(spark, d):
    return blobs(spark, d).drop("c")


def shared_names(spark, d):
    n = views.names(spark, d).select("key", F.explode(F.slice(F.split("name", " "), 1, 2)).alias("word"), F.floor(F.col("key") / 50).alias("lot"))
    first = n.groupBy("lot", "word").agg(F.min("key").alias("first"))
    return n.join(first, ["lot", "word"]).where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))


@query("CC01b_open_graph", "names", """w AS (SELECT key, key // 50 AS lot, unnest(string_split(name, ' ')[1:2]) AS word FROM names), f AS (SELECT lot, word, min(key) AS first FROM w GROUP BY ALL), e AS (SELECT DISTINCT first AS a, key AS b FROM w JOIN f ON w.lot = f.lot AND w.word = f.word WHERE key <> first), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (WITH RECURSIVE r(id, n) AS (SELECT DISTINCT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.n) SELECT id, min(n) AS component FROM r GROUP BY id) SELECT id, component FROM r""")
def cc01b(spark, d):
    """Names of a lot that share a word, directly or through others."""
    return components(shared_names(spark, d))


BLOBS = f"{GRID}, r AS (WITH RECURSIVE r(id, n) AS (SELECT id, id FROM p UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.n) SELECT id, min(n) AS c FROM r GROUP BY id), g AS (SELECT frame, c, count(*) AS size FROM p JOIN r ON p.id = r.id GROUP BY frame, c)"


@query("L06_largest_groups", "thumbs", f"{BLOBS} SELECT frame, turn, size FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY size DESC, c) AS turn FROM g) WHERE turn <= 3")
def l06(spark, d):
    b = blobs(spark, d).withColumn("turn", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("size"), "c")))
    return b.where("turn <= 3").select("frame", "turn", "size")


def marked_bursts(spark, d):
    """Grey values of a burst by cells of 2 x 2 pixels, contrast spread to the full range, and text boxes in pixels."""
    t = views.thumbs(spark, d).select("burst", "frame", F.posexplode("thumb").alias("pos", "v"))
    v = F.least(F.greatest((F.col("v") - 127) * 3 + 127, F.lit(0)), F.lit(255))
    values = t.select("burst", F.floor(F.col("pos") % 8 / 2).alias("cx"), F.floor(F.col("pos") / 8 / 2).alias("cy"), v.alias("v"))
    r = views.rects(spark, d).where("id = 1").select(F.col("frame").alias("burst"), (F.col("x0") % 8).alias("x0"), (F.col("y0") % 8).alias("y0"))
    return values, r.withColumns({"x1": F.least(F.col("x0") + 2, F.lit(8)), "y1": F.col("y0") + 1})


@query("CC02_busy_cells", "thumbs rects", """v AS (SELECT burst, i % 8 // 2 AS cx, i // 16 AS cy, least(greatest((v - 127) * 3 + 127, 0), 255) AS v FROM (SELECT burst, generate_subscripts(thumb, 1) - 1 AS i, unnest(thumb) AS v FROM thumbs)),
b AS (SELECT frame AS burst, x0 % 8 AS x0, y0 % 8 AS y0, least(x0 % 8 + 2, 8) AS x1, y0 % 8 + 1 AS y1 FROM rects WHERE id = 1),
c AS (SELECT burst, cx, cy FROM v GROUP BY ALL HAVING stddev_pop(v) > 18 AND count(DISTINCT v // 16) >= 6),
t AS (SELECT c.*, cy * 4 + cx AS id FROM c WHERE coalesce((SELECT sum(greatest(least(b.x1, cx * 2 + 2) - greatest(b.x0, cx * 2), 0) * greatest(least(b.y1, cy * 2 + 2) - greatest(b.y0, cy * 2), 0)) FROM b WHERE b.burst = c.burst), 0) <= 0.15 * 4),
r AS (WITH RECURSIVE r(burst, id, n) AS (SELECT burst, id, id FROM t UNION SELECT r.burst, r.id, y.id FROM r JOIN t x ON x.burst = r.burst AND x.id = r.n JOIN t y ON y.burst = x.burst AND abs(y.cx - x.cx) + abs(y.cy - x.cy) = 1) SELECT burst, id, min(n) AS c FROM r GROUP BY burst, id)
SELECT burst, count(*) AS cells, min(cx) * 2 AS x0, min(cy) * 2 AS y0, max(cx) * 2 + 2 AS x1, max(cy) * 2 + 2 AS y1 FROM r JOIN t USING (burst, id) GROUP BY burst, c HAVING count(*) >= 4""")
def cc02(spark, d):
    return votes.busy_pictures(*marked_bursts(spark, d), "burst", side=2)


@query("U01_set_difference", "names", f"a AS (SELECT DISTINCT {flat('name')} AS f FROM names WHERE key % 3 <> 0), b AS (SELECT DISTINCT {flat('reading')} AS f FROM names WHERE key % 3 <> 1) SELECT 'both' AS side, f FROM a WHERE f IN (SELECT f FROM b) UNION ALL SELECT 'only old', f FROM a WHERE f NOT IN (SELECT f FROM b) UNION ALL SELECT 'only new', f FROM b WHERE f NOT IN (SELECT f FROM a)")
def u01(spark, d):
    n = views.names(spark, d)
    old, new = n.where("key % 3 <> 0").select(fs.flat(F.col("name")).alias("f")), n.where("key % 3 <> 1").select(fs.flat(F.col("reading")).alias("f"))
    said = lambda df, s: df.select(F.lit(s).alias("side"), "f")
    return said(old.intersect(new), "both").union(said(old.subtract(new), "only old")).union(said(new.subtract(old), "only new"))


@query("U02_union_with_veto", "rects", KEPT.format("b AS (SELECT * FROM rects WHERE kind = 'window' OR kind = 'pane' AND id % 2 = 0)", "b"))
def u02(spark, d):
    r = views.rects(spark, d)
    return joins.suppressed(r.where("kind = 'window'").unionByName(r.where("kind = 'pane' and id % 2 = 0")), "frame")


@query("U03_ordered_distinct", "lines", "SELECT doc, text, min(line) AS first FROM lines GROUP BY doc, text")
def u03(spark, d):
    return views.lines(spark, d).groupBy("doc", "text").agg(F.min("line").alias("first"))


@query("U04_reader_sets", "samples", "a AS (SELECT video, list(DISTINCT app) FILTER (boxes < 20) AS x, list(DISTINCT app) FILTER (boxes >= 20) AS y FROM samples GROUP BY video) SELECT video, list_sort(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) AS both, list_sort(list_filter(coalesce(x, []), lambda v: NOT list_contains(coalesce(y, []), v))) AS only_x FROM a")
def u04(spark, d):
    a = views.samples(spark, d).groupBy("video").agg(F.collect_set(F.when(F.col("boxes") < 20, F.col("app"))).alias("x"), F.collect_set(F.when(F.col("boxes") >= 20, F.col("app"))).alias("y"))
    return a.select("video", F.array_sort(F.array_union("x", "y")).alias("both"), F.array_sort(F.array_except("x", "y")).alias("only_x"))


@query("U05_shared_marks", "lines", r"m AS (SELECT doc, line, list_distinct(regexp_extract_all(text, '[^A-Za-z0-9\s]')) AS m FROM lines WHERE text <> ''), n AS (SELECT doc, count(*) AS n FROM m GROUP BY doc), c AS (SELECT doc, mark, count(*) AS k FROM (SELECT doc, line, unnest(m) AS mark FROM m) GROUP BY ALL) SELECT n.doc, coalesce(list_sort(list(mark) FILTER (k = n)), []) AS shared FROM n LEFT JOIN c ON n.doc = c.doc GROUP BY n.doc")
def u05(spark, d):
    m = views.lines(spark, d).where("text <> ''").select("doc", F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^A-Za-z0-9\s]"), F.lit(0))).alias("m"))
    g = m.groupBy("doc").agg(F.collect_list("m").alias("a"))
    shared = F.aggregate(F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0))), F.get("a", 0), lambda x, y: F.array_intersect(x, y))
    return g.select("doc", F.array_sort(shared).alias("shared"))

"""Queries of sources and sinks."""

from pyspark.sql import functions as F

from screenlake.functions.storage import new_path
from screenlake.operators import scans
from screenlake.plans.registry import query
from screenlake.sources import views


@query("S01_records_scan", "records", "SELECT video, kind, seq, text FROM records")
def s01(spark, d):
    path = new_path(spark, "records")
    views.records(spark, d).select(F.col("video").cast("string").alias("video"), "kind", "seq", "text").write.json(path)
    back = scans.read_records(spark, path)
    kinds = [scans.of_kind(back, k) for k in ("header", "moment", "footer")]
    return kinds[0].union(kinds[1]).union(kinds[2]).select(F.col("video").cast("long").alias("video"), "kind", "seq", "text")


@query("S02_diary", "records", "SELECT video, string_agg(text, '' ORDER BY seq, text) AS diary FROM records GROUP BY video")
def s02(spark, d):
    return scans.diary(views.records(spark, d))


@query("S03_transcript_scan", "cues", "SELECT video, seq, t % 36000 AS t, text AS said FROM cues")
def s03(spark, d):
    c = views.cues(spark, d)
    t = F.col("t") % 36000
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    line = F.concat(F.lit("**["), F.floor(t / 3600).cast("string"), F.lit(":"), two(F.floor(t / 60) % 60), F.lit(":"), two(t % 60), F.lit("]** "), F.col("text"))
    noise = c.select("video", "seq", F.col("text").alias("value"))
    return scans.read_cues(c.select("video", "seq", line.alias("value")).union(noise)).select("video", "seq", "t", "said")


@query("S04_transcript_lookup", "names", "SELECT n.key, min(o.key) AS path FROM names n LEFT JOIN names o ON lower(regexp_replace(trim(n.reading || '. '), '[. ]+$', '')) = lower(regexp_replace(trim(o.name), '[. ]+$', '')) GROUP BY n.key")
def s04(spark, d):
    n = views.names(spark, d)
    wanted = n.select("key", F.concat("reading", F.lit(". ")).alias("title"))
    known = n.groupBy(F.col("name").alias("title")).agg(F.min("key").alias("path"))
    return scans.by_title(wanted, known).select("key", "path")


@query("S05_scan_cache", "samples", "SELECT DISTINCT video, seq % 3 AS every, 3 AS v FROM samples WHERE NOT (video % 2 = 0 AND seq % 3 = 1)")
def s05(spark, d):
    s = views.samples(spark, d)
    wanted = s.select("video", (F.col("seq") % 3).alias("every"), F.lit(3).alias("v")).distinct()
    cache = s.select("video", (F.col("seq") % 3).alias("every"), F.when((F.col("video") % 2 == 0) & (F.col("seq") % 3 == 1), 3).otherwise(2).alias("v")).distinct()
    return scans.stale(wanted, cache, ["video", "every", "v"])


@query("S06_records_sink", "records", "SELECT CASE WHEN seq % 3 = 0 THEN 'named' WHEN seq % 2 = 0 THEN 'chronological' ELSE 'distinct' END AS run_mode, count(*) AS n FROM records GROUP BY 1")
def s06(spark, d):
    path = new_path(spark, "sink")
    r = views.records(spark, d)
    mode = scans.run_mode(F.when(F.col("seq") % 3 == 0, F.col("seq")), F.col("seq") % 2 == 0)
    scans.write_records(r.withColumn("run_mode", mode), path)
    return spark.read.json(path).groupBy("run_mode").agg(F.count(F.lit(1)).alias("n"))


@query("S07_word_table", "words", "SELECT doc, line, string_agg(text, ' ' ORDER BY k) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(avg((doc + k) % 101) / 100, 9) AS score FROM words WHERE (doc + k) % 7 <> 0 GROUP BY doc, line HAVING length(string_agg(text, ' ')) >= 2")
def s07(spark, d):
    conf = F.when((F.col("doc") + F.col("k")) % 7 == 0, -1).otherwise((F.col("doc") + F.col("k")) % 101)
    return scans.word_lines(views.words(spark, d).withColumn("conf", conf), ["doc", "line"]).select("doc", "line", "text", "x0", "y0", "x1", "y1", F.round("score", 9).alias("score"))


@query("S08_line_grouping", "words", """l AS (SELECT doc, line, string_agg(text, ' ' ORDER BY k) AS text, min(y0) AS y0, max(y1) AS y1, avg((doc + k) % 101) / 100 AS score, median(y1 - y0) AS height FROM words GROUP BY doc, line HAVING length(string_agg(text, ' ')) >= 2),
t AS (SELECT *, max(y1) OVER (PARTITION BY doc) AS tall FROM l)
SELECT doc, line, text, height FROM t WHERE length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 3 AND score >= 0.30 AND y0 >= 0.10 * tall AND y1 <= 0.96 * tall""")
def s08(spark, d):
    w = views.words(spark, d).withColumn("conf", (F.col("doc") + F.col("k")) % 101)
    return scans.without_furniture(scans.word_lines(w, ["doc", "line"]), "doc").select("doc", "line", "text", "height")


@query("S09_truth_file", "lines", """f AS (SELECT doc, line, CASE WHEN line % 5 = 2 THEN '```' ELSE text END AS text FROM lines),
n AS (SELECT *, sum(CASE WHEN starts_with(text, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line) AS n FROM f)
SELECT doc, line, text FROM n WHERE n % 2 = 1 AND NOT starts_with(text, '```')""")
def s09(spark, d):
    f = views.lines(spark, d).withColumn("text", F.when(F.col("line") % 5 == 2, "```").otherwise(F.col("text")))
    return scans.fenced(f, "doc", "line").select("doc", "line", "text")


@query("S10_html_items", "", r"""SELECT page_id, list_transform(regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1), lambda t: trim(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS items FROM pages""".replace("SELECT page_id", "p AS (SELECT * FROM pages) SELECT page_id", 1))
def s10(spark, d):
    return views.pages(spark, d).select("page_id", scans.html_items(F.col("html"), "li").alias("items"))


#: pages whose lists are drawn as tables
TABLES = ((" <ul>", "<table>"), ("<ul>", "<table>"), ("</ul>", "</table>"), ("<li>", '<tr class="x"><td>'), ("</li>", "</td><td>more</td></tr>"))
TABLED = "html"
for _a, _b in TABLES:
    TABLED = f"replace({TABLED}, '{_a}', '{_b}')"


@query("S10b_first_cells", "", rf"""t AS (SELECT page_id, {TABLED} AS html FROM pages), x AS (SELECT page_id, generate_subscripts(regexp_extract_all(html, '(?s)<table[^>]*>(.*?)</table>', 1), 1) - 1 AS tab, unnest(regexp_extract_all(html, '(?s)<table[^>]*>(.*?)</table>', 1)) AS body FROM t)
SELECT page_id, tab, list_transform(list_filter(regexp_extract_all(body, '(?s)<tr[^>]*>(.*?)</tr>', 1), lambda r: regexp_matches(r, '<t[dh][ >]')), lambda r: trim(regexp_replace(regexp_replace(regexp_extract(r, '(?s)<t[dh][^>]*>(.*?)</t[dh]>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS cells FROM x""")
def s10b(spark, d):
    html = F.col("html")
    for a, b in TABLES:
        html = F.replace(html, F.lit(a), F.lit(b))
    return views.pages(spark, d).select("page_id", F.posexplode(scans.html_first_cells(html)).alias("tab", "cells")).withColumn("tab", F.col("tab").cast("long"))


@query("S11_styled_boxes", "", "p AS (SELECT page_id, page_id % 50 AS l, page_id % 40 AS t FROM pages) SELECT page_id, CAST(l AS DOUBLE) AS left_pct, CAST(t AS DOUBLE) AS top_pct, CAST(25.5 AS DOUBLE) AS width_pct, CAST(10 AS DOUBLE) AS height_pct FROM p")
def s11(spark, d):
    style = F.concat(F.lit('<div class="box filled" style="left:'), (F.col("page_id") % 50).cast("string"), F.lit("%;top:"), (F.col("page_id") % 40).cast("string"), F.lit('%;width:25.5%;height:10%"></div><div class="box2" style="left:1%"></div><div class="box" style="left:3%"></div>'))
    b = views.pages(spark, d).select("page_id", F.explode(scans.html_boxes(F.concat("html", style), "box")).alias("b"))
    return b.select("page_id", *(F.col(f"b.{k}").cast("double").alias(f"{k}_pct") for k in ("left", "top", "width", "height")))


@query("S13_newer_only", "runs", "SELECT s.run, CASE WHEN t.run IS NULL OR t.video < s.video THEN 'synced' ELSE 'kept' END AS action, coalesce(t.phase, 'plain') AS front FROM runs s LEFT JOIN (SELECT run + 1 AS run, video, phase FROM runs WHERE done) t ON s.run = t.run")
def s13(spark, d):
    r = views.runs(spark, d)
    target = r.where("done").select((F.col("run") + 1).alias("run"), F.col("video").alias("mtime"), F.col("phase").alias("front"))
    return scans.newer_only(r.select("run", F.col("video").alias("mtime"), F.lit("plain").alias("front")), target, "run").select("run", "action", "front")


@query("S14_work_list", "runs", "SELECT run, size FROM runs WHERE run NOT IN (SELECT run FROM runs WHERE done)")
def s14(spark, d):
    r = views.runs(spark, d)
    return scans.work_list(r, r.where("done"), "run").select("run", "size")


@query("S14b_run_log", "runs", "SELECT video, CAST(sum(CASE WHEN done THEN 1 ELSE 0 END) AS BIGINT) AS done, CAST(sum(CASE WHEN NOT done THEN 1 ELSE 0 END) AS BIGINT) AS left_over, round(sum(took) / count(*), 3) AS ratio FROM runs GROUP BY video")
def s14b(spark, d):
    return views.runs(spark, d).groupBy("video").agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("left_over"), F.round(F.sum("took") / F.count(F.lit(1)), 3).alias("ratio"))


@query("S15_spread_moments", "runs", """SELECT run, how, k, round(at_, 6) AS at FROM (
 SELECT run, 'inner' AS how, k, took / 5 * (k + 1) AS at_ FROM runs, range(0, 4) g(k) UNION ALL
 SELECT run, 'middle', k, took * (0.1 + 0.8 * (k + 0.5) / 4) FROM runs, range(0, 4) g(k) UNION ALL
 SELECT run, 'across', k, greatest(0.0, took / 2 + (k - 1.5) * 10.0) FROM runs, range(0, 4) g(k) UNION ALL
 SELECT run, 'every', k, k * 100.0 FROM (SELECT run, unnest(range(0, greatest(1, CAST(ceil(took / 100) AS BIGINT)))) AS k FROM runs))""".replace("SELECT run, how", "SELECT run, how", 1))
def s15(spark, d):
    r = views.runs(spark, d).select("run", "took")
    parts = [scans.spread_moments(r, "took", 100 if how == "every" else 4, how).select("run", F.lit(how).alias("how"), "k", F.round("at", 6).alias("at")) for how in ("inner", "middle", "across", "every")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("S16_lexicon", "names", r"SELECT regexp_replace(lower(reading), '[^a-z0-9]', '', 'g') AS fold, arg_max(reading, length(reading) * 1000000 + 0) AS any_name, count(*) AS sightings FROM names WHERE NOT contains(reading, '…') AND length(reading) >= 6 GROUP BY 1".replace("arg_max(reading, length(reading) * 1000000 + 0) AS any_name", "max(reading) AS name"))
def s16(spark, d):
    return scans.lexicon(views.names(spark, d), "reading")

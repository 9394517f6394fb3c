"""Queries of projections, filters and predicates."""

from pyspark.sql import functions as F

from screenlake.operators import boxes, rules
from screenlake.plans.registry import query
from screenlake.sources import views


@query("P01_clock", "samples", "SELECT seq, lpad(CAST(t % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') AS clock, t % 86400 AS back, CASE WHEN t % 600 < 90 THEN (t % 600) || ' seconds' ELSE (t % 600 // 60) || ' minutes' END AS said FROM samples")
def p01(spark, d):
    s = views.samples(spark, d)
    clock = rules.hms(F.col("t") % 86400)
    return s.select("seq", clock.alias("clock"), rules.seconds_of(clock).alias("back"), rules.spoken(F.col("t") % 600).alias("said"))


THIRD = "CASE WHEN {0} < 1 THEN '{1}' WHEN {0} < 2 THEN 'middle' ELSE '{2}' END"


@query("P02_place_on_screen", "rects", f"""p AS (SELECT frame, id, x1 - x0 >= 0.85 * 1920 AS wide, y1 - y0 >= 0.85 * 1080 AS tall, {THIRD.format('floor(3 * ((x0 + x1) / 2) / 1920)', 'left', 'right')} AS hw, {THIRD.format('floor(3 * ((y0 + y1) / 2) / 1080)', 'top', 'bottom')} AS vw FROM rects)
SELECT frame, id, CASE WHEN wide AND tall THEN 'filling the screen' WHEN wide THEN 'across the ' || vw WHEN tall AND hw = 'middle' THEN 'down the middle' WHEN tall THEN 'down the ' || hw || ' side' WHEN hw = 'middle' AND vw = 'middle' THEN 'the middle of the screen' WHEN vw = 'middle' THEN 'the ' || hw || ', midway down' ELSE vw || ' ' || hw END AS place FROM p""")
def p02(spark, d):
    return views.rects(spark, d).select("frame", "id", boxes.place_on_screen(1920, 1080).alias("place"))


PAIR = "j AS (SELECT p.frame, p.id AS p_id, w.id AS w_id, p.x0 AS p_x0, p.y0 AS p_y0, p.x1 AS p_x1, p.y1 AS p_y1, w.x0 AS w_x0, w.y0 AS w_y0, w.x1 AS w_x1, w.y1 AS w_y1 FROM rects p JOIN rects w ON p.frame = w.frame AND p.kind = 'pane' AND w.kind = 'window')"
SHARED = "(greatest(least(p_x1, w_x1) - greatest(p_x0, w_x0), 0) * greatest(least(p_y1, w_y1) - greatest(p_y0, w_y0), 0))"


def pairs(spark, d):
    r = views.rects(spark, d)
    p = r.where("kind = 'pane'").select("frame", *(F.col(c).alias(f"p_{c}") for c in ("id", "x0", "y0", "x1", "y1")))
    w = r.where("kind = 'window'").select("frame", *(F.col(c).alias(f"w_{c}") for c in ("id", "x0", "y0", "x1", "y1")))
    return p.join(w, "frame")


@query("P03_place_in_window", "rects", f"""{PAIR},
q AS (SELECT *, greatest(1, w_x1 - w_x0) AS ww, greatest(1, w_y1 - w_y0) AS wh, {THIRD.format('floor(3 * ((p_x0 + p_x1) / 2 - w_x0) / greatest(1, w_x1 - w_x0))', 'left', 'right')} AS hw, {THIRD.format('floor(3 * ((p_y0 + p_y1) / 2 - w_y0) / greatest(1, w_y1 - w_y0))', 'top', 'bottom')} AS vw FROM j)
SELECT frame, p_id, w_id, CASE WHEN (p_x1 - p_x0) * (p_y1 - p_y0) >= 0.5 * ww * wh THEN 'its main body' WHEN p_x1 - p_x0 >= 0.85 * ww THEN 'across its ' || vw WHEN p_y1 - p_y0 >= 0.85 * wh AND hw = 'middle' THEN 'its middle band' WHEN p_y1 - p_y0 >= 0.85 * wh THEN 'its ' || hw || ' side' WHEN hw = 'middle' AND vw = 'middle' THEN 'its middle' WHEN vw = 'middle' THEN 'its ' || hw || ', midway' ELSE 'its ' || vw || ' ' || hw END AS place FROM q""")
def p03(spark, d):
    return pairs(spark, d).select("frame", "p_id", "w_id", boxes.place_in_window("p_", "w_").alias("place"))


@query("P04_rectangle_algebra", "rects", f"""{PAIR},
q AS (SELECT *, {SHARED} AS s, (p_x1 - p_x0) * (p_y1 - p_y0) AS pa, (w_x1 - w_x0) * (w_y1 - w_y0) AS wa, least(p_x1 - p_x0, p_y1 - p_y0, w_x1 - w_x0, w_y1 - w_y0) AS side, greatest(abs(p_x0 - w_x0), abs(p_y0 - w_y0), abs(p_x1 - w_x1), abs(p_y1 - w_y1)) AS off FROM j)
SELECT frame, p_id, w_id, round(CASE WHEN pa + wa - s > 0 THEN s / (pa + wa - s) ELSE 0 END, 9) AS iou, round(s / greatest(1, least(pa, wa)), 9) AS of_smaller, round(s / greatest(1, pa), 9) AS covered, off <= 40 AS same_40, off <= 0.15 * side AS near FROM q""")
def p04(spark, d):
    return pairs(spark, d).select("frame", "p_id", "w_id", F.round(boxes.iou("p_", "w_"), 9).alias("iou"), F.round(boxes.of_smaller("p_", "w_"), 9).alias("of_smaller"), F.round(boxes.covered("p_", "w_"), 9).alias("covered"), boxes.same("p_", "w_", 40).alias("same_40"), boxes.near("p_", "w_").alias("near"))


@query("P05_worth_reading", "samples", "SELECT video, call, sum(boxes) >= 12 AS worth, CASE WHEN sum(boxes) >= 12 THEN call ELSE 'camera' END AS called FROM samples GROUP BY video, call")
def p05(spark, d):
    return views.samples(spark, d).groupBy("video", "call").agg((F.sum("boxes") >= 12).alias("worth")).withColumn("called", F.when(F.col("worth"), F.col("call")).otherwise("camera"))


@query("P06_screen_verdict", "thumbs", "SELECT frame, CASE WHEN share <= 0.08 THEN 'camera' WHEN share >= 0.35 THEN 'screen' ELSE 'uncertain' END AS verdict FROM (SELECT frame, len(list_filter(thumb, lambda v: v / 255 >= 0.55)) / len(thumb) AS share FROM thumbs)")
def p06(spark, d):
    share = F.size(F.filter("thumb", lambda v: v / 255 >= 0.55)) / F.size("thumb")
    return views.thumbs(spark, d).select("frame", rules.screen_verdict(share).alias("verdict"))


@query("P07_aligned_left", "words", """s AS (SELECT doc, line, k, x0, lag(x0) OVER (PARTITION BY doc ORDER BY x0, line, k) AS px FROM words),
g AS (SELECT *, sum(CASE WHEN px IS NULL OR x0 - px > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY x0, line, k ROWS UNBOUNDED PRECEDING) AS grp FROM s),
n AS (SELECT doc, grp, count(*) AS n FROM g GROUP BY doc, grp)
SELECT doc, max(n) AS longest, max(n) >= 3 AND sum(n) >= 5 AS aligned FROM n GROUP BY doc""")
def p07(spark, d):
    out = rules.aligned_left(views.words(spark, d), ["doc"], ["line", "k"])
    return out


@query("P08_cascade_gate", "rects", "SELECT frame, id, CASE WHEN (x1 - x0) * (y1 - y0) > 0 AND (x1 - x0) * (y1 - y0) < 250000 THEN 'plain text' WHEN id % 2 = 0 OR id > 3 THEN CASE WHEN id >= 5 THEN 'structural' ELSE 'structural without tree' END ELSE 'none' END AS route FROM rects")
def p08(spark, d):
    return views.rects(spark, d).select("frame", "id", rules.reader_route(boxes.area(), F.col("id") % 2 == 0, F.when(F.col("id") > 3, F.col("id")).otherwise(0)).alias("route"))


@query("P09_columnar", "words", """m AS (SELECT doc, median(y1 - y0) AS h FROM words GROUP BY doc), g AS (SELECT w.doc, w.line, lead(w.x0) OVER (PARTITION BY w.doc, w.line ORDER BY w.k) - w.x1 AS gap, m.h FROM words w JOIN m ON w.doc = m.doc),
r AS (SELECT doc, line, max(CASE WHEN gap > 1.5 * h THEN 1 ELSE 0 END) AS wide FROM g GROUP BY doc, line)
SELECT doc, sum(wide) >= 3 AS columnar FROM r GROUP BY doc""")
def p09(spark, d):
    return rules.columnar(views.words(spark, d), "doc", "line")


@query("P10_prose", "lines", "SELECT doc, count(*) >= 4 AND avg(CASE WHEN right(trim(text), 1) IN ('.', ',', ':', ';', '?', '!') THEN 1 ELSE 0 END) > 0.5 AS prose FROM lines GROUP BY doc")
def p10(spark, d):
    return views.lines(spark, d).groupBy("doc").agg(rules.looks_like_prose(F.col("text")).alias("prose"))


@query("P11_figures", "lines", r"SELECT doc, count(*) >= 4 AND avg(CASE WHEN regexp_matches(text, '^\s*\d') AND NOT regexp_matches(text, '^\s*\d+[.)] ') THEN 1 ELSE 0 END) >= 0.7 AS figures FROM (SELECT doc, CASE WHEN doc % 3 = 0 THEN line || ' ' || text WHEN doc % 3 = 1 THEN line || '. ' || text ELSE text END AS text FROM lines) GROUP BY doc")
def p11(spark, d):
    t = F.when(F.col("doc") % 3 == 0, F.concat_ws(" ", F.col("line").cast("string"), "text")).when(F.col("doc") % 3 == 1, F.concat_ws(". ", F.col("line").cast("string"), "text")).otherwise(F.col("text"))
    return views.lines(spark, d).withColumn("text", t).groupBy("doc").agg(rules.column_of_figures(F.col("text")).alias("figures"))


@query("P12_text_line", "words", """g AS (SELECT doc, line, text, x1 - x0 AS w, lead(x0) OVER (PARTITION BY doc, line ORDER BY k) - x1 AS gap FROM words)
SELECT doc, line, count(*) >= 2 AND sum(length(text)) >= 4 AND coalesce(median(gap), 0) <= 4 * (sum(w) / sum(length(text))) AS text_line FROM g GROUP BY doc, line""")
def p12(spark, d):
    return rules.text_lines(views.words(spark, d), ["doc", "line"])


@query("P13_drawn_large", "words", """h AS (SELECT doc, line, k, y1 - y0 + (doc + k) % 30 AS h, k % 3 <> 0 AS ok FROM words), u AS (SELECT doc, list_sort(list(h)) AS hs FROM h GROUP BY doc)
SELECT h.doc, line, k, len(hs) >= 4 AND ok AND h >= 2.0 * hs[len(hs) // 2 + 1] AS large FROM h JOIN u ON h.doc = u.doc""")
def p13(spark, d):
    w = views.words(spark, d).select("doc", "line", "k", (F.col("y1") - F.col("y0") + (F.col("doc") + F.col("k")) % 30).alias("h"), (F.col("k") % 3 != 0).alias("ok"))
    return rules.drawn_large(w, "doc").select("doc", "line", "k", "large")


@query("P15_row_on_band", "rects", f"{PAIR} SELECT frame, p_id, w_id FROM j WHERE greatest(0, least(p_y1, w_y1) - greatest(p_y0, w_y0)) >= 0.6 * (p_y1 - p_y0)")
def p15(spark, d):
    return rules.on_band(pairs(spark, d), "p_", "w_").select("frame", "p_id", "w_id")


@query("P17_confirmed_words", "lines", r"""SELECT doc, list_filter(flatten(list(regexp_extract_all(t, '[^\s]+') ORDER BY line)), lambda w: length(w) >= 2 AND regexp_matches(w, '[A-Za-z0-9]')) AS confirmed FROM (SELECT doc, line, split_part(text, ',', 1) AS t FROM lines WHERE NOT starts_with(text, 'The')) GROUP BY doc""")
def p17(spark, d):
    return rules.confirmed_words(views.lines(spark, d), ["doc"], "line", doubt=["The"], arrow=",")


@query("P18_pane_kind", "lines", r"""SELECT doc, CASE WHEN tree THEN 'a file tree' WHEN terminal THEN 'a terminal' WHEN list_ THEN 'a list of columns' WHEN chat THEN 'a chat log' WHEN document THEN 'an open document' ELSE 'text, not a tree' END AS kind FROM
(SELECT doc, count(*) >= 5 AND max(length(text)) < 40 AS tree, bool_or(regexp_matches(text, '^[$%>#]')) AS terminal, sum(CASE WHEN contains(text, ' | ') THEN 1 ELSE 0 END) >= 2 AS list_, sum(CASE WHEN regexp_matches(text, '^[A-Z][a-z]+:') THEN 1 ELSE 0 END) >= 2 AS chat, count(*) >= 4 AND avg(CASE WHEN right(trim(text), 1) IN ('.', ',', ':', ';', '?', '!') THEN 1 ELSE 0 END) > 0.5 AS document FROM lines GROUP BY doc)""")
def p18(spark, d):
    t = F.col("text")
    v = views.lines(spark, d).groupBy("doc").agg(((F.count(F.lit(1)) >= 5) & (F.max(F.length(t)) < 40)).alias("tree"), F.bool_or(t.rlike("^[$%>#]")).alias("terminal"), (F.count_if(F.contains(t, F.lit(" | "))) >= 2).alias("list"), (F.count_if(t.rlike("^[A-Z][a-z]+:")) >= 2).alias("chat"), rules.looks_like_prose(t).alias("document"))
    return v.select("doc", rules.pane_kind().alias("kind"))


@query("P19_program", "lines", """SELECT doc, CASE WHEN bool_or(contains(lower(text), 'licensed')) THEN 'editor' WHEN bool_or(contains(text, '|')) THEN 'files' WHEN bool_or(contains(text, '@')) THEN 'mail' WHEN count(*) >= 20 THEN 'document' ELSE 'unknown' END AS program FROM lines GROUP BY doc""")
def p19(spark, d):
    rule = [("editor", lambda t: F.contains(F.lower(t), F.lit("licensed"))), ("files", lambda t: F.contains(t, F.lit("|"))), ("mail", lambda t: F.contains(t, F.lit("@")))]
    return rules.program_by_words(views.lines(spark, d), "doc", rule, many=("document", 20))


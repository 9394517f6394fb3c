"""Queries of joins."""

from pyspark.sql import functions as F

from screenlake.operators import joins, near_names, scans
from screenlake.plans.predicates import PAIR, SHARED, pairs
from screenlake.plans.registry import query
from screenlake.plans.texts import flat
from screenlake.sources import views

SAID = """held AS (SELECT video, start, seq, greatest(coalesce(lead(start) OVER (PARTITION BY video ORDER BY start, seq), start + {0}), start + 1) AS until FROM screens),
got AS (SELECT h.video, h.start, h.seq, h.until, string_agg(c.text, ' ' ORDER BY c.t, c.seq) AS said FROM held h LEFT JOIN cues c ON h.video = c.video AND c.t >= h.start AND c.t < h.until GROUP BY ALL),
run AS (SELECT h.video, h.seq, arg_max(c.text, c.t * 1000000 + c.seq) AS running FROM held h LEFT JOIN cues c ON h.video = c.video AND c.t <= h.start GROUP BY h.video, h.seq)
SELECT g.video, g.start, g.seq, g.until, coalesce(g.said, r.running) AS said FROM got g JOIN run r ON g.video = r.video AND g.seq = r.seq"""


@query("J01_cues_to_screens", "cues screens", SAID.format(30))
def j01(spark, d):
    return joins.said_on_screens(views.screens(spark, d), views.cues(spark, d))


@query("J02_cues_to_moments", "cues screens", SAID.format(10))
def j02(spark, d):
    return joins.said_on_screens(views.screens(spark, d), views.cues(spark, d), tail=10)


def boxed(spark, d, where: str, p: str):
    return views.rects(spark, d).where(where).select("frame", *(F.col(c).alias(f"{p}{c}") for c in ("id", "x0", "y0", "x1", "y1")))


def sql_boxes(where: str, p: str) -> str:
    return f"(SELECT frame, id AS {p}id, x0 AS {p}x0, y0 AS {p}y0, x1 AS {p}x1, y1 AS {p}y1 FROM rects WHERE {where})"


PANE, WIN, PANEL = "kind = 'pane' and id < 5", "kind = 'window'", "kind = 'pane' and id >= 5"
IN = "((p_x0 + p_x1) / 2 >= w_x0 AND (p_x0 + p_x1) / 2 < w_x1 AND (p_y0 + p_y1) / 2 >= w_y0 AND (p_y0 + p_y1) / 2 < w_y1)"


@query("J03_pane_to_window", "rects", f"SELECT p.frame, p_id, min(w_id) AS wi FROM {sql_boxes(PANE, 'p_')} p LEFT JOIN {sql_boxes(WIN, 'w_')} w ON p.frame = w.frame AND {IN} GROUP BY p.frame, p_id")
def j03(spark, d):
    return joins.first_holder(boxed(spark, d, PANE, "p_"), boxed(spark, d, WIN, "w_"), "frame")


def iou(a: str, b: str) -> str:
    s = f"(greatest(least({a}x1, {b}x1) - greatest({a}x0, {b}x0), 0) * greatest(least({a}y1, {b}y1) - greatest({a}y0, {b}y0), 0))"
    return f"({s} / (({a}x1 - {a}x0) * ({a}y1 - {a}y0) + ({b}x1 - {b}x0) * ({b}y1 - {b}y0) - {s}))"


@query("J04_panel_is_window", "rects", f"""own AS (SELECT DISTINCT p.frame, w_id FROM {sql_boxes(PANE, 'p_')} p JOIN {sql_boxes(WIN, 'w_')} w ON p.frame = w.frame AND {IN})
SELECT q.frame, q_id, min(o.w_id) AS wi FROM {sql_boxes(PANEL, 'q_')} q LEFT JOIN (SELECT w.* FROM {sql_boxes(WIN, 'w_')} w SEMI JOIN own ON w.frame = own.frame AND w.w_id = own.w_id) o ON q.frame = o.frame AND {iou('q_', 'w_')} >= 0.3 GROUP BY q.frame, q_id""")
def j04(spark, d):
    p, w = boxed(spark, d, PANE, "p_"), boxed(spark, d, WIN, "w_")
    own = p.join(w, "frame").where(joins.boxes.holds("w_", joins.boxes.middle("p_", "x"), joins.boxes.middle("p_", "y"))).select("frame", "w_id").distinct()
    return joins.panel_windows(boxed(spark, d, PANEL, "q_"), w, own, "frame", least=0.3)


@query("J05_floating_panels", "rects", f"""SELECT q.frame, q_id FROM {sql_boxes(PANEL, 'q_')} q WHERE NOT EXISTS (SELECT 1 FROM rects r WHERE r.frame = q.frame AND r.id = 1 AND floor((q_x0 + q_x1) / 2) >= r.x0 * 1.5 AND floor((q_x0 + q_x1) / 2) < r.x1 * 1.5 AND floor((q_y0 + q_y1) / 2) >= r.y0 * 1.5 AND floor((q_y0 + q_y1) / 2) < r.y1 * 1.5)
 AND NOT EXISTS (SELECT 1 FROM rects w WHERE w.frame = q.frame AND w.kind = 'window' AND floor((q_x0 + q_x1) / 2) >= w.x0 AND floor((q_x0 + q_x1) / 2) < w.x1 AND floor((q_y0 + q_y1) / 2) >= w.y0 AND floor((q_y0 + q_y1) / 2) < w.y1 AND (w.x1 - w.x0) * (w.y1 - w.y0) >= 2 * (q_x1 - q_x0) * (q_y1 - q_y0))""")
def j05(spark, d):
    return joins.floating(boxed(spark, d, PANEL, "q_"), boxed(spark, d, "id = 1", "r_"), boxed(spark, d, WIN, "w_"), "frame", 1.5).select("frame", "q_id")


QIN = "(q_x0 + q_x1) / 2 >= {0}.x0 AND (q_x0 + q_x1) / 2 < {0}.x1 AND (q_y0 + q_y1) / 2 >= {0}.y0 AND (q_y0 + q_y1) / 2 < {0}.y1"


@query("J06_over_video", "rects", f"""SELECT q.frame, q_id FROM {sql_boxes("kind = 'pane' and id > 1", 'q_')} q WHERE q_id % 3 <> 0 AND EXISTS (SELECT 1 FROM rects z WHERE z.frame = q.frame AND z.id = 1 AND {QIN.format('z')}) AND NOT EXISTS (SELECT 1 FROM rects w WHERE w.frame = q.frame AND w.kind = 'window' AND w.id > 1 AND {QIN.format('w')})""")
def j06(spark, d):
    q = boxed(spark, d, "kind = 'pane' and id > 1", "q_").withColumn("how", F.when(F.col("q_id") % 3 == 0, "sharpest of 5 moving frames").otherwise("stacked 5 still frames"))
    return joins.over_video(q, boxed(spark, d, "id = 1", "z_"), boxed(spark, d, "kind = 'window' and id > 1", "w_"), "frame").select("frame", "q_id")


@query("J07_carry_words", "rects", """r AS (SELECT frame % 20 AS video, frame AS t, id, x0, y0, x1, y1, CASE WHEN frame % 3 <> 0 THEN kind || frame END AS words FROM rects)
SELECT a.video, a.t, a.id, arg_max(b.words, b.t * 100 + b.id) AS words, max(b.t) AS since FROM r a JOIN r b ON a.video = b.video AND a.words IS NULL AND b.words IS NOT NULL AND b.t < a.t AND abs(a.x0 - b.x0) <= 60 AND abs(a.y0 - b.y0) <= 60 AND abs(a.x1 - b.x1) <= 60 AND abs(a.y1 - b.y1) <= 60 GROUP BY a.video, a.t, a.id""")
def j07(spark, d):
    r = views.rects(spark, d).select((F.col("frame") % 20).alias("video"), F.col("frame").alias("t"), "id", "x0", "y0", "x1", "y1", F.when(F.col("frame") % 3 != 0, F.concat("kind", F.col("frame").cast("string"))).alias("words"))
    return joins.carried_words(r, "video", slack=60)


@query("J08_second_reading", "words", """SELECT c.doc, c.line, c.k AS c_k, string_agg(s.text, ' ' ORDER BY s.x0) AS second FROM words c JOIN words s ON c.doc = s.doc AND c.line = s.line AND c.k % 3 = 0 AND (s.x0 + s.x1) / 2 + 3 >= c.x0 AND (s.x0 + s.x1) / 2 + 3 < c.x1 AND s.y0 >= c.y0 - 4 AND s.y1 <= c.y1 + 4 GROUP BY ALL""")
def j08(spark, d):
    w = views.words(spark, d)
    cells = w.where("k % 3 = 0").select("doc", "line", F.col("k").alias("c_k"), *(F.col(c).alias(f"c_{c}") for c in ("x0", "x1", "y0", "y1")))
    second = w.select("doc", "line", F.col("text").alias("s_text"), (F.col("x0") + 3).alias("s_x0"), (F.col("x1") + 3).alias("s_x1"), F.col("y0").alias("s_y0"), F.col("y1").alias("s_y1"))
    return joins.second_reading(cells, second, ["doc", "line"])


TERMS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) >= 3)"


@query("J09_cross_confirm", "two", rf"""o AS (SELECT doc, {flat("string_agg(b, ' ' ORDER BY line)")} AS other FROM two GROUP BY doc),
k AS (SELECT DISTINCT doc, unnest({TERMS.format("o")}) AS term FROM (SELECT doc, string_agg(b, ' ' ORDER BY line) AS o FROM two GROUP BY doc)),
m AS (SELECT doc, line, unnest({TERMS.format("a")}) AS term FROM two),
h AS (SELECT m.doc, m.line, count(k.term) * 2 >= count(*) AS half FROM m LEFT JOIN k ON m.doc = k.doc AND m.term = k.term GROUP BY m.doc, m.line)
SELECT two.doc, two.line, ((length({flat('a')}) >= 3 AND contains(other, {flat('a')})) OR coalesce(half, false)) AND NOT regexp_matches(regexp_replace(a, '[\x00-\x7F]', '', 'g'), '\p{{L}}') AS confirmed FROM two JOIN o ON two.doc = o.doc LEFT JOIN h ON two.doc = h.doc AND two.line = h.line""")
def j09(spark, d):
    return joins.confirmed_by(views.two(spark, d), "doc", "line", respace=False).select("doc", "line", "confirmed")


@query("J09b_respaced")
def j09b(spark, d):
    return joins.confirmed_by(views.two(spark, d), "doc", "line").where("confirmed")


@query("J10_remainder", "lines", rf"""s AS (SELECT doc, string_agg(text, ' ' ORDER BY line) AS raw, min(line) AS top_, max(line) AS foot FROM lines WHERE line % 2 = 1 GROUP BY doc),
u AS (SELECT doc, {flat("raw")} AS used, top_, foot FROM s), k AS (SELECT DISTINCT doc, unnest({TERMS.format("raw")}) AS term FROM s),
m AS (SELECT doc, line, unnest({TERMS.format("text")}) AS term FROM lines WHERE line % 2 = 0),
h AS (SELECT m.doc, m.line, count(k.term) >= 0.7 * count(*) AS held FROM m LEFT JOIN k ON m.doc = k.doc AND m.term = k.term GROUP BY m.doc, m.line),
t AS (SELECT l.doc, l.line, {flat('text')} AS mine, used, top_, foot FROM lines l JOIN u ON l.doc = u.doc LEFT JOIN h ON l.doc = h.doc AND l.line = h.line WHERE l.line % 2 = 0 AND NOT coalesce(held, false)),
b AS (SELECT *, CAST(ceil(0.6 * length(mine) - 1e-9) AS BIGINT) AS n FROM t WHERE mine <> '' AND NOT contains(used, mine))
SELECT doc, line, CASE WHEN line < top_ THEN 'above' WHEN line > foot THEN 'below' ELSE 'beside' END AS place FROM b WHERE length(mine) < 8 OR len(list_filter(range(1, length(mine) - n + 2), lambda i: contains(used, substr(mine, i, n)))) = 0""")
def j10(spark, d):
    n = views.lines(spark, d)
    return joins.leftovers(n, n.where("line % 2 = 1"), "doc", "line")


@query("J11_already_said", "lines", "f AS (SELECT text, min(doc) AS first FROM lines WHERE trim(text) <> '' GROUP BY text) SELECT doc, sum(CASE WHEN first < doc THEN 1 ELSE 0 END) * 2 > count(*) AS said FROM lines JOIN f ON lines.text = f.text GROUP BY doc")
def j11(spark, d):
    return joins.already_said(views.lines(spark, d), "doc")


@query("J12_unchanged", "thumbs", "b AS (SELECT *, lag(thumb) OVER (PARTITION BY burst ORDER BY frame) AS before FROM thumbs) SELECT burst, frame, before IS NOT NULL AND len(list_filter(range(1, len(thumb) + 1), lambda i: abs(thumb[i] - before[i]) > 60)) = 0 AS same FROM b")
def j12(spark, d):
    return joins.unchanged(views.thumbs(spark, d), "burst", "frame", pixel=60)


@query("J13_dropped_rows", "frows", """p AS (SELECT DISTINCT list // 40 AS grp, list AS pane, cells[1] || cells[3] AS name FROM frows WHERE list % 4 <> 0), t AS (SELECT DISTINCT list // 40 AS grp, list AS tab, cells[1] || cells[3] AS name FROM frows WHERE list % 4 = 0),
n AS (SELECT pane, count(*) AS n FROM p GROUP BY pane), h AS (SELECT pane, tab, count(*) AS hits FROM p JOIN t ON p.grp = t.grp AND p.name = t.name GROUP BY ALL),
b AS (SELECT pane, arg_max(tab, hits * 1000000 - tab) AS tab, max(hits) AS hits FROM h GROUP BY pane)
SELECT b.tab AS table, p.name, p.pane FROM b JOIN n ON b.pane = n.pane AND b.hits >= greatest(1, 0.2 * n.n) JOIN p ON p.pane = b.pane WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.tab = b.tab AND t.name = p.name)""".replace("AS table,", 'AS "table",'))
def j13(spark, d):
    r = views.rows(spark, d).select(F.floor(F.col("list") / 40).alias("grp"), "list", F.concat(F.get("cells", 0), F.get("cells", 2)).alias("name"))
    return joins.dropped_rows(r.where("list % 4 <> 0").withColumnRenamed("list", "pane"), r.where("list % 4 = 0").withColumnRenamed("list", "table"), "grp", least=1, share=0.2)


def named_rows(spark, d):
    """Names of a moment's panes and drawn tables; each seventh reading lost a letter."""
    n = views.names(spark, d)
    near = F.when(F.col("key") % 7 == 0, F.concat(F.left("name", F.lit(4)), F.substr(F.col("name"), F.lit(6)))).otherwise(F.col("reading"))
    moment = F.floor(F.col("key") / 8)
    return n.where("key % 3 > 0").select(moment.alias("moment"), F.lit(1).cast("long").alias("pane"), near.alias("name")), n.where("key % 3 < 2").select(moment.alias("moment"), (F.col("key") % 2).alias("table"), "name")


@query("J13b_dropped_close")
def j13b(spark, d):
    return joins.dropped_close(*named_rows(spark, d), "moment", least=1, share=0.2)


@query("J14_greedy_pairs")
def j14(spark, d):
    return joins.greedy_pairs(pairs(spark, d), "frame")


@query("J15_missing_windows", "rects", f"SELECT w.frame, w_id FROM {sql_boxes(WIN, 'w_')} w WHERE NOT EXISTS (SELECT 1 FROM {sql_boxes(PANE, 'p_')} p WHERE p.frame = w.frame AND {SHARED} / greatest(1, least((p_x1 - p_x0) * (p_y1 - p_y0), (w_x1 - w_x0) * (w_y1 - w_y0))) > 0.5)")
def j15(spark, d):
    return joins.uncovered(boxed(spark, d, WIN, "w_"), boxed(spark, d, PANE, "p_"), "frame").select("frame", "w_id")


LAP = "greatest(least({0}x1, {1}x1) - greatest({0}x0, {1}x0), 0) * greatest(least({0}y1, {1}y1) - greatest({0}y0, {1}y0), 0) / greatest(1, least(({0}x1 - {0}x0) * ({0}y1 - {0}y0), ({1}x1 - {1}x0) * ({1}y1 - {1}y0)))"


@query("J15b_unfilled_windows", "rects", f"""w AS (SELECT * FROM rects WHERE {WIN}), t AS (SELECT * FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.frame = a.frame AND b.id <> a.id AND {LAP.format('a.', 'b.')} > 0.5)),
o AS (SELECT t.frame, p.id AS box, count(*) AS n, min(t.id) AS id FROM t JOIN (SELECT * FROM rects WHERE {PANE}) p ON p.frame = t.frame AND {LAP.format('t.', 'p.')} > 0.5 GROUP BY t.frame, p.id)
SELECT frame, id AS w_id FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE n = 1 AND o.frame = t.frame AND o.id = t.id)""")
def j15b(spark, d):
    return joins.unfilled(boxed(spark, d, WIN, "w_"), boxed(spark, d, PANE, "p_"), "frame")


@query("J16_rectangles", "segments", """h AS (SELECT * FROM segments WHERE axis = 'h'), v AS (SELECT * FROM segments WHERE axis = 'v'),
f AS (SELECT t.frame, t.pos AS tp, f.pos AS fp, greatest(t.a, f.a) AS x0, least(t.b, f.b) AS x1 FROM h t JOIN h f ON t.frame = f.frame AND t.pos < f.pos AND least(t.b, f.b) - greatest(t.a, f.a) >= 0.5 * least(t.b - t.a, f.b - f.a))
SELECT DISTINCT f.frame, l.pos AS x0, f.tp AS y0, r.pos AS x1, f.fp AS y1 FROM f JOIN v l ON f.frame = l.frame AND abs(l.pos - f.x0) <= 0.15 * (fp - tp) + 40 JOIN v r ON f.frame = r.frame AND l.pos < r.pos AND abs(r.pos - f.x1) <= 0.15 * (fp - tp) + 440""")
def j16(spark, d):
    return joins.rectangle_candidates(views.segments(spark, d), "frame")


#: rectangles kept so far, frame by frame, in order of size
KEPT = """{0}, q AS (SELECT frame, id, x0, y0, x1, y1, row_number() OVER (PARTITION BY frame ORDER BY (x1 - x0) * (y1 - y0) DESC, id) AS turn FROM {1}),
k AS (WITH RECURSIVE r(frame, turn, kept) AS (SELECT frame, 1, [struct_pack(id := id, x0 := x0, y0 := y0, x1 := x1, y1 := y1)] FROM q WHERE turn = 1 UNION ALL
 SELECT q.frame, r.turn + 1, CASE WHEN len(list_filter(r.kept, lambda m: """ + LAP.format("m.", "q.") + """ > 0.5)) > 0 THEN r.kept ELSE list_append(r.kept, struct_pack(id := q.id, x0 := q.x0, y0 := q.y0, x1 := q.x1, y1 := q.y1)) END FROM r JOIN q ON q.frame = r.frame AND q.turn = r.turn + 1)
 SELECT frame, arg_max(kept, turn) AS kept FROM r GROUP BY frame)
SELECT frame, unnest(list_transform(kept, lambda m: m.id)) AS id FROM k"""


@query("J17_suppression", "rects", KEPT.format("b AS (SELECT * FROM rects)", "b"))
def j17(spark, d):
    return joins.suppressed(views.rects(spark, d), "frame")


LEX = f"x AS (SELECT {flat('name')} AS fold, max(name) AS name, count(*) AS n FROM names WHERE length(name) >= 6 GROUP BY 1)"


@query("J18_lexicon_match", "names", f"""{LEX}, r AS (SELECT key, {flat('reading')} AS fold, {flat("split_part(reading, '…', 1)")} AS head, {flat("split_part(reading, '…', 2)")} AS tail, contains(reading, '…') AS cut FROM names),
e AS (SELECT key, name, 'exact' AS tier FROM r JOIN x ON r.fold = x.fold AND n >= 2),
b AS (SELECT key, min(name) AS name, 'bracket' AS tier FROM r JOIN x ON cut AND n >= 2 AND length(head) >= 4 AND starts_with(x.fold, head) AND ends_with(x.fold, tail) AND length(x.fold) > length(head) + length(tail) GROUP BY key HAVING count(*) = 1)
SELECT * FROM e UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key FROM e)""")
def j18(spark, d):
    n = views.names(spark, d)
    return joins.lexicon_names(n, scans.lexicon(n, "name"))


@query("J18b_likely_names")
def j18b(spark, d):
    n = views.names(spark, d)
    return near_names.lexicon_likely(n, scans.lexicon(n, "name"))


@query("J19_splice", "names", "SELECT key, CASE WHEN substr(name, 1, 7) <> '' AND length(name) >= 7 THEN name END AS spliced FROM names WHERE length(name) >= 7")
def j19(spark, d):
    n = views.names(spark, d).where("length(name) >= 7")
    head, tail = F.substring("name", 1, 6), F.substr(F.col("name"), F.lit(4))
    return n.select("key", joins.overlap_join(head, tail).alias("spliced"))


@query("J20_asof_truth", "samples", """s AS (SELECT video, t, seq, CAST(boxes // 10 AS VARCHAR) AS said FROM samples WHERE app <> 'purchase'), l AS (SELECT video, t, seq, CAST(boxes // 20 AS VARCHAR) AS layout FROM samples WHERE app = 'purchase'),
a AS (SELECT s.video, s.t, s.seq, s.said, (SELECT arg_max(l.layout, l.t * 1000000 + l.seq) FROM l WHERE l.video = s.video AND l.t <= s.t) AS layout FROM s),
c AS (SELECT video, said <> lag(said) OVER w AS p, layout <> lag(layout) OVER w AS q FROM a WHERE layout IS NOT NULL WINDOW w AS (PARTITION BY video ORDER BY t, seq))
SELECT video, CAST(sum(CASE WHEN p AND q THEN 1 ELSE 0 END) AS BIGINT) AS "right", CAST(sum(CASE WHEN q AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS missed, CAST(sum(CASE WHEN p AND NOT q THEN 1 ELSE 0 END) AS BIGINT) AS extra FROM c WHERE p IS NOT NULL GROUP BY video""")
def j20(spark, d):
    s = views.samples(spark, d)
    mine = s.where("app <> 'purchase'").select("video", "t", "seq", F.floor(F.col("boxes") / 10).cast("string").alias("said"))
    return joins.asof_confusion(mine, s.where("app = 'purchase'").select("video", "t", "seq", F.floor(F.col("boxes") / 20).cast("string").alias("layout")), "video")


@query("J21_touching", "rects", """e AS (SELECT a.frame, a.id AS i, b.id AS j FROM rects a JOIN rects b ON a.frame = b.frame AND a.id <> b.id AND ((abs(a.x1 - b.x0) <= 38.4 AND least(a.y1, b.y1) > greatest(a.y0, b.y0)) OR (abs(a.y1 - b.y0) <= 38.4 AND least(a.x1, b.x1) > greatest(a.x0, b.x0)))),
u AS (SELECT frame, i, j FROM e UNION SELECT frame, j, i FROM e),
r AS (WITH RECURSIVE r(frame, id, n) AS (SELECT frame, id, id FROM rects UNION SELECT r.frame, r.id, u.j FROM r JOIN u ON u.frame = r.frame AND u.i = r.n) SELECT frame, id, min(n) AS cluster FROM r GROUP BY frame, id)
SELECT frame, id, cluster FROM r""")
def j21(spark, d):
    return joins.touching_clusters(views.rects(spark, d), "frame", 1920)


@query("J21b_parted_clusters")
def j21b(spark, d):
    r = views.rects(spark, d).withColumns({"window": F.when(F.col("id") % 3 == 0, F.col("id") % 2).cast("long"), "is_list": F.col("kind") == "window", "program": F.when(F.col("id") % 4 == 0, F.col("kind"))})
    return joins.touching_clusters(r, "frame", 1920)


@query("J22_adoption", "rects", f"""n AS (SELECT p.frame, p_id, p_x0, p_y0, p_x1, p_y1, w_id, least(abs(p_y1 - w_y0), abs(p_y0 - w_y1)) AS away FROM {sql_boxes("kind = 'pane'", 'p_')} p JOIN {sql_boxes(WIN, 'w_')} w ON p.frame = w.frame AND abs(p_x1 - p_x0 - (w_x1 - w_x0)) <= 0.3 * (w_x1 - w_x0) AND least(abs(p_y1 - w_y0), abs(p_y0 - w_y1)) <= 120),
o AS (SELECT frame, p_id, any_value(p_x0) AS ax0, any_value(p_y0) AS ay0, any_value(p_x1) AS ax1, any_value(p_y1) AS ay1, arg_min(w_id, away * 100 + w_id) AS w_id FROM n GROUP BY frame, p_id)
SELECT w.frame, w.w_id, least(w_x0, min(ax0)) AS x0, least(w_y0, min(ay0)) AS y0, greatest(w_x1, max(ax1)) AS x1, greatest(w_y1, max(ay1)) AS y1 FROM {sql_boxes(WIN, 'w_')} w JOIN o ON w.frame = o.frame AND w.w_id = o.w_id GROUP BY w.frame, w.w_id, w_x0, w_y0, w_x1, w_y1""")
def j22(spark, d):
    return joins.adopted(boxed(spark, d, "kind = 'pane'", "p_"), boxed(spark, d, WIN, "w_"), "frame", share=0.3, gap=120)


@query("J23_alignment", "tree", """r AS (SELECT pos + 3 AS pos, name AS k, CASE WHEN pos % 5 = 0 THEN lower(name) WHEN pos % 7 = 0 THEN name || 'x' ELSE name END AS name, CASE WHEN pos % 11 = 0 THEN depth + 1 ELSE depth END AS depth, collapsed FROM tree),
s AS (SELECT min(pos) AS start FROM r WHERE k = (SELECT name FROM tree ORDER BY pos LIMIT 1)),
j AS (SELECT t.name AS tn, t.depth AS td, t.collapsed AS tc, r.name AS rn, r.depth AS rd, r.collapsed AS rc FROM tree t LEFT JOIN r ON r.pos - (SELECT start FROM s) = t.pos)
SELECT count(*) AS n, count(*) FILTER (rn = tn) AS exact, count(*) FILTER (regexp_replace(lower(rn), '[^a-z0-9]', '', 'g') = regexp_replace(lower(tn), '[^a-z0-9]', '', 'g')) AS loose, count(*) FILTER (rd = td) AS depth, count(*) FILTER (rc = tc) AS state, count(*) FILTER (rn = tn AND rd = td AND rc = tc) AS "all" FROM j""")
def j23(spark, d):
    t = views.tree(spark, d)
    read = t.select((F.col("pos") + 3).alias("pos"), F.col("name").alias("key"), F.when(F.col("pos") % 5 == 0, F.lower("name")).when(F.col("pos") % 7 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")).alias("name"), F.when(F.col("pos") % 11 == 0, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), "collapsed")
    return joins.aligned_score(read, t.drop("key").withColumn("key", F.col("name")))


@query("J24_twins", "names", f"""t AS (SELECT seen_at AS list, key AS r, reading AS name, key % 5 AS votes, key % 2 = 0 AS ok, CAST(seen_at % 4 AS VARCHAR) AS rest FROM names)
SELECT list, arg_max(r, [votes, CAST(ok AS INT), length(regexp_replace(name, '[A-Za-z0-9 ]', '', 'g')), length(name), -r]) AS r, count(*) AS twins FROM t GROUP BY list, rest, {flat('name')}""")
def j24(spark, d):
    t = views.names(spark, d).select(F.col("seen_at").alias("list"), F.col("key").alias("r"), F.col("reading").alias("name"), (F.col("key") % 5).alias("votes"), (F.col("key") % 2 == 0).alias("ok"), (F.col("seen_at") % 4).cast("string").alias("rest"))
    return joins.twin_rows(t, "list")


@query("J24b_near_twins")
def j24b(spark, d):
    t = views.names(spark, d).select(F.floor(F.col("key") / 20).alias("list"), F.col("key").alias("r"), F.col("reading").alias("name"), (F.col("key") % 5).alias("votes"), (F.col("key") % 2 == 0).alias("ok"), (F.col("seen_at") % 4).cast("string").alias("rest"))
    return joins.near_twins(t, "list")


@query("J25_title_evidence", "samples", """t AS (SELECT video, t, app || (boxes % 4) AS key, (seq * 13) % 1000 AS x FROM samples)
SELECT DISTINCT a.video, a.t, a.key, a.x FROM t a WHERE length(a.key) >= 3 AND (EXISTS (SELECT 1 FROM t b WHERE b.video = a.video AND b.key = a.key AND b.t <> a.t AND abs(b.x - a.x) <= 40) OR a.key IN ('view1', 'click2'))""")
def j25(spark, d):
    t = views.samples(spark, d).select("video", "t", F.concat("app", (F.col("boxes") % 4).cast("string")).alias("key"), (F.col("seq") * 13 % 1000).alias("x"))
    return joins.title_evidence(t, t.where("key in ('view1', 'click2')"))


KNOWN = "k AS (SELECT DISTINCT app || 's' AS key FROM samples)"


@query("J25b_known_titles", "samples", f"""{KNOWN}, t AS (SELECT video, t, CASE WHEN seq % 4 = 0 THEN replace(app, 'i', 'l') ELSE app END || CASE WHEN seq % 3 = 0 THEN 's' ELSE '5' END AS key FROM samples),
n AS (SELECT a.key, min(k.key) AS known FROM (SELECT DISTINCT key FROM t WHERE length(key) >= 6) a JOIN k ON length(k.key) = length(a.key) AND len(list_filter(range(1, length(a.key) + 1), lambda i: substr(a.key, i, 1) <> substr(k.key, i, 1))) = 1 GROUP BY a.key HAVING count(*) = 1)
SELECT video, t.t, t.key, coalesce(n.known, t.key) AS spelt FROM t LEFT JOIN n ON t.key = n.key AND t.key NOT IN (SELECT key FROM k)""")
def j25b(spark, d):
    s = views.samples(spark, d)
    key = F.concat(F.when(F.col("seq") % 4 == 0, F.replace("app", F.lit("i"), F.lit("l"))).otherwise(F.col("app")), F.when(F.col("seq") % 3 == 0, "s").otherwise("5"))
    return joins.known_titles(s.select("video", "t", key.alias("key")), s.select(F.concat("app", F.lit("s")).alias("key")))


@query("J25c_holding_titles", "names", """w AS (SELECT key, unnest([string_split(name, ' ')[1], string_split(name, ' ')[2]]) AS word FROM names), t AS (SELECT DISTINCT name AS title FROM names), k AS (SELECT DISTINCT title, unnest(string_split(title, ' ')) AS word FROM t),
h AS (SELECT w.key, title, count(DISTINCT w.word) AS hit FROM (SELECT DISTINCT * FROM w) w JOIN k ON w.word = k.word GROUP BY ALL), n AS (SELECT key, count(DISTINCT word) AS n FROM w GROUP BY key)
SELECT h.key, min(struct_pack(l := length(title), t := title)).t AS title FROM h JOIN n ON h.key = n.key AND hit = n.n GROUP BY h.key""")
def j25c(spark, d):
    n = views.names(spark, d)
    kept = n.select(F.col("key").alias("strip"), F.explode(F.slice(F.split("name", " "), 1, 2)).alias("key"))
    return joins.holding_titles(kept, n.select(F.col("name").alias("key")).distinct(), ["strip"]).withColumnRenamed("strip", "key")


@query("J26_skip_readers", "samples", """s AS (SELECT video, list(DISTINCT CASE app WHEN 'view' THEN 'tree' WHEN 'click' THEN 'list' WHEN 'signup' THEN 'chat' END) AS have, count(DISTINCT seq) AS n FROM samples GROUP BY video)
SELECT video, CASE WHEN n >= 3 THEN list_filter(['chat', 'list', 'tree'], lambda k: NOT list_contains(have, k)) ELSE [] END AS skip FROM s""")
def j26(spark, d):
    kinds = spark.sql("SELECT * FROM VALUES ('view', 'tree'), ('click', 'list'), ('signup', 'chat') AS k(app, kind)")
    return joins.skipped_readers(views.samples(spark, d).select("video", "app", F.col("seq").alias("bar")), kinds, "video")


@query("J27_words_outside", "rects", f"""w AS (SELECT frame // 10 AS pic, x0 AS w_x0, y0 AS w_y0, x1 AS w_x1, y1 AS w_y1 FROM rects WHERE id > 1), b AS (SELECT frame // 10 AS pic, x0 - (x1 - x0) * 0.01 AS gx0, y0 - (y1 - y0) * 0.01 AS gy0, x1 + (x1 - x0) * 0.01 AS gx1, y1 + (y1 - y0) * 0.01 AS gy1 FROM rects WHERE id = 1),
o AS (SELECT pic, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM b WHERE b.pic = w.pic AND (w_x0 + w_x1) / 2 >= gx0 AND (w_x0 + w_x1) / 2 < gx1 AND (w_y0 + w_y1) / 2 >= gy0 AND (w_y0 + w_y1) / 2 < gy1)) AS outside FROM w GROUP BY pic)
SELECT pic, n, outside, n >= 20 AND outside > 0.15 * n AS fault FROM o""")
def j27(spark, d):
    r = views.rects(spark, d).withColumn("pic", F.floor(F.col("frame") / 10))
    w = r.where("id > 1").select("pic", *(F.col(c).alias(f"w_{c}") for c in ("x0", "y0", "x1", "y1")))
    b = r.where("id = 1").select("pic", *(F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")))
    return joins.words_outside(w, b, "pic")


@query("J28_nearest_measured", "rects", f"{PAIR}, m AS (SELECT frame, p_id, max({iou('p_', 'w_')}) AS iou FROM j GROUP BY frame, p_id) SELECT frame, p_id, round(iou, 9) AS iou, CASE WHEN iou >= 0.55 THEN 'ok' WHEN iou >= 0.3 THEN 'near' ELSE 'off' END AS grade FROM m")
def j28(spark, d):
    return joins.nearest_measured(pairs(spark, d), "frame").withColumn("iou", F.round("iou", 9))


@query("J29_lost_names", "words", """r AS (SELECT doc, list_sort(list(DISTINCT text)) AS names FROM words WHERE line = 0 GROUP BY doc), d AS (SELECT doc, list(text) AS drawn, list_sort(list(text) FILTER (n > 1)) AS doubled FROM (SELECT doc, text, count(*) AS n FROM words WHERE line = 0 AND k % 3 <> 0 GROUP BY ALL) GROUP BY doc)
SELECT r.doc, list_filter(names, lambda x: NOT list_contains(coalesce(drawn, []), x)) AS missing, coalesce(doubled, []) AS doubled FROM r LEFT JOIN d ON r.doc = d.doc""")
def j29(spark, d):
    w = views.words(spark, d).where("line = 0").select("doc", "k", F.col("text").alias("name"))
    return joins.lost_names(w, w.where("k % 3 <> 0"), "doc")


@query("J30_scrolled", "frows", """v AS (SELECT list, list(cells[3] ORDER BY r) AS vals FROM frows GROUP BY list), p AS (SELECT list, vals AS a, list_concat(vals[2:], ['x', 'y']) AS b FROM v)
SELECT list, CASE WHEN len(a) - 1 >= 3 THEN list_concat(a, ['x', 'y']) END AS view FROM p""")
def j30(spark, d):
    v = views.rows(spark, d).groupBy("list").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.get("cells", 2).alias("v")))), lambda x: x["v"]).alias("a"))
    after = F.concat(F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0))), F.array(F.lit("x"), F.lit("y")))
    return v.select("list", joins.scrolled(F.col("a"), after).alias("view"))


@query("J30b_scrolled_panes", "frows", """v AS (SELECT list, list(cells[3] ORDER BY r) AS a FROM frows GROUP BY list), p AS (SELECT list // 3 AS moment, list AS pane, CASE WHEN len(a) - 1 >= 3 THEN list_concat(a, ['x']) END AS view FROM v)
SELECT moment, pane, view FROM p WHERE moment NOT IN (SELECT moment FROM p WHERE view IS NULL)""")
def j30b(spark, d):
    v = views.rows(spark, d).groupBy("list").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.get("cells", 2).alias("v")))), lambda x: x["v"]).alias("before"))
    after = F.concat(F.slice("before", F.lit(2), F.greatest(F.size("before") - 1, F.lit(0))), F.array(F.lit("x")))
    return joins.scrolled_panes(v.select(F.floor(F.col("list") / 3).alias("moment"), F.col("list").alias("pane"), "before", after.alias("after")), "moment")

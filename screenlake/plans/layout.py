"""Queries of ordered-sequence operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from screenlake.operators import layout, sameness, states
from screenlake.plans.registry import query
from screenlake.sources import views

B = "b AS (SELECT *, lag(thumb) OVER (PARTITION BY burst ORDER BY frame) AS b, row_number() OVER (PARTITION BY burst ORDER BY frame) AS turn, count(*) OVER (PARTITION BY burst) AS n_all FROM thumbs)"


@query("W01_shots", "thumbs", f"{B}, m AS (SELECT *, CASE WHEN b IS NOT NULL THEN list_sum(list_transform(range(1, 65), lambda i: abs(thumb[i] - b[i]))) / 64 END AS move FROM b), s AS (SELECT *, sum(CASE WHEN move >= 18.0 THEN 1 ELSE 0 END) OVER (PARTITION BY burst ORDER BY frame) AS shot FROM m), k AS (SELECT burst, shot FROM s WHERE turn = n_all // 2 + 1) SELECT s.burst, s.shot, count(*) AS n, round(coalesce(max(CASE WHEN move < 18.0 THEN move END), 0), 9) AS move, round(coalesce(max(CASE WHEN move < 18.0 THEN move END), 0), 9) < 1.5 AS still FROM s JOIN k ON s.burst = k.burst AND s.shot = k.shot GROUP BY s.burst, s.shot")
def w01(spark, d):
    return layout.shots(views.thumbs(spark, d), "burst", "frame", cut=18.0)


#: each sample with the number of its stretch, whose first level is its anchor; {0} is the bound
STRETCHES = """q AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, seq) AS turn FROM samples),
k AS (WITH RECURSIVE r(video, turn, call, anchor, run) AS (SELECT video, turn, call, level, 1 FROM q WHERE turn = 1 UNION ALL
 SELECT q.video, q.turn, q.call, CASE WHEN q.call <> r.call OR q.call = 'screen' AND abs(q.level - r.anchor) > {0} THEN q.level ELSE r.anchor END, r.run + CASE WHEN q.call <> r.call OR q.call = 'screen' AND abs(q.level - r.anchor) > {0} THEN 1 ELSE 0 END FROM r JOIN q ON q.video = r.video AND q.turn = r.turn + 1) SELECT video, turn, run FROM r)
SELECT k.video, min(q.t) AS start, max(q.t) AS "end", count(*) AS n, any_value(q.call) AS call, arg_max(q.seq, [q.frac, -q.t, -q.seq]) AS best_seq FROM k JOIN q ON q.video = k.video AND q.turn = k.turn GROUP BY k.video, k.run"""


@query("W02_stretches", "samples", STRETCHES.format("30.0"))
def w02(spark, d):
    return states.stretches(views.samples(spark, d), 30.0)


@query("W03_best_sample", "samples", "SELECT video, call, arg_max(seq, [frac, -t, -seq]) AS best FROM samples GROUP BY video, call")
def w03(spark, d):
    return views.samples(spark, d).groupBy("video", "call").agg(F.max_by("seq", F.struct("frac", -F.col("t"), -F.col("seq"))).alias("best"))


@query("W04_dense_moments", "thumbs", f"{B} SELECT burst, frame AS at FROM b WHERE turn = 1 OR (n_all >= 3 AND len(list_filter(range(1, 65), lambda i: abs(thumb[i] - b[i]) > 20)) / 64 >= 0.3)")
def w04(spark, d):
    return layout.dense_moments(views.thumbs(spark, d), "burst", "frame", pixels=20, share=0.3)


ROWS = "c AS (SELECT *, (y0 + y1) / 2 AS cy, lag((y0 + y1) / 2) OVER (PARTITION BY doc ORDER BY y0, x0, line, k) AS p FROM words), r AS (SELECT *, sum(CASE WHEN p IS NULL OR cy - p > 0.5 * (y1 - y0) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY y0, x0, line, k ROWS UNBOUNDED PRECEDING) AS row_ FROM c)"


@query("W05_rows_by_gap", "words", f"{ROWS} SELECT doc, row_ AS row, count(*) AS n, string_agg(text, ' ' ORDER BY x0, line, k) AS text FROM r GROUP BY doc, row_")
def w05(spark, d):
    r = layout.rows_by_gap(views.words(spark, d), "doc")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "line", "k", "text"))), lambda w: w["text"]), " ")
    return r.groupBy("doc", "row").agg(F.count(F.lit(1)).alias("n"), text.alias("text"))


@query("W05b_rows_by_rule")
def w05b(spark, d):
    # a line's words have one box height and top that no other line has, so they follow one another
    w, out = views.words(spark, d).groupBy("doc", "line", "y0", "y1").agg(F.min("k").alias("k"), F.min("x0").alias("x0"), F.count(F.lit(1)).alias("n")), None
    for rule in ("fixed", "mean", "near", "extent"):
        one = layout.rows_by_rule(w, "doc", rule, height=14.0).groupBy("doc", "row").agg(F.sum("n").alias("n")).withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return out


@query("W06_clusters", "words", "p AS (SELECT doc, x0, line, k, lag(x0) OVER (PARTITION BY doc ORDER BY x0, line, k) AS p FROM words), c AS (SELECT *, sum(CASE WHEN p IS NULL OR x0 - p > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY x0, line, k) AS cluster FROM p) SELECT doc, cluster, median(x0) AS x, count(*) AS n FROM c GROUP BY doc, cluster HAVING count(*) >= 2")
def w06(spark, d):
    return layout.clusters_1d(views.words(spark, d), ["doc"], "x0", ["line", "k"])


LINES0 = "f AS (SELECT doc, line, min(x0) AS x0 FROM words WHERE k % 3 = 1 GROUP BY ALL), p AS (SELECT *, lag(x0) OVER (PARTITION BY doc ORDER BY x0, line) AS p FROM f), c AS (SELECT *, sum(CASE WHEN p IS NULL OR x0 - p > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY x0, line) AS cluster FROM p), m AS (SELECT doc, cluster, median(x0) AS x, count(*) AS n FROM c GROUP BY doc, cluster)"


def starts(spark, d):
    return views.words(spark, d).where("k % 3 = 1").groupBy("doc", "line").agg(F.min("x0").alias("x0"))


@query("W06b_left_edge", "words", f"{LINES0} SELECT doc, CAST(floor(coalesce(arg_min(x, cluster) FILTER (n >= 2), arg_max(x, cluster))) AS BIGINT) AS x FROM m GROUP BY doc")
def w06b(spark, d):
    return layout.left_edge(starts(spark, d), "doc", "line")


@query("W06c_guide_columns", "words", f"""{LINES0}, g AS (SELECT DISTINCT doc, CAST(floor(x) AS BIGINT) AS x FROM m WHERE n >= 2), n AS (SELECT doc, count(DISTINCT line) AS n FROM f GROUP BY doc)
SELECT g.doc, g.x FROM g JOIN f ON f.doc = g.doc AND abs(f.x0 - g.x) <= 10 JOIN n ON n.doc = g.doc GROUP BY g.doc, g.x, n.n HAVING count(DISTINCT f.line) < n.n""")
def w06c(spark, d):
    return layout.guide_columns(starts(spark, d), "doc")


@query("W06d_text_margin")
def w06d(spark, d):
    return layout.text_margin(views.words(spark, d), "doc", 12.0)


@query("W06e_column_bands")
def w06e(spark, d):
    return layout.column_bands(views.words(spark, d).groupBy("doc", "k").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")), "doc", 12.0)


@query("W09_split_wide", "words", "w AS (SELECT * FROM words WHERE k % 4 <> 2), g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc, line ORDER BY k) AS gap, sum(x1 - x0) OVER (PARTITION BY doc, line) / sum(length(text)) OVER (PARTITION BY doc, line) AS ch FROM w), p AS (SELECT *, sum(CASE WHEN gap > 4.0 * ch THEN 1 ELSE 0 END) OVER (PARTITION BY doc, line ORDER BY k) AS piece FROM g) SELECT doc, line, piece, string_agg(text, ' ' ORDER BY k) AS text, min(x0) AS x0, max(x1) AS x1 FROM p GROUP BY doc, line, piece")
def w09(spark, d):
    return layout.split_wide(views.words(spark, d).where("k % 4 <> 2"), ["doc", "line"])


WIDEST = "w AS (SELECT * FROM words WHERE k % 4 <> 2), g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc, line ORDER BY k) AS gap FROM w), m AS (SELECT doc, line, arg_max(k, [gap, k]) AS cut, max(gap) AS gap FROM g WHERE gap IS NOT NULL GROUP BY doc, line HAVING max(gap) >= 42), s AS (SELECT g.doc, g.line, string_agg(text, ' ' ORDER BY k) FILTER (k < cut) AS label, string_agg(text, ' ' ORDER BY k) FILTER (k >= cut) AS value, min(x0) AS x FROM g JOIN m ON g.doc = m.doc AND g.line = m.line GROUP BY g.doc, g.line)"


@query("W10_split_widest", "words", f"{WIDEST} SELECT doc, line, label, value FROM s")
def w10(spark, d):
    return layout.split_widest(views.words(spark, d).where("k % 4 <> 2"), ["doc", "line"], 42)


@query("W10b_split_panel", "words", """w AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc, line ORDER BY k) AS gap FROM words WHERE k % 4 <> 2), l AS (SELECT doc, line, arg_max(k, [gap, k]) FILTER (gap IS NOT NULL) AS cut, coalesce(max(gap) >= 1.2 * max(y1 - y0), false) AS wide FROM w GROUP BY ALL), e AS (SELECT doc FROM l GROUP BY doc HAVING bool_and(wide))
SELECT w.doc, w.line, string_agg(text, ' ' ORDER BY k) FILTER (k < cut) AS label, string_agg(text, ' ' ORDER BY k) FILTER (k >= cut) AS value FROM w JOIN l ON w.doc = l.doc AND w.line = l.line WHERE w.doc IN (SELECT doc FROM e) GROUP BY w.doc, w.line""")
def w10b(spark, d):
    return layout.split_panel(views.words(spark, d).where("k % 4 <> 2"), "doc", "line")


@query("W11_property_block", "words", f"{WIDEST} SELECT doc, count(*) AS fields, max(line) AS last, count(*) >= 2 AND max(x) - min(x) <= 10 AS block FROM s WHERE line < 12 AND regexp_matches(label, '^[A-Za-z]') GROUP BY doc")
def w11(spark, d):
    w = views.words(spark, d).where("k % 4 <> 2")
    x = w.groupBy("doc", "line").agg(F.min("x0").alias("x"))
    return layout.property_block(layout.split_widest(w, ["doc", "line"], 42).join(x, ["doc", "line"]), "doc")


CHAT = "e AS (SELECT *, sum(CASE WHEN opens OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video, ts ORDER BY seq) AS entry FROM (SELECT *, row_number() OVER (PARTITION BY video, ts ORDER BY seq) AS rn FROM (SELECT video, ts, seq, who, said, seq % 3 = 0 AS opens FROM chat)))"


@query("W12_chat_entries", "chat", f"{CHAT} SELECT video, ts, entry, arg_min(who, seq) AS who, string_agg(said, ' ' ORDER BY seq) AS said FROM e GROUP BY video, ts, entry")
def w12(spark, d):
    return layout.chat_entries(views.chat(spark, d).withColumn("opens", F.col("seq") % 3 == 0), ["video", "ts"], "seq")


@query("W12b_chat_verdict", "chat", "SELECT video, count(*) FILTER (who <> '' AND ts % 20 = 0) >= 2 AND count(*) FILTER (who <> '' AND ts % 20 = 0) * 2 > count(*) AS chat FROM chat GROUP BY video")
def w12b(spark, d):
    return layout.chat_verdict(views.chat(spark, d).withColumn("who", F.when(F.col("ts") % 20 == 0, F.col("who")).otherwise("")), ["video"])


@query("W14_wraps", "words", "l AS (SELECT doc, line, string_agg(text, ' ' ORDER BY k) AS text, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, arg_min(x1 - x0, k) AS first FROM words GROUP BY doc, line), e AS (SELECT *, max(x1) OVER (PARTITION BY doc) AS edge, lag(x1) OVER (PARTITION BY doc ORDER BY line) AS px, lag(y1) OVER (PARTITION BY doc ORDER BY line) AS py FROM l), p AS (SELECT *, sum(CASE WHEN coalesce(edge - px < first AND y0 - py < 42, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY line) AS para FROM e) SELECT doc, para, string_agg(text, ' ' ORDER BY line) AS text FROM p GROUP BY doc, para")
def w14(spark, d):
    rows = views.words(spark, d).groupBy("doc", "line").agg(layout.ordered_text().alias("text"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min_by(F.col("x1") - F.col("x0"), "k").alias("first"))
    return layout.joined_wraps(rows.withColumn("edge", F.max("x1").over(Window.partitionBy("doc"))), "doc", "edge", 14)


@query("W15_clip_column", "words", "e AS (SELECT doc, list_sort(list(e)) AS a FROM (SELECT doc, line, max(x1) AS e FROM words GROUP BY ALL) GROUP BY doc), g AS (SELECT w.doc, line, k, x0, a[CAST(floor(len(a) * 0.75) AS INT) + 1] AS edge, x0 - lag(x1) OVER (PARTITION BY w.doc, line ORDER BY k) AS g FROM words w JOIN e ON w.doc = e.doc) SELECT doc, line, k FROM g WHERE x0 <= edge OR g < 9")
def w15(spark, d):
    return layout.clip_to_column(views.words(spark, d), "doc", "line", gap=9).select("doc", "line", "k")


@query("W16_text_column", "words", "s AS (SELECT doc, line, min(x0) + doc % 3 * line % 70 AS x FROM words GROUP BY doc, line), b AS (SELECT *, x // 10 AS b FROM s), t AS (SELECT doc, -(max(struct_pack(n := n, b := -b)).b) AS bin FROM (SELECT doc, b, count(*) AS n FROM b GROUP BY ALL) GROUP BY doc) SELECT b.doc, bin, min(x) AS margin FROM b JOIN t ON b.doc = t.doc AND abs(b - bin) <= 3 GROUP BY b.doc, bin")
def w16(spark, d):
    return layout.text_column(views.words(spark, d).withColumn("x0", F.col("x0") + F.col("doc") % 3 * F.col("line") % 70), "doc")


@query("W17_open_state", "tree", "SELECT pos, CASE WHEN lead(depth) OVER (ORDER BY pos) > depth THEN 'expanded' WHEN collapsed THEN 'collapsed' ELSE 'file' END AS kind FROM tree")
def w17(spark, d):
    return layout.open_state(views.tree(spark, d).withColumn("tree", F.lit(1)), ["tree"]).select("pos", "kind")


@query("W18_depth_validity", "tree", "m AS (SELECT margin, pos, CASE WHEN margin = 0 THEN depth ELSE greatest(0, (x0 - 181 - margin) // 38) END AS depth FROM tree, range(0, 60, 10) r(margin)), b AS (SELECT *, lag(depth) OVER (PARTITION BY margin ORDER BY pos) AS p FROM m) SELECT margin, count(*) FILTER (CASE WHEN p IS NULL THEN depth <> 0 ELSE depth > p + 1 END) AS faults FROM b GROUP BY margin")
def w18(spark, d):
    m = views.tree(spark, d).withColumn("margin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(50).cast("long"), F.lit(10).cast("long"))))
    depth = F.when(F.col("margin") == 0, F.col("depth")).otherwise(F.greatest(F.lit(0), F.floor((F.col("x0") - 181 - F.col("margin")) / 38)))
    return layout.depth_faults(m.withColumn("depth", depth), ["margin"])


@query("W18b_plateau", "samples", "a AS (SELECT video, seq AS margin, boxes // 14 AS answer, boxes // 14 AS columns, boxes // 20 * 0 AS total FROM samples), r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> answer THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY margin) AS run FROM (SELECT *, lag(answer) OVER (PARTITION BY video ORDER BY margin) AS p FROM a)), g AS (SELECT video, run, any_value(columns) AS c, any_value(total) AS t, count(*) AS n, list(margin ORDER BY margin) AS m FROM r GROUP BY video, run) SELECT video, m[len(m) // 2 + 1] AS margin FROM (SELECT video, arg_max(m, [c, t, n, -run]) AS m FROM g GROUP BY video)")
def w18b(spark, d):
    a = F.floor(F.col("boxes") / 14)
    return layout.best_plateau(views.samples(spark, d).select("video", F.col("seq").alias("margin"), a.alias("answer"), a.alias("columns"), F.lit(0).alias("total")), "video")


@query("W19_parent_path", "tree", "p AS (SELECT pos, depth, name, last_value(CASE WHEN depth = 0 THEN name END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN depth = 1 THEN name END IGNORE NULLS) OVER w AS b FROM tree WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT pos, CASE depth WHEN 0 THEN a WHEN 1 THEN a || '/' || b ELSE a || '/' || b || '/' || name END AS path FROM p")
def w19(spark, d):
    return layout.parent_paths(views.tree(spark, d).withColumn("tree", F.lit(1)), ["tree"]).select("pos", "path")


@query("W20_corridors", "words", "w AS (SELECT doc, line, k, x0 + 30 * (k // 3) AS x0, x1 + 30 * (k // 3) AS x1 FROM words), e AS (SELECT doc, min(e) AS short FROM (SELECT doc, line, max(x1) AS e FROM w GROUP BY ALL) GROUP BY doc HAVING count(*) >= 3), t AS (SELECT DISTINCT doc, unnest(range(x0 // 10, (x1 - 1) // 10 + 1)) AS b FROM w), f AS (SELECT doc, b FROM (SELECT doc, unnest(range(0, short // 10 + 1)) AS b FROM e) x WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc = x.doc AND t.b = x.b)), i AS (SELECT *, b - row_number() OVER (PARTITION BY doc ORDER BY b) AS i FROM f) SELECT doc, min(b) AS start, max(b) + 1 AS \"end\" FROM i GROUP BY doc, i HAVING max(b) + 1 - min(b) >= 2")
def w20(spark, d):
    return layout.blank_corridors(spaced(spark, d), "doc", least=2)


def spaced(spark, d):
    """Words with a gap of 30 more after every third."""
    more = F.floor(F.col("k") / 3) * 30
    return views.words(spark, d).withColumns({"x0": F.col("x0") + more, "x1": F.col("x1") + more})


@query("W20b_corridor_blocks")
def w20b(spark, d):
    return sameness.corridor_blocks(spaced(spark, d), "doc", 30)


@query("W21_cells_in_bands", "words", "SELECT doc, line, CASE WHEN (x0 + x1) / 2 < 100 THEN 0 WHEN (x0 + x1) / 2 < 300 THEN 1 WHEN (x0 + x1) / 2 >= 350 AND (x0 + x1) / 2 < 700 THEN 2 ELSE -1 END AS band, string_agg(text, ' ' ORDER BY k) AS text FROM words GROUP BY ALL")
def w21(spark, d):
    return layout.cells_in_bands(views.words(spark, d), [(0, 100), (100, 300), (350, 700)], ["doc", "line"])


@query("W21b_strays_and_columns", "words", """m AS (SELECT *, (x0 + x1) / 2 AS x FROM words WHERE k % 3 = 0), b AS (SELECT *, CASE WHEN x < 100 THEN 0 WHEN x >= 150 AND x < 300 THEN 1 WHEN x >= 350 AND x < 700 THEN 2 ELSE -1 END AS band, CASE WHEN x >= 700 THEN 2 WHEN x >= 300 THEN 1 WHEN x >= 100 THEN 0 ELSE -1 END AS before FROM m),
f AS (SELECT *, list(DISTINCT band) OVER (PARTITION BY doc, line) AS filled FROM b), g AS (SELECT *, list_filter([before, before + 1], lambda i: i >= 0 AND i < 3 AND NOT list_contains(filled, i)) AS free FROM f)
SELECT doc, line, CAST(CASE WHEN band = -1 AND len(free) = 1 THEN free[1] ELSE band END AS INT) AS band, string_agg(text, ' ' ORDER BY k) AS text FROM g GROUP BY ALL""")
def w21b(spark, d):
    return layout.cells_in_bands(views.words(spark, d).where("k % 3 = 0"), [(0, 100), (150, 300), (350, 700)], ["doc", "line"], strays=True)


@query("W21c_kept_columns", "words", """c AS (SELECT doc, line, k % 3 AS band, min(x0) AS x0, max(x1) AS x1 FROM words GROUP BY ALL), r AS (SELECT doc, count(DISTINCT line) AS rows_ FROM c GROUP BY doc), m AS (SELECT doc, band, median(x0) AS l, median(x1) AS r, count(DISTINCT line) AS n FROM c GROUP BY ALL),
o AS (SELECT c.doc, c.band, n, median(abs(x0 - l)) AS dl, median(abs(x1 - r)) AS dr FROM c JOIN m ON c.doc = m.doc AND c.band = m.band GROUP BY ALL) SELECT o.doc, band, rows_ - n <= 1 AND least(dl, dr) <= 15.0 AS kept FROM o JOIN r ON o.doc = r.doc""")
def w21c(spark, d):
    c = views.words(spark, d).groupBy("doc", "line", (F.col("k") % 3).alias("band")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return layout.kept_columns(c, "doc", "line", space=10.0)


@query("W22_row_growth", "frows", "o AS (SELECT list, r, len(list_filter(cells, lambda c: c <> 'F')) >= 2 AND (list + r) % 4 <> 1 AS ok, cells[1] = 'N' AS seed FROM frows), p AS (SELECT *, sum(CASE WHEN q IS NULL OR q <> ok THEN 1 ELSE 0 END) OVER (PARTITION BY list ORDER BY r) AS part FROM (SELECT *, lag(ok) OVER (PARTITION BY list ORDER BY r) AS q FROM o)) SELECT list, r FROM p WHERE EXISTS (SELECT 1 FROM p x WHERE x.list = p.list AND x.part = p.part AND x.seed AND x.ok)")
def w22(spark, d):
    o = views.rows(spark, d).select("list", "r", ((F.size(F.filter("cells", lambda c: c != "F")) >= 2) & ((F.col("list") + F.col("r")) % 4 != 1)).alias("ok"), (F.get("cells", 0) == "N").alias("seed"))
    return layout.full_row_island(o, "list", "seed")


COVER = "f AS (SELECT *, max(b) OVER (PARTITION BY frame, axis ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM segments), p AS (SELECT *, sum(CASE WHEN far IS NULL OR a > far THEN 1 ELSE 0 END) OVER (PARTITION BY frame, axis ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS part FROM f), m AS (SELECT frame, axis, min(a) AS start, max(b) AS stop FROM p GROUP BY frame, axis, part)"


@query("W23_free_spans", "segments", f"{COVER}, g AS (SELECT frame, axis, coalesce(lag(stop) OVER (PARTITION BY frame, axis ORDER BY start), 0) AS start, start AS stop FROM m UNION ALL SELECT frame, axis, max(stop), 560 FROM m GROUP BY frame, axis) SELECT frame, axis, start, stop AS \"end\" FROM g WHERE stop - start >= 20")
def w23(spark, d):
    return layout.free_spans(views.segments(spark, d), ["frame", "axis"], 0, 560, 20)


@query("W24_merge_runs")
def w24(spark, d):
    return layout.merged_runs(views.segments(spark, d), "frame")


@query("W25_one_table", "words", "r AS (SELECT doc, line, bool_or(x1 <= 250) AS l, bool_or(x0 >= 250) AS r FROM words GROUP BY ALL) SELECT doc, count(*) FILTER (l AND r) >= 5 AND count(*) FILTER (l AND r) >= 0.6 * least(count(*) FILTER (l), count(*) FILTER (r)) AS together FROM r GROUP BY doc")
def w25(spark, d):
    return layout.one_table(views.words(spark, d), "doc", 250)


@query("W26_residual_tiles", "rects", "e AS (SELECT DISTINCT frame, y FROM (SELECT frame, y0 AS y FROM rects UNION ALL SELECT frame, y1 FROM rects)), bd AS (SELECT * FROM (SELECT frame, y AS y0, lead(y) OVER (PARTITION BY frame ORDER BY y) AS y1 FROM e) WHERE y1 IS NOT NULL), s AS (SELECT b.frame, b.y0, b.y1, r.x0 AS a, r.x1 AS b FROM bd b JOIN rects r ON b.frame = r.frame AND r.y0 < b.y1 AND r.y1 > b.y0), f AS (SELECT *, max(b) OVER (PARTITION BY frame, y0, y1 ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s), p AS (SELECT *, sum(CASE WHEN far IS NULL OR a > far THEN 1 ELSE 0 END) OVER (PARTITION BY frame, y0, y1 ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS part FROM f), m AS (SELECT frame, y0, y1, min(a) AS start, max(b) AS stop FROM p GROUP BY frame, y0, y1, part), g AS (SELECT frame, y0, y1, coalesce(lag(stop) OVER (PARTITION BY frame, y0, y1 ORDER BY start), 0) AS x0, start AS x1 FROM m UNION ALL SELECT frame, y0, y1, max(stop), 2600 FROM m GROUP BY frame, y0, y1) SELECT frame, y0, y1, x0, x1 FROM g WHERE x1 - x0 >= 1")
def w26(spark, d):
    return layout.uncovered_tiles(views.rects(spark, d), "frame", 2600)


@query("W27_prompt", "lines", r"t AS (SELECT doc, text, regexp_replace(lower(split_part(trim(text), ' ', 1)), '[^a-z0-9]', '', 'g') AS p FROM lines), n AS (SELECT doc, p, count(*) AS n, bool_and(contains(text, '%')) AS m0, bool_and(contains(text, '$')) AS m1, bool_and(contains(text, '>')) AS m2, bool_and(contains(text, '#')) AS m3 FROM t WHERE length(p) >= 3 GROUP BY doc, p HAVING count(*) >= 2), b AS (SELECT doc, max(struct_pack(n := n, l := length(p), p := p, m0 := m0, m1 := m1, m2 := m2, m3 := m3)) AS b FROM n GROUP BY doc) SELECT doc, b.p AS prompt, b.n AS n, CASE WHEN b.m0 THEN '%' WHEN b.m1 THEN '$' WHEN b.m2 THEN '>' WHEN b.m3 THEN '#' END AS marker FROM b")
def w27(spark, d):
    return layout.prompts(views.lines(spark, d), "doc")


@query("W28_first_said", "lines", "SELECT doc, line, CASE WHEN row_number() OVER w > 1 THEN first_value(doc) OVER w END AS same_as FROM lines WHERE text <> '' WINDOW w AS (PARTITION BY text ORDER BY doc, line)")
def w28(spark, d):
    return layout.first_said(views.lines(spark, d).where("text <> ''"), ["text"], ["doc", "line"]).select("doc", "line", "same_as")


@query("W29_newly_readable", "chat", "w AS (SELECT video, ts, list_filter(string_split(string_agg(said, ' ' ORDER BY seq), ' '), lambda x: x <> '') AS words FROM chat GROUP BY video, ts), b AS (SELECT *, list_transform(coalesce(lag(words) OVER (PARTITION BY video ORDER BY ts), []), lambda x: lower(x)) AS b FROM w) SELECT video, ts, list_filter(list_transform(list_filter(range(1, len(words) + 1), lambda i: list_position(words, words[i]) = i), lambda i: words[i]), lambda x: NOT list_contains(b, lower(x))) AS newly FROM b")
def w29(spark, d):
    w = views.chat(spark, d).groupBy("video", "ts").agg(F.filter(F.split(layout.ordered_text("seq", "said"), " "), lambda x: x != "").alias("words"))
    return layout.newly_readable(w, "video", "ts")


@query("W30_equal_states", "lines", "s AS (SELECT doc % 20 AS win, doc, count(*) // 8 AS sig FROM lines GROUP BY doc), r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> sig THEN 1 ELSE 0 END) OVER (PARTITION BY win ORDER BY doc) AS run FROM (SELECT *, lag(sig) OVER (PARTITION BY win ORDER BY doc) AS p FROM s)) SELECT win, sig, min(doc) AS first, max(doc) AS last, count(*) AS n FROM r GROUP BY win, run, sig")
def w30(spark, d):
    s = views.lines(spark, d).groupBy("doc").agg(F.floor(F.count(F.lit(1)) / 8).alias("sig")).withColumn("win", F.col("doc") % 20)
    return layout.event_runs(s, "win", ["doc"], "sig")


@query("W30b_window_states")
def w30b(spark, d):
    return states.window_states(views.chat(spark, d))


@query("W31_event_log", "samples", "r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> call THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY t, seq) AS run FROM (SELECT *, lag(call) OVER (PARTITION BY video ORDER BY t, seq) AS p FROM samples)) SELECT video, call, min(t) AS first, max(t) AS last, count(*) AS n FROM r GROUP BY video, run, call")
def w31(spark, d):
    return layout.event_runs(views.samples(spark, d), "video", ["t", "seq"], "call")


@query("W32_built_states")
def w32(spark, d):
    return states.built_states(views.chat(spark, d))


@query("W33_screen_spans", "samples", "k AS (SELECT video, t // 43200 AS span, string_agg(DISTINCT call, '+' ORDER BY call) AS held FROM samples GROUP BY ALL), r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> held THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY span) AS run FROM (SELECT *, lag(held) OVER (PARTITION BY video ORDER BY span) AS p FROM k)) SELECT video, held, min(span) AS first, max(span) AS last, count(*) AS n FROM r GROUP BY video, run, held")
def w33(spark, d):
    k = views.samples(spark, d).groupBy("video", F.floor(F.col("t") / 43200).alias("span")).agg(F.array_join(F.array_sort(F.collect_set("call")), "+").alias("held"))
    return layout.event_runs(k, "video", ["span"], "held")


@query("W34_settled_rects", "rects", "r AS (SELECT frame // 20 AS win, frame % 20 AS i, x0, y0, x1, y1, id = 1 AND frame % 3 = 0 AS measured FROM rects WHERE id = 1), h AS (SELECT a.win, a.i, min(struct_pack(o := b.i, x0 := b.x0, y0 := b.y0, x1 := b.x1, y1 := b.y1)) AS m FROM r a JOIN r b ON a.win = b.win AND NOT a.measured AND abs(a.i - b.i) <= 10 AND b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1 AND (b.x1 - b.x0) * (b.y1 - b.y0) > (a.x1 - a.x0) * (a.y1 - a.y0) AND CAST(abs(a.x0 - b.x0) <= 0.3 * 1920 AS INT) + CAST(abs(a.x1 - b.x1) <= 0.3 * 1920 AS INT) + CAST(abs(a.y0 - b.y0) <= 0.3 * 1080 AS INT) + CAST(abs(a.y1 - b.y1) <= 0.3 * 1080 AS INT) >= 3 GROUP BY a.win, a.i) SELECT r.win, r.i, coalesce(m.x0, r.x0) AS x0, coalesce(m.y0, r.y0) AS y0, coalesce(m.x1, r.x1) AS x1, coalesce(m.y1, r.y1) AS y1 FROM r LEFT JOIN h ON r.win = h.win AND r.i = h.i")
def w34(spark, d):
    r = views.rects(spark, d).where("id = 1").select(F.floor(F.col("frame") / 20).alias("win"), (F.col("frame") % 20).alias("i"), "x0", "y0", "x1", "y1", (F.col("frame") % 3 == 0).alias("measured"))
    return layout.settled_rects(r, "win", "i", reach=10, share=0.3)


@query("W35_ordered_merge", "frows", "o AS (SELECT list, cells[3] AS name, min(r) AS o FROM frows WHERE r <= 4 GROUP BY ALL), n AS (SELECT list, cells[3] AS name, min(r) AS n FROM frows WHERE r >= 3 OR r = 1 GROUP BY ALL), b AS (SELECT n.list, n.name, n.n, o.o, last_value(o.o IGNORE NULLS) OVER (PARTITION BY n.list ORDER BY n.n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor, max(o.o) OVER (PARTITION BY n.list) AS hi, min(o.o) OVER (PARTITION BY n.list) AS lo FROM n LEFT JOIN o ON n.list = o.list AND n.name = o.name), t AS (SELECT list, max(o) AS top FROM o GROUP BY list), u AS (SELECT list, name, o AS a, 0 AS side, 0 AS b FROM o UNION ALL SELECT b.list, name, CASE WHEN hi IS NULL THEN coalesce(top, 0) ELSE coalesce(anchor, lo - 1) END, 1, n FROM b LEFT JOIN t ON b.list = t.list WHERE o IS NULL) SELECT list, name, row_number() OVER (PARTITION BY list ORDER BY a, side, b) - 1 AS at FROM u")
def w35(spark, d):
    r = views.rows(spark, d).select("list", F.get("cells", 2).alias("name"), "r")
    one = lambda w: r.where(w).groupBy("list", "name").agg(F.min("r").cast("long").alias("pos"))
    return layout.merged_order(one("r <= 4"), one("r >= 3 or r = 1"), "list")


CRUMB = "c AS (SELECT page_id, crumb FROM (SELECT page_id, unnest(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS crumb FROM pages) WHERE crumb <> '')"


@query("W36_unglue", "", f"{CRUMB}, k AS (SELECT DISTINCT crumb FROM c WHERE length(crumb) >= 3), x AS (SELECT page_id, crumb || tail AS crumb FROM c, (SELECT unnest(['com', 'net']) AS tail)), e AS (SELECT x.page_id, x.crumb, n, substr(x.crumb, n + 1) AS r FROM (SELECT *, unnest(range(2, greatest(2, length(crumb) - 3) + 1)) AS n FROM (SELECT DISTINCT * FROM x)) x WHERE n <= length(x.crumb) - 3), m AS (SELECT page_id, crumb, min(n) AS n FROM e WHERE r IN (SELECT crumb FROM k UNION SELECT 'net') GROUP BY ALL) SELECT page_id, crumb, substr(crumb, 1, n) AS \"left\", substr(crumb, n + 1) AS \"right\" FROM m")
def w36(spark, d):
    c = views.pages(spark, d).select("page_id", F.explode(F.split(F.regexp_replace("url", "[?#].*$", ""), "/")).alias("crumb")).where("crumb <> ''")
    glued = c.withColumn("tail", F.explode(F.array(F.lit("com"), F.lit("net")))).select("page_id", F.concat("crumb", "tail").alias("crumb")).distinct()
    return layout.unglued(glued, c.select("crumb").union(spark.range(1).select(F.lit("net").alias("crumb"))), "page_id")


@query("W36b_mended_paths")
def w36b(spark, d):
    """Each page's path as read with every third crumb lost, and whole, by site."""
    p = views.pages(spark, d).select("page_id", F.filter(F.split(F.regexp_replace("url", "[?#].*$", ""), "/"), lambda c: c != "").alias("path"))
    lost = p.select("page_id", F.lit(1).alias("turn"), F.filter("path", lambda c, i: i % 3 != 1).alias("path"))
    return layout.mended_paths(p.select("page_id", F.lit(0).alias("turn"), F.slice("path", 1, 3).alias("path")).unionByName(lost), "page_id", "turn")


@query("W37b_bar_generations", "samples", """r AS (SELECT video, t, seq, string_split(CASE WHEN seq % 5 < 3 THEN app || ' File Edit' ELSE app || ' View' END, ' ') AS bar FROM samples WHERE seq % 7 > 0), g AS (SELECT *, CASE WHEN bar[1] = lag(bar[1]) OVER (PARTITION BY video ORDER BY t, seq) THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS generation FROM g)
SELECT video, CAST(generation AS BIGINT) AS generation, min(seq) AS first, list_sort(list_distinct(flatten(list(bar)))) AS words FROM n GROUP BY video, generation""")
def w37b(spark, d):
    bar = F.split(F.when(F.col("seq") % 5 < 3, F.concat("app", F.lit(" File Edit"))).otherwise(F.concat("app", F.lit(" View"))), " ")
    s = views.samples(spark, d).select("video", "t", "seq", F.when(F.col("seq") % 7 > 0, bar).otherwise(F.array().cast("array<string>")).alias("bar"))
    return layout.bar_generations(s, "video", ["t", "seq"])


@query("W37_carry_forward", "samples", "SELECT video, seq, last_value(CASE WHEN boxes % 5 = 0 THEN app END IGNORE NULLS) OVER (PARTITION BY video ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM samples")
def w37(spark, d):
    s = views.samples(spark, d).withColumn("clock", F.when(F.col("boxes") % 5 == 0, F.col("app")))
    return layout.carried(s, "video", ["t", "seq"], "clock").select("video", "seq", "held")


@query("W38_nearest_level", "words", "SELECT doc, line, k, arg_min(i, [abs(v - (x1 - x0) / 40.0), i]) AS level FROM words, (SELECT unnest([1.0, 1.3, 1.7, 2.2]) AS v, unnest([0, 1, 2, 3]) AS i) GROUP BY doc, line, k".replace("[abs(v - (x1 - x0) / 40.0), i]", "abs(v - (x1 - x0) / 40.0) * 1000000 + i"))
def w38(spark, d):
    return views.words(spark, d).select("doc", "line", "k", layout.nearest_level((F.col("x1") - F.col("x0")) / 40.0, [1.0, 1.3, 1.7, 2.2]).alias("level"))


@query("W39_report_smells", "lines", "m AS (SELECT doc, line, CASE WHEN line % 6 = 0 THEN 'PANE ' || text WHEN line % 6 = 1 THEN '```' WHEN doc % 3 = 0 THEN text || '?' ELSE text END AS text FROM lines), b AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^(PANE|WINDOW|MOMENT)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line) AS block FROM m), g AS (SELECT doc, block, count(*) AS n, count(*) FILTER (contains(text, '?')) AS doubt, bool_or(regexp_matches(text, '[Ѐ-ӿ一-鿿぀-ヿ]')) AS odd, bool_or(text = '```') AS fence FROM b GROUP BY ALL) SELECT doc, block, 'all unsettled' AS smell FROM g WHERE n >= 4 AND doubt * 2 > n UNION ALL SELECT doc, block, 'odd script' FROM g WHERE odd UNION ALL SELECT doc, block, 'bare fence' FROM g WHERE fence")
def w39(spark, d):
    t = F.when(F.col("line") % 6 == 0, F.concat(F.lit("PANE "), "text")).when(F.col("line") % 6 == 1, "```").when(F.col("doc") % 3 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return layout.report_smells(views.lines(spark, d).withColumn("text", t), "doc", "line")


@query("W40_restored_heading", "frows", "l AS (SELECT list, list(array_to_string(cells, '|') ORDER BY r) AS rs FROM frows WHERE r > 1 GROUP BY list), h AS (SELECT list, CASE WHEN list % 5 = 0 THEN '1/2' ELSE cells[1] END || '|' || cells[2] || '|' || cells[3] AS head FROM frows WHERE r = 1) SELECT l.list, CASE WHEN l.list % 2 = 0 AND l.list % 5 <> 0 THEN list_concat([head], rs) ELSE rs END AS body FROM l JOIN h ON l.list = h.list")
def w40(spark, d):
    r = views.rows(spark, d)
    body = r.where("r > 1").groupBy("list").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "cells"))), lambda x: x["cells"]).alias("rows"))
    head = r.where("r = 1").select("list", F.concat(F.array(F.when(F.col("list") % 5 == 0, "1/2").otherwise(F.get("cells", 0))), F.slice("cells", 2, 2)).alias("head"))
    out = layout.restored_heading(F.col("head"), F.col("rows"), F.col("list") % 2 == 0)
    return body.join(head, "list").select("list", F.transform(out, lambda c: F.array_join(c, "|")).alias("body"))


@query("W41_loose_table", "words", "h AS (SELECT doc, x0, k AS col FROM words WHERE line = 0 AND k < 5), i AS (SELECT * FROM words WHERE line > 0), c AS (SELECT i.doc, i.line, i.k, i.text, arg_max(h.col, h.x0) AS col FROM i JOIN h ON i.doc = h.doc AND h.x0 <= i.x0 + 14 GROUP BY ALL) SELECT doc, line, col, string_agg(text, ' ' ORDER BY k) AS text FROM c GROUP BY doc, line, col")
def w41(spark, d):
    w = views.words(spark, d)
    return layout.loose_table(w.where("line > 0"), w.where("line = 0 and k < 5").select("doc", "x0", F.col("k").cast("long").alias("col")), "doc")


@query("W42_items", "words frows", "i AS (SELECT doc AS pane, 'loose' AS role, line AS r, k AS c, text, x1 FROM words WHERE doc % 2 = 0 UNION ALL SELECT list, 'cell', r, unnest([0, 1, 2]), unnest(cells), NULL FROM frows WHERE list % 2 = 1), m AS (SELECT pane, role, max(x1) AS w FROM i GROUP BY ALL) SELECT i.pane, i.role, i.r, i.c, i.text, round(CASE WHEN w / 600.0 > 1.2 THEN i.x1 / (w / 600.0) ELSE i.x1 END, 6) AS x1 FROM i JOIN m ON i.pane = m.pane AND i.role = m.role")
def w42(spark, d):
    loose = views.words(spark, d).where("doc % 2 = 0").select(F.col("doc").alias("pane"), F.lit("loose").alias("role"), F.col("line").alias("r"), F.col("k").alias("c"), "text", "x1")
    cells = views.rows(spark, d).where("list % 2 = 1").select(F.col("list").alias("pane"), F.lit("cell").alias("role"), "r", F.posexplode("cells").alias("c", "text"), F.lit(None).cast("long").alias("x1"))
    items = loose.unionByName(cells)
    wide = F.max("x1").over(Window.partitionBy("pane", "role")) / 600.0
    return items.withColumn("x1", F.round(F.when(wide > 1.2, F.col("x1") / wide).otherwise(F.col("x1")), 6))

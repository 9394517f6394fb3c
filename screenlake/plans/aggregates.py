"""Queries of aggregations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from screenlake.functions import strings as fs
from screenlake.operators import votes
from screenlake.plans.registry import query
from screenlake.plans.texts import LOOK, flat
from screenlake.sources import views

LET = "regexp_replace({0}, '[^A-Za-z0-9]', '', 'g')"


@query("A01_consensus", "names", f"""r AS (SELECT seen_at AS entity, reading, key AS seq FROM names WHERE key % 4 <> 3), n AS (SELECT entity, reading, count(*) AS n, min(seq) AS first, contains(reading, '…') AS cut FROM r GROUP BY ALL),
g AS (SELECT c.entity, c.reading AS short, c.n AS more, arg_max(w.reading, [w.n, -w.first]) AS reading FROM n c JOIN n w ON c.entity = w.entity AND c.cut AND NOT w.cut AND length(w.reading) > length(trim(split_part(c.reading, '…', 1))) + length(trim(split_part(c.reading, '…', 2))) AND starts_with(w.reading, trim(split_part(c.reading, '…', 1))) AND ends_with(w.reading, trim(split_part(c.reading, '…', 2))) GROUP BY ALL),
t AS (SELECT n.entity, n.reading, CAST(n.n + coalesce((SELECT sum(more) FROM g WHERE g.entity = n.entity AND g.reading = n.reading), 0) AS BIGINT) AS n, first FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.entity = n.entity AND g.short = n.reading)),
k AS (SELECT *, row_number() OVER w AS turn, first_value(reading) OVER w AS top, lead(n) OVER w AS second FROM t WINDOW w AS (PARTITION BY entity ORDER BY n DESC, first)),
l AS (SELECT *, {LET.format('reading')} AS lr, {LET.format('top')} AS lt FROM k),
o AS (SELECT entity, max(top) AS name, count(*) AS left_over, bool_and(reading = top OR ({LOOK.format('lr', 'lt')})) AS alike, max(n) FILTER (turn = 1) AS votes, max(second) FILTER (turn = 1) AS nxt FROM l GROUP BY entity)
SELECT entity, name, CASE WHEN left_over = 1 THEN 'agreed' WHEN alike THEN 'ambiguous-glyph' WHEN votes > nxt THEN 'consensus' ELSE 'disputed' END AS status, votes FROM o""")
def a01(spark, d):
    return votes.consensus(views.names(spark, d).where("key % 4 <> 3").select(F.col("seen_at").alias("entity"), "reading", F.col("key").alias("seq")))


@query("A02_merge_list", "names", f"""r AS (SELECT seen_at AS list, key % 10 AS frame, reading AS name, CASE WHEN key % 3 = 0 THEN '' ELSE CAST(key % 7 AS VARCHAR) END AS col2, CAST(key % 2 AS VARCHAR) AS col3 FROM names), b AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY list, frame) AS c FROM r) WHERE c >= 2),
e AS (SELECT *, {flat('name')} AS e FROM b), v1 AS (SELECT list, e, name AS v, count(*) AS n FROM e GROUP BY ALL), v2 AS (SELECT list, e, col2 AS v, count(*) AS n FROM e WHERE col2 <> '' GROUP BY ALL), v3 AS (SELECT list, e, col3 AS v, count(*) AS n FROM e GROUP BY ALL)
SELECT list, name, col2, col3, seen, "full" FROM (SELECT list, e, count(*) AS seen, count(*) FILTER (NOT contains(name, '…')) AS "full" FROM e GROUP BY list, e) s
 LEFT JOIN (SELECT list, e, max(struct_pack(n := n, v := v)).v AS name FROM v1 GROUP BY ALL) USING (list, e) LEFT JOIN (SELECT list, e, max(struct_pack(n := n, v := v)).v AS col2 FROM v2 GROUP BY ALL) USING (list, e) LEFT JOIN (SELECT list, e, max(struct_pack(n := n, v := v)).v AS col3 FROM v3 GROUP BY ALL) USING (list, e)""")
def a02(spark, d):
    k = F.col("key")
    r = views.names(spark, d).select(F.col("seen_at").alias("list"), (k % 10).alias("frame"), F.col("reading").alias("name"), F.when(k % 3 == 0, "").otherwise((k % 7).cast("string")).alias("col2"), (k % 2).cast("string").alias("col3"))
    return votes.merged_list(r, "list", least=2)


@query("A03_medoid", "names", "r AS (SELECT key // 10 AS entity, key AS rid, name AS reading FROM names), s AS (SELECT a.entity, a.rid, a.reading, sum(1 - levenshtein(a.reading, b.reading) / greatest(length(a.reading), length(b.reading), 1)) + max(length(a.reading)) * 0.002 AS s FROM r a JOIN r b ON a.entity = b.entity AND a.rid <> b.rid GROUP BY a.entity, a.rid, a.reading) SELECT entity, max(struct_pack(s := round(s, 9), a := reading)).a AS medoid FROM s GROUP BY entity")
def a03(spark, d):
    return votes.medoid(views.names(spark, d).select(F.floor(F.col("key") / 10).alias("entity"), F.col("key").alias("rid"), F.col("name").alias("reading")), "entity")


@query("A03b_block_medoid")
def a03b(spark, d):
    r = views.names(spark, d).select(F.floor(F.col("key") / 10).alias("entity"), F.col("key").alias("rid"), "reading", (F.col("key") % 3 == 0).alias("marked"))
    return votes.medoid(r, "entity", fs.seq_ratio)


@query("A04_best_reading", "two", f"r AS (SELECT doc, a AS reading FROM two UNION ALL SELECT doc, b FROM two), s AS (SELECT doc, reading, length(reading) - length(replace(reading, '_', '')) AS u, length({flat('reading')}) AS n, length(reading) - length(replace(reading, '.', '')) AS d FROM r) SELECT doc, max(struct_pack(u := u, n := n, d := d, r := reading)).r AS best FROM s GROUP BY doc")
def a04(spark, d):
    t = views.two(spark, d)
    return votes.best_reading(t.select("doc", F.col("a").alias("reading")).union(t.select("doc", F.col("b").alias("reading"))), "doc")


@query("A05_coverage", "words", "p AS (SELECT doc, line, count(*) AS readings, count(*) FILTER (k % 4 = 0) AS in_structure, count(*) FILTER (k % 4 = 1) AS also, count(*) FILTER (k % 4 = 2) AS unconfirmed, count(*) FILTER (k % 4 = 3 AND line % 50 <> 7) AS video FROM words GROUP BY doc, line) SELECT doc, CAST(sum(readings) AS BIGINT) AS readings, CAST(sum(in_structure) AS BIGINT) AS in_structure, CAST(sum(also) AS BIGINT) AS also, CAST(sum(unconfirmed) AS BIGINT) AS unconfirmed, CAST(sum(video) AS BIGINT) AS video, bool_and(readings = in_structure + also + unconfirmed + video) AS holds FROM p GROUP BY doc")
def a05(spark, d):
    k = F.col("k") % 4
    p = views.words(spark, d).groupBy("doc", "line").agg(F.count(F.lit(1)).alias("readings"), F.count_if(k == 0).alias("in_structure"), F.count_if(k == 1).alias("also"), F.count_if(k == 2).alias("unconfirmed"), F.count_if((k == 3) & (F.col("line") % 50 != 7)).alias("video"))
    return votes.coverage(p, "doc")


@query("A06_cost_tally", "runs", "SELECT video, phase, round(sum(took), 6) AS seconds, count(*) AS n FROM runs GROUP BY ROLLUP (video, phase)")
def a06(spark, d):
    return votes.cost_tally(views.runs(spark, d), ["video", "phase"])


@query("A07_program_census", "samples", "SELECT video, app, count(*) AS sightings, count(DISTINCT boxes) AS bars, list_sort(list(DISTINCT call)) AS kinds FROM samples GROUP BY video, app")
def a07(spark, d):
    return views.samples(spark, d).groupBy("video", "app").agg(F.count(F.lit(1)).alias("sightings"), F.count_distinct("boxes").alias("bars"), F.array_sort(F.collect_set("call")).alias("kinds"))


@query("A08_screen_kinds", "samples", "k AS (SELECT video, t // 86400 AS day, string_agg(DISTINCT app, '+' ORDER BY app) AS kinds, min(seq) AS seq FROM samples GROUP BY ALL) SELECT kinds, arg_min(video, seq) AS video, arg_min(day, seq) AS day FROM k GROUP BY kinds")
def a08(spark, d):
    k = views.samples(spark, d).groupBy("video", F.floor(F.col("t") / 86400).alias("day")).agg(F.array_join(F.array_sort(F.collect_set("app")), "+").alias("kinds"), F.min("seq").alias("seq"))
    return k.groupBy("kinds").agg(F.min_by("video", "seq").alias("video"), F.min_by("day", "seq").alias("day"))


@query("A09_windows_seen", "lines", "SELECT text AS words, min(doc) AS first, string_agg(doc || ':' || line, ',' ORDER BY doc, line) AS stamps FROM lines WHERE length(text) > 20 GROUP BY text")
def a09(spark, d):
    g = views.lines(spark, d).where("length(text) > 20").groupBy(F.col("text").alias("words"))
    stamps = F.transform(F.array_sort(F.collect_list(F.struct("doc", "line"))), lambda s: F.concat_ws(":", s["doc"].cast("string"), s["line"].cast("string")))
    return g.agg(F.min("doc").alias("first"), F.array_join(stamps, ",").alias("stamps"))


@query("A10_backed_share", "two", "SELECT doc, round(sum(CASE WHEN a = b THEN length(a) ELSE 0 END) / greatest(sum(length(a)), 1), 9) AS share, sum(CASE WHEN a = b THEN length(a) ELSE 0 END) >= 2.0 / 3 * sum(length(a)) AS backed FROM two GROUP BY doc")
def a10(spark, d):
    return votes.backed_share(views.two(spark, d).select("doc", F.length("a").alias("chars"), F.when(F.col("a") == F.col("b"), F.length("a")).otherwise(0).alias("backed")), "doc")


GAPS = "g AS (SELECT *, lead(x0) OVER (PARTITION BY doc, line ORDER BY k) - x1 AS gap FROM words)"


@query("A11_space_width", "words", f"{GAPS} SELECT doc, coalesce(median(CASE WHEN gap > 0 THEN gap END), 6.0) AS space FROM g GROUP BY doc")
def a11(spark, d):
    return votes.space_width(views.words(spark, d), "doc", "line")


@query("A12_advance", "words", "w AS (SELECT doc, (x1 - x0 + (doc + k) % 7) / length(text) AS a FROM words WHERE length(text) >= 3), m AS (SELECT doc, median(a) AS m FROM w GROUP BY doc HAVING count(*) >= 8), s AS (SELECT w.doc, round(any_value(m), 9) AS advance, round(median(abs(a - m)) / any_value(m), 9) AS spread FROM w JOIN m ON w.doc = m.doc GROUP BY w.doc) SELECT doc, advance, spread, spread <= 0.04 AS monospace FROM s")
def a12(spark, d):
    w = views.words(spark, d).withColumn("x1", F.col("x1") + (F.col("doc") + F.col("k")) % 7)
    return votes.advance(w, "doc")


@query("A13_line_pitch", "words", "l AS (SELECT DISTINCT doc, y0 FROM words), g AS (SELECT doc, lead(y0) OVER (PARTITION BY doc ORDER BY y0) - y0 AS g FROM l), p AS (SELECT doc, min(g) AS pitch FROM g WHERE g > 0 GROUP BY doc), o AS (SELECT g.doc, pitch, round(median(abs(g / pitch - round_even(g / pitch, 0))), 9) AS off FROM g JOIN p ON g.doc = p.doc WHERE g > 0 GROUP BY g.doc, pitch) SELECT doc, pitch, off, off <= 0.10 AS regular FROM o")
def a13(spark, d):
    return votes.line_pitch(views.words(spark, d).select("doc", "y0").distinct(), "doc", "y0")


STEP = "d AS (SELECT video, abs(level - lag(level) OVER (PARTITION BY video ORDER BY t, seq)) AS d FROM samples)"


@query("A14_quiet_floor", "samples", f"{STEP}, f AS (SELECT video, quantile_cont(d, 0.05) AS f, count(d) AS n FROM d WHERE d IS NOT NULL GROUP BY video) SELECT video, round(CASE WHEN n + 1 >= 12 THEN f END, 9) AS floor, round(CASE WHEN n + 1 >= 12 THEN greatest(4.0, 2.5 * f) ELSE 4.0 END, 9) AS line FROM f")
def a14(spark, d):
    return votes.quiet_floor(views.samples(spark, d), "video")


@query("A15_median_frame", "thumbs", "p AS (SELECT burst, generate_subscripts(thumb, 1) AS pos, unnest(thumb) AS v FROM thumbs), m AS (SELECT burst, pos, CAST(floor(quantile_cont(v, 0.5)) AS BIGINT) AS m FROM p GROUP BY burst, pos) SELECT burst, list(m ORDER BY pos) AS thumb FROM m GROUP BY burst")
def a15(spark, d):
    return votes.median_frame(views.thumbs(spark, d), "burst")


TIES = "q AS (SELECT frame, burst, list_transform(thumb, lambda v: v // 32) AS t FROM thumbs), e AS (SELECT frame, burst, i, CASE WHEN i % 8 = 7 OR i >= 56 THEN 0 WHEN t[i + 1] = t[i + 2] AND t[i + 1] = t[i + 9] THEN 1 ELSE 0 END AS tie FROM q, range(0, 64) r(i)), c AS (SELECT frame, burst, (i // 8) // 4 * 4 + i % 8 // 2 AS cell, avg(tie) AS score FROM e GROUP BY ALL)"


def quarter(spark, d):
    return views.thumbs(spark, d).withColumn("thumb", F.transform("thumb", lambda v: F.floor(v / 32)))


@query("A16_tie_map", "thumbs", f"{TIES} SELECT frame, CAST(cell AS BIGINT) AS cell, score FROM c")
def a16(spark, d):
    return votes.cell_scores(quarter(spark, d), "frame", 8, 8, 2, 4)


@query("A17_moving_cells", "thumbs", "b AS (SELECT *, lag(thumb) OVER (PARTITION BY burst ORDER BY frame) AS b FROM thumbs), p AS (SELECT burst, frame, i, abs(thumb[i + 1] - b[i + 1]) AS d FROM b, range(0, 64) r(i) WHERE b IS NOT NULL), c AS (SELECT burst, frame, (i // 8) // 4 * 4 + i % 8 // 2 AS cell, avg(d) AS d FROM p GROUP BY ALL) SELECT burst, CAST(cell AS BIGINT) AS cell, avg(CASE WHEN d > 18.0 THEN 1 ELSE 0 END) >= 0.5 AS moving FROM c GROUP BY burst, cell")
def a17(spark, d):
    return votes.moving_cells(views.thumbs(spark, d), "burst", "frame", 8, 2, 4, step=18.0)


@query("A18_moving_zones", "thumbs", """b AS (SELECT *, lag(thumb) OVER (PARTITION BY burst ORDER BY frame) AS b FROM thumbs), p AS (SELECT burst, i, abs(thumb[i + 1] - b[i + 1]) AS d FROM b, range(0, 64) r(i) WHERE b IS NOT NULL),
m AS (SELECT burst, i AS pos FROM p GROUP BY burst, i HAVING avg(CASE WHEN d > 22 THEN 1 ELSE 0 END) >= 0.5), f AS (SELECT burst FROM m GROUP BY burst HAVING count(*) <= 0.5 * 64), t AS (SELECT * FROM m SEMI JOIN f ON m.burst = f.burst),
k AS (WITH RECURSIVE r(burst, pos, n) AS (SELECT burst, pos, pos FROM t UNION SELECT r.burst, r.pos, y.pos FROM r JOIN t y ON y.burst = r.burst AND abs(y.pos % 8 - r.n % 8) + abs(y.pos // 8 - r.n // 8) = 1) SELECT burst, pos, min(n) AS c FROM r GROUP BY burst, pos)
SELECT burst, min(pos % 8) AS x0, min(pos // 8) AS y0, max(pos % 8) + 1 AS x1, max(pos // 8) + 1 AS y1 FROM k GROUP BY burst, c""")
def a18(spark, d):
    return votes.moving_zones(views.thumbs(spark, d), "burst", "frame", 8, 8, pixel=22, most=0.5)


@query("A19_standing_text", "thumbs", "b AS (SELECT *, lag(thumb) OVER (PARTITION BY burst ORDER BY frame) AS b FROM thumbs), p AS (SELECT burst, frame % 3 AS look, i % 2 = 0 AS glyph, abs(thumb[i + 1] - b[i + 1]) AS d FROM b, range(0, 64) r(i) WHERE b IS NOT NULL), l AS (SELECT burst, look, median(CASE WHEN glyph THEN d END) AS g, median(CASE WHEN NOT glyph THEN d END) AS n FROM p GROUP BY ALL) SELECT burst, bool_and(coalesce(g <= 1.0 * n, false)) AS standing FROM l GROUP BY burst")
def a19(spark, d):
    b = views.thumbs(spark, d).withColumn("_b", F.lag("thumb").over(Window.partitionBy("burst").orderBy("frame"))).where("_b is not null")
    p = b.select("burst", (F.col("frame") % 3).alias("look"), F.posexplode(F.zip_with("thumb", "_b", lambda x, y: F.abs(x - y))).alias("pos", "change")).withColumn("glyph", F.col("pos") % 2 == 0)
    return votes.standing_text(p, "burst", still=1.0)


@query("A20_rendered_block", "thumbs", f"{TIES}, s AS (SELECT burst, frame % 4 AS block, avg(score) AS s FROM c GROUP BY ALL) SELECT burst, round(max(s), 9) AS best, round(max(s), 9) >= 0.2 AS rendered FROM s GROUP BY burst")
def a20(spark, d):
    q = quarter(spark, d)
    cells = votes.cell_scores(q, "frame", 8, 8, 2, 4).join(q.select("frame", "burst"), "frame").withColumn("block", F.col("frame") % 4)
    return votes.rendered_block(cells, "burst", least=0.2)


@query("A21_theme", "thumbs", "m AS (SELECT burst, frame, median(v) AS m FROM (SELECT burst, frame, unnest(thumb) AS v FROM thumbs) GROUP BY ALL), v AS (SELECT burst, CASE WHEN m < 128 THEN 'dark' ELSE 'light' END AS theme, count(*) AS votes FROM m GROUP BY ALL) SELECT burst, max(struct_pack(v := votes, t := theme)).t AS theme, max(votes) AS votes FROM v GROUP BY burst")
def a21(spark, d):
    return votes.theme(views.thumbs(spark, d), "frame", "burst")


@query("A22_ink_match", "thumbs", "c AS (SELECT frame, i % 16 = 3 AS masked, thumb[i + 1] > 130 AS drawn, thumb[i + 1] + (frame + i) % 9 > 134 AS real_ FROM thumbs, range(0, 64) r(i)) SELECT frame, round(count(*) FILTER (drawn AND real_) / greatest(count(*) FILTER (drawn), 1), 9) AS \"precision\", round(count(*) FILTER (drawn AND real_) / greatest(count(*) FILTER (real_), 1), 9) AS coverage FROM c WHERE NOT masked GROUP BY frame")
def a22(spark, d):
    c = views.thumbs(spark, d).select("frame", F.posexplode("thumb").alias("i", "v"))
    return votes.ink_match(c.select("frame", (F.col("i") % 16 == 3).alias("masked"), (F.col("v") > 130).alias("drawn"), (F.col("v") + (F.col("frame") + F.col("i")) % 9 > 134).alias("real")), "frame")


TREE7 = "t AS (SELECT pos // 17 AS pane, * FROM tree)"


@query("A23_indent_fit", "tree", f"{TREE7}, f AS (SELECT pane, regr_slope(x0, depth) AS step, regr_intercept(x0, depth) AS base, median(y1 - y0) AS h FROM t GROUP BY pane), m AS (SELECT t.pane, base, step, max(abs(x0 - base - step * depth)) / any_value(h) AS miss FROM t JOIN f ON t.pane = f.pane GROUP BY t.pane, base, step) SELECT pane, round(base, 6) AS base, round(step, 6) AS step, round(miss, 6) AS miss, round(miss, 6) <= 1.5 AS straight FROM m WHERE base IS NOT NULL")
def a23(spark, d):
    return votes.indent_fit(views.tree(spark, d).withColumn("pane", F.floor(F.col("pos") / 17)), "pane").where("base is not null and not isnan(base)")


@query("A24_indent_step", "tree", f"{TREE7}, m AS (SELECT pane, depth, avg(x0) AS m FROM t GROUP BY ALL), s AS (SELECT pane, median(d) AS step FROM (SELECT pane, lead(m) OVER (PARTITION BY pane ORDER BY depth) - m AS d FROM m) GROUP BY pane), w AS (SELECT pane, median(w) AS wobble FROM (SELECT t.pane, t.depth, avg(abs(x0 - m)) AS w FROM t JOIN m ON t.pane = m.pane AND t.depth = m.depth GROUP BY ALL) GROUP BY pane) SELECT s.pane, round(step, 6) AS step, round(wobble, 6) AS wobble, step > wobble AS clear FROM s JOIN w ON s.pane = w.pane")
def a24(spark, d):
    return votes.indent_step(views.tree(spark, d).withColumn("pane", F.floor(F.col("pos") / 17)), "pane")


@query("A25_lattice", "tree", """t AS (SELECT pos // 17 AS pane, y0 + key % 3 AS y, length(name) AS width FROM tree), g AS (SELECT pane, g, count(*) AS n FROM (SELECT pane, lead(y) OVER (PARTITION BY pane ORDER BY y) - y AS g FROM t) WHERE g > 0 GROUP BY ALL),
p AS (SELECT pane, arg_max(g, [n, -g]) AS pitch FROM g GROUP BY pane), f AS (SELECT pane, min(y) AS first FROM t GROUP BY pane),
s AS (SELECT t.*, pitch, first, round_even((y - first) / pitch, 0) AS slot FROM t JOIN p ON t.pane = p.pane JOIN f ON t.pane = f.pane),
o AS (SELECT pane, slot, arg_max(y, [width, -y]) AS y FROM s WHERE abs(y - first - slot * pitch) <= 0.2 * pitch GROUP BY pane, slot),
j AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY pane ORDER BY slot) > 2 THEN 1 ELSE 0 END AS jump FROM o)
SELECT pane, CAST(slot AS BIGINT) AS slot, y FROM (SELECT *, sum(jump) OVER (PARTITION BY pane ORDER BY slot) AS part FROM j) WHERE part = 0""")
def a25(spark, d):
    t = views.tree(spark, d).select(F.floor(F.col("pos") / 17).alias("pane"), (F.col("y0") + F.col("key") % 3).alias("y"), F.length("name").alias("width"))
    return votes.lattice(t, "pane")


@query("A26_console_score")
def a26(spark, d):
    """Lines as a console shows them, twelve words a row, as two recognisers read them."""
    t = views.console(spark, d).withColumn("m", fs.matched_characters("a", "b"))
    return t.groupBy("doc").agg(F.sum("m").alias("matched"), F.sum(F.length("a")).alias("characters"), F.count_if(F.col("a") == F.col("b")).alias("exact"))


@query("A27_cell_accuracy", "frows", """t AS (SELECT list, r, i, cells[i] AS v FROM frows, range(1, 4) g(i)), p AS (SELECT list, r, i, CASE WHEN (list + r + i) % 6 = 0 THEN v || 'x' ELSE v END AS v FROM t WHERE (list + r) % 9 <> 0),
j AS (SELECT t.list, t.r, p.v IS NOT NULL AS found, coalesce(t.v = p.v, false) AS ok FROM t LEFT JOIN p ON t.list = p.list AND t.r = p.r AND t.i = p.i), w AS (SELECT list, r, bool_and(ok) AS whole, bool_or(found) AS found FROM j GROUP BY ALL)
SELECT c.list, cells, right_cells, rows_, right_rows FROM (SELECT list, count(*) AS cells, count(*) FILTER (ok) AS right_cells FROM j GROUP BY list) c JOIN (SELECT list, count(*) AS rows_, count(*) FILTER (whole) AS right_rows FROM w GROUP BY list) w ON c.list = w.list""")
def a27(spark, d):
    t = views.rows(spark, d).select("list", "r", F.posexplode("cells").alias("i", "v"))
    odd = (F.col("list") + F.col("r") + F.col("i") + 1) % 6 == 0
    p = t.where("(list + r) % 9 <> 0").select("list", "r", "i", F.when(odd, F.concat("v", F.lit("x"))).otherwise(F.col("v")).alias("p"))
    j = t.join(p, ["list", "r", "i"], "left").withColumn("ok", F.coalesce(F.col("v") == F.col("p"), F.lit(False)))
    per = j.groupBy("list", "r").agg(F.count(F.lit(1)).alias("c"), F.count_if("ok").alias("k"), F.bool_and("ok").alias("whole"))
    return per.groupBy("list").agg(F.sum("c").alias("cells"), F.sum("k").alias("right_cells"), F.count(F.lit(1)).alias("rows_"), F.count_if("whole").alias("right_rows"))


@query("A28_threshold_sweep", "labelled", "SELECT source, bar, count(*) FILTER (want = 1 AND boxes < bar) AS lost, count(*) FILTER (want <> 1 AND boxes >= bar) AS kept, count(*) FILTER ((want = 1) = (boxes >= bar)) AS \"right\" FROM labelled, (SELECT unnest([5, 10, 20, 40, 80]) AS bar) GROUP BY source, bar")
def a28(spark, d):
    return votes.sweep(views.labelled(spark, d), [5, 10, 20, 40, 80], "source")


@query("A29_parameter_sweep", "samples", f"""{STEP}, f AS (SELECT video, quantile_cont(d, 0.05) AS f, count(d) AS n FROM d WHERE d IS NOT NULL GROUP BY video), l AS (SELECT video, round(CASE WHEN n + 1 >= 12 THEN greatest(4.0, 2.5 * f) ELSE 4.0 END, 9) AS line FROM f),
q AS (SELECT s.*, times, line * times AS bound, row_number() OVER (PARTITION BY times, s.video ORDER BY t, seq) AS turn FROM samples s JOIN l ON s.video = l.video, (SELECT unnest([1.0, 2.0, 4.0]::DOUBLE[]) AS times)),
k AS (WITH RECURSIVE r(times, video, turn, call, anchor, run) AS (SELECT times, video, turn, call, level, 1 FROM q WHERE turn = 1 UNION ALL
 SELECT q.times, q.video, q.turn, q.call, CASE WHEN q.call <> r.call OR q.call = 'screen' AND abs(q.level - r.anchor) > q.bound THEN q.level ELSE r.anchor END, r.run + CASE WHEN q.call <> r.call OR q.call = 'screen' AND abs(q.level - r.anchor) > q.bound THEN 1 ELSE 0 END FROM r JOIN q ON q.times = r.times AND q.video = r.video AND q.turn = r.turn + 1) SELECT * FROM r)
SELECT video, CAST(max(run) AS BIGINT) AS stretches, times FROM k GROUP BY video, times""")
def a29(spark, d):
    from screenlake.operators.states import stretches

    s, out = views.samples(spark, d), None
    floor = votes.quiet_floor(s, "video").select("video", "line")
    for k in (1.0, 2.0, 4.0):
        n = stretches(s.join(floor, "video").withColumn("bound", F.col("line") * k)).groupBy("video").agg(F.count(F.lit(1)).alias("stretches")).withColumn("times", F.lit(k))
        out = n if out is None else out.union(n)
    return out


@query("A30_letter_swaps")
def a30(spark, d):
    return votes.letter_swaps(views.names(spark, d).select(F.col("name").alias("a"), F.col("reading").alias("b")))


SMELLS = {"odd script": "[Ѐ-ӿ一-鿿぀-ヿ]", "bare fence": "^```$", "long run": "[A-Za-z]{25}", "symbols": "[#$%&*]{2}"}


@query("A31_smell_tally", "lines", "s AS (" + " UNION ALL ".join(f"SELECT doc % 10 AS video, '{k}' AS kind FROM lines WHERE regexp_matches(text, '{v}')" for k, v in SMELLS.items()) + ") SELECT video, kind, count(*) AS n FROM s GROUP BY CUBE (video, kind)")
def a31(spark, d):
    found = F.filter(F.array(*(F.when(F.col("text").rlike(v), F.lit(k)) for k, v in SMELLS.items())), lambda k: k.isNotNull())
    return views.lines(spark, d).select((F.col("doc") % 10).alias("video"), F.explode(found).alias("kind")).cube("video", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("A32_modal_root", "", "p AS (SELECT page_id, page_id % 20 AS site, regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS root FROM pages), v AS (SELECT site, root, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT site, max(struct_pack(n := n, r := root)).r AS modal FROM v GROUP BY site HAVING sum(n) >= 3) SELECT page_id, p.site, root, modal FROM p JOIN m ON p.site = m.site WHERE root <> modal")
def a32(spark, d):
    p = views.pages(spark, d).select("page_id", (F.col("page_id") % 20).alias("site"), F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)", 1).alias("root"))
    m = p.groupBy("site", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("site").agg(F.max(F.struct("n", "root")).getField("root").alias("modal"), F.sum("n").alias("all")).where("all >= 3")
    return p.join(m, "site").where("root <> modal").select("page_id", "site", "root", "modal")


@query("A33_duplicate_blocks", "lines", "SELECT doc, left(text, 80) AS quote, count(*) AS n FROM lines WHERE length(text) >= 40 GROUP BY ALL HAVING count(*) > 1")
def a33(spark, d):
    return votes.duplicate_blocks(views.lines(spark, d), "doc")


@query("A34_label_agreement", "labelled", "v AS (SELECT source, CASE want WHEN 1 THEN 'screen' ELSE 'camera' END AS want, CASE WHEN boxes <= 20 THEN 'camera' WHEN boxes >= 40 THEN 'screen' ELSE 'uncertain' END AS verdict FROM labelled) SELECT source, count(*) FILTER (verdict = want) AS \"right\", count(*) FILTER (verdict <> want AND verdict <> 'uncertain') AS wrong, count(*) FILTER (verdict = 'uncertain') AS unsure FROM v GROUP BY ROLLUP (source)")
def a34(spark, d):
    v = views.labelled(spark, d).select("source", F.when(F.col("want") == 1, "screen").otherwise("camera").alias("want"), F.when(F.col("boxes") <= 20, "camera").when(F.col("boxes") >= 40, "screen").otherwise("uncertain").alias("verdict"))
    return votes.label_agreement(v, "source")


@query("A35_row_spacing", "words", "l AS (SELECT doc, line, min(y0) AS y0 FROM words GROUP BY ALL), g AS (SELECT doc, lead(y0) OVER (PARTITION BY doc ORDER BY y0) - y0 AS g FROM l), s AS (SELECT doc, list_sort(list(g)) AS a FROM g WHERE g > 0.6 * 14 GROUP BY doc) SELECT doc, a[len(a) // 2 + 1] AS spacing FROM s WHERE len(a) >= 3")
def a35(spark, d):
    return votes.row_spacing(views.words(spark, d).groupBy("doc", "line").agg(F.min("y0").alias("y0")), "doc", 14)

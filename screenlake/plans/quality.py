"""Queries of quality rules (Q01-Q07)."""

from pyspark.sql import functions as F

from screenlake.operators import quality
from screenlake.plans.joins import boxed, sql_boxes
from screenlake.plans.registry import query
from screenlake.plans.repair import PATHS, paths
from screenlake.sources import views


@query("Q01_note_rules", "", r"""x AS (SELECT page_id, html, len(regexp_extract_all(html, '<p></p>')) AS e, (SELECT count(DISTINCT r) FROM (SELECT unnest(regexp_extract_all(html, 'href="/([^"/]*)', 1)) AS r)) AS n FROM pages)
SELECT 'pasted image' AS rule, CAST(page_id AS VARCHAR) AS place, 'img' AS what FROM x WHERE regexp_matches(html, '<img |data:image') UNION ALL SELECT 'pasted style', CAST(page_id AS VARCHAR), 'style' FROM x WHERE contains(html, '<style>') UNION ALL SELECT 'loose bar', CAST(page_id AS VARCHAR), '|' FROM x WHERE contains(html, ' | ') UNION ALL SELECT 'empty rows', CAST(page_id AS VARCHAR), CAST(e AS VARCHAR) FROM x WHERE e >= 7 UNION ALL SELECT 'several roots', CAST(page_id AS VARCHAR), CAST(n AS VARCHAR) FROM x WHERE n > 5""")
def q01(spark, d):
    return quality.note_rules(views.pages(spark, d))


AREA = "(x1 - x0) * (y1 - y0)"


@query("Q02_picture_rules", "rects", f"""j AS (SELECT a.frame, a.id AS i, b.id AS k, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS s FROM rects a JOIN rects b ON a.frame = b.frame AND a.id <> b.id)
SELECT 'outside the screen' AS rule, CAST(frame AS VARCHAR) AS place, CAST(id AS VARCHAR) AS what FROM rects WHERE x1 > 2400 OR y1 > 1200 UNION ALL SELECT 'nothing filled', CAST(frame AS VARCHAR), '0' FROM rects GROUP BY frame HAVING count(*) FILTER (kind = 'window') = 0 UNION ALL SELECT 'swallowed', CAST(frame AS VARCHAR), i || '<' || k FROM j WHERE s / greatest(1, aa) > 0.95 AND NOT least(aa, ba) >= 0.85 * greatest(aa, ba) UNION ALL SELECT 'doubled', CAST(frame AS VARCHAR), i || '=' || k FROM j WHERE least(aa, ba) >= 0.85 * greatest(aa, ba) AND s / greatest(1, aa) > 0.85 AND s / greatest(1, ba) > 0.85 AND i < k""")
def q02(spark, d):
    return quality.picture_rules(views.rects(spark, d), "frame", 2400, 1200)


@query("Q03_camera_agreement", "labelled", "n AS (SELECT item, CASE WHEN want = 1 THEN 'screen' ELSE 'camera' END AS v FROM labelled WHERE item % 7 <> 0), f AS (SELECT item, CASE WHEN boxes >= 30 THEN 'screen' ELSE 'camera' END AS v FROM labelled WHERE item % 11 <> 0) SELECT 'camera disagrees' AS rule, CAST(coalesce(n.item, f.item) AS VARCHAR) AS place, coalesce(n.v, '-') || '/' || coalesce(f.v, '-') AS what FROM n FULL JOIN f ON n.item = f.item WHERE n.v IS NULL OR f.v IS NULL OR n.v <> f.v")
def q03(spark, d):
    x = views.labelled(spark, d)
    n = x.where("item % 7 <> 0").select("item", F.when(F.col("want") == 1, "screen").otherwise("camera").alias("verdict"))
    return quality.camera_agreement(n, x.where("item % 11 <> 0").select("item", F.when(F.col("boxes") >= 30, "screen").otherwise("camera").alias("verdict")), "item")


@query("Q04_sidebar_dropped", "rects", f"w AS (SELECT frame, CASE WHEN id % 2 = 0 THEN 'Desktop' ELSE 'downloads' END AS t, x0, y0, x1, y1 FROM rects WHERE id > 1), p AS {sql_boxes('id = 1', 'p_')} SELECT 'sidebar dropped' AS rule, CAST(p.frame AS VARCHAR) AS place, CAST(p_id AS VARCHAR) AS what FROM p JOIN w ON p.frame = w.frame AND p.frame % 2 = 0 AND (x0 + x1) / 2 >= p_x0 AND (x0 + x1) / 2 < p_x1 AND (y0 + y1) / 2 >= p_y0 AND (y0 + y1) / 2 < p_y1 GROUP BY p.frame, p_id HAVING count(*) >= 2")
def q04(spark, d):
    w = views.rects(spark, d).where("id > 1").select("frame", F.when(F.col("id") % 2 == 0, "Desktop").otherwise("downloads").alias("w_text"), *(F.col(c).alias(f"w_{c}") for c in ("x0", "y0", "x1", "y1")))
    p = boxed(spark, d, "id = 1", "p_").withColumn("p_sidebar", F.col("frame") % 2 == 1)
    return quality.sidebar_dropped(w, p, ["desktop", "downloads", "documents"], "frame")


RULE = "CASE WHEN regexp_matches(crumb, '^(folder|untitled|[?]+)$') THEN 'placeholder' WHEN regexp_matches(crumb, '[a-z]{2}[A-Z]|[a-z][0-9]{2,}[a-z]') THEN 'run together' WHEN regexp_matches(crumb, '--+|_{2,}') OR length(crumb) > 30 THEN 'mangled' END"


@query("Q05_crumb_rules", "", f"{PATHS}, c AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'folder' WHEN page_id % 4 = 1 THEN crumb || 'Xy' WHEN page_id % 4 = 2 THEN crumb || '--' ELSE crumb END AS crumb FROM (SELECT page_id, unnest(path) AS crumb FROM p)), b AS (SELECT *, {RULE} AS rule FROM c), g AS (SELECT DISTINCT path[1] || 'Xyabcdefghijklmnop' AS reading FROM p WHERE length(path[1] || 'Xyabcdefghijklmnop') >= 20) SELECT CASE WHEN EXISTS (SELECT 1 FROM g WHERE starts_with(g.reading, b.crumb) AND substr(g.reading, 1, 6) = substr(b.crumb, 1, 6)) THEN 'excused: ' || rule ELSE rule END AS rule, CAST(page_id AS VARCHAR) AS place, crumb AS what FROM b WHERE rule IS NOT NULL")
def q05(spark, d):
    p = paths(spark, d)
    m = F.col("page_id") % 4
    c = p.select("page_id", F.explode("path").alias("c")).select("page_id", F.when(m == 0, "folder").when(m == 1, F.concat("c", F.lit("Xy"))).when(m == 2, F.concat("c", F.lit("--"))).otherwise(F.col("c")).alias("crumb"))
    return quality.crumb_rules(c, p.select(F.concat(F.get("path", 0), F.lit("Xyabcdefghijklmnop")).alias("reading")), "page_id")


@query("Q06_proof_by_damage")
def q06(spark, d):
    good = views.pages(spark, d).withColumn("html", F.regexp_replace("html", "<style>.*?</style>", ""))
    return quality.proof_by_damage(good, quality.note_rules, lambda p: p.withColumn("html", F.concat("html", F.lit("<style>p{}</style>"))))


@query("Q07_every_region_speaks", "rects", "o AS (SELECT frame, id, CAST(id % 3 = 0 AS INT) + CAST(id % 3 = 1 AND frame % 10 <> 0 AS INT) + CAST(id % 3 = 2 OR frame % 13 = 0 AS INT) AS n FROM rects) SELECT 'not exactly one outcome' AS rule, frame || '/' || id AS place, CAST(n AS VARCHAR) AS what FROM o WHERE n <> 1")
def q07(spark, d):
    r = views.rects(spark, d)
    return quality.every_region_speaks(r, r.where("id % 3 = 0"), r.where("id % 3 = 1 and frame % 10 <> 0"), r.where("id % 3 = 2 or frame % 13 = 0"), ["frame", "id"])

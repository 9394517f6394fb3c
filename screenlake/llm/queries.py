"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.llm import chat, decontaminate, lm_score, mixing, near_dedup, negatives, phrases, quality, repeats, set_join, sharding
from screenlake.llm import language as tongue
from screenlake.llm import toxicity as toxic


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select(F.col("rid").alias("doc_id"), "class_id", "kept")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = tongue.language(docs, tongue.learn(docs))
    return found.select("doc_id", (toxic.fold_of(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    items = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.backoff_scores(table(spark, sf_dir, "documents")).withColumn("log10_score", F.round("log10_score", 6))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = chat.read_turns(text)
            learned = "".join(chat.unescaped(text[s["start"] : s["end"]]) for s in loss)
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(said).alias("text"))
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.format_chats(chats).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxic.toxicity(docs, toxic.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (toxic.fold_of(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(negatives.quantised(rows))


def op12_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.linked_sets(table(spark, sf_dir, "documents")).withColumnRenamed("rid", "doc_id")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_near_dedup, op3_mix, op4_language, op5_decontaminate, op6_repeats, op7_lm_score, op8_shard, op9_chat, op10_toxicity, op11_negatives, op12_set_join, op13_phrases)}

ORACLE = {
    "op12_set_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM w WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id)
SELECT r.id AS doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN z ON z.doc_id = r.id GROUP BY r.id""",
    "op11_negatives": r"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS aid, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT aid, id AS pid, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, id) <= 5),
r AS (SELECT p.aid, p.pid, p.ps, s.id, s.score, row_number() OVER (PARTITION BY p.aid, p.pid ORDER BY s.score DESC, s.id) AS rank
 FROM p JOIN s ON s.aid = p.aid AND NOT s.same AND 30 * p.ps <= 100 * s.score AND 100 * s.score <= 90 * p.ps)
SELECT aid AS anchor_id, pid AS positive_id, CAST(rank AS INTEGER) AS rank, id AS negative_id, ps AS positive_score, score AS negative_score FROM r WHERE rank <= 10""",
    "op13_phrases": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
g AS (SELECT lang, s AS size, array_to_string(w[k : k + s - 1], ' ') AS phrase FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS k FROM w, (SELECT unnest(range(1, 6)) AS s) WHERE len(w) >= s)),
c AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
p AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE size > 1),
k AS (SELECT p.lang, phrase, w, size, f, unnest(range(1, size)) AS k FROM p),
s AS (SELECT k.lang, k.phrase, k.f AS a, x.f AS l, y.f AS r, n.n, k.k, (1000::HUGEINT * k.f * n.n) // (x.f::HUGEINT * y.f) AS score
 FROM k JOIN c x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k.k], ' ') JOIN c y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1 : k.size], ' ') JOIN n ON n.lang = k.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[t : t + z - 1], ' ') AS phrase, max(f) AS f FROM (SELECT lang, w, f, z, unnest(range(1, size - z + 2)) AS t FROM p, (SELECT unnest(range(2, 5)) AS z) WHERE z < size) GROUP BY ALL),
o AS (SELECT m.* FROM m LEFT JOIN i ON i.lang = m.lang AND i.phrase = m.phrase WHERE i.f IS NULL OR 100 * i.f < 100 * m.a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
    "op5_decontaminate": r"""
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (SELECT item_id, w[k : k + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM wins),
spots AS (SELECT doc_id, k, n, w[k : k + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM fold, lens WHERE len(w) >= n)),
hits AS (SELECT s.doc_id, s.k, s.n, i.item_id FROM spots s JOIN wins i ON s.win = i.win),
per AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(i.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM fold f LEFT JOIN per p ON f.doc_id = p.doc_id LEFT JOIN its i ON f.doc_id = i.doc_id""",
    "op6_repeats": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM docs WHERE len(w) >= 20)),
firsts AS (SELECT h, min(struct_pack(d := doc_id, k := k)) AS m FROM wins GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT w.doc_id, unnest(range(w.k, w.k + 20)) AS pos FROM wins w JOIN firsts f ON w.h = f.h WHERE w.doc_id > f.m.d OR w.doc_id = f.m.d AND w.k > f.m.k)),
per AS (SELECT doc_id, list(pos) AS p FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(p.p), 0) AS n_removed, CASE WHEN p.p IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(k.txt, '') END AS txt
 FROM docs d LEFT JOIN per p ON d.doc_id = p.doc_id
 LEFT JOIN (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.pos) AS txt FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs WHERE doc_id IN (SELECT doc_id FROM per)) x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.pos = g.pos GROUP BY x.doc_id) k ON d.doc_id = k.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(txt) AS kept_sha256 FROM kept""",
    "op2_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, sh, count(*) AS n FROM s GROUP BY ALL), z AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS m FROM c x JOIN c y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id)
SELECT id AS doc_id, min(root) AS class_id, id = min(root) AS kept FROM r GROUP BY id""",
    "op7_lm_score": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
one AS (SELECT c, count(*) AS n FROM t GROUP BY c), own1 AS (SELECT doc_id, c, count(*) AS n FROM t GROUP BY ALL),
two AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY ALL), own2 AS (SELECT doc_id, b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY ALL),
f AS (SELECT t.doc_id, x.n - ox.n AS n1, p.n - op.n AS n2, y.n - oy.n AS nb, (SELECT count(*) FROM t) - len(w.w) AS rest FROM t JOIN w ON t.doc_id = w.doc_id
 JOIN one x ON t.c = x.c JOIN own1 ox ON t.doc_id = ox.doc_id AND t.c = ox.c LEFT JOIN one y ON t.b = y.c LEFT JOIN own1 oy ON t.doc_id = oy.doc_id AND t.b = oy.c
 LEFT JOIN two p ON t.b = p.b AND t.c = p.c LEFT JOIN own2 op ON t.doc_id = op.doc_id AND t.b = op.b AND t.c = op.c),
k AS (SELECT doc_id, n1, coalesce(n2 > 0 AND nb > 0, false) AS known, CASE WHEN n2 > 0 AND nb > 0 THEN n2 / nb ELSE 0.4 * greatest(n1, 1) / greatest(rest, 1) END AS s FROM f),
g AS (SELECT doc_id, sum(log10(s)) AS score, count(*) FILTER (NOT known) AS n_backoff, count(*) FILTER (n1 <= 0) AS n_unseen FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, round(coalesce(score, 0.0), 6) AS log10_score, coalesce(n_backoff, 0) AS n_backoff, coalesce(n_unseen, 0) AS n_unseen FROM w LEFT JOIN g ON w.doc_id = g.doc_id""",
    "op9_chat": r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '\### Assistant: </turn> ok'), (1, 'assistant', '\### Assistant: </turn> ok'))),
esc AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) AS n, length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c')) AS m FROM rows),
agg AS (SELECT conv_id, count(*) AS n_turns, sum(n + m + 14) AS formatted_chars,
 string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss FROM esc GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM agg""",
    "op3_mix": r"""
WITH docs AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(text) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM docs GROUP BY source),
wei AS (SELECT source, source_size, CAST([5, 2, 1][turn % 3 + 1] AS BIGINT) AS weight FROM src),
ord AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gone, CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
 FROM wei WINDOW o AS (ORDER BY source_size / weight, source ASC NULLS LAST)),
rat AS (SELECT *, (total - 3 * gone) / open AS rate FROM ord),
sto AS (SELECT *, source_size * 3 <= rate * weight AS stops FROM rat),
lev AS (SELECT arg_min(rate, gone) AS level FROM sto WHERE NOT stops),
tar AS (SELECT source, source_size, CASE WHEN stops THEN CAST(source_size * 3 AS DOUBLE) ELSE level * weight END AS target FROM sto LEFT JOIN lev ON true),
who AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM tar),
res AS (SELECT *, target - whole * source_size AS rest FROM who),
stp AS (SELECT source, CAST(floor(sqrt(size)) AS BIGINT) AS g, CAST(sum(size) AS BIGINT) AS s, CAST(sum(floor(sqrt(size)) * size) AS BIGINT) AS gs FROM docs WHERE size > 0 GROUP BY ALL),
cum AS (SELECT source, g, CAST(coalesce(sum(s) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sure, CAST(sum(gs) OVER (PARTITION BY source ORDER BY g) AS BIGINT) AS part FROM stp),
sca AS (SELECT source, arg_max(c, g) AS c FROM (SELECT c.source, c.g, (r.rest - c.sure) / c.part AS c FROM cum c JOIN res r ON c.source IS NOT DISTINCT FROM r.source) WHERE c * g <= 1 GROUP BY source),
ful AS (SELECT r.*, greatest(coalesce(s.c, 0.0), 1e-12) AS c, greatest(1e-9, least(1 - 1e-9, r.rest / greatest(r.source_size, 1))) AS f FROM res r LEFT JOIN sca s ON r.source IS NOT DISTINCT FROM s.source),
dra AS (SELECT d.*, r.source_size, r.target, r.whole, r.rest, r.f, least(1.0, r.c * floor(sqrt(d.size))) AS p,
 (CAST(CAST('0x' || substr(md5('mix' || chr(31) || coalesce(CAST(d.doc_id AS VARCHAR), chr(30)) || chr(31) || coalesce(d.h, chr(30))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
 FROM docs d JOIN ful r ON d.source IS NOT DISTINCT FROM r.source),
odd AS (SELECT *, u / (1 - u) * (1 - p) / p AS odds FROM dra),
rnk AS (SELECT *, CASE WHEN size > 0 THEN odds / (odds + (1 - f) / f) END AS score FROM odd),
grp AS (SELECT source, doc_id, h, max(score) AS score, max(rest) AS rest, CAST(sum(size) AS BIGINT) AS gsize, false AS inside FROM rnk GROUP BY source, doc_id, h),
ga1 AS (SELECT *, max(rest) OVER (PARTITION BY source) - sum(CASE WHEN inside THEN gsize ELSE 0 END) OVER (PARTITION BY source) AS gap FROM grp),
fi1 AS (SELECT source, doc_id, h, sum(gsize) OVER (PARTITION BY source ORDER BY score, doc_id, h) AS upto FROM ga1 WHERE NOT inside AND gsize > 0 AND gsize <= gap),
gr1 AS (SELECT g.source, g.doc_id, g.h, g.score, g.rest, g.gsize, g.inside OR coalesce(upto <= gap, false) AS inside FROM ga1 g LEFT JOIN fi1 f ON g.source IS NOT DISTINCT FROM f.source AND g.doc_id IS NOT DISTINCT FROM f.doc_id AND g.h IS NOT DISTINCT FROM f.h),
ga2 AS (SELECT *, max(rest) OVER (PARTITION BY source) - sum(CASE WHEN inside THEN gsize ELSE 0 END) OVER (PARTITION BY source) AS gap FROM gr1),
fi2 AS (SELECT source, doc_id, h, sum(gsize) OVER (PARTITION BY source ORDER BY score, doc_id, h) AS upto FROM ga2 WHERE NOT inside AND gsize > 0 AND gsize <= gap),
gr2 AS (SELECT g.source, g.doc_id, g.h, g.score, g.rest, g.gsize, g.inside OR coalesce(upto <= gap, false) AS inside FROM ga2 g LEFT JOIN fi2 f ON g.source IS NOT DISTINCT FROM f.source AND g.doc_id IS NOT DISTINCT FROM f.doc_id AND g.h IS NOT DISTINCT FROM f.h),
ga3 AS (SELECT *, max(rest) OVER (PARTITION BY source) - sum(CASE WHEN inside THEN gsize ELSE 0 END) OVER (PARTITION BY source) AS gap FROM gr2),
fi3 AS (SELECT source, doc_id, h, sum(gsize) OVER (PARTITION BY source ORDER BY score, doc_id, h) AS upto FROM ga3 WHERE NOT inside AND gsize > 0 AND gsize <= 2 * gap),
gr3 AS (SELECT g.source, g.doc_id, g.h, g.score, g.rest, g.gsize, g.inside OR coalesce(upto - gsize / 2 <= gap, false) AS inside FROM ga3 g LEFT JOIN fi3 f ON g.source IS NOT DISTINCT FROM f.source AND g.doc_id IS NOT DISTINCT FROM f.doc_id AND g.h IS NOT DISTINCT FROM f.h),
fin AS (SELECT r.doc_id, r.size, r.source_size, r.target, CAST(CASE WHEN r.size > 0 THEN r.whole + CASE WHEN i.inside THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS copies
 FROM rnk r LEFT JOIN gr3 i ON r.source IS NOT DISTINCT FROM i.source AND r.doc_id IS NOT DISTINCT FROM i.doc_id AND r.h IS NOT DISTINCT FROM i.h)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM fin""",
}

"""Operator 8: shards as the leaves of a k-d tree over metadata, split at weighted medians.

Points are distinct texts; a point weighs the bytes of all rows with its text, so equal texts always share a
shard. Its dimensions are the size of the text and the least document number, language and source of its rows, languages and
sources as ranks of their whole values. A node that is to
hold m shards is cut along the dimension in which it is widest (relative to the whole table's range) at the
weighted quantile floor(m / 2) / m, until every node is one shard. Ties in a dimension are ordered by a hash
of the text, so a dimension of four values still cuts evenly. Where the point that straddles a
cut would tip it by more than 1/64 of a shard, the point goes right and the cut moves on to make up for it, up to ``SKIPS`` times; so a shard of the
law `bytes` is within a few hundredths of the mean, unless it has only a few points.

Scale: all is DataFrame functions. A level needs the ranges per node and three passes of a histogram
that narrows each node's cut from 2^16 buckets to one value, or one where no node has more points than that; only tables of a row per node
reach the driver, at most twice the number of shards. Ranks of values come from a range-partitioned sort of the distinct ones and joins. Slots
come from counts of hashed parts of a shard, so no shard is ever sorted whole.

Defined cases: a null or empty text weighs 16 bytes a row and all such rows are one point each (null and empty
apart); null metadata counts as the least value; ids that are no integers come back as they are and count by their order; where there are fewer texts than shards some shards stay empty; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from screenlake.functions.storage import stored

TIE = 1 << 24
CODE = 1 << 24


def _ranks(rows: DataFrame, name: str) -> DataFrame:
    """(value, rank): the distinct values of a column, numbered from 1 in their order."""
    # ids grow along a range-partitioned sort: the partition above bit 33, the row below
    line = stored(rows.select(F.col(name).alias("value")).where("value is not null").distinct().orderBy("value").withColumn("id", F.monotonically_increasing_id()), "values")
    part = F.shiftright("id", 33)
    sizes = line.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return line.withColumn("part", part).join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("value", (F.col("before") + F.col("id") - F.shiftleft("part", 33) + 1).alias("rank"))


def _points(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    raw = F.col(text_col).cast("binary")
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.md5(raw).alias("print"), (F.coalesce(F.octet_length(raw), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")), "rows")
    for name in ("lang", "source"):  # Spark broadcasts the ranks where they are few
        rows = rows.join(_ranks(rows, name).withColumnRenamed("value", name), name, "left").drop(name).withColumnRenamed("rank", name)
    if isinstance(rows.schema["doc_id"].dataType, IntegralType):
        return stored(rows.withColumn("id", F.col("doc_id").cast("long")), "rows")
    return stored(rows.join(_ranks(rows, "doc_id").withColumnsRenamed({"value": "doc_id", "rank": "id"}), "doc_id", "left"), "rows")


def _scaled(name: str) -> Column:
    """A dimension as 0 .. 2^24 - 1 of the table's range, with a tie-break of 24 bits below."""
    low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
    share = (F.col(name) - low) / F.greatest(high - low, F.lit(1))
    return F.floor(share * (CODE - 1)) * TIE + F.conv(F.substring("print", 1, 6), 16, 10).cast("long")


def _inline(spark, names: str, rows: list[tuple]) -> DataFrame:
    """A table of a few rows, one per node."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(str, r)) + ')' for r in rows)} AS t({names})")


SKIPS, ENDLESS = 10, 1 << 62


def _quantiles(points: DataFrame, cuts: dict[int, dict], dims: list[str], weight: str, small: bool) -> dict[int, tuple[int, float, float]]:
    """For each node the value, from ``low`` on, at which its sum of weights, from ``done`` on, reaches ``goal``; the sum before that value, and the weight at it. ``small``: no node has more points than a histogram has buckets."""
    spark = points.sparkSession
    at_node = {k: (c["low"], c["done"], 0.0) for k, c in cuts.items()}
    for step in (0,) if small else (32, 16, 0):  # 2^16 buckets narrow to one value in three passes
        if not at_node:
            break
        plan = _inline(spark, "leaf, axis, goal, low", [(k, cuts[k]["axis"], f"{cuts[k]['goal'] - done!r}D", f"{low}L") for k, (low, done, _) in at_node.items()])
        here = points.join(F.broadcast(plan), "leaf").withColumn("at", F.element_at(F.array(*dims), F.col("axis") + 1))
        here = here.where((F.col("at") >= F.col("low")) & (F.lit(small) | (F.col("at") < F.col("low") + (1 << (step + 16)))))
        parts = here.withColumn("part", F.shiftright(F.col("at") - F.col("low"), step)).groupBy("leaf", "goal", "part").agg(F.sum(weight).alias("w"))
        upto = F.sum("w").over(Window.partitionBy("leaf").orderBy("part"))
        rows = parts.withColumn("upto", upto).where("upto >= goal").groupBy("leaf").agg(F.min(F.struct("part", "upto", "w")).alias("m")).collect()
        at_node = {r["leaf"]: (at_node[r["leaf"]][0] + (r["m"]["part"] << step), at_node[r["leaf"]][1] + float(r["m"]["upto"] - r["m"]["w"]), float(r["m"]["w"])) for r in rows}
    return at_node


def kd_leaves(points: DataFrame, leaves: int, dims: list[str], weight: str = "weight") -> DataFrame:
    """``points`` with ``leaf``, 0 to leaves - 1. ``dims`` are longs below 2^48, distinct enough to cut anywhere."""
    spark = points.sparkSession
    nodes = {0: (0, leaves)}  # of each node that is open: the first leaf and the number of leaves
    df = points.withColumn("leaf", F.lit(0))
    while wide := {k: v for k, v in nodes.items() if v[1] > 1}:
        df = stored(df, "tree")
        live = df.join(F.broadcast(_inline(spark, "leaf", [(k,) for k in wide])), "leaf")
        spans = live.groupBy("leaf").agg(F.sum(weight).alias("total"), F.count(F.lit(1)).alias("points"), *(F.struct(F.min(d), F.max(d)).alias(d) for d in dims)).collect()
        if not spans:  # no rows are left to split
            return df
        cuts = {}
        for r in spans:
            first, m = wide[r["leaf"]]
            axis = max(range(len(dims)), key=lambda i: ((r[dims[i]][1] >> 24) - (r[dims[i]][0] >> 24), -i))
            cuts[r["leaf"]] = {"axis": axis, "goal": r["total"] * (m // 2) / m, "slack": r["total"] / m / 64, "low": 0, "done": 0.0, "take": True, "skips": []}
        todo, small = cuts, max(r["points"] for r in spans) <= 1 << 16
        while todo:
            found = _quantiles(live, todo, dims, weight, small)
            again = {}
            for k, c in todo.items():
                if k not in found:  # all that is left belongs to the left
                    c["low"] = ENDLESS
                    continue
                c["low"], c["done"], w = found[k]
                short = c["goal"] - c["done"]
                c["take"] = short >= w / 2  # the side that comes nearer to the goal
                if min(short, w - short) > c["slack"] and len(c["skips"]) < SKIPS:
                    c["skips"].append(c["low"])
                    again[k] = c | {"low": c["low"] + 1}
            for k in again:
                cuts[k] = again[k]
            todo = again
        table = _inline(spark, "leaf, axis, cut, take, skips, next", [(k, c["axis"], f"{c['low']}L", "true" if c["take"] else "false", f"array({', '.join(f'{x}L' for x in c['skips'])})" if c["skips"] else "cast(array() as array<bigint>)", wide[k][0] + wide[k][1] // 2) for k, c in cuts.items()])
        df = df.join(F.broadcast(table), "leaf", "left")
        at = F.element_at(F.array(*dims), F.col("axis") + 1)
        right = (at > F.col("cut")) | ((at == F.col("cut")) & ~F.col("take")) | F.array_contains("skips", at)
        df = df.withColumn("leaf", F.when(F.col("axis").isNotNull() & right, F.col("next")).otherwise(F.col("leaf"))).drop("axis", "cut", "take", "skips", "next")
        for first, m in wide.values():
            nodes[first] = (first, m // 2)
            nodes[first + m // 2] = (first + m // 2, m - m // 2)
    return df


def kd_shards(docs: DataFrame, shards: int = 40, parts: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of ``docs``."""
    rows = _points(docs, id_col, text_col, lang_col, source_col)
    groups = rows.groupBy("print").agg(F.sum("size").alias("weight"), F.max("size").alias("size"), *(F.coalesce(F.min(c), F.lit(0).cast("long")).alias(c) for c in ("id", "lang", "source")))
    groups = stored(groups.withColumn("print", F.coalesce("print", F.lit("000000"))), "points")
    names = ["size", "id", "lang", "source"]
    ranges = groups.agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("low", F.min), ("high", F.max)))).first()
    scaled = groups.withColumns({f"{n}_{k}": F.lit(ranges[f"{n}_{k}"]).cast("long") for n in names for k in ("low", "high")})
    scaled = scaled.select("print", "weight", *(_scaled(n).alias(f"d_{n}") for n in names))
    leaf = kd_leaves(scaled, shards, [f"d_{n}" for n in names]).select(F.col("print").alias("key"), F.col("leaf").alias("shard"))
    placed = rows.withColumn("key", F.coalesce("print", F.lit("000000"))).join(leaf, "key")
    placed = stored(placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int").alias("part")), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    turn = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1
    # shards x parts rows at most
    out = placed.withColumn("turn", turn).join(F.broadcast(counts), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("turn")).alias("slot"))

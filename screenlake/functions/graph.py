"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.functions.storage import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every end of ``edges``; component is the least id of its members.

    Each round points every node at the neighbour (or itself) of the least hash, drawn anew per round,
    replaces edges by those between the pointed-at nodes and drops loops. A constant share of nodes is
    expected to vanish per round, chains included, so rounds grow with the logarithm of the size. Only
    aggregations with partial sums and joins on ids occur; a hub's edges are never gathered. An empty edge table gives an empty result; null ends are ignored.
    """
    pair = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    first, live, moves = pair, pair, []
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        order = F.struct(F.xxhash64(F.col("n"), F.lit(len(moves))), F.col("n"))
        near = both.select(F.col("a").alias("id"), F.col("b").alias("n")).union(both.select(F.col("a").alias("id"), F.col("a").alias("n")))
        # the pointed-at neighbour of a node may itself move on; that only delays the merge by a round
        to = stored(near.groupBy("id").agg(F.min(order).getField("n").alias("to")), "moves")
        moves.append(to)
        left, right = to.selectExpr("id AS a", "to AS ta"), to.selectExpr("id AS b", "to AS tb")
        live = stored(live.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    label = first.selectExpr("explode(array(a, b)) id").distinct().selectExpr("id", "id AS tag")
    for to in moves:  # tables that shrink from round to round
        label = label.join(to.selectExpr("id AS tag", "to"), "tag", "left").select("id", F.coalesce("to", "tag").alias("tag"))
    least = label.groupBy("tag").agg(F.min("id").alias("component"))
    return label.join(least, "tag").select("id", "component")

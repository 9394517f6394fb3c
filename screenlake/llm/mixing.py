r"""Operator 3: mixing sources to target weights by Pareto order sampling.

Targets share the words of the whole corpus by weight; a target stops at ``most`` times its source's
words and what is over is shared again. A source whose target is m times its words gives floor(m) whole copies
of every document for certain. The rest, R words, is a sample of unequal probabilities: document i is
included with probability p_i = min(1, c g_i), where g_i = floor(sqrt(size_i)) favours long
documents mildly and c makes the expected words R. Pareto order sampling (Rosen) ranks the documents of a source by
(u / (1 - u)) / (p / (1 - p)), u uniform by hash of seed and row, and takes them in that order while they fit into R words. What then is left
over is filled by going on down the ranking with those that fit, once more, and at last with what comes nearest to R.

Scale: sizes are summed per source before any shuffle; only the table of sources is ordered as a whole.
No source is ever sorted in one task: ranks fall into ``bins`` by a hash-uniform score, per-bin sums find
the bin that holds the cut, and only that bin's rows are ordered. The table of sources has a row a source.

Defined cases: null, empty and wordless texts have size 0 and take nothing; sources without words have target 0; a null source is a source of its own,
last; rows that repeat a doc_id are separate documents unless their text is equal too, then they share one draw and may
be taken together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions.storage import stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    r"""Words `[^\x20\x09-\x0D]+` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) by water-filling: the sources that stop at ``most`` times their size are a prefix by most * size / weight."""
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    table = table.withColumn("weight", weight.cast("long"))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    table = table.withColumns({"total": F.sum("source_size").over(Window.partitionBy()), "gone": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "open": F.sum("weight").over(rest)})
    rate = (F.col("total") - most * F.col("gone")) / F.col("open")
    table = table.withColumn("stops", F.col("source_size") * most <= rate * F.col("weight")).withColumn("rate", rate)
    level = F.min(F.when(~F.col("stops"), F.struct("gone", "rate"))).over(Window.partitionBy()).getField("rate")
    target = F.when(F.col("stops"), (F.col("source_size") * most).cast("double")).otherwise(level * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def uniform(seed: str, *columns: str) -> Column:
    """A number between 0 and 1, made from 52 bits of a hash."""
    key = F.concat_ws("\x1f", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


ROUNDS = 3


def _fill(units: DataFrame, bins: int, last: bool) -> DataFrame:
    """``units`` with ``inside`` set for those that the ranking takes next: a prefix, among the units that fit, of each source's gap."""
    gaps = units.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("inside"), F.col("size")).otherwise(0))).alias("gap"))
    same = F.col("t.source").eqNullSafe(F.col("r.source"))
    fits = ~F.col("inside") & (F.col("size") > 0) & (F.col("size") <= (2 if last else 1) * F.col("gap"))
    bin_of = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    units = units.alias("t").join(gaps.alias("r"), same).select("t.*", "gap").withColumn("bin", F.when(fits, bin_of))
    sums = units.where("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    cut = sums.withColumn("upto", upto).where("upto > gap").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("m"))
    units = units.alias("t").join(cut.select("source", "m.bin", "m.before").alias("r"), same, "left").select("t.*", F.col("r.bin").alias("cut"), "before")
    edge = F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
    # order within the bin of the cut only
    line = Window.partitionBy("source").orderBy("score", "doc_id", "text_hash")
    end = F.col("before") + F.sum("size").over(line)
    ordered = units.where(edge).withColumn("inside", end - (F.col("size") / 2 if last else 0) <= F.col("gap"))
    whole = units.where(~edge).withColumn("inside", F.col("inside") | F.coalesce(F.col("cut").isNull() | (F.col("bin") < F.col("cut")), F.lit(False)) & F.col("bin").isNotNull())
    return stored(ordered.unionByName(whole).drop("gap", "bin", "cut", "before"), "filled")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, bins: int = 4096, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, text_hash, size, source, source_size, target, copies, taken) per row; taken = copies * size."""
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.col(text_col).cast("binary")).alias("text_hash")), "sizes")
    table = source_targets(rows, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    table = table.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    g = F.floor(F.sqrt("size"))
    # c of each source: the documents with g from some value up are included for certain, the others share what is left
    steps = rows.where("size > 0").select("source", g.alias("g"), "size").groupBy("source", "g").agg(F.sum("size").alias("s"), F.sum(F.col("g") * F.col("size")).alias("gs"))
    down = Window.partitionBy("source").orderBy(F.desc("g"))
    up = Window.partitionBy("source").orderBy("g")
    steps = steps.withColumns({"sure": F.coalesce(F.sum("s").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "part": F.sum("gs").over(up)})
    same = F.col("t.source").eqNullSafe(F.col("r.source"))
    c = (F.col("rest") - F.col("sure")) / F.col("part")
    scale = steps.alias("t").join(table.alias("r"), same).select("t.source", "g", c.alias("c")).where("c * g <= 1").groupBy("source").agg(F.max_by("c", "g").alias("c"))
    table = table.alias("t").join(scale.alias("r"), same, "left").select("t.*", F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(1e-12)).alias("c"))
    table = stored(table, "targets")
    u = uniform(seed, "doc_id", "text_hash")
    p = F.least(F.lit(1.0), F.col("c") * g)
    # u / (1 - u) * (1 - p) / p; as a score it is divided by the source's mean odds, so that bins of scores are about even
    f = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("rest") / F.greatest("source_size", F.lit(1))))
    odds = u / (1 - u) * (1 - p) / p
    ranked = rows.alias("t").join(table.alias("r"), same).select("t.doc_id", "t.text_hash", "t.source", "size", "source_size", "target", "whole", "rest", F.when(F.col("size") > 0, odds / (odds + (1 - f) / f)).alias("score"))
    # rows that repeat are taken together
    key = ["source", "doc_id", "text_hash"]
    units = stored(ranked.groupBy(*key).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("score").alias("score"), F.lit(False).alias("inside")), "units")
    for turn in range(ROUNDS):
        units = _fill(units, bins, turn == ROUNDS - 1)
    taken = units.where("inside").select(*key, F.lit(1).alias("more"))
    each = F.lit(True)
    for c in key:
        each &= F.col(f"t.{c}").eqNullSafe(F.col(f"r.{c}"))
    out = ranked.alias("t").join(taken.alias("r"), each, "left").select("t.*", F.coalesce("more", F.lit(0)).alias("more"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0).cast("long")
    return out.select("doc_id", "text_hash", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    plan = mixed(docs, id_col=id_col, text_col=text_col, **params).groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.col(text_col).cast("binary")).alias("text_hash"), F.struct("*").alias("row"))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.text_hash").eqNullSafe(F.col("m.text_hash"))
    return rows.alias("d").join(plan.alias("m"), same).select("row", F.explode(F.sequence(F.lit(1), F.col("m.copies").cast("int"))).alias("turn")).select("row.*")

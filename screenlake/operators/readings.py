"""Operators that weigh one reading against others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.functions import strings as fs


def program_names(readings: DataFrame, vocabulary: list[str], floor: float = 0.72) -> DataFrame:
    """(key, program): the vocabulary word that the text before the last word most resembles, null below ``floor``."""
    known = F.explode(F.array(*map(F.lit, vocabulary)))
    before = fs.flat(F.substring_index("reading", " ", 1))
    each = readings.select("key", before.alias("head"), known.alias("word"))
    best = each.withColumn("score", fs.seq_ratio("head", "word")).groupBy("key").agg(F.max(F.struct("score", "word")).alias("b"))
    return best.select("key", F.when(F.col("b.score") >= floor, F.col("b.word")).alias("program"))


def reconciled(rows: DataFrame, primary: str, second: str) -> DataFrame:
    """``rows`` with ``text`` and ``status`` by the ladder of agreement of two readings.

    Each rung is a column of its own, so the costly ones see only the rows that come down to them.
    """
    said = rows.withColumns({"_p": fs.tidy(F.col(primary)), "_s": fs.tidy(F.col(second))}).withColumns({"_lp": fs.letters(F.col("_p")), "_ls": fs.letters(F.col("_s"))})
    open_, same = (F.col("_p") != F.col("_s")) & (F.col("_s") != ""), F.col("_lp") == F.col("_ls")
    said = said.withColumn("_m", fs.merged_readings(*(F.when(open_ & same, F.col(c)) for c in ("_p", "_s"))))
    said = said.withColumn("_g", F.when(open_ & ~same & (F.length("_lp") == F.length("_ls")), fs.only_lookalikes(F.col("_lp"), F.col("_ls"))))
    rest = open_ & ~same & ~F.coalesce("_g", F.lit(False))
    said = fs.agreed_head(said.withColumns({"_a": F.when(rest, F.col("_p")), "_b": F.when(rest, F.col("_s"))}), "_a", "_b", "_h")
    status = (
        F.when(F.col("_s") == "", "unverified")
        .when(F.col("_p") == F.col("_s"), "confident")
        .when(same, F.when(F.col("_m.clashes") > 0, "ambiguous-symbol").otherwise("reconciled"))
        .when(F.col("_g"), "ambiguous-glyph")
        .otherwise(F.coalesce(F.col("_h.status"), F.lit("uncertain")))
    )
    return said.select(*rows.columns, F.coalesce("_m.text", "_h.text", "_p").alias("text"), status.alias("status"))

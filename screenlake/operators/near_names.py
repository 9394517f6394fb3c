"""Names that a mangled reading may be, found by an index that misses none within its bound, and the tiers that choose among them.

The likeness of two names (twice the letters in matching blocks over both lengths) cannot exceed what their letters have in
common, order aside. So two names that reach a likeness share at least so many letter tokens (a letter and its
occurrence), and among the rarest tokens of each, a few more than may differ, at least ``size``: each subset of ``size`` of
those is a key, and names that are alike enough meet in one. A count of common letters by bitmaps then drops most pairs
before any text is compared. Keys with many names are split, and the readings that ask for them repeated, so no task holds a hot key.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlake.functions import strings as fs
from screenlake.functions.storage import stored

RARE_FIRST = "0123456789qzjxkvbwygpfmucdlhrsnioate"
BAND, END_LIKE, SAME_NAME, LEAD, REPLACES, COMPLETES, FULLER = 0.35, 0.8, 0.88, 0.08, 0.90, 0.75, 1.15
KEYS = T.ArrayType(T.LongType())
LETTERS = T.StructType([*(T.StructField(f"b{k}", T.LongType()) for k in range(3)), T.StructField("more", T.IntegerType())])
_PLACE = {c: i for i, c in enumerate(RARE_FIRST)}
_SUBSETS: dict[tuple[int, int], np.ndarray] = {}


def tokens(fold: str) -> list[int]:
    """Letter tokens, later occurrences and rarer letters first."""
    seen: dict[str, int] = {}
    out = []
    for c in fold:
        seen[c] = seen.get(c, 0) + 1
        out.append((63 - min(seen[c], 63)) * 64 + _PLACE.get(c, 63))
    return sorted(out)


def subset_keys(front: list[int], size: int) -> list[int]:
    if (len(front), size) not in _SUBSETS:
        _SUBSETS[len(front), size] = np.array(list(combinations(range(len(front)), size)), np.int64).reshape(-1, size)
    picked = np.array(front, np.int64)[_SUBSETS[len(front), size]]
    return list(dict.fromkeys((picked * (4096 ** np.arange(size))).sum(axis=1).tolist()))


def _whole_keys(reading: bool, least: float, size: int = 3):
    """Keys of whole names for a likeness of ``least`` with names whose lengths are within the band."""

    @F.pandas_udf(KEYS)
    def keys(fold: pd.Series) -> pd.Series:
        def of(s: str) -> list[int]:
            n = len(s)
            partner = (1 - BAND) * n if reading else n / (1 + BAND)
            both = math.ceil(least * (n + math.ceil(partner - 1e-9)) / 2 - 1e-9)
            return subset_keys(tokens(s)[: n - both + size], size) if both >= size else []

        return fold.map(of)

    return keys


def _end_keys(lengths: tuple[int, ...] | None, size: int = 2):
    """Keys of ends: of a reading's end itself (``lengths`` None), or of all beginnings and ends of a name with these lengths."""

    def of(end: str, tail: bool) -> list[int]:
        p = len(end)
        both = math.ceil(END_LIKE * p - 1e-9)
        return [(k << 12 | p << 1 | tail) for k in subset_keys(tokens(end)[: p - both + size], size)]

    if lengths is None:

        @F.pandas_udf(KEYS)
        def keys(end: pd.Series, tail: pd.Series) -> pd.Series:
            return pd.Series([of(e, bool(t)) for e, t in zip(end, tail, strict=True)], dtype="object")
    else:

        @F.pandas_udf(KEYS)
        def keys(fold: pd.Series) -> pd.Series:
            return fold.map(lambda s: [k for p in lengths if p < len(s) for k in (*of(s[:p], False), *of(s[-p:], True))])

    return keys


@F.pandas_udf(LETTERS)
def _letters(fold: pd.Series) -> pd.DataFrame:
    """A bit for each of the first four occurrences of each of 36 letters, and how many tokens have none."""
    out = []
    for s in fold:
        bits, more = [0, 0, 0], 0
        for t in tokens(s):
            occurrence, place = 63 - t // 64, t % 64
            if occurrence <= 4 and place < 36:
                bits[place // 12] |= 1 << (place % 12 * 4 + occurrence - 1)
            else:
                more += 1
        out.append((*bits, more))
    return pd.DataFrame(out, columns=["b0", "b1", "b2", "more"])


def _common(a: str, b: str) -> Column:
    """No fewer than the letters that two folds have in common."""
    same = sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseAND(F.col(f"{b}.b{k}"))) for k in range(3)), F.lit(0))
    return same + F.least(f"{a}.more", f"{b}.more")


def meet(asked: DataFrame, known: DataFrame, most: int = 1000) -> DataFrame:
    """Equality join on ``key`` in which a key of more than ``most`` rows of ``known`` (with ``f``) is split over several."""
    known = stored(known, "keys")
    hot = known.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    left = asked.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    right = known.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("f"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return left.join(right, ["key", "part"])


def alike_names(asked: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(fold, f, score): every name (f) within the band of a reading (fold) whose likeness reaches ``least``."""
    left = asked.select("fold", _letters("fold").alias("x"), F.explode(_whole_keys(True, least)("fold")).alias("key"))
    right = names.select("f", _letters("f").alias("y"), F.explode(_whole_keys(False, least)("f")).alias("key"))
    n, m = F.length("fold"), F.length("f")
    near = meet(left, right).where((F.abs(m - n) <= BAND * n) & (2 * _common("x", "y") >= least * (n + m) - 1e-9)).select("fold", "f").distinct()
    return near.withColumn("score", fs.seq_ratio("f", "fold")).where(F.col("score") >= least)


def ends_of_cut(reading: Column) -> tuple[Column, Column]:
    """Folds before and after the first mark of a cut."""
    return (fs.flat(F.regexp_extract(reading, p, 1)) for p in (r"^(.*?)(?:\.{2,}|…)", r"^.*?(?:\.{2,}|…)[.…]*(.*)$"))


def bracketed(cut: DataFrame, names: DataFrame) -> DataFrame:
    """(reading, f): longer names that begin and end as a cut reading (reading, head, tail) does, each end alike by ``END_LIKE``."""
    tail_leads = F.length("tail") > F.length("head")
    asked = cut.withColumns({"end": F.when(tail_leads, F.col("tail")).otherwise(F.col("head")), "by_tail": tail_leads})
    lengths = tuple(sorted(r[0] for r in asked.select(F.length("end")).distinct().collect()))  # as many as ends have lengths
    left = asked.withColumn("key", F.explode(_end_keys(None)("end", "by_tail"))).select("reading", "head", "tail", "key")
    right = names.select("f", F.explode(_end_keys(lengths)("f")).alias("key"))
    p, q = F.length("head"), F.length("tail")
    near = meet(left, right).where(F.length("f") > p + q).select("reading", "head", "tail", "f").distinct()
    near = near.withColumns({"a": F.substr("f", F.lit(1), p), "b": F.right("f", q)})
    like = lambda x, y: F.when(F.col(x) == F.col(y), 1.0).otherwise(fs.seq_ratio(x, y))
    return near.withColumn("start", like("a", "head")).where(F.col("start") >= END_LIKE).withColumn("finish", like("b", "tail")).where(F.col("finish") >= END_LIKE).select("reading", "f")


def continued(asked: DataFrame, names: DataFrame, least: int = 10) -> DataFrame:
    """(fold, f): names longer by four letters and more that a reading of ``least`` letters begins or ends."""
    long = asked.where(F.length("fold") >= least)
    begin = long.withColumn("k", F.left("fold", F.lit(least))).join(names.withColumn("k", F.left("f", F.lit(least))), "k").where(F.startswith("f", "fold"))
    end = long.withColumn("k", F.right("fold", F.lit(least))).join(names.withColumn("k", F.right("f", F.lit(least))), "k").where(F.endswith("f", "fold"))
    return begin.union(end).where(F.length("f") > F.length("fold") + 3).select("fold", "f").distinct()


def _led(found: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """``found`` (by, f, whole, ...) with the first name of each reading (``lead``) and whether a row spells it (``same``)."""
    first = F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1
    stem = F.regexp_replace("f", "md$", "")
    rows = found.withColumns({"stem": stem, "first": first})
    lead = rows.where("first").select(by, *(F.col(c).alias(f"lead_{c}") for c in rows.columns if c not in (by, "first")))
    both = rows.join(lead, by)
    return both.withColumn("like", F.when(F.col("stem") == F.col("lead_stem"), 1.0).otherwise(fs.seq_ratio("stem", "lead_stem"))).withColumn("same", F.col("like") >= SAME_NAME)


def the_only(found: DataFrame, by: str) -> DataFrame:
    """(by, name): the fullest name, where all others spell the same."""
    led = _led(found, by, [F.desc(F.length("whole")), F.col("whole")])
    return led.groupBy(by).agg(F.bool_and("same").alias("one"), F.any_value("lead_whole").alias("name")).where("one").select(by, "name")


def the_likeliest(found: DataFrame) -> DataFrame:
    """(fold, name, score, next, fuller): the best score and the best of another name."""
    led = _led(found, "fold", [F.desc("score"), F.desc("whole")])
    return led.groupBy("fold").agg(F.any_value("lead_whole").alias("name"), F.any_value("lead_score").alias("score"), F.max(F.when(~F.col("same"), F.col("score"))).alias("next"), (F.length(F.any_value("lead_f")) >= FULLER * F.length("fold")).alias("fuller"))


def lexicon_likely(readings: DataFrame, lexicon: DataFrame, least: int = 2) -> DataFrame:
    """(key, name): the one known name that a mangled reading of six letters and more plainly is, where it is not an exact fold.

    A cut reading must be the one name with both its ends, of eight letters together. Of other readings, one of ten letters may
    be the beginning or the end of one name; else likeness decides: 0.90, or 0.75 for a name longer by 15 %, and 0.08 before the next name. Spellings of one
    name count as one. Only names sighted ``least`` times are taken; a null reading has none.
    """
    lex = stored(lexicon.where(F.col("sightings") >= least).select(F.col("fold").alias("f"), F.col("name").alias("whole")), "lexicon")
    named = lambda found: found.join(lex, "f")
    names = lex.select("f").distinct()
    head, tail = ends_of_cut(F.col("reading"))
    r = readings.select("key", "reading", fs.flat(F.col("reading")).alias("fold")).where("length(fold) >= 6").join(lexicon.select("fold").distinct(), "fold", "left_anti")
    r = stored(r.withColumns({"cut": F.col("reading").rlike(r"\.{2,}|…"), "head": head, "tail": tail}), "readings")
    cut = r.where("cut AND head <> '' AND length(head) + length(tail) >= 8").select("reading", "head", "tail").distinct()
    whole = stored(r.where("NOT cut").select("fold").distinct(), "asked")
    by_ends = the_only(named(bracketed(cut, names)), "reading")
    by_part = stored(the_only(named(continued(whole, names)), "fold"), "continued")
    open_ = stored(whole.join(by_part, "fold", "left_anti"), "open")
    best = stored(the_likeliest(named(alike_names(open_, names, COMPLETES))), "likeliest")
    # below this the next name could have stayed under the first search's bound
    unsure = best.where(F.col("fuller") & (F.col("score") < COMPLETES + LEAD)).select("fold")
    again = stored(the_likeliest(named(alike_names(unsure, names, COMPLETES - LEAD))), "again")
    best = best.join(unsure, "fold", "left_anti").unionByName(again)
    fit = F.when(F.col("fuller"), F.col("score") >= COMPLETES).otherwise(F.col("score") >= REPLACES)
    by_likeness = best.where(fit & F.coalesce(F.col("score") - F.col("next") >= LEAD, F.lit(True))).select("fold", "name")
    mine = r.where("cut").join(by_ends, "reading").select("key", "name")
    return mine.union(r.where("NOT cut").join(by_part.union(by_likeness), "fold").select("key", "name"))

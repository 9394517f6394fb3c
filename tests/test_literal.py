"""Literal cases of operators that SQL cannot say and that had no test of their own."""

import difflib
import os
import random

from pyspark.sql import functions as F

from screenlake.functions import strings as fs
from screenlake.functions.storage import removed, stored
from screenlake.operators import joins, layout, quality
from screenlake.sources import views


def test_matched_characters(spark):
    rows = [("abcd", "abcd", 4), ("abcd", "axcd", 3), ("ab", "ba", 1), ("", "x", 0), (None, "x", 0), ("one two", "onetwo", 6)]
    got = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(rows)], "k int, a string, b string").select("k", fs.matched_characters("a", "b").alias("m")).collect()
    assert {r.k: r.m for r in got} == {k: m for k, (_, _, m) in enumerate(rows)}


def test_rows_that_a_near_table_dropped(spark):
    panes = [(1, 1, n) for n in ("invoices", "receipts", "operations", "lost name")] + [(2, 1, "alone"), (1, 2, None)]
    drawn = [(1, 7, n) for n in ("invoices", "receipts", "operatlons")] + [(1, 8, "invoices")]
    p, d = spark.createDataFrame(panes, "moment int, pane long, name string"), spark.createDataFrame(drawn, "moment int, table long, name string")
    assert {tuple(r) for r in joins.dropped_close(p, d, "moment").collect()} == {(1, 1, 7, "lost name")}
    assert joins.dropped_close(p, d, "moment", least=4).count() == 0  # three hits only
    assert joins.dropped_close(p, d.limit(0), "moment").count() == 0


def test_a_rule_is_proved_by_damage(spark):
    rule = lambda df: df.where(F.col("text").contains("!"))
    good = spark.createDataFrame([("a",), ("b!",)], "text string")
    worse = lambda df: df.withColumn("text", F.concat("text", F.lit("!")))
    told = lambda df, damage: tuple(quality.proof_by_damage(df, rule, damage).select("verdict", "examined", "before", "after").first())
    assert told(good, worse) == ("PROVED", 2, 1, 2) and told(good, lambda df: df) == ("NOT PROVED", 2, 1, 1) and told(good.limit(0), worse) == ("UNPROVED", 0, 0, 0)


def test_removed_tables_leave_what_was_made_of_them(spark):
    first = stored(spark.range(10), "first")
    second = stored(first.where("id > 6"), "second")
    path = first.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.exists(path)
    removed(first)
    assert not os.path.exists(path) and sorted(r.id for r in second.collect()) == [7, 8, 9]


def test_matched_characters_are_those_of_difflib():
    r = random.Random(1)
    for k in range(4000):
        a, b = ("".join(r.choices(("ab", "abc de1l")[k % 2], k=r.randint(0, 30))) for _ in "ab")
        b = (b, a.replace(" ", ""), a.replace("l", "1"))[k % 3]
        assert fs.matched(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_words_and_console_rows_are_cut_without_a_shuffle_of_words(spark, tmp_path):
    r = random.Random(2)
    texts = ["", " ", "a  b", None, " ".join(f"w{k}é" for k in range(100)) + "\n" + " ".join("x" * r.randint(0, 3) for _ in range(70))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words, console = views.words(spark, str(tmp_path)), views.console(spark, str(tmp_path))
    want, rows = set(), set()
    for doc, text in enumerate(texts):
        for line, one in enumerate([] if text is None else text.split("\n")):
            at, parts = 0, one.split(" ")
            rows |= {(doc, line, k // 12, " ".join(parts[k : k + 12])) for k in range(0, len(parts), 12)}
            for k, w in enumerate(parts):
                want |= {(doc, line, k, w, at * 10, (at + len(w)) * 10)} if w else set()
                at += len(w) + 1
    assert {tuple(x) for x in words.select("doc", "line", "k", "text", "x0", "x1").collect()} == want
    assert {tuple(x) for x in console.select("doc", "line", "row", "a").collect()} == rows
    plan = layout.split_panel(words, "doc", "line")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of whole texts


def test_alike_boxes_in_a_row_are_counted_as_one_by_one(spark):
    r = random.Random(3)
    lines = [(d, n, n * 20 + r.randint(-9, 9), 14 + r.randint(0, 12) * (d == 1), r.randint(1, 9)) for d in range(2) for n in range(60)]
    lines = [x for k, x in enumerate(lines) if not any(x[0] == y[0] and (x[2] == y[2] or 2 * x[2] + x[3] == 2 * y[2] + y[3]) for y in lines[:k])]
    one = spark.createDataFrame([(d, n, k, 10 * k, y, y + h) for d, n, y, h, w in lines for k in range(w)], "doc long, line long, k long, x0 long, y0 long, y1 long")
    many = spark.createDataFrame([(d, n, 0, 0, y, y + h, w) for d, n, y, h, w in lines], "doc long, line long, k long, x0 long, y0 long, y1 long, n long")
    for rule in ("fixed", "mean", "near", "extent"):
        want = {(x.doc, x.row): x["count"] for x in layout.rows_by_rule(one, "doc", rule, height=14.0).groupBy("doc", "row").count().collect()}
        assert {(x.doc, x.row): x.n for x in layout.rows_by_rule(many, "doc", rule, height=14.0).groupBy("doc", "row").agg(F.sum("n").alias("n")).collect()} == want and len(want) > 20


def test_corridors_are_found_by_ranges(spark):
    r = random.Random(4)
    rows = [(d, n, x, x + r.randint(1, 40)) for d in range(30) for n in range(r.randint(1, 6)) for x in r.sample(range(0, 200, 5), r.randint(1, 4))]
    want = set()
    for d in range(30):
        ends = {n: max(b for e, m, _, b in rows if (e, m) == (d, n)) for e, n, *_ in rows if e == d}
        taken = {b for e, _, x, y in rows if e == d for b in range(x // 10, (y - 1) // 10 + 1)}
        free = [b for b in range(min(ends.values()) // 10 + 1) if b not in taken] if len(ends) >= 3 else []
        runs = []
        for b in free:
            if runs and runs[-1][1] == b:
                runs[-1][1] = b + 1
            else:
                runs.append([b, b + 1])
        want |= {(d, a, b) for a, b in runs if b - a >= 2}
    found = layout.blank_corridors(spark.createDataFrame(rows, "doc long, line long, x0 long, x1 long"), "doc", least=2)
    assert {tuple(x) for x in found.collect()} == want and want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row a bin

"""Literal truths of single operators."""

import importlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from screenlake.functions import strings as fs
from screenlake.functions.graph import components
from screenlake.operators import joins, layout, readings, repair, scans, states, votes
from screenlake.sources import views
from screenlake.streaming import carriers


def one(spark, expr, **cols):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


def test_ladder(spark):
    r = lambda a, b: readings.reconciled(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b").first().status
    assert r("notes.md", "") == "unverified"
    assert r("notes.md", "notes.md") == "confident"
    assert r("even ona", "evenona") == "reconciled"
    assert r("a>b", "a-b") == "ambiguous-symbol"
    assert r("l0g", "lOg") == "ambiguous-glyph"
    assert r("alpha", "omega") == "uncertain"


def test_merge_keeps_every_symbol(spark):
    m = one(spark, fs.merged_readings(F.col("a"), F.col("b")), a="even ona...x", b="evenona... x")
    assert m.text == "even ona... x" and m.clashes == 0
    assert one(spark, fs.merged_readings(F.col("a"), F.col("b")), a="ab", b="ac") is None


def test_cut_names(spark):
    assert one(spark, fs.completes(F.col("s"), F.col("f")), s="project_ship…fix.md", f="project_shipment_fix.md")
    assert not one(spark, fs.completes(F.col("s"), F.col("f")), s="plain", f="plain.md")


def test_dates_and_sizes(spark):
    assert one(spark, fs.tidy_date(F.col("s")), s="Jun30,2026at5:51PM") == "Jun 30, 2026 at 5:51 PM"
    assert one(spark, fs.tidy_date(F.col("s")), s="hello") is None
    assert one(spark, fs.tidy_size(F.col("s")), s="2Kb Markdown").size == "2 KB"


def test_kind_of_a_cut_cell(spark):
    assert one(spark, fs.kind_of(F.col("s")), s="Markdo...text fi") == "Markdown text file"
    assert one(spark, fs.kind_of(F.col("s")), s="P…") is None


def test_overlap_splice(spark):
    assert one(spark, joins.overlap_join(F.col("a"), F.col("b")), a="project_sh", b="_shipment.md") == "project_shipment.md"
    assert one(spark, joins.overlap_join(F.col("a"), F.col("b")), a="abc", b="xyz") is None


def test_scrolled_views(spark):
    s = lambda a, b: one(spark, joins.scrolled(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert s("abcde", "cdefg") == list("abcdefg")
    assert s("abc", "abc") == list("abc")
    assert s("abcde", "defgh") is None


def test_running_cue_and_ties(spark):
    screens = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 50, 3)], "video long, start long, seq long")
    cues = spark.createDataFrame([(1, 5, 1, "before"), (1, 10, 2, "at"), (1, 20, 3, "later")], "video long, t long, seq long, text string")
    got = {r.seq: r.said for r in joins.said_on_screens(screens, cues).collect()}
    assert got == {1: "at", 2: "at later", 3: "later"}


def test_transcript_lines(spark):
    df = spark.createDataFrame([("**[1:02:03]** hello",), ("no cue",), ("**[0:00:01]**  ",)], "value string")
    assert [(r.t, r.said) for r in scans.read_cues(df).collect()] == [(3723, "hello")]


def test_parent_paths(spark):
    df = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 1, "b"), (1, 2, 2, "c"), (1, 3, 1, "d")], "t int, pos int, depth int, name string")
    assert [r.path for r in layout.parent_paths(df, ["t"]).orderBy("pos").collect()] == ["a", "a/b", "a/b/c", "a/d"]


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_components_of_a_long_chain(spark):
    n = list(range(200))
    random.Random(1).shuffle(n)
    got = components(spark.createDataFrame(list(zip(n, n[1:], strict=False)), "a long, b long"))
    assert {r.component for r in got.collect()} == {0}


def test_entry():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())


def test_unknown_kinds_of_rows_do_not_fail(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert components(empty).count() == 0


def test_ladder_uses_the_agreed_head(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma Kn", "alpha beta gamma"), (2, "> notes", "notes"), (3, None, "x")], "k int, a string, b string")
    got = {r.k: (r.text, r.status) for r in readings.reconciled(df, "a", "b").collect()}
    assert got[1] == ("alpha beta gamma", "cut") and got[2] == ("notes", "confident")


def test_kind_cells(spark):
    k = lambda s: tuple(one(spark, fs.kind_cell(F.col("s")), s=s))
    assert k("2KB Markdo...text fi") == ("2 KB Markdown text file", "kind completed")
    assert k("49bytesN Markdown text file") == ("49 bytes Markdown text file", "left alone")
    assert k("Pyth0n Script") == ("Python Script", "kind mended")
    assert k("Jun 3, 2026 at 5:51 PM")[1] == "a date in the kind column"
    assert k("something else") == ("something else", "left alone")


def test_kind_cells_work_out_each_part_once(spark):
    cells = spark.range(50_000).select(F.concat(F.lit("Markdo"), (F.col("id") % 7).cast("string"), F.lit("...text fi")).alias("s"))
    plan = cells.select(fs.kind_cell(F.col("s")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 200


def test_day_names_and_separators(spark):
    d = lambda s: one(spark, fs.tidy_date(F.col("s")), s=s)
    assert d("Todayat5.51pM") == "Today at 5:51 PM" and d("jun 3. 2026 at 05°07 am") == "Jun 3, 2026 at 5:07 AM"
    assert d("Jux 3, 2026 at 5:07 AM") is None and d("Jun 3 at 5:07 AM") is None


def test_subsequence_against_brute_force(spark):
    r = random.Random(2)
    rows = [("".join(r.choice("ab") for _ in range(r.randint(0, 4))), "".join(r.choice("abc") for _ in range(r.randint(0, 9)))) for _ in range(80)]

    def inside(x, y):
        return not x or any(y[i] == x[0] and inside(x[1:], y[i + 1 :]) for i in range(len(y)))

    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", fs.subsequence("x", "y").alias("z")).collect()
    assert all(g.z == inside(g.x, g.y) for g in got)


def test_close_names():
    assert fs.close_names("03 Company…pe Company)", "03 Company B (Landscape Company)")
    assert fs.close_names("operatlons", "operations") and fs.close_names("claude.jso", "claude.json")
    assert not fs.close_names("abc", "abd") and not fs.close_names("invoices", "receipts")


def test_respaced_confirmation(spark):
    rows = [(1, 0, "Youenteryouremail.", "You enter your email."), (1, 1, "R78", "nothing"), (1, 2, "straße", "strae"), (1, 3, None, "x")]
    got = {r.line: (r.confirmed, r.text) for r in joins.confirmed_by(spark.createDataFrame(rows, "doc long, line int, a string, b string"), "doc", "line").collect()}
    assert got == {0: (True, "You enter your email."), 1: (False, "R78"), 2: (False, "straße")}


def test_leftovers_by_common_block(spark):
    read = spark.createDataFrame([(1, 0, "Size"), (1, 1, "alpha beta gamma"), (1, 2, "xalphabetagamm"), (1, 3, "zzzz")], "doc long, line int, text string")
    got = joins.leftovers(read, read.where("line = 1"), "doc", "line").collect()
    assert {(r.line, r.place) for r in got} == {(0, "above"), (3, "below")}


def test_suppression_is_ordered(spark):
    # the second is dropped by the first, so the third, which only the second overlaps, stays
    rows = [(1, 1, 0, 0, 100, 100), (1, 2, 40, 0, 130, 100), (1, 3, 105, 0, 150, 100)]
    got = joins.suppressed(spark.createDataFrame(rows, "frame long, id int, x0 long, y0 long, x1 long, y1 long"), "frame")
    assert sorted(r.id for r in got.collect()) == [1, 3]


def test_clusters_are_parted(spark):
    rows = [(1, 1001, 0, 0, 100, 100, 1, True, "a"), (1, 2, 100, 0, 200, 100, 1, True, "a"), (2, 1, 0, 0, 100, 100, None, False, None), (2, 2, 101, 50, 200, 100, 3, False, None), (2, 3, 201, 50, 300, 90, 4, False, None)]
    df = spark.createDataFrame(rows, "frame long, id int, x0 long, y0 long, x1 long, y1 long, window long, is_list boolean, program string")
    got = {(r.frame, r.id): r.cluster for r in joins.touching_clusters(df, "frame", 1000).collect()}
    assert got == {(1, 1001): 1001, (1, 2): 2, (2, 1): 1, (2, 2): 1, (2, 3): 3}
    plain = {(r.frame, r.id): r.cluster for r in joins.touching_clusters(df.drop("window", "is_list", "program"), "frame", 1000).collect()}
    assert plain == {(1, 1001): 2, (1, 2): 2, (2, 1): 1, (2, 2): 1, (2, 3): 1}


def test_unfilled_windows(spark):
    w = spark.createDataFrame([(1, 1, 0, 0, 100, 100), (1, 2, 200, 0, 300, 100)], "frame long, w_id int, w_x0 long, w_y0 long, w_x1 long, w_y1 long")
    box = lambda *r: spark.createDataFrame(list(r), "frame long, p_id int, p_x0 long, p_y0 long, p_x1 long, p_y1 long")
    assert {r.w_id for r in joins.unfilled(w, box((1, 1, 0, 0, 300, 100)), "frame").collect()} == {1, 2}
    assert {r.w_id for r in joins.unfilled(w, box((1, 1, 0, 0, 100, 100)), "frame").collect()} == {2}


def test_near_twins(spark):
    rows = [(1, 1, "x", ".claude.json", 3, True), (1, 2, "x", "claude.jsn", 1, False), (1, 3, "y", ".claude.json", 1, True), (1, 4, "x", "other", 1, True)]
    got = joins.near_twins(spark.createDataFrame(rows, "list long, r long, rest string, name string, votes long, ok boolean"), "list").collect()
    assert {(r.r, r.twins) for r in got} == {(1, 2), (3, 1), (4, 1)}


def test_respelt(spark):
    mine = spark.createDataFrame([(1, 1, "03 CompanyB(Landscape)", ["a", "b"]), (1, 2, "Opekations", ["c", "d"]), (1, 3, "unlike", ["c", "d"])], "list long, r long, name string, cells array<string>")
    known = spark.createDataFrame([(1, 1, "03 Company B (Landscape)", ["z"]), (1, 2, "Operations", ["c", "d", "e"])], "list long, r long, name string, cells array<string>")
    got = {r.r: r.name for r in repair.respelt(mine, known, "list").collect()}
    assert got == {1: "03 Company B (Landscape)", 2: "Operations", 3: "unlike"}


def test_mended_lines_grow_until_none_does(spark):
    rows = [(1, 0, "one two three four five six seven eight"), (2, 0, "one two three four five six seven eight nine ten"), (3, 0, "zero one two three four five six seven eight nine ten")]
    got = {r.doc: r.text for r in repair.mended_lines(spark.createDataFrame(rows, "doc long, line int, text string")).collect()}
    assert got[1].endswith("nine ten") and set(got) == {1, 2, 3}


def test_mended_lines_do_not_feed_each_other(spark):
    rows = [(1, 0, "one two three four five six idiot and idiot end"), (2, 0, "one two three four five six and idiot and end"), (3, 0, " ".join(f"w{k}" for k in range(40)))]
    got = {r.doc: r.text for r in repair.mended_lines(spark.createDataFrame(rows, "doc long, line int, text string")).collect()}
    assert got[3] == rows[2][2] and all(len(rows[d - 1][2]) < len(got[d]) and len(got[d].split(" ")) <= 12 for d in (1, 2)), got


def test_lines_that_cannot_agree_ship_no_texts(spark, monkeypatch):
    near, keep = [], repair.stored

    def stored(df, name):
        out = keep(df, name)
        if name == "near":
            near.append(out.count())
        return out

    monkeypatch.setattr(repair, "stored", stored)
    common = "in the end of the day"
    rows = [(k, 0, " ".join(f"w{k}x{j}" for j in range(15)) + f" {common}") for k in range(40)] + [(90, 0, "a b c d e f g"), (91, 0, "a b c d e f g h")]
    got = {r.doc: r.text for r in repair.mended_lines(spark.createDataFrame(rows, "doc long, line int, text string")).collect()}
    assert got == {d: t for d, _, t in rows} | {90: "a b c d e f g h"} and near[0] < 79  # of 781 that share a shingle


def test_fragment_lines_meet_by_the_index_of_grams(spark, monkeypatch):
    asked, search = [], repair.occurrences
    monkeypatch.setattr(repair, "occurrences", lambda *a: asked.append(1) or search(*a))
    f = spark.createDataFrame([(1, "abcdefghijklm"), (1, "nopqrstuvwxyzab"), (1, "short")], "frag long, fold string")
    w = spark.createDataFrame([(2, "xxabcdefghijklmyy"), (2, "opqrstuvwxyz"), (2, "short"), (4, "abcdefghijklm")], "win long, fold string")
    assert [tuple(r) for r in repair.fragment_owner(f, w, least=2).collect()] == [(1, "2")] and len(asked) == 2


def test_furniture_meets_by_the_index_of_grams(spark, monkeypatch):
    asked, search = [], repair.occurrences
    monkeypatch.setattr(repair, "occurrences", lambda *a: asked.append(1) or search(*a))
    lines = spark.createDataFrame([(1, k, 7, t) for k, t in enumerate(["Menu bar of", "the menu bar of it all", "menu bar of it all, twice", ".menu bar of", "menu bar", "another line"])] + [(2, 0, 8, "menu bar of")], "doc long, line int, video long, text string")
    strip = spark.createDataFrame([(7, "menu bar of it all")], "video long, text string")
    got = sorted((r.doc, r.line) for r in repair.without_furniture(lines, strip).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 0)] and len(asked) == 2


def test_medoid_counts_copies(spark):
    rows = [(1, k, x) for k, x in enumerate(["notes.md", "notes.md", "n0tes.md", "other.txt"])]
    df = spark.createDataFrame(rows, "entity long, rid long, reading string")
    assert votes.medoid(df, "entity", fs.seq_ratio).first().medoid == "notes.md"


def test_first_cells_of_tables(spark):
    html = "<table><tr><th>Name</th></tr><tr><td><b>a</b>\n b</td><td>c</td></tr><tr></tr></table><p>x</p><table><tr><td>z</td></tr></table>"
    assert one(spark, scans.html_first_cells(F.col("h")), h=html) == [["Name", "a b"], ["z"]]


def test_busy_pictures(spark):
    v = [(1, cx, cy, 17 * ((k * 5 + cx) % 16)) for cx in range(3) for cy in range(2) for k in range(16)]
    values = spark.createDataFrame(v, "burst long, cx int, cy int, v long")
    none = spark.createDataFrame([], "burst long, x0 int, y0 int, x1 int, y1 int")
    assert [tuple(r) for r in votes.busy_pictures(values, none, "burst", 4).collect()] == [(1, 6, 0, 0, 12, 8)]
    text = spark.createDataFrame([(1, 0, 0, 12, 4)], "burst long, x0 int, y0 int, x1 int, y1 int")
    assert votes.busy_pictures(values, text, "burst", 4).count() == 0


def test_rows_by_each_rule(spark):
    ys = [(0, 10), (4, 14), (8, 18), (12, 22), (30, 40), (31, 41)]
    w = spark.createDataFrame([(1, 0, k, y0, y1, 10 * k) for k, (y0, y1) in enumerate(ys)], "doc long, line long, k long, y0 long, y1 long, x0 long")
    rows = lambda rule: [r["row"] for r in layout.rows_by_rule(w, "doc", rule, height=10.0).orderBy("k").collect()]
    assert rows("fixed") == [1, 1, 2, 2, 3, 3]
    assert rows("mean") == [1, 1, 2, 2, 3, 3]
    assert rows("near") == [1, 1, 1, 2, 3, 3]
    assert rows("extent") == [1, 1, 1, 1, 2, 2]


def test_margins_and_columns(spark):
    starts = [(1, 0, 288), (1, 0, 584), (1, 1, 587), (1, 2, 588), (1, 2, 640), (1, 3, 590)]
    w = spark.createDataFrame(starts, "doc long, line long, x0 long")
    assert [tuple(r) for r in layout.text_margin(w, "doc", 12.0).collect()] == [(1, 584.0)]
    assert [tuple(r) for r in layout.left_edge(w, "doc", "line").collect()] == [(1, 587)]
    assert layout.guide_columns(w, "doc").count() == 0  # on every row: a border
    assert [tuple(r) for r in layout.guide_columns(w.union(spark.createDataFrame([(1, 4, 900)], w.schema)), "doc").collect()] == [(1, 587)]
    b = spark.createDataFrame([(1, 0, 50), (1, 8, 90), (1, 16, 60), (1, 40, 80)], "doc long, x0 long, x1 long")
    assert sorted(tuple(r)[2:] for r in layout.column_bands(b, "doc", 12.0).collect()) == [(0, 90), (16, 60), (40, 80)]


def test_longer_heads_complete_a_tail(spark):
    rows = [(1, 1, "project_ship…ment_fix.md"), (2, 1, "project_shipment_f…x"), (3, 1, "other…end.md"), (4, 2, "pro…t.md"), (5, 2, "project.md"), (6, 2, "prospect.md")]
    df = spark.createDataFrame(rows, "key long, seen_at long, reading string")
    got = {r.key: r.name for r in repair.whole_names(df, df, "seen_at").collect()}
    assert got == {1: "project_shipment_fix.md", 2: "project_shipment_f…x", 3: "other…end.md", 4: "pro…t.md"}


def test_retitling_spares_good_titles(spark):
    paths = spark.createDataFrame([(1, ["root", "docs", "a", "x"]), (2, ["root", "docs", "b"])], "path_id long, path array<string>")
    rows = [(1, "a", None, False), (1, "b", None, False), (2, "a", "Good", False), (2, "b", "Good", False), (3, "a", "…", True), (3, "q", "…", True), (3, "r", "…", True), (4, "x", None, None)]
    got = repair.retitled(spark.createDataFrame(rows, "list long, name string, title string, weak boolean"), paths)
    assert {(r.list, r.title) for r in got.collect()} == {(1, "docs"), (4, "a")}


def test_numbered_families(spark):
    rows = [(1, 1, "01 Plans"), (1, 2, "02 Notes"), (1, 3, "O3Company"), (1, 4, "Ox"), (2, 5, "O3Company")]
    got = {r.key: r.name for r in repair.mended_numbers(spark.createDataFrame(rows, "seen_at long, key long, name string"), "seen_at").collect()}
    assert got[3] == "03 Company" and got[4] == "Ox" and got[5] == "O3Company"


def test_fragment_owner_by_containment(spark):
    f = spark.createDataFrame([(1, "alphabetagamma"), (1, "deltaepsilonzeta"), (2, "short")], "frag long, fold string")
    w = spark.createDataFrame([(7, "xxalphabetagammayy"), (7, "epsilonzeta"), (8, "short"), (9, "deltaepsilonzeta")], "win long, fold string")
    assert {(r.frag, r.owner) for r in repair.fragment_owner(f, w, least=2).collect()} == {(1, "7")}


def test_fragment_owner_does_not_pair_by_common_lines(spark, monkeypatch):
    r = random.Random(2)
    docs = {d: [f"verycommonline{k}" for k in range(2) if r.random() < 0.9] + [f"line{r.randrange(60):02d}of the rest" for _ in range(3)] for d in range(120)}
    docs |= {1000: ["verycommonline0", "only here and there"], 1001: ["verycommonline0", "xx only here and there yy"]}
    rows, sizes, keep = [(d, t) for d, ts in docs.items() for t in ts], {}, repair.stored
    monkeypatch.setattr(repair, "stored", lambda df, name: (out := keep(df, name), sizes.update({name: out.count()}))[0])
    df = spark.createDataFrame(rows, "d long, fold string")
    for least in (2, 3):
        got = {x.frag: x.owner for x in repair.fragment_owner(df.where("d % 2 = 1").withColumnRenamed("d", "frag"), df.where("d % 2 = 0").withColumnRenamed("d", "win"), least=least).collect()}
        want = {}
        for a in (d for d in docs if d % 2):
            n = sorted((-sum(any(x == y or len(x) >= 10 and x in y or len(y) >= 10 and y in x for y in docs[b]) for x in set(docs[a])), b) for b in docs if not b % 2)
            if -n[0][0] >= least:
                want[a] = "several" if -n[1][0] >= least else str(n[0][1])
        assert got == want and got
        assert sizes["settled"] > 20 and sizes["shown"] < 60 * 62


def test_titles_one_letter_off_and_held(spark):
    t = spark.createDataFrame([(1, 0, "operatlons"), (1, 0, "unlike"), (1, 0, "invoice")], "video long, t long, key string")
    known = spark.createDataFrame([("operations",), ("invoice",), ("invoicd",), ("My Operations Review",), ("operations review long",)], "key string")
    assert {r.key: r.spelt for r in joins.known_titles(t, known).collect()} == {"operatlons": "operations", "unlike": "unlike", "invoice": "invoice"}
    kept = spark.createDataFrame([(1, "Operations"), (1, "review")], "strip long, key string")
    assert joins.holding_titles(kept, known, ["strip"]).first().title == "My Operations Review"


def test_all_panes_must_agree(spark):
    rows = [(1, 1, list("abcde"), list("cdefg")), (1, 2, list("abc"), list("abc")), (2, 1, list("abcde"), list("cdefg")), (2, 2, list("abc"), list("xyz"))]
    got = joins.scrolled_panes(spark.createDataFrame(rows, "moment long, pane long, before array<string>, after array<string>"), "moment")
    assert {(r.moment, r.pane, "".join(r.view)) for r in got.collect()} == {(1, 1, "abcdefg"), (1, 2, "abc")}


def test_panel_needs_a_gap_on_every_line(spark):
    rows = [(1, 0, 0, "a", 0, 10), (1, 0, 1, "b", 40, 50), (1, 1, 0, "c", 0, 10), (1, 1, 1, "d", 60, 70), (2, 0, 0, "a", 0, 10), (2, 0, 1, "b", 40, 50), (2, 1, 0, "c", 0, 10), (2, 1, 1, "d", 12, 20)]
    w = spark.createDataFrame(rows, "doc long, line long, k long, text string, x0 long, x1 long").withColumns({"y0": F.lit(0), "y1": F.lit(14)})
    assert {tuple(r) for r in layout.split_panel(w, "doc", "line").collect()} == {(1, 0, "a", "b"), (1, 1, "c", "d")}


def test_greedy_pairs_spend_each_side_once(spark):
    cols = ["frame", *(f"{p}_{c}" for p in "pw" for c in ("id", "x0", "y0", "x1", "y1"))]
    box = {1: (0, 0, 10, 10), 2: (0, 0, 10, 8)}
    rows = [(1, p, *box[p], w, *box[w]) for p in (1, 2) for w in (1, 2)] + [(1, 1, *box[1], 3, 5, 0, 15, 10)]
    got = joins.greedy_pairs(spark.createDataFrame(rows, cols), "frame").collect()
    assert {(r.p_id, r.w_id, r.fault) for r in got} == {(1, 1, False), (2, 2, False)}


def test_accents_ratios_and_programs(spark):
    assert one(spark, fs.accent_fold(F.col("s")), s="Éß Ünï-7") == "euni7" and one(spark, fs.seq_ratio("a", "b"), a="abcd", b="bcde") == 0.75
    df = spark.createDataFrame([(1, "smal window"), (2, "zzz q")], "key long, reading string")
    assert {r.key: r.program for r in readings.program_names(df, ["small", "blue"]).collect()} == {1: "small", 2: None}


def test_merged_runs_keep_the_longest(spark):
    rows = [(1, "h", 0, 0, 10), (1, "h", 2, 5, 30), (1, "h", 9, 0, 5), (1, "v", 1, 0, 10)]
    got = layout.merged_runs(spark.createDataFrame(rows, "frame long, axis string, pos long, a long, b long"), "frame").collect()
    assert {tuple(r)[1:] for r in got} == {("h", 2, 5, 30), ("h", 9, 0, 5), ("v", 1, 0, 10)}


def test_letter_swaps(spark):
    df = spark.createDataFrame([("lol", "l0l"), ("oo", "00"), ("abc", "abc"), (None, "x")], "a string, b string")
    assert {tuple(r) for r in votes.letter_swaps(df).collect()} == {("o", "0", 1), ("oo", "00", 1)}


def test_states_of_a_window(spark):
    say = lambda ts, *lines: [(1, ts, k, x) for k, x in enumerate(lines)]
    rows = say(1, *"abcde") + say(2, *"cdefg") + say(3, *"cdefg") + say(4, "other", "thing")
    df = spark.createDataFrame(rows, "video long, ts long, seq int, said string")
    got = [tuple(r) for r in states.window_states(df).orderBy("first").collect()]
    assert got[0][:3] == (1, 1, 3) or got[0][:3] == (1, 1, 2)
    assert got[-1] == (1, 4, 4, 1, 2) and got[0][4] >= 7
    built = [tuple(r) for r in states.built_states(df).orderBy("state").collect()]
    assert built == [(1, 0, 1, 3, 7), (1, 1, 4, 4, 2)]



def test_paths_mend_between_anchors_only():
    assert layout.mended_path([["HD", "Users", "docs"], ["HD", "Users", "jared", "docs"], ["docs", "more"]]) == ["HD", "Users", "jared", "docs"]
    assert layout.mended_path([["HD", "docs", "x"], ["HD", "Users", "docs"]]) == ["HD", "Users", "docs", "x"]
    assert layout.mended_path([["HD", "Usersjared", "jared", "jared"]]) == ["HD", "Users", "jared"]
    assert layout.mended_path([["junk", "HD", "a"]], root="hd") == ["HD", "a"] and layout.mended_path([[], []]) == []


def test_carried_words_against_all_pairs(spark):
    rows = [(n % 3, n // 3 % 40, n, n * 37 % 300, n * 53 % 200, n * 37 % 300 + 20 + n % 7 * 10, n * 53 % 200 + 30, None if n % 4 == 0 else f"w{n}") for n in range(400)]
    near = lambda a, b: a[0] == b[0] and b[7] is not None and b[1] < a[1] and all(abs(x - y) <= 25 for x, y in zip(a[3:7], b[3:7], strict=True))
    want = {(a[0], a[1], a[2], *max((b[1:3], b[7], b[1]) for b in rows if near(a, b))[1:]) for a in rows if a[7] is None and any(near(a, b) for b in rows)}
    told = joins.carried_words(spark.createDataFrame(rows, "video long, t long, id long, x0 long, y0 long, x1 long, y1 long, words string"), "video", 25)
    assert {tuple(x) for x in told.collect()} == want and len(want) > 20
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_headings_are_told_without_a_shuffle(spark, sf):
    from screenlake.plans import catalog

    assert "Exchange" not in catalog.QUERIES["F17_heading_words"](spark, sf)._jdf.queryExecution().toString()


def test_tiles_of_a_frame_are_one_fold(spark, sf):
    """An edge counts though the other is unknown, a span of unknown ends frees nothing, and rectangles are dealt out once, not by band."""
    from screenlake.operators import layout
    from screenlake.plans import catalog

    rects = [(1, 5, 0, 10, 10), (1, 0, 4, 1, None), (1, None, 0, None, 10), (2, 0, 0, 20, 5)]
    got = layout.uncovered_tiles(spark.createDataFrame(rects, "frame long, x0 long, y0 long, x1 long, y1 long"), "frame", 20).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 4, 0, 5), (1, 0, 4, 10, 20), (1, 4, 10, 0, 5), (1, 4, 10, 10, 20)]
    plan = catalog.QUERIES["W26_residual_tiles"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan

"""Completion across moments: what one moment lost and another one read."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions import strings as fs
from screenlake.functions.folds import fold_sorted
from screenlake.functions.storage import removed, stored
from screenlake.operators.joins import overlap_join
from screenlake.operators.layout import ordered_text
from screenlake.operators.sameness import shared_share
from screenlake.operators.substrings import longest_after, occurrences


def same_lists(rows: DataFrame, group: str, least: float = 0.5) -> DataFrame:
    """(a, b, shared, how): lists of one group that share half of the smaller's names, or where one's last three rows hold the other's first.

    Candidates come from an equality join on the rarest names of the smaller list inside a group.
    """
    sets = rows.groupBy(F.col("list").alias("id"), F.col(group).alias("grp")).agg(F.collect_set("name").alias("names"))
    own = lambda c: sets.select(F.col("id").alias(c), F.col("names").alias(f"n{c}"))
    shared = F.size(F.array_intersect("na", "nb")).cast("long")
    half = shared_share(sets, least).join(own("a"), "a").join(own("b"), "b").select("a", "b", shared.alias("shared"), F.lit("names").alias("how"))
    desc = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("r")))
    last = rows.withColumn("_d", desc).where("_d <= 3").select(group, F.col("list").alias("a"), "name")
    first = rows.where("r = 1").select(group, F.col("list").alias("b"), "name")
    ends = last.join(first, [group, "name"]).where("a < b").select("a", "b").distinct().join(half.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.lit(1).cast("long").alias("shared"), F.lit("ends").alias("how"))
    return half.unionByName(ends)


def whole_names(cut: DataFrame, pool: DataFrame, group: str, overlap: int = 4) -> DataFrame:
    """(key, name): a cut name's only whole one in its pool with that head and tail; two candidates leave it as it is.

    Where there is none, the only longer head of another cut name that begins with its head and ends in ``overlap`` letters and more of its tail's beginning completes it.
    """
    parts = fs.cut_parts(F.col("reading"))
    whole = pool.where(parts.isNull()).select(group, F.col("reading").alias("whole"), fs.flat(F.col("reading")).alias("fold")).distinct()
    c = cut.where(parts.isNotNull())
    fits = c.join(whole, group).where(fs.completes(F.col("reading"), F.col("whole"))).groupBy("key").agg(F.count_distinct("fold").alias("n"), F.min("whole").alias("whole"))
    ends = c.select("key", group, parts.getField("head").alias("head"), parts.getField("tail").alias("tail"))
    heads = pool.where(parts.isNotNull()).select(group, parts.getField("head").alias("longer")).distinct()
    met = ends.join(heads, group).where(F.startswith("longer", "head") & (F.length("longer") > F.length("head"))).withColumn("spliced", overlap_join(F.col("longer"), F.col("tail"), least=overlap))
    spliced = met.where("spliced is not null").groupBy("key").agg(F.count_distinct(fs.flat(F.col("spliced"))).alias("m"), F.min("spliced").alias("spliced"))
    told = c.join(fits, "key", "left").join(spliced, "key", "left")
    return told.select("key", F.when(F.col("n") == 1, F.col("whole")).when(F.col("n").isNull() & (F.col("m") == 1), F.col("spliced")).otherwise(F.col("reading")).alias("name"))


def retitled(lists: DataFrame, paths: DataFrame, quorum: int = 2, small: int = 2) -> DataFrame:
    """(list, title): the parent that most rows have in the paths, ties by name; a quorum of rows must have it, one for a list without title or of ``small`` rows at most.

    ``title`` and ``weak`` are optional columns of the lists: only a missing or weak title is replaced.
    """
    edges = paths.select("path_id", F.posexplode("path").alias("pos", "crumb")).withColumn("parent", F.lag("crumb").over(Window.partitionBy("path_id").orderBy("pos"))).where("parent is not null")
    first = edges.groupBy(fs.flat(F.col("crumb")).alias("fold")).agg(F.min(F.struct("path_id", "pos", "parent")).getField("parent").alias("parent"))
    have = lambda c, kind: F.max(c) if c in lists.columns else F.max(F.lit(None).cast(kind))
    about = lists.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), have("title", "string").alias("was"), have("weak", "boolean").alias("weak"))
    votes = lists.select("list", fs.flat(F.col("name")).alias("fold")).join(first, "fold").groupBy("list", "parent").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("list").agg(F.max(F.struct("n", "parent")).alias("m")).join(about, "list")
    untitled = F.coalesce(F.trim("was"), F.lit("")) == ""
    need = F.when(untitled | (F.col("rows") <= small), 1).otherwise(quorum)
    return best.where((untitled | F.coalesce("weak", F.lit(False))) & (F.col("m.n") >= need)).select("list", F.col("m.parent").alias("title"))


def mended_lines(lines: DataFrame, least: int = 5, share: float = 0.55, most: float = 1.5) -> DataFrame:
    """(doc, line, text): a line takes the words that another reading of it has more of, where both agree on ``least`` words and a share of the shorter.

    Equal lines are one. Candidates share three three-word shingles: two lines that do share one besides each one's two commonest, so these are not joined on.
    Mended lines are compared again with the lines as they were read until none grows, as in the system under study; grown lines are no evidence for each other, else two of them can feed each other
    without end ("and idiot and idiot and ..."). None gets more than ``most`` times the words of the longest line.
    Lines meet as numbers with a bitmap of their words, repeats apart: each bit that only one of the two has is a word that cannot agree. Texts are fetched for pairs that can still agree on enough.
    A merge allows no contradiction, which the ends of two lines tell first: these travel instead of texts. What passes is compared in full where the longest common subsequence, which no matching blocks pass, does.
    """
    import difflib

    maps = 8  # of 64 bits
    spark = lines.sparkSession

    def common(p: list[str], q: list[str]) -> int:
        places: dict[str, int] = {}
        for i, w in enumerate(p):
            places[w] = places.get(w, 0) | 1 << i
        every = open_ = (1 << len(p)) - 1
        for w in q:
            if w in places:
                met = open_ & places[w]
                open_ = (open_ + met | open_ - met) & every
        return len(p) - open_.bit_count()

    def merge(x: str, y: str, p: list[str], q: list[str]) -> str:
        ops = difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes()
        same = sum(i2 - i1 for op, i1, i2, _, _ in ops if op == "equal")
        if same < least or same < share * min(len(p), len(q)):
            return x
        out: list[str] = []
        for op, i1, i2, j1, j2 in ops:
            if op == "insert" and out:
                out += q[j1:j2]
            elif op == "replace":
                cut, run = " ".join(p[i1:i2]), " ".join(q[j1:j2])
                if not (run.startswith(cut) or run.endswith(cut)):
                    return x
                out += q[j1:j2]
            else:
                out += p[i1:i2]
        return " ".join(out) if len(p) < len(out) <= most * len(p) else x

    def run(it):
        for pdf in it:
            grown = []
            for a, b, back in zip(pdf["ta"], pdf["tb"], pdf["back"], strict=True):
                p, q = a.split(" "), b.split(" ")
                if common(p, q) >= max(least, share * min(len(p), len(q))):
                    grown += [(a, merge(a, b, p, q))] + [(b, merge(b, a, q, p))] * back
            yield pd.DataFrame([r for r in grown if r[0] != r[1]], columns=["was", "text"], dtype="object")

    @F.pandas_udf("array<long>")
    def bitmap(texts: pd.Series) -> pd.Series:
        def bits(text: str) -> list[int]:
            out, seen = np.zeros(64 * maps, np.uint8), {}
            for w in text.split(" "):
                seen[w] = seen.get(w, 0) + 1
            out[[zlib.crc32(w.encode(), k) % len(out) for w, n in seen.items() for k in range(n)]] = 1
            return np.packbits(out).view(np.int64).tolist()

        return texts.map(bits)

    def read(texts: DataFrame) -> DataFrame:
        """Distinct texts that are long enough, by number."""
        return texts.select("text").where(F.size(F.split("text", " ")) >= 6).distinct().select(F.xxhash64("text").alias("id"), F.size(F.split("text", " ")).alias("size"), "text", bitmap("text").alias("bits"))

    def shingled(t: DataFrame) -> DataFrame:
        at = F.sequence(F.lit(0), F.col("size") - 3)
        words = t.select("id", "size", F.split("text", " ").alias("w"))
        return words.select("id", F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))).alias("s"))

    def meeting(one: DataFrame, own: DataFrame, other: DataFrame, pool: DataFrame) -> DataFrame:
        """(a, b): numbers in ``own`` and ``pool`` of texts that share a shingle and may agree; where both are the same, each pair once."""
        held = lambda k, t, c: k.join(t.select("id", "size", *(F.get("bits", i).alias(f"b{i}") for i in range(maps))), "id").withColumnsRenamed({"id": c, "size": f"n{c}"} | {f"b{i}": f"{c}{i}" for i in range(maps)})
        alone = lambda x, y: sum((F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(f"{y}{i}"))) for i in range(maps)), F.lit(0))
        can = F.least(F.col("na") - alone("a", "b"), F.col("nb") - alone("b", "a")) >= F.greatest(F.lit(least), share * F.least("na", "nb"))
        return held(one, own, "a").join(held(other, pool, "b"), "s").where("a < b" if own is pool else "a <> b").where(can).select("a", "b").distinct()

    def ends(t: DataFrame, c: str) -> DataFrame:
        """The first two and the last two words of each text."""
        word = lambda n, i: F.substring_index(F.substring_index("text", " ", n), " ", i)
        return t.select(F.col("id").alias(c), word(1, 1).alias("w0"), word(2, -1).alias("w1"), word(-1, 1).alias("v0"), word(-2, 1).alias("v1"))

    def fits() -> tuple[Column, Column]:
        """Whether a matching with ``text`` can begin, and end, without contradiction at the ends of the other: at its last word, or next to it where a run of ``text`` begins or ends with that word."""
        sp, text = F.lit(" "), F.concat(F.lit(" "), "text", F.lit(" "))
        has = lambda *parts: F.contains(text, F.concat(*parts))
        head = has(sp, "w0", sp) | F.startswith(F.col("text"), F.col("w0")) & has(sp, "w1", sp) | has("w0", sp, "w1", sp)
        tail = has(sp, "v0", sp) | F.endswith(F.col("text"), F.col("v0")) & has(sp, "v1", sp) | has(sp, "v1", sp, "v0")
        return head, tail

    def mended(near: DataFrame, own: DataFrame, pool: DataFrame) -> DataFrame:
        text = lambda t, c: t.select(F.col("id").alias(c), "text")
        head, tail = fits()
        there = near.join(ends(own, "a"), "a").join(text(pool, "b"), "b").select("a", "b", head.alias("head"), tail.alias("tail"))
        here = there.join(ends(pool, "b"), "b").join(text(own, "a"), "a").where((F.col("head") | head) & (F.col("tail") | tail)).select(F.col("text").alias("ta"), "b")
        pairs = here.join(text(pool, "b").withColumnRenamed("text", "tb"), "b").select("ta", "tb", F.lit(own is pool).alias("back"))
        merged = pairs.mapInPandas(run, "was string, text string").where(F.size(F.split("text", " ")) <= longest)
        best = merged.groupBy("was").agg(F.max(F.struct(F.length("text").alias("n"), "text")).getField("text").alias("text"))
        return best.select(F.xxhash64("was").alias("id"), F.xxhash64("text").alias("to"), "text")

    longest = most * (lines.agg(F.max(F.size(F.split("text", " ")))).first()[0] or 0)
    pool = stored(read(lines), "texts")
    s = shingled(pool)
    s = s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("s"))).where("n > 1")
    k = stored(s.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "s"))).where("turn > 2").select("id", "s"), "shingles")
    own, near, steps = pool, stored(meeting(k, pool, k, pool), "near"), []
    removed(k)
    while True:  # a line only grows, and never beyond ``longest``
        grown = stored(mended(near, own, pool), "mended")
        removed(near)
        if grown.isEmpty():
            break
        steps.append(grown)
        fresh = read(grown).join(pool.select("id"), "id", "left_anti")
        for done in steps[:-1]:  # what a text grows to does not depend on the round
            fresh = fresh.join(done.select(F.col("to").alias("id")), "id", "left_anti")
        own = stored(fresh, "texts")
        new = stored(shingled(own), "shingles")
        near = stored(meeting(new, own, shingled(pool).join(new.select("s").distinct(), "s", "left_semi"), pool), "near")
        removed(new)
    if not steps:
        return lines.select("doc", "line", "text")
    ways = stored(reduce(DataFrame.unionByName, steps), "ways")
    for _ in range(len(steps).bit_length()):  # each time twice as far
        ways = stored(ways.alias("x").join(ways.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("text").alias("now")), "to", "left").select("id", F.coalesce("far", "to").alias("to"), F.coalesce("now", "text").alias("text")), "ways")
    known = lines.withColumn("id", F.xxhash64("text")).join(ways.select("id", F.col("text").alias("now")), "id", "left")
    return known.select("doc", "line", F.coalesce("now", "text").alias("text"))


def tail_completion(lines: DataFrame, least: int = 16, piece: int = 14, tail: int = 8, most: int = 220) -> DataFrame:
    """(doc, line, tail): an unfinished line whose last letters stand in another document takes the longest tail; ties by text."""
    fold = lines.select("doc", "line", "text", fs.flat(F.col("text")).alias("f"))
    cut = fold.where(~F.trim("text").rlike("[.,:;?!]$") & (F.length("f") >= least)).select("doc", "line", F.right("f", F.lit(piece)).alias("p"))
    # the two documents with the longest tails are enough: one of them is another one
    best = longest_after(cut.select(F.col("p").alias("piece")), fold.select("doc", F.col("f").alias("text")), piece, tail, most).select(F.col("piece").alias("p"), F.col("doc").alias("other"), "n", "t")
    hit = cut.join(best, "p").where(F.col("other") != F.col("doc"))
    return hit.groupBy("doc", "line").agg(F.max(F.struct("n", "t")).getField("t").alias("tail"))


def window_completion(lines: DataFrame, least: int = 12, held: int = 24, same: int = 40) -> DataFrame:
    """(doc, line, whole): an unfinished line of ``least`` letters takes the one longer line of its window (doc) that holds its first ``held`` letters, as folded letters.

    Longer lines of the same first ``same`` letters are one, the longest of them; where two unlike lines fit, none is taken.
    """
    fold = lines.select("doc", "line", "text", fs.flat(F.col("text")).alias("f"))
    cut = fold.where(~F.trim("text").rlike("[.,:;?!]$") & (F.length("f") >= least)).select("doc", "line", "f", F.left("f", F.lit(held)).alias("needle"))
    found = occurrences(cut.select("doc", "needle"), fold.select("doc", F.col("f").alias("text")), least, ["doc"]).select("doc", "needle", "text").distinct()
    fits = cut.join(found, ["doc", "needle"]).where(F.length("text") > F.length("f"))
    one = fits.groupBy("doc", "line").agg(F.count_distinct(F.left("text", F.lit(same))).alias("n"), F.max(F.struct(F.length("text").alias("n"), "text")).getField("text").alias("whole"))
    return one.where("n = 1").select("doc", "line", "whole")


def mended_tree(mine: DataFrame, whole: DataFrame, key: str, least: int = 3, share: float = 0.6) -> DataFrame:
    """(key, name, depth, mark): depth from the whole tree, the mark as this stretch read it; trees that match too little stay as they are."""
    w = whole.groupBy("name").agg(F.min("depth").alias("w_depth"), F.count(F.lit(1)).alias("twice")).where("twice = 1").drop("twice")
    j = mine.join(w, "name", "left")
    n = j.groupBy(key).agg(F.count("w_depth").alias("hit"), F.count(F.lit(1)).alias("n")).select(key, ((F.col("hit") >= least) & (F.col("hit") >= share * F.col("n"))).alias("ok"))
    return j.join(n, key).select(key, "name", F.when(F.col("ok"), F.coalesce("w_depth", "depth")).otherwise(F.col("depth")).alias("depth"), "mark")


def filled_cells(mine: DataFrame, full: DataFrame, key: str, cols: list[str], dates: tuple[str, ...] = (), kinds: tuple[str, ...] = ()) -> DataFrame:
    """Cells of ``mine`` mended from the settled list's row of that name: blank ones, dates that do not parse where the settled one does, and kinds read cut where it is whole."""
    f = full.select(key, "name", *(F.col(c).alias(f"f_{c}") for c in cols)).dropDuplicates([key, "name"])
    j = mine.join(f, [key, "name"], "left")

    def mended(c: str) -> Column:
        worse = F.col(c) == ""
        if c in dates:
            worse |= fs.tidy_date(F.col(c)).isNull() & fs.tidy_date(F.col(f"f_{c}")).isNotNull()
        if c in kinds:
            worse |= fs.cut_parts(F.col(c)).isNotNull() & fs.cut_parts(F.col(f"f_{c}")).isNull()
        return F.when(worse, F.coalesce(f"f_{c}", F.col(c))).otherwise(F.col(c)).alias(c)

    return j.select(key, "name", *map(mended, cols))


def filled_rows(mine: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """(key, name): the settled list's rows that stand between the first and the last matched row and are missing here; two matches are needed."""
    m = mine.select(key, "name").distinct()
    span = full.join(m, [key, "name"], "left_semi").groupBy(key).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return full.join(span, key).where("pos > lo and pos < hi").join(m, [key, "name"], "left_anti").select(key, "name")


def _spelling(name: str) -> Column:
    marks, caps = F.length(F.regexp_replace(name, "[A-Za-z0-9 ]", "")), F.length(F.regexp_replace(name, "[^A-Z]", ""))
    return F.struct(marks.alias("m"), caps.alias("c"), F.length(name).alias("n"), F.col(name).alias("name"))


def settled_spelling(readings: DataFrame, keys: list[str], name: str = "reading") -> DataFrame:
    """``readings`` with ``settled``: of equal folds the spelling with most marks, then capitals, then length."""
    fold = fs.flat(F.col(name))
    best = readings.groupBy(*keys, fold.alias("_f")).agg(F.max(_spelling(name)).getField("name").alias("settled"))
    return readings.withColumn("_f", fold).join(best, [*keys, "_f"]).drop("_f")


def respelt(rows: DataFrame, settled: DataFrame, key: str) -> DataFrame:
    """(key, r, name): a name takes the settled list's first spelling that is alike: equal folds, or a ratio of 0.88, or 0.80 where two other cells and more agree.

    Of equal folds the one with more marks, then capitals, then letters stands. ``cells`` are a row's other cells. A list is what one window holds.
    """

    def weight(s: str) -> tuple:
        return sum(not c.isalnum() for c in s), sum(c.isupper() for c in s), len(s)

    def fold(group: list[tuple]) -> list[tuple]:
        known, out = [g for g in group if g[1] == 0], []
        for k, side, r, name, cells in group:
            if side == 0:
                continue
            own = [fs.folded(c)[0] for c in cells if c]
            for _, _, _, other, theirs in known:
                rest = len(own) >= 2 and set(own) <= {fs.folded(c)[0] for c in theirs if c}
                if name and other and fs.folded(name)[0] and fs.alike(name, other, 0.8 if rest else 0.88):
                    same = fs.folded(name)[0] == fs.folded(other)[0]
                    name = name if same and weight(name) > weight(other) else other
                    break
            out.append((k, r, name))
        return out

    full = lambda df, side: df.select(key, F.lit(side).alias("side"), "r", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("cells", F.array().cast("array<string>")).alias("cells"))
    both = full(settled, 0).union(full(rows, 1))
    return fold_sorted(both, key, ["side", "r"], f"{key} long, r long, name string", fold)


def canonical(names: DataFrame, name: str = "reading") -> DataFrame:
    """(fold, canonical, n): most capitals, then marks, then length stands for all readings of a fold."""
    s = F.struct(F.length(F.regexp_replace(name, "[^A-Z]", "")).alias("c"), F.length(F.regexp_replace(name, "[A-Za-z0-9 ]", "")).alias("m"), F.length(name).alias("n"), F.col(name).alias("name"))
    return names.where(fs.cut_parts(F.col(name)).isNull()).groupBy(fs.flat(F.col(name)).alias("fold")).agg(F.max(s).getField("name").alias("canonical"), F.count(F.lit(1)).alias("n"))


def mended_numbers(names: DataFrame, group: str, least: int = 2) -> DataFrame:
    """(group, key, name): where a group has a family of names that begin with two digits, one that reads a letter o or Q for a zero gets the digit and the space back."""
    numbered = F.col("name").rlike(r"^\d{2}[ _.-]")
    n = names.groupBy(group).agg(F.count_if(numbered).alias("n"))
    lead, rest = F.substring("name", 1, 2), F.substr(F.col("name"), F.lit(3))
    mistaken = lead.rlike(r"^(\d[oOQ]|[oOQ]\d)$") & (F.length(rest) > 0)
    mended = F.concat(F.translate(lead, "oOQ", "000"), F.lit(" "), F.ltrim(rest))
    return names.join(n, group).select(group, "key", F.when((F.col("n") >= least) & mistaken, mended).otherwise(F.col("name")).alias("name"))


def folded_nameless(rows: DataFrame, key: str) -> DataFrame:
    """Rows without those that have no name and equal a named row in their other cells; equal blanks become one."""
    named = rows.where("name <> ''").select(key, "rest").distinct()
    blank = rows.where("name = ''").join(named, [key, "rest"], "left_anti").dropDuplicates([key, "rest"])
    return rows.where("name <> ''").unionByName(blank)


def unspoiled(rows: DataFrame, key: str, least: int = 5, share: float = 0.8) -> DataFrame:
    """Rows of mostly dated lists without those whose date does not parse and whose kind is unusual."""
    total = rows.groupBy(key).agg(F.count_if("dated").alias("_d"), F.count(F.lit(1)).alias("_n"))
    usual = rows.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("_k"))
    j = rows.join(total, key).join(usual, [key, "kind"])
    strict = (F.col("_n") >= least) & (F.col("_d") >= share * F.col("_n"))
    return j.where(~(strict & ~F.col("dated") & (F.col("_k") < 2))).drop("_d", "_n", "_k")


def split_glued(cell: Column) -> Column:
    """struct(name, date, size, kind) of a cell in which they ran together."""
    rx = r"^(.*?)\s*(\d{1,2}/\d{1,2}/\d{2,4})?\s*(\d[\d.,]*\s?(?:KB|MB|GB|bytes))?\s*([A-Z][A-Za-z ]*)?$"
    return F.struct(*(F.nullif(F.trim(F.regexp_extract(cell, rx, k)), F.lit("")).alias(n) for k, n in ((1, "name"), (2, "date"), (3, "size"), (4, "kind"))))


def list_not_tree(trees: DataFrame, lists: DataFrame, least: int = 4, share: float = 0.6) -> DataFrame:
    """(tree, kind): a tree whose names are those of a known list of at least ``least`` rows is a list."""
    t = trees.groupBy("tree").agg(F.collect_set("name").alias("t"))
    big = lists.groupBy("list").agg(F.count_distinct("name").alias("n")).where(F.col("n") >= least).select("list")
    hits = trees.select("tree", "name").distinct().join(lists.select("list", "name").distinct().join(big, "list"), "name").groupBy("tree", "list").agg(F.count(F.lit(1)).alias("h")).groupBy("tree").agg(F.max("h").alias("h"))
    return t.join(hits, "tree", "left").select("tree", F.when(F.coalesce("h", F.lit(0)) >= share * F.size("t"), "list").otherwise("tree").alias("kind"))


def fragment_owner(fragments: DataFrame, windows: DataFrame, least: int = 3, size: int = 80, held: int = 10) -> DataFrame:
    """(frag, owner): the window that shows most of a fragment's lines, several where the runner-up has enough too.

    Lines are folds cut to ``size``; equal ones match, and from ``held`` letters on one that holds the other, found by ``occurrences``; lines that repeat are one.
    Lines travel as numbers. Two windows with enough lines settle a fragment, so these are looked for first among runs of ``least`` of its lines in order of commonness, each run once
    and from its rarest line; windows are counted only for fragments that no run settles, on all but the commonest lines, of which ``least`` - 1 are not enough.
    """
    id_ = lambda c: F.xxhash64(c).alias(c)
    f = fragments.select("frag", F.left("fold", F.lit(size)).alias("a")).where("a <> ''")
    w = windows.select("win", F.left("fold", F.lit(size)).alias("b")).where("b <> ''")
    one, other = stored(f.select("a").distinct(), "lines"), stored(w.select("b").distinct(), "lines")
    holds = lambda small, x, big, y: occurrences(small.select(F.col(x).alias("needle")), big.select(F.col(y).alias("text")), held).where("needle <> text").select(F.xxhash64("needle").alias(x), F.xxhash64("text").alias(y))
    pairs = holds(one, "a", other, "b").unionByName(holds(other, "b", one, "a")).unionByName(one.join(other, F.col("a") == F.col("b")).select(id_("a"), id_("b"))).distinct()
    shown = stored(w.select("win", id_("b")).distinct().join(pairs, "b").select("a", "win").distinct(), "shown")
    often = shown.groupBy("a").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("frag").orderBy(F.desc("often"), "a"))
    f = stored(f.select("frag", id_("a")).distinct().join(often, "a").withColumn("turn", rank), "asked")
    line = Window.partitionBy("frag").orderBy("turn")
    runs = f.select("frag", F.collect_list("a").over(line.rowsBetween(1 - least, 0)).alias("run")).where(F.size("run") == least)
    runs = stored(runs.withColumn("key", F.xxhash64("run")), "runs")
    each = runs.select("key", F.element_at("run", -1).alias("a"), F.slice("run", 1, least - 1).alias("rest")).dropDuplicates(["key"])
    both = each.join(shown, "a").select("key", "win", F.explode_outer("rest").alias("a")).join(shown, ["a", "win"], "left_semi") if least > 1 else each.join(shown, "a").select("key", "win")
    full = both.groupBy("key", "win").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(least - 1, 1)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    settled = stored(runs.join(full, "key", "left_semi").select("frag").distinct(), "settled")
    open_ = f.join(settled, "frag", "left_anti")
    some = open_.where(F.col("turn") >= least).join(shown, "a").groupBy("frag", "win").agg(F.count(F.lit(1)).alias("n"))
    common = open_.where(F.col("turn") < least).select("frag", "a")
    more = some.join(common, "frag").join(shown, ["a", "win"], "left_semi").groupBy("frag", "win").agg(F.count(F.lit(1)).alias("more"))
    hit = some.join(more, ["frag", "win"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))).where(F.col("n") >= least)
    line = Window.partitionBy("frag").orderBy(F.desc("n"), "win")
    top = hit.withColumns({"turn": F.row_number().over(line), "next": F.lead("n").over(line)}).where("turn = 1")
    owner = top.select("frag", F.when(F.col("next") >= least, "several").otherwise(F.col("win").cast("string")).alias("owner"))
    return owner.unionByName(settled.select("frag", F.lit("several").alias("owner")))


def near_windows(seen: DataFrame, spans: DataFrame, reach: int = 3) -> DataFrame:
    """(span, win, at): windows not in a span but seen within ``reach`` moments before it, else after it."""
    j = spans.join(seen, "video").where((F.col("at") >= F.col("lo") - reach) & (F.col("at") <= F.col("hi") + reach))
    g = j.groupBy("span", "win").agg(F.bool_or(F.col("at").between(F.col("lo"), F.col("hi"))).alias("inside"), F.max(F.when(F.col("at") < F.col("lo"), F.col("at"))).alias("before"), F.min(F.when(F.col("at") > F.col("hi"), F.col("at"))).alias("after"))
    return g.where("not inside").select("span", "win", F.coalesce("before", "after").alias("at"))


def rect_provenance(asked: DataFrame, reads: DataFrame, key: str) -> DataFrame:
    """(key, at, x0, how): a rectangle measured or read at the moment, borrowed from the latest one before, or none."""
    flow = asked.select(key, "at", F.lit(1).alias("side"), F.lit(None).cast("long").alias("x0"), F.lit(None).cast("string").alias("how")).unionByName(reads.select(key, "at", F.lit(0).alias("side"), "x0", "how"))
    line = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = flow.withColumn("m", F.last(F.when(F.col("side") == 0, F.struct("at", "x0", "how")), ignorenulls=True).over(line)).where("side = 1")
    return held.select(key, "at", F.col("m.x0").alias("x0"), F.when(F.col("m").isNull(), "none").when(F.col("m.at") == F.col("at"), F.col("m.how")).otherwise("borrowed").alias("how"))


def span_rect(rects: DataFrame, key: str, w: int = 1920, h: int = 1080) -> DataFrame:
    """(key, x0, y0, x1, y1): the measured box, else the union of boxes whose left and top lie within 4 % and right within 6 % of the first."""
    first = rects.groupBy(key).agg(F.min(F.struct("at", "x0", "y0", "x1", "y1")).alias("f"), F.min(F.when(F.col("measured"), F.struct("at", "x0", "y0", "x1", "y1"))).alias("m"))
    near = (F.abs(F.col("x0") - F.col("f.x0")) <= 0.04 * w) & (F.abs(F.col("y0") - F.col("f.y0")) <= 0.04 * h) & (F.abs(F.col("x1") - F.col("f.x1")) <= 0.06 * w)
    j = rects.join(first, key).where(near | F.col("m").isNotNull())
    u = j.groupBy(key).agg(F.first("m").alias("m"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return u.select(key, *(F.coalesce(F.col(f"m.{c}"), F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")))


def fingerprint(words: DataFrame, key: str, size: int = 24) -> DataFrame:
    """(key, print): the first content line of the topmost, leftmost pane, folded and cut."""
    lines = words.groupBy(key, "line").agg(ordered_text().alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0")).where(F.length(fs.flat(F.col("text"))) > 0)
    return lines.groupBy(key).agg(F.min_by(fs.flat(F.col("text")), F.struct("y0", "x0", "line")).alias("f")).select(key, F.substring("f", 1, size).alias("print"))


def without_path_rows(rows: DataFrame, crumbs: DataFrame, key: str) -> DataFrame:
    """Rows that are not a lone cell which is the end of a longer path crumb."""
    lone = rows.where((F.size("cells") == 1) & (F.length(F.get("cells", 0)) >= 8)).withColumn("c", F.get("cells", 0))
    hit = lone.join(crumbs.where("length(crumb) >= 10").select(key, "crumb"), key).where("endswith(crumb, c) and crumb <> c").select(key, "r").distinct()
    return rows.join(hit, [key, "r"], "left_anti")


def without_furniture(lines: DataFrame, strip: DataFrame, least: int = 8) -> DataFrame:
    """Lines that neither equal, lie inside nor end with a long word of the top strip of their recording; names with a leading dot stay."""
    s = strip.select("video", fs.flat(F.col("text")).alias("s")).where(F.length("s") >= least).distinct()
    f = fs.flat(F.col("text"))
    asked = lines.where(~F.startswith(F.col("text"), F.lit(".")) & (F.length(f) >= least)).select("doc", "line", "video", f.alias("f"))
    inside = occurrences(asked.select("video", F.col("f").alias("needle")), s.select("video", F.col("s").alias("text")), least, ["video"]).select("video", F.col("needle").alias("f"))
    back = lambda df, c, to: df.select("video", F.reverse(c).alias(to))
    held = occurrences(back(s, "s", "needle"), back(asked, "f", "text"), least, ["video"], True)
    ends = held.select("video", F.reverse("text").alias("f"))
    hit = asked.join(inside.union(ends).distinct(), ["video", "f"], "left_semi").select("doc", "line")
    return lines.join(hit, ["doc", "line"], "left_anti")


def edge_headings(words: DataFrame, vocabulary: list[str], page: str, line: str) -> DataFrame:
    """(page, line, k, heading): a word at the left edge that is the end of exactly one heading, with another heading in its row."""
    heads = F.array(*map(F.lit, vocabulary))
    row = words.groupBy(page, line).agg(F.max(F.lower("text").isin(*vocabulary).cast("int")).alias("has")).where("has = 1")
    fits = F.filter(heads, lambda h: F.endswith(h, F.lower(F.col("text"))) & (h != F.lower(F.col("text"))))
    return words.where("x0 <= 1").withColumn("fits", fits).where(F.size("fits") == 1).join(row, [page, line], "left_semi").select(page, line, "k", F.get("fits", 0).alias("heading"))


def sidebar(words: DataFrame, vocabulary: list[str], page: str, least_rows: int = 4, least: int = 3, share: float = 0.6) -> DataFrame:
    """(page, sidebar): enough of a pane's rows are names of a fixed vocabulary."""
    hit = F.count_if(fs.flat(F.col("text")).isin(*vocabulary))
    n = F.count(F.lit(1))
    return words.groupBy(page).agg(((n >= least_rows) & (hit >= least) & (hit >= share * n)).alias("sidebar"))


def folded_splits(rects: DataFrame, key: str, w: int = 1920, h: int = 1080) -> DataFrame:
    """(key, left, right, x0, y0, x1, y1): abutting halves of one window: same top and foot, buttons on the left only, a shallow seam."""
    a = rects.select(key, *(F.col(c).alias(f"a_{c}") for c in ("id", "x0", "y0", "x1", "y1", "buttons", "seam")))
    b = rects.select(key, *(F.col(c).alias(f"b_{c}") for c in ("id", "x0", "y0", "x1", "y1", "buttons")))
    meet = (F.abs(F.col("a_x1") - F.col("b_x0")) <= 0.01 * w) & (F.abs(F.col("a_y0") - F.col("b_y0")) <= 0.03 * h) & (F.abs(F.col("a_y1") - F.col("b_y1")) <= 0.05 * h)
    j = a.join(b, key).where(meet & F.col("a_buttons") & ~F.col("b_buttons") & (F.col("a_seam") < 10))
    return j.select(key, F.col("a_id").alias("left"), F.col("b_id").alias("right"), F.least("a_x0", "b_x0").alias("x0"), F.least("a_y0", "b_y0").alias("y0"), F.greatest("a_x1", "b_x1").alias("x1"), F.greatest("a_y1", "b_y1").alias("y1"))


def read_gaps(regions: DataFrame, quiet: DataFrame, key: str, area: float = 0.05, ink: float = 0.1) -> DataFrame:
    """(key, id, state): regions in a moment's quiet list, unread when both shares pass their bounds, else empty; without a frame an error."""
    q = regions.join(quiet, [key, "id"], "left_semi")
    return q.select(key, "id", F.when(F.col("ink").isNull(), "no frame").when((F.col("area") > area) & (F.col("ink") > ink), "unread").otherwise("empty").alias("state"))

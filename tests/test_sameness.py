"""Same things, window identity, tree stretches and corridor blocks against brute force and literal cases."""

import difflib
import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from screenlake.operators import sameness as sm
from screenlake.operators import substrings
from screenlake.streaming import timed


def flat(s):
    return re.sub("[^a-z0-9]", "", (s or "").lower())


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def window(k, grp, kind, names=None, rests=None, title=None, from_path=None, times=None, crumbs=None, slot=None, text=None):
    return (k, grp, kind, names, rests, title, from_path, times, crumbs, slot, text)


def reason(a, b):
    """Why two windows are one, rule by rule."""
    if a[1:3] != b[1:3]:
        return None
    na, nb = list(a[3] or []), list(b[3] or [])
    sa, sb = set(na), set(nb)
    ends = bool(na and nb) and (na[0] in nb[-3:] or nb[0] in na[-3:])
    if a[2] == "list":
        if flat(a[5]) and flat(a[5]) == flat(b[5]) and not a[6] and not b[6] and (min(len(sa), len(sb)) < 3 or not set(a[7] or []) & set(b[7] or [])):
            return "folder"
        for x, y in ((a, b), (b, a)):
            have, own = ([flat(c) for c in w[4] or [] if flat(c)] for w in (y, x))
            if not x[3] and len(own) >= 2 and 2 * sum(c in have for c in own) >= len(own):
                return "nameless"
        if sa and sb and 2 * len(sa & sb) >= min(len(sa), len(sb)):
            return "names"
        return "ends" if ends else "crumb" if len(na) >= 10 and len(nb) >= 10 and not sa & sb and set(a[8] or []) & set(b[8] or []) else None
    if a[2] == "note":
        if abs((a[9] or 0) - (b[9] or 0)) > 1:
            return None
        ta, tb, x, y = flat(a[5]), flat(b[5]), flat(a[10])[:200], flat(b[10])[:200]
        return "note" if min(len(ta), len(tb)) >= 6 and (ta.startswith(tb) or tb.startswith(ta)) or x and y and (x == y or ratio(x, y) >= 0.75) else None
    if a[2] == "tree":
        return "rows" if sa and sb and 10 * len(sa & sb) >= 3 * min(len(sa), len(sb)) else "ends" if ends else None
    x, y = flat(a[10]), flat(b[10])
    return "words" if x and y and ratio(x, y) >= 0.8 else None


def test_same_things_against_all_pairs(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    pool = {g: [word() for _ in range(60)] for g in range(8)}
    out = []
    for k in range(1000):
        g, kind = k % 8, r.choice(["list", "list", "list", "note", "tree", "words"])
        names = r.sample(pool[g], r.choice([0, 1, 2, 5, 12])) + (["everywhere"] if r.random() < 0.33 else [])
        r.shuffle(names)
        text = " ".join(r.choices(pool[g][:12], k=r.randint(0, 30))) if r.random() < 0.7 else " ".join(pool[g][:9]) + word()
        out.append(window(k, f"g{g}", kind, names or r.choice([None, []]), r.choice([None, [word(), r.choice("xyz") * 3, "pdf 3", ""], ["pdf 3", "doc 4"]]), r.choice([None, "", word(), "Folder " + r.choice("abcdef"), "folder-" + r.choice("abcdef")]), r.choice([None, True, False, False]), r.choice([None, [1], [2, 3], [k]]), r.choice([None, ["x"], [word()], [pool[g][0]]]), r.choice([None, 0, 1, 4]), r.choice([None, text, text, text[: len(text) // 2]])))
    got = {(x.a, x.b): x.how for x in sm.same_things(spark.createDataFrame(out, sm.WINDOWS)).collect()}
    want = {(a[0], b[0]): how for a, b in itertools.combinations(out, 2) if (how := reason(a, b))}
    assert got == want and set(want.values()) == {"folder", "nameless", "names", "ends", "crumb", "note", "rows", "words"}
    assert sm.same_things(spark.createDataFrame([], sm.WINDOWS)).count() == 0


def test_classes_of_same_things_against_all_pairs(spark):
    """One row a window: classes are those of all pairs, in groups that fall into many classes and in one of copies, and pairs are not told."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    out = []
    for k in range(600):
        kind = r.choice(["list", "list", "note", "tree", "words"])
        pool = [word() for _ in range(40)] if r.random() < 0.8 else [f"name{x}" for x in range(30)]
        text = " ".join(r.choices(pool, k=r.randint(0, 30)))
        names = r.sample(pool, r.choice([0, 3, 5, 12]))
        out.append(window(k, f"g{k % 3}", kind, names or r.choice([None, []]), r.choice([None, [word(), word(), "pdf 3"], ["pdf 3", "doc 4"]]), r.choice([None, word() + word()]), r.choice([None, True, False]), r.choice([None, [1], [2, 3], [k]]), r.choice([None, [word()], ["x"]]), r.choice([None, 1, 4]), r.choice([text, out[-1][10] + "x" if out else ""])))
    out += [window(1000 + k, "copies", "list", ["a", "b", "c", "d"], ["doc 1"], "Folder", False, [1]) for k in range(300)]
    group = {w[0]: w[0] for w in out}
    for a, b in itertools.combinations(out, 2):
        if group[a[0]] != group[b[0]] and reason(a, b):
            old, new = max(group[a[0]], group[b[0]]), min(group[a[0]], group[b[0]])
            group = {k: new if v == old else v for k, v in group.items()}
    got = {x.id: x.class_id for x in sm.same_classes(spark.createDataFrame(out, sm.WINDOWS)).collect()}
    assert got == group and 30 < len(set(group.values())) < 600


def test_alike_texts_in_blocks(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefghij") for _ in range(60)) for _ in range(12)]
    texts = [(k, "g", k % 3, k, t if r.random() < 0.2 else "".join(c for c in t if r.random() < 0.9)) for k in range(80) for t in [r.choice(base)]]
    found = sm._text_links(spark.createDataFrame(texts, "id long, grp string, slot int, c long, fold string"), 0.8, block=16).collect()
    joined = lambda pairs: {frozenset(x) for x in _joined(80, pairs)}
    want = [(a[0], b[0]) for a, b in itertools.combinations(texts, 2) if abs(a[2] - b[2]) <= 1 and ratio(a[4], b[4]) >= 0.8]
    assert joined([(x.a, x.b) for x in found]) == joined(want) and all(max(sm.common_letters(a[4], [b[4]])[0] * 2 / (len(a[4]) + len(b[4])), 0) >= ratio(a[4], b[4]) for a, b in itertools.combinations(texts, 2))


def _joined(n, pairs):
    sets = [{k} for k in range(n)]
    for a, b in pairs:
        x, y = (next(s for s in sets if k in s) for k in (a, b))
        if x is not y:
            x |= y
            sets.remove(y)
    return sets


def test_a_name_of_a_third_of_the_lists_gives_no_square(spark):
    """Lists of ten own names and one that all hold: nothing but the rarest names asks, so no pair is met."""
    rows = [(k, "g", [f"n{k}_{j}" for j in range(10)] + ["everywhere"]) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, grp string, names array<string>")
    met = sm.shared_share(df, 0.5)
    assert met.count() == 0
    each = df.select("id", "grp", F.size("names").alias("n"), F.explode("names").alias("name"))
    assert each.where("name = 'everywhere'").count() == 300


@pytest.fixture(scope="module")
def boxes():
    r = random.Random(6)
    rows = []
    for t in range(200):
        for k in range(r.randint(1, 6)):
            x, y = r.randrange(6) * 20 + r.randint(-14, 14), r.randrange(4) * 20 + r.randint(-14, 14)
            rows.append((t % 3, 100 + t, k, x, y, x + 50 + r.randint(-8, 8), y + 40))
    return rows


BOX = "video long, t long, id long, x0 long, y0 long, x1 long, y1 long"


def by_hand(rows):
    out, known = set(), defaultdict(list)
    for v, t, i, *box in sorted(rows):
        hit = next((k for k, b in enumerate(known[v]) if all(abs(p - q) <= 12 for p, q in zip(b, box, strict=True))), None)
        if hit is None:
            hit = len(known[v])
            known[v].append(box)
        out.add((v, t, i, hit))
    return out


def test_window_identity_in_batch_and_stream(spark, boxes, tmp_path):
    want = by_hand(boxes)
    assert {tuple(x) for x in sm.identified(spark.createDataFrame(boxes, BOX)).collect()} == want and len({w[3] for w in want}) > 20
    for k in range(3):
        spark.createDataFrame(boxes[k * len(boxes) // 3 : (k + 1) * len(boxes) // 3], BOX).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
    s = spark.readStream.schema(BOX).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path)).withColumn("at", F.timestamp_seconds("t"))
    run = timed.Run(timed.remembered(s, "video", ["t", "id"], sm.IDENTITY, sm.IDENTIFIED, sm.window_identity(12), 10_000, "1 minute"), "identity").go()
    assert {tuple(x) for x in run.table().collect()} == want


def test_chain_against_brute_force():
    r = random.Random(1)
    for _ in range(200):
        m = list({(r.randrange(6), s := r.randrange(8), s + r.choice([0, 0, 1])) for _ in range(r.randint(0, 9))})
        best = max((len(c) for n in range(len(m) + 1) for c in itertools.combinations(sorted(m), n) if all(x[0] < y[0] and x[2] < y[1] for x, y in zip(c, c[1:], strict=False))), default=0)
        got = sm.chain(m)
        assert len(got) == best and all(x[0] < y[0] and x[2] < y[1] for x, y in zip(got, got[1:], strict=False)) and set(got) <= set(m)


def test_stretches_of_a_tree_with_repeated_names(spark):
    whole = [("src", 0), ("index", 1), ("notes", 1), ("docs", 0), ("index", 1), ("guide", 1), ("chapter one", 2), ("chapter two", 2), ("a very long chapter name", 2), ("tail", 0)]
    w = spark.createDataFrame([("t", k, n, d) for k, (n, d) in enumerate(whole)], "tree string, pos long, name string, depth int")
    mine = [
        (1, 0, "index", 9, True), (1, 1, "guide", 9, False), (1, 2, "chapter two", 9, None), (1, 3, "smudge", 9, None), (1, 4, "a very long ch…", 9, True),
        (2, 0, "index", 9, True), (2, 1, "notes", 9, True), (2, 2, "docsindex", 9, False),
        (3, 0, "index", 9, True), (3, 1, "what", 9, True), (3, 2, "else", 9, True), (4, 0, "tail", 1, None),
    ]
    got = {(x.pane, x.at, x.name, x.depth, x.mark, x.how) for x in sm.mended_stretches(spark.createDataFrame([("t", *x) for x in mine], "tree string, pane int, at long, name string, depth int, mark boolean"), w).collect()}
    assert {g for g in got if g[0] == 1} == {
        (1, None, "docs", 0, None, "above"), (1, 0, "index", 1, True, "read"), (1, 1, "guide", 1, False, "read"), (1, 2, "chapter two", 2, None, "read"),
        (1, 3, "smudge", 9, None, "as it was"), (1, 4, "a very long chapter name", 2, True, "read"),
    }  # the second index, since docs' rows follow; chapter one, between matched rows, is not filled
    assert {g for g in got if g[0] == 2} == {(2, None, "src", 0, None, "above"), (2, 0, "index", 1, True, "read"), (2, 1, "notes", 1, True, "read"), (2, 2, "docs", 0, False, "split"), (2, 2, "index", 1, False, "split")}
    assert {g for g in got if g[0] > 2} == {(3, 0, "index", 9, True, "as it was"), (3, 1, "what", 9, True, "as it was"), (3, 2, "else", 9, True, "as it was"), (4, 0, "tail", 1, None, "as it was")}


def blocks_by_hand(lines, width, least, rows):
    blank = [[all(not (a <= x < b) for a, b in boxes) for x in range(width)] for boxes in lines]

    def runs(mask):
        out, start = [], None
        for x, e in enumerate([*mask, False]):
            if e and start is None:
                start = x
            elif not e and start is not None:
                out += [(start, x)] if x - start >= least else []
                start = None
        return out

    def meet(p, q):
        return [(max(a, c), min(b, d)) for a, b in p for c, d in q if min(b, d) - max(a, c) >= least]

    cands = []
    for i in range(len(lines)):
        left = runs(blank[i])
        for j in range(i + 1, len(lines)):
            left = meet(left, runs(blank[j]))
            if not left:
                break
            if j - i + 1 >= rows:
                cands.append((len(left), j - i + 1, i, j, left))
    cands.sort(key=lambda c: (-c[0], -c[1]))
    used, out = set(), []
    for _, n, i, j, left in cands:
        if not used & set(range(i, j + 1)):
            used |= set(range(i, j + 1))
            out.append((i, j, n, ",".join(f"{a}-{b}" for a, b in sorted(left))))
    return sorted(out)


def test_corridor_blocks_against_every_run(spark):
    r = random.Random(2)
    rows, want = [], {}
    for page in range(500):
        stops = sorted(r.sample(range(0, 60, 6), 3))
        lines = []
        for _ in range(r.randint(1, 9)):
            lines.append([(s, s + r.randint(1, 5)) for s in stops] if r.random() < 0.7 else [(r.randint(0, 30), r.randint(31, 64))])
        width = max(b for boxes in lines for _, b in boxes)
        rows += [(page, y, a, b) for y, boxes in enumerate(lines) for a, b in boxes]
        want[page] = blocks_by_hand(lines, width, 3, 3)
    got = defaultdict(list)
    for x in sm.corridor_blocks(spark.createDataFrame(rows, "doc long, line int, x0 long, x1 long"), "doc", 3).collect():
        got[x.doc].append((x.first, x.last, x.n, x.corridors))
    assert {p: sorted(v) for p, v in got.items()} == {p: v for p, v in want.items() if v}


def test_substrings_against_every_place(spark):
    r = random.Random(11)
    from screenlake.operators import substrings

    texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(120)] + ["a" * 40]
    needles = [t[k : k + n] for t in texts[:60] for k, n in [(r.randint(0, 30), r.randint(10, 24))]] + ["a" * 12, "", "abc", "zzzzzzzzzzzzzz"]
    rows = lambda x, c: spark.createDataFrame([(k % 3, v) for k, v in enumerate(x)], f"g int, {c} string")
    want = {(n, t, k) for n in needles if len(n) >= 10 for t in texts for k in range(len(t)) if t.startswith(n, k)}
    got = [(x.needle, x.text, x.at) for x in substrings.occurrences(rows(needles, "needle"), rows(texts, "text"), 10).collect()]
    assert set(got) == want and len(got) == len(want) > 60
    by = {(x.g, x.needle, x.text, x.at) for x in substrings.occurrences(rows(needles, "needle"), rows(texts, "text"), 10, ["g"]).collect()}
    place = {(k % 3, t) for k, t in enumerate(texts)}
    assert by == {(k % 3, *w) for k, n in enumerate(needles) for w in want if w[0] == n and (k % 3, w[1]) in place}


def test_longest_tails_of_two_documents(spark):
    r = random.Random(4)
    texts = [(d % 9, "".join(r.choice("abc") for _ in range(r.randrange(5, 60)))) for d in range(60)]
    pieces = sorted({t[k : k + 5] for _, t in texts for k in range(0, len(t) - 4, 7)} | {"zzzzz"})
    want = set()
    for p in pieces:
        of = {}
        for d, t in texts:
            for k in range(len(t) - 7):
                if t[k : k + 5] == p:
                    of[d] = max(of.get(d, (0, "")), (len(t[k + 5 : k + 25]), t[k + 5 : k + 25]))
        want |= {(p, n) for n, _ in sorted(of.values(), reverse=True)[:2]}
    got = substrings.longest_after(spark.createDataFrame([(p,) for p in pieces], "piece string"), spark.createDataFrame(texts, "doc long, text string"), 5, 3, 20).collect()
    assert {(x.piece, x.n) for x in got if x.piece in pieces} == want and len({(x.piece, x.doc) for x in got}) == len(got)
    plan = substrings.longest_after(spark.createDataFrame([("abcab",)], "piece string"), spark.createDataFrame(texts, "doc long, text string"), 5, 3, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # texts are not fetched for what meets


def test_places_of_texts_do_not_travel(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(8, 600))) for _ in range(60)]
    needles = sorted({t[:n] for t in texts[:30] for n in (8, 17, 300) if len(t) >= n} | {t[5:n] for t in texts[:9] for n in (40, 500) if len(t) >= n})
    rows = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} string")
    found = substrings.occurrences(rows(needles, "needle"), rows(texts, "text"), 8, [], True)
    want = {(n, t, 0) for n in needles for t in texts if t.startswith(n)}
    assert sorted((x.needle, x.text, x.at) for x in found.collect()) == sorted(want) and len(want) > 60
    anywhere = substrings.occurrences(rows(needles, "needle"), rows(texts, "text"), 8)
    assert {(x.needle, x.text, x.at) for x in anywhere.collect()} == {(n, t, k) for n in needles for t in set(texts) for k in range(len(t)) if t.startswith(n, k)}
    assert "Generate" not in anywhere._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_lines_are_not_all_held():
    import tracemalloc

    r = random.Random(8)
    both = lambda x, y: [(max(a, c), min(b, d)) for a, b in x for c, d in y if min(b, d) - max(a, c) >= 3]
    for _ in range(60):
        blank = [sorted((a, a + r.randint(3, 20)) for a in r.sample(range(0, 90, 30), r.randint(0, 3))) for _ in range(r.randint(1, 25))]
        every, used, want = [], set(), []
        for i in range(len(blank)):
            left = blank[i]
            for j in range(i + 1, len(blank)):
                left = both(left, blank[j])
                if left and j - i >= 2:
                    every.append((-len(left), i - j, i, j, left))
        for _, _, i, j, left in sorted(every):
            if used.isdisjoint(range(i, j + 1)):
                used.update(range(i, j + 1))
                want.append((i, j, left))
        assert sm.best_runs(blank, both, 3) == want
    tracemalloc.start()
    assert len(sm.best_runs([[(0, 50), (60, 90)]] * 900, both, 3)) == 1 and tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def test_chains_are_found_without_walking_the_matches():
    r = random.Random(6)
    for _ in range(1500):
        rows = [(k, [(sorted(r.sample(range(14), r.randint(1, 5))), span) for span in r.sample([0, 1], r.randint(0, 2))]) for k in range(r.randint(1, 6))]
        matches = [(k, p, p + span) for k, lists in rows for starts, span in lists for p in starts]
        assert sm.chain_of(rows) == (sm.chain(matches) if matches else []), rows

    class Counted(list):
        asked = 0

        def __getitem__(self, k):
            Counted.asked += 1
            return super().__getitem__(k)

    many = Counted(range(100_000))
    assert sm.chain_of([(k, [(many, 0)]) for k in range(9)]) == [(k, k, k) for k in range(9)] and Counted.asked < 10_000


def test_carried_words_against_every_reading(spark):
    from screenlake.operators import joins

    r = random.Random(9)
    rows = [(r.randrange(2), t, k, *(r.choice((-1, 1, 1 << 27)) * r.randrange(40) for _ in range(4)), r.choice([None, f"w{t}:{k}"])) for t in range(60) for k in range(4)]
    got = {tuple(x) for x in joins.carried_words(spark.createDataFrame(rows, "video long, t long, id long, x0 long, y0 long, x1 long, y1 long, words string"), "video", slack=25).collect()}
    want = set()
    for v, t, k, *box, words in rows:
        near = [(s, i, w) for u, s, i, *other, w in rows if u == v and w and s < t and all(abs(a - b) <= 25 for a, b in zip(box, other, strict=True))]
        if words is None and near:
            s, _, w = max(near)
            want.add((v, t, k, w, s))
    assert got == want and len(want) >= 8

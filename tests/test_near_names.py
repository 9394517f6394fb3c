"""The index of names against all pairs, and the tiers against a plain choice among all names."""

import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlake.functions import strings as fs
from screenlake.operators import near_names as nn

SYLLABLES = "ka lo min ter ra su pel no vi da ex qu ir ban te sol mi gar".split()


def fold(s):
    return re.sub("[^a-z0-9]", "", s.lower())


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@pytest.fixture(scope="module")
def named():
    """5,000 names, and readings of 360 of them mangled at both ends, cut, shortened or with wrong letters."""
    r = random.Random(8)
    names = sorted({"_".join("".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(2, 4))) + r.choice(["", ".md", ".py"]) for _ in range(5600)})
    names = r.sample(names, 5000)
    readings = []
    for n in r.sample(names, 360):
        x, kind = list(n), r.randrange(5)
        if kind == 0:  # both ends
            x[0], x[-1] = r.choice("xyz0"), r.choice("xyz0")
        elif kind == 1:
            at = r.randrange(4, max(5, len(x) - 4))
            x = [*x[:at], "…", *x[at + 3 :]]
            x[1] = r.choice("ao")
        elif kind == 2:
            x = x[: max(6, int(len(x) * 0.8))]
        elif kind == 3:
            for _ in range(2):
                x[r.randrange(len(x))] = r.choice("aeioqz")
        else:
            x = x[2:-3]
        readings.append("".join(x))
    return names, sorted(set(readings))


def test_index_misses_no_pair(spark, named):
    names, readings = named
    a, b = sorted({fold(x) for x in readings if "…" not in x and len(fold(x)) >= 6}), sorted({fold(x) for x in names})
    count = lambda folds: np.array([[min(f.count(c), 100) for c in nn.RARE_FIRST] for f in folds], np.int8)
    ca, cb, n, m = count(a), count(b), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    both = np.zeros((len(a), len(b)), np.int16)
    for k in range(ca.shape[1]):
        both += np.minimum(ca[:, k][:, None], cb[:, k][None, :])
    for least in (nn.COMPLETES, nn.COMPLETES - nn.LEAD):
        may = (2 * both >= least * (n[:, None] + m[None, :]) - 1e-9) & (abs(m[None, :] - n[:, None]) <= nn.BAND * n[:, None])
        want = {(a[i], b[j]) for i, j in zip(*np.nonzero(may), strict=True) if ratio(b[j], a[i]) >= least}
        rows = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} string")
        got = {(r.fold, r.f) for r in nn.alike_names(rows(a, "fold"), rows(b, "f"), least).collect()}
        assert got == want and len(want) > 300


def test_tiers_against_a_choice_among_all_names(spark, named):
    names, readings = named
    readings = readings[::3]
    lexicon = {fold(n): n for n in names}
    rows = spark.createDataFrame([(f, n, 2) for f, n in lexicon.items()], "fold string, name string, sightings long")
    got = {r.key: r.name for r in nn.lexicon_likely(spark.createDataFrame(list(enumerate(readings)), "key int, reading string"), rows).collect()}
    stem = lambda f: re.sub("md$", "", f)
    same = lambda f, g: stem(f) == stem(g) or ratio(stem(f), stem(g)) >= nn.SAME_NAME
    want = {}
    for key, reading in enumerate(readings):
        f = fold(reading)
        if len(f) < 6 or f in lexicon:
            continue
        if "…" in reading:
            head, tail = map(fold, reading.split("…", 1))
            if not head or len(head) + len(tail) < 8:
                continue
            fit = [k for k in lexicon if len(k) > len(head) + len(tail) and ratio(k[: len(head)], head) >= 0.8 and (not tail or ratio(k[-len(tail) :], tail) >= 0.8)]
            fit.sort(key=lambda k: (-len(lexicon[k]), lexicon[k]))
            if fit and all(same(k, fit[0]) for k in fit):
                want[key] = lexicon[fit[0]]
            continue
        fit = sorted((k for k in lexicon if len(f) >= 10 and len(k) > len(f) + 3 and (k.startswith(f) or k.endswith(f))), key=lambda k: (-len(lexicon[k]), lexicon[k]))
        if fit and all(same(k, fit[0]) for k in fit):
            want[key] = lexicon[fit[0]]
            continue
        matcher = difflib.SequenceMatcher(None, "", f, autojunk=False)
        score = {}
        for k in lexicon:
            if abs(len(k) - len(f)) <= 0.35 * len(f):
                matcher.set_seq1(k)
                if matcher.quick_ratio() >= 0.67:
                    score[k] = matcher.ratio()
        order = sorted(score, key=lambda k: (score[k], lexicon[k]), reverse=True)
        if order and score[order[0]] >= (0.75 if len(order[0]) >= 1.15 * len(f) else 0.9):
            other = max((score[k] for k in order if not same(k, order[0])), default=None)
            if other is None or score[order[0]] - other >= 0.08:
                want[key] = lexicon[order[0]]
    assert got == want and len(want) > 40


def test_hot_keys_are_split(spark):
    known = spark.createDataFrame([(7, f"name{k}") for k in range(300)] + [(8, "other")], "key long, f string")
    got = nn.meet(spark.createDataFrame([(7, "x"), (8, "y"), (9, "z")], "key long, fold string"), known, most=100)
    assert got.count() == 301 and got.where("key = 7").select("part").distinct().count() == 3


def test_likely_names_of_odd_readings(spark):
    names = ["user_moves_fast_dont_pad_timelines.md", "feedback_code_tracker.md", "reference_stripe_api_version.md", "reference_stripe_api_version", "0oInboxes two"]
    lex = spark.createDataFrame([(fold(n), n, 2) for n in names] + [("rarename", "rare_name", 1)], "fold string, name string, sightings long")
    asked = [(1, "user_moves_fast_..pad_timelins.md"), (2, "feedback_co"), (3, "referenc_stripe_apl_version.md"), (4, "00 Inbox"), (5, None), (6, ""), (7, "rare_nane"), (8, "…"), (9, "feedback_code_tracker.md")]
    got = {r.key: r.name for r in nn.lexicon_likely(spark.createDataFrame(asked, "key long, reading string"), lex).collect()}
    assert got == {1: names[0], 2: names[1], 3: names[2]}
    none = spark.createDataFrame([], "key long, reading string")
    assert nn.lexicon_likely(none, lex).count() == 0 and nn.lexicon_likely(spark.createDataFrame(asked, "key long, reading string"), lex.limit(0)).count() == 0


def test_agreed_head_marks_what_is_cut(spark):
    cases = [
        ("alpha beta gamma Kn", "alpha beta gamma", ("alpha beta gamma", "cut", "Kn", "")),
        ("alpha beta gamma xyzq", "alpha beta gamma 12345", ("alpha beta gamma", "cut", "xyzq", "12345")),
        ("alpha beta gamma", "alpha beta gamma delta epsilon", ("alpha beta gamma delta epsilon", "reconciled", "", "")),
        ("second line here", "first line second line here too", ("second line here", "reconciled", "", "")),
        ("alpha beta gamma delta", "alpha beta gamma de1ta", None),  # like tails are a substitution
        ("alpha beta gamma delete", "alpha beta gamma 1qqxzz", ("alpha beta gamma", "cut", "delete", "1qqxzz")),
        ("alpha", "omega", None), ("Same-Thing here", "same thing here", ("Same-Thing here", "reconciled", "", "")), (None, "x", None), ("...", "x", None),
        ("alpha beta gammax", "alpha beta gammakk vvv www", ("alpha beta", "cut", "gammax", "kk vvv www")),
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = {r.k: tuple(r.h) if r.h else None for r in fs.agreed_head(df, "a", "b", "h").collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(cases)}


def test_readings_are_merged_as_by_a_walk(spark):
    """A batch of readings at once, with marks of several bytes, the characters 1 and 0 in a text, rows without letters and nulls."""
    import random

    def merged(a, b):
        gaps = lambda t: re.split("[A-Za-z0-9]", t)
        x, y = re.sub("[^A-Za-z0-9]", "", a), re.sub("[^A-Za-z0-9]", "", b)
        if x != y:
            return None
        g = list(zip(gaps(a), gaps(b), strict=True))
        return "".join((p if len(p) >= len(q) else q) + c for (p, q), c in zip(g, [*x, ""], strict=True)), sum(p != q and len(p) == len(q) for p, q in g)

    r = random.Random(1)
    some = lambda t: "".join(c + r.choice(["", "", " ", ". ", "…", "é", "\u0001", "\n", "字–"]) for c in t)
    rows = [(k, some(t), some(t if r.random() < 0.8 else t + "x")) for k in range(400) for t in ["".join(r.choice("abZ09") for _ in range(r.randint(0, 12)))]]
    rows += [(400, None, "a"), (401, "a", None), (402, "", ""), (403, "…", "-"), (404, "a\u0001b", "a\u0001b")]
    df = spark.createDataFrame(rows, "k long, a string, b string").select("k", fs.merged_readings(F.col("a"), F.col("b")).alias("m"))
    got = {x.k: x.m and tuple(x.m) for x in df.collect()}
    assert got == {k: None if a is None or b is None else merged(a, b) for k, a, b in rows} and got[404] == ("a\u0001b", 0)


def test_lookalikes_character_by_character(spark):
    import itertools

    alike = lambda x, y: x == y or any(x in g and y in g for g in fs.HOMOGLYPHS)
    words = ["".join(w) for w in itertools.product("Il1|i0Oay", repeat=2)] + ["a", "", "aI1"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").withColumn("like", fs.only_lookalikes(F.col("a"), F.col("b")))
    assert all(x.like == (len(x.a) == len(x.b) and x.a != x.b and all(map(alike, x.a, x.b))) for x in df.collect())


def test_letters_and_their_places_alone():
    r = random.Random(5)
    texts = ["".join(r.choices("aB9 .é字İK😀\n", k=40)) for _ in range(200)] + ["", "é"]
    assert all((fs.ascii_fold(t), fs.letter_places(t).tolist()) == fs.folded(t) for t in texts)

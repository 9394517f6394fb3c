"""Operators 11 to 13 against brute force, with ties, nulls, copies, hot keys and empty tables; and ids, labels and marks of earlier ones."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlake.llm import near_dedup, negatives, phrases, set_join, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string, score string, size string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""
    a, b = words(60, 1), words(20_000, 2)
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (3, a + " tail", None, None), (4, None, "en", "s"), (5, "", "fr", "t"), (None, a, "en", None), (None, None, None, None), (6, b, "en", "s"), (6, b, "en", "s"), (7, "  \n\t ", "en", "s"), (8, "one", "fr", "s"), (9, "ß Ünï x y", "de", "t"), (10, "ONE", "fr", "s")]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, "x", "y", "z") for i, t, lang, s in rows], DOCS)


def linked(texts):
    """The least id reachable by links, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = {tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(texts), 2):
        a, b = sets[i], sets[j]
        if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.fixture(scope="module")
def crowded():
    """Short and long texts, groups of near copies that change a word each, and a passage that most texts share."""
    r, texts = random.Random(5), []
    shared = words(40, 77)
    for k in range(25):
        base = words(r.choice([4, 5, 6, 9, 12, 30, 80, 200]), 1000 + k).split()
        for _ in range(r.choice([1, 2, 6, 14])):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                own[r.randrange(len(own))] = words(1, r.random())
            texts.append(" ".join(own) if k % 3 else shared + " " + " ".join(own))
    return {i: t for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [64, 4, 2])
def test_set_join_against_all_pairs(spark, crowded, most, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 16)  # lists of several blocks
    got = {r.rid: (r.n_shingles, r.component_id) for r in set_join.linked_sets(spark.createDataFrame(list(crowded.items()), "doc_id long, text string"), most=most).collect()}
    assert got == linked(crowded)


def test_every_linked_pair_meets_in_a_list(spark, crowded):
    """Before any shortcut by components: each pair of unlike sets that links shares a list, with hot lists dropped at all levels."""
    join = set_join.Join(spark.createDataFrame(list(crowded.items()), "doc_id long, text string"), set_join.Rule(), 5, 3, "text", "doc_id")
    node = {r.node: r.rid for r in join.nodes.select("node", "rid").collect()}
    members = {}
    for r in join.lists().collect():
        members.setdefault((r.kind, r.key), set()).add(node[r.node])
    met = {p for m in members.values() for p in itertools.combinations(sorted(m), 2)}
    alone = sorted(node.values())
    for i, j in itertools.combinations(alone, 2):
        if linked({i: crowded[i], j: crowded[j]})[j][1] == i:
            assert (i, j) in met


def test_set_join_of_odd_tables(spark, odd):
    got = {(r.rid, r.n_shingles, r.component_id) for r in set_join.linked_sets(odd).collect() if r.rid >= 0}
    want = {(3, 57, None), (4, 0, 4), (5, 0, 5), (7, 0, 7), (8, 1, 8), (9, 1, 9), (10, 1, 8), (6, 19_996, 6)}
    own = next(c for i, _, c in got if i == 1)  # the null id's row with the same text has a negative number
    assert own < 0 and {(1, 56, own), (2, 56, own), (3, 57, own)} <= got and want - {(3, 57, None)} <= got
    assert set_join.linked_sets(odd).count() == odd.count() and set_join.linked_sets(odd.limit(0)).count() == 0


def test_boundary_costs(spark):
    rule = set_join.Rule()
    assert set_join.cheapest_boundary([], rule) == 1 and set_join.cheapest_boundary([(4, 100)], rule) > 4
    assert 1 < set_join.cheapest_boundary([(n, 10) for n in range(1, 128)], rule) < 64
    for n in range(4, 400):  # the keys that are due never exceed what the smallest partner shows
        least = rule.smallest(n)
        assert 3 + least // 10 <= least and set_join.shown(least, False, rule) - rule.prefix(least) >= min(2 + least // 10, least - rule.prefix(least))


def brute_negatives(rows, every=100):
    rows = sorted({(i, str(lab), tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}, key=lambda r: r[0])
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a in rows:
        if a[0] % every:
            continue
        others = sorted((-dot(a[2], b[2]), b[0], b[1]) for b in rows if b is not a)
        for s, pid, _ in [o for o in others if o[2] == a[1]][:5]:
            fit = [o for o in others if o[2] != a[1] and 30 * -s <= 100 * -o[0] <= 90 * -s][:10]
            out |= {(a[0], pid, k, nid, -s, -t) for k, (t, nid, _) in enumerate(fit, 1)}
    return out


def vectors(n, seed, dims=8, centres=6):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(centres, dims))
    return [(i, int(i % 3), (mid[i % centres] * 0.4 + r.normal(size=dims) * 0.25).tolist()) for i in range(n)]


VEC = "vec_id long, label int, embedding array<float>"


def test_hard_negatives_against_brute_force(spark):
    rows = vectors(900, 3)
    rows += [(5000 + k, 1, rows[200][2]) for k in range(40)]  # one very common vector, with ties
    rows += [(100, 2, None), (None, 1, rows[0][2]), (300, None, rows[1][2]), (500, 1, [1.0, None] + [0.0] * 6), (700, 1, [float("nan")] * 8), (900, 1, [float("inf")] * 8), (6000, 1, [0.0] * 8), (6100, 2, [0.5, 0.25])]
    rows = [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    df = negatives.quantised(spark.createDataFrame(rows + rows[:50], VEC))
    want = brute_negatives(rows)
    for params in ({}, {"leaf_rows": 30, "chunk": 25, "ways": 4, "most_sample": 200}):
        got = {tuple(r) for r in negatives.hard_negatives(df, every=50, **params).collect()}
        assert got == brute_negatives(rows, 50) and len(got) > len(want) > 50


def test_hard_negatives_of_odd_tables(spark):
    assert negatives.hard_negatives(negatives.quantised(spark.createDataFrame([], VEC))).count() == 0
    assert negatives.hard_negatives(negatives.quantised(spark.createDataFrame([(0, 1, [0.5])], VEC))).count() == 0
    big = [(0, 1, [3e14, 1.0]), (1, 1, [3e14, 2.0]), (2, 2, [1.5e14, 5.0]), (3, 2, [2e13, 1.0])]  # beyond 2^53, exact; scores beyond 64 bits are held at the bound
    got = negatives.hard_negatives(negatives.quantised(spark.createDataFrame(big, "vec_id long, label int, embedding array<double>"))).collect()
    assert all(r.positive_score == negatives.HIGHEST for r in got)


def test_tree_passes_over_subtrees_but_misses_no_row():
    r = np.random.default_rng(1)
    rows = np.vstack([r.normal(size=(300, 6)) * 20 + c for c in (r.normal(size=(8, 6)) * 300)]).round()
    tree = negatives.Tree(rows[::3], float((rows**2).sum(axis=1).max()), 4, 20)
    leaf, seen = tree.place(tree.lifted(rows))
    tree.set_ranges([(n, i, j, min(x[3] for x in g), max(x[4] for x in g)) for (n, i, j), g in itertools.groupby(sorted(seen), key=lambda x: x[:3]) for g in [list(g)]])
    score = rows[:40] @ rows.T
    low = np.sort(score, axis=1)[:, -20:][:, :1]
    who, at = tree.reached(rows[:40], low, np.full((40, 1), 1e18))
    got = set(zip(who.tolist(), at.tolist(), strict=True))
    assert all((i, leaf[j]) in got for i, j in zip(*np.nonzero(score >= low), strict=True))
    assert len(got) < 0.5 * 40 * tree.leaves


def brute_phrases(rows, threshold, most=2000):
    words_of = Counter()
    count = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            words_of[lang] += len(w)
            for n in range(1, 6):
                count.update((lang, tuple(w[k : k + n])) for k in range(len(w) - n + 1))
    found = {}
    for (lang, p), a in count.items():
        if len(p) > 1 and a >= threshold and not any(len(q) > len(p) and m == lang and b >= a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for (m, q), b in count.items() if b >= a):
            cut = min((1000 * a * words_of[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-cut[0], -a, " ".join(p).encode(), count[lang, p[: cut[1]]], count[lang, p[cut[1] :]]))
    return {(lang, k, p.decode(), -a, l, r, words_of[lang], -s) for lang, v in found.items() for k, (s, a, p, l, r) in enumerate(sorted(v)[:most], 1)}


@pytest.mark.parametrize("most", [2000, 3])
def test_phrases_against_brute_force(spark, most):
    r = random.Random(6)
    vocab = [words(1, k) for k in range(30)] + ["É", "Wörter", "a.b", "\x0b"]
    rows = [(r.choice(["en", "de", None, "und"]), r.choice([" ", "  ", "\t"]).join(r.choices(vocab, [1 / (k + 1) for k in range(len(vocab))], k=r.randint(0, 60))) + r.choice([". Nice To Meet You", "", ", nice to meet you!"])) for _ in range(250)] + [("en", None), ("en", ""), (None, None)]
    got = {tuple(x) for x in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), threshold=12, most=most).collect()}
    assert got == brute_phrases(rows, 12, most) and len(got) >= 6


def test_phrases_of_odd_tables(spark, odd):
    assert phrases.collocations(odd.limit(0)).count() == 0
    assert phrases.collocations(odd).count() == 0
    assert phrases.collocations(odd, threshold=2).where("lang = 'en'").count() > 0
    huge = spark.createDataFrame([("en", "go on " * 30_000)], "lang string, text string")
    got = {r.phrase: (r.a, r.l, r.r, r.n) for r in phrases.collocations(huge).collect()}
    assert got["go on go on go"][0] == 29_998 and "go on go" not in got or got["go on go on"][3] == 60_000


def test_misra_gries_keeps_what_reaches_the_threshold():
    r = np.random.default_rng(2)
    for capacity in (1, 40, 1000):
        h = np.concatenate([r.integers(0, 200_000, 400_000), np.repeat(np.arange(50) + 10**6, r.integers(80, 140, 50))])
        r.shuffle(h)
        true = Counter(h.tolist())
        parts = ((x, np.ones(len(x), np.int64)) for x in np.array_split(h, 9))
        got, c, taken = phrases.misra_gries(parts, 100, capacity)
        kept = dict(zip(got.tolist(), c.tolist(), strict=True))
        assert taken < 100 and all(kept.get(x, 0) + taken >= n for x, n in true.items() if n >= 100) and all(n <= true[x] for x, n in kept.items())


def test_shards_of_string_ids(spark):
    docs = spark.createDataFrame([(f"doc-{k}", words(20, k), "en", "s") for k in range(200)] + [(None, "x", None, None)], "doc_id string, text string, lang string, source string")
    got = sharding.kd_shards(docs, 8).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted([f"doc-{k}" for k in range(200)] + ["None"]) and len({r.shard for r in got}) == 8


def test_clashing_labels_of_equal_texts(spark):
    """Copies of toxic texts that are labelled 0: the higher label holds, whatever the order of rows."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    copies = docs.join(labels.where("toxic = 1"), "doc_id").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    both = docs.select("doc_id", "text").unionByName(copies)
    marks = labels.select("doc_id", "toxic").unionByName(copies.select("doc_id", F.lit(0).cast("int").alias("toxic")))
    models = [toxicity.learn(both.orderBy(turn), marks.orderBy(turn)) for turn in (F.asc("doc_id"), F.desc("doc_id"))]
    assert models[0].weights and models[0].weights == models[1].weights


def test_marks_tell_darts_apart():
    """Pairs that share a band must not seem to share an earlier one: the marks leave no coordinate bits."""
    r = np.random.default_rng(3)
    false = 0
    for _ in range(300):
        both = r.integers(0, 2**63, 150).astype(np.uint64)
        own = lambda: r.integers(0, 2**63, 18).astype(np.uint64)
        a, b = (near_dedup.signature(np.unique(np.concatenate([both, own()])), np.ones(168, np.int64), 64) for _ in range(2))
        short = [(s >> np.uint64(6)).astype(np.uint32) for s in (a, b)]
        false += int(((short[0] == short[1]) & (a != b)).sum())
    assert false == 0


def test_near_recall_by_similarity(spark):
    """Near copies are found whatever their similarity above the threshold: pairs of every band from 0.8 on."""
    r, rows, pairs = random.Random(9), [], []
    for k in range(240):
        base = words(400, 3000 + k).split()
        own = list(base)
        for at in r.sample(range(0, 400, 8), k % 10 + 1):
            own[at] = words(1, r.random())
        a, b = ({tuple(w[i : i + 5]) for i in range(396)} for w in (base, own))
        pairs.append((2 * k, len(a & b) / len(a | b)))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
    got = {x.rid: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.82), (0.82, 0.86), (0.86, 0.92), (0.92, 1.01)):
        band = [i for i, s in pairs if low <= s < high]
        assert not band or sum(got[i + 1] == i for i in band) >= 0.9 * len(band)
    assert sum(0.8 <= s for _, s in pairs) > 100 and all(got[i + 1] == i + 1 for i, s in pairs if s < 0.8)

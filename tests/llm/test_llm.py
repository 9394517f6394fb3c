"""Operators for training data against brute force, round trips and held-out labels, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from screenlake.functions.batches import NAME, small_batches
from screenlake.llm import chat, decontaminate, language, lm_score, mixing, near_dedup, quality, queries, repeats, sharding, toxicity
from screenlake.llm.text import WordHashes, folded_words, plain_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string, score string, size string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""
    a, b = words(60, 1), words(30_000, 2)
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (3, a + " tail", None, None), (4, None, "en", "s"), (5, "", "fr", "t"), (None, a, "en", None), (None, None, None, None), (6, b, "en", "s"), (6, b, "en", "s"), (7, "  \n\t ", "en", "s"), (8, "one", "fr", "s"), (9, "ß Ünï x y", "de", "t")]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, "x", "y", "z") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bands_and_counts(spark, odd, none):
    got = {r.doc_id: r for r in quality.quality(odd).collect() if r.doc_id}
    assert got[1].n_words == 60 and got[1].kept and not got[1].base_failed
    assert got[4].n_words == 0 and got[4].base_failed and not got[4].kept and got[5].ratio is None
    assert got[6].chunks > 5 and got[6].within and got[1].chunks == 1
    assert quality.quality(none).count() == 0
    rep = spark.createDataFrame([(1, "la la la " * 200), (2, "".join(chr(33 + random.Random(3).randrange(90)) for _ in range(9000)))], "doc_id long, text string")
    assert not any(r.kept for r in quality.quality(rep).collect())


def test_learned_bands_against_brute_force(spark):
    """``kept`` of every document by limits computed here, and what the bands catch of bad and lose of good texts that they were not learned from."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    good = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in quality.quality(docs, quality.learn(docs, labels)).collect()}
    press = zstandard.ZstdCompressor(level=3)

    def measures(b):
        parts = [b[k : k + 512] for k in range(0, len(b), 512)]
        if len(parts) > 1:
            parts[-1] = b[-512:]
        ratios = [len(press.compress(p)) / len(p) for p in parts]
        return len(press.compress(b)) / len(b), min(ratios), max(ratios)

    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    passes = [i for i, r in got.items() if not r.base_failed]
    seen = {i: measures(text[i]) for i in passes}
    size = {i: int(2 * np.log2(len(text[i]))) for i in passes}
    learned = [i for i in passes if good.get(i) == 1 and not held(i)]

    def limits(c):
        for reach in range(60):
            near = np.array([seen[i] for i in learned if abs(size[i] - c) <= reach])
            if len(near) >= 200:
                return [(np.quantile(near[:, k], 0.001) * 0.98, np.quantile(near[:, k], 0.999) * 1.02) for k in range(3)]

    low, high = min(size[i] for i in learned), max(size[i] for i in learned)
    known = {c: limits(c) for c in range(low, high + 1)}
    for i, r in got.items():
        want = not r.base_failed and all(a <= x <= b for x, (a, b) in zip(seen[i], known[min(max(size[i], low), high)], strict=True))
        assert r.kept == want
    bad, fine = ([i for i in passes if held(i) and good.get(i) == v] for v in (0, 1))
    assert sum(not got[i].kept for i in bad) >= 0.6 * len(bad) and sum(not got[i].kept for i in fine) < 0.01 * len(fine)


def test_repeat_words_against_brute_force():
    for seed in range(30):
        r = random.Random(seed)
        w = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 25))]
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        assert quality.repeat_words(w) == len(hit)
    assert quality.dup_lines(b"a\nb\na\n\n \na") == 2


def shingles(text, n=5):
    w = text.split()
    k = min(n, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def test_signatures_estimate_weighted_similarity():
    h = WordHashes()
    base = words(300, 5).split()
    other = base[:240] + words(60, 6).split()
    for more in ([], base[:60] * 9 + base[100:130] * 40):  # shingles of weights 1, 10 and 41 beside each other
        x, y = shingles(" ".join(base + more)), shingles(" ".join(other + more))
        a, b = (near_dedup.elements([w.encode() for w in z + more], h) for z in (base, other))
        want = sum((x & y).values()) / sum((x | y).values())
        assert abs((near_dedup.signature(*a, 4096) == near_dedup.signature(*b, 4096)).mean() - want) < 0.05
    assert len(near_dedup.signature(a[0][:1], a[1][:1], 64)) == 64


def test_regions_cover_an_elements_weight_once():
    seed, start, width, weight = near_dedup.regions(np.arange(5, dtype=np.uint64), np.array([1, 2, 3, 8, 9]))
    for w in (1, 2, 3, 8, 9):
        own = sorted(zip(start[weight == w], width[weight == w], strict=True))
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False)) and own[-1][0] < w <= sum(own[-1])
    assert len(set(seed.tolist())) == len(seed)


def test_near_duplicates_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    sh = {i: shingles(t) for i, t in text.items()}
    parent = {i: i for i in text}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(text)
    for i in ids:
        for j in ids:
            if i < j and sh[i] and sh[j] and min(len(sh[i]), len(sh[j])) and sum((sh[i] & sh[j]).values()) >= 0.8 * sum((sh[i] | sh[j]).values()):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = {r.rid: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in ids}


def test_near_pairs_among_texts_of_shared_parts(spark):
    """Texts made of the same few parts fill large buckets of unlike members; each planted pair must be found in them."""
    r, part = random.Random(12), [[words(12, 100 * k + v) for v in range(4)] for k in range(20)]
    texts = []
    for k in range(700):
        own = [r.choices(range(4), (86, 5, 5, 4))[0] for _ in part]
        texts.append(own)
        if k % 14 == 0:
            at = r.randrange(20)
            texts.append([*own[:at], own[at] % 3 + 1, *own[at + 1 :]])
    rows = [(i, " ".join(p[v] for p, v in zip(part, own, strict=True))) for i, own in enumerate(texts)]
    number: dict = {}
    has = np.zeros((len(rows), 20_000), np.float32)
    for i, t in rows:
        for x in shingles(t):
            has[i, number.setdefault(x, len(number))] = 1
    both, n = has @ has.T, has.sum(axis=1)
    near = both >= 0.8 * (n[:, None] + n[None, :] - both)
    group = np.arange(len(rows))
    while (low := np.where(near, group[None, :], len(rows)).min(axis=1)).tolist() != group.tolist():
        group = low
    got = {r.rid: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(number) < 20_000 and 50 < len(rows) - len(set(group.tolist())) and got == dict(enumerate(group.tolist()))


def test_near_duplicate_edges(odd, none):
    got = [(r.rid, r.class_id) for r in near_dedup.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    c = dict(got)
    assert c[1] == c[2] == c[3] and c[4] == 4 and c[5] == 5 and c[7] == 7
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 1
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.drop_near_duplicates(none).count() == 0


def test_mix_reaches_targets(spark):
    rows = [(i, words(20 + i % 90, i), f"s{i % 4}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and r.size == len(dict((i, t) for i, t, _ in rows)[r.doc_id].split())
    assert abs(sum(target.values()) - sum(r.size for r in got)) < 1
    assert all(abs(taken[s] - target[s]) <= 110 for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(docs).collect()))


def test_water_filling(spark):
    t = mixing.source_targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, size long"))
    got = {r.source: r.target for r in t.collect()}
    assert got["a"] == 30 and got[None] == 0 and abs(got["b"] / got["c"] - 2) < 1e-9 and abs(sum(got.values()) - 2010) < 1e-6


def test_mix_edges(odd, none):
    got = mixing.mixed(odd).collect()
    assert len(got) == odd.count() and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.take_mix(odd).columns == odd.columns and mixing.take_mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_language_on_held_out(spark):
    r, rows = random.Random(4), []
    sounds = {"aa": "th er on".split(), "bb": "sch ung ei".split(), "cc": "eau oi ez".split()}
    for i in range(600):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 4))) for _ in range(40)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.language(docs, language.learn(docs)).collect()
    assert all(g.lang_pred == rows[g.doc_id][2] and 0 <= g.score <= 1 for g in got)


def test_language_edges(odd, none):
    d = language.learn(odd)
    got = {r.doc_id: r.lang_pred for r in language.language(odd, d).collect() if r.doc_id}
    assert got[4] == got[5] == got[7] == "und" and got[1] in d
    assert language.learn(none) == {} and {r.lang_pred for r in language.language(odd, {}).collect()} == {"und"}


def windows(text, n=10):
    w = [x.decode() for x in folded_words(text.encode())]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fm_index_finds_all_occurrences():
    r = np.random.default_rng(0)
    text = r.integers(1, 5, 500)
    fm = decontaminate.FMIndex(text, 5, sample=7)
    for n in (1, 3, 6):
        p = np.array([text[k : k + n] for k in range(0, 480, 17)])
        low, high = fm.search(p)
        for k in range(len(p)):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[k]).all()]
            assert sorted(fm.locate(np.arange(low[k], high[k])).tolist()) == want
    low, high = fm.search(np.array([[1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]]))
    assert low[0] >= high[0]


def test_benchmark_hits_against_brute_force(spark):
    r = random.Random(9)
    vocab = [words(1, k) for k in range(12)]
    bench = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([3, 12, 18])))) for k in range(15)] + [(99, None), (98, " "), (None, "x")]
    docs = []
    for k in range(80):
        t = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        if k % 3 == 0:
            t[5:5] = bench[r.randrange(15)][1].split()
        docs.append((k, " ".join(t).title() if k % 2 else ", ".join(t)))
    for block in (1 << 20, 60):
        hits = decontaminate.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), shard_words=200, block_words=block)
        got = {h.doc_id: ([k for s in h.spans for k in range(s.start, s.end)], sorted(h["items"])) for h in hits.collect()}
        for i, t in docs:
            w = [x.decode() for x in folded_words(t.encode())]
            hit, items = set(), set()
            for item, b in bench:
                for win in windows(b) if b and item is not None else ():
                    for k in range(len(w) - len(win) + 1):
                        if tuple(w[k : k + len(win)]) == win:
                            hit |= set(range(k, k + len(win)))
                            items.add(str(item))
            assert got[i] == (sorted(hit), sorted(items))


def test_cut_leaves_no_window(spark, odd, none):
    item = words(25, 77)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    text = "Start here. " + item.upper() + "! And then " + item + " end."
    docs = spark.createDataFrame([(1, text, len(text)), (2, "clean text", 3)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in decontaminate.cut_benchmark(docs, bench).collect()}
    assert got[1].text == "Start here. \n! And then \n end." and got[1].n_chars == len(got[1].text)
    assert got[2].text == "clean text" and got[2].n_chars == 3
    assert decontaminate.cut_benchmark(odd, bench).columns == odd.columns
    assert sorted(map(str, decontaminate.cut_benchmark(odd, bench).collect())) == sorted(map(str, odd.collect()))
    assert decontaminate.benchmark_hits(none, bench).count() == 0
    assert all(not h.spans for h in decontaminate.benchmark_hits(odd, bench.limit(0)).collect())


def brute_repeats(docs, n):
    first = {}
    for i, t in docs:
        w = plain_words((t or "").encode())
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), (i, k))
    out = {}
    for i, t in docs:
        w = plain_words((t or "").encode())
        gone = {p for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < (i, k) for p in range(k, k + n)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("block", [40, 200_000])
def test_repeats_against_brute_force(spark, block):
    r = random.Random(3)
    base = [words(120, k).split() for k in range(6)]
    docs = []
    for k in range(60):
        b = list(base[k % 6])
        for _ in range(k % 4):
            b[r.randrange(len(b))] = words(1, 1000 + k)
        docs.append((k, " ".join(b[r.randrange(40) :] + b[:30])))
    got = repeats.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), block_words=block)
    assert {g.doc_id: (g.n_words, g.n_removed, g.kept_sha256) for g in got.collect()} == brute_repeats(docs, 20)


def test_repeats_of_a_frequent_minimizer(spark):
    """One phrase in many surroundings, some of them copied: no group may hold more than a few stretches of it."""
    r, phrase = random.Random(6), words(9, 70)
    docs = [(k, f"{words(15, 300 + k % 50)} {phrase} {words(15, 400 + k % 40)}") for k in range(90)]
    docs += [(100 + k, f"{docs[r.randrange(90)][1]} x {docs[k][1]}") for k in range(10)]
    got = repeats.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), most_stretches=5).collect()
    assert {g.doc_id: (g.n_words, g.n_removed, g.kept_sha256) for g in got} == brute_repeats(docs, 20)


def test_repeat_edges(odd, none):
    got = repeats.without_repeats(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for g in got:
        by[g.doc_id].append((g.n_words, g.n_removed))
    assert by[2] == [(60, 60)] and by[3] == [(61, 60)] and by[4] == [(0, 0)] and by[6] == [(30_000, 0)] * 2
    assert repeats.without_repeats(none).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_scores_against_brute_force(spark, odd, none, order):
    import math

    r = random.Random(8)
    docs = [(k, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for k in range(40)]
    w = {i: t.split() for i, t in docs}
    grams = lambda t, n: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
    every = [sum((grams(t, n) for t in w.values()), Counter()) for n in range(order + 1)]
    total = sum(map(len, w.values()))
    got = {g.doc_id: g for g in lm_score.backoff_scores(spark.createDataFrame(docs, "doc_id long, text string"), order=order, block_words=100).collect()}
    for i, t in w.items():
        own, score, backed = [grams(t, n) for n in range(order + 1)], 0.0, 0

        def count(g):
            return every[len(g)][g] - own[len(g)][g]

        for k, x in enumerate(t):
            for n in range(order, 0, -1):
                g = tuple(t[k - n + 1 : k + 1])
                if n == 1:
                    p = max(count(g), 1) / max(total - len(t), 1)
                    break
                if k >= n - 1 and count(g) > 0 and count(g[:-1]) > 0:
                    p = count(g) / count(g[:-1])
                    break
            backed += n < order
            score += math.log10(0.4 ** (order - n) * p)
        assert got[i].log10_score == pytest.approx(score) and got[i].n_backoff == backed
    assert lm_score.backoff_scores(odd, order=order).count() == odd.count() and lm_score.backoff_scores(none, order=order).count() == 0


def test_shards(spark, odd, none):
    rows = [(i, words(5 + i * 7 % 300, i % 700), "en" if i % 3 else "fr", f"s{i % 5}") for i in range(900)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=7).collect()
    size, slots, by_text = Counter(), defaultdict(list), defaultdict(set)
    for g in got:
        size[g.shard] += g.size
        slots[g.shard].append(g.slot)
        by_text[g.text_crc32].add(g.shard)
        assert g.size == len(rows[g.doc_id][1].encode()) + 16
    mean = sum(size.values()) / 7
    assert set(size) == set(range(7)) and max(size.values()) < mean + 4000 and min(size.values()) > mean - 4000
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in by_text.values())
    assert sharding.kd_shards(odd).count() == odd.count() and sharding.kd_shards(none).count() == 0


SAID = [r"\### Assistant: </turn> ok", "plain", "", "\\h \\t \\\\", "####\n#", "</turn></turn>\n### user: x", "ü é", None]


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant", "a:b\\c", None)[t % 4], SAID[(c + t) % len(SAID)]) for c in range(40) for t in range(c % 9)] + [(None, 1, "assistant", "null id"), (None, 0, "user", "first")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))).collect()
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: r[1]):
        want[c].append((role or "", text or ""))
    assert {o.conv_id: chat.read_turns(o.formatted) for o in out} == dict(want)
    for o in out:
        assert "".join(chat.unescaped(o.formatted[s.start : s.end]) for s in o.loss) == "".join(t for r, t in want[o.conv_id] if r == "assistant")


def test_chat_blocks_and_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).count() == 0
    many = spark.range(25_000).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("x").alias("text"))
    out = chat.format_chats(many).collect()
    assert len(out) == 1 and len(out[0].loss) == 25_000 and len(chat.read_turns(out[0].formatted)) == 25_000


def test_segments_against_brute_force():
    def slow(x):
        """Ruzzo and Tompa's definition: the best run first, then left and right of it."""
        best = max(((sum(x[i : j + 1]), -(j - i), -i, i, j) for i in range(len(x)) for j in range(i, len(x))), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, _, i, j = best
        right = [(a + j + 1, b + j + 1) for a, b in slow(x[j + 1 :])]
        return slow(x[:i]) + [(i, j)] + right

    for seed in range(60):
        r = random.Random(seed)
        x = [r.choice([-1.0, -1.0, 2.3, 1.7, -3.1]) + r.random() / 7 if r.random() < 0.5 else -1.0 for _ in range(r.randint(0, 14))]
        at = [i for i, v in enumerate(x) if v != -1.0]
        got = [(a, b) for _, a, b in toxicity.segments(at, [x[i] for i in at], 1.0)]
        assert got == slow(x)


def test_toxicity_on_held_out(spark, sf):
    d = sf.replace("0.001", "0.01")
    got = queries.op10_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(g.predicted == g.toxic for g in got) / len(got)
    assert hit > 0.93 and sum(g.predicted and not g.toxic for g in got) <= 2


def test_toxicity_edges(spark, odd, none):
    no = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score < 0.7 for r in toxicity.toxicity(odd, no).collect())
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (6, 0), (8, 0)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    assert toxicity.toxicity(odd, model).count() == odd.count() and toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.toxicity(none, model).count() == 0 and toxicity.learn(none, labels).weights == {}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "shard":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[5] == sizes[4]


TABLES = ("documents", "benchmark", "conversations", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols, plain = sorted(df.columns), lambda v: round(v, 5) if isinstance(v, float) else v
    cur = c.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert sorted(repr([plain(r[k]) for k in cols]) for r in df.collect()) == sorted(repr([plain(r[names.index(k)]) for k in cols]) for r in cur.fetchall())


def test_base_counts_against_brute_force(spark, sf):
    import regex

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for got in quality.quality(docs).join(docs, "doc_id").collect():
        t = got.text or ""
        w = regex.findall(r"[^\x20\x09-\x0D]+", t)
        wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {k for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        lines = [x for x in t.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want
        assert got.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_the_end_of_a_text_is_a_chunk_too(spark):
    r = random.Random(5)
    prose, noise = words(3000, 9)[:8192], "".join(chr(r.randrange(33, 0x2FF)) + (" " if k % 9 == 0 else "") for k in range(1500))
    got = {x.doc_id: x for x in quality.quality(spark.createDataFrame([(1, prose), (2, prose[:4096] + noise)], "doc_id long, text string")).collect()}
    assert got[1].kept and got[2].chunks == 2 and got[2].bad_chunks == 1 and not got[2].kept


def test_language_sizes_against_a_plain_encoder(spark, sf):
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    d = language.learn(docs)
    got = {r.doc_id: r for r in language.language(docs, d).collect()}
    for r in docs.collect():
        text = language.letters_only((r.text or "").encode())
        if got[r.doc_id].lang_pred == "und":
            assert not any(c.isalpha() for c in r.text or "")
            continue
        size = {}
        for lang, data in d.items():
            press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            size[lang] = sum(len(press.compress(text[k : k + (16 << 10)])) for k in range(0, len(text), 16 << 10))
        assert got[r.doc_id].lang_pred == min(size, key=lambda x: (size[x], x))


def test_every_language_is_learned_from_anywhere_in_its_texts(spark):
    head = "Notice: all rights of this page are reserved by its owner and may not be copied. " * 8
    rows = [(i, head + words(200, i), f"l{i % 40}") for i in range(400)] + [(1000 + i, "kurz da", "zz") for i in range(9)]
    d = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), total_bytes=400_000)
    assert set(d) == {f"l{k}" for k in range(40)} | {"zz"} and len(set(d.values())) == 41
    assert all(len(x) <= 400_000 // 41 for x in d.values())


ID_TEXT = [(1, words(80, 21)), (1, words(80, 22)), (1, words(80, 21)), (2, words(80, 22) + " x"), (None, words(80, 23)), (None, words(80, 23) + " y")]


def test_texts_of_one_id_stay_apart(spark):
    docs = spark.createDataFrame(ID_TEXT, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(docs).collect()]
    assert len(kept) == 3 and {t for _, t in kept} >= {ID_TEXT[0][1], ID_TEXT[1][1]}
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(r.class_id for r in got)[2:] == [1, 1, 1, 1] and sum(r.kept for r in got) == 4
    out = repeats.without_repeats(docs).collect()
    assert sorted(r.n_removed for r in out if r.doc_id == 1) == [0, 0, 0]  # a row that repeats is the same document
    assert [r.n_removed for r in out if r.doc_id == 2] == [80]


def test_ids_that_are_no_integers(spark):
    docs = spark.createDataFrame([("a", words(80, 21)), ("b", words(80, 21)), ("7", words(80, 22))], "doc_id string, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    assert sum(r.kept for r in near_dedup.near_duplicates(docs).collect()) == 2
    assert sorted(r.n_removed for r in repeats.without_repeats(docs).collect()) == [0, 0, 80]
    assert sharding.kd_shards(docs, shards=2).count() == 3
    assert decontaminate.benchmark_hits(docs, spark.createDataFrame([(1, words(80, 22))], "item_id long, text string")).where("size(spans) > 0").first().doc_id == "7"


def test_several_blocks_give_what_one_gives(spark):
    w = words(60, 31).split()
    bench = spark.createDataFrame([(k, " ".join(w[10 * k : 10 * k + 15])) for k in range(4)] + [(9, " ".join(w[:5] + w[40:50]))], "item_id long, text string")
    joined = " ".join(w[:5] + w[20:34] + w[40:50])  # cutting the middle joins the last item's words
    rows = [(1, "s " + " ".join(w), "r"), (1, "s " + " ".join(w), "r"), (1, "other text", "r"), (2, joined, None), (3, None, "r"), (4, "", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string").withColumns({"spans": F.lit(1), "n_chars": F.length("text").cast("long"), "row": F.lit("x")})
    one = decontaminate.benchmark_hits(docs, bench)
    assert one.count() == 6
    for block in (60, 20, 1):
        assert sorted(map(repr, decontaminate.benchmark_hits(docs, bench, block_words=block).collect())) == sorted(map(repr, one.collect()))
        cut = decontaminate.cut_benchmark(docs, bench, block_words=block)
        assert cut.columns == docs.columns and sorted(map(repr, cut.collect())) == sorted(map(repr, decontaminate.cut_benchmark(docs, bench).collect()))
        assert all(not h.spans for h in decontaminate.benchmark_hits(cut, bench).collect())


def test_columns_of_any_name_stay(spark):
    names = ("_rid", "_kept", "_turn", "rid", "tag", "row", "turn", "copies", "hit", "spans", "items", "source")
    docs = spark.createDataFrame([(k, words(60, k % 3)) for k in range(6)], "doc_id long, text string").withColumns({n: F.lit("s") for n in names})
    for out in (near_dedup.drop_near_duplicates(docs), mixing.take_mix(docs), decontaminate.cut_benchmark(docs, spark.createDataFrame([(1, words(60, 1))], "item_id long, text string"))):
        assert out.columns == docs.columns and all(r[n] == "s" for r in out.collect() for n in names)


def test_mix_beside_one_huge_document(spark):
    rows = [(i, words(20 + i % 50, i), "a") for i in range(300)] + [(1000, words(9000, 5), "a")] + [(2000 + i, words(30, i), "b") for i in range(900)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.02 * mine[0].target


def test_forty_shards_are_near_equal(spark, sf):
    d = sf.replace("0.001", "0.1")
    got = sharding.kd_shards(spark.read.parquet(f"{d}/documents.parquet")).groupBy("shard").agg(F.sum("size").alias("s"), F.count("slot").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    mean = sum(r.s for r in got) / 40
    assert len(got) == 40 and all(0.97 * mean < r.s < 1.03 * mean and r.n == r.d == r.m + 1 for r in got)


def test_leaves_against_a_plain_tree(spark):
    """The tree of a few points, none of which tips a cut, built in plain Python."""
    r = random.Random(4)
    pts = [(k, r.randrange(1 << 24) << 24, r.randrange(1 << 24) << 24) for k in range(256)]

    def leaves(p, first, m):
        if m == 1:
            return {k: first for k, _, _ in p}
        axis = max((1, 2), key=lambda i: ((max(x[i] for x in p) >> 24) - (min(x[i] for x in p) >> 24), -i))
        p = sorted(p, key=lambda x: x[axis])
        n = len(p) * (m // 2) // m
        return leaves(p[:n], first, m // 2) | leaves(p[n:], first + m // 2, m - m // 2)

    df = spark.createDataFrame([(*p, 1) for p in pts], "k long, x long, y long, weight long")
    assert {g.k: g.leaf for g in sharding.kd_leaves(df, 16, ["x", "y"]).collect()} == leaves(pts, 0, 16)


def test_ranks_of_whole_values(spark):
    names = [f"https://example.org/{k:03d}" for k in range(50)]
    rows = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "source string").repartition(5)
    assert {g.value: g["rank"] for g in sharding._ranks(rows, "source").collect()} == {n: k + 1 for k, n in enumerate(names)}


def test_segments_of_a_very_long_text():
    import time

    began = time.time()
    for weight in (0.5, 1.0, 3.0):
        toxicity.segments(list(range(0, 300_000, 3)), [weight] * 100_000, 0.9)
    assert time.time() - began < 5


def test_pipeline_stages_against_brute_force(spark, sf):
    """Each stage on what the one before it kept, against what its contract says of single rows."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = lambda df: spark.createDataFrame(df.collect(), df.schema)
    clean = held(stages["toxicity"](spark, docs, sf))
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, x in score.items() if x < 0.7}
    apart = held(stages["near_dedup"](spark, clean, sf)).collect()
    sh = {r.doc_id: shingles(r.text or "") for r in clean.collect()}
    kept = {r.doc_id for r in apart}
    near = lambda a, b: bool(sh[a] and sh[b]) and sum((sh[a] & sh[b]).values()) >= 0.8 * sum((sh[a] | sh[b]).values())
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    reached, new = set(kept), list(kept)
    while new:
        a = new.pop()
        more = [b for b in sh if b not in reached and near(a, b)]
        reached |= set(more)
        new += more
    assert reached == set(sh)
    apart = spark.createDataFrame(apart, docs.schema)
    cut = held(stages["decontaminate"](spark, apart, sf))
    wins = set().union(*(windows(b.text) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()))
    for a, b in zip(apart.orderBy("doc_id").collect(), cut.orderBy("doc_id").collect(), strict=True):
        w = [x.decode() for x in folded_words((b.text or "").encode())]
        assert not any(tuple(w[k : k + n]) in wins for n in {len(x) for x in wins} for k in range(len(w) - n + 1))
        assert (a.text == b.text) == (a.text is None or not windows(a.text) & wins)
    mix = held(stages["mix"](spark, cut, sf))
    often = {r.doc_id: r.copies for r in mixing.mixed(cut).collect()}
    assert Counter(r.doc_id for r in mix.collect()) == {i: n for i, n in often.items() if n}
    out = stages["shard"](spark, mix, sf).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mix.collect())


def test_pipeline_on_odd_and_empty_tables(spark, sf, odd, none, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd), ("none", none)):
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert (corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() > 0) == (name == "odd")


def test_quality_limits_come_from_every_good_row(spark):
    import inspect

    import numpy as np

    r = random.Random(8)
    rows = [(n, *(r.random() for _ in range(3))) for n in (r.choice([300, 361, 362, 363, 512, 700, 9000]) for _ in range(21_000))] + [(1, 0.5, 0.5, 0.5)]
    known = quality.fitted(spark.createDataFrame(rows, "size long, ratio double, least double, most double"), 512).known
    own = np.array([quality.length_class(x[0]) for x in rows])
    assert list(sorted(known)) == list(range(own.min(), own.max() + 1))
    for c, limits in known.items():
        reach = next(k for k in range(99) if (abs(own - c) <= k).sum() >= 200)
        near = np.array(rows)[abs(own - c) <= reach]
        for k, (low, high) in enumerate(limits, 1):
            assert abs(low / 0.98 - np.quantile(near[:, k], 0.001)) < 2e-5 and abs(high / 1.02 - np.quantile(near[:, k], 0.999)) < 2e-5
    assert "most_rows" not in inspect.signature(quality.learn).parameters


def test_near_duplicates_meet_in_small_batches(spark):
    before = spark.conf.get(NAME)

    def rows(batches):
        import pyarrow as pa  # a worker does not know this module

        yield from (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches)

    with small_batches(spark, 1):
        many = spark.range(2000).selectExpr("repeat('x', 2000) AS t").coalesce(1).mapInArrow(rows, "n long").collect()
    assert spark.conf.get(NAME) == before and len(many) >= 4 and sum(r.n for r in many) == 2000
    docs = spark.createDataFrame([(k, words(300, k // 2) + (" more" if k % 2 else "")) for k in range(20)], "doc_id long, text string")
    assert {r.rid: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == {k: k - k % 2 for k in range(20)}
    assert spark.conf.get(NAME) == before

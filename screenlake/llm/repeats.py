r"""Operator 6: repeated passages found with sharded Aho-Corasick automata.

A window of ``width`` words that also starts earlier (smaller doc_id, or earlier in the document) is removed.
Windows with equal words share a minimizer, the least hash of their ``gram``-word runs, so they
are dealt by it to shards: (1) every document gives the minimizers of its windows, one for each stretch of
windows; (2) those met only once cannot repeat and go; (3) the words of the remaining stretches go to
the shard of their minimizer, equal ones of a batch once. There the windows that recur are confirmed word by word, those that only occur together
joined to passages, and these compiled into an automaton, through which all stretches stream; every occurrence but the first is a removal span.

Scale: what is shuffled is one number per seven words, the documents that hold a recurring minimizer, and
those stretches. A minimizer met twice in one Arrow batch sends a row a batch to be counted, not a row a document; equal stretches of a
batch send one row, and the others are spans at once. A shard's group has at most ``most_stretches`` stretches. A more frequent minimizer has no
group: its stretches are dealt by their own words, and what is left, one of each, by single windows, whose first places come from partial aggregates.

Defined cases: null, empty and wordless texts lose nothing and keep ''; texts of fewer than ``width`` words lose nothing;
rows that repeat a doc_id and text are one document and fare alike; of texts that share a doc_id the one of the smaller hash comes
first; a null doc_id takes a negative number made from its text, which counts as smaller, and so does one that is no integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.functions.storage import stored
from screenlake.llm.text import WordHashes, gram_hashes, plain_words, row_key


def stretches(words: list[bytes], hashes: WordHashes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of each run of windows with one minimizer position."""
    if len(words) < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    g = gram_hashes(hashes.of(words), gram)
    at = np.lib.stride_tricks.sliding_window_view(g, width - gram + 1).argmin(axis=1)
    at = at + np.arange(len(at))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return g[at[first]].view(np.int64), first, np.diff(np.append(first, len(at)))


def _minimizers(width: int, gram: int):
    """(h, rid, n, known) of a document's minimizers, each with its stretches. One met twice in a batch is known to recur, and one row without rid tells of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            own = [np.unique(stretches(plain_words(text.as_py()), hashes, width, gram)[0], return_counts=True) for text in batch.column(1).cast(pa.binary())]
            h, n = (np.concatenate([x[k] for x in own]) if own else np.zeros(0, np.int64) for k in (0, 1))
            rid = pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x, _ in own]), pa.int64())
            distinct, at = np.unique(h, return_inverse=True)
            often = np.bincount(at, weights=n, minlength=len(distinct)) > 1
            twice = distinct[often]
            known = np.concatenate((often[at], np.zeros(len(twice), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((h, twice)), pa.int64()), pa.concat_arrays([rid, pa.nulls(len(twice), pa.int64())]), pa.array(np.concatenate((n, np.zeros(len(twice), np.int64))), pa.int32()), pa.array(known, pa.bool_())], ["h", "rid", "n", "known"])

    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (known, h), those known and those whose h occurs twice or more; one row is held back between batches."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([*([held[0]] if held else []), batch]).combine_chunks()
        h, known = t.column("h").to_numpy(), t.column("known").to_numpy()
        same = (h[1:] == h[:-1]) & ~known[1:]
        keep = np.concatenate(([held[1] if held else False], same)) | np.concatenate((same, [False])) | known
        keep &= ~np.asarray(t.column("rid").is_null())
        last = len(h) - 1
        yield from t.slice(0, last).filter(pa.array(keep[:last])).select(["h", "rid", "n"]).to_batches()
        # of the held row: whether an equal one came before it
        held = (t.slice(last).to_batches()[0], bool(same[-1]) if last else bool(held and held[1]))
    if held:
        last = held[0]
        if last.column("rid")[0].is_valid and (held[1] or last.column("known")[0].as_py()):
            yield last.select(["h", "rid", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, since they are shuffled twice."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        k = batch.schema.get_field_index("text")
        zipped = [None if t is None else press.compress(t) for t in batch.column(k).cast(pa.binary()).to_pylist()]
        yield batch.set_column(k, "text", pa.array(zipped, pa.binary()))


def _plain(zipped: list[bytes | None]) -> Iterator[bytes | None]:
    press = zstandard.ZstdDecompressor()
    return (None if z is None else press.decompress(z) for z in zipped)


def _table(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


PIECE = "kind int, h long, rid long, tag long, first int, end int, words binary"
COLD, HOT, SPAN = range(3)  # a stretch for the shard of its minimizer; one dealt by its words; a span that is known already


def _split(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of the minimizers found, which are frequent."""
    for batch in batches:
        h = batch.column("found")
        hot = pa.ListArray.from_arrays(h.offsets, pa.array(np.isin(h.values.to_numpy(), frequent), pa.bool_()))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), h, hot], ["rid", "found", "hot"])


def _pieces(width: int, gram: int):
    """The words of the stretches whose minimizer recurs; of equal ones in a batch the first, the others are spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            least: dict[bytes, tuple] = {}  # (rid, tag, first, end, h, whether frequent)
            spans: list[tuple] = []
            for rid, tag, text, found, hot in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _plain(batch.column(2).to_pylist()), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                words, wanted = plain_words(text), dict(zip(found, hot, strict=True))
                for h, first, n in zip(*(c.tolist() for c in stretches(words, hashes, width, gram)), strict=True):
                    frequent = wanted.get(h)
                    if frequent is None:
                        continue
                    end = first + n + width - 1
                    piece, place = b" ".join(words[first:end]), (rid, tag, first, end, h, frequent)
                    was = least.setdefault(piece, place)
                    if was is place or was[:3] == place[:3]:
                        continue
                    if place < was:
                        least[piece], place = place, was
                    if spans and spans[-1][2:4] == place[:2] and spans[-1][4] <= place[2] <= spans[-1][5]:
                        spans[-1] = (*spans[-1][:5], max(spans[-1][5], place[3]), None)
                    else:
                        spans.append((SPAN, place[0], *place[:4], None))
            spans += [(HOT if p[5] else COLD, xxhash.xxh3_64_intdigest(x) - (1 << 63) if p[5] else p[4], *p[:4], x) for x, p in least.items()]
            yield _table(spans, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), ["kind", "h", "rid", "tag", "first", "end", "words"])

    return run


SALTS = 16
MOST_SENT = 1_000_000  # frequent minimizers sent to every task; beyond that they are joined
PLACE = "rid", "tag", "first"


def _windows(width: int):
    """The windows of texts, each with its own place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words.split(b" ")
                out.extend((b" ".join(w[k : k + width]), place["rid"], place["tag"], place["first"] + k) for k in range(len(w) - width + 1))
            yield _table(out, (pa.binary(), pa.int64(), pa.int64(), pa.int32()), ["words", *PLACE])

    return run


def _by_window(texts: DataFrame, width: int) -> DataFrame:
    """(rid, tag, start, end) of the windows of texts (words, place) that also start earlier, dealt by their own words."""
    windows = texts.mapInArrow(_windows(width), "words binary, rid long, tag long, first int")
    place = F.struct(*PLACE)
    firsts = windows.groupBy("words").agg(F.min(place).alias("least"), F.max(place).alias("last")).where("least < last")
    firsts = firsts.select("words", "least", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    salted = windows.withColumn("salt", F.pmod(F.xxhash64(*PLACE), F.lit(SALTS)).cast("int"))
    later = salted.join(firsts.hint("merge"), ["words", "salt"]).where(place > F.col("least"))
    return later.select("rid", "tag", F.col("first").alias("start"), (F.col("first") + width).alias("end"))


class Codes(dict):
    """One character for each word met; the surrogates' range is left out."""

    def __missing__(self, word: bytes) -> str:
        n = len(self) + 1
        c = self[word] = chr(n if n < 0xD800 else n + 0x800)
        return c


def _passages(lines: list[tuple[str, int]], width: int) -> dict[str, int]:
    """Of texts with their numbers of places the recurring windows, joined where they occur only together, and how often each occurs."""
    count: dict[str, int] = {}
    after: dict[str, str | None] = {}
    for x, places in lines:
        last = None
        for k in range(len(x) - width + 1):
            w = x[k : k + width]
            count[w] = count.get(w, 0) + places
            if last is not None and after.setdefault(last, w) != w:
                after[last] = None
            last = w
        after[last] = None  # a text ends with it
    out: dict[str, int] = {}
    for x, _ in lines:
        begin, last = 0, None
        for k in range(len(x) - width + 2):
            w = x[k : k + width] if k <= len(x) - width else None
            if last is not None and (w is None or after[last] != w or count[w] != count[last]):
                if count[last] > 1:
                    out[x[begin : k - 1 + width]] = count[last]
                begin = k
            last = w
    return out


def repeated_spans(groups: list[dict[bytes, list[tuple[int, int, int]]]], width: int) -> list[tuple[int, int, int, int]]:
    """(rid, tag, start, end) of windows that start earlier too. groups: for each minimizer the places (rid, tag, first word), in order, of each text."""
    code = Codes().__getitem__
    lines: list[tuple[str, list[tuple[int, int, int]]]] = []
    automaton = ahocorasick.Automaton()
    for texts in groups:
        own = [("".join(map(code, words.split(b" "))), places) for words, places in texts.items()]
        lines += own
        # a text that is alone with its minimizer recurs as a whole
        for w in _passages([(x, len(p)) for x, p in own], width) if len(own) > 1 else [own[0][0]] if len(own[0][1]) > 1 else ():
            automaton.add_word(w, w)
    if not len(automaton):
        return []
    automaton.make_automaton()
    hits = [[(end - len(w) + 1, w) for end, w in automaton.iter(x)] for x, _ in lines]
    least: dict[str, tuple[int, int, int]] = {}
    for found, (_, places) in zip(hits, lines, strict=True):
        rid, tag, first = places[0]
        for k, w in found:
            place = (rid, tag, first + k)
            if place < least.setdefault(w, place):
                least[w] = place
    spans = []
    for found, (_, places) in zip(hits, lines, strict=True):
        if len(places) > 1:  # all that recurs in it starts earlier, at the first place at least
            runs = _runs([(k, k + len(w)) for k, w in found])
            spans += [(rid, tag, first + a, first + b) for rid, tag, first in places[1:] for a, b in runs]
        rid, tag, first = places[0]
        spans += [(rid, tag, first + a, first + b) for a, b in _runs([(k, k + len(w)) for k, w in found if (rid, tag, first + k) > least[w]])]
    return spans


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order of their ends, merged."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _automata(width: int, block_words: int):
    """Rows sorted by kind, h and place. Of texts dealt by their words the first goes on, with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), ["rid", "tag", "start", "end", "words"]
        groups: list[dict[bytes, list[tuple[int, int, int]]]] = []
        texts: dict[bytes, list[tuple[int, int, int]]] = {}
        first_of: dict[bytes, tuple[int, int, int]] = {}
        held, last, hot = 0, None, None
        for batch in batches:
            out: list[tuple] = []
            for kind, h, rid, tag, first, end, words in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if kind == COLD:
                    if h != last:
                        if held >= block_words:  # a block ends with a minimizer
                            out += [(*x, None) for x in repeated_spans(groups, width)]
                            groups, held = [], 0
                        last, texts = h, {}
                        groups.append(texts)
                    places = texts.get(words)
                    if places is None:
                        texts[words] = [(rid, tag, first)]
                        held += end - first
                    else:
                        held += 1
                        if places[-1] != (rid, tag, first):  # a row that repeats is the same document
                            places.append((rid, tag, first))
                elif kind == HOT:
                    if h != hot:
                        hot, first_of = h, {}
                    place = first_of.get(words)
                    if place is None:
                        first_of[words] = (rid, tag, first)
                        out.append((rid, tag, first, end, words))
                    elif place != (rid, tag, first):
                        out.append((rid, tag, first, end, None))
                else:
                    out.append((rid, tag, first, end, None))
            yield _table(out, kinds, names)
        yield _table([(*x, None) for x in repeated_spans(groups, width)], kinds, names)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, text_out, sha = [], [], [], []
        for text, spans in zip(_plain(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
            words = plain_words(text)
            kept = words
            if spans:
                off = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    off[min(s["start"], len(words))] += 1
                    off[min(s["end"], len(words))] -= 1
                keep = (np.cumsum(off)[:-1] == 0).tolist()
                kept = [w for w, k in zip(words, keep, strict=True) if k]
            out = b" ".join(kept)
            n.append(len(words))
            gone.append(len(words) - len(kept))
            text_out.append(out.decode())
            sha.append(hashlib.sha256(out).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text_out, pa.string()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def without_repeats(docs: DataFrame, width: int = 20, gram: int = 8, block_words: int = 200_000, most_stretches: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) per row of ``docs``; kept is the text's remaining words, one space between."""
    cut = docs.select(F.col(id_col).alias("doc_id"), *row_key(docs, id_col, text_col), F.col(text_col).cast("string").alias("text"))
    kind = cut.schema["doc_id"].dataType.simpleString()
    marks = cut.select("rid", "text").mapInArrow(_minimizers(width, gram), "h long, rid long, n int, known boolean")
    # a frequent minimizer sends a row a batch to its task, not a row a document
    dealt = marks.repartition(F.when(F.col("known"), F.xxhash64("rid")).otherwise(F.col("h"))).sortWithinPartitions("known", "h")
    found = stored(dealt.mapInArrow(_recurring, "h long, rid long, n int").groupBy("rid").agg(F.collect_set(F.struct("h", "n")).alias("found")), "recurring")
    each = found.select("rid", F.explode("found").alias("f")).select("rid", "f.h", "f.n")
    hot = stored(each.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > most_stretches).select("h"), "frequent")
    n_hot = hot.count()
    if n_hot <= MOST_SENT:
        frequent = hot.toArrow().column("h").to_numpy()
        found = found.select("rid", F.col("found.h").alias("found")).mapInArrow(lambda batches: _split(batches, frequent), "rid long, found array<long>, hot array<boolean>")
    else:
        marked = each.join(hot.withColumn("hot", F.lit(True)), "h", "left").groupBy("rid").agg(F.collect_list(F.struct("h", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("found"))
        found = marked.select("rid", F.col("found.h").alias("found"), F.col("found.hot").alias("hot"))
    packed = cut.mapInArrow(_packed, f"doc_id {kind}, rid long, tag long, text binary")
    pieces = packed.select("rid", "tag", "text").join(found.hint("merge"), "rid").select("rid", "tag", "text", "found", "hot").mapInArrow(_pieces(width, gram), PIECE)
    shards = pieces.repartition("h").sortWithinPartitions("kind", "h", *PLACE)
    spans = shards.mapInArrow(_automata(width, block_words), "rid long, tag long, start int, end int, words binary")
    if n_hot:
        spans = stored(spans, "spans")
        texts = spans.where("words is not null").select("words", F.struct("rid", "tag", F.col("start").alias("first")).alias("place"))
        spans = spans.where("words is null").drop("words").unionByName(_by_window(texts, width))
    spans = spans.groupBy("rid", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    last = packed.join(spans.hint("merge"), ["rid", "tag"], "left").select("doc_id", "text", "spans")
    return last.mapInArrow(_kept, f"doc_id {kind}, n_words long, n_removed long, kept string, kept_sha256 string")

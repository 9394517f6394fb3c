"""Operator 4: language by compression with one raw-content dictionary per language.

Each language's dictionary is text of that language; a text belongs to the language whose dictionary
makes its zstandard frames smallest. Texts are reduced to their words first. Long texts are encoded whole, in chunks, and the sizes add up.
The saved bits become a score; where the runner-up is within ``margin`` of the winner the answer is marked as rejected.

Scale: learning reads a bounded sample, about ``sample_docs`` documents a language (by hash of doc_id), each of which gives a piece from a place
in its text that a hash chooses. All languages together get ``total_bytes`` of dictionaries, one language ``dict_bytes`` at most; that
much is broadcast. Prediction is one narrow pass over whole texts.

Defined cases: null texts and texts without a letter are `und` with score 0; null languages are not learned from; if nothing
can be learned all is `und`; ties go to the language first by code point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.functions.storage import stored
from screenlake.llm.toxicity import fold_of


def letters_only(text: bytes) -> bytes:
    """Lower-case words of ASCII letters and of all bytes beyond ASCII, one space between: markup and figures tell nothing of a language."""
    return b" ".join(text.translate(_LETTERS).split())


_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def learn(docs: DataFrame, sample_docs: int = 300, dict_bytes: int = 112 << 10, total_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries from documents outside the held-out fold (crc32(doc_id as text) mod 3 = 1). Equal texts give one piece."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where((fold_of(F.col("doc_id")) != 1) & F.col("lang").isNotNull())
    counts = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langs")
    langs = counts.count()
    if not langs:
        return {}
    share = max(64, min(dict_bytes, total_bytes // langs))
    docs_each = max(1, min(sample_docs, share // 64))
    each = max(64, share // docs_each)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # twice as many as needed, since copies give one piece
    picked = rows.join(counts, "lang").where(part.cast("double") * F.col("n") < 2.0 * docs_each * (1 << 30))
    room = F.greatest(F.length("text") - each, F.lit(0)) + 1
    begin = F.pmod(F.xxhash64("text", F.lit("place")), room) + 1
    picked = picked.select("lang", part.alias("part"), F.xxhash64("text").alias("print"), F.substring("text", begin, F.lit(each)).alias("text"), (begin > 1).alias("inner"), (begin < room).alias("cut")).collect()
    out, seen = {}, set()
    pieces: dict[str, list[bytes]] = {}
    for r in sorted(picked, key=lambda r: (r.lang, r.part, r.print)):
        own = pieces.setdefault(r.lang, [])
        if (r.lang, r.print) not in seen and len(own) < docs_each:
            seen.add((r.lang, r.print))
            words = r.text.split()  # a place inside a text may cut words
            own.append(letters_only(" ".join(words[int(r.inner) : len(words) - int(r.cut)]).encode()))
    for lang, own in pieces.items():
        if data := b"\n".join(x for x in own if x)[:share]:
            out[lang] = data.rjust(8)  # zstandard takes no less
    return out


def _sizes(dictionaries: dict[str, bytes], chunk: int, level: int, temper: float, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = {}
        for lang, data in dictionaries.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            press[lang] = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        for batch in batches:
            langs, scores, weak = [], [], []
            for cell, letters in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                b = cell.as_py()
                if not letters or not press:
                    langs.append("und")
                    scores.append(0.0)
                    weak.append(True)
                    continue
                b = letters_only(b)
                parts = [b[k : k + chunk] for k in range(0, len(b), chunk)]
                size = sorted((sum(len(f(p)) for p in parts), lang) for lang, f in press.items())
                best = size[0][0]
                langs.append(size[0][1])
                scores.append(1 / sum(math.exp(-min(700.0, 8 * math.log(2) * (n - best) / temper)) for n, _ in size))
                weak.append(len(size) > 1 and size[1][0] - best < margin * best)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(weak, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def language(docs: DataFrame, dictionaries: dict[str, bytes], chunk: int = 16 << 10, level: int = 3, temper: float = 8.0, margin: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per row of ``docs``."""
    text = F.col(text_col).cast("string")
    cut = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = cut.schema["doc_id"].dataType.simpleString()
    return cut.mapInArrow(_sizes(dictionaries, chunk, level, temper, margin), f"doc_id {kind}, lang_pred string, score double, rejected boolean")

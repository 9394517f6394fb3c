"""Words and hashes of texts, on UTF-8 bytes, shared by the operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased; all others become spaces
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
FOLD = bytes((c + 32) if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))
U = np.uint64


def row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """rid and tag: the two numbers that tell a row of ``docs`` from all others but its repeats.

    rid is the id as a long; where it is null, or no integer, a negative number made from the text or the id. tag is a hash of the text.
    """
    text, plain = F.col(text_col).cast("string"), F.col(id_col)
    stand_in = lambda c: -F.pmod(F.xxhash64(c), F.lit(1 << 61)) - 1
    number = plain.try_cast("long")
    return F.when(plain.isNull(), stand_in(text)).otherwise(F.coalesce(number, stand_in(plain.cast("string")))).alias("rid"), F.xxhash64(text).alias("tag")


def plain_words(text: bytes | None) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+`: bytes.split() cuts at just these six ASCII characters."""
    return text.split() if text else []


def folded_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all at ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 500_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on an array of uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` hashes in ``h``; none if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for k in range(n):
        out = out * U(0x9E3779B97F4A7C15) + h[k : k + m]
        out ^= out >> U(29)
    return mixed(out)

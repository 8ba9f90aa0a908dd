"""Shared word handling: a word is a run of bytes other than space and \\t \\n \\v \\f \\r."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Entries a worker's word cache may hold before it starts anew.
CACHE_LIMIT = 400_000


def words_of(text: Column) -> Column:
    """Array of the words of a text column (null text: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


class WordIds(dict):
    """Word bytes -> signed 64-bit xxHash, remembered up to CACHE_LIMIT words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        value = xxhash.xxh64_intdigest(word, 17)
        value = value - (1 << 64) if value >= 1 << 63 else value
        self[word] = value
        return value


def hashed_words(text: bytes, ids: WordIds) -> np.ndarray:
    """Hashes of the words of a text, A-Z lowered."""
    words = text.lower().split()
    return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (murmur finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def column_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts in a row, A-Z lowered; how many words each text has). Made from the column's bytes
    at once, eight bytes of all words at a time; not the hashes of `hashed_words`."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = b"" if len(column) == 0 or column.buffers()[2] is None else column.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().lower()
    ends = ends - ends[0]
    letter = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    first = np.flatnonzero(letter & np.append(True, ~letter[:-1] | edge[1:-1])[: len(letter)])
    last = np.flatnonzero(letter & np.append(~letter[1:] | edge[1:-1], True)[: len(letter)])
    left = last - first + 1
    eights = np.ndarray(len(data) + 1, np.uint64, data + bytes(8), strides=(1,))
    hashes = mix(left.astype(np.uint64))
    at, todo = first.copy(), np.arange(len(first))
    while len(todo):
        spare = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        hashes[todo] = mix(hashes[todo] ^ (eights[at] << spare)) + np.uint64(1)
        more = left > 8
        at, left, todo = at[more] + 8, left[more] - 8, todo[more]
    return hashes, np.diff(np.searchsorted(first, ends))

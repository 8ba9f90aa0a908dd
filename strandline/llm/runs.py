"""Periodic runs of words by an enhanced suffix array: branching tandem repeats, rotated and merged into runs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .words import text_bytes

#: Words, about, whose suffixes a task sorts together; suffixes it tests for squares together.
BLOCK_WORDS, TEST_ROWS = 150_000, 1 << 20
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Numbers(dict):
    """Word -> number in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class SuffixArray:
    """Suffixes of several number sequences laid end to end; a suffix ends with its sequence.

    `levels[l][i]` is the rank of the 2^l numbers from i on: how many suffixes of all sequences are less in them. Two
    places have one rank exactly if 2^l equal numbers follow in both. Ranks are doubled until every suffix has one of its own:
    that last level is the inverse suffix array. A suffix that is alone with its rank is settled and not sorted again.
    """

    def __init__(self, numbers: np.ndarray, starts: np.ndarray, at_most: int | None = None) -> None:
        n = self.n = len(numbers)
        sizes = np.diff(np.append(starts, n))
        self.owner = np.repeat(np.arange(len(starts)), sizes)
        self.first, self.end = starts[self.owner], (starts + sizes)[self.owner]
        self.levels: list[np.ndarray] = []
        live, rank, key = np.arange(n), np.zeros(n, dtype=np.int64), self.owner * (int(numbers.max(initial=0)) + 1) + numbers
        while True:
            order = np.argsort(key, kind="stable")
            place, sorted_key, old = live[order], key[order], rank[live[order]]
            count = np.arange(len(place))
            group = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, count, 0))
            opens = np.append(True, np.diff(sorted_key) != 0)[: len(place)]
            inner = np.maximum.accumulate(np.where(opens, count, 0))
            rank = rank.copy()
            rank[place] = old + inner - group
            self.levels.append(rank.astype(np.int32))
            alone = opens & np.append(opens[1:], True)[: len(place)]
            live = np.sort(place[~alone])
            if not len(live) or len(self.levels) == at_most:
                break
            after = live + (1 << (len(self.levels) - 1))
            # Nothing follows a suffix that ends before: it is the least of its group, and alone.
            key = rank[live] * (n + 1) + np.where(after < self.end[live], rank[np.minimum(after, n - 1)] + 1, 0)
        self.unsettled = live

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many equal numbers follow places a and b of one sequence."""
        size = np.zeros(len(a), dtype=np.int64)
        for level in reversed(range(len(self.levels))):
            rank = self.levels[level]
            x, y = a + size, b + size
            here = (x < self.end[a]) & (y < self.end[b])
            size += (here & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)])).astype(np.int64) << level
        return size

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many equal numbers stand before places a < b of one sequence."""
        size = np.zeros(len(a), dtype=np.int64)
        for level in reversed(range(len(self.levels))):
            rank = self.levels[level]
            x = a - size - (1 << level)
            here = x >= self.first[a]
            size += (here & (rank[np.maximum(x, 0)] == rank[np.maximum(x + b - a, 0)])).astype(np.int64) << level
        return size

    def enhance(self) -> None:
        """The suffix array, its inverse and the common prefixes of neighbours; 0 where a sequence begins and at the end."""
        self.inverse = self.levels[-1].astype(np.int64)
        self.suffix = np.empty(self.n, dtype=np.int64)
        self.suffix[self.inverse] = np.arange(self.n)
        self.lcp = np.zeros(self.n + 1, dtype=np.int64)
        a, b = self.suffix[:-1], self.suffix[1:]
        at = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
        self.lcp[at + 1] = self.common(a[at], b[at])

    def reach(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(left, right): the interval of suffixes left, ..., right - 1 whose least common prefix with a neighbour is
        that of boundary `at`, which must be positive."""
        depth, least = self.lcp[at], [self.lcp]
        while 2 << (len(least) - 1) <= self.n + 1:
            low, half = least[-1], 1 << (len(least) - 1)
            least.append(np.minimum(low[:-half], low[half:]))
        left, right = at.copy(), at + 1
        for level in reversed(range(len(least))):
            step, low = 1 << level, least[level]
            onward = (right < len(low)) & (low[np.minimum(right, len(low) - 1)] >= depth)
            right += onward * step
            onward = (left >= step) & (low[np.clip(left - step, 0, len(low) - 1)] >= depth)
            left -= onward * step
        return left - 1, right


def branching_squares(array: SuffixArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of every square whose period is not kept by the word behind it.

    The suffixes of an interval of common prefixes of depth d fall into children, within which they agree beyond d. For
    each suffix i of every child but the largest, the inverse array says whether i + d or i - d lies in the interval and
    outside the child: then a square of period d begins at the earlier of the two. A pair of places that lie in two
    children is seen from a smaller one, so none is missed, and n log n tests do.
    """
    at = np.flatnonzero(array.lcp > 0)
    if not len(at):
        return
    left, right = array.reach(at)
    order = np.argsort(left * (array.n + 1) + right, kind="stable")
    at, left, right = at[order], left[order], right[order]
    opens = np.append(True, (np.diff(left) != 0) | (np.diff(right) != 0))
    interval = np.cumsum(opens) - 1
    last = np.append(opens[1:], True)
    # Children: from an interval's left end to its first boundary, and from each boundary to the next.
    start = np.concatenate([left[opens], at])
    stop = np.concatenate([at[opens], np.where(last, right, np.append(at[1:], 0))])
    of = np.concatenate([np.arange(interval[-1] + 1), interval])
    order = np.lexsort((stop - start, of))
    smaller = order[np.append(np.diff(of[order]) == 0, False)]
    start, stop, of = start[smaller], stop[smaller], of[smaller]
    left, right, depth = left[opens][of], right[opens][of], array.lcp[at[opens]][of]
    until = np.cumsum(stop - start)
    for first in range(0, int(until[-1]), TEST_ROWS):
        t = np.arange(first, min(first + TEST_ROWS, until[-1]))
        child = np.searchsorted(until, t, side="right")
        i, d = array.suffix[stop[child] - until[child] + t], depth[child]
        for other, square in ((i + d, i), (i - d, i - d)):
            inside = (other >= array.first[i]) & (other < array.end[i])
            rank = array.inverse[np.clip(other, 0, array.n - 1)]
            found = inside & (rank >= left[child]) & (rank < right[child]) & ((rank < start[child]) | (rank >= stop[child]))
            yield square[found], d[found]


def find_runs(numbers: np.ndarray, starts: np.ndarray, least: int = 6, repeats: int = 4) -> np.ndarray:
    """Rows (sequence, start, length, period), in this order, of the runs of sequences of numbers laid end to end.

    A run is a longest stretch of a smallest period q that holds max(least, repeats * q) numbers or more, `repeats` being 2
    at least. Its last square branches, so it is found; the square is rotated to the left by the ranks of words before
    it, as far as the period is kept, and squares that reach one stretch, those of multiples of its period, are merged into
    a run of the least of their periods.
    """
    empty = np.empty((0, 4), dtype=np.int64)
    if not len(numbers):
        return empty
    array = SuffixArray(numbers, starts)
    array.enhance()
    found = []
    for place, period in branching_squares(array):
        end = place + 2 * period
        begin = place - array.common_before(place, place + period)
        long = end - begin >= np.maximum(least, repeats * period)
        found.append(np.stack([array.owner[place], begin, end - begin, period], axis=1)[long])
    rows = np.concatenate(found) if found else empty
    rows = rows[np.lexsort(rows.T[::-1])]
    rows = rows[np.append(True, (np.diff(rows[:, :3], axis=0) != 0).any(axis=1))[: len(rows)]]
    rows[:, 1] -= starts[rows[:, 0]]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def runs_of(sequences: list[np.ndarray], least: int = 6, repeats: int = 4) -> list[np.ndarray]:
    """For each sequence, its runs as rows (start, length, period) by start, then period.

    The numbers of a run but its last q stand q later as well. So a sequence in which no 2^l numbers in a row stand
    twice, 2^l being at most the fewest such numbers of any q, has no run; only the others' suffixes are sorted to the end.
    """
    if not sequences:
        return []
    sizes = np.array([len(s) for s in sequences])
    numbers, starts = np.concatenate(sequences).astype(np.int64), np.cumsum(sizes) - sizes
    kept = max(1, min(max(least, repeats * q) - q for q in range(1, least + 1)))
    first = SuffixArray(numbers, starts, at_most=kept.bit_length())
    asked = np.unique(first.owner[first.unsettled])
    out = [np.empty((0, 3), dtype=np.int64)] * len(sequences)
    if len(asked):
        some = sizes[asked]
        rows = find_runs(np.concatenate([sequences[i] for i in asked]).astype(np.int64), np.cumsum(some) - some, least, repeats)
        for i, part in zip(asked[np.unique(rows[:, 0])].tolist(), np.split(rows[:, 1:], np.flatnonzero(np.diff(rows[:, 0])) + 1), strict=False):
            out[i] = part
    return out


def planted_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, or, for one id in ten by its CRC, with a tail that repeats itself."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def digest_runs(words: list[bytes], runs: np.ndarray) -> tuple:
    """n_runs, the longest run's start, length, period and exponent, the runs' digest, that of the words they leave."""
    listed = runs.tolist()
    best = min(listed, key=lambda r: (-r[1], r[0], r[2]), default=None)
    if listed:
        dropped = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
        np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(dropped)[:-1] == 0).tolist()]
    text = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
    about = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(listed), *about, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def periodic_runs(docs: DataFrame, least: int = 6, repeats: int = 4, plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; nulls if there is none), runs_sha256,
    collapsed_sha256: a row for each row of `docs`.

    Words are runs of bytes other than space and \\t to \\r, compared as they stand. Of several longest runs the first is
    told, then that of the smaller period. `plant` rewrites the tail of one text in ten (see `planted_words`); a null
    id is not rewritten. A null, empty or blank text has no words, hence no runs and the digests of nothing; repeated rows
    are answered alike; other columns are left out; an empty table gives no rows.

    No run leaves its text, so nothing is shuffled: a task sorts the suffixes of some texts together, `BLOCK_WORDS`
    or one text at a time, in memory that is in proportion to these times the logarithm of the longest repeat.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([(f, pa.string() if f.endswith("256") else pa.int64()) for f in (c.split()[0] for c in RESULT.split(", "))])

    def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        number = Numbers()
        coded = [np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts]
        rows = [(i, *digest_runs(words, runs)) for i, words, runs in zip(ids, texts, runs_of(coded, least, repeats), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                words = text.split()
                ids.append(doc_id)
                texts.append(planted_words(words, doc_id) if plant else words)
                size += len(words) + 1
                if size >= BLOCK_WORDS:
                    yield answer(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield answer(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)

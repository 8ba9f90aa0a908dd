"""Quality by perplexity under interpolated modified Kneser-Ney trigrams of trusted text.

All n-grams whose middle word (of a pair: first, of a history: last, of a word: itself) falls into one of PARTS are a part of the
model. Parts are made, joined to the texts and dropped one after the other, so that no more than one lies on disk. Within
a part, n-grams are dealt to buckets as blocks of columns (`SCHEMA`): a row is what a task has for a bucket, its columns are
the bytes of arrays. A bucket is sorted at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, materialize_by, prepare
from .words import column_words, mix, word_count

#: Stand for the place before a text and its end; word hashes are 64-bit, so these are as rare as any other.
START, END = np.uint64(2**64 - 3), np.uint64(2**64 - 5)
#: Words of texts that a task sorts together, and bytes of text that it takes at once.
BLOCK, BLOCK_BYTES = 1 << 19, 1 << 22
#: Leading digits of the order's hashes by which trusted ids are counted: 16^3 cuts a language.
CUT_DIGITS = 3
#: Stands for a bound that is not given beside one that is.
UNBOUNDED = 1 << 60
#: Ids and numbers that are few enough to be sent to every task.
SMALL_TABLE = 1_000_000
#: Powers of two: slots of n-grams that every task knows, and bits of the filter of all others, of one part each.
HOT, FILTER = 20, 26
#: Parts of the model, one of which lies on disk at a time.
PARTS = 8
#: Powers of two: the least buckets of a part, as many as it gets for each FEW_CHARS letters of trusted text, and the most, for each MANY_CHARS.
BUCKETS, FEW_CHARS, MANY_CHARS = (3, 6, 11), 40_000, 2_000_000
#: What a row of blocks holds.
GRAMS, PAIRS, HISTORIES, WORDS, LONGEST, SHORTER, FOUND, TEXTS, ADDED, STATS = range(10)
KINDS = {"l": np.uint64, "u": np.uint64, "v": np.uint64, "w": np.uint64, "x": np.float64, "y": np.float64, "c": np.int32, "at": np.int32, "n": np.int32, "n1": np.int32, "n2": np.int32}
SCHEMA = "kind int, bucket int, part int, block long, " + ", ".join(f"{c} binary" for c in KINDS)
ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in KINDS]])


def _lang_salt(lang: str | None) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest("" if lang is None else "=" + lang, 3))


def _key(salt, *words) -> np.ndarray:
    """One 64-bit number for a language and a run of words."""
    x = np.asarray(salt, dtype=np.uint64)
    for w in words:
        x = mix(x ^ w) + np.uint64(len(words))
    return x


def _gram_keys(l, u, v, w):  # noqa: E741
    """Numbers of a trigram's history, of the pair that it falls back to, and its own."""
    past, pair = mix(_key(l, u, v)), _key(l, v, w)
    return past, pair, mix(past + mix(pair))


def _part_of(word_keys: np.ndarray, parts: int) -> np.ndarray:
    return ((word_keys & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int32)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32)


def trusted_sample(docs: DataFrame, labels: DataFrame, max_docs: int | None, max_words: int | None) -> tuple[DataFrame, DataFrame]:
    """(trusted ids, training texts): labelled good and not toxic; all of them, but that every fifth (crc32 of the id) is kept
    from training, to set the threshold by. If bounds are given, per language the first `max_docs` of these by md5 of
    the id. They fill `max_words` words in that order, texts that are longer than this by themselves last; `take` says how
    many words of a text are used (all but in the last text that fits in part)."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)).select("doc_id")
    place = F.md5(F.col("doc_id").cast("string"))
    for_training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    if max_docs is None and max_words is None:
        ids = materialize(good.where(for_training), "chosen")
        return good, docs.join(F.broadcast(ids) if ids.count() <= SMALL_TABLE else ids, "doc_id", "left_semi").select("doc_id", "lang", "text")
    max_docs, max_words = max_docs or UNBOUNDED, max_words or UNBOUNDED
    chosen = docs.select("doc_id", "lang").join(good.where(for_training), "doc_id").withColumn("place", place).withColumn("cut", F.substring("place", 1, CUT_DIGITS))
    # The counts of the order's cuts tell in which of them the first of a language end, so that no task sorts a whole language.
    earlier = F.coalesce(F.sum("c").over(Window.partitionBy("_lang").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = chosen.groupBy(F.col("lang").alias("_lang"), F.col("cut").alias("_cut")).agg(F.count("*").alias("c")).withColumn("before", earlier).where(F.col("before") < max_docs)
    cuts = materialize(cuts.select("_lang", "_cut"), "cuts")
    chosen = chosen.join(F.broadcast(cuts) if cuts.count() <= SMALL_TABLE else cuts, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("cut") == F.col("_cut")), "left_semi")
    chosen = chosen.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).where(F.col("rn") <= max_docs)
    chosen = materialize(chosen.select("doc_id", "rn"), "chosen")
    texts = docs.join(F.broadcast(chosen) if chosen.count() <= SMALL_TABLE else chosen, "doc_id").withColumn("n", word_count(F.col("text")))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("n") > max_words, "rn", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    take = F.least("n", max_words - F.coalesce(before, F.lit(0)))
    return good, texts.withColumn("take", take).where((F.col("take") > 0) | (F.col("n") == 0)).select("doc_id", "lang", "text", "take")


def _rows(kind: int, bounds: np.ndarray, bucket, part=0, block=0, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each stretch of the columns between two bounds."""
    n = len(bounds) - 1
    arrays = [pa.array(np.broadcast_to(np.asarray(x, kind_), n)) for x, kind_ in ((kind, np.int32), (bucket, np.int32), (part, np.int32), (block, np.int64))]
    for name, dtype in KINDS.items():
        if name in columns:
            data = np.ascontiguousarray(columns[name], dtype=dtype)
            arrays.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * (data.itemsize * int(np.prod(data.shape[1:])))).astype(np.int32)), pa.py_buffer(data)]))
        else:
            arrays.append(pa.nulls(n, pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def _dealt(kind: int, bucket: np.ndarray, part=0, block=0, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket (and part)."""
    code = np.broadcast_to(np.asarray(part, np.int64), len(bucket)) << 32 | bucket
    order = np.argsort(code, kind="stable")
    code = code[order]
    heads = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return _rows(kind, np.append(heads, len(code)), code[heads] & 0xFFFFFFFF, code[heads] >> 32, block, **{c: x[order] for c, x in columns.items()})


def _of(table: pa.Table, *kinds: int) -> pa.Table:
    return table.filter(pc.is_in(table["kind"], value_set=pa.array(kinds, pa.int32())))


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table[c].to_pylist()), KINDS[c]) for c in names]


def _by_bucket(blocks: DataFrame, run) -> DataFrame:
    """`run` makes the rows of blocks of each bucket from those that it has."""
    return blocks.groupBy("bucket").applyInArrow(lambda table: pa.Table.from_batches(run(table), schema=ARROW), SCHEMA)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(a place of each distinct key in ascending order, each place's number among these, how many)."""
    _, at, of = np.unique(keys, return_index=True, return_inverse=True)
    return at, of, len(at)


def _stats(level: int, l: np.ndarray, c: np.ndarray) -> pa.RecordBatch:  # noqa: E741
    """Per language, how many n-grams of a level are found 1 to 4 times, all they are found, and their number."""
    at, of, n = _distinct(l)
    sums = [np.bincount(of, c == i, n) for i in (1, 2, 3, 4)] + [np.bincount(of, c, n), np.bincount(of, minlength=n)]
    return _rows(STATS, np.array([0, n]), 0, level, l=l[at], x=np.stack(sums, 1))


class _Cuts:
    """What an n-gram's count gives up, by language: three discounts from the counts of counts, as modified Kneser-Ney has them."""

    def __init__(self, stats: pa.Table, level: int):
        mine = stats.filter(pc.equal(stats["part"], level))
        l, x = _columns(mine, "l", "x")  # noqa: E741
        self.langs, of = np.unique(l, return_inverse=True)
        self.sums = np.zeros((len(self.langs), 6))
        np.add.at(self.sums, of, x.reshape(-1, 6))
        n = self.sums.T
        y = n[0] / np.maximum(n[0] + 2 * n[1], 1)
        self.cuts = np.stack([np.clip(i - (i + 1) * y * n[i] / np.maximum(n[i - 1], 1), 0.1, i - 0.05) for i in (1, 2, 3)], 1)
        self.all, self.kinds = n[4], n[5]
        self.freed = n[0] * self.cuts[:, 0] + n[1] * self.cuts[:, 1] + (n[5] - n[0] - n[1]) * self.cuts[:, 2]
        self.rest = self.freed / np.maximum(self.all, 1) / (self.kinds + 1)

    def of(self, l: np.ndarray, c: np.ndarray) -> np.ndarray:  # noqa: E741
        return self.cuts[np.searchsorted(self.langs, l), np.minimum(c, 3) - 1]

    def freed_by(self, l: np.ndarray, n: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:  # noqa: E741
        """What n n-grams give up, of which n1 are found once and n2 twice."""
        return (self.cuts[np.searchsorted(self.langs, l)] * np.stack([n1, n2, n - n1 - n2], 1)).sum(axis=1)

    def word_share(self, l: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
        """(P1 of words found after c distinct words, what an unknown word gets)."""
        at = np.searchsorted(self.langs, l)
        return (c - self.of(l, c)) / self.all[at] + self.rest[at], self.rest[at]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of a batch whose first columns are lang, text and take: (first row, end, padded words, their rows from the first, their
    languages' numbers), by some BLOCK words at a time. Of a text, its first `take` words (null: all); only a whole one has an end."""
    langs, takes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
    salts = {x: _lang_salt(x) for x in set(langs)}
    bytes_to = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(langs):
        hi = max(lo + 1, int(np.searchsorted(bytes_to, (bytes_to[lo - 1] if lo else 0) + BLOCK_BYTES, "right")))
        hashes, n = column_words(batch.column(1).slice(lo, hi - lo))
        take = np.array([k if t is None else min(t, k) for t, k in zip(takes[lo:hi], n.tolist(), strict=True)], np.int64)
        whole = (take == n).astype(np.int64)
        size = take + 2 + whole
        doc = np.repeat(np.arange(hi - lo), size)
        flat, starts = np.full(len(doc), END), np.cumsum(size) - size
        flat[starts] = flat[starts + 1] = START
        place = np.arange(len(doc)) - starts[doc] - 2
        is_word = (place >= 0) & (place < take[doc])
        flat[is_word] = hashes[(place + (np.cumsum(n) - n)[doc])[is_word]]
        yield lo, hi, flat, doc, np.array([salts[x] for x in langs[lo:hi]], np.uint64)
        lo = hi


def _grams(texts: DataFrame, part: int, parts: int, bits: int) -> DataFrame:
    """Trigrams of a part as blocks (l, u, v, w, c: l stands for the language), dealt by history."""

    def run(batches):
        for batch in batches:
            for _, _, flat, doc, salts in _blocks(batch):
                l, v = salts[doc[1:-1]], flat[1:-1]  # noqa: E741
                k = np.flatnonzero((doc[2:] == doc[:-2]) & (_part_of(_key(l, v), parts) == part))
                l, u, v, w = l[k], flat[k], v[k], flat[k + 2]  # noqa: E741
                past, _, gram = _gram_keys(l, u, v, w)
                at, of, n = _distinct(gram)
                yield _dealt(GRAMS, _bucket(past[at], bits), l=l[at], u=u[at], v=v[at], w=w[at], c=np.bincount(of, minlength=n))

    take = F.col("take") if "take" in texts.columns else F.lit(None)
    return texts.select("lang", "text", take.cast("long").alias("take")).mapInArrow(run, SCHEMA)


def _counted(table: pa.Table) -> tuple:
    """l, u, v, w, history, pair, trigram and count of a bucket's distinct trigrams."""
    l, u, v, w, c = _columns(_of(table, GRAMS), "l", "u", "v", "w", "c")  # noqa: E741
    past, pair, gram = _gram_keys(l, u, v, w)
    at, of, n = _distinct(gram)
    return l[at], u[at], v[at], w[at], past[at], pair[at], gram[at], np.bincount(of, c, n).astype(np.int64)


def _pairs(texts: DataFrame, part: int, parts: int, bits: int) -> DataFrame:
    """A part's pairs (u: number, w: the last word's, c: how many words they are found after), dealt by last word, with what is
    known of their first word, as histories have it too (at: sum of c, n: pairs, n1 and n2: those found once and twice); and
    statistics of trigrams and pairs."""

    def trigrams(table):
        l, _, v, w, _, pair, _, c = _counted(table)  # noqa: E741
        at, of, n = _distinct(pair)
        return [_stats(3, l, c), _dealt(PAIRS, _bucket(pair[at], bits), l=l[at], v=v[at], w=w[at], c=np.bincount(of, minlength=n))]

    def pairs(table):
        l, v, w, c = _columns(_of(table, PAIRS), "l", "v", "w", "c")  # noqa: E741
        at, of, n = _distinct(_key(l, v, w))
        l, v, w, c = l[at], v[at], w[at], np.bincount(of, c, n).astype(np.int64)  # noqa: E741
        return [*_of(table, STATS).to_batches(), _stats(2, l, c), _dealt(PAIRS, _bucket(_key(l, v), bits), l=l, v=v, w=w, c=c)]

    def histories(table):
        l, v, w, c = _columns(_of(table, PAIRS), "l", "v", "w", "c")  # noqa: E741
        key, word = _key(l, v), _key(l, w)
        at, of, n = _distinct(key)
        sums = {"at": np.bincount(of, c, n), "n": np.bincount(of, minlength=n), "n1": np.bincount(of, c == 1, n), "n2": np.bincount(of, c == 2, n)}
        return [
            *_of(table, STATS).to_batches(),
            _dealt(PAIRS, _bucket(word, bits), part, l=l, u=_key(l, v, w), w=word, c=c, **{k: x[of] for k, x in sums.items()}),
            _dealt(HISTORIES, _bucket(key[at], bits), part, l=l[at], u=key[at], **sums),
        ]

    return _by_bucket(_by_bucket(_by_bucket(_grams(texts, part, parts, bits), trigrams), pairs), histories)


def _pair_shares(pairs: DataFrame, cuts: _Cuts, parts: int, bits: int) -> DataFrame:
    """Pairs dealt by their numbers (y: first word's backoff mass, at: its sum of c, w: how many words the last is found
    after); histories and words with their parts; and statistics of words."""

    def words(table):
        l, u, w, c, total, *sums = _columns(_of(table, PAIRS), "l", "u", "w", "c", "at", "n", "n1", "n2")  # noqa: E741
        part = np.repeat(_of(table, PAIRS)["part"].to_numpy(), pc.binary_length(_of(table, PAIRS)["u"]).to_numpy() // 8)
        at, of, n = _distinct(w)
        c1, word = np.bincount(of, minlength=n), w[at]
        hl, history, all_, *freed = _columns(_of(table, HISTORIES), "l", "u", "at", "n", "n1", "n2")
        return [
            _stats(1, l[at], c1),
            _dealt(HISTORIES, _bucket(history, bits), _part_of(history, parts), u=history, x=np.log(cuts.freed_by(hl, *freed) / all_), c=all_),
            _dealt(WORDS, _bucket(word, bits), _part_of(word, parts), l=l[at], u=word, c=c1),
            _dealt(PAIRS, _bucket(u, bits), part, l=l, u=u, w=c1[of], c=c, y=cuts.freed_by(l, *sums) / total, at=total),
        ]

    return _by_bucket(pairs, words)


def _shares(texts: DataFrame, facts: dict, part: int) -> DataFrame:
    """A part of the model: for a bucket a row of its trigrams and one of its shorter n-grams, with keys (u), what they add (x) and
    counts (c). Trigrams are in the buckets of the pairs that they fall back to."""
    bits, firsts, seconds, thirds = facts["bits"], *facts["cuts"]

    def trigrams(table):
        l, _, _, _, past, pair, gram, c = _counted(table)  # noqa: E741
        at, of, n = _distinct(past)
        cut = thirds.of(l, c)
        total, freed = np.bincount(of, c, n), np.bincount(of, cut, n)
        past = past[at]
        return [_dealt(GRAMS, _bucket(pair, bits), u=gram, v=pair, x=(c - cut) / freed[of], c=c), _dealt(SHORTER, _bucket(past, bits), u=past, x=np.log(freed / total), c=total)]

    def priced(table):
        l, pair, c1, c, y, total = _columns(_of(table, PAIRS), "l", "u", "w", "c", "y", "at")  # noqa: E741
        p1, _ = firsts.word_share(l, c1.astype(np.int64))
        x = (c - seconds.of(l, c)) / total
        order = np.argsort(pair)
        p2 = (x + y * p1)[order]
        gram, of, ratio, c3 = _columns(_of(table, GRAMS), "u", "v", "x", "c")
        l, word, n = _columns(_of(table, WORDS), "l", "u", "c")  # noqa: E741
        word_p, rest = firsts.word_share(l, n)
        others = _columns(_of(table, HISTORIES, SHORTER), "u", "x", "c")
        # A word has what it adds itself and as a history.
        u, x, c = (np.concatenate(z) for z in zip((pair, np.log1p(x / (y * p1)), c), (word, np.log(word_p / rest), n), others, strict=True))
        at, back, n = _distinct(u)
        bucket = table["bucket"][0].as_py()
        return [
            _rows(LONGEST, np.array([0, len(gram)]), bucket, u=gram, x=np.log1p(ratio / p2[np.searchsorted(pair[order], of)]), c=c3),
            _rows(SHORTER, np.array([0, n]), bucket, u=u[at], x=np.bincount(back, x, n), c=np.minimum(np.bincount(back, c, n), 2**31 - 1)),
        ]

    known = facts["pairs"].where((F.col("part") == part) & (F.col("kind") != STATS))
    return _by_bucket(_by_bucket(_grams(texts, part, facts["parts"], bits), trigrams).unionByName(known), priced)


def _slot(keys: np.ndarray, buckets: np.ndarray, bits: int, slots: int) -> np.ndarray:
    """A key's place among 2^slots, those of a bucket side by side."""
    return ((buckets.astype(np.uint64) << np.uint64(64 - bits)) | (keys >> np.uint64(bits))) >> np.uint64(64 - slots)


def _places(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of keys in their bucket's stretch of the filter."""
    low = np.uint64(width - 1)
    return keys & low, (keys >> np.uint64(32)) & low


def _shown(blocks: DataFrame, bits: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """What every task gets to know of a part, of a fixed size: keys, what they add and counts of the most frequent n-gram of each of
    2^HOT slots; and a Bloom filter of all keys, made by buckets, each of which has its own stretch of it."""
    slots, size = HOT, max(FILTER, bits + 3)
    width = 1 << (size - bits)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                u, x, c = _columns(pa.Table.from_batches([batch.slice(i, 1)]), "u", "x", "c")
                slot = _slot(u, np.full(len(u), batch.column(0)[i].as_py()), bits, slots)
                order = np.lexsort((c, slot))
                best = order[np.append(slot[order][1:] != slot[order][:-1], True)[: len(order)]]
                stretch = np.zeros(width, np.uint8)
                for place in _places(u, width):
                    stretch[place] = 1
                marks = np.packbits(stretch, bitorder="little")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *[pa.array([a.tobytes()], pa.binary()) for a in (u[best], x[best], c[best], marks)]], names=["bucket", "u", "x", "c", "marks"])

    got = blocks.select("bucket", "u", "x", "c").mapInArrow(run, "bucket int, u binary, x binary, c binary, marks binary").toArrow()
    known = np.zeros(1 << (size - 3), np.uint8)
    for bucket, marks in zip(got["bucket"].to_pylist(), got["marks"].to_pylist(), strict=True):
        known[bucket * width // 8 : (bucket + 1) * width // 8] |= np.frombuffer(marks, np.uint8)
    u, x, c = _columns(got, "u", "x", "c")
    slot = _slot(u, np.repeat(got["bucket"].to_numpy(), pc.binary_length(got["u"]).to_numpy() // 8), bits, slots)
    order = np.argsort(c, kind="stable")
    hot = np.zeros(1 << slots, np.uint64), np.zeros(1 << slots), np.zeros(1 << slots, np.int32)
    for into, values in zip(hot, (u, x, c), strict=True):
        into[slot[order]] = values[order]
    return hot, known


def _facts(texts: DataFrame) -> dict:
    """What all parts of the model share: `pairs` (shares of pairs, histories and words), discounts, and `rest` (l, rest: what an unknown word gets in each language)."""
    spark = texts.sparkSession
    chars = max(1, (texts.agg(F.sum(F.length("text"))).first()[0] or 0) / PARTS)
    few, many = (int(np.ceil(np.log2(max(1, chars / x)))) for x in (FEW_CHARS, MANY_CHARS))
    bits = min(BUCKETS[2], max(BUCKETS[0], min(BUCKETS[1], few), many))
    chunk = (F.col("bucket") % PARTS).alias("chunk")
    counted = [materialize_by(_pairs(texts, part, PARTS, bits).select("*", chunk), "pairs", "chunk") for part in range(PARTS)]
    both = reduce(DataFrame.unionByName, counted)
    stats = both.where((F.col("chunk") == 0) & (F.col("kind") == STATS)).select("part", "l", "x").toArrow()
    seconds, thirds = _Cuts(stats, 2), _Cuts(stats, 3)
    dealt, shares = both.where(F.col("kind") != STATS), []
    for i in range(PARTS):
        shares.append(materialize(_pair_shares(dealt.where(F.col("chunk") == i).drop("chunk"), seconds, PARTS, bits), "pair_shares"))
        discard(*counted, only=f"chunk={i}")
    discard(*counted)
    pairs = reduce(DataFrame.unionByName, shares)
    firsts = _Cuts(pairs.where(F.col("kind") == STATS).select("part", "l", "x").toArrow(), 1)
    rest = spark.createDataFrame(list(zip(firsts.langs.view(np.int64).tolist(), firsts.rest.tolist(), strict=True)), "l long, rest double")
    return {"pairs": pairs, "stored": shares, "cuts": (firsts, seconds, thirds), "rest": rest, "bits": bits, "parts": PARTS}


def _parts(texts: DataFrame, facts: dict) -> Iterator[dict]:
    """The model's parts, each made when it is asked for: `blocks`, `hot` and `filter`."""
    for part in range(facts["parts"]):
        blocks = materialize(_shares(texts, facts, part), "part_shares")
        hot, known = _shown(blocks, facts["bits"])
        yield {"blocks": blocks, "hot": hot, "filter": known}


def _table(blocks: DataFrame) -> DataFrame:
    """(key, x, c) of blocks."""

    def run(batches):
        for batch in batches:
            u, x, c = _columns(pa.Table.from_batches([batch]), "u", "x", "c")
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(x), pa.array(c.astype(np.int64))], names=["key", "x", "c"])

    return blocks.select("u", "x", "c").mapInArrow(run, "key long, x double, c long")


def train(texts: DataFrame) -> dict:
    """The whole model: `table` (key, x, c) and `hot`, its most frequent n-grams; `rest` (l, rest), and its `parts` for `perplexities`.

    With P1, P2, P3 the interpolated probabilities and g the histories' backoff masses, the log of P(w | u v) is a
    sum of what the pieces of the trigram add, each nothing if it was not seen in training:
    ln rest + [ln P1(w) - ln rest] over words, [ln g(v)] over histories of one word, [ln P2(v w) - ln g(v) - ln P1(w)] over pairs,
    [ln g(u v)] over histories of two and [ln P3(u v w) - ln g(u v) - ln P2(v w)] over trigrams.
    So a text's sum needs only its counts of n-grams joined to one table. What trigrams add is ln(1 + s / P2(v w)), where s is their
    discounted count by what their history's discounts free.
    """
    facts = _facts(texts)
    parts, tables = list(_parts(texts, facts)), []
    for part in parts:
        for kind, label in ((LONGEST, "trigram_shares"), (SHORTER, "shorter_shares")):
            tables.append(materialize(_table(part["blocks"].where(F.col("kind") == kind)), label))
    keys, adds, counts = (np.stack(x) for x in zip(*(p["hot"] for p in parts), strict=True))
    hot = tuple(np.take_along_axis(x, counts.argmax(axis=0)[None], 0)[0] for x in (keys, adds, counts))
    return facts | {"parts": parts, "table": reduce(DataFrame.unionByName, tables), "hot": hot}


def _possible(known: np.ndarray, keys: np.ndarray, buckets: np.ndarray, bits: int) -> np.ndarray:
    """Which keys the filter cannot rule out."""
    width = (len(known) * 8) >> bits
    first, second = (x + buckets.astype(np.uint64) * np.uint64(width) for x in _places(keys, width))
    bit = lambda x: ((known[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    found = bit(first)
    left = np.flatnonzero(found)
    found[left] = bit(second[left])
    return found


def _asked(docs: DataFrame, part: int, parts: int, bits: int, shared: Broadcast) -> DataFrame:
    """Of (lang, text, take, id), a row a block of texts (u: ids, l: languages, c: words and the end, x: what their hot n-grams of a
    part add), and the other n-grams that may be in the part (u) with their texts' places in the block (at) and counts, dealt as the part is."""

    def run(batches):
        (hot_keys, hot_x), known = shared.value
        slots, block = len(hot_keys).bit_length() - 1, TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(3).to_numpy().view(np.uint64)
            for lo, hi, flat, doc, salts in _blocks(batch):
                block += 1
                l = salts[doc]  # noqa: E741
                word = _key(l, flat)
                mine = _part_of(word, parts) == part
                mine[0] = False
                mine[1:] &= doc[1:] == doc[:-1]
                j = np.flatnonzero(mine)
                # All but a text's end have a word behind them.
                k = j[np.append(doc, -1)[j + 1] == doc[j]]
                past, pair, gram = _gram_keys(l[k], flat[k - 1], flat[k], flat[k + 1])
                keys, of = np.concatenate([word[j], past, pair, gram]), doc[np.concatenate([j, k, k, k])]
                bucket = np.concatenate([_bucket(z, bits) for z in (word[j], past, pair, pair)])
                slot = _slot(keys, bucket, bits, slots)
                is_hot = hot_keys[slot] == keys
                x = np.bincount(of[is_hot], hot_x[slot[is_hot]], hi - lo)
                n = np.bincount(doc, minlength=hi - lo) - 2
                yield _rows(TEXTS, np.array([0, hi - lo]), block % (1 << bits), part, block, u=ids[lo:hi], l=salts, c=n, x=x)
                cold = np.flatnonzero(~is_hot)
                cold = cold[_possible(known, keys[cold], bucket[cold], bits)]
                keys, of, bucket = keys[cold], of[cold], bucket[cold]
                order = np.lexsort((keys, of))
                keys, of, bucket = keys[order], of[order], bucket[order]
                heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))[: len(keys)])
                yield _dealt(FOUND, bucket[heads], part, block, u=keys[heads], at=of[heads], c=np.diff(np.append(heads, len(keys))))

    return docs.mapInArrow(run, SCHEMA)


def _answered(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """id, l, n_tokens of every text, and x, what its n-grams of a part add."""

    def priced(table):
        u, x = _columns(_of(table, LONGEST, SHORTER), "u", "x")
        order = np.argsort(u, kind="stable")
        u, x = u[order], x[order]
        rows = _of(table, FOUND)
        keys, at, n = _columns(rows, "u", "at", "c")
        size = pc.binary_length(rows["at"]).to_numpy() // 4
        of = np.repeat(np.arange(len(size), dtype=np.int64), size) << 32 | at
        place = np.minimum(np.searchsorted(u, keys), max(0, len(u) - 1))
        found = np.flatnonzero(u[place] == keys) if len(u) else np.empty(0, np.int64)
        adds, of = n[found] * x[place[found]], of[found]
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
        sums, of = np.add.reduceat(adds, heads) if len(heads) else adds, of[heads]
        row, first = np.unique(of >> 32, return_index=True)
        return [*_of(table, TEXTS).to_batches(), _rows(ADDED, np.append(first, len(of)), 0, 0, rows["block"].to_numpy()[row], at=of & 0xFFFFFFFF, x=sums)]

    def summed(table):
        ids, l, n, x = _columns(_of(table, TEXTS), "u", "l", "c", "x")  # noqa: E741
        at, more = _columns(_of(table, ADDED), "at", "x")
        return pa.Table.from_arrays([pa.array(ids.view(np.int64)), pa.array(l.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(x + np.bincount(at, more, len(x)))], names=["id", "l", "n_tokens", "x"])

    added = _by_bucket(asked.unionByName(blocks), priced)
    return added.groupBy("block").applyInArrow(summed, "id long, l long, n_tokens long, x double")


def perplexities(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang, n_tokens (words and the end), perplexity (null where the language has no model or the text no words).

    Each text's n-grams are counted in its task, once for each part of the model. The part's most frequent ones are priced there; the others are
    dealt by n-gram, meet the part's table, and what they add is summed by block and text. Rows that are equal in all are answered alike.
    """
    rows = docs.withColumn("id", F.xxhash64("doc_id", F.isnull("lang"), "lang", F.isnull("text"), "text"))
    texts, extras = rows.select("lang", "text", F.lit(None).cast("long").alias("take"), "id"), []
    for i, part in enumerate(model["parts"]):
        shared = docs.sparkSession.sparkContext.broadcast((part["hot"][:2], part["filter"]))
        extras.append(materialize(_answered(_asked(texts, i, PARTS, model["bits"], shared), part["blocks"]), "extra"))
        shared.destroy()
    # Equal rows have one id, so what they add stands there once for each of them, in each part.
    extra = reduce(DataFrame.unionByName, extras).groupBy("id").agg((F.sum("x") * len(extras) / F.count("*")).alias("x"), F.first("l").alias("l"), F.first("n_tokens").alias("n_tokens"))
    out = rows.select("doc_id", "lang", "id").join(extra, "id").join(F.broadcast(model["rest"]), "l", "left")
    log = F.col("n_tokens") * F.ln("rest") + F.col("x")
    perplexity = F.when((F.col("n_tokens") > 1) & F.col("rest").isNotNull(), F.exp(F.least(F.lit(700.0), -log / F.col("n_tokens"))))
    return out.select("doc_id", "lang", "n_tokens", perplexity.alias("perplexity"))


def _kept_while_used(parts: Iterable[dict]) -> Iterator[dict]:
    for part in parts:
        yield part
        discard(part["blocks"])


def classify_quality(docs: DataFrame, labels: DataFrame, max_docs: int | None = None, max_words: int | None = None, quantile: float = 0.99, slack: float = 1.1) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold, kept for every row.

    The model is trained on the texts that `labels` calls good and not toxic, all but those kept for the threshold; if
    bounds are given, on `max_docs` texts and `max_words` words per language, which they fill if there are so many. Its parts are made, joined to
    the texts' counts of n-grams and dropped one after the other. A language's threshold is `slack` times the `quantile` of the perplexities of its other trusted texts
    (of all its trusted ones if there is no other). A row is kept if its perplexity is at most the
    threshold. Rows without words are not kept; rows of a language without trusted text have no
    threshold and are kept. A null lang is a language of its own; repeated rows are answered alike.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    good, texts = trusted_sample(rows, labels, max_docs, max_words)
    texts = materialize(texts, "trusted")
    used = materialize(texts.select("doc_id").distinct(), "used").withColumn("_used", F.lit(True))
    facts = _facts(texts)
    scored = materialize(perplexities(rows, facts | {"parts": _kept_while_used(_parts(texts, facts))}), "perplexity")
    discard(texts, *facts["stored"])
    trusted = scored.join(good, "doc_id").join(used, "doc_id", "left")
    cut = trusted.groupBy("lang").agg(F.percentile_approx(F.when(F.col("_used").isNull(), F.col("perplexity")), quantile, 10_000).alias("a"), F.percentile_approx("perplexity", quantile, 10_000).alias("b"))
    cut = cut.select(F.col("lang").alias("_lang"), (F.coalesce("a", "b") * slack).alias("threshold"))
    out = scored.join(cut, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    kept = F.when(F.col("n_tokens") <= 1, False).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return out.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", kept.alias("kept"))

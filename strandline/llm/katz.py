"""Bigram language-model scoring with Katz backoff: Good-Turing discounts, exactly normalised weights.

Every pair (previous word, word) of a document is a posting. Postings are dealt by word into bounded
buckets as column blocks, so that one shuffle brings together all that counts a pair and all the
documents that hold it: each bucket counts its words and pairs over the training texts and
prices them for every document at once. What a bucket cannot know, the backoff weight of a history, is
a second table, summed by history and joined to the few pairs that were never seen in training.

A word too frequent for a bucket is dealt by pair, and a pair too frequent for one by batches of texts: it is counted
in parts, and priced by joining its summed count to the documents. A batch is dealt to FAN buckets at most; more buckets
than that are reached by dealing those again, so that blocks stay large and their number is in proportion to the texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, prepare
from .skew import HOT_ROWS, join_many
from .words import WordIds, hashed_words, mix, text_bytes

#: Counts up to TOP are discounted by Good-Turing; larger ones by LARGE, so that every history keeps some mass for unseen words.
TOP, LARGE = 5, 0.1
#: The place before a text, and its end (a token).
START, END = np.int64(-3), np.int64(-5)
#: Words of texts whose postings a task sorts together, and postings a bucket should hold.
BATCH_WORDS, BUCKET_POSTINGS, LEAST_BUCKETS = 1_000_000, 1_500_000, 96
#: Texts in such a batch, so that a document's number in it fits two bytes; buckets that a batch is dealt to at once.
BATCH_DOCS, FAN = 32_000, 512
#: Postings that a bucket prices at once.
PRICE_ROWS = 200_000
#: Bounds for what every task knows: 2^FREQUENT words, and twice as many pairs; rows of a table to be broadcast.
FREQUENT, SMALL_TABLE = 22, 1_000_000
_IDS = WordIds()

POSTINGS = "bucket long, base long, words array<long>, pairs array<int>, histories array<long>, holders array<int>, docs array<smallint>, far array<long>, counts array<int>, ids array<long>"
PARTS = "kind int, id long, doc_id long, held_out boolean, n long, c array<long>, x array<double>"
PART_NAMES = ["kind", "id", "doc_id", "held_out", "n", "c", "x"]
PART_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))


def _batches(batches, size: int):
    """(first row number, doc_ids, held-out flags, word hashes) of about `size` words of whole texts."""
    first, ids, held, words, total = None, [], [], [], 0
    for batch in batches:
        rows, keys, out = (batch.column(i).to_pylist() for i in range(3))
        for row, key, h, text in zip(rows, keys, out, text_bytes(batch.column(3)), strict=True):
            if first is None:
                first = row
            ids.append(key)
            held.append(h)
            words.append(hashed_words(text, _IDS))
            total += len(words[-1]) + 1
            if total >= size or len(ids) >= BATCH_DOCS:
                yield first, ids, np.array(held, dtype=bool), words
                first, ids, held, words, total = None, [], [], [], 0
    if ids:
        yield first, ids, np.array(held, dtype=bool), words


def _tokens(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, previous word, word) of every token, each text closed by END."""
    lengths = np.array([len(w) + 1 for w in words])
    flat = np.concatenate([x for w in words for x in (w, [END])]).astype(np.int64)
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[np.cumsum(lengths) - lengths] = START
    return np.repeat(np.arange(len(words), dtype=np.int64), lengths), before, flat


def _pair_keys(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(w.view(np.uint64)) ^ h.view(np.uint64))


def _among(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted `known`, whether it is there) of every key."""
    if not len(known):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """(w, h, c), summed in each task first: with h null the training count of every word and of END; with h the count
    of pairs over all texts, from those batches that hold a pair `least` times or more."""

    def run(batches):
        for _, _, held, words in _batches(batches, BATCH_WORDS):
            doc, h, w = _tokens(words)
            value, count = np.unique(w[~held[doc]], return_counts=True)
            often = value[count >= least] if not held.any() else np.unique(w)[np.unique(w, return_counts=True)[1] >= least]
            near = _among(w, often)[1]
            h, w = h[near], w[near]
            _, first, pairs = np.unique(_pair_keys(w, h), return_index=True, return_counts=True)
            first, pairs = first[pairs >= least], pairs[pairs >= least]
            before = pa.array(np.append(np.zeros(len(value), np.int64), h[first]), mask=np.arange(len(value) + len(first)) < len(value))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(value, w[first])), before, pa.array(np.append(count, pairs))], names=["w", "h", "c"])

    return rows.mapInArrow(run, "w long, h long, c long").groupBy("w", "h").agg(F.sum("c").alias("c"))


def discounts(n: list[float]) -> list[float]:
    """Good-Turing factors d_1..d_TOP from the counts of counts n_1..n_(TOP+1), as Katz scales them.

    Where these are missing or leave (0, 1), a count r keeps (r - 0.5) / r.
    """
    out = []
    a = (TOP + 1) * n[TOP] / n[0] if n[0] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a) if n[r - 1] and a < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _places(w: np.ndarray, h: np.ndarray, whole: np.uint64, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Where postings go: by word, a frequent word's by pair, a frequent pair's to the place `whole`."""
    place = mix(w.view(np.uint64))
    often = np.flatnonzero(_among(w, words)[1])
    if len(often):
        key = _pair_keys(w[often], h[often])
        place[often] = np.where(_among(key, pairs)[1], whole, key)
    return place


def _blocks(w, h, row, n, bucket, base: int | None, heads: dict[int, list[int]]):
    """A record batch for each bucket; postings come sorted by word, history and text.

    Texts are numbers from `base` on that fit two bytes, or any numbers without it. `heads` are lists that go with a
    bucket: texts' ids, each followed by 1 if it is held out.
    """
    order = np.argsort(bucket, kind="stable")
    w, h, row, n, bucket = w[order], h[order], row[order], n[order], bucket[order]
    present = np.union1d(bucket, np.array(list(heads), dtype=np.int64)).astype(np.int64)
    lows, highs = np.searchsorted(bucket, present), np.searchsorted(bucket, present, side="right")
    for b, lo, hi in zip(present.tolist(), lows.tolist(), highs.tolist(), strict=True):
        bw, bh = w[lo:hi], h[lo:hi]
        pair = np.flatnonzero(np.append(True, (bw[1:] != bw[:-1]) | (bh[1:] != bh[:-1]))) if hi > lo else np.empty(0, np.int64)
        word = np.flatnonzero(np.append(True, bw[pair][1:] != bw[pair][:-1])) if hi > lo else pair
        texts = row[lo:hi]
        lists = [
            (bw[pair][word], pa.int64()),
            (np.diff(np.append(word, len(pair))), pa.int32()),
            (bh[pair], pa.int64()),
            (np.diff(np.append(pair, hi - lo)), pa.int32()),
            (texts if base is not None else texts[:0], pa.int16()),
            (texts if base is None else texts[:0], pa.int64()),
            (n[lo:hi], pa.int32()),
            (heads.get(b, []), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b], pa.int64()), pa.array([base or 0], pa.int64()), *[pa.array([x], pa.list_(t)) for x, t in lists]],
            names=["bucket", "base", "words", "pairs", "histories", "holders", "docs", "far", "counts", "ids"],
        )


def _deal(rows: DataFrame, buckets: int, shared) -> DataFrame:
    """The postings of every batch of texts as one column block for each bucket."""

    def run(batches):
        words_often, pairs_often = shared.value["hot"], shared.value["pairs"]
        for first, ids, held, words in _batches(batches, BATCH_WORDS):
            doc, h, w = _tokens(words)
            order = np.lexsort((doc, h, w))
            doc, h, w = doc[order], h[order], w[order]
            at = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
            n = np.diff(np.append(at, len(w))).astype(np.int32)
            doc, h, w = doc[at], h[at], w[at]
            n = np.where(held[doc], -n, n)
            whole = mix(np.array([first], dtype=np.uint64))[0]
            bucket = (_places(w, h, whole, words_often, pairs_often) % np.uint64(buckets)).astype(np.int64)
            # One block of each batch also carries its documents' ids.
            head = [x for pair in zip(ids, held.tolist(), strict=True) for x in (pair[0], int(pair[1]))]
            yield from _blocks(w, h, doc, n, bucket, first, {int(whole % np.uint64(buckets)): head})

    return rows.mapInArrow(run, POSTINGS)


def _deal_again(dealt: DataFrame, now: int, then: int, postings: int, shared) -> DataFrame:
    """The blocks of `now` buckets as blocks of `then`, a multiple of it."""

    def run(batches):
        words_often, pairs_often = shared.value["hot"], shared.value["pairs"]
        held: list[pa.RecordBatch] = []
        size = 0

        def out():
            table = pa.Table.from_batches(held)
            w, h, row, n = _postings(table)
            bucket = np.repeat(table.column("bucket").to_numpy(), _sizes(table, "counts"))
            order = np.lexsort((row, h, w))
            w, h, row, n, bucket = w[order], h[order], row[order], n[order], bucket[order]
            # A frequent pair has no place of its own: it may go to any bucket that its block's leads to.
            whole = mix(np.array([row[0] if len(row) else 0], dtype=np.uint64))[0]
            place = _places(w, h, whole, words_often, pairs_often)
            step = (place // np.uint64(now)) % np.uint64(then // now)
            yield from _blocks(w, h, row, n, bucket + now * step.astype(np.int64), None, {})
            heads = table.filter(pc.greater(pc.list_value_length(table.column("ids")), 0))
            for b, base, ids in zip(*(heads.column(c).to_pylist() for c in ("bucket", "base", "ids")), strict=True):
                none = np.empty(0, np.int64)
                yield from _blocks(none, none, none, none, none, base, {b: ids})

        for batch in batches:
            for i in range(batch.num_rows):
                held.append(batch.slice(i, 1))
                size += len(batch.column(batch.schema.get_field_index("counts"))[i])
                if size >= BATCH_WORDS:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    salts = max(1, -(-postings // (now * 50 * BATCH_WORDS)))
    spread = dealt.repartition(F.col("bucket"), F.pmod(F.xxhash64("base", F.size("counts")), F.lit(salts)))
    return spread.mapInArrow(run, POSTINGS)


def _levels(buckets: int) -> list[int]:
    """How many buckets there are after each dealing: each a multiple of the one before, by FAN at most."""
    out = [min(buckets, FAN)]
    while out[-1] < buckets:
        out.append(out[-1] * min(FAN, -(-buckets // out[-1])))
    return out


def _flat(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name)
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if column.num_chunks else np.empty(0, np.int64)


def _sizes(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.diff(c.offsets.to_numpy()) for c in table.column(name).chunks])


def _postings(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, history, text, count) of every posting of some blocks."""
    holders = _flat(table, "holders")
    w, h = (np.repeat(x, holders).astype(np.int64, copy=False) for x in (np.repeat(_flat(table, "words"), _flat(table, "pairs")), _flat(table, "histories")))
    size = _sizes(table, "counts")
    near = np.repeat(_sizes(table, "docs") > 0, size)
    row = np.repeat(table.column("base").to_numpy(), size)
    row[near] += _flat(table, "docs")
    row[~near] = _flat(table, "far")
    return w, h, row, _flat(table, "counts").astype(np.int64)


def _histories(h: np.ndarray, c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(histories, counts, mass) of pairs with their counts c and their words' own shares p: of each history the counts of
    counts of its pairs, the pairs above TOP, all tokens; and the lower-order mass."""
    who, inverse = np.unique(h, return_inverse=True)
    total = lambda x: np.bincount(inverse, weights=x, minlength=len(who))
    counts = np.empty((len(who), TOP + 3), dtype=np.int64)
    for i, value in enumerate((*[c == r for r in range(1, TOP + 2)], c > TOP, c)):
        counts[:, i] = total(value)
    return who, counts, total(p)[:, None]


def _price(table: pa.Table, model: dict) -> pa.Table:
    """What one bucket adds: to documents (kind 0), to histories (1), unseen pairs (2), ids (3); and of frequent pairs,
    numbered as the model has them, the counts in training (4) and in documents (5)."""
    # A worker that has dealt texts before still holds their words.
    _IDS.clear()
    w, h, row, n = _postings(table)
    bases = table.column("base").to_numpy()
    order = np.lexsort((h, w))
    w, h, row, n = w[order], h[order], row[order], n[order]
    out: list[pa.RecordBatch] = []

    def add(kind: int, ident, doc_id=None, held=None, count=None, c=None, x=None) -> None:
        size = len(ident)

        def column(value, kind: pa.DataType) -> pa.Array:
            if value is None:
                return pa.nulls(size, kind)
            if not pa.types.is_list(kind):
                return pa.array(value, kind)
            return pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * value.shape[1]), pa.array(np.ascontiguousarray(value).ravel(), kind.value_type))

        values = (np.full(size, kind), ident, doc_id, held, count, c, x)
        out.append(pa.RecordBatch.from_arrays([column(v, t) for v, t in zip(values, PART_TYPES, strict=True)], names=PART_NAMES))

    if len(w):
        train = np.maximum(n, 0)
        new_w = np.append(True, w[1:] != w[:-1])
        new_p = new_w | np.append(True, h[1:] != h[:-1])
        at_w, at_p = np.flatnonzero(new_w), np.flatnonzero(new_p)
        c_w, c_p = np.add.reduceat(train, at_w), np.add.reduceat(train, at_p)
        near, often = _among(w[at_w], model["hot"])
        if often.any():
            c_w = np.where(often, model["hot_counts"][near], c_w)
        word_of, pair_of = (np.cumsum(x, dtype=np.int32) - 1 for x in (new_w, new_p))
        p_uni, word_of_pair = unigram(c_w, model), word_of[at_p]
        del train, new_w, new_p
        number, partial = np.zeros(len(at_p), dtype=np.int32), np.zeros(len(at_p), dtype=bool)
        if len(model["pairs"]) and often.any():
            near = np.flatnonzero(often[word_of_pair])
            number[near], partial[near] = _among(_pair_keys(w[at_p[near]], h[at_p[near]]), model["pairs"])
        if partial.any():
            add(4, number[partial], count=c_p[partial])
            mine = partial[pair_of]
            add(5, row[mine], doc_id=number[pair_of[mine]], count=np.abs(n[mine]))
            c_p = np.where(partial, -1, c_p)
        seen = c_p > 0
        who, c, x = _histories(h[at_p][seen], c_p[seen], p_uni[word_of_pair[seen]])
        add(1, who, c=c, x=x)
        del at_w, at_p, number, partial, seen, word_of_pair, who, c, x
        # Documents, some postings at a time: only their sums are kept.
        docs = np.unique(row)
        sums = np.zeros((TOP + 4, len(docs)))
        for lo in range(0, len(w), PRICE_ROWS):
            part = slice(lo, lo + PRICE_ROWS)
            k, of_word = np.abs(n[part]), word_of[part]
            cw, cp = c_w[of_word], c_p[pair_of[part]]
            log = np.where(cp > 0, np.log10(np.maximum(cp - np.where(cp > TOP, LARGE, 0), 1e-300)), np.where(cp < 0, 0, np.log10(p_uni[of_word])))
            log -= np.where((cw > 0) & (w[part] != END), np.log10(np.maximum(cw, 1)), 0)
            at = np.searchsorted(docs, row[part])
            for i, value in enumerate((k, k * (cw > 0), *[k * (cp == r) for r in range(1, TOP + 1)], k * np.log10((cw + 0.1) / model["base_all"]), k * log)):
                sums[i] += np.bincount(at, weights=value, minlength=len(docs))
            bare = cp == 0
            add(2, row[part][bare], doc_id=h[part][bare], count=k[bare])
        add(0, docs, count=sums[0].astype(np.int64), c=sums[1 : TOP + 2].T.astype(np.int64), x=sums[TOP + 2 :].T)
    for ids, base in zip(table.column("ids").to_pylist(), bases.tolist(), strict=True):
        if ids:
            add(3, np.arange(base, base + len(ids) // 2), doc_id=ids[0::2], held=[bool(x) for x in ids[1::2]])

    return pa.Table.from_batches(out, pa.schema(list(zip(PART_NAMES, PART_TYPES, strict=True))))


def unigram(c: np.ndarray, model: dict) -> np.ndarray:
    """Good-Turing probability of words with training count c; the mass of unseen words is one event's."""
    d = np.array([0.0, *model["uni_d"]])
    kept = np.where(c > TOP, c - LARGE, c * d[np.minimum(c, TOP)])
    return np.where(c > 0, kept / max(model["N"], 1), model["unknown"])


def _counts_of_counts(c: str) -> list[Column]:
    return [F.count_if(F.col(c) == r).alias(f"n{r}") for r in range(1, TOP + 2)]


def score_documents(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens are a text's words (A-Z lowered) and one end; documents whose crc32(doc_id as text) mod
    `modulus` is 0 are held out, all others are learnt from, whole (a null doc_id too). score is the
    log10 probability of the text: a seen pair has its Good-Turing share of its history's count, an unseen one its
    history's backoff weight times the word's own probability, a history never seen in training hands
    over whole. For each history the weights make all words, the unknown one included, sum to 1.
    base_score is the add-0.1 unigram score. A null or empty text is its end alone. Repeated rows
    each count and are each scored; an empty table gives no rows.

    Words and pairs are told apart by 64-bit hashes. The driver sees counts of counts, and the words and pairs
    that one bucket could not hold: fewer than 2^FREQUENT words by their count, and twice as many pairs.
    """
    spark = prepare(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    at_most = size[0] + (size[1] or 0) // 2 + 1
    # No pair occurs more than `room` times unless half of its occurrences are in batches that hold it `least` times.
    room = max(BUCKET_POSTINGS // 4, at_most >> FREQUENT)
    least = max(2, room * BATCH_WORDS // (2 * at_most))
    counts = materialize(word_counts(rows, least), "words")
    vocabulary = counts.where("h IS NULL").select("w", "c")
    got = vocabulary.agg(F.sum("c").alias("N"), F.count("*").alias("V"), *_counts_of_counts("c"), F.count_if(F.col("c") > TOP).alias("large")).first()
    n_all, vocab = int(got["N"] or 0), int(got["V"])
    uni_d = discounts([float(got[f"n{r}"]) for r in range(1, TOP + 2)])
    freed = sum((1 - uni_d[r - 1]) * r * got[f"n{r}"] for r in range(1, TOP + 1)) + LARGE * got["large"]
    pairs = counts.where(F.col("h").isNotNull() & (F.col("c") > room // 2)).select("w", "h").toPandas()
    key = _pair_keys(pairs["w"].to_numpy(dtype=np.int64), pairs["h"].to_numpy(dtype=np.int64))
    pairs = pairs.iloc[np.argsort(key)]
    own = spark.createDataFrame([(int(x),) for x in pairs["w"].unique()], "w long")
    hot = vocabulary.where(F.col("c") > room).unionByName(vocabulary.join(own, "w", "right").select("w", F.coalesce("c", F.lit(0)).alias("c"))).distinct().toPandas().sort_values("w")
    texts = int(vocabulary.where(F.col("w") == int(END)).agg(F.sum("c")).first()[0] or 0)
    model = {
        "N": n_all, "unknown": freed / n_all if n_all else 1.0, "uni_d": uni_d, "base_all": n_all + 0.1 * (vocab + 1),
        "hot": hot["w"].to_numpy(dtype=np.int64), "hot_counts": hot["c"].to_numpy(dtype=np.int64), "pairs": np.sort(key),
    }
    shared = spark.sparkContext.broadcast(model)

    def run(table: pa.Table) -> pa.Table:
        return _price(table, shared.value)

    levels = _levels(max(LEAST_BUCKETS, math.ceil(n_all / BUCKET_POSTINGS)))
    dealt = _deal(rows, levels[0], shared)
    for now, then in zip(levels, levels[1:], strict=False):
        dealt = _deal_again(dealt, now, then, n_all, shared)
    parts = materialize(dealt.groupBy("bucket").applyInArrow(run, PARTS), "parts")
    discard(counts)

    c, x = F.col("c"), F.col("x")
    # What is known of frequent pairs once their parts are summed.
    h, w = (pairs[name].to_numpy(dtype=np.int64) for name in ("h", "w"))
    c_w = model["hot_counts"][_among(w, model["hot"])[0]] if len(w) else np.empty(0, np.int64)
    often = spark.createDataFrame(list(zip(range(len(w)), h.tolist(), unigram(c_w, model).tolist(), strict=True)), "number long, h long, pu double")
    often = materialize(often.join(parts.where("kind = 4").groupBy(F.col("id").alias("number")).agg(F.sum("n").alias("cp")), "number"), "frequent")
    seen = often.where("cp > 0")
    of_pairs = seen.select("h", F.array(*[(F.col("cp") == r).cast("long") for r in range(1, TOP + 2)], (F.col("cp") > TOP).cast("long"), "cp").alias("c"), F.array("pu").alias("x"))
    of_history = parts.where("kind = 1").select(F.col("id").alias("h"), "c", "x").unionByName(of_pairs).groupBy("h").agg(*[F.sum(c[i]).alias(f"b{i + 1}") for i in range(TOP + 1)], F.sum(c[TOP + 1]).alias("large"), F.sum(c[TOP + 2]).alias("all"), F.sum(x[0]).alias("lower"))
    of_history = materialize(of_history, "histories")
    sums = of_history.agg(*[F.sum(f"b{r}").alias(f"n{r}") for r in range(1, TOP + 2)]).first()
    d = discounts([float(sums[f"n{r}"] or 0) for r in range(1, TOP + 2)])
    left = sum((F.col(f"b{r}") * float(r * (1 - d[r - 1])) for r in range(1, TOP + 1)), F.col("large") * F.lit(LARGE))
    # log10 of the backoff weight times the history's count, which the documents' sums took off.
    weight = of_history.select(F.col("h").alias("doc_id"), F.log10(left / (1 - F.col("lower"))).alias("weight"))
    unseen = parts.where("kind = 2").select("id", "doc_id", "n")
    priced = sum((F.sum(c[r]) * float(math.log10(d[r - 1])) for r in range(1, TOP + 1)), F.sum(x[1]))
    of_doc = parts.where("kind = 0").groupBy("id").agg(F.sum("n").alias("n_tokens"), F.sum(c[0]).alias("n_known"), F.sum(x[0]).alias("base_score"), priced.alias("seen"))
    if len(w):
        small = often.count() <= SMALL_TABLE
        met = parts.where("kind = 5").select("id", F.col("doc_id").alias("number"), "n").join(F.broadcast(often) if small else often, "number")
        kept = F.col("cp") * F.element_at(F.array(*[F.lit(v) for v in d]), F.greatest(F.least(F.col("cp"), F.lit(TOP)), F.lit(1)).cast("int"))
        log = F.log10(F.when(F.col("cp") > TOP, F.col("cp") - LARGE).when(F.col("cp") > 0, kept).otherwise(F.col("pu")))
        of_doc = of_doc.join(met.groupBy("id").agg(F.sum(F.col("n") * log).alias("often")), "id", "left").withColumn("seen", F.col("seen") + F.coalesce("often", F.lit(0.0))).drop("often")
        unseen = unseen.unionByName(met.where("cp = 0").select("id", F.col("h").alias("doc_id"), "n"))
    # Histories with many unseen pairs are among those with many seen ones.
    hot = materialize(of_history.where(F.col("all") > 10 * HOT_ROWS).select(F.col("h").alias("doc_id"), F.ceil(F.col("all") / (10 * HOT_ROWS)).cast("long").alias("_parts")), "hot")
    unseen = join_many(unseen, weight, ["doc_id"], "left", hot).groupBy("id").agg(F.sum(F.col("n") * F.coalesce("weight", F.lit(0.0))).alias("extra"))
    heads = parts.where("kind = 3").select("id", "doc_id", "held_out")
    first = float(math.log10(texts)) if texts else 0.0
    return heads.join(of_doc, "id").join(unseen, "id", "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", (F.col("seen") + F.coalesce("extra", F.lit(0.0)) - F.lit(first)).alias("score")
    )

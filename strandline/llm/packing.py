"""Best-fit packing of tokenised documents into fixed-length sequences (large-item matching)."""

from __future__ import annotations

import bisect
import json
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, prepare
from .numbering import number_within

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "p_length long, p_first long, p_until long, p_per_bin long, p_sequence long, p_offset long"
#: Words whose ids a worker keeps (some 200 bytes each), and bytes of text that are encoded together.
CACHE_WORDS, BLOCK_BYTES = 500_000, 4 << 20
#: Rows that one cut of a length may hold before the lengths are cut finer.
CUT_ROWS = 100_000
# The pre-token pattern that never crosses white space, and normalizers that keep it so.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = {"NFC", "Lowercase", "Replace"}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Latin, Greek and Cyrillic letters, of classes that no Unicode version has changed; without the capital
# dotted i, whose lower case is a letter and a mark.
LETTERS = "".join(chr(c) for a, b in ("AZ", "az", "ÀÖ", "Øö", "øį", "ıɏ", "ΑΡ", "Σώ", "Ѐҁ", "Ҋӿ") for c in range(ord(a), ord(b) + 1))
#: One loaded tokenizer and one word cache for each tokenizer file in a worker process.
_LOADED: dict[str, tuple] = {}


def _parts(spec: dict | None, plural: str) -> list[dict]:
    return [] if spec is None else spec[plural] if spec["type"] == "Sequence" else [spec]


def reads_by_words(spec: dict) -> bool:
    """Whether a tokenizer's ids of a text are the ids of its words in turn: white space is dropped, runs of letters
    and of punctuation are pre-tokens of their own, and an id that ends a pre-token says so."""
    splits, normal = _parts(spec["pre_tokenizer"], "pretokenizers"), _parts(spec["normalizer"], "normalizers")
    first = splits[0] if splits else {}
    white = [n for n in normal if n["type"] == "Replace" and (n["pattern"] != {"Regex": r"\s+"} or n["content"] != " ")]
    return (
        first.get("type") == "Split" and first["pattern"] == {"Regex": WORD_PATTERN} and first["behavior"] == "Removed" and first["invert"]
        and {n["type"] for n in normal} <= WORD_NORMALIZERS and not white
        and bool(spec["model"].get("end_of_word_suffix")) and not spec["model"].get("dropout")
    )


def _tokenizer(path: str) -> tuple:
    """(tokenizer, one for words of letters alone or None if texts must be encoded whole, which ids close a
    pre-token, cache of ids)."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, stems, closes = Tokenizer.from_file(path), None, None
        spec = json.loads(tokenizer.to_str())
        if reads_by_words(spec):
            suffix = spec["model"]["end_of_word_suffix"]
            vocab = tokenizer.get_vocab()
            closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
            closes[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
            # Letters need no pattern to be parted: white space does it.
            spec["normalizer"] = {"type": "Sequence", "normalizers": [n for n in _parts(spec["normalizer"], "normalizers") if n["type"] != "Replace"]}
            spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *_parts(spec["pre_tokenizer"], "pretokenizers")[1:]]}
            stems = Tokenizer.from_str(json.dumps(spec))
        _LOADED[path] = (tokenizer, stems, closes, {b"": b""})
    return _LOADED[path]


def _ids_of(tokenizer, texts: list[str]) -> list[bytes]:
    return [np.array(got.ids, dtype="<u4").tobytes() for got in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _encode_stems(tokenizer, closes: np.ndarray, stems: list[bytes]) -> list[bytes]:
    """Ids of words of letters alone: each is one pre-token, so one call encodes them all and the
    closing ids part them. Should the parts not add up (a letter whose lower case is not one), they
    are encoded one by one."""
    ids = np.array(tokenizer.encode_batch_fast([b" ".join(stems).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
    ends = 4 * (np.flatnonzero(closes[ids]) + 1)
    if len(ends) != len(stems) or (len(ends) and ends[-1] != 4 * len(ids)):
        return _ids_of(tokenizer, [s.decode() for s in stems])
    raw, out, start = ids.tobytes(), [], 0
    for end in ends.tolist():
        out.append(raw[start:end])
        start = end
    return out


def _ids_by_key(keys: pa.Array, loaded: tuple) -> list[bytes]:
    """Ids of runs of letters and of other words; a distinct one is encoded once for as long as the cache keeps it."""
    tokenizer, letters, closes, cache = loaded
    known = keys.cast(pa.large_binary()).to_pylist()
    new = np.array([k not in cache for k in known], dtype=bool)
    if len(cache) + new.sum() > CACHE_WORDS:
        kept = {k: cache[k] for k in known if k in cache}
        cache.clear()
        cache.update(kept)
    plain = pc.equal(pc.binary_length(pc.utf8_ltrim(keys, LETTERS)), 0).to_numpy(zero_copy_only=False)
    stems, others = ([known[i] for i in np.flatnonzero(new & kind)] for kind in (plain, ~plain))
    if stems:
        cache.update(zip(stems, _encode_stems(letters, closes, stems), strict=True))
    cache.update(zip(others, _ids_of(tokenizer, [w.decode() for w in others]), strict=True))
    return [cache[k] for k in known]


def _gather(table: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of `table` from `start` on of `size` entries each, in a row."""
    stop = np.cumsum(size)
    return table[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


def _encode_words(texts: pa.LargeStringArray, loaded: tuple, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of all texts, each closed by `end_id`, and where each text's ids end.

    A word of letters and closing punctuation is two pre-tokens. Distinct letters, tails and other words are encoded;
    their ids are dealt to the block's distinct words, and those to their places.
    """
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    distinct = words.dictionary
    stem, tail = pc.utf8_rtrim(distinct, PUNCTUATION), pc.utf8_ltrim(distinct, LETTERS)
    long = pc.binary_length(stem)
    two = pc.and_(pc.equal(pc.add(long, pc.binary_length(tail)), pc.binary_length(distinct)), pc.greater(long, 0))
    key = pc.if_else(two, pc.ascii_lower(stem), distinct).dictionary_encode()
    tail = pc.if_else(two, tail, "").dictionary_encode()
    # The last entry is the end of a text.
    raw = [*_ids_by_key(key.dictionary, loaded), *_ids_by_key(tail.dictionary, loaded), end_id.to_bytes(4, "little")]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
    start = np.cumsum(size) - size
    table = np.frombuffer(b"".join(raw), dtype="<u4")
    parts = np.append(np.stack([key.indices.to_numpy(), tail.indices.to_numpy() + len(key.dictionary)], 1).ravel(), len(raw) - 1)
    table = _gather(table, start[parts], size[parts])
    size = np.append(size[parts[:-1]].reshape(-1, 2).sum(axis=1), 1)
    start = np.cumsum(size) - size
    at = split.offsets.to_numpy()
    place = np.insert(words.indices.to_numpy(), at[1:] - at[0], len(size) - 1)
    ends = np.cumsum(size[place])[at[1:] - at[0] + np.arange(len(texts))]
    return _gather(table, start[place], size[place]), ends


def _encode_whole(texts: pa.LargeStringArray, loaded: tuple, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As `_encode_words`, for a tokenizer whose ids may depend on white space."""
    raw = [got + end_id.to_bytes(4, "little") for got in _ids_of(loaded[0], texts.to_pylist())]
    return np.frombuffer(b"".join(raw), dtype="<u4"), np.cumsum([len(r) // 4 for r in raw])


def encode_texts(texts: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, ids, ends) of blocks of texts: their ids by the tokenizer of `path`, each text closed by `end_id`,
    and where each text's ids end. A null text is empty.

    Where the tokenizer drops white space and parts letters from punctuation before its merges, a text's ids are the ids
    of its words in turn, and distinct words are encoded; with any other tokenizer whole texts are.
    """
    loaded = _tokenizer(path)
    encode = _encode_words if loaded[1] is not None else _encode_whole
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES)))
        ids, ends = encode(texts[at:until], loaded, end_id)
        yield at, ids, ends
        at = until


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of at most `capacity` ids: doc_id, piece, start, length, ids_crc32.

    Whole texts are encoded; a null or empty text is its end id alone. Repeated rows are kept.
    """
    prepare(docs.sparkSession)
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def run(batches):
        for batch in batches:
            doc_ids = batch.column(0)
            for first, ids, ends in encode_texts(batch.column(1), tokenizer_path, end_id):
                length = np.diff(ends, prepend=0)
                pieces = -(-length // capacity)
                owner = np.repeat(np.arange(len(ends)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = (ends - length)[owner] + piece * capacity
                stop = np.minimum(start + capacity, ends[owner])
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                columns = (doc_ids.take(pa.array(first + owner)), piece, piece * capacity, stop - start, crc)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first, until, per_bin, sequence, offset).

    The work depends on the number of distinct lengths (at most `capacity`), not on the number of
    pieces. Lengths above a third of the capacity are matched first, largest with the largest that
    still fits, two to a bin at most; the smaller ones, largest first, then go to the bin with
    the least gap that holds them, and open new bins only when no gap does.
    """
    left, used, plan, gaps, order, sequence = dict(counts), dict.fromkeys(counts, 0), [], {}, [], 0

    def put(length: int, bins: int, per_bin: int, at: int, offset: int) -> None:
        plan.append((length, used[length], used[length] + bins * per_bin, per_bin, at, offset))
        used[length] += bins * per_bin
        left[length] -= bins * per_bin

    def add_gap(gap: int, at: int, bins: int) -> None:
        if gap and bins:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((at, bins))

    large = sorted(x for x in counts if 3 * x > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect.bisect_right(large, min(capacity - length, length)) - 1
            while at >= 0 and left[large[at]] < 1 + (large[at] == length):
                at -= 1
            if at < 0:
                bins = left[length]
                put(length, bins, 1, sequence, 0)
                add_gap(capacity - length, sequence, bins)
            elif large[at] == length:
                bins = left[length] // 2
                put(length, bins, 2, sequence, 0)
                add_gap(capacity - 2 * length, sequence, bins)
            else:
                bins = min(left[length], left[large[at]])
                put(length, bins, 1, sequence, 0)
                put(large[at], bins, 1, sequence, length)
                add_gap(capacity - length - large[at], sequence, bins)
            sequence += bins

    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[length]:
            k = bisect.bisect_left(order, length)
            if k < len(order):
                gap = order[k]
                at, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(k)
            else:
                gap, at, bins = capacity, sequence, -(-left[length] // (capacity // length))
                sequence += bins
            per_bin = gap // length
            full = min(bins, left[length] // per_bin)
            if full:
                put(length, full, per_bin, at, capacity - gap)
                add_gap(gap - per_bin * length, at, full)
            if full < bins and left[length]:
                rest = left[length]
                put(length, 1, rest, at + full, capacity - gap)
                add_gap(gap - rest * length, at + full, 1)
                full += 1
            if gap < capacity:
                add_gap(gap, at + full, bins - full)
    return plan


def pack_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack documents: the columns of `token_pieces` plus sequence_id and offset.

    Only the number of pieces of each length (at most `capacity` numbers) goes to the driver, and
    only the plan made of it (bounded by the capacity alone) is broadcast. An empty table gives no
    rows; null doc_ids are kept; extra columns are ignored.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = spark.createDataFrame(plan_bins(counts, capacity), PLAN)
    # The pieces of the most frequent length decide into how many cuts (powers of 16) each length goes.
    digits = max(1, math.ceil(math.log(max(counts.values(), default=1) / CUT_ROWS, 16))) if counts else 1
    numbered = number_within(pieces, ["length"], F.md5(F.concat_ws(":", "doc_id", "piece", "ids_crc32")), ["doc_id", "piece", "ids_crc32"], "_ord", digits=digits)
    step = F.col("_ord") - F.col("p_first")
    return numbered.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("_ord") >= F.col("p_first")) & (F.col("_ord") < F.col("p_until"))).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("p_sequence") + F.floor(step / F.col("p_per_bin"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + F.pmod(step, F.col("p_per_bin")) * F.col("length")).cast("long").alias("offset"),
    )

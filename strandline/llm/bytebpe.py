"""Ids of whole texts by byte-level BPE tokenizers: distinct chunks of a block are encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids a worker keeps (some 200 bytes each), and bytes of text that are encoded together.
CACHE_PIECES, BLOCK_BYTES = 1_000_000, 8 << 20
#: Longer pieces are encoded one by one and not kept.
LONGEST_PIECE = 64
#: White space beside space, \t, \n and \r, and signs that some engines count as such: their texts are encoded whole.
ODD_SPACE = "\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Latin, Greek and Cyrillic letters, of classes that no Unicode version has changed.
LETTERS = "".join(chr(c) for a, b in ("AZ", "az", "ÀÖ", "Øö", "øɏ", "ΑΡ", "Σώ", "Ѐҁ", "Ҋӿ") for c in range(ord(a), ord(b) + 1))
#: One encoder for each tokenizer file in a worker process.
_LOADED: dict[str, Encoder] = {}


def splits_at_spaces(spec: dict) -> bool:
    """Whether ids of a text are those of its chunks in turn, a chunk being white space and the word behind it."""
    first, model = spec["pre_tokenizer"] or {}, spec["model"]
    return (
        first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        and spec["normalizer"] is None and not spec.get("truncation") and model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token")
        and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
    )


def gather(table: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of `table` from `start` on of `size` entries each, in a row."""
    stop = np.cumsum(size)
    return table[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


class Encoder:
    """A tokenizer and the ids of the pieces of text it has met.

    A byte-level pre-token never holds white space but in front: so one always begins where white space follows
    another sign, and what it is depends on nothing before that place. Chunks from such a place to the next are
    encoded each by itself, and punctuation behind a letter is a piece of its own. Pieces of white space with a word behind
    it stay apart when laid end to end, so that one call encodes all, and the ids' bytes, which are the text's, part
    them again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_chunk = splits_at_spaces(spec)
        self.top = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.bytes_of = np.zeros(self.top + 1, dtype=np.int64)
        if self.by_chunk:
            # A byte is one letter of a token of the vocabulary.
            self.bytes_of[list(spec["model"]["vocab"].values())] = [len(t) for t in spec["model"]["vocab"]]
        self.odd = "|".join([f"[{ODD_SPACE}]", *[re.escape(t["content"]) for t in spec["added_tokens"]]])
        self.forget()

    def forget(self) -> None:
        """Piece -> its number in `sizes`, the numbers of its ids; `ids` has all these in a row."""
        self.number: dict[bytes, int] = {}
        self.sizes, self.ids = np.empty(0, dtype=np.int64), np.empty(0, dtype="<u4")

    def alone(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of texts."""
        got = [g.ids for g in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        return np.fromiter(map(len, got), dtype=np.int64, count=len(got)), np.array([i for ids in got for i in ids], dtype="<u4")

    def together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As `alone`, for pieces that each begin with white space and end with another sign."""
        if not pieces:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype="<u4")
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(pieces).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        reached, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        ends = np.searchsorted(reached, wanted) + 1
        if not len(ids) or reached[-1] != wanted[-1] or (reached[ends - 1] != wanted).any():
            return self.alone(pieces)
        return np.diff(ends, prepend=0), ids

    def look_up(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of distinct pieces, those met for the first time encoded."""
        known = pieces.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.number.get, known, repeat(-1)), dtype=np.int64, count=len(known))
        new = np.flatnonzero(numbers < 0).tolist()
        if len(self.number) + len(new) > CACHE_PIECES and len(new) < len(known):
            self.forget()
            return self.look_up(pieces)
        both: list[list[int]] = [[], []]
        for i in new:
            piece = known[i]
            both[not piece or len(piece) > LONGEST_PIECE or piece[0] not in b" \t\n\r" or piece[-1] in b" \t\n\r"].append(i)
        sizes, ids = self.sizes, self.ids
        for at, encode in zip(both, (self.together, self.alone), strict=True):
            if at:
                numbers[at] = np.arange(len(at)) + len(sizes)
                here = [known[i] for i in at]
                more = encode(here)
                sizes, ids = np.append(sizes, more[0]), np.append(ids, more[1])
                if encode == self.together:
                    self.number.update(zip(here, range(len(self.sizes), len(sizes)), strict=True))
                    self.sizes, self.ids = sizes, ids
        return sizes[numbers], gather(ids, (np.cumsum(sizes) - sizes)[numbers], sizes[numbers])

    def encode(self, texts: pa.LargeStringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, each closed by `end_id`, and where each text's ids end."""
        if not self.by_chunk:
            sizes, ids = self.alone(texts.cast(pa.large_binary()).to_pylist())
            return np.insert(ids, np.cumsum(sizes), end_id).astype("<u4"), np.cumsum(sizes + 1)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        opens = (data == 32) | (data == 10) | (data == 13) | (data == 9)
        opens[1:] &= ~opens[:-1]
        for i in np.flatnonzero(odd).tolist():
            opens[offsets[i] : offsets[i + 1]] = False
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        begins = np.flatnonzero(opens)
        per_text = np.searchsorted(begins, offsets)
        chunks = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)).dictionary_encode()
        distinct = chunks.dictionary
        # Letters, then punctuation, are two pre-tokens.
        stem, tail = pc.utf8_rtrim(distinct, PUNCTUATION), pc.utf8_ltrim(distinct, " \t\n\r" + LETTERS)
        size = pc.binary_length(stem)
        two = pc.and_(pc.equal(pc.add(size, pc.binary_length(tail)), pc.binary_length(distinct)), pc.less(pc.binary_length(pc.utf8_rtrim(stem, LETTERS)), size))
        stem, tail = pc.if_else(two, stem, distinct).dictionary_encode(), pc.if_else(two, tail, "").dictionary_encode()
        pieces = [self.look_up(part.dictionary.cast(pa.large_binary())) for part in (stem, tail)]
        # The last entry is the end of a text.
        sizes, ids = np.concatenate([pieces[0][0], pieces[1][0], [1]]), np.concatenate([pieces[0][1], pieces[1][1], np.array([end_id], dtype="<u4")])
        parts = np.append(np.stack([stem.indices.to_numpy(), tail.indices.to_numpy() + len(stem.dictionary)], 1).ravel(), len(sizes) - 1).astype(np.int64)
        ids, sizes = gather(ids, (np.cumsum(sizes) - sizes)[parts], sizes[parts]), sizes[parts]
        sizes = np.append(sizes[:-1].reshape(-1, 2).sum(axis=1), 1)
        place = np.insert(chunks.indices.to_numpy().astype(np.int64), per_text[1:], len(sizes) - 1)
        ends = np.cumsum(sizes[place])[per_text[1:] + np.arange(len(texts))]
        return gather(ids, (np.cumsum(sizes) - sizes)[place], sizes[place]), ends


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def encode_blocks(texts: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, ids, ends) of blocks of texts: their ids by the tokenizer of `path`, each text closed by `end_id`,
    and where each text's ids end. A null text is empty."""
    loaded = encoder(path)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES)))
        ids, ends = loaded.encode(texts[at:until], end_id)
        yield at, ids, ends
        at = until

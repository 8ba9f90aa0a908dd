import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import packing
from strandline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, piece string, length int"


def whole(texts, path=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def encoded(texts, path):
    out = []
    for first, ids, ends in packing.encode_texts(pa.array(texts, pa.string()), path, 0):
        assert first == len(out)
        out += [part.tolist() for part in np.split(ids, ends[:-1])]
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("block", [1, 5000, 8 << 20])
def test_encoding_equals_whole_texts(spark, monkeypatch, name, block):
    import public_tokenizers

    monkeypatch.setattr(packing, "BLOCK_BYTES", block)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(400 if block > 1 else 20).collect()
    texts = [r[0] for r in docs] + [
        "", None, "  \t ", "It's  I'm can't 'S", "café cafe\u0301 \u0301x cafe\u0301.", "İstanbul İ", "Σας ΟΔΟΣ ΟΔΟΣ.", "a1b22 x_y #tag don't!",
        "<|endoftext|> a<|endoftext|>b", "你好。 emoji \U0001f600\U0001f600  line", "of, of. OF; of?! ...", "\xa0nbsp\xa0x", "x\x1cy\x85z",
        "Éa$$$ ÉA.%%% don' 's ''s x's. Ǆa ᾼ ꟊ", "",
    ]
    path = public_tokenizers.path(name)
    assert encoded(texts, path) == whole(texts, path)
    assert (packing._tokenizer(path)[1] is not None) == (name == "word_bpe_49k.json")


def test_a_small_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    monkeypatch.setattr(packing, "BLOCK_BYTES", 10)
    texts = ["one two, three", "two three FOUR five", "one", "", "six! two, seven x1"]
    assert encoded(texts, tokenizer_path()) == whole(texts)


def fewest_bins(lengths, cap):
    """The least number of bins, by trying every place of every piece."""
    best = len(lengths)

    def place(at, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[at] <= cap and bins[i] not in bins[:i]:
                place(at + 1, [*bins[:i], bins[i] + lengths[at], *bins[i + 1 :]])
        place(at + 1, [*bins, lengths[at]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_plan_is_near_the_fewest_bins():
    rnd = random.Random(5)
    exact = 0
    for _ in range(150):
        cap = rnd.choice([10, 30, 100])
        lengths = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 9))]
        plan = packing.plan_bins({x: lengths.count(x) for x in set(lengths)}, cap)
        used = len({sequence + t // per_bin for _, first, until, per_bin, sequence, _ in plan for t in range(until - first)})
        least = fewest_bins(lengths, cap)
        assert least <= used <= least + 1
        exact += used == least
    assert exact >= 140


def optimum_bound(lengths, cap):
    return -(-sum(lengths) // cap)


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_bins_without_gaps(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 64, 2048])
    lengths = [rnd.randint(1, cap) if rnd.random() < 0.5 else rnd.randint(1, max(1, cap // 4)) for _ in range(rnd.randint(1, 3000))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.plan_bins(counts, cap)
    bins: dict = {}
    seen: dict = {}
    for length, first, until, per_bin, sequence, offset in plan:
        for o in range(first, until):
            seen.setdefault(length, []).append(o)
            t = o - first
            bins.setdefault(sequence + t // per_bin, []).append((offset + t % per_bin * length, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items()}
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= cap
    assert len(bins) <= 1.25 * optimum_bound(lengths, cap) + 1 or len(bins) <= sum(2 * x > cap for x in lengths) + 1.25 * optimum_bound([x for x in lengths if 2 * x <= cap], cap) + 1


def test_pack_edge_cases(spark):
    long = " ".join(["word"] * 9000)
    rows = [(1, "", "x", 1), (2, None, None, None), (None, "null id here", "y", 2), (3, long, "z", 3), (4, "same text", "a", 4), (4, "same text", "a", 4)]
    out = packing.pack_sequences(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), 2048).collect()
    expect = []
    for (doc, text, *_), ids in zip(rows, whole([r[1] for r in rows]), strict=True):
        for p, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at : at + 2048]
            expect.append((doc, p, at, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes())))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(expect, key=key)
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in by.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_sequences(spark.createDataFrame([], SCHEMA), tokenizer_path(), 2048).count() == 0

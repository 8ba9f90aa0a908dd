"""Each operator against a plain version on small tables, and its edge cases."""

import hashlib
import math
import pathlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import components, katz, kneser, langid, linedup, minhash, mixing, rules, sharding, skew, topk
from strandline.llm.words import column_words
from strandline.session import materialize, scratch_root

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Clashing names that the operators use inside.
EXTRA = DOC + ", node long, key string, size int, _d string, shard int, score double, n_lines string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, langs=None, sources=None, ids=None):
    rows = [((i if ids is None else ids[i]), t, (langs[i] if langs else "en"), (sources[i] if sources else f"s{i % 3}"), None if t is None else len(t), 1, "k", 2, "d", 3, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA)


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return WORD.findall(lower(text or ""))


def sentences(seed, n, vocabulary=60, length=40):
    rnd = random.Random(seed)
    vocab = ["w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(vocabulary)]
    return [" ".join(rnd.choices(vocab, k=rnd.randint(1, length))) for _ in range(n)]


ODD = ["", None, " \n\t ", "one", "A b c \x85 d", "x " * 9000, "same", "same", "Été \U0001f600"]


# --- 1: exact top-k

def test_top_k_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(700)]
    rows += [(700, None), (701, [float("nan")] * 8), (702, [0.1, None] * 4), (703, [0.0] * 8), (704, rows[3][1]), (705, rows[3][1]), (None, rows[0][1]), (706, []), (750, [1.0, 2.0]), (50, rows[50][1]), (50, rows[7][1]), (20, rows[50][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.search_embeddings(table, 5, 50).collect()))
    stored = [(r[0], r[1]) for r in table.collect()]
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in stored if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    expect = []
    for n, (q, v) in enumerate(sound):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(sound) if m != n and len(w) == len(v))[:5]
            expect += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(expect)
    assert topk.search_embeddings(spark.createDataFrame([], table.schema), 5, 50).count() == 0


def test_top_k_ships_only_live_blocks(spark, monkeypatch):
    """Vectors in far-apart bundles by id: most blocks never meet a set of queries, and the result is whole."""
    for name, value in (("BLOCK_ROWS", 8), ("GROUP_BLOCKS", 2), ("QUERY_ROWS", 4), ("CHUNK_BLOCKS", 16)):
        monkeypatch.setattr(topk, name, value)
    rnd = random.Random(4)
    rows = [(i, [(9.0 if j == i // 60 else 0.0) + rnd.random() for j in range(10)]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    whole = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(whole)
    blocks = materialize(topk.block_table(vectors.withColumn("row", F.monotonically_increasing_id()).withColumn("width", F.size("v"))), "blocks")
    assert sum(len(r.ids) for r in blocks.collect()) == 900 and max(len(r.ids) for r in blocks.collect()) <= 8
    got = sorted(map(tuple, topk.search_embeddings(whole, 5, 50).collect()))
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    expect = []
    for q, v in sound:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q)[:5]
            expect += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(expect)


def test_a_block_below_the_seed_is_left():
    blocks = pa.table({"ids": [[1, 2], [3]], "rows": [[1, 2], [3]], "flat": [[5, 0, 4, 0], [1, 1]], "high": [[5, 0], [1, 1]], "low": [[4, 0], [1, 1]]})
    number, ids, scores = topk.search_group(np.array([[2, 0], [0, 3]]), np.array([1, 9]), np.array([4, 3]), blocks, 2)
    assert (number.tolist(), ids.tolist(), scores.tolist()) == ([0, 1], [2, 3], [8, 3])
    with pytest.raises(OverflowError):
        topk.search_group(np.array([[1 << 40, 0]]), np.array([9]), np.array([0]), blocks.set_column(2, "flat", pa.array([[1 << 40, 0, 4, 0], [1, 1]])).set_column(3, "high", pa.array([[1 << 40, 0], [1, 1]])), 2)


# --- 2: Kneser-Ney

def brute_kneser(training, tests):
    grams = Counter()
    for t in training:
        w = ["<s>", "<s>", *words(t), "</s>"]
        grams.update(zip(w, w[1:], w[2:], strict=False))
    levels = [grams]
    for _ in range(2):
        levels.append(Counter(g[1:] for g in levels[-1]))

    def cut(counts):
        n = [sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)]
        y = n[0] / max(n[0] + 2 * n[1], 1)
        return [min(max(i - (i + 1) * y * n[i] / max(n[i - 1], 1), 0.1), i - 0.05) for i in (1, 2, 3)]

    cuts = [cut(c) for c in levels]
    d = lambda k, c: cuts[k][min(c, 3) - 1]
    totals, freed = [Counter() for _ in levels], [Counter() for _ in levels]
    for k, counts in enumerate(levels):
        for g, c in counts.items():
            totals[k][g[:-1]] += c
            freed[k][g[:-1]] += d(k, c)

    def p(k, g):
        low = 1 / (len(levels[2]) + 1) if k == 2 else p(k + 1, g[1:])
        h = g[:-1]
        if not totals[k][h]:
            return low
        c = levels[k][g]
        return (c - d(k, c) if c else 0) / totals[k][h] + freed[k][h] / totals[k][h] * low

    out = []
    for t in tests:
        w = ["<s>", "<s>", *words(t), "</s>"]
        out.append(math.exp(-sum(math.log(p(0, g)) for g in zip(w, w[1:], w[2:], strict=False)) / (len(w) - 2)))
    return out


def test_kneser_ney_equals_plain_version(spark):
    texts = sentences(1, 80)
    table = docs(spark, texts)
    model = kneser.train(table.limit(50))
    got = {r.doc_id: r.perplexity for r in kneser.perplexities(table.select("doc_id", "lang", "text"), model).collect()}
    expect = brute_kneser(texts[:50], texts)
    assert [got[i] for i in range(80)] == pytest.approx(expect, rel=1e-9)


def test_quality_edges(spark):
    table = docs(spark, [*sentences(2, 60), *ODD], langs=["en"] * 50 + [None] * 10 + ["xx"] * len(ODD))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(3, 0, 0), (5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in kneser.classify_quality(table, labels).collect()}
    assert len(out) == 60 + len(ODD)
    assert not out[60].kept and not out[61].kept and not out[62].kept and out[63].kept and out[63].threshold is None
    assert sum(out[i].kept for i in range(60)) >= 40
    none = spark.createDataFrame([], labels.schema)
    assert all(r.kept for r in kneser.classify_quality(table.limit(5), none).collect())
    assert kneser.classify_quality(spark.createDataFrame([], EXTRA), labels).count() == 0


def test_long_trusted_texts_leave_training_text(spark):
    """Texts over the word bound, the first by md5 or not, neither empty the model nor end it early."""
    texts = [f"long{i} " * 90 if i % 4 == 0 else f"a b c d e f g h i {i}" for i in range(40)] + ["long " * 90] * 3 + ["junk%d bad%d x%d" % (i, i, i) for i in range(5)]
    table = docs(spark, texts, langs=["en"] * 40 + ["xx"] * 3 + ["en"] * 5)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(43)], "doc_id long, quality int, toxic int")
    used = kneser.trusted_sample(table.select("doc_id", "lang", "text"), labels, 2000, 80)[1].collect()
    assert {x: sum(r.take for r in used if r.lang == x) for x in ("en", "xx")} == {"en": 80, "xx": 80}
    assert len([r for r in used if r.lang == "en"]) == 8 and all(r.doc_id % 4 for r in used if r.lang == "en")
    assert all(r.threshold is not None for r in kneser.classify_quality(table, labels, max_words=80).collect())


def test_the_first_trusted_texts_are_chosen(spark):
    table = docs(spark, [f"t{i}" for i in range(60)], langs=["en"] * 40 + [None] * 20).select("doc_id", "lang", "text")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    used = {r.doc_id for r in kneser.trusted_sample(table, labels, 9, 10**6)[1].collect()}
    order = sorted((i for i in range(60) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert used == {*[i for i in order if i < 40][:9], *[i for i in order if i >= 40][:9]}


def test_all_trusted_texts_are_learnt_from(spark):
    table = spark.range(2600).selectExpr("id AS doc_id", "'en' AS lang", "concat('t', id, repeat(' w', 300)) AS text")
    labels = spark.range(2600).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    used = kneser.trusted_sample(table, labels, *kneser.classify_quality.__defaults__[:2])[1]
    assert {r.doc_id for r in used.select("doc_id").collect()} == {i for i in range(2600) if zlib.crc32(str(i).encode()) % 5}
    assert "take" not in used.columns


def test_ngrams_are_joined_in_shards(spark, monkeypatch):
    """With hardly any hot n-grams and a filter that lets nearly all pass, the joined table alone gives the perplexities, in each language."""
    monkeypatch.setattr(kneser, "HOT", 1)
    monkeypatch.setattr(kneser, "FILTER", 8)
    texts = sentences(1, 80)
    table = docs(spark, texts, langs=[None if i % 2 else "en" for i in range(80)])
    model = kneser.train(table.where("doc_id < 50"))
    assert len(model["hot"][0]) == 2 and model["table"].columns == ["key", "x", "c"]
    got = {r.doc_id: r.perplexity for r in kneser.perplexities(table.select("doc_id", "lang", "text"), model).collect()}
    for k in (0, 1):
        assert [got[i] for i in range(k, 80, 2)] == pytest.approx(brute_kneser(texts[k:50:2], texts[k::2]), rel=1e-9)


def test_trigrams_and_rare_ngrams_are_joined_part_by_part(spark, monkeypatch):
    """Each part's shuffles are gone before the next; the parts together give the perplexities."""
    made, store = [], kneser.materialize
    monkeypatch.setattr(kneser, "materialize", lambda df, label: made.append((label, store(df, label))) or made[-1][1])
    monkeypatch.setattr(kneser, "PARTS", 3)
    monkeypatch.setattr(kneser, "HOT", 1)
    texts = sentences(1, 80)
    table = docs(spark, texts)
    model = kneser.train(table.where("doc_id < 50"))
    got = {r.doc_id: r.perplexity for r in kneser.perplexities(table.select("doc_id", "lang", "text"), model).collect()}
    assert [got[i] for i in range(80)] == pytest.approx(brute_kneser(texts[:50], texts), rel=1e-9)
    sizes = {label: [t.count() for x, t in made if x == label] for label in ("trigram_shares", "extra")}
    assert [len(x) for x in sizes.values()] == [3, 3] and 0 < max(sizes["trigram_shares"]) < sum(sizes["trigram_shares"])
    assert sum(sizes["trigram_shares"]) == len({x for t in texts[:50] for x in zip(*[["<s>", "<s>", *words(t), "</s>"][i:] for i in range(3)], strict=False)})


def test_one_part_of_the_model_lies_on_disk_at_a_time(spark, monkeypatch):
    """When a part's texts are answered, no other part's table is there any more, and the shares of pairs are all that is kept besides."""
    left, store = [], kneser.materialize

    def watch(df, label):
        out = store(df, label)
        if label == "extra":
            root = pathlib.Path(out._strandline_path.removeprefix("file:")).parent
            left.append({x: len([*root.glob(f"strandline-{x}-*")]) - before.get(x, 0) for x in ("pairs", "part_shares")})
        return out

    root = pathlib.Path(scratch_root(spark).removeprefix("file:"))
    before = {x: len([*root.glob(f"strandline-{x}-*")]) for x in ("pairs", "part_shares")}
    monkeypatch.setattr(kneser, "materialize", watch)
    monkeypatch.setattr(kneser, "PARTS", 3)
    table = docs(spark, sentences(2, 60))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert kneser.classify_quality(table, labels).count() == 60
    assert left == [{"pairs": 0, "part_shares": 1}] * 3


def test_word_hashes_of_a_column(spark):
    texts = [None, "", "a b", "c", " Ab\tabcdefghij ", "abcdefgh abcdefghi abcdefghij", "b\x0bc\x1fd", "\u00e9 \u00c9"]
    hashes, sizes = column_words(pa.array(texts))
    split = [w for t in texts for w in (t or "").encode().lower().split()]
    assert sizes.tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(hashes) == len(split) and len(set(hashes.tolist())) == len(set(zip(split, hashes.tolist(), strict=True))) == len(set(split))


# --- 3: Katz

def brute_katz(texts, ids, modulus):
    held = [i is not None and zlib.crc32(str(i).encode()) % modulus == 0 for i in ids]
    uni, pairs, hist = Counter(), Counter(), Counter()
    rows = [["<s>", *words(t), "</s>"] for t in texts]
    for w, h in zip(rows, held, strict=True):
        if not h:
            uni.update(w[1:])
            pairs.update(zip(w, w[1:], strict=False))
            hist.update(w[:-1])

    def cuts(counter):
        n = [sum(c == r for c in counter.values()) for r in range(1, 7)]
        return katz.discounts([float(x) for x in n])

    d1, d2, n_all = cuts(uni), cuts(pairs), sum(uni.values())
    keep = lambda c, d: c * d[c - 1] if c <= 5 else c - 0.1
    unknown = 1 - sum(keep(c, d1) for c in uni.values()) / n_all
    p1 = lambda w: keep(uni[w], d1) / n_all if uni[w] else unknown
    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c
    weight = {h: (1 - sum(keep(c, d2) for c in f.values()) / hist[h]) / (1 - sum(p1(w) for w in f)) for h, f in after.items()}

    def p(h, w):
        if pairs[h, w]:
            return keep(pairs[h, w], d2) / hist[h]
        return weight.get(h, 1.0) * p1(w)

    for h in list(after)[:20]:
        assert sum(p(h, w) for w in uni) + p(h, "<unknown>") == pytest.approx(1, abs=1e-9)
    out = []
    for i, (w, h) in enumerate(zip(rows, held, strict=True)):
        base = sum(math.log10((uni[x] + 0.1) / (n_all + 0.1 * (len(uni) + 1))) for x in w[1:])
        out.append((ids[i], h, len(w) - 1, sum(uni[x] > 0 for x in w[1:]), n_all, base, sum(math.log10(p(a, b)) for a, b in zip(w, w[1:], strict=False))))
    return out


@pytest.mark.parametrize(("batch", "fan", "room"), [(1_500_000, 512, 1_500_000), (100, 512, 40), (100, 2, 40)])
def test_katz_equals_plain_version(spark, batch, fan, room, monkeypatch):
    """In one batch; in many, with frequent words and pairs; and with buckets reached by dealing three times."""
    texts = [*sentences(5, 120), *ODD, *["held pair held pair"] * 30]
    ids = [*range(125), None, 7, 126, 126, *[next(i for i in range(200, 400) if zlib.crc32(str(i).encode()) % 10 == 0)] * 30]
    monkeypatch.setattr(katz, "LEAST_BUCKETS", 7)
    monkeypatch.setattr(katz, "BATCH_WORDS", batch)
    monkeypatch.setattr(katz, "FAN", fan)
    monkeypatch.setattr(katz, "BUCKET_POSTINGS", room)
    got = katz.score_documents(docs(spark, texts, ids=ids).repartition(3), 10).collect()
    key = lambda r: tuple((x is None, x) if not isinstance(x, float) else (False, round(x, 6)) for x in r)
    expect = brute_katz(texts, ids, 10)
    assert len(got) == len(expect)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expect, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert katz.score_documents(spark.createDataFrame([], EXTRA), 10).count() == 0


def test_a_bucket_is_priced_alike_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    w, h, row = np.sort(rng.integers(0, 30, 500)), rng.integers(0, 20, 500), rng.integers(0, 40, 500)
    order = np.lexsort((row, h, w))
    blocks = list(katz._blocks(w[order], h[order], row[order], rng.integers(1, 4, 500) * np.where(row[order] % 5 == 0, -1, 1), np.zeros(500, dtype=np.int64), 0, {0: [9, 0, 10, 1]}))
    model = {"N": 900, "unknown": 0.01, "uni_d": [0.5] * 5, "base_all": 1e3, "hot": np.array([3, 7]), "hot_counts": np.array([40, 50]), "pairs": np.sort(katz._pair_keys(np.array([3, 7]), np.array([1, 2])))}
    whole = katz._price(pa.Table.from_batches(blocks), model).to_pylist()
    monkeypatch.setattr(katz, "PRICE_ROWS", 7)
    parts = katz._price(pa.Table.from_batches(blocks), model).to_pylist()
    plain = lambda rows: sorted(repr({k: [round(v, 9) for v in x] if k == "x" and x else x for k, x in r.items()}) for r in rows)
    assert plain(whole) == plain(parts) and {r["kind"] for r in whole} == {0, 1, 2, 3, 4, 5}


# --- 4: rules

def brute_counts(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_rules_counts_and_guards(spark):
    rnd = random.Random(4)
    clean = [" ".join(rnd.choices(["the", "of", "and", "river", "stone", "Walks,", "over"], k=120)) for _ in range(30)]
    junk = [" ".join(w + "###" for w in t.split()) for t in clean[:4]] + [" ".join(rnd.choices(["zzqa", "kkwe", "ppvu", "|"], k=200)) for _ in range(3)]
    texts = [*clean, *junk, *ODD, "a\nb\na\n\n\na", "p q r p q r p q", "s t s t s"]
    out = {r.doc_id: r for r in rules.judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t), t
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert not (r.base_failed and r.kept)
    sound = [i for i in range(30) if not out[i].base_failed]
    assert all(out[i].kept for i in sound)
    assert not any(out[i].kept for i in range(30, 37))
    kept = rules.keep_good(docs(spark, [*texts, texts[sound[0]]] if sound else texts))
    assert kept.columns == [f.split()[0] for f in EXTRA.split(", ")]
    assert rules.judge(spark.createDataFrame([], EXTRA)).count() == 0
    assert rules.judge(docs(spark, clean, langs=[None] * 30)).where("kept or base_failed").count() == 30


# --- 5: mixing

def test_mix_targets_and_cap(spark):
    texts = ["w " * 5] * 4 + ["w " * 100] * 40 + ["w " * 300] * 30 + [None, ""]
    sources = ["a"] * 4 + ["b"] * 40 + ["c"] * 30 + [None, "d"]
    rows = mixing.mix_sources(docs(spark, texts, sources=sources)).collect()
    by = {}
    for r in rows:
        s = by.setdefault(r.source, [r.source_size, r.target, 0, 0])
        s[2] += r.taken
        s[3] = max(s[3], r.size)
        assert r.taken <= 3 * r.size
    assert by["a"][:2] == [20, 60.0] and by[None][:2] == [0, 0.0] and by["d"][:2] == [0, 0.0]
    assert sum(v[1] for v in by.values()) == pytest.approx(13020)
    assert all(abs(v[2] - v[1]) <= v[3] / 2 + 1e-9 for v in by.values())
    again = mixing.mix_sources(docs(spark, texts, sources=sources).repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    whole = mixing.expand_mix(docs(spark, texts, sources=sources))
    assert Counter(r.doc_id for r in whole.collect()) == Counter({r.doc_id: r.repeats for r in rows if r.repeats})
    assert mixing.mix_sources(spark.createDataFrame([], EXTRA)).count() == 0
    assert mixing.expand_mix(spark.createDataFrame([], EXTRA)).count() == 0
    assert mixing.mix_sources(docs(spark, [None, ""])).count() == 2


def test_repeated_rows_and_clashing_names_are_mixed_whole(spark):
    """Rows of one id and text that the end of the order cuts in two stand as often as the mix takes them."""
    rows = [(None if i < 7 else 5 if i < 12 else i, "w " * (3 if i < 12 else 1 + i % 9), "abc"[i % 3] if i >= 12 else "a", f"id{i}", i, f"h{i}", 1.5, "c") for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, _repeats int, _hash string, _copies double, c0 string")
    for weights in ((1, 2, 3), (5, 2, 1), (1, 1, 1)):
        want = Counter()
        for r in mixing.mix_sources(table, weights).collect():
            want[r.source, r.doc_id] += r.repeats
        got = mixing.expand_mix(table, weights)
        assert got.columns == table.columns
        found = got.collect()
        have = Counter()
        for r in found:
            have[r.source, r.doc_id] += 1
            assert tuple(r) in set(rows)
        assert have == +want
        each = Counter(r._repeats for r in found if r.doc_id is None)
        assert not each or max(each.values()) - min(each.get(i, 0) for i in range(7)) <= 1


# --- 6: sharding

def test_shards_move_little(spark):
    texts = [*sentences(6, 300), *ODD]
    table = docs(spark, texts, ids=[*range(305), None, None, 3, 4])
    rows = sharding.shard_documents(table, [1.0] * 10).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 10)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    moved = sum(r.grown_shard == 10 for r in rows)
    assert 5 <= moved <= 60
    by = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id < 300 and r.doc_id not in (3, 4)}
    assert all(by[i].size == len(texts[i].encode()) + 16 and by[i].text_crc32 == zlib.crc32(texts[i].encode()) for i in by)
    heavy = Counter(r.shard for r in sharding.shard_documents(table, [1.0, 3.0]).collect())
    assert 2 < heavy[1] / heavy[0] < 4.5
    assert sharding.shard_documents(spark.createDataFrame([], EXTRA), [1.0]).count() == 0


# --- 7: language

def brute_profile(texts, size):
    counts = Counter()
    for t in texts:
        t = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        for n in (1, 2, 3):
            counts.update(g for g in (t[i : i + n] for i in range(len(t) - n + 1)) if g != " ")
    order = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], order(g)))[:size]


def test_language_equals_plain_version(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = table.collect()
    learn = defaultdict(list)
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            learn[r.lang].append(r.text)
    # A joined text has no n-grams across documents but one space: the same as each padded.
    profiles = {k: {g: i for i, g in enumerate(brute_profile([" ".join(v)], 300))} for k, v in learn.items()}
    got = {r.doc_id: r for r in langid.identify(table).collect()}
    for r in rows:
        mine = brute_profile([r.text], 300)
        cost = {k: sum(abs(i - p[g]) if g in p else 300 for i, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(cost), key=cost.get)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (best, zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert got[r.doc_id].score == pytest.approx(1 - cost[best] / (300 * len(mine)))
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    out = {r.doc_id: r for r in langid.identify(docs(spark, [*sentences(8, 20), *ODD, "12 34 !?", "\u00bd \u00b2 \u2177 \u2460", "\u2167_\u0301"])).collect()}
    assert [out[i].lang_pred for i in (20, 21, 22, 29, 30, 31)] == ["und"] * 6 and out[20].score == 0.0
    assert out[23].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify(docs(spark, ["abc"] * 3, langs=[None] * 3)).collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], EXTRA)).count() == 0


# --- 8: line runs

def brute_lines(texts, least):
    places, total = [], []
    for d, t in enumerate(texts):
        lines = [(x.strip(" \t\r\v\f"), len(WORD.findall(x))) for x in (t or "").split("\n") if WORD.search(x)]
        places.append(lines)
        total += [(d, i) for i in range(len(lines))]
    gone = set()
    for b, (d2, i2) in enumerate(total):
        for d1, i1 in total[:b]:
            k = n = 0
            while i1 + k < len(places[d1]) and i2 + k < len(places[d2]) and places[d1][i1 + k] == places[d2][i2 + k]:
                n += places[d2][i2 + k][1]
                k += 1
            if n >= least:
                gone.update((d2, i2 + j) for j in range(k))
    return gone, places


@pytest.mark.parametrize("seed", range(4))
def test_line_runs_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choices("abcdefgh", k=rnd.choice([1, 1, 2, 5, 9]))) for _ in range(12)]
    texts = ["\n".join(rnd.choice([*pool, "", f"u{rnd.random()}"]) for _ in range(rnd.randint(1, 14))) for _ in range(25)]
    texts += [texts[2], "x\n" * 30, None, "", texts[4] + "\n" + texts[5]]
    gone, places = brute_lines(texts, 8)
    out = {r.doc_id: r for r in linedup.dedup_lines(docs(spark, texts), 8).collect()}
    for d, t in enumerate(texts):
        kept = [x for i, (x, _) in enumerate(places[d]) if (d, i) not in gone]
        left = None if t is None else [x.strip() for x in out[d].text.split("\n") if x.strip()]
        assert left == (None if t is None else kept)
        assert out[d].n_lines == "x"
        assert out[d].n_removed == len(places[d]) - len(kept)
        assert out[d].n_chars == (None if t is None else len(out[d].text))


def test_many_copies_over_many_ranges(spark, monkeypatch):
    """One run in most documents is cut by many ranges of the order; all copies but the first go."""
    run = "\n".join(f"common line number {i} of the run" for i in range(9))
    texts = [f"head {i} x\n{run}\ntail {i} y" for i in range(120)] + [run, run]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        out = {r.doc_id: r for r in linedup.dedup_lines(docs(spark, texts).repartition(9), 50).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [out[i].n_removed for i in range(122)] == [0] + [9] * 121
    assert out[5].text == "head 5 x\ntail 5 y" and out[0].text == texts[0] and out[121].text == ""


def test_columns_named_like_the_counts_stay(spark):
    text = "a b c d e f\ng h i"
    table = spark.createDataFrame([(1, text, 7, "x", "r"), (2, text, 8, "y", "s")], "doc_id long, text string, n_removed int, n_lines string, _runs string")
    out = linedup.dedup_lines(table, 5, ("lines_here", "lines_gone"))
    assert out.columns == [*table.columns, "lines_here", "lines_gone"]
    assert sorted(map(tuple, out.collect())) == [(1, text, 7, "x", "r", 2, 0), (2, "", 8, "y", "s", 2, 2)]
    assert linedup.dedup_lines(table, 5).columns == table.columns


def test_line_edges(spark):
    assert linedup.dedup_lines(spark.createDataFrame([], DOC), 50).count() == 0
    out = linedup.dedup_lines(docs(spark, ODD, ids=[0, 1, 2, 3, 4, None, 6, 6, 8]), 5).collect()
    assert len(out) == len(ODD) and all(r.n_removed == 0 for r in out)


# --- 9: near duplicates

def brute_near(texts, ids, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least.get(find(i))) for i in range(len(texts))]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    rnd = random.Random(9)
    texts = []
    for base in sentences(10, 25, 4000, 200):
        texts.append(base)
        for _ in range(rnd.randint(0, 8)):
            w = rnd.choice(texts[-3:]).split()
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = f"new{rnd.random()}"
            texts.append(" ".join(w))
    texts += [*ODD, "a b c", "A b C", "a b c d e", "same", texts[0]]
    ids = [*range(len(texts) - 3), 5, None, 2]
    rnd.shuffle(texts)
    got = minhash.near_duplicates(docs(spark, texts, ids=ids), percent).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_near(texts, ids, percent), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    one = minhash.keep_one(docs(spark, texts, ids=ids), percent)
    assert one.columns == [f.split()[0] for f in EXTRA.split(", ")]
    assert minhash.near_duplicates(spark.createDataFrame([], EXTRA), percent).count() == 0


def test_bitmaps_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, own = rng.integers(1, 400), rng.integers(0, 60, 2)
        pool = rng.integers(0, 1 << 63, n + own.sum(), dtype=np.uint64)
        a, b = np.concatenate([pool[:n], pool[n : n + own[0]]]), np.concatenate([pool[:n], pool[n + own[0] :]])
        differ = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in minhash.bitmap(a) ^ minhash.bitmap(b))
        assert differ <= own.sum() and (own.sum() < 40 or differ > own.sum() / 2)


def test_edited_copies_far_from_each_other(spark):
    """Copies with edits of their own: few reach the pivot, and nearly all pairs are ruled out by their bitmaps."""
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(220)]
    texts = []
    for i in range(60):
        w = list(base)
        for k in range(4 + i % 5):
            w[rnd.randrange(len(w))] = f"x{i}_{k}"
        texts += [" ".join(w)] + ([" ".join([*w, "tail"])] if i % 6 == 0 else [])
    got = minhash.near_duplicates(docs(spark, texts), 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_near(texts, list(range(len(texts))), 85))


def test_buckets_with_many_components(spark):
    """One row a band puts chains of unlike texts into the same buckets."""
    base = ("p q r s t u v w x y z " * 6).split()
    texts = [" ".join(base + [f"{i}-{j}" for j in range(i % 7 * 3)]) for i in range(40)]
    got = minhash.near_duplicates(docs(spark, texts), 80, bands=24, rows=1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_near(texts, list(range(40)), 80))


@pytest.mark.parametrize("rows", [3, 10**6])
def test_hot_keys_are_dealt_and_lose_nothing(spark, monkeypatch, rows):
    monkeypatch.setattr(skew, "HOT_ROWS", rows)
    many = materialize(spark.createDataFrame([(None if i % 9 == 0 else i % 4 if i < 60 else i, i) for i in range(80)], "k int, i int"), "many")
    one = spark.createDataFrame([(k, f"v{k}") for k in (0, 1, 2, 61, 99)], "k int, v string")
    for how in ("inner", "left"):
        assert sorted(map(repr, skew.join_many(many, one, ["k"], how).collect())) == sorted(map(repr, many.join(one, ["k"], how).collect()))
    left, right, keys = skew.pairs_within(many.dropna(), "k", "i")
    right = right.withColumnRenamed("i", "j")
    assert sorted((r.k, r.i, r.j) for r in left.join(right, keys).collect()) == sorted((r.k, r.i, r.j) for r in many.join(many.withColumnRenamed("i", "j"), "k").collect())
    texts = ["p q r s t u v w"] * 12 + [f"p q r s t u v w {i}" for i in range(9)] + sentences(3, 20, 500, 60)
    got = minhash.near_duplicates(docs(spark, texts), 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_near(texts, list(range(len(texts))), 80))
    base = ("p q r s t u v w x y z " * 6).split()
    texts = [" ".join(base + [f"{i}-{j}" for j in range(i % 7 * 3)]) for i in range(40)]
    got = minhash.near_duplicates(docs(spark, texts), 80, bands=24, rows=1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_near(texts, list(range(40)), 80))


def test_components(spark):
    rnd = random.Random(12)
    edges = [(i, i + 1) for i in range(50, 90)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(5, 9), (9, 5), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_one_row_of_each_component_stays(spark):
    """Groups of null ids lose their copies; unlike texts under one id both stay, and so do rows without words."""
    a, b, c = ("a0 a1 a2 a3 a4 a5 a6 a7 a8 a9 " * 3).split(), [f"b{i}" for i in range(30)], [f"c{i}" for i in range(60)]
    texts = [" ".join(x) for x in (b, b + ["end"], b + ["stop"], b, a, c, c + ["end"], c)] + ["", "", None]
    ids = [None, None, None, None, 7, 7, None, 3, None, None, 9]
    got = [(r.doc_id, r.text) for r in minhash.keep_one(docs(spark, texts, ids=ids), 80).collect()]
    assert sum(i is None and bool(t) for i, t in got) == 1
    assert {(7, texts[4]), (3, texts[5])} <= set(got) and (7, texts[5]) not in got
    assert got.count((None, "")) == 2 and (9, None) in got and len(got) == 6

"""Centroid clusters, token files and periodic runs against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import bisector, bytebpe, runs, tokenfile

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, _h string, part int, start string, raw int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([((i if ids is None else ids[i]), t, "h", 1, "s", 2) for i, t in enumerate(texts)], DOC)


# --- 11: centroid clusters

def brute_clusters(rows, k, rounds, salt, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]
    if not centroids:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    sums = [sum(d for d, c in at if c == n) for n in range(len(centroids))]
    return [(i, n, d, sums[n], sum(sums), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, at, strict=True)]


@pytest.mark.parametrize(("k", "grain"), [(7, 3), (12, 1), (90, 2), (1, 2)])
def test_clusters_equal_brute_force(spark, k, grain, monkeypatch):
    monkeypatch.setattr(bisector, "CHUNK_ROWS", 16)
    rnd = random.Random(k)
    # Few different components, so that many vectors lie on bisectors, and many are equal.
    rows = [(i, [rnd.randint(-grain, grain) / 128 for _ in range(4)]) for i in range(70)]
    rows += [(70, None), (71, [0.1] * 3), (72, [0.1] * 5), (73, [0.1, None, 0.2, 0.3]), (74, [float("nan")] * 4), (75, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.0, 0.0, 0.0]), (3, [0.25] * 4), (3, [0.125] * 4)]
    table = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    got = list(map(tuple, bisector.cluster_vectors(table, k, 4, "2", 4).collect()))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(got, key=key) == sorted(brute_clusters(rows, k, 4, "2", 4), key=key)


def test_cluster_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert bisector.cluster_vectors(spark.createDataFrame([], schema)).count() == 0
    assert bisector.cluster_vectors(spark.createDataFrame([(None, [0.0, 1.0])], schema), dims=2).count() == 0
    with pytest.raises(ValueError, match="bisectors"):
        bisector.cluster_vectors(spark.createDataFrame([], schema), k=100_000)
    with pytest.raises(OverflowError):
        bisector.nearest(np.array([[1 << 28]]), np.array([[0], [1]]), bisector.bisectors(np.array([[0], [1]])))


def test_a_vector_on_a_bisector_goes_to_the_smaller_number():
    centroids = np.array([[4], [0], [8], [4]])
    won, distance = bisector.nearest(np.array([[2], [6], [4], [9], [-3]]), centroids, bisector.bisectors(centroids))
    assert won.tolist() == [0, 0, 0, 2, 1] and distance.tolist() == [4, 4, 0, 1, 9]


# --- 12: token files

ODD = [
    "", None, "  \t ", "It's  I'm can't 'S", "café café ́x.", "a1b22 x_y #tag don't!", "a  b\n\n c\n\n\nd \n e\r\nf", " \n", "x   y", "<|endoftext|> a<|endoftext|>b",
    "你好。 emoji \U0001f600\U0001f600  line", "of, of. OF; of?! ... ,", "\xa0nbsp\xa0 x", "x\x1cy\x85z\x0b\x0cq", "a" * 500 + " b", "   lead", "trail   ", "\t\ttab\tx", "a​b  c", " " * 300 + "x", "Éa$$$ ÉA.%%% don' 's ''s x's. -- _", "word.\n-word, (word) word's.",
    "w" * 70 + "." + " w" * 3000,
]


def byte_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def whole(texts, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize(("block", "cache"), [(1, 1_000_000), (3000, 400), (8 << 20, 1_000_000)])
def test_encoding_by_pieces_equals_whole_texts(spark, monkeypatch, name, block, cache):
    import public_tokenizers

    monkeypatch.setattr(bytebpe, "BLOCK_BYTES", block)
    monkeypatch.setattr(bytebpe, "CACHE_PIECES", cache)
    monkeypatch.setattr(bytebpe, "_LOADED", {})
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(20 if block == 1 else 150).collect()] + ODD
    path, got = public_tokenizers.path(name), []
    for first, ids, ends in bytebpe.encode_blocks(pa.array(texts, pa.string()), path, 0):
        assert first == len(got)
        got += [part.tolist() for part in np.split(ids, ends[:-1])]
    assert got == whole(texts, path)
    assert bytebpe.encoder(path).by_chunk == (name == "byte_bpe_50k.json")


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "READ_BYTES", 2000)
    rnd = random.Random(5)
    texts = ODD + [" ".join(rnd.choices(["alpha", "beta", "gamma,", "delta."], k=rnd.randint(1, 60))) for _ in range(200)]
    ids = [rnd.choice([None, 7, *range(-50, 50)]) for _ in texts]
    files = tokenfile.write_token_files(docs(spark, texts, ids).repartition(4), byte_path())
    got = files.read(ids=True).collect()
    coded = whole(texts, byte_path())
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), c) for i, c in zip(ids, coded, strict=True))
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == sorted((i is not None, i or 0) for i in ids)
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows)
    thin = files.read()
    assert thin.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and thin.count() == len(texts)
    again = tokenfile.open_token_files(spark, files.folder, files.manifest.drop("start"))
    assert sorted(map(repr, again.read().collect())) == sorted(map(repr, thin.collect()))


def test_one_document_is_read_by_its_place_and_damage_is_told(tmp_path):
    samples = [np.arange(i, i + 40, dtype="<u2").tobytes() for i in range(0, 4000, 3)]
    dictionary = tokenfile.train_dictionary(samples, 4096)
    assert 0 < len(dictionary) <= 4096
    path = str(tmp_path / "x.ids")
    writer = tokenfile.FileWriter(path, dictionary, 2)
    rows = [np.arange(i, i + 30, dtype="<u4") for i in range(100)] + [np.array([0], dtype="<u4")]
    for part in (rows[:60], rows[60:]):
        writer.add(list(range(len(part))), np.concatenate(part), np.cumsum([len(r) for r in part]))
    n, n_ids, size = writer.close()
    raw = (tmp_path / "x.ids").read_bytes()
    assert (n, n_ids, size) == (101, 3001, len(raw))
    reader = tokenfile.FileReader(path, dictionary)
    assert all(reader.ids(i).tolist() == rows[i].tolist() for i in (100, 0, 59, 60, 99))
    assert reader.index["stop"][100] - reader.starts[100] < 40
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfile.FileReader(path, dictionary + b"x")
    for cut in (raw[:-5], raw[:40], raw[:-60]):
        (tmp_path / "x.ids").write_bytes(cut)
        with pytest.raises(ValueError, match="cut short|no whole token file"):
            tokenfile.FileReader(path, dictionary)


def test_orphans_of_lost_tasks_are_not_read(spark):
    files = tokenfile.write_token_files(docs(spark, ["a b", "c"]), byte_path())
    system, at = tokenfile.open_folder(files.folder)
    with system.open_output_stream(f"{at}/part-000000-lost.ids") as out:
        out.write(b"half a file")
    assert files.read().count() == 2
    empty = tokenfile.write_token_files(docs(spark, []), byte_path())
    assert empty.dictionary == b"" and empty.read().count() == 0


def test_few_samples_are_the_dictionary():
    assert tokenfile.train_dictionary([]) == b"" and tokenfile.train_dictionary([b"abc"], 100) == b"abc"


# --- 13: periodic runs

def brute_runs(words, least=6, repeats=4):
    found, n = {}, len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = j + 1 if j == i else j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "repeats"), [(6, 4), (2, 2), (5, 3), (1, 4), (9, 2)])
def test_runs_equal_brute_force(least, repeats, monkeypatch):
    monkeypatch.setattr(runs, "TEST_ROWS", 37)
    rnd = random.Random(least)
    for _ in range(60):
        sequences = []
        for _ in range(rnd.randint(0, 6)):
            n, k = rnd.randint(0, 80), rnd.randint(1, 4)
            s = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a, p = rnd.randrange(n), rnd.randint(1, 9)
                s = [s[i] if i < a else s[min(n - 1, a + (i - a) % p)] for i in range(n)]
            sequences.append(np.array(s, dtype=np.int64))
        got = [[tuple(r) for r in x.tolist()] for x in runs.runs_of(sequences, least, repeats)]
        assert got == [brute_runs(s.tolist(), least, repeats) for s in sequences]


def test_suffix_array_and_prefixes():
    rnd = random.Random(2)
    sequences = [[rnd.randrange(2) for _ in range(n)] for n in (40, 1, 23)] + [[0] * 17]
    flat, sizes = np.concatenate(sequences), np.array([len(s) for s in sequences])
    array = runs.SuffixArray(flat, np.cumsum(sizes) - sizes)
    array.enhance()
    suffixes = sorted((n, s[i:], i) for n, s in enumerate(sequences) for i in range(len(s)))
    assert array.suffix.tolist() == [int((np.cumsum(sizes) - sizes)[n]) + i for n, _, i in suffixes]
    for j in range(1, len(suffixes)):
        (n, a, _), (m, b, _) = suffixes[j - 1 : j + 1]
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) if n == m else 0
        assert array.lcp[j] == same


def brute_answer(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    s, size, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(found), s, size, q, 1000 * size // q if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_documents_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    texts = ["", None, " \n\t ", "one", "na na na na na na", "Na na na na na na", "a b a b a b a b", "x\xa0y " * 9, "q\x0bq\x0cq q\tq\rq", "ab cd " * 3000]
    texts += [" ".join(rnd.choices(["a", "b", "c"][: rnd.randint(1, 3)], k=rnd.randint(1, 90))) for _ in range(150)]
    ids = [None, *range(1, len(texts))]
    ids[-1] = ids[-2]
    monkeypatch.setattr(runs, "BLOCK_WORDS", 200)
    got = runs.periodic_runs(docs(spark, texts, ids), plant=True).collect()
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted((brute_answer(i, t) for i, t in zip(ids, texts, strict=True)), key=key)
    assert runs.periodic_runs(docs(spark, [])).count() == 0

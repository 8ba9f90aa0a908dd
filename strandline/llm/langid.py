"""Language identification by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, prepare

#: Characters handled at once.
BLOCK = 1 << 19
#: Numerals such as superscripts, Roman and circled ones are no letters.
_OTHER = regex.compile(r"\P{L}+")
#: Bits of a character's code point, and of an n-gram (at most 3 characters).
CHAR_BITS, GRAM_BITS = 21, 63


def letters(text: str) -> str:
    """Lower case, with every stretch of characters that are not letters made one space, padded."""
    return " " + _OTHER.sub(" ", text.lower()).strip() + " "


def grams(text: str, orders: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text's letters as numbers, and their counts; a lone space is none, nor has a text without letters any."""
    padded = letters(text)
    if padded.isspace():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer(padded.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    out = []
    for n in orders:
        if len(code) < n:
            continue
        key = code[: len(code) - n + 1].copy()
        for i in range(1, n):
            key = (key << CHAR_BITS) | code[i : len(code) - n + 1 + i]
        if n == 1:
            key = key[key != 32]
        out.append(key)
    return np.unique(np.concatenate(out), return_counts=True) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def top_ranks(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, ties to the smaller number, best first."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        keys, counts = keys[near], counts[near]
    return keys[np.lexsort((keys, -counts))][:size]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n: n-gram counts of texts by language, summed in each task before the shuffle."""

    def run(batches):
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text or "")
            for lang, texts in by.items():
                joined = [" ".join(texts[i:j]) for i, j in _spans(texts)]
                for text in joined:
                    keys, counts = grams(text)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _spans(texts: list[str]):
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def learn_profiles(docs: DataFrame, size: int = 300) -> DataFrame:
    """(lang, gram, place): each language's `size` most frequent n-grams, best first (place from 0).

    All texts of `docs` with a language count, whole.
    """
    known = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return gram_counts(known).withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < size).select("lang", "gram", "place")


def classify(docs: DataFrame, profiles: DataFrame, size: int = 300, max_languages: int = 1000) -> DataFrame:
    """Adds lang_pred and score to the columns of `docs`.

    A document's `size` most frequent n-grams are held against each profile: an n-gram costs the
    distance of its two places, or `size` if the profile lacks it; the least sum wins, ties to the
    language first by code point. score is 1 - sum / (size * n-grams). A text that is null or has no
    letter gets `und` and 0, as does every text when no profile was learnt. The profiles sent to the
    tasks are at most `max_languages * size` rows; more languages raise an error.
    """
    prepare(docs.sparkSession)
    table = profiles.limit(max_languages * size + 1).toPandas()
    if len(table) > max_languages * size:
        raise ValueError(f"more than {max_languages} languages")
    langs = sorted(set(table["lang"]))
    known = np.unique(table["gram"].to_numpy(dtype=np.int64))
    places = np.full((len(langs), len(known) + 1), -1, dtype=np.int64)
    places[table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64), np.searchsorted(known, table["gram"].to_numpy(dtype=np.int64))] = table["place"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((langs, known, places))
    names = docs.columns
    renamed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col("text").cast("string").alias("_text"))

    def one(text: str | None) -> tuple[str, float]:
        langs, known, places = shared.value
        if not text or not langs:
            return "und", 0.0
        keys, counts = grams(text)
        if not len(keys):
            return "und", 0.0
        top = top_ranks(keys, counts, size)
        at = np.minimum(np.searchsorted(known, top), max(len(known) - 1, 0))
        at = np.where(known[at] == top, at, len(known))
        found = places[:, at]
        cost = np.where(found < 0, size, np.abs(found - np.arange(len(top)))).sum(axis=1)
        best = int(cost.argmin())
        return langs[best], max(0.0, 1.0 - float(cost[best]) / (size * len(top)))

    def run(batches):
        for batch in batches:
            got = [one(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    schema = renamed.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    out = renamed.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in ("lang_pred", "score")], "lang_pred", "score")


def held_out(key: Column, modulus: int = 5) -> Column:
    """True for the documents kept from learning: crc32 of the id as text is divisible by `modulus`."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == 0, F.lit(False))


def identify(docs: DataFrame, size: int = 300, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every text; profiles come from those not held out.

    A null doc_id is not held out. Repeated rows count, and are answered, once each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out(F.col("doc_id"), modulus).alias("held_out"))
    profiles = materialize(learn_profiles(rows.where(~F.col("held_out")), size), "profiles")
    return classify(rows.select("doc_id", "held_out", "text"), profiles, size).select("doc_id", "held_out", "lang_pred", "score")

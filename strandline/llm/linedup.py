"""Repeated line runs by prefix doubling over line-ID sequences; later copies are deleted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, prepare
from .skew import join_many, parts_of
from .words import text_bytes

LINES = "doc_id long, d long, pos int, h1 long, h2 long, ahead int, back int"


def _worded(text: bytes) -> list[tuple[int, bytes, int]]:
    """(index, stripped line, words) of the \\n-split lines that hold a word."""
    return [(i, line.strip(), n) for i, line in enumerate(text.split(b"\n")) if (n := len(line.split()))]


def shortest_runs(words: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, how many lines from it (ahead) and up to it (back) first hold `least` words; 0: none."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    at = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least, side="left")
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    return np.where(end <= n, end - at, 0), np.where(start >= 0, at + 1 - start, 0)


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per line with a word: its text as a 128-bit hash, its place, its shortest runs."""
    fields = [("doc_id", pa.int64()), ("d", pa.int64()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("ahead", pa.int32()), ("back", pa.int32())]

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in fields]
            for doc_id, d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                lines = _worded(text)
                if not lines:
                    continue
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(line) for _, line, _ in lines), dtype=">i8").reshape(-1, 2).astype(np.int64)
                ahead, back = shortest_runs([n for _, _, n in lines], min_words)
                for col, value in zip(cols, ([doc_id] * len(lines), [d] * len(lines), range(len(lines)), both[:, 0].tolist(), both[:, 1].tolist(), ahead.tolist(), back.tolist()), strict=True):
                    col.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    return docs.mapInArrow(run, LINES)


def ranked(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """(d, pos, r): suffixes whose `keys` occur at least twice, ranked by them.

    Distinct keys are sorted by range over all tasks and numbered in that order (with gaps between
    tasks), so ranks compare as the prefixes do: this is a suffix array's rank step.
    """
    seen = suffixes.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    order = materialize(seen.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("r", F.monotonically_increasing_id()), "order")
    # A line may stand in a third of all documents.
    out = materialize(join_many(suffixes, order.drop("_n"), keys, hot=parts_of(order, keys, "_n")).select("d", "pos", "r"), "rank")
    discard(order)
    return out


def repeated_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(d, start, length): line runs of at least `min_words` words that occur earlier as well.

    Earlier is by doc_id (null last), then text hash, then line. `lines` is from `line_table`.

    Ranks of prefixes of 1, 2, 4, ... lines are doubled until they cover the longest shortest run
    (at most `min_words` lines, as every line has a word); only suffixes that share their prefix with
    another stay in. Suffixes that share the prefix in which they first reach `min_words` words are
    one interval of common prefixes, neighbours in the order of two overlapping ranks (`later_members`): its earliest member stays and
    the others are copies. A maximal run is the union of such shortest runs from its lines and up to
    its lines, so deleting those deletes it whole, whatever its length.
    """
    wide = max(1, min_words)
    starts = lines.where("ahead > 0").select("d", "doc_id", F.col("pos").alias("s"), F.col("ahead").alias("e"))
    ends = lines.where("back > 0").select("d", "doc_id", (F.col("pos") - F.col("back") + 1).alias("s"), F.col("back").alias("e"))
    windows = starts.unionByName(ends)
    level = ranked(lines.select("d", "pos", "h1", "h2"), ["h1", "h2"])
    copies, k = [], 1
    while True:
        here = windows.where((F.col("e") >= k) & (F.col("e") < 2 * k))
        one = level.select("d", F.col("pos").alias("s"), F.col("r").alias("ra"))
        two = level.select("d", (F.col("pos") + k).alias("t"), F.col("r").alias("rb"))
        named = here.join(one, ["d", "s"]).withColumn("t", F.col("s") + F.col("e")).join(two, ["d", "t"]).select("d", "doc_id", "s", "e", "ra", "rb").distinct()
        # Stored level by level: one plan over all levels would be planned anew after each of its many shuffles.
        copies.append(materialize(named, "named"))
        k *= 2
        if k > wide:
            break
        shifted = level.select("d", (F.col("pos") - k // 2).cast("int").alias("pos"), F.col("r").alias("r2"))
        after = ranked(level.withColumnRenamed("r", "r1").join(shifted, ["d", "pos"]), ["r1", "r2"])
        discard(level)
        level = after
        if level.isEmpty():
            break
    found = copies[0]
    for more in copies[1:]:
        found = found.unionByName(more)
    out = later_members(found.withColumn("o", F.coalesce("doc_id", F.lit((1 << 63) - 1))))
    discard(level, *copies)
    return out


def later_members(found: DataFrame) -> DataFrame:
    """(d, start, length): of windows (e, ra, rb, o, d, s), all but the first of each interval.

    The windows are put in the order of their length and suffix ranks, and within equal ranks of the corpus, by ranges
    over all tasks. Neighbours of equal length and ranks have a common prefix of at least that length, so a stretch of
    them is one interval of common prefixes, and every member that has such a neighbour before it is a later copy. A task
    compares the rows of its range in turn; whether its first row goes on with the range before is settled by a table of
    each range's ends.
    """
    order = ["e", "ra", "rb", "o", "d", "s"]
    names = ["part", "kind", "e", "ra", "rb", "d", "s"]

    def run(batches):
        part = TaskContext.get().partitionId()
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            e, ra, rb, d, s = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("e", "ra", "rb", "d", "s"))
            same = np.append(last == (e[0], ra[0], rb[0]), (e[1:] == e[:-1]) & (ra[1:] == ra[:-1]) & (rb[1:] == rb[:-1]))
            # Kinds: 0 a later copy, 1 a range's first row, 2 its last.
            at = np.flatnonzero(same)
            kind = np.zeros(len(at), dtype=np.int32)
            if last is None:
                at, kind = np.append(at, 0), np.append(kind, 1)
            last = (e[-1], ra[-1], rb[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part), pa.int32()), pa.array(kind, pa.int32()), *[pa.array(c[at]) for c in (e, ra, rb, d, s)]], names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([2], pa.int32()), *[pa.array([x], t) for x, t in zip((*last, 0, 0), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]], names=names)

    ranged = found.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    compared = materialize(ranged.mapInArrow(run, "part int, kind int, e int, ra long, rb long, d long, s int"), "intervals")
    # A row or two for each range.
    before = Window.orderBy("part", "kind")
    ends = compared.where("kind > 0").select("*", *[F.lag(c).over(before).alias(f"_{c}") for c in ("e", "ra", "rb")])
    going_on = ends.where("kind = 1 AND e = _e AND ra = _ra AND rb = _rb")
    return compared.where("kind = 0").select("d", F.col("s").alias("start"), F.col("e").alias("length")).unionByName(going_on.select("d", F.col("s").alias("start"), F.col("e").alias("length")))


def dedup_lines(docs: DataFrame, min_words: int = 50, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """Every column of `docs`, with later copies of long line runs deleted from `text`, and the two columns that
    `counts` names: lines with a word, and how many of them went. If `docs` has a column of such a name, that one is
    kept as it is and the count left out.

    A run of lines, one or more, is deleted where it holds at least `min_words` words and the same lines
    (white space at their ends aside) stand earlier in the corpus. Lines without a word go when the
    worded lines on both sides do. A null text stays null and an empty one empty; n_chars, if there
    is such a column, follows the text. Rows equal in doc_id and text count as one document and are
    treated alike. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    own = [F.col(c).alias(f"_c{i}") for i, c in enumerate(names) if c != "text"]
    keyed = docs.select(*own, F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).withColumn("_d", F.xxhash64("_id", "_text"))
    lines = materialize(line_table(keyed.select("_id", "_d", "_text"), min_words).dropDuplicates(["d", "pos"]), "lines")
    gone = repeated_runs(lines, min_words).groupBy("d").agg(F.collect_set(F.struct("start", "length")).alias("_runs"))
    totals = lines.groupBy("d").agg(F.count("*").alias("_lines"))
    per_doc = materialize(totals.join(gone, "d", "left").select(F.col("d").alias("_d"), "_lines", "_runs"), "runs")
    discard(lines)
    joined = keyed.join(per_doc, "_d", "left")

    def cut(text: bytes, runs) -> tuple[bytes, int]:
        worded = [i for i, _, _ in _worded(text)]
        drop = np.zeros(len(worded) + 1, dtype=np.int64)
        for run in runs:
            drop[run["start"]] += 1
            drop[run["start"] + run["length"]] -= 1
        drop = np.cumsum(drop)[:-1] > 0
        lines = text.split(b"\n")
        left, at = [], 0
        for i, line in enumerate(lines):
            here = at < len(worded) and worded[at] == i
            before = at > 0 and drop[at - 1]
            after = at >= len(worded) or drop[at]
            if not (drop[at] if here else before and after):
                left.append(line)
            at += here
        return b"\n".join(left), int(drop.sum())

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            runs = batch.column(batch.schema.get_field_index("_runs")).to_pylist()
            new, removed = [], []
            for text, cuts in zip(texts.cast(pa.large_binary()).to_pylist(), runs, strict=True):
                got = cut(text, cuts) if cuts else (text, 0)
                new.append(got[0])
                removed.append(got[1])
            rest = [(f.name, c) for f, c in zip(batch.schema, batch.columns, strict=True) if f.name not in ("_text", "_runs")]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(new, pa.large_binary()).cast(pa.large_string()).cast(pa.string()), pa.array(removed, pa.int64())], names=[*[n for n, _ in rest], "_text", "_removed"])

    thin = joined.select(*[f"_c{i}" for i, c in enumerate(names) if c != "text"], F.coalesce("_lines", F.lit(0)).alias("_n"), "_text", "_runs")
    schema = thin.drop("_text", "_runs").schema.add("_text", "string").add("_removed", "long")
    out = thin.mapInArrow(run, schema)
    columns = [F.col("_text").alias("text") if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_c{i}").alias(c) for i, c in enumerate(names)]
    values = zip(counts, (F.col("_n"), F.col("_removed")), strict=True)
    return out.select(*columns, *[value.alias(c) for c, value in values if c not in names])

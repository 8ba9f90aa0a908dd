"""Exact top-k search by block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, prepare

#: Rows of a block, blocks of a group, queries of a set, blocks whose bounds a task looks at together.
BLOCK_ROWS, GROUP_BLOCKS, QUERY_ROWS, CHUNK_BLOCKS = 256, 32, 256, 1024
#: A block's name: a range of ids, a part of a crowded range, the vectors' length, a number.
GROUP = ["area", "part", "width"]
BLOCK = [*GROUP, "block"]
BLOCKS = "area long, part long, width int, block int, rows array<long>, ids array<long>, flat array<long>, high array<long>, low array<long>"


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array of long): floor(scale * x) of each component as double.

    Vectors that are null or empty, or hold a null or non-finite component, are left out, as are null ids.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # Filtered inside the expression as well: Spark may evaluate a projection before its filter.
    floors = F.when(sound, F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), floors.alias("v")).where(F.col("v").isNotNull())


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    """A column of lists of one length as the rows of a matrix."""
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _as_numbers(*parts: np.ndarray, width: int) -> list[np.ndarray]:
    """Matrices, queries first, as doubles if all their inner products are whole numbers in these, else as longs."""
    most = float(np.abs(parts[0]).max(initial=0)) * max(float(np.abs(p).max(initial=0)) for p in parts[1:]) * width
    if most >= 2**63:
        raise OverflowError("inner products beyond 64 bits")
    return [p.astype(np.float64 if most < 2**53 else np.int64) for p in parts]


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(queries, blocks): what no inner product with a row of the block exceeds, from its term maxima and minima."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def block_table(rows: DataFrame) -> DataFrame:
    """Rows (row, vec_id, v, width) as blocks: the ids and vectors of at most BLOCK_ROWS rows of neighbouring ids, and
    the largest and least value of each component."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        ids, numbers, v = table.column("vec_id").to_numpy()[order], table.column("row").to_numpy()[order], _matrix(table, "v")[order]
        starts = np.arange(0, len(ids), BLOCK_ROWS)
        high, low = np.maximum.reduceat(v, starts, axis=0), np.minimum.reduceat(v, starts, axis=0)
        cut = lambda x: np.split(x, starts[1:])
        names = [pa.array([k.as_py()] * len(starts)) for k in key]
        lists = (cut(numbers), cut(ids), [x.ravel() for x in cut(v)], list(high), list(low))
        schema = pa.schema([("area", pa.int64()), ("part", pa.int64()), ("width", pa.int32()), ("block", pa.int32()), *[(n, pa.list_(pa.int64())) for n in ("rows", "ids", "flat", "high", "low")]])
        return pa.table([*names, pa.array(range(len(starts)), pa.int32()), *[pa.array(x, pa.list_(pa.int64())) for x in lists]], names=schema.names).cast(schema)

    n_rows, first, last = rows.agg(F.count("*"), F.min("vec_id"), F.max("vec_id")).first()
    # Ranges of ids make the blocks document ranges; a crowded range is cut again by a hash of the row.
    groups = max(1, -(-n_rows // (BLOCK_ROWS * GROUP_BLOCKS)))
    span = max(1, -(-((last or 0) - (first or 0) + 1) // groups))
    area = F.floor((F.col("vec_id") - F.lit(first or 0)) / F.lit(span)).cast("long")
    crowd = rows.groupBy(area.alias("area")).agg(F.ceil(F.count("*") / (2 * BLOCK_ROWS * GROUP_BLOCKS)).cast("long").alias("parts"))
    placed = rows.withColumn("area", area).join(crowd, "area").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    return placed.groupBy(*GROUP).applyInArrow(run, BLOCKS)


def search_group(queries: np.ndarray, own: np.ndarray, seeds: np.ndarray, blocks: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score) candidates of some blocks: each query's best k in them that reach its seed.

    For each query the blocks are taken in order of falling bound until a bound lies below the seed or the kth score
    so far.
    """
    flat, width = blocks.column("flat").to_pylist(), queries.shape[1]
    ids, rows = blocks.column("ids").to_pylist(), blocks.column("rows").to_pylist()
    queries, high, low = _as_numbers(queries, _matrix(blocks, "high"), _matrix(blocks, "low"), width=width)
    kind = queries.dtype
    limit = bounds(queries, high, low)
    by_bound = np.argsort(-limit, axis=1, kind="stable")
    least = -np.inf if kind == np.float64 else np.iinfo(np.int64).min
    best_score = np.full((len(queries), k), least, dtype=kind)
    best_id = np.full((len(queries), k), -1, dtype=np.int64)
    have = np.zeros(len(queries), dtype=np.int64)
    floor = np.where(seeds == np.iinfo(np.int64).min, least, seeds).astype(kind)
    live = np.arange(len(queries))
    for step in range(len(ids)):
        here = by_bound[live, step]
        live = live[limit[live, here] >= np.maximum(floor[live], best_score[live, k - 1])]
        if not len(live):
            break
        here = by_bound[live, step]
        for block in np.unique(here):
            mine = live[here == block]
            who_here, row_here = np.array(ids[block], dtype=np.int64), np.array(rows[block], dtype=np.int64)
            scores = queries[mine] @ np.array(flat[block], dtype=kind).reshape(-1, width).T
            blank = (own[mine][:, None] == row_here[None, :]) | (scores < floor[mine][:, None])
            every = np.concatenate([best_score[mine], scores], axis=1)
            who = np.concatenate([best_id[mine], np.broadcast_to(who_here, scores.shape)], axis=1)
            blank = np.concatenate([np.arange(k)[None, :] >= have[mine][:, None], blank], axis=1)
            # Sorted by score, then id; blanks (unused places, the query itself, what is below the seed) last.
            rank = np.lexsort((who, -every, blank), axis=1)[:, :k]
            have[mine] = np.minimum(k, (~np.take_along_axis(blank, rank, 1)).sum(axis=1))
            free = np.arange(k)[None, :] >= have[mine][:, None]
            best_score[mine], best_id[mine] = np.where(free, least, np.take_along_axis(every, rank, 1)), np.take_along_axis(who, rank, 1)
    used = np.arange(k)[None, :] < have[:, None]
    return np.broadcast_to(np.arange(len(queries))[:, None], best_id.shape)[used], best_id[used], best_score[used].astype(np.int64)


def _against_bounds(sets: DataFrame, limits: DataFrame, chunks: int, n_sets: int, run, schema: str) -> DataFrame:
    """`run` over every set of queries with every chunk of blocks' maxima and minima."""
    left = sets.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    right = limits.withColumn("chunk", F.pmod(F.xxhash64(*BLOCK), F.lit(chunks))).withColumn("set", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sets - 1).cast("long"))))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    keys = ["set", "chunk", "width"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows by integer inner product.

    Both tables have row (a number of its own for each row), vec_id and v (see `integer_vectors`); a query's own row is
    no candidate, ties go to the smaller vec_id, and only vectors of the query's length are compared. A query with fewer
    candidates gets them all. Rows of one vec_id are candidates, and queries, each by itself. Inner products
    beyond 64 bits raise an error. An empty table gives no rows.

    Rows become blocks of BLOCK_ROWS neighbours, a row of a table each, with their term maxima and minima. Sets of
    queries first meet these bounds alone: each query scores the block of its highest bound, whose kth score is
    its seed. Then only those blocks go to a set of queries of which one has a bound that reaches its seed; within a
    group of them a query takes blocks in order of falling bound until bounds fall below its kth score.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select("row", "vec_id", "v", F.size("v").alias("width"))
    blocks = materialize(block_table(rows), "blocks")
    n_blocks, asked = blocks.count(), queries.count()
    if not n_blocks or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chunks, n_sets = -(-n_blocks // CHUNK_BLOCKS), -(-asked // QUERY_ROWS)
    sets = queries.select(F.pmod(F.xxhash64("row"), F.lit(n_sets)).alias("set"), F.col("row").alias("q"), F.col("vec_id").alias("query_id"), "v", F.size("v").alias("width"))
    limits = blocks.select(*BLOCK, "high", "low")
    keyed = lambda t, at: [t.column(n).take(pa.array(at)) for n in BLOCK]
    empty = np.empty(0, np.int64)

    def best_block(one: pa.Table, two: pa.Table) -> pa.Table:
        at, bound = empty, empty
        if one.num_rows and two.num_rows:
            q, high, low = _as_numbers(_matrix(one, "v"), _matrix(two, "high"), _matrix(two, "low"), width=one.column("width")[0].as_py())
            limit = bounds(q, high, low)
            at = limit.argmax(axis=1)
            bound = limit[np.arange(len(q)), at].astype(np.int64)
        q = one.column("q").combine_chunks() if len(at) else pa.array([], pa.int64())
        return pa.table([q, *keyed(two, at), pa.array(bound, pa.int64())], names=["q", *BLOCK, "bound"])

    best = _against_bounds(sets, limits, chunks, n_sets, best_block, "q long, area long, part long, width int, block int, bound long")
    best = best.groupBy("q").agg(F.max(F.struct("bound", *BLOCK)).alias("b")).select("q", *[F.col(f"b.{c}").alias(c) for c in BLOCK])
    best = materialize(best.join(sets.select("q", "set", "v"), "q"), "best")

    def first_scores(one: pa.Table, two: pa.Table) -> pa.Table:
        q, seed = one.column("q").to_numpy(), np.full(one.num_rows, np.iinfo(np.int64).min)
        if one.num_rows and two.num_rows:
            number, _, score = search_group(_matrix(one, "v"), q, seed, two, k)
            full = np.bincount(number, minlength=len(q)) == k
            kth = np.full(len(q), np.iinfo(np.int64).max)
            np.minimum.at(kth, number, score)
            seed = np.where(full, kth, seed)
        return pa.table({"q": pa.array(q, pa.int64()), "seed": pa.array(seed, pa.int64())})

    there = [*BLOCK, "set"]
    named = lambda frame: frame.select(*[F.col(c).alias(c) for c in frame.columns])
    seeds = best.groupBy(*there).cogroup(named(blocks.join(best.select(*there).distinct(), BLOCK)).groupBy(*there)).applyInArrow(first_scores, "q long, seed long")
    sets = materialize(sets.join(seeds, "q", "left").withColumn("seed", F.coalesce("seed", F.lit(-(1 << 63)))), "sets")
    discard(best)

    def live_blocks(one: pa.Table, two: pa.Table) -> pa.Table:
        at = empty
        if one.num_rows and two.num_rows:
            q, high, low = _as_numbers(_matrix(one, "v"), _matrix(two, "high"), _matrix(two, "low"), width=one.column("width")[0].as_py())
            at = np.flatnonzero((bounds(q, high, low) >= one.column("seed").to_numpy()[:, None]).any(axis=0))
        return pa.table([pa.array([one.column("set")[0].as_py()] * len(at), pa.int64()), *keyed(two, at)], names=["set", *BLOCK])

    live = materialize(_against_bounds(sets, limits, chunks, n_sets, live_blocks, "set long, area long, part long, width int, block int"), "live")

    def search(one: pa.Table, two: pa.Table) -> pa.Table:
        got = (empty, empty, empty)
        if one.num_rows and two.num_rows:
            got = search_group(_matrix(one, "v"), one.column("q").to_numpy(), one.column("seed").to_numpy(), two, k)
        who = [one.column(n).take(pa.array(got[0])) for n in ("q", "query_id")]
        return pa.table([*who, pa.array(got[1], pa.int64()), pa.array(got[2], pa.int64())], names=["q", "query_id", "vec_id", "score"])

    keys = ["set", *GROUP]
    left = sets.join(live.select(*keys).distinct(), ["set", "width"])
    right = named(blocks.join(live, BLOCK))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_embeddings(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The rows whose vec_id is divisible by `every` against all rows; each row is a query and a candidate by itself."""
    rows = materialize(integer_vectors(embeddings).withColumn("row", F.monotonically_increasing_id()), "vectors")
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

"""Centroid clustering: every vector finds its nearest centroid in a tournament of bisector tests."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, prepare

#: Rows a task tests together; what the bisectors of all pairs may take in a worker.
CHUNK_ROWS, PAIR_BYTES = 4096, 256 << 20
#: Squared distances of components up to this stay below 2^63 for vectors of up to 127 components.
LARGEST = 1 << 27


def integer_vectors(embeddings: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, v (array of long): floor(scale * x) of each component as double, of the vectors with exactly `dims`
    components, none null or non-finite. Null ids stay."""
    x = F.col("embedding").cast("array<double>")
    sound = x.isNotNull() & (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # Inside the expression as well: Spark may evaluate a projection before its filter.
    floors = F.when(sound, F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), floors.alias("v")).where(F.col("v").isNotNull())


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors of the k smallest sha256 of `salt:vec_id`, in that order; equal ids go by their components. A null id
    has no hash and is never one."""
    hashed = vectors.where(F.col("vec_id").isNotNull()).withColumn("_h", F.sha2(F.concat_ws(":", F.lit(salt), F.col("vec_id").cast("string")), 256))
    return np.array([r.v for r in hashed.orderBy("_h", "v").limit(k).collect()], dtype=np.int64)


def bisectors(centroids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each challenger j, the normals 2(c_j - c_i) and thresholds |c_j|² - |c_i|² of its bisectors with all i < j:
    x is strictly nearer to c_j exactly where normal · x - threshold is positive."""
    square = (centroids * centroids).sum(axis=1)
    pairs = range(len(centroids))
    return [2 * (centroids[j] - centroids[:j]) for j in pairs], [square[j] - square[:j] for j in pairs]


def nearest(x: np.ndarray, centroids: np.ndarray, tests: tuple[list[np.ndarray], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, ties to the smaller number.

    Each row holds a champion, first centroid 0, and every other centroid in turn challenges it: one sign test on which
    side of their bisector the row lies. The loser is out for good, so k - 1 tests leave the nearest; a row on the
    bisector stays with the champion, whose number is smaller. Only the winner's distance is worked out.
    """
    if np.abs(x).max(initial=0) > LARGEST or np.abs(centroids).max(initial=0) > LARGEST:
        raise OverflowError("components beyond 2^27 after scaling")
    won, distance = np.zeros(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    normals, thresholds = tests
    for at in range(0, len(x), CHUNK_ROWS):
        rows, champion = x[at : at + CHUNK_ROWS], won[at : at + CHUNK_ROWS]
        for j in range(1, len(centroids)):
            side = np.einsum("ij,ij->i", rows, normals[j][champion]) - thresholds[j][champion]
            champion[side > 0] = j
        gap = rows - centroids[champion]
        distance[at : at + CHUNK_ROWS] = np.einsum("ij,ij->i", gap, gap)
    return won, distance


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moved_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each non-empty centroid becomes the floor of its vectors' mean, component by component, exactly.

    Tasks sum what they assign, at most k rows each; Spark adds these up, so k * dims sums come to the driver.
    """
    k, dims = centroids.shape

    def run(batches):
        tests, total, n = bisectors(centroids), np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                won, _ = nearest(x, centroids, tests)
                order = np.argsort(won, kind="stable")
                first = np.flatnonzero(np.diff(won[order], prepend=-1))
                total[won[order[first]]] += np.add.reduceat(x[order], first, axis=0)
                n += np.bincount(won, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    out = centroids.copy()
    for r in cells.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(19,0)")).alias("s"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    return out


def cluster_vectors(embeddings: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", dims: int = 64) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: a row for each vector kept.

    Lloyd's rounds over integer vectors (see `integer_vectors`) from the k first by hash; then the vectors are assigned
    once more. Fewer than k vectors with an id make as many centroids; an empty centroid stays where it is. Rows of one
    vec_id are vectors each by itself; a null id is clustered but never a first centroid. Vectors that are not kept have
    no row, and without a first centroid there are no rows. Components beyond 2^27 after scaling raise OverflowError.

    Every round reads the stored vectors once and shuffles only sums. What the driver holds, and each task gets, is k
    centroids; each task precomputes the bisectors of their pairs, which `PAIR_BYTES` bounds.
    """
    spark = prepare(embeddings.sparkSession)
    if k * (k - 1) // 2 * (dims + 1) * 8 > PAIR_BYTES or dims > 127:
        raise ValueError("bisectors of all pairs would not fit into a worker")
    vectors = materialize(integer_vectors(embeddings, dims), "vectors")
    centroids = first_centroids(vectors, k, salt)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved_centroids(vectors, centroids)

    def run(batches):
        tests = bisectors(centroids)
        for batch in batches:
            if batch.num_rows:
                won, distance = nearest(_matrix(batch.column(1)), centroids, tests)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(won, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = materialize(vectors.select("vec_id", "v").mapInArrow(run, schema), "assigned")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(c, s, sum(sums.values()), digest[c]) for c, s in sums.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 40, rounds: int = 5, salt: str = "2", dims: int = 64) -> str:
    """The same clustering in DuckDB's SQL, by plain distances to all centroids."""
    ctes = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS k, v AS c
  FROM v WHERE vec_id IS NOT NULL QUALIFY k < {k})""",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, k, d
  FROM (SELECT r, vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c
  FROM c{i} LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY p) AS m
    FROM (SELECT k, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range({dims})) AS p FROM a{i}) GROUP BY k, p)
    GROUP BY k) USING (k))""")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""

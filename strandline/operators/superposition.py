"""Superposed models: RMSD from summed moments, TM and GDT by a search over fragments that many tasks share."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Distances of the global distance test.
CUTOFFS = (1.0, 2.0, 4.0, 8.0)
ROUNDS = 20
#: Distances a task works out for its share of a model's fragments (times ROUNDS), and a model's shares at most, as each gets all its points.
SHARE, SHARES = 50_000_000, 16
#: Fits measured together, and distances held at a time.
SEEDS, TOGETHER = 64, 1 << 15
#: A score this near to the highest there can be is taken for it: the distances are no more exact.
ROUNDING = 1e-12
AXES = "xyz"


def scale_of(length: int) -> float:
    """The distance at which a residue of a chain of this length counts half."""
    return 0.3 if length <= 1 else max(0.6 * float(np.sqrt(max(length - 0.5, 0.0))) - 2.5, 0.3)


def fragments(n: int) -> np.ndarray:
    """(start, size) of the fragments that fits start from: the whole, halves of it, down to 4 residues, each half over the last."""
    out, size = [], n
    while size >= 4:
        out += [(start, size) for start in range(0, n - size + 1, max(1, size // 2))]
        size = size // 2 if size > 4 else 0
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def _fits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proper rotations and shifts that carry b onto a, from sums of 1, b, a and b x a over each selection."""
    n = np.maximum(sums[:, :1], 1.0)
    b, a = sums[:, 1:4] / n, sums[:, 4:7] / n
    h = sums[:, 7:].reshape(-1, 3, 3) / n[:, :, None] - b[:, :, None] * a[:, None, :]
    u, _, vt = np.linalg.svd(h)
    v, ut = vt.transpose(0, 2, 1), u.transpose(0, 2, 1)
    v[:, :, 2] *= np.sign(np.linalg.det(v @ ut))[:, None]
    r = v @ ut
    return r, a - (r @ b[:, :, None])[:, :, 0]


def _measured(fits: tuple[np.ndarray, np.ndarray], features: np.ndarray, score: Callable[[np.ndarray], np.ndarray], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each fit: its score, the points closer than its cut (as bits), and their moments.

    A squared distance is linear in the points' features, so those of many fits and a tile of points are one product of
    matrices; only a tile of distances is held at a time.
    """
    r, t = fits
    weights = np.concatenate([(t * t).sum(axis=1)[:, None], 2 * (t[:, None, :] @ r)[:, 0], -2 * t, -2 * r.transpose(0, 2, 1).reshape(-1, 9), np.ones((len(t), 1))], axis=1)
    n, moments = len(features), features.shape[1] - 1
    total, sums, bits = np.zeros(len(t)), np.zeros((len(t), moments)), np.empty((len(t), (n + 7) // 8), dtype=np.uint8)
    tile = max(8, TOGETHER // len(t) // 8 * 8)
    for at in range(0, n, tile):
        some = features[at : at + tile]
        far = np.maximum(weights @ some.T, 0.0)
        near = far < (cuts * cuts)[:, None]
        bits[:, at // 8 : (at + len(some) + 7) // 8] = np.packbits(near, axis=1)
        sums += near.astype(np.float64) @ some[:, :moments]
        total += score(far)
    return total, bits, sums


def grown(a: np.ndarray, b: np.ndarray, seeds: np.ndarray, score: Callable[[np.ndarray], np.ndarray], top: int, cut: float, widen: bool) -> float:
    """The best score of the fits grown from the seeds: superpose a selection, keep what is closer than the cut, again.

    `score` gives what some of the points add to each fit's score, from their squared distances. The first fits come from running
    sums of the points' moments, so that a fragment of any length costs the same. Where fewer than three points are kept,
    the cut widens by a half, or else the search of that seed ends. What follows from a selection does not depend on the
    seed, so a selection that was met with as many rounds left is not grown again; nor is anything if the best is `top`,
    which no fit can pass.
    """
    features = np.concatenate([np.ones((len(a), 1)), b, a, (b[:, :, None] * a[:, None, :]).reshape(-1, 9), (a * a + b * b).sum(axis=1)[:, None]], axis=1)
    running = np.concatenate([np.zeros((1, features.shape[1] - 1)), np.cumsum(features[:, :-1], axis=0)])
    best, together, met = 0.0, min(SEEDS, max(1, TOGETHER // 8)), {}
    for at in range(0, len(seeds), together):
        some = seeds[at : at + together]
        chosen = np.packbits((np.arange(len(a)) >= some[:, :1]) & (np.arange(len(a)) < some.sum(axis=1)[:, None]), axis=1)
        sums, cuts = running[some.sum(axis=1)] - running[some[:, 0]], np.full(len(some), cut)
        for left in reversed(range(ROUNDS)):
            going = sums[:, 0] >= 3
            chosen, sums, cuts = chosen[going], sums[going], cuts[going]
            if not len(sums):
                break
            scores, near, kept = _measured(_fits(sums), features, score, cuts)
            best = max(best, float(scores.max()))
            if best >= top * (1 - ROUNDING):
                return best
            few = kept[:, 0] < 3
            done = (near == chosen).all(axis=1) & ~few | (few & (not widen))
            cuts = cuts + 0.5 * few
            chosen, sums = np.where(few[:, None], chosen, near), np.where(few[:, None], sums, kept)
            for i in np.flatnonzero(~done):
                key = blake2b(chosen[i].tobytes() + cuts[i].tobytes(), digest_size=16).digest()
                done[i] = met.get(key, 0) >= left
                met[key] = max(met.get(key, 0), left)
            chosen, sums, cuts = chosen[~done], sums[~done], cuts[~done]
    return best


def scores_from(a: np.ndarray, b: np.ndarray, full: int, seeds: np.ndarray) -> tuple[float, float]:
    """(tm, gdt_ts) of points b paired with a, the best of the seeds; TM is over the reference's full length."""
    middle = a.mean(axis=0)
    a, b, d0 = a - middle, b - b.mean(axis=0), scale_of(full)
    within = lambda d2, c: np.bitwise_count(np.packbits(d2 < c * c, axis=1)).sum(axis=1, dtype=np.int64)
    tm = grown(a, b, seeds, lambda d2: np.reciprocal(1 + d2 / (d0 * d0)).sum(axis=1), len(a), d0 + 1.0, True)
    gdt = grown(a, b, seeds, lambda d2: sum(within(d2, c) for c in CUTOFFS), len(CUTOFFS) * len(a), CUTOFFS[-1], False)
    return tm / full, gdt / (len(CUTOFFS) * len(a))


def _with_rmsd(sums: DataFrame, n: Column) -> DataFrame:
    """Adds _fit: least RMSD under a proper rotation, from sums of both sides (_m0, ..., _r0, ...), of their products (_p00,
    ...) and squares (_q). The singular values of the centred product are roots of a cubic, here in closed form. Steps
    are columns of their own, so that none is worked out twice."""
    c, three = F.col, range(3)
    det = lambda m: sum(((-1) ** i * m(0, i) * (m(1, min({0, 1, 2} - {i})) * m(2, max({0, 1, 2} - {i})) - m(1, max({0, 1, 2} - {i})) * m(2, min({0, 1, 2} - {i}))) for i in three), F.lit(0.0))
    h = sums.withColumns({f"_h{i}{j}": c(f"_p{i}{j}") - c(f"_m{i}") * c(f"_r{j}") / n for i in three for j in three})
    h = h.withColumn("_spread", c("_q") - sum((c(f"_{v}{i}") * c(f"_{v}{i}") for v in "mr" for i in three), F.lit(0.0)) / n)
    k = h.withColumns({f"_k{i}{j}": sum((c(f"_h{m}{i}") * c(f"_h{m}{j}") for m in three), F.lit(0.0)) for i in three for j in three if i <= j})
    k = k.withColumn("_det", det(lambda i, j: c(f"_h{i}{j}"))).withColumn("_mid", (c("_k00") + c("_k11") + c("_k22")) / 3)
    k = k.withColumns({f"_d{i}": c(f"_k{i}{i}") - c("_mid") for i in three})
    k = k.withColumn("_wide", F.sqrt((sum((c(f"_d{i}") * c(f"_d{i}") for i in three), F.lit(0.0)) + 2 * (c("_k01") * c("_k01") + c("_k02") * c("_k02") + c("_k12") * c("_k12"))) / 6))
    off = det(lambda i, j: c(f"_d{i}") if i == j else c(f"_k{min(i, j)}{max(i, j)}"))
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(off, 2 * c("_wide") * c("_wide") * c("_wide")), F.lit(0.0))))) / 3
    k = k.withColumn("_turn", turn)
    k = k.withColumns({"_one": c("_mid") + 2 * c("_wide") * F.cos("_turn"), "_three": c("_mid") + 2 * c("_wide") * F.cos(c("_turn") + F.lit(2 * np.pi / 3))})
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    fit = root(c("_one")) + root(3 * c("_mid") - c("_one") - c("_three")) + F.signum("_det") * root(c("_three"))
    return k.withColumn("_fit", root((c("_spread") - 2 * fit) / n))


def paired_residues(reference: DataFrame, submissions: DataFrame) -> DataFrame:
    """target, submission, idx, x, y, z, rx, ry, rz: the residues both have, one row of each number (the least point)."""
    r = reference.groupBy("target", "idx").agg(F.min(F.struct(*AXES)).alias("_r"))
    s = submissions.groupBy("target", "submission", "idx").agg(F.min(F.struct(*AXES)).alias("_s"))
    return s.join(r, ["target", "idx"]).select("target", "submission", "idx", *[F.col(f"_s.{c}").alias(c) for c in AXES], *[F.col(f"_r.{c}").alias(f"r{c}") for c in AXES])


def submission_rmsd(paired: DataFrame, least: int = 10) -> DataFrame:
    """target, submission, paired, rmsd (null under `least` residues), from one aggregate of moments."""
    mine, other = [F.col(c) for c in AXES], [F.col(f"r{c}") for c in AXES]
    moments = {f"_m{i}": F.sum(mine[i]) for i in range(3)} | {f"_r{i}": F.sum(other[i]) for i in range(3)} | {f"_p{i}{j}": F.sum(mine[i] * other[j]) for i in range(3) for j in range(3)}
    squares = F.sum(sum((c * c for c in (*mine, *other)), F.lit(0.0))).alias("_q")
    s = paired.groupBy("target", "submission").agg(F.count("*").alias("paired"), squares, *[c.alias(name) for name, c in moments.items()])
    return _with_rmsd(s, F.col("paired")).select("target", "submission", "paired", F.when(F.col("paired") >= least, F.col("_fit")).alias("rmsd"))


def _dealt(points: DataFrame, columns: list[str]) -> DataFrame:
    """Each model's points as arrays, once for each of its shares (part of parts), dealt to tasks."""
    n, tasks = F.size("_c").cast("double"), 4 * points.sparkSession.sparkContext.defaultParallelism
    parts = F.least(F.lit(SHARES), F.greatest(F.lit(1), F.ceil(2 * n * n / SHARE))).cast("int")
    shares = points.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shares = shares.select("target", "submission", "full", "part", "parts", *[F.col(f"_c.{c}").cast("array<double>").alias(c) for c in columns])
    return shares.repartition(tasks, "target", "submission", "part")


def score_submissions(reference: DataFrame, submissions: DataFrame, least: int = 10) -> DataFrame:
    """target, submission, paired, rmsd, tm, gdt_ts of every submission with a residue of the reference; under `least`
    paired residues the scores are null.

    reference: target, idx, x, y, z; submissions the same with `submission`. TM is over the reference's full length, GDT over
    the paired residues, each the best of one superposition.

    RMSD comes from moments alone. For TM and GDT a model's points are one row, and its fragments are dealt to SHARES tasks at
    most, each of which gets the points and a share of the fragments. So what is shuffled grows as the rows do, while the
    distances (fragments times points) grow with the square of the length.
    """
    paired = materialize(paired_residues(reference, submissions), "paired")
    rmsd = submission_rmsd(paired, least)
    full = reference.groupBy("target").agg(F.count_distinct("idx").alias("full"))
    columns = [*AXES, *[f"r{c}" for c in AXES]]
    points = paired.groupBy("target", "submission").agg(F.array_sort(F.collect_list(F.struct("idx", *columns))).alias("_c")).where(F.size("_c") >= least)
    dealt = _dealt(points.join(full, "target"), columns)
    kind = {f.name: f.dataType.simpleString() for f in paired.schema}

    def run(batches):
        for batch in batches:
            out: list[list[float]] = [[], []]
            for i in range(batch.num_rows):
                cell = lambda name: batch.column(batch.schema.get_field_index(name))[i]  # noqa: B023, E731
                xyz = np.stack([cell(c).values.to_numpy(zero_copy_only=False) for c in columns], axis=1)
                seeds = fragments(len(xyz))[cell("part").as_py() :: cell("parts").as_py()]
                for got, value in zip(out, scores_from(xyz[:, 3:], xyz[:, :3], cell("full").as_py(), seeds), strict=True):
                    got.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.float64()) for x in out]], names=["target", "submission", "tm", "gdt_ts"])

    found = dealt.mapInArrow(run, f"target {kind['target']}, submission {kind['submission']}, tm double, gdt_ts double")
    best = found.groupBy("target", "submission").agg(F.max("tm").alias("tm"), F.max("gdt_ts").alias("gdt_ts"))
    return rmsd.join(best, ["target", "submission"], "left")

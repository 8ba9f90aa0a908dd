"""Numeric kernels: covariance, Gaussian fits, greedy pairing. Spark sums and deals; numpy works on small matrices."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .structure import by_size, cell_join
from .tiles import Tile, distances, tile_join


def step_covariance(steps: DataFrame, context: str, values: Sequence[str], least: int = 200) -> DataFrame:
    """context, n, mean, sd (population), covariance (sample, row by row), inverse_diagonal, condition of contexts with at least
    `least` steps. Spark sums the moments; the small matrices are inverted per context."""
    k = list(values)
    pairs = [(a, b) for i, a in enumerate(k) for b in k[i:]]
    m = steps.groupBy(context).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m_{v}") for v in k], *[F.stddev_pop(v).alias(f"s_{v}") for v in k], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs]).where(F.col("n") >= least)

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                c = np.array([[row[f"c_{a}_{b}"] if (a, b) in pairs else row[f"c_{b}_{a}"] for b in k] for a in k])
                w = np.linalg.eigvalsh(c)
                sound = w[0] > 0
                out.append((row[context], row["n"], [row[f"m_{v}"] for v in k], [row[f"s_{v}"] for v in k], c.ravel().tolist(), np.diag(np.linalg.inv(c)).tolist() if sound else None, float(w[-1] / w[0]) if sound else None))
            yield pd.DataFrame(out, columns=[context, "n", "mean", "sd", "covariance", "inverse_diagonal", "condition"])

    kind = steps.schema[context].dataType.simpleString()
    return m.mapInPandas(run, f"{context} {kind}, n long, mean array<double>, sd array<double>, covariance array<double>, inverse_diagonal array<double>, condition double")


def gaussian_nll(steps: DataFrame, group: str, values: Sequence[str], key: str, ridge: float = 1e-3, least: int = 50) -> DataFrame:
    """fold, groups, n, nll: mean negative log-likelihood of each half under Gaussians fitted to the other half of its group
    (groups with `least` rows in the other half); rows are halved by a hash of `key`."""
    k = list(values)
    s = steps.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(2)).cast("int"))
    moments = [F.avg(v).alias(f"m_{v}") for v in k] + [F.covar_pop(a, b).alias(f"c_{a}_{b}") for a in k for b in k]
    fit = s.groupBy(F.col(group).alias("_g"), (1 - F.col("fold")).alias("_fold")).agg(F.count("*").alias("_n"), *moments).where(F.col("_n") >= least)
    # Expected log-likelihood needs the scored half's moments alone: trace and quadratic form.
    scored = s.groupBy(group, "fold").agg(F.count("*").alias("n"), *[F.avg(v).alias(f"t_{v}") for v in k], *[F.covar_pop(a, b).alias(f"d_{a}_{b}") for a in k for b in k])
    j = scored.join(fit, (F.col(group) == F.col("_g")) & (F.col("fold") == F.col("_fold")))

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                c = np.array([[r[f"c_{a}_{b}"] for b in k] for a in k]) + ridge * np.eye(len(k))
                d = np.array([[r[f"d_{a}_{b}"] for b in k] for a in k])
                shift = np.array([r[f"t_{v}"] - r[f"m_{v}"] for v in k])
                inv = np.linalg.inv(c)
                nll = 0.5 * (len(k) * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + np.trace(inv @ d) + shift @ inv @ shift)
                rows.append((int(r["fold"]), int(r["n"]), float(nll)))
            yield pd.DataFrame(rows, columns=["fold", "n", "nll"])

    per = j.mapInPandas(run, "fold int, n long, nll double")
    return per.groupBy("fold").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("nll")) / F.sum("n")).alias("nll"))


def nested_gaussian_nll(steps: DataFrame, values: Sequence[str], models: Mapping[str, Sequence[str]], key: str, ridge: float = 1e-3, covered: int = 200, least: int = 8) -> DataFrame:
    """model, n_covered, coverage, n_common, n_in, in_sample, n_held, held_out: mean negative log-likelihood of Gaussians
    fitted to the groups of each model, on the steps they were fitted to and on held-out halves.

    `models` names the columns that each model groups by. A step is covered by a model if its group has `covered` steps; all
    models are scored on the steps that all cover. Groups of fewer than `least` steps are not fitted. The fit's covariance
    has n - 1 below it and the ridge on its diagonal. Halves are by a hash of `key`; steps with a null value are left out.

    Steps are summed once, into moments of the finest groups by half; every model's groups are sums of these (grouping sets),
    and a mean likelihood needs moments alone. Moments are taken about the overall mean.
    """
    k, names = list(values), list(dict.fromkeys(c for columns in models.values() for c in columns))
    known = steps.dropna(subset=k)
    middle = known.agg(*[F.avg(v).alias(v) for v in k]).first()
    x = {v: F.col(v) - F.lit(float(middle[v] or 0.0)) for v in k}
    moments = {"n": F.count("*").cast("double"), **{f"s_{v}": F.sum(x[v]) for v in k}, **{f"p_{a}_{b}": F.sum(x[a] * x[b]) for i, a in enumerate(k) for b in k[i:]}}
    half = F.pmod(F.xxhash64(key), F.lit(2)).cast("int")
    cells = materialize(known.groupBy(*names, half.alias("_half")).agg(*[c.alias(m) for m, c in moments.items()]), "cells")

    def levels(df: DataFrame, *aggregates: Column) -> DataFrame:
        """A row for each group of each model, with its model; a column that the model does not group by is null."""
        sets = [[F.col(c) for c in columns] for columns in models.values()]
        code = {sum((c not in columns) << (len(names) - 1 - i) for i, c in enumerate(names)): m for m, columns in models.items()}
        model = F.create_map(*[F.lit(v) for pair in code.items() for v in pair])
        return df.groupingSets(sets, *[F.col(c) for c in names]).agg(F.grouping_id(*names).cast("int").alias("_g"), *aggregates).withColumn("model", model[F.col("_g")])

    counts = materialize(levels(cells, F.sum("n").alias("_n")), "counts")
    reached = counts.where(F.col("_n") >= covered)
    common = cells
    for m, columns in models.items():
        same = F.lit(True)
        for c in columns:
            same = same & F.col(c).eqNullSafe(F.col(f"_{m}_{c}"))
        common = common.join(reached.where(F.col("model") == m).select(*[F.col(c).alias(f"_{m}_{c}") for c in columns], F.lit(1).alias("_one")), same, "left_semi")
    common = materialize(common, "common")
    sums = [F.coalesce(F.sum(F.when(F.col("_half") == h, F.col(m))), F.lit(0.0)).alias(f"{m}_{h}") for h in (0, 1) for m in moments]

    summed = list(moments)

    def run(frames):
        for pdf in frames:
            half = []
            for h in (0, 1):
                product = np.stack([[pdf[f"p_{a}_{b}_{h}" if f"p_{a}_{b}" in summed else f"p_{b}_{a}_{h}"].to_numpy() for b in k] for a in k], axis=0) if len(pdf) else np.empty((len(k), len(k), 0))
                half.append((pdf[f"n_{h}"].to_numpy(), pdf[[f"s_{v}_{h}" for v in k]].to_numpy(), product.transpose(2, 0, 1)))
            both = tuple(a + b for a, b in zip(*half, strict=True))
            out = {"model": pdf["model"]}
            for name, pairs in (("in", [(both, both)]), ("held", [(half[0], half[1]), (half[1], half[0])])):
                got = [mean_nll(fit, scored, ridge, least) for fit, scored in pairs]
                out[f"n_{name}"], out[f"l_{name}"] = sum(n for n, _ in got), sum(n * x for n, x in got)
            yield pd.DataFrame(out)

    scored = levels(common, *sums).drop("_g", *names).mapInPandas(run, "model string, n_in double, l_in double, n_held double, l_held double")
    total = F.sum("n_in"), F.sum("n_held")
    losses = scored.groupBy("model").agg(total[0].cast("long").alias("n_in"), F.try_divide(F.sum("l_in"), total[0]).alias("in_sample"), total[1].cast("long").alias("n_held"), F.try_divide(F.sum("l_held"), total[1]).alias("held_out"))
    about = counts.groupBy("model").agg(F.coalesce(F.sum(F.when(F.col("_n") >= covered, F.col("_n"))), F.lit(0.0)).cast("long").alias("n_covered"), F.sum("_n").alias("_all"))
    n_common = common.agg(F.coalesce(F.sum("n"), F.lit(0.0)).cast("long").alias("n_common"))
    return about.join(losses, "model", "left").join(F.broadcast(n_common)).select("model", "n_covered", (F.col("n_covered") / F.col("_all")).alias("coverage"), "n_common", "n_in", "in_sample", "n_held", "held_out")  # a row for each model


def mean_nll(fit: tuple, scored: tuple, ridge: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, mean negative log-likelihood) of the scored moments (n, sums, products) of groups under Gaussians fitted to
    others; 0 where a group has none to score, or too few to fit."""
    n, s, p = scored
    m, t, q = fit
    use = (n > 0) & (m >= max(least, 2))
    d, safe, free = s.shape[1], np.where(use, n, 1.0), np.where(use, m, 2.0)
    mean, centre = s / safe[:, None], t / free[:, None]
    spread = p / safe[:, None, None] - mean[:, :, None] * mean[:, None, :]
    fitted = (q - free[:, None, None] * centre[:, :, None] * centre[:, None, :]) / (free - 1)[:, None, None] + ridge * np.eye(d)
    fitted = np.where(use[:, None, None], fitted, np.eye(d))
    inverse, (sign, size), shift = np.linalg.inv(fitted), np.linalg.slogdet(fitted), mean - centre
    use &= sign > 0
    square = np.einsum("gij,gji->g", inverse, spread) + np.einsum("gi,gij,gj->g", shift, inverse, shift)
    return np.where(use, n, 0.0), np.where(use, 0.5 * (square + size + d * np.log(2 * np.pi)), 0.0)


def nll_gains(result: DataFrame, steps: Mapping[str, tuple[str, str]]) -> DataFrame:
    """gain, in_sample, held_out: how much lower the second model of each named pair scores than the first."""
    rows = []
    for name, (before, after) in steps.items():
        of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
        rows.append(result.agg(F.lit(name).alias("gain"), *[(of(before, c) - of(after, c)).alias(c) for c in ("in_sample", "held_out")]))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


#: Watson-Crick and wobble pairs.
PAIRS = ("AU", "UA", "GC", "CG", "GU", "UG")


def pair_candidates(residues: DataFrame, ideal: float = 8.63, window: float = 2.0, apart: int = 3, within: float | None = None) -> DataFrame:
    """entry, i, j, off: complementary residues whose distance is within the window of the ideal, and no further off it than
    `within`; by cells, those of large entries by tiles."""
    letters = sorted({b for pair in PAIRS for b in pair})
    r = residues.where(F.col("base").isin(*letters)).select("entry", "idx", "base", "x", "y", "z")
    most, cutoff = window if within is None else min(window, within), ideal + window
    small, large = by_size(r)
    near = cell_join(small, small, "entry", cutoff).where((F.col("r_idx") - F.col("idx") > apart) & F.concat("base", "r_base").isin(*PAIRS))
    near = near.withColumn("off", F.abs(F.sqrt("dist2") - ideal)).where(F.col("off") <= most).select("entry", F.col("idx").alias("i"), F.col("r_idx").alias("j"), "off")
    fits = np.array([[a + b in PAIRS for b in letters] for a in letters])

    def kernel(a: Tile, b: Tile) -> Iterator[list[np.ndarray]]:
        of, to = a["code"].astype(np.int8), b["code"].astype(np.int8)
        for s, far in distances(a, b):
            off = np.abs(np.sqrt(far) - ideal)
            p, q = np.nonzero((off <= most) & (far <= cutoff * cutoff))
            good = fits[of[s][p], to[q]] & (b["idx"][q] - a["idx"][s][p] > apart)
            yield [a["idx"][s][p[good]], b["idx"][q[good]], off[p[good], q[good]]]

    code = F.array_position(F.array(*[F.lit(b) for b in letters]), F.col("base")) - 1
    kind = r.schema["idx"].dataType.simpleString()
    tiled = tile_join(large.withColumn("code", code), cutoff, ["code"], kernel, "i long, j long, off double")
    return near.unionByName(tiled.select("entry", F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "off"))


#: Candidates a residue is first given, about; by how much the width grows each time.
FIRST_CANDIDATES, WIDER = 16, 8


def greedy_pairs(residues: DataFrame, ideal: float = 8.63, window: float = 2.0, apart: int = 3) -> DataFrame:
    """entry, i, j: what `greedy_pairing` takes of all `pair_candidates`.

    The order is by `off`, so candidates that are hardly off are paired first, and those further off are only made
    of the residues that are still free: their number stays near that of the residues.
    """
    left = materialize(residues.select("entry", "idx", "base", "x", "y", "z"), "free")
    longest = left.groupBy("entry").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    within, taken = window * min(1.0, FIRST_CANDIDATES / longest), None
    while True:
        got = greedy_pairing(pair_candidates(left, ideal, window, apart, within))
        taken = got if taken is None else taken.unionByName(got)
        if within >= window:
            return taken
        gone = got.select("entry", F.explode(F.array("i", "j")).alias("idx"))
        left = materialize(left.join(gone, ["entry", "idx"], "left_anti"), "free")
        within = min(window, within * WIDER)


#: The ring atoms that lie in a base's plane, and the atom that pairs.
RINGS = {"A": ("N9", "C8", "N7", "C5", "C4"), "G": ("N9", "C8", "N7", "C5", "C4"), "C": ("N1", "C2", "N3", "C4", "C5", "C6"), "U": ("N1", "C2", "N3", "C4", "C5", "C6")}
PAIRING_ATOM = {"A": "N1", "G": "N1", "C": "N3", "U": "N3"}


def base_planes(atoms: DataFrame) -> DataFrame:
    """entry, idx, base, x, y, z (of the pairing atom), nx, ny, nz (the plane's normal) of residues whose ring and pairing
    atoms are all there, from entry, idx, base, atom, x, y, z.

    The normal is the direction in which the ring atoms vary least. Spark gathers a residue's few atoms; numpy solves the
    small matrices of a batch at once.
    """
    ring = F.create_map(*[x for b, names in RINGS.items() for x in (F.lit(b), F.array(*[F.lit(a) for a in names]))])
    pairing = F.create_map(*[F.lit(x) for kv in PAIRING_ATOM.items() for x in kv])
    a = atoms.where(F.col("base").isin(*RINGS)).dropDuplicates(["entry", "idx", "base", "atom"])
    inside = F.array_contains(F.try_element_at(ring, F.col("base")), F.col("atom"))
    own = F.col("atom") == F.try_element_at(pairing, F.col("base"))
    mean = [F.sum(F.when(inside, F.col(u) * F.col(v))).alias(f"{u}{v}") for u, v in ("xx", "xy", "xz", "yy", "yz", "zz")]
    sums = a.groupBy("entry", "idx", "base").agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in "xyz"], *[F.sum(F.when(inside, F.col(c))).alias(f"s{c}") for c in "xyz"], *mean, F.count_if(inside).alias("n")
    ).where(F.col("x").isNotNull() & (F.col("n") == F.size(F.try_element_at(ring, F.col("base")))))

    def run(frames):
        for pdf in frames:
            n = pdf["n"].to_numpy(dtype=float)
            s = pdf[["sx", "sy", "sz"]].to_numpy()
            m = pdf[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy().reshape(-1, 3, 3) / n[:, None, None]
            m = m - (s / n[:, None])[:, :, None] * (s / n[:, None])[:, None, :]
            normal = np.linalg.eigh(m)[1][:, :, 0] if len(pdf) else np.empty((0, 3))
            yield pdf[["entry", "idx", "base", "x", "y", "z"]].assign(nx=normal[:, 0], ny=normal[:, 1], nz=normal[:, 2])

    kind = {f.name: f.dataType.simpleString() for f in sums.schema}
    return sums.mapInPandas(run, f"entry {kind['entry']}, idx {kind['idx']}, base string, x double, y double, z double, nx double, ny double, nz double")


def full_atom_pairs(atoms: DataFrame, cutoff: float = 3.3, parallel: float = 0.75, apart: int = 3) -> DataFrame:
    """entry, i, j: residues of bases that can pair, more than `apart` places from each other, whose pairing atoms are within
    the cutoff and whose planes' normals agree to `parallel` or more. Residues lacking an atom are left out."""
    r = materialize(base_planes(atoms), "planes")
    j = cell_join(r, r, "entry", cutoff).where((F.col("r_idx") - F.col("idx") > apart) & F.concat("base", "r_base").isin(*PAIRS))
    same = F.abs(sum((F.col(f"n{c}") * F.col(f"r_n{c}") for c in "xyz"), F.lit(0.0)))
    return j.where(same >= parallel).select("entry", F.col("idx").alias("i"), F.col("r_idx").alias("j"))


def greedy_pairing(candidates: DataFrame) -> DataFrame:
    """entry, i, j: candidates in order of `off` (then i, j), each taken if both residues are free.

    Round by round: a candidate that is the best of both its residues is one the greedy order takes, so all such are taken
    at once and their residues leave; this gives the greedy result without putting an entry into one task.
    """
    left, taken = materialize(candidates, "candidates"), None
    while True:
        order = F.struct("off", "i", "j")
        ends = left.select("entry", F.explode(F.array("i", "j")).alias("e"), order.alias("o")).groupBy("entry", "e").agg(F.min("o").alias("b"))
        bi = ends.select("entry", F.col("e").alias("i"), F.col("b").alias("bi"))
        bj = ends.select("entry", F.col("e").alias("j"), F.col("b").alias("bj"))
        best = left.join(bi, ["entry", "i"]).join(bj, ["entry", "j"]).where((F.col("bi") == order) & (F.col("bj") == order)).select("entry", "i", "j")
        best = materialize(best, "pairs")
        if best.isEmpty():
            return taken if taken is not None else best
        taken = best if taken is None else taken.unionByName(best)
        gone = best.select("entry", F.explode(F.array("i", "j")).alias("e")).distinct()
        left = left.join(gone.withColumnRenamed("e", "i"), ["entry", "i"], "left_anti").join(gone.withColumnRenamed("e", "j"), ["entry", "j"], "left_anti")
        left = materialize(left.select("entry", "i", "j", "off"), "candidates")


# What pairs of bases score, and the weights of the pair, its stacking neighbours and its nearness.
PAIR_SCORES = {"GC": 3.0, "CG": 3.0, "AU": 2.0, "UA": 2.0, "GU": 0.8, "UG": 0.8}
BASE_WEIGHT, STACK_WEIGHT, NEAR_WEIGHT, DECAY = 1.0, 0.6, 2.0, 40.0


#: The separation up to which pairs are taken in first.
FIRST_REACH = 128


def proposal_recall(residues: DataFrame, truth: DataFrame, budgets: Sequence[int], apart: int = 4) -> DataFrame:
    """entry, c, recall: share of true contacts among the c * L best pairs by a score from sequence alone (complementary bases,
    stacking neighbours on both sides, decay with separation), ties by i and j. Pairs of every separation are ranked.
    `truth` has each pair once.

    A pair's score falls with its separation, so no pair further apart than some separation scores more than the best kinds
    of its entry would just beyond it. Separations are taken in up to where so many pairs score more than that as the
    largest budget asks for; only where they never do, all of them are. True pairs further apart are counted alone.
    """
    w = Window.partitionBy("entry").orderBy("idx")
    # A kind is three numbers of three bits: the residue before, itself and the one after; 0 to 3 are bases, 4 another one, 5 none.
    base = F.coalesce(F.array_position(F.array(*[F.lit(b) for b in "ACGU"]), F.col("base")), F.lit(0)).cast("int")
    r = residues.select("entry", "idx", F.when(base > 0, base - 1).otherwise(4).alias("base")).withColumns({"nxt": F.coalesce(F.lead("base").over(w), F.lit(5)), "prv": F.coalesce(F.lag("base").over(w), F.lit(5))})
    kind = F.col("prv") * 64 + F.col("base") * 8 + F.col("nxt")
    # An entry's pairs are made from its rows, so these are dealt to all cores.
    r = materialize(r.select("entry", F.col("idx").cast("int").alias("idx"), kind.alias("kind")).repartition(4 * r.sparkSession.sparkContext.defaultParallelism, "entry", "idx"), "kinds")
    table = F.array(*[F.lit(PAIR_SCORES.get("ACGU"[a] + "ACGU"[b], 0.0) if max(a, b) < 4 else 0.0) for a in range(8) for b in range(8)])
    size = r.groupBy("entry").agg(F.count("*").alias("l"))
    near = r.groupBy("entry").agg((F.max("idx") - F.min("idx")).alias("span")).where(F.col("span") >= apart)
    near = materialize(near.join(size, "entry").withColumn("cut", F.col("l") * F.lit(max(budgets))), "spans")

    def scored(df: DataFrame) -> DataFrame:
        # Places in a kind: 1 the residue before, 2 itself, 3 the one after. At a chain's ends nothing stacks, nor do
        # inner neighbours that are too near to pair.
        at = lambda c, place: F.shiftright(F.col(c), 9 - 3 * place).bitwiseAND(F.lit(7))
        pair = lambda a, b: F.get(table, at("kind", a) * 8 + at("kind_j", b))
        inside = (at("kind", 1) != 5) & (at("kind_j", 3) != 5)
        stack = F.when(inside, pair(1, 3) + F.when(F.col("gap") - 2 >= apart, pair(3, 1)).otherwise(0.0)).otherwise(0.0)
        return df.withColumn("score", F.round(pair(2, 2) * BASE_WEIGHT + stack * STACK_WEIGHT + F.exp(-F.col("gap") / DECAY) * NEAR_WEIGHT, 9))

    def pairs_at(reach: DataFrame) -> DataFrame:
        """The scored pairs (entry, i, j, score) of entries at separations up to their `reach`."""
        i = reach.select("entry", F.explode(F.sequence(F.lit(apart), F.col("reach"))).alias("gap")).join(r, "entry").withColumn("j", F.col("idx") + F.col("gap"))
        return scored(i.join(r.select("entry", F.col("idx").alias("j"), F.col("kind").alias("kind_j")), ["entry", "j"])).select("entry", F.col("idx").alias("i"), "j", "score")

    kinds = materialize(r.select("entry", "kind").distinct(), "entry_kinds")
    every = kinds.join(kinds.withColumnRenamed("kind", "kind_j"), "entry")
    left, done, reach = near, None, FIRST_REACH
    while True:
        # The score that no pair beyond the reach passes.
        beyond = scored(every.withColumn("gap", F.lit(reach + 1))).groupBy("entry").agg(F.max("score").alias("bound"))
        tried = left.withColumn("reach", F.least(F.col("span"), F.lit(reach)).cast("int"))
        counts = pairs_at(tried).groupBy("entry", "score").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("entry").orderBy(F.desc("score")))
        classes = counts.join(tried, "entry").join(beyond, "entry").where((F.col("score") > F.col("bound")) | (F.col("span") <= reach))
        classes = materialize(classes.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n")), "classes")
        enough = classes.groupBy("entry", "reach", "span", "cut").agg(F.max("upto").alias("found")).where((F.col("found") >= F.col("cut")) | (F.col("span") <= reach))
        enough = materialize(enough.select("entry", "reach"), "enough")
        kept = classes.where(F.col("before") < F.col("cut")).join(enough.select("entry"), "entry", "left_semi").select("entry", "score", "before", "l", "reach")
        done = kept if done is None else done.unionByName(kept)
        left = materialize(left.join(enough.select("entry"), "entry", "left_anti"), "spans")
        if left.isEmpty():
            break
        reach *= 2
    # The pairs up to the cut, and their places: what is before their class, and inside it.
    place = F.row_number().over(Window.partitionBy("entry", "score").orderBy("i", "j"))
    ranked = pairs_at(done.select("entry", "reach").distinct()).join(done.drop("reach"), ["entry", "score"]).withColumn("place", F.col("before") + place)
    ranked = ranked.where(F.col("place") <= F.col("l") * F.lit(max(budgets))).select("entry", "i", "j", "place", "l")
    widest = done.agg(F.max("reach")).first()[0] or 0
    true = truth.select("entry", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
    hits = true.where(F.col("j") - F.col("i") <= widest).join(ranked, ["entry", "i", "j"])
    hits = hits.groupBy("entry").agg(*[F.count_if(F.col("place") <= F.lit(b) * F.col("l")).alias(f"_{b}") for b in budgets])
    c = F.explode(F.array(*[F.struct(F.lit(b).alias("c"), F.coalesce(f"_{b}", F.lit(0)).alias("hit")) for b in budgets]))
    found = true.groupBy("entry").agg(F.count("*").alias("n")).join(hits, "entry", "left").withColumn("c", c)
    return found.select("entry", "c.c", (F.col("c.hit") / F.col("n")).alias("recall"))

"""Structure tables: distance joins on grid cells, contacts, labels, geometry, base pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..session import materialize
from .tiles import kept_distances, residue_pairs, tile_join


def _cells(df: DataFrame, cutoff: float, spread: bool) -> DataFrame:
    cell = [F.floor(F.col(a) / F.lit(cutoff)).cast("long") for a in "xyz"]
    if not spread:
        return df.withColumns({f"_c{a}": c for a, c in zip("xyz", cell, strict=True)})
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    for a, c in zip("xyz", cell, strict=True):
        df = df.withColumn("_o", near).withColumn(f"_c{a}", c + F.col("_o")).drop("_o")
    return df


def cell_join(left: DataFrame, right: DataFrame, key: str, cutoff: float) -> DataFrame:
    """Pairs of rows of one `key` within `cutoff`: left columns as they are, right ones prefixed r_, and dist2.

    Space is cut into cells as wide as the cutoff; the right side goes into its 27 neighbouring cells, so
    this is an equi-join on (key, cell), not all pairs.
    """
    r = _cells(right, cutoff, True).select(F.col(key), *[f"_c{a}" for a in "xyz"], *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    j = _cells(left, cutoff, False).join(r, [key, "_cx", "_cy", "_cz"]).drop("_cx", "_cy", "_cz")
    d2 = (F.col("x") - F.col("r_x")) ** 2 + (F.col("y") - F.col("r_y")) ** 2 + (F.col("z") - F.col("r_z")) ** 2
    return j.withColumn("dist2", d2).where(F.col("dist2") <= cutoff * cutoff)


#: Points of an entry from which on it is met tile by tile.
LARGE_ENTRY = 512


def by_size(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points of entries of fewer than LARGE_ENTRY points, and those of the others."""
    large = materialize(points.groupBy("entry").agg(F.count("*").alias("_n")).where(F.col("_n") >= LARGE_ENTRY).select("entry"), "large")
    return points.join(large, "entry", "left_anti"), points.join(large, "entry", "left_semi")


def contacts(atoms: DataFrame, cutoff: float = 8.0, apart: int = 4) -> DataFrame:
    """entry, i, j: residues with any two atoms within the cutoff and j - i >= apart.

    A dense entry has nearly as many contacts as pairs of residues. Those of large entries are found tile by tile, each in
    one pair of tiles, so that no row is shuffled for a pair; the others' by cells.
    """
    a = atoms.select("entry", "idx", "x", "y", "z")
    kind = a.schema["idx"].dataType.simpleString()
    small, large = by_size(a)
    near = cell_join(small, small, "entry", cutoff).where(F.col("r_idx") - F.col("idx") >= apart).select("entry", F.col("idx").alias("i"), F.col("r_idx").alias("j")).distinct()
    tiled = tile_join(large, cutoff, [], residue_pairs(cutoff, apart), "i long, j long")
    return near.unionByName(tiled.select("entry", F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j")))


def lengths(residues: DataFrame) -> DataFrame:
    return residues.groupBy("entry").agg((F.max("idx") + 1).alias("length"))


def contact_stats(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """entry, length, contacts, per_nt, density."""
    n = pairs.groupBy("entry").agg(F.count("*").alias("contacts"))
    length = F.col("length")
    c = F.coalesce("contacts", F.lit(0))
    return sizes.join(n, "entry", "left").select("entry", "length", c.alias("contacts"), (c / length).alias("per_nt"), F.try_divide(2 * c, length * (length - 1)).alias("density"))


def separation_shares(pairs: DataFrame, bands: Sequence[int]) -> DataFrame:
    """entry, n, median separation, share of contacts with j - i <= band for each band."""
    sep = F.col("j") - F.col("i")
    return pairs.groupBy("entry").agg(F.count("*").alias("n"), F.median(sep).alias("median_separation"), *[F.avg((sep <= b).cast("double")).alias(f"within_{b}") for b in bands])


def block_occupancy(pairs: DataFrame, sizes: DataFrame, blocks: Sequence[int]) -> DataFrame:
    """entry, b, occupied, effective_c (occupied b^2 / length), share of all upper blocks."""
    per = pairs.select("entry", F.explode(F.array(*[F.lit(b) for b in blocks])).alias("b"), "i", "j")
    occ = per.groupBy("entry", "b", F.floor(F.col("i") / F.col("b")).alias("bi"), F.floor(F.col("j") / F.col("b")).alias("bj")).agg(F.count("*").alias("_n")).groupBy("entry", "b").agg(F.count("*").alias("occupied"))
    side = F.ceil(F.col("length") / F.col("b"))
    return occ.join(sizes, "entry").select("entry", "b", "occupied", (F.col("occupied") * F.col("b") * F.col("b") / F.col("length")).alias("effective_c"), (F.col("occupied") / (side * (side + 1) / 2)).alias("share"))


def near_flag(atoms: DataFrame, ions: DataFrame, cutoff: float) -> DataFrame:
    """entry, idx of residues with an atom within the cutoff of an ion."""
    return cell_join(ions, atoms, "entry", cutoff).select("entry", F.col("r_idx").alias("idx")).distinct()


def coordination(ions: DataFrame, atoms: DataFrame, inner: float = 2.6, outer: tuple[float, float] = (3.5, 5.0)) -> DataFrame:
    """entry, ion, k (atom kind), inner, outer: atoms in the first shell and in the second."""
    d = F.sqrt("dist2")
    j = cell_join(ions, atoms, "entry", max(inner, outer[1])).where(d > 0)
    return j.groupBy("entry", "ion", F.col("r_k").alias("k")).agg(F.count_if(d <= inner).alias("inner"), F.count_if(d.between(*outer)).alias("outer")).where("inner + outer > 0")


def nearest_ion(residues: DataFrame, ions: DataFrame, first: float = 8.0) -> DataFrame:
    """entry, idx, distance to the nearest ion of the entry; null without one.

    Residues look within `first` by cells, and those that find none again within twice as far each time, so a
    residue meets the ions about it and not all of its entry; it ends when every entry with ions is done.
    """
    near = materialize(residues.select("entry", "idx", "x", "y", "z"), "residues")
    left = near.join(ions.select("entry").distinct(), "entry", "left_semi")
    found, cutoff = None, first
    # No two points of an entry are further apart than the diagonal of what holds them all.
    both = near.select("entry", "x", "y", "z").unionByName(ions.select("entry", "x", "y", "z"))
    spans = both.groupBy("entry").agg(*[(F.max(c) - F.min(c)).alias(f"s{c}") for c in "xyz"])
    widest = spans.agg(F.max(F.sqrt(sum((F.col(f"s{c}") ** 2 for c in "xyz"), F.lit(0.0))))).first()[0] or 0.0
    while True:
        got = materialize(cell_join(left, ions.select("entry", "x", "y", "z"), "entry", cutoff).groupBy("entry", "idx").agg(F.sqrt(F.min("dist2")).alias("distance")), "nearest")
        found = got if found is None else found.unionByName(got)
        left = materialize(left.join(got, ["entry", "idx"], "left_anti"), "far")
        if cutoff > widest or left.isEmpty():
            break
        cutoff *= 2
    return near.select("entry", "idx").join(found, ["entry", "idx"], "left")


#: Widths of cells that are tried, each half the one before, and how many points near one are few.
WIDTHS, FEW = 12, 16


def nearest_residue(residues: DataFrame, cutoff: float, apart: int) -> DataFrame:
    """entry, i, j: of each residue, the nearest other one within the cutoff and `apart` places or more away, the first of those
    equally near; residues without one are left out.

    Residues look within cells so narrow that few points share one, and those that find none again within twice as far each
    time up to the cutoff, so a residue meets the points about it and not all that lie within the cutoff. Of points on the
    same spot only the first can be the nearest: 2 * apart of a spot are as good as all.
    """
    own = materialize(residues.select("entry", "idx", "x", "y", "z"), "residues")
    spot = Window.partitionBy("entry", "x", "y", "z").orderBy("idx")
    others = materialize(own.withColumn("_n", F.row_number().over(spot)).where(F.col("_n") <= max(1, 2 * apart)).drop("_n"), "spots")
    level = others.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(WIDTHS))))
    cell = [F.floor(F.col(c) / (F.lit(cutoff) / F.pow(F.lit(2.0), F.col("_l")))).alias(f"_c{c}") for c in "xyz"]
    held = level.groupBy("entry", "_l", *cell).agg(F.count("*").cast("double").alias("_n")).groupBy("_l").agg((F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("mean")).collect()
    narrow = [r["_l"] for r in held if r["mean"] <= FEW]
    width, found, left = cutoff / 2 ** (min(narrow) if narrow else WIDTHS), None, own
    while True:
        width = min(width, cutoff)
        near = cell_join(left, others, "entry", width).where(F.abs(F.col("r_idx") - F.col("idx")) >= apart)
        least = near.groupBy("entry", "idx").agg(F.min(F.struct("dist2", "r_idx"))["r_idx"].alias("j"))
        got = materialize(least.select("entry", F.col("idx").alias("i"), "j"), "nearest")
        found = got if found is None else found.unionByName(got)
        if width >= cutoff:
            return found
        left = materialize(left.join(got.select("entry", F.col("i").alias("idx")), ["entry", "idx"], "left_anti"), "far")
        width *= 2


def neighbour_density(residues: DataFrame, cutoff: float = 10.0) -> DataFrame:
    """entry, idx, density: other residues within the cutoff."""
    j = cell_join(residues, residues, "entry", cutoff).where("idx <> r_idx").groupBy("entry", "idx").agg(F.count("*").alias("_n"))
    return residues.select("entry", "idx").join(j, ["entry", "idx"], "left").select("entry", "idx", F.coalesce("_n", F.lit(0)).alias("density"))


def residue_z(b_factors: DataFrame) -> DataFrame:
    """entry, idx, b, z: mean B of each residue and its z over the chain's observed (b > 0) residues, population sd.
    Null for b = 0 and where a chain has one observed residue or no spread."""
    r = b_factors.groupBy("entry", "idx").agg(F.avg("b").alias("b"))
    seen = F.when(F.col("b") > 0, F.col("b"))
    s = r.groupBy("entry").agg(F.avg(seen).alias("_m"), F.stddev_pop(seen).alias("_s"), F.count(seen).alias("_n"))
    z = F.when((F.col("b") > 0) & (F.col("_n") > 1) & (F.col("_s") > 0), (F.col("b") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)))
    return r.join(s, "entry").select("entry", "idx", "b", z.alias("z"))


def binned_gradient(df: DataFrame, value: str, distance: str, edges: Sequence[float], stratum: str) -> DataFrame:
    """stratum (null: all), bin, n, mean, rises (mean at least the bin before's)."""
    band = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        band = F.when((F.col(distance) >= edges[k]) & (F.col(distance) < edges[k + 1]), F.lit(k)).otherwise(band)
    d = df.withColumn("bin", band).where("bin IS NOT NULL")
    one = d.groupBy(F.col(stratum).cast("string").alias("stratum"), "bin").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    every = d.groupBy(F.lit("all").alias("stratum"), "bin").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    both = one.unionByName(every)
    return both.withColumn("rises", F.col("mean") >= F.lag("mean").over(Window.partitionBy("stratum").orderBy("bin")))


def density_bins(df: DataFrame, least: int = 50) -> DataFrame:
    """density, n, mean z of densities held by at least `least` residues, and Pearson's r over all."""
    r = df.agg(stats.safe_corr(F.col("density").cast("double"), F.col("z")).alias("r"))
    bins = df.groupBy("density").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z")).where(F.col("n") >= least)
    return bins.join(F.broadcast(r))  # one row


def loop_classes(residues: DataFrame, pairs: DataFrame) -> DataFrame:
    """entry, idx, paired, loop: 2 inside a class-1 pair that encloses no paired residue (hairpin), 1 in an unpaired
    run next to a pair that encloses other pairs (internal), else 0."""
    ends = pairs.select("entry", F.explode(F.array("i", "j")).alias("idx")).distinct().withColumn("_p", F.lit(1))
    r = residues.select("entry", "idx").join(ends, ["entry", "idx"], "left").withColumn("paired", F.coalesce("_p", F.lit(0)))
    up = Window.partitionBy("entry").orderBy("idx")
    r = r.withColumn("_upto", F.sum("paired").over(up)).select("entry", "idx", "paired", "_upto")
    one = pairs.where("lw = 1")
    at = lambda c, name: r.select("entry", F.col("idx").alias(c), F.col("_upto").alias(name))
    sized = one.join(at("i", "_a"), ["entry", "i"]).join(at("j", "_b"), ["entry", "j"]).withColumn("inside", F.col("_b") - F.col("_a") - 1)
    hair = sized.where("inside = 0 AND j - i > 1").select("entry", F.explode(F.sequence(F.col("i") + 1, F.col("j") - 1)).alias("idx")).distinct().withColumn("_h", F.lit(1))
    # Unpaired runs have one count of paired residues before them; a run touches the pair ends on its two sides.
    flank = sized.where("inside > 0").select("entry", F.explode(F.array(F.col("i"), F.col("j"))).alias("e")).distinct()
    free = r.where("paired = 0")
    run = free.groupBy("entry", "_upto").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    left = run.join(flank.select("entry", (F.col("e") + 1).alias("lo")), ["entry", "lo"], "left_semi").select("entry", "_upto")
    right = run.join(flank.select("entry", (F.col("e") - 1).alias("hi")), ["entry", "hi"], "left_semi").select("entry", "_upto")
    inner = free.join(left.unionByName(right).distinct(), ["entry", "_upto"], "left_semi").select("entry", "idx").withColumn("_i", F.lit(1))
    out = r.join(hair, ["entry", "idx"], "left").join(inner, ["entry", "idx"], "left")
    return out.select("entry", "idx", "paired", F.when(F.col("paired") == 1, 0).when(F.col("_h") == 1, 2).when(F.col("_i") == 1, 1).otherwise(0).alias("loop"))


def _minus(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [p - q for p, q in zip(a, b, strict=True)]


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def dihedral(p: Sequence[Sequence[Column]]) -> Column:
    """Torsion of four points in radians; null if a point is missing or three are in line."""
    b1, b2, b3 = _minus(p[1], p[0]), _minus(p[2], p[1]), _minus(p[3], p[2])
    n1, n2 = _cross(b1, b2), _cross(b2, b3)
    y = _dot(b1, n2) * F.sqrt(_dot(b2, b2))
    x = _dot(n1, n2)
    return F.when((_dot(n1, n1) > 1e-12) & (_dot(n2, n2) > 1e-12), F.atan2(y, x))


def pseudotorsions(backbone: DataFrame) -> DataFrame:
    """entry, idx, eta, theta from P (px, py, pz) and C4' (cx, cy, cz) of a residue and its neighbours."""
    w = Window.partitionBy("entry").orderBy("idx")
    p = [F.col(c) for c in ("px", "py", "pz")]
    c = [F.col(c) for c in ("cx", "cy", "cz")]
    before = [F.lag(x).over(w) for x in c]
    next_p, next_c = [F.lead(x).over(w) for x in p], [F.lead(x).over(w) for x in c]
    follows = (F.lead("idx").over(w) == F.col("idx") + 1)
    preceded = (F.lag("idx").over(w) == F.col("idx") - 1)
    d = backbone.withColumn("_eta", dihedral([before, p, c, next_p])).withColumn("_theta", dihedral([p, c, next_p, next_c])).withColumn("_f", follows).withColumn("_b", preceded)
    return d.select("entry", "idx", F.when(F.col("_f") & F.col("_b"), F.col("_eta")).alias("eta"), F.when(F.col("_f"), F.col("_theta")).alias("theta"))


def bond_validity(backbone: DataFrame, ideal: float, tolerance: float) -> DataFrame:
    """entry, n, share of P-P(next) distances within the tolerance, their median."""
    w = Window.partitionBy("entry").orderBy("idx")
    d = F.sqrt(sum(((F.lead(c).over(w) - F.col(c)) ** 2 for c in ("px", "py", "pz")), F.lit(0.0)))
    r = backbone.withColumn("d", d).where("d IS NOT NULL")
    return r.groupBy("entry").agg(F.count("*").alias("n"), F.avg((F.abs(F.col("d") - ideal) <= tolerance).cast("double")).alias("valid"), F.median("d").alias("median"))


def lddt(reference: DataFrame, model: DataFrame, radius: float = 15.0, apart: int = 0) -> DataFrame:
    """entry, pairs, lddt: over reference pairs closer than the radius and further than `apart` along the chain, the mean
    share of distances kept to 0.5, 1, 2 and 4."""
    n = F.sum("n")
    return kept_by_residue(reference, model, radius, apart).groupBy("entry").agg((n / 2).cast("long").alias("pairs"), (F.sum("kept") / 4 / n).alias("lddt"))


def kept_by_residue(reference: DataFrame, model: DataFrame, radius: float, apart: int) -> DataFrame:
    """entry, idx, n, kept (in quarters), of residues in both: rows to be summed by residue, of every pair of residues one for each of the two."""
    both = reference.select("entry", "idx", "x", "y", "z").join(model.select("entry", "idx", *[F.col(c).alias(f"m{c}") for c in "xyz"]), ["entry", "idx"])
    small, large = by_size(both)
    near = cell_join(small, small, "entry", radius).where((F.abs(F.col("r_idx") - F.col("idx")) > apart) & (F.col("dist2") < radius * radius))
    d = F.abs(F.sqrt("dist2") - F.sqrt(sum(((F.col(f"m{c}") - F.col(f"r_m{c}")) ** 2 for c in "xyz"), F.lit(0.0))))
    kept = sum(((d < t).cast("long") for t in (0.5, 1.0, 2.0, 4.0)), F.lit(0).cast("long"))
    near = near.select("entry", F.col("idx").cast("long").alias("idx"), F.lit(1).cast("long").alias("n"), kept.alias("kept"))
    return near.unionByName(tile_join(large, radius, ["mx", "my", "mz"], kept_distances(radius, apart), "idx long, n long, kept long"))


def clash_score(atoms: DataFrame, cutoff: float = 2.0, apart: int = 1) -> DataFrame:
    """entry, clashes, pairs, score: unordered pairs of atoms of residues further apart than `apart` that are closer than
    the cutoff, over all such pairs; the second number comes from counts of atoms per residue, not from pairs."""
    c = cell_join(atoms, atoms, "entry", cutoff).where((F.col("r_idx") - F.col("idx") > apart) & (F.col("dist2") < cutoff * cutoff)).groupBy("entry").agg(F.count("*").alias("clashes"))
    per = atoms.groupBy("entry", "idx").agg(F.count("*").alias("n"))
    w = Window.partitionBy("entry").orderBy("idx")
    all_before = F.coalesce(F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, -apart - 1)), F.lit(0))
    total = per.withColumn("_p", F.col("n") * all_before).groupBy("entry").agg(F.sum("_p").alias("pairs"))
    n = F.coalesce("clashes", F.lit(0))
    return total.join(c, "entry", "left").select("entry", n.alias("clashes"), "pairs", F.try_divide(n, F.col("pairs")).alias("score"))


def center_coords(df: DataFrame) -> DataFrame:
    """Coordinates about the mean of their entry, which is kept as mx, my, mz."""
    m = df.groupBy("entry").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    return df.join(m, "entry").withColumns({a: F.col(a) - F.col(f"m{a}") for a in "xyz"})


def pair_confusion(predicted: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """key, tp, fp, fn, precision, recall, f1, inf (null without reference pairs)."""
    p = predicted.select(key, "i", "j").distinct().withColumn("_p", F.lit(1))
    r = reference.select(key, "i", "j").distinct().withColumn("_r", F.lit(1))
    n = p.join(r, [key, "i", "j"], "full").groupBy(key).agg(F.count_if(F.col("_p").isNotNull() & F.col("_r").isNotNull()).alias("tp"), F.count_if(F.col("_r").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return n.select(key, "tp", "fp", "fn", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.when(tp + fn > 0, F.coalesce(F.try_divide(tp, F.sqrt((tp + fp) * (tp + fn))), F.lit(0.0))).alias("inf"))


OPENING, CLOSING = "(<[{", ")>]}"


def dot_bracket_pairs(df: DataFrame, key: str, ss: str) -> DataFrame:
    """key, i, j (from 0): bracket pairs of the four kinds; a closing that nothing opened and an opening that never closes pair
    with nothing. Each string is read once in its task, nothing is shuffled."""

    def run(batches):
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                stacks, found = {c: [] for c in CLOSING}, []
                own = dict(zip(OPENING, stacks.values(), strict=True))
                for at, c in enumerate(text.as_py() or ""):
                    if c in own:
                        own[c].append(at)
                    elif c in stacks and stacks[c]:
                        found.append((stacks[c].pop(), at))
                if found:
                    ij = np.array(found, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(ij), row))), pa.array(ij[:, 0]), pa.array(ij[:, 1])], names=[key, "i", "j"])

    return df.select(key, ss).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, i int, j int")


def helix_runs(steps: DataFrame, least: int = 4) -> DataFrame:
    """entry, i, j, run, helical: pairs (i, j) that follow each other as (i+1, j-1), the length of their run."""
    w = Window.partitionBy("entry", F.col("i") + F.col("j")).orderBy("i")
    g = steps.withColumn("_g", F.col("i") - F.row_number().over(w))
    n = F.count("*").over(Window.partitionBy("entry", F.col("i") + F.col("j"), "_g"))
    return g.withColumn("run", n).select("entry", "i", "j", "run", (F.col("run") >= least).alias("helical"))


def local_gc(residues: DataFrame, half: int = 16) -> DataFrame:
    """entry, idx, gc: G and C among the known bases within `half` places; 0 where none is known."""
    w = Window.partitionBy("entry").orderBy("idx").rowsBetween(-half, half)
    gc, known = F.col("base").isin("G", "C").cast("int"), F.col("base").isin("A", "C", "G", "U").cast("int")
    return residues.select("entry", "idx", F.coalesce(F.try_divide(F.sum(gc).over(w), F.sum(known).over(w)), F.lit(0.0)).alias("gc"))


def kmer_context_mean(residues: DataFrame) -> DataFrame:
    """class, n, mean_z: each window of four bases gives its four z to 'GNRA' or 'other'."""
    w = Window.partitionBy("entry").orderBy("idx")
    lead = lambda c, k: F.lead(c, k).over(w)
    four = F.concat("base", *[lead("base", k) for k in (1, 2, 3)])
    r = residues.withColumn("_k", four).withColumn("_z", F.array("z", *[lead("z", k) for k in (1, 2, 3)])).where("_k IS NOT NULL")
    kind = F.when(F.col("_k").rlike("^G[ACGU][AG]A$"), "GNRA").otherwise("other")
    return r.select(kind.alias("class"), F.explode("_z").alias("z")).groupBy("class").agg(F.count("z").alias("n"), F.avg("z").alias("mean_z"))


def first_conformers(atoms: DataFrame) -> DataFrame:
    """First model only, no hydrogens, one conformer: of each (entry, chain, residue, atom) the row first in the file."""
    first = atoms.groupBy("entry").agg(F.min_by("model", "file_pos").alias("_model"))
    a = atoms.join(first, "entry").where((F.col("model") == F.col("_model")) & (F.col("element") != "H") & F.col("seq_id").isNotNull()).drop("_model")
    keys = ["entry", "chain", "seq_id", "ins", "atom"]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("file_pos"))
    return a.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def hybrid_rule(atoms: DataFrame, entities: DataFrame) -> DataFrame:
    """Atoms of RNA chains, and in DNA/RNA hybrid chains of the residues that have an O2' atom."""
    kind = entities.select("entry", "chain", F.when(F.lower("poly_type").contains("hybrid"), "hybrid").when(F.lower("poly_type").contains("polyribonucleotide") & ~F.lower("poly_type").contains("deoxy"), "rna").alias("_kind")).where("_kind IS NOT NULL")
    o2 = atoms.where("atom = \"O2'\"").select("entry", "chain", "seq_id", "ins").distinct().withColumn("_o2", F.lit(True))
    j = atoms.join(kind, ["entry", "chain"]).join(o2, ["entry", "chain", "seq_id", "ins"], "left")
    return j.where("_kind = 'rna' OR _o2").drop("_kind", "_o2")

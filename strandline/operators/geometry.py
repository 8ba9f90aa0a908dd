"""Backbone geometry: three pseudotorsions, bond lengths against their bands, distance tests of residues."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import percentiles
from ..session import materialize
from .structure import dihedral, kept_by_residue

POINTS = {"p": ("px", "py", "pz"), "c": ("cx", "cy", "cz"), "n": ("nx", "ny", "nz")}
#: Least and greatest median, and greatest spread, of bonds of deposited chains.
BANDS = {"p_c4": (3.6, 4.2, 0.40), "c4_n": (3.1, 3.7, 0.40), "p_p": (5.3, 6.5, 1.20)}
#: Length and tolerance of the bonds of a valid chain.
VALID = {"c4_n": (3.38, 0.25), "p_p": (6.01, 1.50)}


def _point(name: str) -> list[Column]:
    return [F.col(c) for c in POINTS[name]]


def _apart(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def _neighbours(backbone: DataFrame) -> tuple[Window, Column, Column]:
    w = Window.partitionBy("entry").orderBy("idx")
    return w, F.lag("idx").over(w) == F.col("idx") - 1, F.lead("idx").over(w) == F.col("idx") + 1


def pseudotorsions(backbone: DataFrame) -> DataFrame:
    """entry, idx, eta, theta, chi (radians) and the sines and cosines of each.

    `backbone` has a residue's P, C4' and base N (px, ..., nz). eta and theta run along P and C4' of the residue and its
    neighbours; chi is P, C4', N and the next P. An angle is null where a point or a neighbour is missing.
    """
    w, before, after = _neighbours(backbone)
    next_p, next_c, last_c = [F.lead(x).over(w) for x in _point("p")], [F.lead(x).over(w) for x in _point("c")], [F.lag(x).over(w) for x in _point("c")]
    d = backbone.withColumns({f"_np{i}": c for i, c in enumerate(next_p)} | {f"_nc{i}": c for i, c in enumerate(next_c)} | {f"_bc{i}": c for i, c in enumerate(last_c)} | {"_before": before, "_after": after})
    p, c, n = _point("p"), _point("c"), _point("n")
    np_, nc, bc = ([F.col(f"_{k}{i}") for i in range(3)] for k in ("np", "nc", "bc"))
    angles = {"eta": F.when(F.col("_before") & F.col("_after"), dihedral([bc, p, c, np_])), "theta": F.when(F.col("_after"), dihedral([p, c, np_, nc])), "chi": F.when(F.col("_after"), dihedral([p, c, n, np_]))}
    d = d.select("entry", "idx", *[x.alias(name) for name, x in angles.items()])
    return d.select("*", *[f(name).alias(f"{label}_{name}") for name in angles for label, f in (("sin", F.sin), ("cos", F.cos))])


def bond_lengths(backbone: DataFrame) -> DataFrame:
    """entry, idx, p_c4, c4_n, p_p (to the next residue of the chain); null where a point is missing."""
    w, _, after = _neighbours(backbone)
    next_p = [F.lead(x).over(w) for x in _point("p")]
    return backbone.select("entry", "idx", _apart(_point("p"), _point("c")).alias("p_c4"), _apart(_point("c"), _point("n")).alias("c4_n"), F.when(after, _apart(_point("p"), next_p)).alias("p_p"))


def geometry_validity(backbone: DataFrame, valid: Mapping[str, tuple[float, float]] = VALID) -> DataFrame:
    """entry and for each bond _ok and _median: the share of lengths within the tolerance, and their median; null without one."""
    lengths = materialize(bond_lengths(backbone), "bonds")
    ok = [F.avg((F.abs(F.col(b) - at) <= off).cast("double")).alias(f"{b}_ok") for b, (at, off) in valid.items()]
    out = lengths.groupBy("entry").agg(*ok)
    for b in valid:
        out = out.join(percentiles(lengths, ["entry"], b, {f"{b}_median": 0.5}), "entry", "left")
    return out


def bond_bands(backbone: DataFrame, bands: Mapping[str, tuple[float, float, float]] = BANDS) -> DataFrame:
    """bond, n, median, sd (population), ok: each bond over all chains, and whether its median lies inside the band and
    its spread below the band's."""
    lengths = bond_lengths(backbone)
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("bond"), F.col(b).alias("length")) for b in bands]))
    long = materialize(lengths.select(rows.alias("r")).select("r.*").where("length IS NOT NULL"), "lengths")
    spread = long.groupBy("bond").agg(F.count("*").alias("n"), F.stddev_pop("length").alias("sd"))
    j = spread.join(percentiles(long, ["bond"], "length", {"median": 0.5}), "bond")
    ok = F.lit(False)
    for b, (lo, hi, most) in bands.items():
        ok = F.when(F.col("bond") == b, (F.col("median") > lo) & (F.col("median") < hi) & (F.col("sd") < most)).otherwise(ok)
    return j.select("bond", "n", "median", "sd", ok.alias("ok"))


def residue_lddt(reference: DataFrame, model: DataFrame, radius: float = 15.0, apart: int = 0) -> DataFrame:
    """entry, idx, pairs, lddt of each reference residue in the model: over the residues closer than the radius and further than
    `apart` along the chain, the mean share of distances kept to 0.5, 1, 2 and 4; null (0 pairs) without such residues."""
    found = kept_by_residue(reference, model, radius, apart).groupBy("entry", "idx").agg(F.sum("n").alias("_n"), (F.sum("kept") / 4 / F.sum("n")).alias("lddt"))
    both = reference.select("entry", "idx").join(model.select("entry", "idx"), ["entry", "idx"])
    return both.join(found, ["entry", "idx"], "left").select("entry", "idx", F.coalesce("_n", F.lit(0)).alias("pairs"), "lddt")

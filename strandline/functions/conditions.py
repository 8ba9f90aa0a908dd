"""Column functions on experimental conditions: units, ions, labels, electrolyte terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CONCENTRATION = r"chemical:([A-Za-z0-9+]+):([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)\s*([A-Za-zµ]+)"


def clash_weight(score: Column) -> Column:
    """Training weight by clashscore band; unknown is 0.8, a score in no band 0.3."""
    return F.when(score.isNull(), 0.8).when((score >= 0) & (score < 10), 1.0).when((score >= 10) & (score < 20), 0.8).when((score >= 20) & (score < 40), 0.55).otherwise(0.3)


def to_mm(value: Column, unit: Column, strict: bool = False) -> Column:
    """Concentration in mM. An unknown unit counts as mM, or gives null when `strict`."""
    u = F.translate(F.lower(F.trim(unit)), "µ", "u")
    other = F.lit(None).cast("double") if strict else value
    return F.when(u == "m", value * 1000).when(u == "mm", value).when(u == "um", value / 1000).when(u == "nm", value / 1_000_000).otherwise(other)


def extract_concentrations(text: Column) -> Column:
    """map<ion, mM> of every 'chemical:ION:value unit'; the last mention of an ion wins."""
    ions, values, units = (F.regexp_extract_all(text, F.lit(CONCENTRATION), F.lit(i)) for i in (1, 2, 3))
    rows = F.transform(F.arrays_zip(ions.alias("ion"), values.alias("v"), units.alias("u")), lambda r: F.struct(r["ion"].alias("key"), to_mm(r["v"].cast("double"), r["u"]).alias("value")))
    kept = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda s: s["key"] == r["key"]))
    return F.map_from_entries(kept)


def first_match(text: Column, patterns: Sequence[tuple[str, str]], other: str | None = None) -> Column:
    """Label of the first pattern that occurs in the text."""
    out = F.lit(other)
    for pattern, label in reversed(patterns):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def all_matches(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Labels of every pattern that occurs, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for p, label in patterns]))


#: Ordered patterns for names of modified residues.
MODIFICATIONS = (("(?i)pseudouridine|pseudo-uridine", "pseudouridine"), ("(?i)methyl", "methylation"))


def classify_modification(name: Column) -> Column:
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "unknown").otherwise(first_match(name, MODIFICATIONS, "other"))


def probe_of(annotations: Column, stem: Column, probes: Sequence[str]) -> Column:
    """A 'modifier:' annotation's value, else the first probe named in the file's stem, else '?'."""
    named = F.regexp_extract(F.concat_ws("\t", annotations), r"modifier:([^\t]+)", 1)
    return F.when(named != "", named).otherwise(first_match(F.lower(stem), [(p.lower(), p) for p in probes], "?"))


def competitor_label(filename: Column) -> Column:
    """struct<group, model> from names like '...TS123_4.pdb'; else the stem and '?'."""
    stem = F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    group, model = F.regexp_extract(stem, r"TS(\w+?)_(\d+)", 1), F.regexp_extract(stem, r"TS(\w+?)_(\d+)", 2)
    return F.struct(F.when(group != "", group).otherwise(stem).alias("group"), F.when(group != "", model).otherwise(F.lit("?")).alias("model"))


def method_label(method: Column) -> Column:
    m = F.upper(method)
    return F.when(m.contains("ELECTRON MICROSCOPY"), "cryo-EM").when(m.contains("X-RAY"), "X-ray").otherwise("other")


#: Ion valences; an ion that is not listed is an error.
VALENCE = {"Na": 1, "K": 1, "Li": 1, "Mg": 2, "Ca": 2, "Mn": 2, "Zn": 2, "Cl": -1}


def _valence(ion: Column) -> Column:
    table = F.create_map(*[x for k, v in VALENCE.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, ion), F.raise_error(F.concat(F.lit("unknown ion "), ion)).cast("int"))


def ionic_strength(conditions: Column) -> Column:
    """Molar ionic strength of a map<cation, mM> with monovalent counter-anions: half the sum of c (z^2 + |z|)."""
    parts = F.transform(F.map_entries(conditions), lambda e: e["value"] / 1000.0 * (_valence(e["key"]) * _valence(e["key"]) + F.abs(_valence(e["key"]))))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2


def debye_length(strength: Column, temperature: float = 298.15, permittivity: float = 78.4) -> Column:
    """Debye length in angstrom; null without ions."""
    k, e, na, eps0 = 1.380649e-23, 1.602176634e-19, 6.02214076e23, 8.8541878128e-12
    return F.when(strength > 0, F.sqrt(F.lit(permittivity * eps0 * k * temperature / (2 * na * e * e * 1000)) / strength) * 1e10)


def bjerrum_length(temperature: float = 298.15, permittivity: float = 78.4) -> float:
    """Bjerrum length in angstrom."""
    k, e, eps0, pi = 1.380649e-23, 1.602176634e-19, 8.8541878128e-12, 3.141592653589793
    return e * e / (4 * pi * eps0 * permittivity * k * temperature) * 1e10


def manning_terms(valence: Column, spacing: float = 2.8) -> Column:
    """struct<xi, theta, q_eff>: Manning parameter, condensed fraction per charge, effective charge."""
    xi = F.lit(bjerrum_length() / spacing)
    theta = F.greatest(F.lit(0.0), (1 - 1 / (valence * xi)) / valence)
    return F.struct(xi.alias("xi"), theta.alias("theta"), (1 - valence * theta).alias("q_eff"))

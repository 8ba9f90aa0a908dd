"""Column functions on mutation strings such as 'C15G,A78U'."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = r"[A-Za-z][0-9]+[A-Za-z]"
WHOLE = f"^{ONE}(,{ONE})*$"


def parse_mutations(c: Column) -> Column:
    """array<struct<wt, pos, mt>> with 0-based places; null if any part is malformed or there is none."""
    parts = F.split(F.regexp_replace(c, r"\s", ""), ",")
    parsed = F.transform(
        parts,
        lambda m: F.struct(
            F.upper(F.substring(m, 1, 1)).alias("wt"),
            (F.regexp_extract(m, r"^[A-Za-z]([0-9]+)[A-Za-z]$", 1).try_cast("int") - 1).alias("pos"),
            F.upper(F.substring(m, -1, 1)).alias("mt"),
        ),
    )
    return F.when(F.regexp_replace(c, r"\s", "").rlike(WHOLE), parsed)


def apply_mutations(wt: Column, muts: Column) -> Column:
    """The sequence with each mutation put in place, later ones over earlier ones; places outside are left."""
    inside = lambda s, m: (m["pos"] >= 0) & (m["pos"] < F.length(s))
    return F.aggregate(muts, wt, lambda s, m: F.when(inside(s, m), F.overlay(s, m["mt"], m["pos"] + 1, F.lit(1))).otherwise(s))


def wild_type_agrees(wt: Column, muts: Column) -> Column:
    """True if every mutation names the base that stands at its place."""
    return F.forall(muts, lambda m: (m["pos"] >= 0) & (F.substring(wt, m["pos"] + 1, F.lit(1)) == m["wt"]))


def mutation_depth(muts: Column) -> Column:
    return F.when(muts.isNotNull(), F.size(muts))


def mutation_count(c: Column) -> Column:
    """`mutation_depth` of the string's mutations, by its commas: no part is taken out of it."""
    bare = F.regexp_replace(c, r"\s", "")
    return F.when(bare.rlike(WHOLE), F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1)


def first_prefix(name: Column, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """Label of the first rule whose prefix the name has."""
    out = F.lit(other)
    for prefix, label in reversed(rules):
        out = F.when(name.startswith(prefix), F.lit(label)).otherwise(out)
    return out


def category_of(family: Column, name: Column) -> Column:
    return F.when(family == "splicing", "splicing").when(F.lower(name).contains("aptamer"), "aptamer").otherwise("ribozyme")

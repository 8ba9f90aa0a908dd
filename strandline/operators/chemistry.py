"""Residue vocabulary, chemistry columns, modification counts and entry composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import classify_modification
from .ranking import places

# The structural vocabulary in order of its ids.
VOCABULARY = ("A", "C", "G", "U", "N", "DA", "DC", "DG", "DU", "I", "UNK", "PAD")
# What is known of each base's chemistry.
PROPERTIES = ("purine", "pair_donors", "pair_acceptors", "groove_donors", "groove_acceptors", "sugar_donors", "sugar_acceptors", "pka", "pka_shifted", "north", "south", "polarity", "stacking", "charge", "hydroxyl")
BASES = {
    "A": (1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 3.5, 0.0, 0.80, 0.20, 0.82, 0.85, -1.0, 1.0),
    "C": (0.0, 1.0, 2.0, 0.0, 1.0, 0.0, 1.0, 4.2, 0.0, 0.78, 0.22, 0.61, 0.63, -1.0, 1.0),
    "G": (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 9.2, 0.0, 0.82, 0.18, 1.00, 1.00, -1.0, 1.0),
    "U": (0.0, 1.0, 2.0, 0.0, 1.0, 0.0, 1.0, 9.2, 0.0, 0.76, 0.24, 0.58, 0.55, -1.0, 1.0),
}
DEOXY_NORTH, DEOXY_SOUTH = 0.30, 0.70
#: The feature columns in order: base, modified or not, properties, class of modification, surroundings.
FEATURES = ("is_a", "is_c", "is_g", "is_u", "modified", *PROPERTIES, "methylated", "pseudouridine", "other_modified", "local_gc")


def encode_residues(residues: DataFrame, components: DataFrame) -> DataFrame:
    """Adds token, parent and mod_id to rows with `comp`: standard residues are themselves, DNA keeps its symbol, inosine is I;
    others take their component's parent and get the id of their modification (most frequent first), or are N."""
    ids = components.join(residues.groupBy("comp").agg(F.count("*").alias("_n")), "comp", "left").where("parent IS NOT NULL")
    ids = places(ids.withColumn("_n", F.coalesce("_n", F.lit(0))), [], [F.desc("_n"), F.col("comp")], "_mod", total="").select("comp", F.col("parent").alias("_parent"), (F.col("_mod") + 1).alias("_mod"))
    c = F.upper("comp")
    r = residues.join(ids, "comp", "left")
    dna = F.when(c == "DT", "DU").when(c.isin("DA", "DC", "DG", "DU"), c)
    token = F.when(c.isin("A", "C", "G", "U"), c).when(dna.isNotNull(), dna).when(c.isin("I", "DI"), "I").when(c == "UNK", "UNK").otherwise(F.coalesce("_parent", F.lit("N")))
    standard = c.isin("A", "C", "G", "U", "DT", "DA", "DC", "DG", "DU", "I", "DI", "UNK")
    r = r.withColumn("token", token).withColumn("mod_id", F.when(standard, 0).otherwise(F.coalesce("_mod", F.lit(0))))
    return r.withColumn("parent", F.when(F.substring("token", -1, 1).isin(*BASES), F.substring("token", -1, 1))).drop("_parent", "_mod")


def residue_chemistry(residues: DataFrame, components: DataFrame, half: int = 16) -> DataFrame:
    """Adds the 24 FEATURES to rows with entry, idx, comp, token, parent (see `encode_residues`).

    `components` (comp, name) gives the class of a modification. A residue that is not A, C, G or U is modified; one of
    unknown parent has the mean of the four bases. Pseudouridine has a donor more in the groove; the 5' end bears no charge; a
    DNA residue has no hydroxyl and a south sugar. local_gc is the share of G and C among the known parents within `half`
    places. pka_shifted is a label to be filled in by others, so it is 0.
    """
    kinds = components.groupBy(F.upper("comp").alias("_comp")).agg(F.min(F.when(F.trim("name") != "", classify_modification(F.col("name")))).alias("_class"))
    r = residues.withColumn("_comp", F.upper("comp")).join(kinds, "_comp", "left")
    modified = ~F.col("_comp").isin(*BASES)
    kind = F.when(modified, F.when(F.col("_class").isin("methylation", "pseudouridine"), F.col("_class")).otherwise("other"))
    deoxy = F.col("token").isin("DA", "DC", "DG", "DU")
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")

    def known(i: int) -> Column:
        out = F.lit(sum(v[i] for v in BASES.values()) / 4)
        for b, v in BASES.items():
            out = F.when(F.col("parent") == b, v[i]).otherwise(out)
        return out

    first = F.col("idx") == F.min("idx").over(Window.partitionBy("entry"))
    columns = {f"is_{b.lower()}": number(F.col("parent") == b) for b in BASES} | {"modified": number(modified)}
    columns |= {p: known(i) for i, p in enumerate(PROPERTIES)}
    columns["groove_donors"] = columns["groove_donors"] + number(kind == "pseudouridine")
    columns["charge"] = F.when(first, 0.0).otherwise(columns["charge"])
    columns["north"] = F.when(deoxy, DEOXY_NORTH).otherwise(columns["north"])
    columns["south"] = F.when(deoxy, DEOXY_SOUTH).otherwise(columns["south"])
    columns["hydroxyl"] = F.when(deoxy, 0.0).otherwise(columns["hydroxyl"])
    columns |= {"methylated": number(kind == "methylation"), "pseudouridine": number(kind == "pseudouridine"), "other_modified": number(kind == "other")}
    near = Window.partitionBy("entry").orderBy("idx").rowsBetween(-half, half)
    gc = F.try_divide(F.sum(number(F.col("parent").isin("G", "C"))).over(near), F.sum(number(F.col("parent").isin(*BASES))).over(near))
    columns["local_gc"] = F.coalesce(gc, F.lit(0.0))
    return r.select(*residues.columns, *[columns[f].alias(f) for f in FEATURES])


def modification_census(residues: DataFrame, names: DataFrame) -> DataFrame:
    """class, kinds, residues, share of the components (comp, name) that are not standard."""
    n = residues.where(~F.col("comp").isin("A", "C", "G", "U", "N")).groupBy("comp").agg(F.count("*").alias("n"))
    c = n.join(names, "comp", "left").withColumn("class", classify_modification(F.col("name")))
    t = c.groupBy("class").agg(F.count("*").alias("kinds"), F.sum("n").alias("residues"))
    return t.withColumn("share", F.col("residues") / F.sum("residues").over(Window.partitionBy()))


def entry_composition(residues: DataFrame) -> DataFrame:
    """entry, rna, protein, longest_rna, has_protein from rows with entry, chain, seq_id, ins, kind; residues count once."""
    r = residues.select("entry", "chain", "seq_id", "ins", "kind").distinct().groupBy("entry", "chain", "kind").agg(F.count("*").alias("n"))
    s = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    return r.groupBy("entry").agg(s("rna").alias("rna"), s("protein").alias("protein"), F.coalesce(F.max(F.when(F.col("kind") == "rna", F.col("n"))), F.lit(0)).alias("longest_rna"), (s("protein") > 0).alias("has_protein"))


def composition_population(entries: DataFrame, ribosome: tuple[int, int] = (1000, 1000), large: int = 4096) -> DataFrame:
    """entries, most_rna, over_large, in_complex, ribosome_like."""
    return entries.agg(
        F.count("*").alias("entries"), F.max("rna").alias("most_rna"), F.count_if(F.col("rna") > large).alias("over_large"), F.avg(F.col("has_protein").cast("double")).alias("in_complex"),
        F.count_if((F.col("rna") >= ribosome[0]) & (F.col("protein") >= ribosome[1])).alias("ribosome_like"),
    )


def longest_chain(chains: DataFrame) -> DataFrame:
    """entry, chain, length: the longest chain of each entry, the first in the file on ties."""
    w = Window.partitionBy("entry").orderBy(F.desc("length"), "file_order")
    return chains.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def buffer_audit(conditions: DataFrame) -> DataFrame:
    """ion, entries, share, median, p10 and p90 (index min(n - 1, int(p n))) from rows with entry and a map ions."""
    from ..functions.stats import nearest_rank

    total = conditions.agg(F.count("*").alias("_all"))
    e = conditions.select("entry", F.explode("ions").alias("ion", "mm"))
    s = e.groupBy("ion").agg(F.count("*").alias("entries"), F.median("mm").alias("median"))
    p = lambda q, n: nearest_rank(e, ["ion"], "mm", q).withColumnRenamed("mm", n)
    return s.join(p(0.1, "p10"), "ion").join(p(0.9, "p90"), "ion").join(F.broadcast(total)).withColumn("share", F.col("entries") / F.col("_all")).drop("_all")

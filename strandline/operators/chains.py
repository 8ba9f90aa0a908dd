"""Assembly of chain tables: label precedence, keyed residue joins, backbone picks, valid targets, blind-test listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def disorder_is_meaningful(length: Column, n_polymer: Column) -> Column:
    """True if the polymer's length is unknown, 0 or at most 200, else if it is at most three times the modelled length."""
    return F.when(n_polymer.isNull() | (n_polymer == 0) | (n_polymer <= 200), F.lit(True)).otherwise(n_polymer <= 3 * length)


def label_precedence(chains: DataFrame, by_chain: DataFrame, by_entry: DataFrame, label: str = "family") -> DataFrame:
    """Adds the chain's own label (entry, chain), else its entry's (entry), else null."""
    c = by_chain.select("entry", "chain", F.col(label).alias("_c"))
    e = by_entry.select("entry", F.col(label).alias("_e"))
    return chains.join(c, ["entry", "chain"], "left").join(e, "entry", "left").withColumn(label, F.coalesce("_c", "_e")).drop("_c", "_e")


def family_accession(df: DataFrame, families: DataFrame, name: str = "family") -> DataFrame:
    """Adds `accession` of families (accession, id) whose accession or id the name is."""
    keys = families.select("accession", F.explode(F.array_distinct(F.array("accession", "id"))).alias("_k")).groupBy("_k").agg(F.min("accession").alias("accession"))
    return df.join(keys, F.col(name) == F.col("_k"), "left").drop("_k")


def align_by_number(reference: DataFrame, model: DataFrame, key: str = "target") -> DataFrame:
    """key, chain, number, coordinates of both sides (x.. and m_x..): residues joined by (chain, number); where nothing meets and
    both sides have one chain, by number alone. The first residue (by file_pos) of a key counts."""
    def first(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(key, "chain", "number").orderBy("file_pos")
        return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

    r, m = first(reference), first(model)
    right = m.select(key, F.col("chain").alias("m_chain"), "number", *[F.col(c).alias(f"m_{c}") for c in "xyz"])
    met = r.join(right.withColumnRenamed("m_chain", "chain"), [key, "chain", "number"]).select(key, "chain", "number", "x", "y", "z", "m_x", "m_y", "m_z")
    one = lambda df: df.groupBy(key).agg(F.min("chain").alias("a"), F.max("chain").alias("b")).where("a = b").select(key)
    alone = one(r).join(one(m), key).join(met.select(key).distinct(), key, "left_anti")
    other = r.join(alone, key, "left_semi").join(right, [key, "number"]).select(key, "chain", "number", "x", "y", "z", "m_x", "m_y", "m_z")
    return met.unionByName(other)


def step_classes(steps: DataFrame, classes: DataFrame) -> DataFrame:
    """Steps (entry, chain, seq) with the pair class of that place, the last one mentioned (by row_no); null without one."""
    last = classes.groupBy("entry", "chain", "seq").agg(F.max_by("pair_class", "row_no").alias("pair_class"))
    return steps.join(last, ["entry", "chain", "seq"], "left")


def backbone(atoms: DataFrame, parents: DataFrame) -> DataFrame:
    """entry, chain, seq_id and P (px..), C4' (cx..), N9 or N1 (nx..) of each residue, the first by file_pos; null where missing.
    `parents` (comp, parent) tells purines; unknown components take N9 if they have it, else N1."""
    a = atoms.join(parents, "comp", "left")
    purine = F.col("parent").isin("A", "G")
    wanted = F.when(F.col("atom") == "P", "p").when(F.col("atom") == "C4'", "c").when((F.col("atom") == "N9") & F.coalesce(purine, F.lit(True)), "n").when((F.col("atom") == "N1") & ~F.coalesce(purine, F.lit(False)), "n")
    # An unknown residue's N9 stands before its N1.
    rank = F.struct((F.col("atom") == "N1").alias("late"), "file_pos")
    a = a.withColumn("_k", wanted).where("_k IS NOT NULL").withColumn("_o", rank)
    pick = lambda k, c: F.min_by(F.when(F.col("_k") == k, F.col(c)), F.when(F.col("_k") == k, F.col("_o"))).alias(k + c)
    return a.groupBy("entry", "chain", "seq_id").agg(*[pick(k, c) for k in "pcn" for c in "xyz"])


def valid_targets(residues: DataFrame, meta: DataFrame) -> DataFrame:
    """Residues (entry, idx, z, lw1) with the flags a trainer masks by: rigid (X-ray, finite z above -6), loop_known (the entry has a
    class-1 pair), disorder_known."""
    known = residues.groupBy("entry").agg(F.bool_or("lw1").alias("loop_known"), F.count("*").alias("_l"))
    j = residues.join(known, "entry").join(meta.select("entry", "method", "n_polymer"), "entry", "left")
    rigid = F.coalesce(F.upper("method").contains("X-RAY") & F.col("z").isNotNull() & ~F.isnan("z") & (F.col("z") > -6), F.lit(False))
    return j.withColumn("rigid", rigid).withColumn("disorder_known", disorder_is_meaningful(F.col("_l"), F.col("n_polymer"))).drop("_l", "method", "n_polymer")


def assemble_chains(meta: DataFrame, backbones: DataFrame, contacts: DataFrame, shortest: int = 32, longest: int = 4608, least_contacts: int = 8) -> DataFrame:
    """entry, chain, length, n_contacts, agrees (as many backbone rows as the length) of chains inside the window with enough contacts."""
    b = backbones.groupBy("entry", "chain").agg(F.count("*").alias("_b"))
    c = contacts.groupBy("entry", "chain").agg(F.count("*").alias("n_contacts"))
    j = meta.where(F.col("length").between(shortest, longest)).join(c, ["entry", "chain"]).where(F.col("n_contacts") >= least_contacts).join(b, ["entry", "chain"], "left")
    return j.select("entry", "chain", "length", "n_contacts", (F.coalesce("_b", F.lit(0)) == F.col("length")).alias("agrees"))


def blind_targets(files: DataFrame, descriptions: DataFrame) -> DataFrame:
    """target, kind (puzzle, casp), reference, competitors, description from paths such as '.../PZ7/solution.pdb', '.../PZ7/sub.pdb',
    '.../R1107/reference.pdb'; targets without a reference are left out."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    f = files.select("path", folder.alias("target"), name.alias("name")).where(F.col("name").rlike(r"\.(pdb|cif)$"))
    ref = F.col("name").rlike("solution|reference|native")
    t = f.groupBy("target").agg(F.min(F.when(ref, F.col("path"))).alias("reference"), F.count_if(~ref).alias("competitors"))
    t = t.where("reference IS NOT NULL").withColumn("kind", F.when(F.col("target").rlike(r"^R\d{4}"), "casp").otherwise("puzzle"))
    return t.join(descriptions.select("target", "description"), "target", "left")

"""Readers of line-oriented formats: plain Spark text scans, split and assembled by DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Paths = str | Sequence[str]


def _list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_fasta(spark: SparkSession, paths: Paths, limit: int | None = None) -> DataFrame:
    """path, header, sequence of FASTA files, plain or compressed.

    Records are split at '\\n>', so plain files are read by many tasks and a compressed one by its own. Text before
    the first '>' is dropped, wrapped sequence lines are joined. With `limit`, the first records by path and place.
    """
    raw = spark.read.option("lineSep", "\n>").text(_list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    # A file's first record keeps its '>'; what stands before it, if anything, is not a record.
    head = raw.groupBy("path").agg(F.min(F.struct("block", "place")).alias("_f"))
    r = raw.join(head, "path").withColumn("_first", (F.col("block") == F.col("_f.block")) & (F.col("place") == F.col("_f.place")))
    r = r.where(~F.col("_first") | F.col("value").startswith(">")).withColumn("value", F.when(F.col("_first"), F.expr("substring(value, 2)")).otherwise(F.col("value")))
    lines = F.split("value", "\r?\n")
    header = F.trim(F.element_at(lines, 1))
    sequence = F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), "")
    out = r.select("path", "block", "place", header.alias("header"), sequence.alias("sequence"))
    if limit is not None:
        out = out.orderBy("path", "block", "place").limit(limit)
    return out.select("path", "header", "sequence")


def read_stockholm(spark: SparkSession, paths: Paths) -> DataFrame:
    """path, family, accession, row_no, name, aligned, ss_cons: records end with '//', wrapped rows are joined by name in
    order of first sight; an accession's version is cut off."""
    rec = spark.read.option("lineSep", "//\n").text(_list(paths)).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("rec"), F.split("value", "\r?\n").alias("lines"))
    tag = lambda t: F.trim(F.regexp_extract(F.array_join("lines", "\n"), rf"(?m)^#=GF {t}\s+(.*)$", 1))
    head = rec.select("path", "rec", tag("ID").alias("family"), F.regexp_replace(tag("AC"), r"\..*$", "").alias("accession"), "lines")
    parts = F.transform(F.filter("lines", lambda x: x.startswith("#=GC SS_cons")), lambda x: F.regexp_extract(x, r"^#=GC SS_cons\s+(\S+)", 1))
    ss = F.array_join(parts, "")
    rows = head.select("path", "rec", "family", "accession", ss.alias("ss_cons"), F.posexplode("lines").alias("pos", "line")).where(F.col("line").rlike(r"^[^#\s]\S*\s+\S+\s*$"))
    cut = rows.select("path", "rec", "family", "accession", "ss_cons", "pos", F.regexp_extract("line", r"^(\S+)", 1).alias("name"), F.regexp_extract("line", r"^\S+\s+(\S+)", 1).alias("part"))
    joined = cut.groupBy("path", "rec", "family", "accession", "ss_cons", "name").agg(F.min("pos").alias("_first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda p: p["part"]), "").alias("aligned"))
    w = Window.partitionBy("path", "rec").orderBy("_first")
    return joined.select("path", "family", "accession", (F.row_number().over(w) - 1).alias("row_no"), "name", "aligned", "ss_cons")


def read_rdat(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """(files, rows): path, name, sequence, structure, offset, seqpos, annotations; and path, row, annotations,
    reactivity. A key ends at any white space, so both dialects are read. Files without reactivity have no rows."""
    t = spark.read.text(_list(paths)).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+", 2).alias("kv"))
    t = t.select("path", F.element_at("kv", 1).alias("key"), F.when(F.size("kv") > 1, F.trim(F.element_at("kv", 2))).otherwise("").alias("value"))
    one = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    numbers = F.transform(F.filter(F.split(one("SEQPOS"), r"\s+"), lambda x: x != ""), lambda x: F.regexp_extract(x, r"(-?\d+)$", 1).cast("int"))
    tags = F.filter(F.split(F.coalesce(one("ANNOTATION"), F.lit("")), r"\s+"), lambda x: x != "")
    files = t.groupBy("path").agg(one("NAME").alias("name"), one("SEQUENCE").alias("sequence"), one("STRUCTURE").alias("structure"), one("OFFSET").try_cast("int").alias("offset"), numbers.alias("seqpos"), tags.alias("annotations"))
    row = t.withColumn("row", F.regexp_extract("key", r"^(?:REACTIVITY|ANNOTATION_DATA):(\d+)$", 1).try_cast("int")).where("row IS NOT NULL")
    values = F.max(F.when(F.col("key").startswith("REACTIVITY"), F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))))
    notes = F.max(F.when(F.col("key").startswith("ANNOTATION_DATA"), F.split("value", r"\s+")))
    rows = row.groupBy("path", "row").agg(notes.alias("annotations"), values.alias("reactivity")).where("reactivity IS NOT NULL")
    return files, rows


def titration_examples(files: DataFrame, rows: DataFrame) -> DataFrame:
    """path, row, pos (in the sequence), reactivity: by SEQPOS - OFFSET - 1 where there are as many places as values, else
    the first values in order; places outside the sequence and values that are not finite are dropped."""
    j = rows.select("path", "row", "reactivity").join(files.select("path", "sequence", "offset", "seqpos"), "path")
    fits = F.size("seqpos") == F.size("reactivity")
    n = F.least(F.length("sequence"), F.size("reactivity"))
    place = F.when(fits, F.transform("seqpos", lambda p: p - F.coalesce("offset", F.lit(0)) - 1)).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: i - 1))
    e = j.select("path", "row", "sequence", F.explode(F.arrays_zip(place.alias("p"), F.col("reactivity").alias("v"))).alias("r"))
    v = F.col("r.v")
    return e.where((F.col("r.p") >= 0) & (F.col("r.p") < F.length("sequence")) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select("path", "row", F.col("r.p").alias("pos"), v.alias("reactivity"))


def read_front_matter(spark: SparkSession, paths: Paths, scalars: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """path and the named fields of a '---' block at a file's head: scalars as text, '[a, b]' lists as arrays."""
    t = spark.read.text(_list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---", 1).alias("head"))
    field = lambda k: F.trim(F.regexp_extract("head", rf"(?m)^\s*{k}:\s*(.*)$", 1))
    clean = lambda c: F.regexp_replace(F.trim(c), "^[\"']|[\"']$", "")
    items = lambda k: F.filter(F.transform(F.split(F.regexp_extract(field(k), r"^\[(.*)\]$", 1), ","), clean), lambda x: x != "")
    return t.select("path", *[F.nullif(clean(field(k)), F.lit("")).alias(k) for k in scalars], *[items(k).alias(k) for k in lists])


def read_cmscan(spark: SparkSession, paths: Paths) -> DataFrame:
    """chain, family, accession, score, evalue, pos of the included ('!') hits of a white-space table with at least 18 fields."""
    t = spark.read.text(_list(paths)).select(F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("v")).where(~F.col("v").startswith("#"))
    f = t.select("pos", F.split("v", r"\s+").alias("f")).where((F.size("f") >= 18) & (F.element_at("f", 17) == "!"))
    at = lambda i: F.element_at("f", i + 1)
    return f.select(at(2).alias("chain"), at(0).alias("family"), at(1).alias("accession"), at(14).try_cast("double").alias("score"), at(15).try_cast("double").alias("evalue"), "pos")


def read_pdb_atoms(spark: SparkSession, paths: Paths) -> DataFrame:
    """entry, chain, seq_id, ins, comp, atom, element, x, y, z, b, model, file_pos of fixed-width ATOM and HETATM lines."""
    t = spark.read.text(_list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    kind = F.trim(F.substring("value", 1, 6))
    t = t.where(kind.isin("ATOM", "HETATM", "MODEL"))
    w = Window.partitionBy("path").orderBy("block", "place")
    t = t.withColumn("file_pos", F.row_number().over(w)).withColumn("model", F.greatest(F.lit(1), F.count_if(kind == "MODEL").over(w)))
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    number = lambda a, n: cut(a, n).try_cast("double")
    entry = F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1)
    return t.where(kind != "MODEL").select(
        entry.alias("entry"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("seq_id"), cut(27, 1).alias("ins"), cut(18, 3).alias("comp"), cut(13, 4).alias("atom"),
        cut(77, 2).alias("element"), number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"), number(61, 6).alias("b"), "model", "file_pos",
    )


def read_ccd(spark: SparkSession, paths: Paths, wanted: DataFrame | None = None, tags: Sequence[str] = ("_chem_comp.name", "_chem_comp.type", "_chem_comp.mon_nstd_parent_comp_id")) -> DataFrame:
    """comp and the named tags (quoted, plain or between ';' lines) of each 'data_' block; only `wanted` (comp) if given."""
    t = spark.read.option("lineSep", "\ndata_").text(_list(paths)).select(F.regexp_replace("value", "^data_", "").alias("v"))
    t = t.select(F.regexp_extract("v", r"^(\S+)", 1).alias("comp"), "v").where("comp <> ''")
    if wanted is not None:
        t = t.join(wanted.select("comp"), "comp", "left_semi")

    def value(tag: str) -> Column:
        name = tag.replace(".", r"\.")
        block = F.regexp_extract("v", rf"(?s){name}\s*\n;(.*?)\n;", 1)
        plain = F.trim(F.regexp_extract("v", rf"(?m)^{name}[ \t]+(.+)$", 1))
        text = F.when(block != "", F.trim(block)).otherwise(F.regexp_replace(plain, "^[\"'](.*)[\"']$", "$1"))
        return F.when(text.isin("", "?", "."), None).otherwise(text)

    return t.select("comp", *[value(x).alias(x.split(".")[-1]) for x in tags])

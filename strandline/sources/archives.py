"""Readers of archives and structure files: `binaryFile` scans and one small parser per file in the tasks."""

from __future__ import annotations

import gzip
import io
import itertools
import re
import tarfile
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .text import Paths, _list


def files(spark: SparkSession, paths: Paths, content: bool = True, skip: str = r"/(\.git|\.cache)/") -> DataFrame:
    """path, size_bytes, modified and, if asked for, content; folders are read through."""
    prepare(spark)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_list(paths))
    f = f.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return f.where(~F.col("path").rlike(skip))


def checksums(spark: SparkSession, paths: Paths, most: int = 50_000_000) -> DataFrame:
    """path, size_bytes, sha256 (null for files over `most` bytes, which are not read)."""
    small = files(spark, paths).where(F.col("size_bytes") <= most).select("path", F.sha2("content", 256).alias("sha256"))
    return files(spark, paths, content=False).select("path", "size_bytes").join(small, "path", "left")


def _fasta(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    header, parts = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if header is not None:
                yield header, "".join(parts)
            header, parts = line[1:].strip(), []
        elif header is not None:
            parts.append(line)
    if header is not None:
        yield header, "".join(parts)


def read_tar_fasta(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """(records, status): path, member, header, sequence; and path, records, truncated. What a broken archive still gave is kept.
    An archive is one value in its task, which Spark holds to 2 GB; `stream_tar_fasta` reads larger ones."""

    def run(frames):
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                n, broken = 0, False
                try:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:
                        for member in tar:
                            if not (f := tar.extractfile(member)):
                                continue
                            for header, sequence in _fasta(line.decode("utf-8", "replace") for line in f):
                                rows.append((path, member.name, header, sequence, None, None))
                                n += 1
                except (tarfile.TarError, EOFError, OSError, gzip.BadGzipFile):
                    broken = True
                rows.append((path, None, None, None, n, broken))
            yield pd.DataFrame(rows, columns=["path", "member", "header", "sequence", "records", "truncated"])

    out = files(spark, paths).select("path", "content").mapInPandas(run, "path string, member string, header string, sequence string, records long, truncated boolean")
    return out.where("records IS NULL").drop("records", "truncated"), out.where("records IS NOT NULL").select("path", "records", "truncated")


#: A tar header's block, its magic word and where that, a name, a mode, a prefix and a kind stand in it.
TAR_BLOCK, TAR_MAGIC, MAGIC_AT, NAME_AT, MODE_AT, PREFIX_AT, KIND_AT = 512, "ustar", 257, (0, 100), (100, 108), (345, 500), 156
_MODE = re.compile(r"[0-7 ]{6,7}[ \0]{1,2}")


def _tar_lines(lines: Iterator[str]) -> Iterator[tuple[str | None, str]]:
    """(member, line) of a tar's text read as lines: a header block and the zeros before it are part of the line that
    they stand in. Names of kinds other than plain files are None."""
    member = None
    for line in lines:
        at = line.find(TAR_MAGIC, MAGIC_AT) if "\0" in line else -1
        start = 0
        while at >= 0:
            head = at - MAGIC_AT
            if head < start or not _MODE.fullmatch(line[head + MODE_AT[0] : head + MODE_AT[1]]):
                at = line.find(TAR_MAGIC, at + 1)
                continue
            if left := line[start:head].strip("\0"):
                yield member, left
            block = line[head : head + TAR_BLOCK]
            name, prefix = (block[slice(*p)].split("\0")[0] for p in (NAME_AT, PREFIX_AT))
            member = (f"{prefix}/{name}" if prefix else name) if block[KIND_AT : KIND_AT + 1] in ("0", "\0", "") else None
            start = head + TAR_BLOCK
            at = line.find(TAR_MAGIC, start + MAGIC_AT)
        yield member, line[start:].strip("\0")


def stream_tar_fasta(spark: SparkSession, paths: Paths) -> DataFrame:
    """path, member, header, sequence of gzipped tars ('.tar.gz') of any size: Spark unpacks and reads them as text, a task an
    archive, and nothing but a record is held at once. What a broken archive gave before its break is kept.

    Members' lines must be UTF-8 text, and the tars of the POSIX kind, whose headers name themselves.
    """
    wrong = [p for p in _list(paths) if not p.rstrip("/").endswith(".gz") and p.rsplit("/", 1)[-1].count(".")]
    if wrong:
        raise ValueError(f"only gzipped archives are read by one task each: {wrong[0]}")
    prepare(spark)
    rows = spark.read.option("ignoreCorruptFiles", "true").text(_list(paths)).select("_metadata.file_path", "value")

    def run(batches):
        path = member = header = None
        parts: list[str] = []
        out: list[tuple] = []

        def flat():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        for path_now, group in itertools.groupby(flat(), key=lambda r: r[0]):
            path, member, header, parts = path_now, None, None, []
            for member_now, line in _tar_lines(line for _, line in group):
                line = line.strip()
                if line.startswith(">") or member_now != member:
                    if header is not None:
                        out.append((path, member, header, "".join(parts)))
                    member, header, parts = member_now, None, []
                if line.startswith(">") and member is not None:
                    header = line[1:].strip()
                elif header is not None:
                    parts.append(line)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["path", "member", "header", "sequence"])
                    out = []
            if header is not None:
                out.append((path, member, header, "".join(parts)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["path", "member", "header", "sequence"])

    return rows.mapInArrow(run, "path string, member string, header string, sequence string")


def read_zip_csv(spark: SparkSession, paths: Paths) -> DataFrame:
    """assay (a .csv member's stem), row, fields (map) of every CSV in the archives."""

    def run(frames):
        for pdf in frames:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in (n for n in z.namelist() if n.endswith(".csv")):
                        t = pd.read_csv(z.open(name), dtype=str, encoding="utf-8-sig")
                        fields = [{k: v for k, v in r.items() if isinstance(v, str)} for r in t.to_dict("records")]
                        yield pd.DataFrame({"assay": [name.rsplit("/", 1)[-1][:-4]] * len(t), "row": range(len(t)), "fields": fields})

    return files(spark, paths).select("content").mapInPandas(run, "assay string, row long, fields map<string,string>")


def archive_ids(spark: SparkSession, paths: Paths, suffix: str = ".cif") -> DataFrame:
    """id: four-character ids, upper case, of archive members with the suffix."""

    def run(frames):
        for pdf in frames:
            ids = []
            for content in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:
                    ids += [m[1].upper() for x in tar if (m := re.fullmatch(rf"(?:.*/)?([A-Za-z0-9]{{4}}){re.escape(suffix)}(?:\.gz)?", x.name))]
            yield pd.DataFrame({"id": pd.Series(ids, dtype=str)})

    return files(spark, paths).select("content").mapInPandas(run, "id string").distinct()


def _text(content: bytes) -> str:
    return (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8", "replace")


_TOKEN = re.compile(r"'(?:[^']|'(?=\S))*'|\"(?:[^\"]|\"(?=\S))*\"|[^\s#]\S*")


def _cif_rows(text: str, wanted: Sequence[str]) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(category, row number, tag -> value) of the wanted categories, whether loops or single values."""
    lines = iter(text.split("\n"))
    tags: list[str] = []
    values: list[str] = []
    single: dict[str, dict[str, str]] = {}
    looping, pending, numbers = False, None, {}

    def rows() -> Iterator[tuple[str, int, dict[str, str]]]:
        if tags and (category := tags[0].split(".")[0]) in wanted:
            for at in range(0, len(values) - len(tags) + 1, len(tags)):
                numbers[category] = numbers.get(category, -1) + 1
                yield category, numbers[category], {t.split(".", 1)[1]: v for t, v in zip(tags, values[at : at + len(tags)], strict=True)}

    for line in lines:
        if line.startswith(";"):
            part = [line[1:]]
            for more in lines:
                if more.startswith(";"):
                    break
                part.append(more)
            tokens = ["\n".join(part).strip()]
        else:
            tokens = [t[1:-1] if t[0] in "'\"" and len(t) > 1 and t[-1] == t[0] else t for t in _TOKEN.findall(line)] if not line.startswith("#") else None
        if tokens is None or tokens and tokens[0] == "loop_":
            yield from rows()
            tags, values, looping, pending = [], [], tokens is not None, None
            continue
        for t in tokens:
            if t.startswith("_") and not line.startswith(";") and (looping and not values or pending is None and not looping or t.split(".")[0] != (tags[0].split(".")[0] if tags else "")):
                if looping and values:
                    yield from rows()
                    tags, values, looping = [], [], False
                if looping:
                    tags.append(t)
                else:
                    pending = t
            elif pending is not None:
                category, _, tag = pending.partition(".")
                if category in wanted:
                    single.setdefault(category, {})[tag] = t
                pending = None
            elif looping and (not tags or tags[0].split(".")[0] in wanted):
                values.append(t)
            elif looping:
                values = values or [""]
    yield from rows()
    for category, fields in single.items():
        yield category, numbers.get(category, -1) + 1, fields


def read_mmcif(spark: SparkSession, paths: Paths, wanted: Sequence[str]) -> DataFrame:
    """entry, category, row_no, fields (map): rows of the wanted mmCIF categories, one parse per file."""
    names = list(wanted)

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                entry = re.sub(r"(\.[A-Za-z0-9]+)+$", "", path.rsplit("/", 1)[-1])
                rows = [(entry, c, n, f) for c, n, f in _cif_rows(_text(content), names)]
                yield pd.DataFrame(rows, columns=["entry", "category", "row_no", "fields"])

    return files(spark, paths).select("path", "content").mapInPandas(run, "entry string, category string, row_no long, fields map<string,string>")


def mmcif_atoms(rows: DataFrame) -> DataFrame:
    """The atom table (entry, chain, seq_id, ins, comp, atom, element, x, y, z, b, model, file_pos) of `_atom_site` rows."""
    f = lambda k: F.try_element_at("fields", F.lit(k))
    n = lambda k: f(k).try_cast("double")
    ins = F.when(f("pdbx_PDB_ins_code").isin("?", "."), "").otherwise(F.coalesce(f("pdbx_PDB_ins_code"), F.lit("")))
    return rows.where("category = '_atom_site'").select(
        "entry", f("auth_asym_id").alias("chain"), f("label_seq_id").try_cast("int").alias("seq_id"), ins.alias("ins"), f("label_comp_id").alias("comp"), f("label_atom_id").alias("atom"), f("type_symbol").alias("element"),
        n("Cartn_x").alias("x"), n("Cartn_y").alias("y"), n("Cartn_z").alias("z"), n("B_iso_or_equiv").alias("b"), F.coalesce(f("pdbx_PDB_model_num").try_cast("int"), F.lit(1)).alias("model"), F.col("row_no").alias("file_pos"),
    )


def mmcif_entities(rows: DataFrame) -> DataFrame:
    """entry, chain, poly_type: strands of `_entity_poly`, a row for each chain."""
    f = lambda k: F.try_element_at("fields", F.lit(k))
    r = rows.where("category = '_entity_poly'").select("entry", F.explode(F.split(f("pdbx_strand_id"), ",")).alias("chain"), f("type").alias("poly_type"))
    return r.select("entry", F.trim("chain").alias("chain"), "poly_type")


def base_pair_annotations(rows: DataFrame) -> DataFrame:
    """entry, chain, i, j, lw, saenger: pairs inside one chain, i < j, class 1 to 12 or 0, the last mention wins. Chains go by
    the author's name, where that is missing by the label's."""
    f = lambda k: F.try_element_at("fields", F.lit(k))
    a, b = f("i_label_seq_id").try_cast("int"), f("j_label_seq_id").try_cast("int")
    lw = f("hbond_type_12").try_cast("int")
    named = lambda side: F.coalesce(F.nullif(f(f"{side}_auth_asym_id"), F.lit("")), f(f"{side}_label_asym_id"))
    p = rows.where("category = '_ndb_struct_na_base_pair'").where((named("i") == named("j")) & a.isNotNull() & b.isNotNull() & (a != b))
    p = p.select("entry", named("i").alias("chain"), F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), F.when(lw.between(1, 12), lw).otherwise(0).alias("lw"), f("hbond_type_28").alias("saenger"), "row_no")
    return p.groupBy("entry", "chain", "i", "j").agg(F.max_by("lw", "row_no").alias("lw"), F.max_by("saenger", "row_no").alias("saenger"))


def integrity(spark: SparkSession, paths: Paths, least: int = 1) -> DataFrame:
    """path, kind, status (OK, FAIL, SKIP), detail: every archive is opened and read through; a stray '.part' fails."""

    def probe(path: str, content: bytes) -> tuple[str, str, str]:
        if path.endswith(".part"):
            return "part", "FAIL", "left over"
        if len(content) < least:
            return "any", "FAIL", f"{len(content)} bytes"
        try:
            if path.endswith((".tgz", ".tar.gz", ".tar")):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as t:
                    return "tar", "OK", f"{sum(1 for _ in t)} members"
            if path.endswith(".gz"):
                return "gzip", "OK", f"{len(gzip.decompress(content))} bytes"
            if path.endswith(".zip"):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    bad = z.testzip()
                    return "zip", "FAIL" if bad else "OK", bad or f"{len(z.namelist())} members"
            if path.endswith(".parquet"):
                import pyarrow.parquet as pq

                return "parquet", "OK", f"{pq.ParquetFile(io.BytesIO(content)).metadata.num_rows} rows"
        except Exception as e:  # any way of being broken is the finding
            return "any", "FAIL", type(e).__name__
        return "any", "SKIP", ""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(p, *probe(p, c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=["path", "kind", "status", "detail"])

    return files(spark, paths).select("path", "content").mapInPandas(run, "path string, kind string, status string, detail string")


def valid_entries(spark: SparkSession, paths: Paths, least: int = 400) -> DataFrame:
    """path, valid: at least `least` bytes, unpacks, and holds an atom table."""

    @F.pandas_udf("boolean")
    def good(content: pd.Series) -> pd.Series:
        def one(c: bytes) -> bool:
            try:
                return len(c) >= least and "_atom_site" in _text(c)
            except (OSError, EOFError):
                return False

        return content.map(one)

    return files(spark, paths).select("path", good("content").alias("valid"))

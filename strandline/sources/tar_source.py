"""A data source of FASTA records in tar archives of any size, plain or gzipped, that tells which archives are cut short.

    register(spark)
    spark.read.format("tar_fasta").load("/data/archives/*.tar.gz")
"""

from __future__ import annotations

import fnmatch
import gzip
import re
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..session import prepare

SCHEMA = "path string, member string, header string, sequence string, records long, truncated boolean"
BATCH_ROWS, TAIL_BYTES = 5000, 512


class Tail:
    """A stream that remembers the last block it gave: a whole tar ends with zeros."""

    def __init__(self, stream) -> None:
        self.stream, self.last = stream, b""

    def read(self, n: int = -1) -> bytes:
        data = self.stream.read(n)
        self.last = (self.last + data)[-TAIL_BYTES:] if len(data) < TAIL_BYTES else data[-TAIL_BYTES:]
        return data

    def ended(self) -> bool:
        return len(self.last) == TAIL_BYTES and not any(self.last)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def matching(path: str) -> list[str]:
    """The files that a path, a folder or a glob in the last part of a path names, in order."""
    folder, _, name = path.rstrip("/").rpartition("/")
    system, at = file_system(folder if any(c in name for c in "*?[") else path)
    scheme = path[: len(path) - len(path.split("://", 1)[-1])] if "://" in path and not path.startswith("file:") else ""
    if any(c in name for c in "*?["):
        found = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, name)]
    elif system.get_file_info(at).type == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File]
    else:
        found = [at]
    return [scheme + f for f in sorted(found)]


def records_of(path: str) -> Iterator[tuple]:
    """(path, member, header, sequence, None, None) of each record, then (path, None, None, None, records, truncated).

    The archive is read as a stream: what is held is one record. What a broken archive gave before its break is kept.
    """
    system, at = file_system(path)
    n, broken = 0, False
    with system.open_input_stream(at, compression=None) as raw:
        packed = raw.read(2)
    with system.open_input_stream(at, compression=None) as raw:
        stream = Tail(gzip.GzipFile(fileobj=raw, mode="rb") if packed == b"\x1f\x8b" else raw)
        try:
            with tarfile.open(fileobj=stream, mode="r|") as tar:
                for member in tar:
                    if not (file := tar.extractfile(member)):
                        continue
                    header, parts = None, []
                    for line in file:
                        text = line.decode("utf-8", "replace").strip()
                        if not text.startswith(">"):
                            if header is not None:
                                parts.append(text)
                            continue
                        if header is not None:
                            n += 1
                            yield path, member.name, header, "".join(parts), None, None
                        header, parts = text[1:].strip(), []
                    if header is not None:
                        n += 1
                        yield path, member.name, header, "".join(parts), None, None
            broken = not stream.ended()
        except (tarfile.TarError, EOFError, OSError, gzip.BadGzipFile, zlib.error):
            broken = True
    yield path, None, None, None, n, broken


class Archive(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class TarFastaReader(DataSourceReader):
    """A partition for each archive; an equality on `path` leaves the other archives unopened."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            yield f

    def partitions(self) -> list[Archive]:
        found = [f for p in self.paths for f in matching(p)]
        return [Archive(f) for f in dict.fromkeys(found) if self.only is None or f in self.only]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.bool_()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows: list[tuple] = []
        for row in records_of(partition.path):
            rows.append(row)
            if len(rows) >= BATCH_ROWS or row[4] is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []


class TarFasta(DataSource):
    """Records, and for each archive a last row with the number of its records and whether it is cut short."""

    @classmethod
    def name(cls) -> str:
        return "tar_fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarFastaReader:
        return TarFastaReader([p for p in self.options.get("path", "").split(",") if p])


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarFasta)


def read_archives(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, status): path, member, header, sequence; and path, records, truncated, of archives of any size."""
    register(spark)
    table = spark.read.format("tar_fasta").load(",".join([paths] if isinstance(paths, str) else paths))
    return table.where("records IS NULL").drop("records", "truncated"), table.where("records IS NOT NULL").select("path", "records", "truncated")

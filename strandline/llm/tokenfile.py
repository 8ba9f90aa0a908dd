"""Binary token files: documents' ids compressed one by one with a shared zstandard dictionary, and an offset index.

A file is HEADER, the documents' frames in a row, the index, TRAILER. The header names the bytes of an id and the SHA-256
of the dictionary, which lies beside the files; the index (compressed) holds for each document its id, whether that is
null, where its frame ends and how many ids it has, in the files' order; the trailer says where the index begins. So one
document is read by its place in two short reads, whatever the file's length.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, prepare, scratch_root
from . import bytebpe

MAGIC = b"STRDIDS1"
HEADER, TRAILER = struct.Struct("<8sB32s"), struct.Struct("<QQ8s")
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("stop", "<u8"), ("n_ids", "<u8")])
#: The dictionary's bytes; the documents it is trained on, and the most ids that one of them may have.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_IDS = 64 << 10, 2048, 8192
#: Bytes of frames that are read, and of ids that are held, together.
READ_BYTES = 4 << 20
MANIFEST = "part int, file string, n_docs long, n_ids long, n_bytes long"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a local path or a URI that Arrow knows (file, hdfs, s3, gs)."""
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most `size` bytes; too few samples to train on are themselves the dictionary."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes, digest: bytes | None = None) -> zstandard.ZstdCompressionDict | None:
    if digest is not None and hashlib.sha256(raw).digest() != digest:
        raise ValueError("the file was written with another dictionary")
    return zstandard.ZstdCompressionDict(raw) if raw else None


class FileWriter:
    """Writes one token file; `add` takes documents in their order."""

    def __init__(self, path: str, dictionary: bytes, width: int, level: int = 3) -> None:
        system, at = open_folder(path)
        self.out = system.open_output_stream(at)
        known = _dictionary(dictionary)
        self.frame = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        self.kind, self.index, self.n_ids, self.at = np.dtype(f"<u{width}"), [], 0, HEADER.size
        self.out.write(HEADER.pack(MAGIC, width, hashlib.sha256(dictionary).digest()))

    def add(self, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, width = memoryview(ids.astype(self.kind)).cast("B"), self.kind.itemsize
        sizes = np.diff(ends, prepend=0)
        stops = (np.cumsum(sizes) * width).tolist()
        frames = [self.frame.compress(raw[a:b]) for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        rows = np.zeros(len(frames), dtype=INDEX)
        rows["doc_id"], rows["null"] = [i or 0 for i in doc_ids], [i is None for i in doc_ids]
        rows["stop"], rows["n_ids"] = self.at + np.cumsum([len(f) for f in frames]), sizes
        self.out.write(b"".join(frames))
        self.index.append(rows)
        self.at, self.n_ids = int(rows["stop"][-1]), self.n_ids + int(sizes.sum())

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) of the file, which is whole only now."""
        index = np.concatenate(self.index) if self.index else np.empty(0, dtype=INDEX)
        packed = zstandard.ZstdCompressor(level=3).compress(index.tobytes())
        self.out.write(packed + TRAILER.pack(self.at, len(index), MAGIC))
        self.out.close()
        return len(index), self.n_ids, self.at + len(packed) + TRAILER.size


class FileReader:
    """Random access to the documents of one token file."""

    def __init__(self, path: str, dictionary: bytes) -> None:
        system, at = open_folder(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        if size < HEADER.size + TRAILER.size:
            raise ValueError(f"{path} is cut short")
        magic, width, digest = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        begin, n, end_magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or end_magic != MAGIC:
            raise ValueError(f"{path} is no whole token file")
        self.kind = np.dtype(f"<u{width}")
        self.frame = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary, digest))
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read_at(size - TRAILER.size - begin, begin)), dtype=INDEX)
        if len(self.index) != n:
            raise ValueError(f"{path} has an index of other length")
        self.starts = np.append(HEADER.size, self.index["stop"][:-1].astype(np.int64))[:n]

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at `place`."""
        start = int(self.starts[place])
        raw = self.frame.decompress(self.file.read_at(int(self.index["stop"][place]) - start, start))
        if len(raw) != int(self.index["n_ids"][place]) * self.kind.itemsize:
            raise ValueError(f"document {place} has other ids than its index says")
        return np.frombuffer(raw, dtype=self.kind)

    def blocks(self) -> Iterator[tuple[int, list[bytes]]]:
        """(first place, little-endian 32-bit ids of each document) of stretches of about READ_BYTES bytes of ids."""
        at = 0
        held = np.cumsum(self.index["n_ids"].astype(np.int64)) * 4
        while at < len(self.index):
            until = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + READ_BYTES)))
            start = int(self.starts[at])
            data = memoryview(self.file.read_at(int(self.index["stop"][until - 1]) - start, start))
            cuts = [start, *self.index["stop"][at:until].tolist()]
            raw = [self.frame.decompress(data[a - start : b - start]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if [len(r) // self.kind.itemsize for r in raw] != self.index["n_ids"][at:until].tolist():
                raise ValueError("a document has other ids than its index says")
            yield at, [np.frombuffer(r, dtype=self.kind).astype("<u4").tobytes() for r in raw]
            at = until

    def close(self) -> None:
        self.file.close()


class TokenFiles:
    """Written token files: their folder, dictionary and manifest (MANIFEST, with `start`: ids of all files before)."""

    def __init__(self, folder: str, dictionary: bytes, manifest: DataFrame) -> None:
        self.folder, self.dictionary = folder, dictionary
        # A row for each file.
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        self.manifest = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))

    def read(self, ids: bool = False) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with `ids` the ids themselves
        (array<int>): a row for each document, from the files alone."""
        dictionary = self.dictionary
        types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * ids
        names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]

        def run(batches):
            for batch in batches:
                for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    reader = FileReader(path, dictionary)
                    starts = first + np.append(0, np.cumsum(reader.index["n_ids"].astype(np.int64)))
                    for at, raw in reader.blocks():
                        rows = reader.index[at : at + len(raw)]
                        doc_ids = pa.array(rows["doc_id"], pa.int64(), mask=rows["null"].astype(bool))
                        columns = [doc_ids, pa.array(starts[at : at + len(raw)]), pa.array(rows["n_ids"].astype(np.int64)), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                        if ids:
                            columns.append(pa.array([np.frombuffer(r, dtype="<i4") for r in raw], types[4]))
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                    reader.close()

        n_files = self.manifest.count()
        files = self.manifest.select("file", "start").repartition(max(1, n_files))
        return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def _sample(docs: DataFrame, tokenizer_path: str, end_id: int, width: int) -> list[bytes]:
    """The ids of at most SAMPLE_DOCS different documents of at most SAMPLE_IDS ids, chosen by hash, as bytes."""
    every = max(1, docs.count() // SAMPLE_DOCS)

    def run(batches):
        for batch in batches:
            for first, ids, ends in bytebpe.encode_blocks(batch.column(1), tokenizer_path, end_id):
                parts = [p.astype(f"<u{width}").tobytes() if len(p) <= SAMPLE_IDS else None for p in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(parts)], pa.array(parts, pa.binary())], names=["h", "raw"])

    chosen = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.pmod("h", F.lit(every)) == 0)
    found = chosen.mapInArrow(run, "h long, raw binary").where(F.col("raw").isNotNull()).dropDuplicates(["h"])
    return [bytes(r["raw"]) for r in found.orderBy("h").limit(SAMPLE_DOCS).collect()]


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, level: int = 3) -> TokenFiles:
    """Encodes every whole text, closes it with `end_id` and writes the ids in ascending doc_id order.

    Null ids stand first, rows of one id in the order of their texts' hashes; a null or empty text is its end id alone; repeated
    rows are written each; other columns are left out; an empty table makes no documents. Ids take two bytes where
    the tokenizer has at most 65,536, else four.

    The rows are dealt to ranges of (doc_id, hash), and each task writes one file under a name of its own. The
    manifest, stored by Spark's own committer, names the files that count: what a lost or repeated task left
    behind is in no manifest, so it is never read. The dictionary is trained on a bounded sample (`_sample`); everything else
    reads all rows.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or f"{scratch_root(spark)}/strandline-tokens-{uuid.uuid4().hex}"
    system, at = open_folder(folder)
    system.create_dir(at, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 2 if max(bytebpe.encoder(tokenizer_path).top, end_id) < 1 << 16 else 4
    dictionary = train_dictionary(_sample(docs, tokenizer_path, end_id, width))
    with system.open_output_stream(f"{at}/{hashlib.sha256(dictionary).hexdigest()}.dictionary") as out:
        out.write(dictionary)

    def run(batches):
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        writer = None
        for batch in batches:
            if batch.num_rows:
                writer = writer or FileWriter(path, dictionary, width, level)
                doc_ids = batch.column(0).to_pylist()
                for first, ids, ends in bytebpe.encode_blocks(batch.column(1), tokenizer_path, end_id):
                    writer.add(doc_ids[first : first + len(ends)], ids, ends)
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), *[pa.array([n], pa.int64()) for n in writer.close()]], names=[c.split()[0] for c in MANIFEST.split(", ")])

    order = ["doc_id", "_h"]
    ranged = docs.withColumn("_h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return TokenFiles(folder, dictionary, materialize(ranged.select("doc_id", "text").mapInArrow(run, MANIFEST), "manifest"))


def open_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> TokenFiles:
    """Token files written before, by their folder and stored manifest."""
    prepare(spark)
    system, at = open_folder(folder)
    names = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".dictionary")]
    if len(names) != 1:
        raise ValueError(f"{folder} does not hold one dictionary")
    with system.open_input_file(names[0]) as file:
        return TokenFiles(folder, file.read(), manifest)

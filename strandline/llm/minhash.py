"""Near-duplicate documents by MinHash banding, checked on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, prepare
from .components import connected_components
from .skew import join_many, pairs_within
from .words import WORD, WordIds, hashed_words, mix, text_bytes

#: Shingles handled at once: small enough for the processor's cache; longs of a set's bitmap.
BLOCK, BITMAP_LONGS = 1 << 16, 16
_IDS = WordIds()


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's `width`-word shingles (A-Z lowered).

    Fewer words make one shingle of the whole sequence; no words make none.
    """
    words = hashed_words(text, _IDS).astype(np.uint64)
    n = len(words)
    if n == 0:
        return words
    span = min(n, width)
    x = np.full(n - span + 1, span, dtype=np.uint64)
    for i in range(span):
        x = mix(x ^ words[i : n - span + 1 + i]) if span < width else x * np.uint64(0x9E3779B97F4A7C15) + words[i : n - span + 1 + i]
    return np.unique(mix(x))


def signatures(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(documents, hashes) minima of the multiply-add-shift hashes of nonempty sets."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    x = np.concatenate(sets)
    out = np.empty((len(a), len(sets)), dtype=np.uint32)
    buffer = np.empty_like(x)
    for i in range(len(a)):
        np.multiply(x, a[i], out=buffer)
        np.add(buffer, b[i], out=buffer)
        out[i] = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
    return out.T


def _hashes(bands: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed))
    a = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)


def _blocks(sets: list[np.ndarray]):
    """Index ranges of about BLOCK shingles each."""
    start = size = 0
    for i, s in enumerate(sets):
        size += len(s)
        if size >= BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sets):
        yield start, len(sets)


def _node(s: np.ndarray) -> int:
    """A set's 64-bit digest: equal sets, and only they (up to hash accidents), share it."""
    return int(np.int64(mix(np.array([mix(s * np.uint64(0x9E3779B97F4A7C15)).sum() + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0]))


def bitmap(s: np.ndarray) -> np.ndarray:
    """BITMAP_LONGS longs: of each bit the parity of the shingles that fall on it. A shingle that only one of two sets has
    changes one bit at most, so their bitmaps differ in no more bits than the sets in shingles."""
    odd = np.bincount((mix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(40)).astype(np.int64) % (64 * BITMAP_LONGS), minlength=64 * BITMAP_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def _band_matrix(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) keys of signatures."""
    spread = mix(np.arange(1, rows + 1, dtype=np.uint64))
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(1 << 32))
    return mix((sig.astype(np.uint64).reshape(len(sig), bands, rows) * spread).sum(axis=2, dtype=np.uint64) ^ salt).view(np.int64)


def band_keys(docs: DataFrame, bands: int, rows: int, width: int, seed: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (the set's digest, null if empty), bands (array of keys)."""

    def run(batches):
        a, b = _hashes(bands, rows, seed)
        for batch in batches:
            sets = [shingle_set(t, width) for t in text_bytes(batch.column(2))]
            keys: list = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            some = [sets[i] for i in full]
            for lo, hi in _blocks(some):
                block = _band_matrix(signatures(some[lo:hi], a, b), bands, rows)
                for k in range(lo, hi):
                    keys[full[k]] = block[k - lo]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "node", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, text_key long, n_shingles long, node long, bands array<long>")


def full_sets(docs: DataFrame, bands: int, rows: int, width: int, seed: int) -> DataFrame:
    """node, n, bitmap, bands, shingles (arrays of long) of each text that has words."""

    def run(batches):
        a, b = _hashes(bands, rows, seed)
        for batch in batches:
            sets = [s for s in (shingle_set(t, width) for t in text_bytes(batch.column(0))) if len(s)]
            for lo, hi in _blocks(sets):
                part = sets[lo:hi]
                keys = _band_matrix(signatures(part, a, b), bands, rows)
                lists = (list(map(bitmap, part)), list(keys), [s.view(np.int64) for s in part])
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in part], pa.int64()), pa.array(map(len, part), pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in lists]], names=["node", "n", "bitmap", "bands", "shingles"])

    return docs.mapInArrow(run, "node long, n long, bitmap array<long>, bands array<long>, shingles array<long>")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of their full sets (n_a, n_b) and of what they share (both)."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("set_b"))
    # A pivot may have a great many neighbours, a neighbour has few pivots.
    met = join_many(pairs, one, ["a"]).join(two, "b")
    return met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).alias("both"))


def similar(percent: int) -> Column:
    """100 * intersection >= percent * union."""
    return F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent


def may_be_similar(percent: int) -> Column:
    """Whether sets of n_a and n_b shingles with bitmap_a and bitmap_b can be similar: their sizes are near enough, and
    no more bits differ than shingles may, (n_a + n_b) (100 - percent) / (100 + percent)."""
    differ = F.aggregate(F.zip_with("bitmap_a", "bitmap_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    return sizes & (differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


def possible_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes of one bucket and different components (key, node, root, far) that could be similar enough.

    far is a node's Jaccard distance to the bucket's pivot, to which all were compared. The distance is a
    metric, so two nodes are at least as far apart as their distances to the pivot differ. A node can
    share only those shingles that another node in question has as well: with m the smaller such number of
    the two, the similarity is at most m / (n_a + n_b - m). And bitmaps tell how many shingles differ at least. None of
    these bounds can rule out a pair that is similar enough; many edited copies fail one of them without
    being compared. A pair that shares several buckets is made in the first of its bands alone.
    """
    nodes = sets.join(members.select("node").distinct(), "node", "left_semi").select("node", "n", F.explode("shingles").alias("shingle"))
    common = nodes.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("shingle")
    shared = join_many(nodes, common, ["shingle"]).groupBy("node", "n").agg(F.count("*").alias("s")).where(F.col("s") * 100 >= F.col("n") * percent)
    known = materialize(members.join(shared, "node").join(sets.select("node", "bitmap", "bands"), "node"), "known")
    left, right, keys = pairs_within(known, "key", "node")
    names = ("node", "root", "far", "n", "s", "bitmap", "bands")
    one = left.select(*keys, *[F.col(c).alias("a" if c == "node" else f"{c}_a") for c in names])
    two = right.select(*[F.col(c).alias(f"_{c}") for c in keys], *[F.col(c).alias("b" if c == "node" else f"{c}_b") for c in names])
    least = F.least("s_a", "s_b")
    apart = F.abs(F.col("far_a") - F.col("far_b")) <= 1 - percent / 100 + 1e-9
    near = (F.col("root_a") < F.col("root_b")) & apart & (least * 100 >= (F.col("n_a") + F.col("n_b") - least) * percent) & may_be_similar(percent)
    first = F.element_at(F.filter(F.zip_with("bands_a", "bands_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 1)
    return one.join(two, [F.col(c) == F.col(f"_{c}") for c in keys] + [near, first == F.col("key")]).select("a", "b")


def _linked(docs: DataFrame, percent: int, width: int = 5, bands: int = 32, rows: int = 6, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The rows' `band_keys`, and (node, root) of every node that is linked to another."""
    prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    table = materialize(band_keys(base, bands, rows, width, seed), "bands")
    met = table.where("node is not null").select("node", F.explode("bands").alias("key")).distinct()
    shared = met.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi").select("key")
    members = materialize(met.join(shared, "key"), "members")
    chosen = members.select("node").distinct()
    least = table.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("r")).join(chosen, "node", "left_semi").select(F.col("r.doc_id").alias("_id"), F.col("r.text_key").alias("_key"))
    texts = base.join(least, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_semi").select("text")
    stored = materialize(full_sets(texts, bands, rows, width, seed), "sets")
    sets = stored.dropDuplicates(["node"]) if stored.groupBy("node").count().where("count > 1").limit(1).count() else stored

    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    degree = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("degree"))
    pivots = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("p")).select("key", F.col("p.node").alias("pivot"))
    stars = members.join(pivots, "key").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(compared(stars, sets), "stars")
    links = stars.where(similar(percent)).select("a", "b")
    roots = materialize(connected_components(links), "roots")

    labelled = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    unlike = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    to_pivot = stars.select(F.col("a").alias("pivot"), F.col("b").alias("node"), (1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("far"))
    # The pivots themselves have been compared with everyone.
    rest = materialize(labelled.join(unlike, "key").join(pivots, "key").where("node <> pivot").join(to_pivot, ["pivot", "node"]).select("key", "node", "root", "far"), "open")
    if not rest.isEmpty():
        again = materialize(compared(materialize(possible_pairs(rest, sets, percent), "pairs"), sets).where(similar(percent)).select("a", "b"), "links")
        if not again.isEmpty():
            roots = materialize(connected_components(links.unionByName(again)), "roots")
        discard(again)
    discard(members, stored, stars, rest)
    return table, roots


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, bands: int = 32, rows: int = 6, seed: int = 11) -> DataFrame:
    """Every row with its component: doc_id, text_key, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of distinct
    `width`-word shingles; component_id is the least doc_id reachable and kept says that the row is
    that document. Texts without words have an empty set and stand alone. Null doc_ids never become
    a component_id unless all of a component's are null. Rows of one doc_id are ordinary rows.

    Equal sets are one node from the start. Nodes that share a band's key meet in a bucket. First each
    bucket's pivot, the node with the most company over all its buckets (of edited copies mostly the
    original), is compared with the others, so a bucket of copies costs its size, not its square, and a
    bucket within one component is done. In the others every pair of different components is compared
    that `possible_pairs` cannot rule out. So every pair that shares a bucket is linked, connected
    otherwise, or shown to be too unlike. With 32 bands of 6 a pair of similarity 0.85 shares no
    bucket with probability 3e-7, one of 0.8 with 6e-5.
    """
    table, roots = _linked(docs, percent, width, bands, rows, seed)
    classes = table.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    of_root = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(of_root, "root").select("node", "component_id")
    alone = F.col("node").isNull()
    # Exact copies share a node, and may be a third of all rows.
    out = join_many(table, named, ["node"], "left").withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `docs` without near-duplicates: one row of each component.

    It is the row of the least doc_id, a null one last; of several such rows the one with the least
    text hash, once. Texts without words stand alone, so each of their rows stays.
    """
    table, roots = _linked(docs, percent)
    best = table.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("r"))
    best = best.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("r").alias("r"))
    chosen = materialize(best.select(F.col("r.doc_id").alias("_id"), F.col("r.text_key").alias("_key")), "chosen")
    names = docs.columns
    wordy = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False)).alias("_wordy")
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_text_key"), wordy)
    left = rows.where("_wordy").join(chosen, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_semi")
    if not rows.where("_wordy").groupBy("_doc", "_text_key").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["_doc", "_text_key"])
    return left.unionByName(rows.where("NOT _wordy")).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])

"""Alignments: row weights, coupled columns, best rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import places

#: Symbols of an aligned column.
SYMBOLS = 5


#: Rows of a block: two blocks of one family are compared by one task.
BLOCK_ROWS = 512
#: Columns of a matrix of marks that are compared at once.
MARKS = 8192
#: Distinct marks up to which a set is stored as bits. Blocks of queries and of rows into which a family is cut at most, unless
#: a block's sets would then be more bytes than this.
DENSE, QUERY_BLOCKS, ROW_BLOCKS, BLOCK_BYTES = 1 << 16, 8, 64, 1 << 24
#: Columns of a tile, rows of a product of two tiles, products that are summed at once.
TILE, CHUNK_ROWS, SUMMED = 48, 8192, 16


def _blocked(df: DataFrame, key: str, ident: str) -> DataFrame:
    """Adds block (a part of its family of about BLOCK_ROWS rows, by a hash) and blocks (how many its family has)."""
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    return df.join(sizes, key).withColumn("block", F.pmod(F.xxhash64(ident), F.col("blocks")).cast("int"))


def _agreement(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(rows of a, rows of b): how many marks (distinct whole numbers of each row) two rows share."""
    known = np.unique(np.concatenate([*a, *b])) if a and b else np.empty(0, np.int64)
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    at = [[np.searchsorted(known, row) for row in side] for side in (a, b)]
    for lo in range(0, len(known), MARKS):
        part = []
        for side in at:
            m = np.zeros((len(side), min(MARKS, len(known) - lo)), dtype=np.float32)
            for i, places in enumerate(side):
                here = places[(places >= lo) & (places < lo + MARKS)]
                m[i, here - lo] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def _cells_of(aligned: str) -> np.ndarray:
    """A mark for every column of an aligned row: its place and its symbol."""
    code = np.frombuffer(aligned.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return (np.arange(len(code), dtype=np.int64) << 21) | code


def _apart(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """(rows of one, rows of two): how many marks two rows do not share; this obeys the triangle inequality."""
    return np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in two])[None, :] - 2 * _agreement(one, two)


def pivot_blocks(msa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, pivots), stored: family, row_no, aligned, pivot, part, away, width, the rows by the nearest pivot of their family;
    and family, block, blocks, aligned, the pivots of the families of more than one block.

    A family has a pivot for each BLOCK_ROWS rows, those of the least hash in their part of it, and each row goes to the pivot
    from which it is least `away`. A pivot with more rows than a block's has parts.
    """
    rows = _blocked(msa.select("family", "row_no", "aligned"), "family", "row_no")
    alone = rows.where("blocks = 1").select("family", "row_no", "aligned", F.lit(0).alias("pivot"), F.lit(0).cast("long").alias("away"))
    many = rows.where("blocks > 1")
    pivots = many.groupBy("family", "block", "blocks").agg(F.min_by("aligned", F.struct(F.xxhash64("row_no", F.lit(1)), "row_no")).alias("aligned"))
    pivots = materialize(pivots, "pivots")
    asked = pivots.select("family", F.col("block").alias("pivot"), "aligned", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])
    kind = {f.name: f.dataType.simpleString() for f in msa.schema}

    def nearest(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            at, away = np.empty(0, np.int64), np.empty(0, np.int64)
        else:
            d = _apart(*([_cells_of(x) for x in t.column("aligned").to_pylist()] for t in (one, two)))
            at, away = d.argmin(axis=1), d.min(axis=1).astype(np.int64)
        chosen = two.column("pivot").take(pa.array(at)) if len(at) else pa.array([], pa.int32())
        return pa.table([one.column("family"), one.column("row_no"), one.column("aligned"), chosen, pa.array(away)], names=["family", "row_no", "aligned", "pivot", "away"])

    keys = ["family", "block"]
    dealt = many.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(nearest, f"family {kind['family']}, row_no {kind['row_no']}, aligned string, pivot int, away long")
    placed = materialize(alone.unionByName(dealt), "placed")
    parts = placed.groupBy("family", "pivot").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_parts"))
    cut = placed.join(parts, ["family", "pivot"]).withColumn("part", F.pmod(F.xxhash64("row_no"), F.col("_parts")).cast("int"))
    return materialize(cut.select("family", "row_no", "aligned", "pivot", "part", "away", F.length("aligned").alias("width")), "blocks"), pivots


def near_blocks(rows: DataFrame, pivots: DataFrame, threshold: float) -> DataFrame:
    """family, pivot, part, other, other_part: the pairs of blocks that may hold rows as identical as the threshold.

    Rows a and b of two blocks are at least as far apart as their pivots less the blocks' radii; rows that share more than the
    threshold of a's columns are at most |b| + (1 - 2 * threshold) |a| apart.
    """
    sizes = rows.groupBy("family", "pivot", "part").agg(F.max("away").alias("radius"), F.min("width").alias("least"), F.max("width").alias("most"))
    sizes = materialize(sizes, "radii")
    whole = sizes.groupBy("family", "pivot").agg(F.max("radius").alias("radius"), F.min("least").alias("least"), F.max("most").alias("most"))
    named = pivots.select("family", F.col("block").alias("pivot"), "aligned", "blocks").join(whole, ["family", "pivot"])
    step = named.withColumn("chunk", F.floor(F.col("pivot") / BLOCK_ROWS).cast("int"))
    other = step.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / BLOCK_ROWS).cast("int"))))
    other = other.select(*[F.col(c).alias(c) for c in other.columns])
    kind = rows.schema["family"].dataType.simpleString()

    def near(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        i = j = np.empty(0, np.int64)
        if one.num_rows and two.num_rows:
            d = _apart(*([_cells_of(x) for x in t.column("aligned").to_pylist()] for t in (one, two)))
            of = lambda t, c: t.column(c).to_numpy()
            slope = 1 - 2 * threshold
            most = of(two, "most")[None, :] + slope * of(one, "most" if slope > 0 else "least")[:, None]
            i, j = np.nonzero(d - of(one, "radius")[:, None] - of(two, "radius")[None, :] <= most + 1e-9)
        take = lambda t, c, at: t.column(c).take(pa.array(at))
        return pa.table([take(one, "family", i), take(one, "pivot", i), take(two, "pivot", j)], names=["family", "pivot", "other"])

    keys = ["family", "chunk"]
    pairs = step.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(near, f"family {kind}, pivot int, other int")
    single = whole.join(pivots.select("family").distinct(), "family", "left_anti").select("family", "pivot", F.col("pivot").alias("other"))
    pairs = materialize(pairs.unionByName(single), "near")
    left = sizes.select("family", "pivot", "part")
    right = sizes.select("family", F.col("pivot").alias("other"), F.col("part").alias("other_part"))
    return materialize(pairs.join(left, ["family", "pivot"]).join(right, ["family", "other"]), "block_pairs")


def row_weights(msa: DataFrame, threshold: float = 0.8, strict: bool = True) -> DataFrame:
    """family, row_no, weight: one over the number of rows of the family, itself included, that are more (or as much,
    not strict) identical than the threshold; identity is the share of columns in which two rows agree.

    A family's rows lie in blocks about pivots, and every two blocks that may hold such rows (`near_blocks`) meet in a task
    as matrices of cells, so no pair of rows is a row of a table, and a family of any size is the work of many tasks.
    """
    rows, pivots = pivot_blocks(msa)
    pairs = near_blocks(rows, pivots, threshold)
    left = rows.join(pairs, ["family", "pivot", "part"]).select("family", "pivot", "part", "other", "other_part", "row_no", "aligned")
    meets = pairs.select("family", F.col("pivot").alias("_p"), F.col("part").alias("_q"), F.col("other").alias("pivot"), F.col("other_part").alias("part"))
    right = rows.join(meets, ["family", "pivot", "part"]).select("family", F.col("_p").alias("pivot"), F.col("_q").alias("part"), F.col("pivot").alias("other"), F.col("part").alias("other_part"), "aligned")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    kind = {f.name: f.dataType.simpleString() for f in msa.schema}

    def run(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        a, b = ([_cells_of(x) for x in t.column("aligned").to_pylist()] for t in (one, two))
        share = _agreement(a, b) / np.maximum([len(x) for x in a], 1)[:, None] if a and b else np.zeros((len(a), len(b)))
        near = share > threshold if strict else share >= threshold
        return pa.table([one.column("family"), one.column("row_no"), pa.array(near.sum(axis=1).astype(np.int64))], names=["family", "row_no", "n"])

    keys = ["family", "pivot", "part", "other", "other_part"]
    counts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"family {kind['family']}, row_no {kind['row_no']}, n long")
    return counts.groupBy("family", "row_no").agg((1.0 / F.sum("n")).alias("weight"))


def neff(weights: DataFrame) -> DataFrame:
    return weights.groupBy("family").agg(F.count("*").alias("rows"), F.sum("weight").alias("neff"))


def columns(msa: DataFrame) -> DataFrame:
    """family, row_no, col (from 0), symbol."""
    return msa.select("family", "row_no", F.posexplode(F.split("aligned", "")).alias("col", "symbol"))


def residue_index(cells: DataFrame) -> DataFrame:
    """Cells that are not gaps, with `residue`, their place in the row's sequence."""
    w = Window.partitionBy("family", "row_no").orderBy("col")
    return cells.where("symbol <> '-'").withColumn("residue", F.row_number().over(w) - 1)


def match_columns(cells: DataFrame) -> DataFrame:
    """Cells of the columns in which the family's first row has an upper-case letter or '-'."""
    first = cells.groupBy("family").agg(F.min("row_no").alias("row_no"))
    good = cells.join(first, ["family", "row_no"]).where(F.col("symbol").rlike("^[A-Z-]$")).select("family", "col")
    return cells.join(good, ["family", "col"])


def _codes(aligned: pd.Series) -> np.ndarray:
    """Rows as numbers of their symbols: A, C, G, U, and 4 for every other."""
    rows = np.stack([np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32) for a in aligned])
    out = np.full(rows.shape, SYMBOLS - 1, dtype=np.int64)
    for i, s in enumerate("ACGU"):
        out[rows == ord(s)] = i
    return out


def tile_counts(msa: DataFrame, weights: DataFrame) -> DataFrame:
    """family, ti, tj, counts: for the columns of tiles ti <= tj the weighted counts of symbols (a, b) of every two of them, as
    one array (i, a, j, b); all rows of a family have its number of columns.

    The columns are cut into tiles of TILE. For each two tiles, each CHUNK_ROWS rows of a family are two matrices of marks,
    whose product counts all their pairs of columns at once; products of one pair of tiles are then summed, SUMMED at a
    time, until one is left. What a task holds depends on these three numbers, not on the rows or columns.
    """
    kind = {f.name: f.dataType.simpleString() for f in msa.schema}
    chunks = msa.groupBy("family").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("long").alias("_chunks"))
    rows = msa.select("family", "row_no", "aligned").join(weights, ["family", "row_no"]).join(chunks, "family")
    last = F.floor((F.length("aligned") - 1) / TILE).cast("int")
    tiles = rows.where(F.length("aligned") > 0).select("family", "weight", "aligned", F.pmod(F.xxhash64("row_no"), F.col("_chunks")).alias("chunk"), last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("ti"))
    tiles = tiles.withColumn("tj", F.explode(F.sequence("ti", "_last")))
    part = lambda t: F.substring("aligned", F.col(t) * TILE + 1, F.lit(TILE))
    schema = f"family {kind['family']}, ti int, tj int, chunk long, counts array<double>"

    def marks(aligned: pd.Series) -> np.ndarray:
        codes = _codes(aligned)
        out = np.zeros((len(codes), codes.shape[1] * SYMBOLS))
        out[np.arange(len(codes))[:, None], np.arange(codes.shape[1]) * SYMBOLS + codes] = 1
        return out

    def row(key: tuple, counts: np.ndarray) -> pa.Table:
        cells = [pa.array([k.as_py()], k.type) for k in key]
        return pa.table([*cells, pa.array([counts], pa.list_(pa.float64()))], names=["family", "ti", "tj", "chunk", "counts"])

    def product(key: tuple, table: pa.Table) -> pa.Table:
        one, two = (marks(pd.Series(table.column(c).to_pylist())) for c in ("a", "b"))
        return row(key, (one.T @ (two * table.column("weight").to_numpy()[:, None])).ravel())

    def add(key: tuple, table: pa.Table) -> pa.Table:
        column = table.column("counts").combine_chunks()
        return row(key, column.flatten().to_numpy().reshape(len(column), -1).sum(axis=0))

    keys = ["family", "ti", "tj", "chunk"]
    sums = tiles.select(*keys, "weight", part("ti").alias("a"), part("tj").alias("b")).groupBy(*keys).applyInArrow(product, schema)
    left = chunks.agg(F.max("_chunks")).first()[0] or 1
    while left > 1:
        sums = sums.withColumn("chunk", F.floor(F.col("chunk") / SUMMED).cast("long")).groupBy(*keys).applyInArrow(add, schema)
        left = -(-left // SUMMED)
    return sums.drop("chunk")


def _tile_information(counts: np.ndarray, tile: int, first: int, second: int, total: float, pseudocount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, mutual information) of the pairs i < j of two tiles; a column's own counts are sums over any other's symbols."""
    k = SYMBOLS
    # The last tile of a family may be narrower, and never stands first unless both are it.
    wide = tile if first < second else int(round(np.sqrt(len(counts)) / k))
    n = counts.reshape(wide, k, -1, k)
    one, two = n[:, :, 0, :].sum(axis=2), n[0].sum(axis=0)
    q = (n + pseudocount / (k * k)) / (total + pseudocount)
    pa, pb = ((x + pseudocount / k) / (total + pseudocount) for x in (one, two))
    information = (q * np.log(q / (pa[:, :, None, None] * pb[None, None, :, :]))).sum(axis=(1, 3))
    i, j = np.indices(information.shape)
    i, j = i + first * tile, j + second * tile
    use = i < j
    return i[use], j[use], information[use]


def column_information(msa: DataFrame, weights: DataFrame, pseudocount: float = 0.5) -> DataFrame:
    """family, i, j, mi: weighted mutual information of every two columns i < j, as of `apc_mutual_information`."""
    kind = {f.name: f.dataType.simpleString() for f in msa.schema}["family"]
    total = weights.groupBy("family").agg(F.sum("weight").alias("w"))
    tile = TILE

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ti, tj, w = (batch.column(c)[at].as_py() for c in (1, 2, 4))
                i, j, mi = _tile_information(batch.column(3)[at].values.to_numpy(), tile, ti, tj, w, pseudocount)
                family = batch.column(0).take(pa.array(np.full(len(i), at)))
                yield pa.RecordBatch.from_arrays([family, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(mi)], names=["family", "i", "j", "mi"])

    return tile_counts(msa, weights).join(total, "family").select("family", "ti", "tj", "counts", F.col("w").cast("double").alias("w")).mapInArrow(run, f"family {kind}, i int, j int, mi double")


def apc_mutual_information(msa: DataFrame, weights: DataFrame, pseudocount: float = 0.5) -> DataFrame:
    """family, i, j, mi, score: weighted mutual information of column pairs (natural log) with the pseudocount spread
    over the symbol pairs, and its average-product correction (means over all columns, the zero diagonal included).

    All cells of a pair count, those that do not occur with the pseudocount alone. Symbols other than A, C, G and U
    are one. Pairs are worked out by tiles of columns (`tile_counts`), and only their information becomes rows.
    """
    mi = materialize(column_information(msa, weights, pseudocount), "mi")
    both = mi.unionByName(mi.select("family", F.col("j").alias("i"), F.col("i").alias("j"), "mi"))
    per = both.groupBy("family", "i").agg(F.sum("mi").alias("_m"))
    size = per.groupBy("family").agg((F.max("i") + 1).cast("double").alias("l"), F.sum("_m").alias("s"))
    means = materialize(per.join(size, "family").select("family", "i", (F.col("_m") / F.col("l")).alias("m"), (F.col("s") / (F.col("l") * F.col("l"))).alias("all")), "means")
    a = means.select("family", "i", F.col("m").alias("mi_i"), "all")
    b = means.select("family", F.col("i").alias("j"), F.col("m").alias("mi_j"))
    return mi.join(a, ["family", "i"]).join(b, ["family", "j"]).select("family", "i", "j", "mi", (F.col("mi") - F.coalesce(F.try_divide(F.col("mi_i") * F.col("mi_j"), F.col("all")), F.lit(0.0))).alias("score"))


def top_couplings(scores: DataFrame, per_column: float, apart: int, length: int) -> DataFrame:
    """family, i, j, score, place: the best per_column * length pairs with j - i >= apart; scores are rounded to 9
    places for the order, ties by i and j."""
    w = Window.partitionBy("family").orderBy(F.desc(F.round("score", 9)), "i", "j")
    return scores.where(F.col("j") - F.col("i") >= apart).withColumn("place", F.row_number().over(w)).where(F.col("place") <= int(per_column * length)).select("family", "i", "j", "score", "place")


def precision_at(top: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """family, k, precision of the first k pairs."""
    hit = top.join(truth.select("family", "i", "j").distinct().withColumn("_t", F.lit(1)), ["family", "i", "j"], "left")
    rows = hit.select("family", "place", F.coalesce("_t", F.lit(0)).alias("t"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("place <= k")
    return rows.groupBy("family", "k").agg((F.sum("t") / F.count("*")).alias("precision"))


def kmer_hashes(sequence: str, k: int) -> np.ndarray:
    """Distinct k-mers of a sequence as 64-bit numbers, sorted; a shorter sequence has none."""
    code = np.frombuffer(sequence.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(code) < k:
        return np.empty(0, np.int64)
    x = np.zeros(len(code) - k + 1, dtype=np.uint64)
    for i in range(k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + code[i : len(code) - k + 1 + i] + np.uint64(1)
    return np.unique(x.view(np.int64))


def sized_blocks(df: DataFrame, ident: str, most: int) -> DataFrame:
    """The rows, stored, with `block`: rows of a family in the order of their sets' sizes, BLOCK_ROWS to a block, or so many times
    that in a large family that it has `most` blocks, as far as BLOCK_BYTES allows."""
    placed = places(df, ["family"], [F.col("_size"), F.col(ident)], "_place", total="")
    times = F.least(F.ceil(F.count("*") / (BLOCK_ROWS * most)), F.floor(F.lit(BLOCK_BYTES) / (F.max(F.octet_length("marks")) * BLOCK_ROWS)))
    wide = df.groupBy(F.col("family").alias("_family")).agg((F.greatest(F.lit(1), times) * BLOCK_ROWS).alias("_wide"))
    placed = placed.join(wide, F.col("family").eqNullSafe(F.col("_family")))
    return materialize(placed.withColumn("block", F.floor(F.col("_place") / F.col("_wide")).cast("int")).drop("_place", "_wide", "_family"), "sized")


def _shared_bits(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """(rows of one, rows of two): how many bits two rows of bytes share."""
    out = np.zeros((len(one), len(two)), dtype=np.float64)
    for lo in range(0, one.shape[1], MARKS // 8):
        a, b = (np.unpackbits(x[:, lo : lo + MARKS // 8], axis=1).astype(np.float32) for x in (one, two))
        out += a @ b.T
    return out


def _highest(one: np.ndarray, two: np.ndarray) -> float:
    """What no Jaccard similarity of sets of these sizes exceeds."""
    return float(min(1.0, one.max() / two.min(), two.max() / one.min()))


def block_bounds(queries: DataFrame, rows: DataFrame, ratio: float, least: float) -> DataFrame:
    """family, block, other, bound: pairs of blocks of queries and rows that may hold a row for a query, and what no Jaccard
    similarity between them exceeds: the smaller set's size over the larger one's."""
    ends = lambda df, p: df.groupBy("family", F.col("block").alias(f"{p}block")).agg(*[f(c).alias(f"{p}{n}{c[-4:]}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("_size", "length")])
    pairs = ends(queries, "q").join(ends(rows, "r"), "family")
    bound = F.when(F.col("qhisize") < F.col("rlosize"), F.col("qhisize") / F.col("rlosize")).when(F.col("rhisize") < F.col("qlosize"), F.col("rhisize") / F.col("qlosize")).otherwise(F.lit(1.0))
    near = (F.col("qhingth") >= ratio * F.col("rlongth")) & (F.col("rhingth") >= ratio * F.col("qlongth"))
    return materialize(pairs.where(near).select("family", F.col("qblock").alias("block"), F.col("rblock").alias("other"), bound.alias("bound")).where(F.col("bound") >= least), "bounds")


def best_rows(queries: DataFrame, rows: DataFrame, k: int = 5, ratio: float = 0.5, least: float = 0.10, own: bool = False) -> DataFrame:
    """query, family, row_no, similarity: each query's row of each family with the highest Jaccard similarity of k-mer
    sets, among rows whose length is within the ratio; ties to the first row, none under `least`. With `own`, queries
    are rows too, and none is its own answer.

    Rows are stored once as sets of k-mers, in blocks of sets of like sizes. Blocks of queries first meet the blocks of rows
    whose sizes overlap theirs; then only those whose bound on the similarity reaches the least best of the queries so far.
    Every two blocks meet in a task of their own, BLOCK_ROWS rows of each at a time, which keeps one row for each query. Nothing
    is joined on a k-mer, of which there are so few that almost all rows share them.

    Where there are at most DENSE k-mers, a set is a bit for each, else its hashes. A row is sent to each block of queries of its
    family and a query to each of rows; these are QUERY_BLOCKS and ROW_BLOCKS at most, as blocks grow with the family (up to
    BLOCK_BYTES), so what is shuffled grows as the rows do.
    """
    @F.pandas_udf("array<long>")
    def hashes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda x: kmer_hashes(x or "", k))

    def hashed(df: DataFrame, ident: str, label: str) -> DataFrame:
        return materialize(df.select("family", ident, F.length("sequence").alias("length"), hashes("sequence").alias("marks")), label).where(F.size("marks") > 0)

    one, two = hashed(queries, "query", "query_sets"), hashed(rows, "row_no", "row_sets")
    # One more than DENSE tells that there are too many for bits.
    kmers = one.select(F.explode("marks").alias("m")).unionByName(two.select(F.explode("marks").alias("m"))).distinct().limit(DENSE + 1).toArrow()["m"].to_numpy()
    known = np.sort(kmers) if len(kmers) <= DENSE else None

    @F.pandas_udf("binary")
    def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def bits(x: np.ndarray) -> bytes:
            if known is None:
                return np.asarray(x, dtype=np.int64).tobytes()
            row = np.zeros(len(known), dtype=np.uint8)
            row[np.searchsorted(known, x)] = 1
            return np.packbits(row).tobytes()

        for p in parts:
            yield p.map(bits)

    def sets(df: DataFrame, ident: str, most: int) -> DataFrame:
        return sized_blocks(materialize(df.select("family", ident, "length", F.size("marks").alias("_size"), packed("marks").alias("marks")), "packed"), ident, most)

    q, r = sets(one, "query", QUERY_BLOCKS), sets(two, "row_no", ROW_BLOCKS)
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *rows.schema]}
    dense, step = known is not None, BLOCK_ROWS

    def run(key, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query": one["query"], "family": [key[0]] * len(one), "row_no": [None] * len(one), "similarity": np.zeros(len(one))})
        if not len(one) or not len(two):
            return out.iloc[:0]

        def slices(df: pd.DataFrame, ident: str) -> list[tuple]:
            made = []
            df = df.sort_values(["_size", ident])
            for at in range(0, len(df), step):
                some = df.iloc[at : at + step].sort_values(ident)
                marks = [np.frombuffer(x, np.uint8 if dense else np.int64) for x in some["marks"]]
                made.append((some[ident].to_numpy(), some["_size"].to_numpy(), some["length"].to_numpy(), np.stack(marks) if dense else marks))
            return made

        found, theirs = [], slices(two, "row_no")
        for query, size, length, marks in slices(one, "query"):
            best, row = np.full(len(query), -1.0), np.full(len(query), theirs[0][0][0])
            bounds = [_highest(size, s) for _, s, _, _ in theirs]
            for at in np.argsort(bounds, kind="stable")[::-1]:
                number, sizes, lengths, other = theirs[at]
                if bounds[at] < max(least, best.min()) or length.max() < ratio * lengths.min() or lengths.max() < ratio * length.min():
                    continue
                both = _shared_bits(marks, other) if dense else _agreement(marks, other)
                near = np.minimum(length[:, None], lengths[None, :]) >= ratio * np.maximum(length[:, None], lengths[None, :])
                if own:
                    near &= query[:, None] != number[None, :]
                similarity = np.where(near, both / (size[:, None] + sizes[None, :] - both), -1.0)
                first = similarity.argmax(axis=1)
                value = similarity[np.arange(len(query)), first]
                better = (value > best) | ((value == best) & (number[first] < row))
                best, row = np.where(better, value, best), np.where(better, number[first], row)
            found.append(pd.DataFrame({"query": query, "family": [key[0]] * len(query), "row_no": row, "similarity": best})[best >= least])
        return pd.concat(found)

    def met(pairs: DataFrame, label: str) -> DataFrame:
        left = q.join(pairs.select("family", "block", "other"), ["family", "block"]).select("family", "block", "other", "query", "length", "_size", "marks")
        right = r.withColumnRenamed("block", "other").join(pairs.select("family", "block", "other"), ["family", "other"]).select("family", "block", "other", "row_no", "length", "_size", "marks")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])
        keys = ["family", "block", "other"]
        return materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"query {kind['query']}, family {kind['family']}, row_no {kind['row_no']}, similarity double"), label)

    pairs = block_bounds(q, r, ratio, least)
    first = met(pairs.where("bound = 1"), "first_rows")
    # The worst of a block's queries so far, 0 if one has none, says which further blocks may still matter.
    so_far = first.groupBy("family", "query").agg(F.max("similarity").alias("_s"))
    worst = q.join(so_far, ["family", "query"], "left").groupBy("family", "block").agg(F.min(F.coalesce("_s", F.lit(0.0))).alias("_worst"))
    found = first.unionByName(met(pairs.where("bound < 1").join(worst, ["family", "block"]).where(F.col("bound") >= F.col("_worst")), "more_rows"))
    top = F.max_by(F.struct("row_no", "similarity"), F.struct("similarity", (-F.col("row_no")).alias("n")))
    return found.groupBy("query", "family").agg(top.alias("t")).select("query", "family", "t.row_no", "t.similarity")


def project(pairs: DataFrame, cells: DataFrame, row: str = "row_no") -> DataFrame:
    """family, i, j of residues of each row: column pairs through the row's gaps; a pair with an end in a gap is dropped."""
    at = residue_index(cells)
    i = at.select("family", row, F.col("col").alias("i"), F.col("residue").alias("ri"))
    j = at.select("family", row, F.col("col").alias("j"), F.col("residue").alias("rj"))
    return pairs.join(i, ["family", "i"]).join(j, ["family", row, "j"]).select("family", row, F.col("ri").alias("i"), F.col("rj").alias("j"))

"""Distances of all points of an entry, tile against tile: a few rows of many points are moved, and no row for a pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Places of a chain that are one tile; distances worked out at once; what a task works out, and the most tasks.
TILE, BLOCK, SHARE, MOST_TASKS = 1024, 1 << 20, 100_000_000, 20_000
#: What reading a point costs, in distances.
POINT = 1000
AXES = "xyz"

Tile = dict[str, np.ndarray]


def tile_join(points: DataFrame, cutoff: float, columns: Sequence[str], kernel: Callable[[Tile, Tile], Iterator[list[np.ndarray]]], schema: str) -> DataFrame:
    """entry and what `kernel` yields (as `schema`) for every two tiles of one entry, a tile with itself included, that may hold
    points within the cutoff; the first tile is never behind the second.

    points: entry, idx (a whole number), x, y, z and the other `columns`, which are doubles. A tile is all points of TILE places
    in a row, so what concerns two residues is found in one pair of tiles alone. Pairs of tiles whose boxes are further
    apart than the cutoff are left out. The kernel gets idx and columns as arrays; `start` is a tile's first place.
    """
    sound = F.lit(True)
    for c in AXES:
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c)
    p = points.where(sound & F.col("entry").isNotNull() & F.col("idx").isNotNull())
    names = [*AXES, *[c for c in columns if c not in AXES]]
    tiles = p.groupBy("entry", F.floor(F.col("idx") / TILE).alias("tile")).agg(
        F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in names])).alias("c"),
        *[f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))],
    )
    tiles = materialize(tiles, "tiles")
    boxes = tiles.select("entry", "tile", F.size("c").cast("double").alias("n"), *[f"{n}_{c}" for c in AXES for n in ("lo", "hi")])
    other = boxes.select("entry", *[F.col(c).alias(f"r_{c}") for c in boxes.columns if c != "entry"])
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"lo_{c}") - F.col(f"r_hi_{c}"), F.col(f"r_lo_{c}") - F.col(f"hi_{c}"))
    apart = sum((gap(c) * gap(c) for c in AXES), F.lit(0.0))
    met = boxes.join(other, "entry").where((F.col("tile") <= F.col("r_tile")) & (apart <= cutoff * cutoff * (1 + 1e-9)))
    met = materialize(met.select("entry", "tile", "r_tile", (F.col("n") * F.col("r_n") + POINT * (F.col("n") + F.col("r_n"))).alias("work")), "met")
    work = met.agg(F.sum("work")).first()[0] or 0.0
    tasks = int(min(MOST_TASKS, max(p.sparkSession.sparkContext.defaultParallelism, work // SHARE + 1)))
    fields = ["idx", *names]
    left = tiles.select("entry", "tile", *[F.col(f"c.{f}").alias(f"a_{f}") for f in fields])
    right = tiles.select("entry", F.col("tile").alias("r_tile"), *[F.col(f"c.{f}").alias(f"b_{f}") for f in fields])
    dealt = met.drop("work").join(left, ["entry", "tile"]).join(right, ["entry", "r_tile"]).repartition(tasks, "entry", "tile", "r_tile")
    dealt = dealt.select("entry", "tile", "r_tile", *[f"a_{f}" for f in fields], *[f"b_{f}" for f in fields])
    columns_out = [f.strip().split()[0] for f in schema.split(",")]
    kind = points.schema["entry"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
                side = lambda s, t: {f: at[f"{s}_{f}"].values.to_numpy(zero_copy_only=False) for f in fields} | {"start": at[t].as_py() * TILE}  # noqa: B023, E731
                for out in kernel(side("a", "tile"), side("b", "r_tile")):
                    if len(out[0]):
                        entry = batch.column(0).take(pa.array(np.full(len(out[0]), row)))
                        yield pa.RecordBatch.from_arrays([entry, *map(pa.array, out)], names=["entry", *columns_out])

    return dealt.mapInArrow(run, f"entry {kind}, {schema}")


def distances(a: Tile, b: Tile, prefix: str = "") -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of some of a's points (a slice of them) from all of b's, some rows at a time."""
    step = max(1, BLOCK // max(1, len(b["idx"])))
    x, y, z = (prefix + c for c in AXES)
    for lo in range(0, len(a["idx"]), step):
        s = slice(lo, lo + step)
        yield s, (a[x][s, None] - b[x]) ** 2 + (a[y][s, None] - b[y]) ** 2 + (a[z][s, None] - b[z]) ** 2


def residue_pairs(cutoff: float, apart: int) -> Callable[[Tile, Tile], Iterator[list[np.ndarray]]]:
    """A kernel of (i, j): residues with any two points within the cutoff and j - i >= apart, each pair once."""

    def kernel(a: Tile, b: Tile) -> Iterator[list[np.ndarray]]:
        hit = np.zeros((TILE, TILE), dtype=bool)
        i, j = a["idx"] - a["start"], b["idx"] - b["start"]
        # Where each place has one point at most, rows are written as they are.
        alone = len(np.unique(i)) == len(i) and len(np.unique(j)) == len(j)
        for s, far in distances(a, b):
            near = far <= cutoff * cutoff
            if alone:
                hit[i[s, None], j] = near
            else:
                p, q = np.nonzero(near)
                hit[i[s][p], j[q]] = True
        p, q = np.nonzero(hit)
        p, q = p + a["start"], q + b["start"]
        keep = q - p >= apart
        yield [p[keep], q[keep]]

    return kernel


def kept_distances(radius: float, apart: int) -> Callable[[Tile, Tile], Iterator[list[np.ndarray]]]:
    """A kernel of (idx, n, kept): of each residue, with how many others closer than the radius and further than `apart` along
    the chain it stands in these tiles, and how many of 4 bounds (0.5, 1, 2, 4) on the change of distance in the model's
    points (mx, my, mz) those keep."""

    def kernel(a: Tile, b: Tile) -> Iterator[list[np.ndarray]]:
        n, kept = np.zeros(len(b["idx"]), np.int64), np.zeros(len(b["idx"]), np.int64)
        for (s, far), (_, model) in zip(distances(a, b), distances(a, b, "m"), strict=True):
            near = (far < radius * radius) & (b["idx"] - a["idx"][s, None] > apart)
            off = np.abs(np.sqrt(far) - np.sqrt(model))
            good = ((off < 0.5).view(np.int8) + (off < 1.0) + (off < 2.0) + (off < 4.0)) * near
            n += near.sum(axis=0)
            kept += good.sum(axis=0, dtype=np.int64)
            rows = near.sum(axis=1)
            some = rows > 0
            yield [a["idx"][s][some], rows[some].astype(np.int64), good.sum(axis=1, dtype=np.int64)[some]]
        some = n > 0
        yield [b["idx"][some], n[some], kept[some]]

    return kernel

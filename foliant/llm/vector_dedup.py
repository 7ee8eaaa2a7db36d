"""Near-duplicates among embeddings: tiles of vectors, compared leading principal directions first.

Only vectors of equal label and length are compared, by cosine in double precision.

1. Equal vectors form one class straight away; a class counts as many links as it
   has members.
2. A rotation to principal directions (from the second moments of all classes of
   the commonest length) changes no product and puts the largest shares first. Two
   unit vectors with cosine t or more are at most sqrt(2 - 2t) apart, and so are their
   leading coordinates: a label falls into slices of that width, and only a slice
   and its neighbour meet.
3. Slices are dealt into tiles of about ``TILE`` vectors by hash. A task compares two
   tiles: it adds up ``STEP`` directions at a time, bounds what is left of a product
   by the norms of what is left of both vectors, and drops all pairs whose cosine
   can't reach the threshold any more. Pairs within 1e-9 of the threshold are
   decided by the vectors as they were given.
4. Of two tiles come the number of links of each vector and a spanning forest of
   the links, never the links themselves: what is shuffled is of the order of the
   vectors, however large a group of copies is.

Null ids, labels or vectors, empty and zero vectors, and vectors with null or
non-finite components link with nothing. A null id has a null component and is
kept. Rows with a repeated id are vectors of their own; ``component_id`` is the
least id among the vectors reachable. An empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import materialize
from foliant.llm.components import components

#: Vectors of a tile, rows that are compared at once, directions added at a time.
TILE, ROWS, STEP = 4096, 512, 16
#: Longer vectors than this keep their own directions: the rotation is sent to all tasks.
MOST_DIMS = 2048
#: Cosines this near to the threshold are worked out from the vectors as given.
CLOSE = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaling by a power of two first keeps squares in range."""
    _, e = np.frexp(np.abs(x).max(1, initial=0))
    x = np.ldexp(x, -e[:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = (np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in (x, y))
    return float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y)))


def _matrix(col: pa.ChunkedArray | pa.Array, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def principal_directions(vectors: DataFrame, dim: int, kind: str) -> np.ndarray:
    """Directions as columns, the largest second moment first; each task adds up its own moments."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            u = unit(_matrix(batch.column(0), kind, dim))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int64()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(r) for r in pdf["row"]], axis=0)
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [total.tobytes()]})

    rows = vectors.select("x").mapInArrow(run, "i long, row binary").groupBy("i").applyInPandas(add, "i long, row binary").collect()
    _, directions = np.linalg.eigh(np.stack([np.frombuffer(r.row) for r in sorted(rows, key=lambda r: r.i)]))
    return np.ascontiguousarray(directions[:, ::-1])


def _tails(x: np.ndarray) -> np.ndarray:
    """For each step, the norms of what comes after it."""
    squares = np.cumsum((x * x)[:, ::-1], 1)[:, ::-1]
    ends = range(STEP, x.shape[1] + STEP, STEP)
    return np.sqrt(np.stack([squares[:, e] if e < x.shape[1] else np.zeros(len(x)) for e in ends]))


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rotated unit rows, some rows of the left at a time, that reach the threshold, and whether it is close."""
    dim, tail_l, tail_r = left.shape[1], _tails(left), _tails(right)
    least = threshold - CLOSE
    for lo in range(0, len(left), ROWS):
        rows, cols = np.arange(lo, min(lo + ROWS, len(left))), np.arange(len(right))
        sums, at = np.zeros((len(rows), len(cols))), 0
        i = j = value = None
        for k, first in enumerate(range(0, dim, STEP)):
            last = min(first + STEP, dim)
            if i is None:  # many pairs are open: whole tiles
                sums += left[rows, first:last] @ right[cols, first:last].T
                open_ = sums + tail_l[k][rows][:, None] * tail_r[k][cols][None] >= least
                some_rows, some_cols = open_.any(1), open_.any(0)
                if not (some_rows.all() and some_cols.all()):
                    rows, cols, sums, open_ = rows[some_rows], cols[some_cols], sums[np.ix_(some_rows, some_cols)], open_[np.ix_(some_rows, some_cols)]
                if last == dim or open_.sum() * 8 < open_.size:
                    at = np.nonzero(open_)
                    i, j, value = rows[at[0]], cols[at[1]], sums[at]
            else:  # few are: pair by pair
                value = value + np.einsum("pd,pd->p", left[i, first:last], right[j, first:last])
                keep = value + tail_l[k][i] * tail_r[k][j] >= least
                i, j, value = i[keep], j[keep], value[keep]
            if (len(i) if i is not None else len(rows)) == 0:
                break
        if i is not None and len(i):
            yield i, j, value < threshold + CLOSE


class _Forest:
    """Components of the nodes of two tiles, and links that span them."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, node: int, others: np.ndarray) -> None:
        found, where = np.unique(self.label[others], return_index=True)
        own = self.label[node]
        if len(found) == 1 and found[0] == own:
            return
        self.links += [(node, int(others[w])) for f, w in zip(found, where) if f != own]
        self.label[np.isin(self.label, found)] = own


def compare_tiles(ids: np.ndarray, classes: np.ndarray, sizes: np.ndarray, side: np.ndarray, x: np.ndarray, directions: np.ndarray | None, threshold: float) -> pa.RecordBatch:
    """Link counts (other_id null) and spanning links of the rows of one or two tiles."""
    u = unit(x)
    if directions is not None:
        u = u @ directions
    same = not side.any()
    lefts = np.flatnonzero(side == 0)
    rights = lefts if same else np.flatnonzero(side == 1)
    count, forest = np.zeros(len(ids), np.int64), _Forest(len(ids))
    for i, j, close in linked(u[lefts], u[rights], threshold):
        i, j = lefts[i], rights[j]
        keep = i < j if same else np.ones(len(i), bool)
        for p in np.flatnonzero(close & keep):
            keep[p] = cosine(x[i[p]], x[j[p]]) >= threshold
        i, j = i[keep], j[keep]
        count += np.bincount(i, sizes[j], len(ids)).astype(np.int64) + np.bincount(j, sizes[i], len(ids)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]])) if len(i) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            forest.add(int(i[a]), j[a:b])
    at = np.flatnonzero(count)
    a, b = np.array(forest.links, np.int64).reshape(-1, 2).T
    none = pa.nulls(len(at), pa.int64())
    whole = lambda first, rest: pa.chunked_array([pa.array(first, pa.int64()), rest]).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [whole(ids[at], pa.array(ids[a])), whole(classes[at], pa.array(classes[a])), whole(none, pa.array(ids[b])), whole(none, pa.array(classes[b])), whole(count[at], pa.nulls(len(a), pa.int64()))],
        ["id", "c0", "other_id", "other_c0", "links"],
    )


def tile_pairs(slices: DataFrame, tile: int) -> DataFrame:
    """(label, dim, slice, tile, pair, side) of tiles that meet: those of a slice, and those of neighbouring slices."""
    sizes = slices.select("label", "dim", "slice", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    own = sizes.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("u", F.explode(F.sequence(F.col("t"), F.col("tiles") - 1)))
    own = own.select("label", "dim", F.col("slice").alias("s"), "t", F.col("slice").alias("r"), "u")
    after = sizes.select("label", "dim", (F.col("slice") - 1).alias("slice"), F.col("tiles").alias("next"))
    both = sizes.join(after, ["label", "dim", "slice"]).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("next") - 1)))
    both = both.select("label", "dim", F.col("slice").alias("s"), "t", (F.col("slice") + 1).alias("r"), "u")
    pairs = own.unionAll(both).withColumn("sides", F.when((F.col("s") == F.col("r")) & (F.col("t") == F.col("u")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    pairs = pairs.withColumn("side", F.explode("sides")).withColumn("pair", F.struct("s", "t", "r", "u"))
    first = F.col("side") == 0
    return pairs.select("label", "dim", F.when(first, F.col("s")).otherwise(F.col("r")).alias("slice"), F.when(first, F.col("t")).otherwise(F.col("u")).alias("tile"), "pair", "side")


def similar_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    x = F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>")
    fit = F.coalesce(F.exists("v", lambda v: v != 0) & ~F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), x.alias("v"))
    rows = rows.withColumn("fit", fit & F.col("id").isNotNull() & F.col("label").isNotNull())
    rows = rows.withColumn("c0", F.when(F.col("fit"), F.xxhash64("label", "v"))).withColumn("c1", F.when(F.col("fit"), F.xxhash64(F.lit(11), F.col("v"))))
    ids = materialize(rows.select("id", "label", "c0", "c1"), "vector-ids")

    def packed(batches):
        for batch in batches:
            v = batch.column(4)
            flat, off = v.values.to_numpy(zero_copy_only=False).astype(kind), v.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], batch.column(5), pa.array(np.diff(off), pa.int32()), pa.array([flat[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())], ["label", "c0", "c1", "id", "n", "dim", "x"])

    classes = rows.filter("fit").groupBy("label", "c0", "c1").agg(F.min("id").alias("id"), F.any_value("v").alias("v"), F.count("*").alias("n"))
    shape = "label string, c0 long, c1 long, id long, n long, dim int, x binary"
    classes = materialize(classes.select("label", "c0", "c1", "id", "v", "n").mapInArrow(packed, shape), "vector-classes")

    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    main = common.dim if common and common.dim <= MOST_DIMS else 0
    shared = spark.sparkContext.broadcast(principal_directions(classes.filter(F.col("dim") == main), main, kind) if main else None)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def sliced(batches):
        for batch in batches:
            dims = batch.column(5).to_numpy()
            leading = np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                u = unit(_matrix(batch.column(6).take(pa.array(at)), kind, d))
                leading[at] = u @ shared.value[:, 0] if d == main else u[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.floor((leading + 1) / width).astype(np.int32))], [*batch.schema.names, "slice"])

    placed = materialize(classes.mapInArrow(sliced, f"{shape}, slice int"), "vector-slices")
    slices = materialize(placed.groupBy("label", "dim", "slice").count(), "slice-sizes")
    tiled = placed.join(slices, ["label", "dim", "slice"]).withColumn("tile", F.pmod(F.col("c1"), F.ceil(F.col("count") / tile)).cast("int"))
    met = tiled.join(materialize(tile_pairs(slices, tile), "tile-pairs"), ["label", "dim", "slice", "tile"]).select("label", "dim", "pair", "side", "id", "c0", "n", "x")

    def settle(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        table = table.sort_by([("side", "ascending"), ("id", "ascending"), ("c0", "ascending")])
        ids, c0, n, side = (table.column(k).to_numpy().astype(np.int64) for k in ("id", "c0", "n", "side"))
        return pa.Table.from_batches([compare_tiles(ids, c0, n, side, _matrix(table.column("x"), kind, dim), shared.value if dim == main else None, threshold)])

    links = met.groupBy("label", "dim", "pair").applyInArrow(settle, "id long, c0 long, other_id long, other_c0 long, links long")
    links = materialize(links, "vector-links")
    node = F.struct("id", "c0")
    counts = links.filter("other_id IS NULL").groupBy("id", "c0").agg(F.sum("links").alias("links"))
    found = components(links.filter("other_id IS NOT NULL").select(node.alias("a"), F.struct(F.col("other_id").alias("id"), F.col("other_c0").alias("c0")).alias("b")))
    found = found.select("node.id", "node.c0", F.col("root.id").alias("component"))
    # A class is known by its least id and one of its hashes.
    known = classes.select("label", "c0", "c1", "id", "n").join(counts, ["id", "c0"], "left").join(found, ["id", "c0"], "left")
    known = known.select("label", "c0", "c1", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = ids.join(materialize(known, "vector-components").hint("merge"), ["label", "c0", "c1"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors of one label link if their cosine is at least ``THRESHOLD``, that is if their
unit vectors are within the squared distance 2 - 2 * THRESHOLD.  Unit vectors are
rotated (principal axes of a bounded sample; any orthonormal matrix is exact) and split
into ``BLOCKS`` blocks of coordinates.  A block's budget is its share, by dimensions,
of the squared distance; a linked pair keeps within the budget in at least one block.

Each block is range-joined on a grid over its leading coordinates.  Cells are two radii
wide; along each of these coordinates a vector within a radius above its cell's lower
edge also visits the cell below.  Two vectors within a radius share exactly one cell in
which, along every coordinate, one of them at least is at home.  How many coordinates
carry the grid is chosen from the sample, for the number of vectors of the largest label:
none where the pairs spared would not outweigh the copies made, as in a block whose
coordinates spread little beyond the radius.  That choice moves work, never results.  Inside a cell the block distances of all pairs are screened,
survivors are verified by the exact cosine in double precision, and a pair counts in the
first block whose budget it keeps, so the union over blocks has no pair twice.

Identical vectors of a label are one class with a multiplicity and a number of its own.
A cell over ``TILE`` entries is dealt out as pairs of chunks.  A tile returns the number
of links of each class and one edge to the smallest class it reaches there, never the pairs.

Defined results: null, zero or non-finite vectors, null components, and null labels
link with nothing and are their own component; vectors of different lengths do not
link; rows with the same id are different vectors with the same name; a null id counts
as the smallest and comes back as null; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import NULL_ID, connected_components, stored

THRESHOLD = 0.93
BLOCKS = 4
TILE = 2048
#: Rows of the sample that the rotation is fitted on.
SAMPLE = 4096
#: Coordinates of a block that may carry its grid, and the pairs that one more copy of a vector may cost.
MAX_GRID = 6
COPY_COST = 200
#: Survivors that are verified at once.
VERIFY = 1 << 15
_SLACK = 1e-9


def rotation(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors, as columns, strongest first."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    unit = unit - unit.mean(axis=0)
    return np.linalg.eigh(unit.T @ unit)[1][:, ::-1].copy()


def blocks_of(dims: int, blocks: int = BLOCKS) -> list[np.ndarray]:
    """The coordinates of each block, dealt in turn so that each leads with a strong one."""
    return [np.arange(b, dims, blocks) for b in range(min(blocks, dims))]


def budgets(dims: int, threshold: float, blocks: int = BLOCKS) -> list[float]:
    return [(2 - 2 * threshold) * len(c) / dims * (1 + _SLACK) + 1e-12 for c in blocks_of(dims, blocks)]


def radius_of(budget: float) -> float:
    return float(np.sqrt(budget) * (1 + 1e-9))


def _base(radius: float) -> int:
    """More than the number of cells along a coordinate of unit vectors, the visited one below included."""
    return 2 * int(np.ceil(1 / (2 * radius))) + 4


def entries(turned: np.ndarray, columns: np.ndarray, radius: float, grid: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask, rows, cells): the rows' own cells (mask 0) and those they visit, a bit for each coordinate they visit along."""
    at = turned[:, columns[:grid]] / (2 * radius)
    cell = np.floor(at)
    low = at - cell <= 0.5 + 1e-9
    base = _base(radius)
    for mask in range(1 << grid):
        along = np.array([mask >> k & 1 for k in range(grid)], np.int64)
        pick = np.flatnonzero(low[:, along == 1].all(axis=1))
        digits = cell[pick].astype(np.int64) - along + base // 2
        yield mask, pick, digits @ np.array([base**k for k in range(grid)], np.int64)


def grids(turned: np.ndarray, threshold: float, size: int) -> list[int]:
    """For each block the coordinates of its grid, by the cost that a sample suggests for ``size`` vectors."""
    dims, out = turned.shape[1], []
    for columns, budget in zip(blocks_of(dims), budgets(dims, threshold)):
        radius = radius_of(budget)
        most = min(MAX_GRID, len(columns), int(62 / np.log2(_base(radius))))
        costs = []
        for grid in range(most + 1):
            cells = np.concatenate([c for _, _, c in entries(turned, columns, radius, grid)])
            full = np.unique(cells, return_counts=True)[1] / len(turned)
            costs.append(float((full**2).sum()) / 2 * size * size + COPY_COST * float(full.sum()) * size)
            if grid > 1 and costs[-1] >= min(costs[:-1]):
                break
        out.append(int(np.argmin(costs)))
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _plan(shared, dims: int) -> tuple[np.ndarray, list[int]]:
    """The axes and grids fitted on the sample; vectors of another length keep their axes and have no grid."""
    axes, grid = shared.value
    return (axes, grid) if axes is not None and len(axes) == dims else (np.eye(dims), [0] * BLOCKS)


def _deal(shared, threshold: float):
    """Each vector to its own cell and the cells it visits, in every block."""

    def run(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("v")], np.int64)
            for dims in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                axes, grid = _plan(shared, dims)
                turned = _unit(_rows(own.column("v"))) @ axes
                for b, (columns, budget) in enumerate(zip(blocks_of(dims), budgets(dims, threshold))):
                    for mask, pick, cell in entries(turned, columns, radius_of(budget), grid[b]):
                        part, k = own.take(pa.array(pick)), len(pick)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("label"), part.column("rep"), part.column("n"), part.column("v"), pa.array(np.full(k, dims, np.int32)), pa.array(np.full(k, b, np.int32)), pa.array(cell), pa.array(np.full(k, mask, np.int32))],
                            ["label", "rep", "n", "v", "dims", "block", "cell", "mask"],
                        )

    return run


def _tile(shared, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        get = lambda c: table.column(c).to_numpy()
        block, dims, i, j = (int(get(c)[0]) for c in ("block", "dims", "i", "j"))
        rep, n, mask, own = get("rep"), get("n"), get("mask"), get("own")
        rows = _rows(table.column("v").chunk(0) if table.column("v").num_chunks else table.column("v").combine_chunks())
        norms = np.linalg.norm(rows, axis=1)
        turned = (rows / norms[:, None]) @ _plan(shared, dims)[0]
        columns, budget = blocks_of(dims), budgets(dims, threshold)
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        links = np.zeros(len(rep), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        z = turned[:, columns[block]]
        square = (z**2).sum(axis=1)
        for a in range(0, len(left), 512):
            some = left[a : a + 512]
            apart = square[some][:, None] + square[right][None, :] - 2 * (z[some] @ z[right].T)
            near = apart <= budget[block] + 1e-7
            near &= (mask[some][:, None] & mask[right][None, :]) == 0
            if i == j:
                near &= some[:, None] < right[None, :]
            p, q = np.nonzero(near)
            p, q = some[p], right[q]
            for c in range(0, len(p), VERIFY):
                x, y = p[c : c + VERIFY], q[c : c + VERIFY]
                ok = np.einsum("ij,ij->i", rows[x], rows[y]) / (norms[x] * norms[y]) >= threshold
                x, y = x[ok], y[ok]
                difference = (turned[x] - turned[y]) ** 2
                ok = difference[:, columns[block]].sum(axis=1) <= budget[block]
                for earlier in range(block):
                    ok &= difference[:, columns[earlier]].sum(axis=1) > budget[earlier]
                x, y = x[ok], y[ok]
                if len(x):
                    links += np.bincount(x, n[y], len(rep)).astype(np.int64) + np.bincount(y, n[x], len(rep)).astype(np.int64)
                    ends.append((x, y))
        root = np.arange(len(rep))
        while ends:
            before = root.copy()
            for x, y in ends:
                low = np.minimum(root[x], root[y])
                np.minimum.at(root, x, low)
                np.minimum.at(root, y, low)
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(links)
        return pa.table([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], ["rep", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(
        F.coalesce(vectors["vec_id"].cast("long"), F.lit(NULL_ID)).alias("id"), vectors["label"].cast("string").alias("label"), vectors["embedding"].cast(kind).alias("v")
    )
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    # Written once, so that the numbers of the classes stay what they are.
    reps = rows.where("usable").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()))
    sample = [r.v for r in reps.orderBy(F.xxhash64("label", "v"), "rep").limit(SAMPLE).select("v").collect()]
    most = max({len(v) for v in sample}, key=[len(v) for v in sample].count) if sample else 0
    axes, grid = None, None
    if most:
        fit = np.array([v for v in sample if len(v) == most], np.float64)
        axes = rotation(fit)
        grid = grids(_unit(fit) @ axes, threshold, int(reps.groupBy("label").count().agg(F.max("count")).first()[0]))
    shared = spark.sparkContext.broadcast((axes, grid))  # dims x dims
    dealt = reps.select("label", "rep", "n", "v").mapInArrow(_deal(shared, threshold), f"label string, rep long, n long, v {kind}, dims int, block int, cell long, mask int")
    key = ["label", "dims", "block", "cell"]
    sizes = dealt.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1")
    tiles = dealt.join(sizes, key).withColumn("chunks", F.ceil(F.col("size") / TILE).cast("int"))
    tiles = tiles.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    tiles = tiles.select(*key, "i", "j", "own", "mask", "rep", "n", "v")
    found = stored(tiles.groupBy(*key, "i", "j").applyInArrow(_tile(shared, threshold), "rep long, links long, root long"))
    degrees = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = reps.join(degrees, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    known = known.select("label", "v", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class"))
    names = known.groupBy("class").agg(F.min("first").alias("component"))
    known = known.join(names, "class").select("label", "v", "n_links", "component")
    out = rows.where("usable").join(known, ["label", "v"]).select("id", "n_links", "component")
    out = out.unionByName(rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").alias("vec_id"), "n_links", real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))

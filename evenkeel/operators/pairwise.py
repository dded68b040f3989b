"""Pairwise operators in blocks: neighbours, mean distances, Gower, bounded near-duplicates, skylines.

Both sides are dealt into blocks of about ``ROWS`` rows by a hash of their id and written
once; every pair of blocks is computed with numpy where it is read and reduced to a few
numbers per row before anything is shuffled.  Nothing is broadcast and no pair is emitted.  The
work is the product of both sides, as the exact answer needs; where a distance bound is
given, :func:`near` turns it into an equi-join on grid cells instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import finite

ROWS = 1024


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(np.float64) if column.num_chunks else np.zeros(0)
    return flat.reshape(len(column), -1)


def _by_size(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """|x - y| over the larger of both sizes and 1; a gap counts 1."""
    return np.nan_to_num(np.abs(x - y) / np.maximum(np.maximum(np.abs(x), np.abs(y)), 1.0), nan=1.0)


def distances(metric: str, a: np.ndarray, b: np.ndarray, categories: int = 0) -> np.ndarray:
    """All distances of two matrices.  ``gower``: the last ``categories`` columns are codes, the others scaled by range; a gap counts 1.
    ``gower-raw``: the same for columns without a known range, each difference over the larger size of the two, at least 1."""
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
    out = np.zeros((len(a), len(b)))
    split = a.shape[1] - (categories if metric.startswith("gower") else 0)
    for k in range(a.shape[1]):
        x, y = a[:, k][:, None], b[:, k][None, :]
        if metric == "euclidean":
            out += (x - y) ** 2
        elif k < split and metric == "gower-raw":
            out += _by_size(x, y)
        elif k < split:
            out += np.nan_to_num(np.abs(x - y), nan=1.0)
        else:
            out += ~(x == y)
    return np.sqrt(out) if metric == "euclidean" else out / max(1, a.shape[1])


#: Bytes that Spark hands to a Python worker at once: a pair of blocks is one row.
BATCH_BYTES = 32 << 20


def _packed(df: DataFrame, rows: int, parts: int) -> DataFrame:
    """One row per block of about ``rows`` rows: (b, ids, v), the vectors in one value; written once."""
    from ..functions.reliable import checkpoint

    n, kind = max(1, -(-df.count() // rows)), dict(df.dtypes)["id"]
    own = df.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b"))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        return pa.table({"b": table.column("b")[:1], "ids": pa.array([ids.to_pylist()], pa.list_(ids.type)), "v": pa.array([_matrix(table.column("v")).tobytes()], pa.binary())})

    return checkpoint(own.groupBy("b").applyInArrow(pack, f"b int, ids array<{kind}>, v binary").repartition(min(n, parts)))


def blocks(left: DataFrame, right: DataFrame, each: Callable, schema: str, rows: int = ROWS, half: bool = False) -> DataFrame:
    """``each(ids_left, matrix_left, ids_right, matrix_right)`` for every pair of blocks of (id, v) frames.

    Each side is written once, a row per block, and pairs of blocks are made as they are
    read: no copy of a row is shuffled.  ``half``: both sides are the same frame, a pair of
    blocks is met once, and ``each`` is also told how often it counts, 1 or 2 times.
    """
    spark = left.sparkSession
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    parts = math.ceil(2 * math.sqrt(spark.sparkContext.defaultParallelism))  # of either side: about four tasks a core
    a = _packed(left, rows, parts)
    b = a if half else _packed(right, rows, parts)
    both = a.toDF("lb", "li", "lv").crossJoin(b.toDF("rb", "ri", "rv"))  # a row per pair of blocks, computed where it is made
    both = both.where("lb <= rb") if half else both
    fields = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own: list = []
                for s in "lr":
                    ids = batch.column(f"{s}i")[i].values.to_numpy(zero_copy_only=False)
                    own += [ids, np.frombuffer(batch.column(f"{s}v")[i].as_py(), np.float64).reshape(len(ids), -1)]
                found = each(*own, *([1 if batch.column("lb")[i] == batch.column("rb")[i] else 2] if half else []))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for (_, t), x in zip(fields, found)], [n for n, _ in fields])

    return both.mapInArrow(run, schema)


_ARROW = {"smallint": pa.int16(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "date": pa.date32()}


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(n, _ARROW[t]) for n, t in (x.split() for x in schema.split(","))]


def neighbours(left: DataFrame, right: DataFrame, k: int, metric: str = "euclidean", exclude_self: bool = False, categories: int = 0) -> DataFrame:
    """(id, neighbour, distance, place): the k nearest of ``right`` for each row of ``left``; ties by id."""

    def each(ids, a, others, b):
        found: list[tuple] = []
        rank = np.argsort(np.argsort(others, kind="stable"), kind="stable")
        for at in range(0, len(ids), 256):
            d = np.round(distances(metric, a[at : at + 256], b, categories), 9)
            if exclude_self:
                d[ids[at : at + 256][:, None] == others[None, :]] = np.inf
            d = np.where(np.isnan(d), np.inf, d)
            for row, x in enumerate(d):
                best = np.lexsort((rank, x))[:k]
                best = best[np.isfinite(x[best])]
                found += [(ids[at + row], others[j], x[j]) for j in best]
        return zip(*found) if found else ([], [], [])

    kind = dict(left.dtypes)["id"].replace("bigint", "long")
    near = blocks(left, right, each, f"id {kind}, neighbour {kind}, distance double")
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))  # k rows per block of the right side
    return near.withColumn("place", place).where(F.col("place") <= k)


def nearest(left: DataFrame, right: DataFrame, metric: str = "euclidean", exclude_self: bool = False, categories: int = 0) -> DataFrame:
    """(id, distance): the smallest distance to the other side."""

    def each(ids, a, others, b):
        out = []
        for at in range(0, len(ids), 256):
            d = distances(metric, a[at : at + 256], b, categories)
            if exclude_self:
                d[ids[at : at + 256][:, None] == others[None, :]] = np.inf
            out.append(np.min(np.where(np.isnan(d), np.inf, d), axis=1))
        return ids, np.concatenate(out)

    kind = dict(left.dtypes)["id"].replace("bigint", "long")
    return blocks(left, right, each, f"id {kind}, distance double").groupBy("id").agg(F.min("distance").alias("distance"))


def total_distance(left: DataFrame, right: DataFrame, metric: str = "euclidean", categories: int = 0) -> DataFrame:
    """(id, total): the sum of distances to all of the other side."""

    def each(ids, a, others, b):
        return ids, np.concatenate([distances(metric, a[at : at + 256], b, categories).sum(axis=1) for at in range(0, len(ids), 256)])

    kind = dict(left.dtypes)["id"].replace("bigint", "long")
    return blocks(left, right, each, f"id {kind}, total double").groupBy("id").agg(F.sum("total").alias("total"))


def mean_pairwise(df: DataFrame, metric: str = "euclidean", categories: int = 0) -> DataFrame:
    """One row: the mean distance over all unordered pairs; null with fewer than two rows.

    Gower distance is a sum over columns and needs no pairs.  For other metrics equal
    vectors are one row with a weight, and every pair of those is met once.
    """
    if metric == "gower":
        return _mean_gower(df, categories)
    n = df.count()

    def each(ids, a, others, b, times):
        parts = [(distances(metric, a[at : at + 256, :-1], b[:, :-1], categories) @ b[:, -1]) @ a[at : at + 256, -1] for at in range(0, len(ids), 256)]
        return [[times * sum(parts)]]

    one = df.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", F.array_append(F.transform("v", lambda x: x.cast("double")), F.col("n").cast("double")).alias("v"))
    return blocks(one, one, each, "total double", half=True).agg(F.try_divide(F.sum("total"), F.lit(float(n * (n - 1)))).alias("mean_distance"))


def _mean_gower(df: DataFrame, categories: int) -> DataFrame:
    """The mean Gower distance from counted values: the differences of a column add up from each value's place in its order.

    A number that is missing, NaN or infinite is a gap, which counts 1 against any other row.
    """
    from ..functions.reliable import checkpoint

    n = df.count()
    long = df.select(F.posexplode(F.transform("v", finite)).alias("at", "x"), F.size("v").alias("size"))
    counts = long.groupBy("at", "size", "x").agg(F.count("*").cast("double").alias("c"))
    # Range partitions hold values in order, so a value's place is the rows of the partitions before and of its own.
    counts = checkpoint(counts.repartitionByRange("at", "x").withColumn("p", F.spark_partition_id()))
    known = counts.where("x IS NOT NULL")
    earlier = Window.partitionBy("at").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row per column and partition
    starts = known.groupBy("at", "p").agg(F.sum("c").alias("m")).select("at", "p", F.coalesce(F.sum("m").over(earlier), F.lit(0.0)).alias("before"), F.sum("m").over(Window.partitionBy("at")).alias("all"))
    inside = F.coalesce(F.sum("c").over(Window.partitionBy("at", "p").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = known.withColumn("inside", inside).join(F.broadcast(starts), ["at", "p"])
    below = F.col("before") + F.col("inside")
    pairs, total = F.lit(float(n) * (n - 1)), F.first("all")
    numeric = pairs - total * (total - 1) + 2 * F.sum(F.col("x") * F.col("c") * (2 * below + F.col("c") - F.col("all")))
    unequal = pairs - F.sum(F.col("c") * (F.col("c") - 1))
    size = F.first("size")
    column = placed.groupBy("at").agg(F.when(F.col("at") >= size - categories, unequal).otherwise(numeric).alias("total"))
    blank = counts.groupBy("at").agg(F.count("x").alias("k")).where("k = 0").select("at", pairs.alias("total"))  # columns of gaps only
    size = counts.agg(F.max("size").alias("size"))
    out = column.unionByName(blank).agg(F.sum("total").alias("total")).crossJoin(size)  # one row each
    return out.select(F.try_divide(F.col("total"), F.col("size") * pairs).alias("mean_distance"))


def least_distance(df: DataFrame, columns: Sequence[str], rows: int = ROWS) -> DataFrame:
    """One row: the smallest Euclidean distance of two rows of (id, columns); null if no two rows have all numbers.

    The least distance inside blocks of ``rows`` rows bounds the answer; what is closer lies in
    neighbouring cells of that width.
    """
    columns, spark = list(columns), df.sparkSession
    own = df.select("id", *[finite(F.col(c)).alias(c) for c in columns]).dropna(subset=columns)
    one = own.groupBy(*columns).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    found = one.agg(F.count("*").alias("k"), F.max("n").alias("n")).first()
    answer = lambda x: spark.createDataFrame([(x,)], "min_distance double")
    if found.k == 0 or (found.k == 1 and found.n == 1):
        return answer(None)
    if found.n > 1:
        return answer(0.0)

    def least(table: pa.Table) -> pa.Table:
        v = np.stack([table.column(c).to_numpy() for c in columns], axis=1)
        best = np.inf
        for at in range(0, len(v), 256):
            d = distances("euclidean", v[at : at + 256], v)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            best = min(best, d.min())
        return pa.table({"d": [float(best)]})

    n = -(-found.k // rows)
    bound = one.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("b")).applyInArrow(least, "d double").agg(F.min("d")).first()[0]
    if n == 1 or not bound:
        return answer(bound)
    if not math.isfinite(bound):  # every block holds one row
        return least_distance(df, columns, 2 * rows)
    a = _cells(one, columns, bound, 2)
    keys = [f"k{i}" for i in range(len(columns[:2]))]
    b = _around(a.select(F.col("id").alias("other"), *[F.col(c).alias(f"b_{c}") for c in columns], *keys), keys)
    gap = sum(((F.col(c) - F.col(f"b_{c}")) ** 2 for c in columns), F.lit(0.0))
    closer = a.join(b.hint("shuffle_merge"), keys).where("id != other").agg(F.min(F.sqrt(gap)).alias("d"))
    return closer.select(F.least(F.col("d"), F.lit(float(bound))).alias("min_distance"))


def near(left: DataFrame, right: DataFrame, columns: Sequence[str], bound: float, grid: int = 2) -> DataFrame:
    """(id, other): pairs closer than the bound in Euclidean distance, by an equi-join on grid cells.

    Cells are ``bound`` wide in the first ``grid`` columns, so a pair within the bound is
    in neighbouring cells; the left side is sent to all of them.
    """
    keys = list(columns)[:grid]
    cell = lambda c: F.floor(F.col(c) / bound)
    moves = F.array(*[F.struct(*[F.lit(m).alias(f"m{i}") for i, m in enumerate(step)]) for step in product((-1, 0, 1), repeat=len(keys))])
    a = left.select(F.col("id").alias("id"), *[F.col(c).alias(f"a_{c}") for c in columns], *[cell(c).alias(f"k{i}") for i, c in enumerate(keys)], F.explode(moves).alias("m"))
    a = a.withColumns({f"k{i}": F.col(f"k{i}") + F.col(f"m.m{i}") for i in range(len(keys))}).drop("m")
    b = right.select(F.col("id").alias("other"), *[F.col(c).alias(f"b_{c}") for c in columns], *[cell(c).alias(f"k{i}") for i, c in enumerate(keys)])
    gap = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in columns), F.lit(0.0))
    return a.join(b, [f"k{i}" for i in range(len(keys))]).where(gap < bound * bound).select("id", "other")


def first_of_each(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, columns): the smallest id of each different vector of finite numbers."""
    own = df.select("id", *[finite(F.col(c)).alias(c) for c in columns]).dropna(subset=list(columns))
    return own.groupBy(*columns).agg(F.min("id").alias("id")).select("id", *columns)


def _cells(df: DataFrame, columns: Sequence[str], bound: float, grid: int) -> DataFrame:
    """With the cell ``k0``, ``k1``, ... of each row, ``bound`` wide in the first ``grid`` columns."""
    return df.withColumns({f"k{i}": F.floor(F.col(c) / bound) for i, c in enumerate(columns[:grid])})


def _around(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row once for its cell and for each cell next to it."""
    moves = F.array(*[F.struct(*[F.lit(m).alias(f"m{i}") for i, m in enumerate(step)]) for step in product((-1, 0, 1), repeat=len(keys))])
    return df.withColumn("__m", F.explode(moves)).withColumns({k: F.col(k) + F.col(f"__m.m{i}") for i, k in enumerate(keys)}).drop("__m")


def touching(left: DataFrame, right: DataFrame, columns: Sequence[str], bound: float, grid: int = 2) -> DataFrame:
    """The columns of ``left``, which has (id, columns), where some row of ``right`` is closer than the bound.

    A semi-join on the cells of :func:`near`: a row's search ends at its first hit and no pair is emitted.
    """
    columns = list(columns)
    keys = [f"k{i}" for i in range(len(columns[:grid]))]
    a = _around(_cells(left, columns, bound, grid), keys).select("id", *[F.col(c).alias(f"a_{c}") for c in columns], *[F.col(k).alias(f"a_{k}") for k in keys])
    b = _cells(right.select(*columns).distinct(), columns, bound, grid)
    gap = sum(((F.col(f"a_{c}") - F.col(c)) ** 2 for c in columns), F.lit(0.0))
    meet = reduce(lambda x, y: x & y, [F.col(f"a_{k}") == F.col(k) for k in keys]) & (gap < bound * bound)
    return a.join(b.hint("shuffle_merge"), meet, "left_semi").select("id", *[F.col(f"a_{c}").alias(c) for c in columns]).distinct()


def spaced(df: DataFrame, columns: Sequence[str], bound: float, grid: int = 2, local: int = 1 << 17) -> DataFrame:
    """(id): keep-first among different vectors: in the order of ``id``, without those closer than the bound to an earlier kept one.

    ``df`` has (id, columns), ids and vectors all different.  A round keeps the rows that are the
    first of what is undecided in their cell and all cells next to it, which nothing earlier
    can drop, and drops what is close to them; a cell holds few kept rows, so no round sees
    all pairs.  The last ``local`` rows are decided one after the other in one task.
    """
    from ..functions.reliable import checkpoint

    columns = list(columns)
    keys = [f"k{i}" for i in range(len(columns[:grid]))]
    kind = dict(df.dtypes)["id"]
    left = checkpoint(_cells(df.select("id", *columns), columns, bound, grid))
    kept = None
    while left.count() > local:
        first = left.groupBy(*keys).agg(F.min("id").alias("first"))
        least = _around(first, keys).groupBy(*keys).agg(F.min("first").alias("least"))
        new = checkpoint(left.join(least.hint("shuffle_merge"), keys).where(F.col("id") == F.col("least")).select(*left.columns))
        kept = new.select("id") if kept is None else kept.unionByName(new.select("id"))
        gone = _around(new.select(*[F.col(c).alias(f"b_{c}") for c in columns], *keys), keys).withColumnsRenamed({k: f"b_{k}" for k in keys})
        gap = sum(((F.col(c) - F.col(f"b_{c}")) ** 2 for c in columns), F.lit(0.0))
        meet = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"b_{k}") for k in keys]) & (gap < bound * bound)
        left = checkpoint(left.join(gone.hint("shuffle_merge"), meet, "left_anti"))

    def rest(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        at = pa.compute.sort_indices(ids).to_numpy()
        v = np.stack([table.column(c).to_numpy() for c in columns], axis=1)
        cells = np.stack([table.column(k).to_numpy() for k in keys], axis=1).tolist()
        steps, held, out = list(product((-1, 0, 1), repeat=len(keys))), {}, []
        for i, x in zip(at.tolist(), v[at].tolist()):
            near_by = (y for step in steps for y in held.get(tuple(c + m for c, m in zip(cells[i], step)), ()))
            if not any(sum(((a - b) ** 2 for a, b in zip(x, y)), 0.0) < bound * bound for y in near_by):
                held.setdefault(tuple(cells[i]), []).append(x)
                out.append(i)
        return pa.table({"id": ids.take(pa.array(out, pa.int64()))})

    last = left.groupBy().applyInArrow(rest, f"id {kind}")  # ``local`` rows at most
    return last if kept is None else kept.unionByName(last)


def greedy(df: DataFrame, pairs: DataFrame, order: str = "id", max_rounds: int = 1000) -> DataFrame:
    """Keep-first: the rows of ``df`` left when each kept row drops the later rows it pairs with.

    ``pairs`` has (id, other).  A row is kept once all earlier rows it pairs with are
    dropped, and dropped once one of them is kept; rounds go on until all are decided.
    """
    from ..functions.reliable import checkpoint

    before = pairs.select(F.greatest("id", "other").alias("late"), F.least("id", "other").alias("early")).where("late != early").distinct()
    before = checkpoint(before)
    state = checkpoint(before.select(F.col("late").alias("id")).unionByName(before.select(F.col("early").alias("id"))).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    for _ in range(max_rounds):
        early = state.select(F.col("id").alias("early"), F.col("kept").alias("early_kept"))
        seen = before.join(early, "early").groupBy(F.col("late").alias("id")).agg(F.max(F.coalesce(F.col("early_kept"), F.lit(False))).alias("any_kept"), F.count(F.when(F.col("early_kept").isNull(), 1)).alias("open"))
        new = state.join(seen, "id", "left").select("id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("any_kept"), False).when(F.coalesce(F.col("open"), F.lit(0)) == 0, True).alias("kept"))
        state = checkpoint(new)
        if state.where("kept IS NULL").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"rows still undecided after {max_rounds} rounds")
    return df.join(state.where("NOT kept").select(F.col("id").alias(order)), order, "left_anti")


def skyline(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Distinct score tuples that no other dominates (all at least, one greater); NaN and null tuples never enter."""
    distinct = df.select(*scores).dropna().distinct()
    rows = distinct.select(F.xxhash64(*scores).alias("id"), F.array(*[F.col(c).cast("double") for c in scores]).alias("v"))

    def top(v: np.ndarray) -> np.ndarray:
        order = np.lexsort(v.T[::-1])[::-1]
        kept: list[int] = []
        for i in order:
            if not kept or not (v[kept] >= v[i]).all(axis=1).any():
                kept.append(int(i))
        return np.array(kept)

    def local(table: pa.Table) -> pa.Table:
        return table.take(pa.array(top(_matrix(table.column("v"))))).select(["id", "v"])

    part = rows.withColumn("part", F.pmod("id", F.lit(max(1, -(-distinct.count() // (8 * ROWS))))))
    survivors = part.groupBy("part").applyInArrow(local, "id long, v array<double>")

    def beaten(ids, a, others, b):
        return ids, np.array([bool(((b >= x).all(axis=1) & (b > x).any(axis=1)).any()) for x in a])

    out = blocks(survivors, survivors, beaten, "id long, beaten boolean").groupBy("id").agg(F.max("beaten").alias("beaten")).where("NOT beaten")
    kept = survivors.join(out, "id")
    return kept.select(*[F.col("v")[i].alias(c) for i, c in enumerate(scores)])

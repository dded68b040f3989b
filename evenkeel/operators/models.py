"""Operators that train models with pyspark.ml: regions, leaves, classifiers, discriminative anchors, thresholds."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..functions.reliable import checkpoint
from . import evaluate, pairwise, quantiles
from .propose import _draw

SEED = 42
#: Bins of a feature of boosted trees, the library's default, and the most that its search for them is set to.
BINS, MOST_BINS = 32, 1024
#: Cells of a task while trees are grown.
CELLS = 25_000


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="skip").transform(df)


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """``weight``: n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    weights = counts.crossJoin(total).select(F.col(label).alias("__label"), (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))  # one row per class
    return df.join(F.broadcast(weights), F.col(label) == F.col("__label")).drop("__label")  # one row per class


def regions(df: DataFrame, clusters: int, least: int = 5, k: int = 10) -> DataFrame:
    """Sparse regions of (id, v): per k-means cluster its size, density, radius, representative and priority, sparsest first.

    Density is 1 / (1 + mean distance to the k-th neighbour, a row counting as its own
    first); clusters under ``least`` rows are left out.
    """
    n = df.count()
    rows = df.withColumn("features", array_to_vector("v"))
    model = KMeans(k=max(1, clusters if n >= 10 else 1), seed=SEED).fit(rows)
    out = model.transform(rows).withColumnRenamed("prediction", "region")
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "region int, centre array<double>")
    gap = F.sqrt(F.aggregate(F.zip_with("v", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    out = out.join(F.broadcast(centres), "region").withColumn("radius", gap)  # one row per cluster
    # Neighbours inside a region: a coordinate far apart for each region keeps regions from meeting.
    apart = out.select("id", F.array_append("v", F.col("region") * 1e9).alias("v"))
    near = pairwise.neighbours(apart, apart, k).where("distance < 1e8").groupBy("id").agg(F.max("distance").alias("kth"))
    stats = out.join(near, "id").groupBy("region").agg(
        F.count("*").alias("n"), (1 / (1 + F.avg("kth"))).alias("density"), F.max("radius").alias("radius"), F.min_by("id", F.struct("radius", "id")).alias("representative")
    )
    priority = F.when(F.col("density") < 0.25, "high").when(F.col("density") < 0.5, "medium").otherwise("low")
    return stats.where(F.col("n") >= least).withColumn("priority", priority).orderBy("density", "region")


def diversity_targets(found: DataFrame, wanted: int = 100) -> DataFrame:
    """How many rows each region should get: inversely to its density, ``wanted`` in all."""
    share = (1 - F.col("density")) / F.sum(1 - F.col("density")).over(Window.partitionBy(F.lit(1)))  # one row per region
    return found.withColumn("n_target", F.ceil(F.coalesce(share, F.lit(0.0)) * wanted))


def cut_points(df: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """For each column the rising values that part its range into ``BINS`` bins at most, near equal in rows, or one for each value.

    They come from all rows, by counted values; a bin ends with its cut.
    """
    counts = checkpoint(quantiles.value_counts(df, columns))
    found = {r.c: r for r in quantiles.quantiles(counts, [i / BINS for i in range(1, BINS)]).collect()}  # a row per column
    few = [c for c, r in found.items() if r.n_unique <= BINS]
    cuts = {c: set(r.q) for c, r in found.items()} | {c: set() for c in few}
    for r in counts.where(F.col("c").isin(few)).select("c", "x").collect():  # BINS rows per column, at most
        cuts[r.c].add(r.x)
    return [sorted(cuts.get(c, ())) for c in range(len(columns))]


def bin_of(column: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """How many cuts lie below the value, found by halving."""
    if not cuts:
        return F.lit(float(first))
    at = len(cuts) // 2
    return F.when(column <= cuts[at], bin_of(column, cuts[:at], first)).otherwise(bin_of(column, cuts[at + 1 :], first + at + 1))


def leaves(df: DataFrame, columns: Sequence[str], label: str = "y", trees: int = 10, depth: int = 5) -> DataFrame:
    """(other columns..., tree, leaf, n_rows): the leaves that the rows reach in every tree of a boosted model.

    The trees see a column as ``BINS`` bins, so rows that share all bins and all columns
    but the features are one cell, with their number as ``n_rows``: the model is fitted on
    cells that weigh as many rows, and a cell is placed at once.  Every row counts; rows
    without a number in some feature are left out.
    """
    others = [c for c in df.columns if c not in columns]
    whole = [F.col(c).cast("double") for c in columns]
    rows = df.where(functools.reduce(lambda x, y: x & y, [x.isNotNull() & ~F.isnan(x) for x in whole]))
    bins = [f"__bin{i}" for i in range(len(columns))]
    cuts = cut_points(rows, columns)
    rows = rows.select(*others, *[bin_of(x, c).alias(b) for x, c, b in zip(whole, cuts, bins)])
    cells = assemble(checkpoint(rows.groupBy(*others, *bins).agg(F.count("*").alias("n_rows"))), bins)
    fitted = assemble(cells.groupBy(label, *bins).agg(F.sum("n_rows").cast("double").alias("weight")), bins)
    n = fitted.count()
    # The library looks for the bins in maxBins ** 2 cells: this many, so that it finds them all, up to a million cells.
    most = min(MOST_BINS, max(BINS, math.isqrt(n) + 1))
    # It runs a job for each level of each tree, and few cells take less than the start of a task does.
    parts = min(df.sparkSession.sparkContext.defaultParallelism, n // CELLS + 1)
    model = GBTClassifier(labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=SEED, maxBins=most)
    out = model.setLeafCol("leaves").fit(fitted.repartition(parts, *bins)).transform(cells)
    return out.select(*others, "n_rows", F.posexplode(vector_to_array("leaves")).alias("tree", "leaf")).select(*others, "tree", "leaf", "n_rows")


def leaf_fairness(placed: DataFrame, group: str) -> DataFrame:
    """(tree, leaf, n, fairness): 1 / (1 + sum over groups of |share overall - share in the leaf|).

    A row of ``placed`` stands for as many as its column ``n_rows`` says, if it has one.
    """
    own = placed.groupBy("tree", "leaf", F.col(group).alias("g")).agg((F.sum("n_rows") if "n_rows" in placed.columns else F.count("*")).alias("m"))
    whole = own.groupBy("tree", "g").agg(F.sum("m").alias("t"))
    whole = whole.withColumn("p", F.col("t") / F.sum("t").over(Window.partitionBy("tree")))  # one row per tree and group
    sizes = own.groupBy("tree", "leaf").agg(F.sum("m").alias("n"))
    grid = sizes.join(whole, "tree").join(own, ["tree", "leaf", "g"], "left")
    gap = F.sum(F.abs(F.col("p") - F.coalesce(F.col("m"), F.lit(0)) / F.col("n")))
    return grid.groupBy("tree", "leaf").agg(F.first("n").alias("n"), (1 / (1 + gap)).alias("fairness"))


def estimators(label: str = "y", n: int = 1000) -> dict:
    """Random forest, boosted trees and logistic regression with balanced class weights."""
    common = {"labelCol": label, "weightCol": "weight"}
    return {
        "random_forest": RandomForestClassifier(numTrees=50, maxDepth=10, seed=SEED, **common),
        "boosted_trees": GBTClassifier(maxIter=30, maxDepth=5, stepSize=0.1, seed=SEED, **common),
        "logistic_regression": LogisticRegression(maxIter=200, regParam=1.0 / max(1, n), **common),
    }


def compare_classifiers(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = "y", models: dict | None = None) -> DataFrame:
    """(classifier, confusion cells and metrics, roc_auc, pr_auc) on the test rows; any ml estimator can be passed."""
    fitted = class_weights(assemble(train, columns), label).persist()
    held = assemble(test, columns)
    out = None
    for name, estimator in (models or estimators(label, fitted.count())).items():
        p = estimator.fit(fitted).transform(held).select(F.col(label).alias("y"), F.col("prediction").cast("int").alias("pred"), vector_to_array("probability")[1].alias("score"))
        row = evaluate.classification(p).crossJoin(evaluate.roc_auc(p)).select(F.lit(name).alias("classifier"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def discriminative(df: DataFrame, columns: Sequence[str], n: int, key: str, label: str = "y") -> DataFrame:
    """n of the 2n minority rows that a random forest is surest of."""
    rows = class_weights(assemble(df, columns), label)
    model = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=30, maxDepth=6, seed=SEED).fit(rows)
    sure = model.transform(rows.where(F.col(label) == 1)).withColumn("p", F.round(vector_to_array("probability")[1], 9))
    return _draw(sure.orderBy(F.desc("p"), key).limit(2 * n).select(key, "p"), n, key, "discriminative")


def _clustered(df: DataFrame, clusters: int, seed: int) -> DataFrame:
    """(id, v) with ``region`` and the squared distance ``gap`` to its k-means centre."""
    rows = df.withColumn("features", array_to_vector("v"))
    model = KMeans(k=clusters, seed=seed).fit(rows)
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "region int, centre array<double>")
    gap = F.aggregate(F.zip_with("v", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return model.transform(rows).withColumnRenamed("prediction", "region").join(F.broadcast(centres), "region").withColumn("gap", gap)  # one row per cluster


def central(df: DataFrame, clusters: int, seed: int = SEED) -> DataFrame:
    """(region, id): the row of (id, v) closest to each k-means centre; empty clusters give none."""
    return _clustered(df, clusters, seed).groupBy("region").agg(F.min_by("id", F.struct("gap", "id")).alias("id"))


def representatives(df: DataFrame, keep: int) -> DataFrame:
    """(id): a memory of (id, v) cut to the rows closest to ``keep`` k-means centres; all rows where there are no more than that."""
    return central(df, keep).select("id").distinct() if df.limit(keep + 1).count() > keep else df.select("id")


def diverse(df: DataFrame, n: int, iteration: int = 0, previous: DataFrame | None = None) -> DataFrame:
    """(id): of 2n k-means clusters of (id, v) a hash-drawn row each, then the n farthest from ``previous`` rows, or the first n."""
    total = df.limit(2 * n).count()
    if total <= n:
        return df.select("id")
    drawn = _clustered(df, total, SEED + 13 * iteration).groupBy("region").agg(F.min_by(F.struct("id", "v"), F.struct(uniform(F.col("id"), f"diverse {iteration}"), "id")).alias("e"))
    drawn = drawn.select("region", "e.id", "e.v")  # 2n rows at most
    if previous is None or previous.limit(1).count() == 0:
        return drawn.orderBy("region").limit(n).select("id")
    far = pairwise.nearest(drawn.select("id", "v"), previous.select("id", "v"))
    return far.orderBy(F.desc(F.round("distance", 9)), "id").limit(n).select("id")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count, sums and sums of products of its vectors, as one list."""
    total = 0.0
    for batch in batches:
        if batch.num_rows:
            v = pairwise._matrix(pa.chunked_array([batch.column("v")]))
            v = np.hstack([np.ones((len(v), 1)), v])
            total = total + v.T @ v
    if np.ndim(total):
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["p"])


def dimensions(df: DataFrame, share: float = 0.95) -> tuple[int, int]:
    """(how many principal axes hold that share of the variance, all dimensions) of (id, v); products are added up per cell."""
    rows = df.select(F.transform("v", lambda x: x.cast("double")).alias("v"))
    cells = rows.mapInArrow(_products, "p array<double>").select(F.posexplode("p").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()  # (dims + 1) ** 2 numbers
    if not cells:
        return 0, 0
    p = np.array([r.x for r in cells]).reshape(round(math.sqrt(len(cells))), -1)
    mean = p[0, 1:] / p[0, 0]
    held = np.cumsum(np.linalg.eigvalsh(p[1:, 1:] / p[0, 0] - np.outer(mean, mean))[::-1])
    return int(np.searchsorted(held / max(held[-1], 1e-12), share)) + 1, len(mean)


def similarity_threshold(df: DataFrame, label: str = "y", sample: int = 200, neighbours: int = 5) -> DataFrame:
    """One row: the similarity beyond which a row counts as a duplicate, from (id, y, v), within 0.75 and 0.95.

    0.80, more for many rows, few independent dimensions and a dense minority, less for
    imbalance.  Dimensions are scaled to unit deviation; density is the mean distance to
    the last of ``neighbours`` neighbours in a seeded sample of the minority.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # two rows
    n, low = sum(counts.values()), min(counts.values(), default=0)
    ratio = max(counts.values(), default=0) / max(1, low)
    minority = min(counts, key=lambda k: (counts[k], k)) if counts else None
    sums = df.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("at").collect()  # a row per dimension
    scale = F.array(*[F.struct(F.lit(float(r.m)).alias("m"), F.lit(float(r.s or 1.0)).alias("s")) for r in sums])
    scaled = df.withColumn("v", F.zip_with("v", scale, lambda x, y: (x - y.m) / y.s)) if sums else df
    dim, dims = dimensions(scaled)
    some = _draw(scaled.where(F.col(label) == minority), sample, "id", "similarity").select("id", "v")
    k = min(neighbours, max(0, min(sample, low) - 1))
    far = pairwise.neighbours(some, some, k, exclude_self=True).where(F.col("place") == k).agg(F.avg("distance")).first()[0] if k else None
    parts = (0.10 * math.log10(max(n, 100)) / 5, 0.05 * (1 - dim / dims) if dims > 1 else 0.0, -0.05 * min(ratio / 10, 1.0), 0.05 / (1 + far) if far is not None else 0.0)
    found = float(min(0.95, max(0.75, 0.80 + sum(parts))))
    return df.sparkSession.createDataFrame([(n, float(ratio), dim, far, found)], "n_rows long, ratio double, dim95 int, mean_neighbour double, threshold double")


def mean_leaf_fairness(leaves: DataFrame) -> DataFrame:
    """One row: the mean of :func:`leaf_fairness` over all leaves."""
    return leaves.agg(F.avg("fairness").alias("mean_fairness"), F.count("*").alias("n_leaves"))


def near_duplicate_threshold(df: DataFrame, n_rows: int, ratio: float, sample: int = 500) -> DataFrame:
    """One row: the threshold from size, dimensions that hold 95 percent of the variance, imbalance and density, within 0.05 and 0.5.

    The covariance is one aggregation over (id, v); neighbours are measured on a seeded sample.
    """
    dim95, dims = dimensions(df)
    some = _draw(df, sample, "id", "threshold")
    nn = pairwise.nearest(some, some, exclude_self=True).agg(F.avg("distance")).first()[0] or 0.0
    t = 0.10 + 0.02 * math.log10(max(1, n_rows)) + 0.05 * dim95 / dims - 0.01 * math.log2(max(1.0, ratio)) + 0.05 / (1 + nn)
    return df.sparkSession.createDataFrame([(dim95, float(nn), float(min(0.5, max(0.05, t))))], "dim95 int, mean_nn double, threshold double")

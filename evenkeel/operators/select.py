"""Selection: weighted scores, Pareto, universal and diversity-first selection, DPP, diversity measures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pairwise
from .transform import moments, with_moments


def fairness_score(targets: Sequence[tuple[Column, int]]) -> Column:
    """Mean over targets of 1.0, 0.7 or 0.5 (matched, by priority 1 to 3) or 0.1 (not matched); 1 without targets."""
    if not targets:
        return F.lit(1.0)
    parts = [F.when(match, {1: 1.0, 2: 0.7}.get(priority, 0.5)).otherwise(0.1) for match, priority in targets]
    return sum(parts, F.lit(0.0)) / len(parts)


def distance_score(distance: Column) -> Column:
    """min(1, d / 5), plus up to 0.2 for d over 3, capped at 1."""
    return F.when(distance > 3, F.least(F.lit(1.0), F.least(F.lit(1.0), distance / 5) + F.least(F.lit(0.2), (distance - 3) / 10))).otherwise(F.least(F.lit(1.0), distance / 5))


def weighted_top(df: DataFrame, n: int, fairness: float, diversity: float, quality: float, key: str = "id") -> DataFrame:
    """The n best by normalised weights over ``fairness``, ``diversity`` and ``quality``; ties by key."""
    total = fairness + diversity + quality
    score = F.col("fairness") * (fairness / total) + F.col("diversity") * (diversity / total) + F.col("quality") * (quality / total)
    return df.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), key).limit(n)


def universal_scores(df: DataFrame, train: DataFrame, weight: float = 0.5) -> DataFrame:
    """(id, diversity, novelty, score) of (id, v): mean distance within and least distance to train, each by its maximum."""
    n = df.count()
    inner = pairwise.total_distance(df, df).select("id", (F.col("total") / max(1, n)).alias("d"))
    outer = pairwise.nearest(df, train).select("id", F.col("distance").alias("o"))
    both = inner.join(outer, "id")
    most = both.agg(F.max("d").alias("dm"), F.max("o").alias("om"))
    out = both.crossJoin(F.broadcast(most))  # one row
    d = F.lit(1.0) if n == 1 else F.coalesce(F.try_divide("d", "dm"), F.lit(0.0))
    out = out.select("id", d.alias("diversity"), F.coalesce(F.try_divide("o", "om"), F.lit(0.0)).alias("novelty"))
    return out.withColumn("score", weight * F.col("diversity") + (1 - weight) * F.col("novelty"))


def universal_select(df: DataFrame, train: DataFrame, n: int, weight: float = 0.5) -> DataFrame:
    return universal_scores(df, train, weight).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(n)


def diversity_first(df: DataFrame, train: DataFrame, n: int, ratio: float = 0.5) -> DataFrame:
    """(id, stage): the int(n * ratio) rows farthest from train, then the best of the rest by 0.6 fidelity + 0.3 spread + 0.1.

    ``df`` has (id, v, fidelity).  With n rows or fewer all are returned at stage 1.
    """
    if df.count() <= n:
        return df.select("id", F.lit(1).alias("stage"))
    first_n = int(n * ratio)
    far = pairwise.nearest(df.select("id", "v"), train).withColumn("distance", F.round("distance", 9)).orderBy(F.desc("distance"), "id").limit(first_n).select("id")
    rest = df.join(far, "id", "left_anti")
    if first_n:
        spread = pairwise.nearest(rest.select("id", "v"), df.join(far, "id", "left_semi").select("id", "v"))
        most = spread.agg(F.max("distance").alias("m"))
        spread = spread.crossJoin(F.broadcast(most)).select("id", F.coalesce(F.try_divide("distance", "m"), F.lit(0.0)).alias("s"))  # one row
        rest = rest.join(spread, "id")
    else:
        rest = rest.withColumn("s", F.lit(1.0))
    second = rest.withColumn("score", F.round(0.6 * F.col("fidelity") + 0.3 * F.col("s") + 0.1, 9)).orderBy(F.desc("score"), "id").limit(n - first_n).select("id")
    return far.select("id", F.lit(1).alias("stage")).unionByName(second.select("id", F.lit(2).alias("stage")))


def pareto(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """The rows whose score tuple nothing dominates."""
    return df.join(pairwise.skyline(df, scores), list(scores), "left_semi")


def dpp(df: DataFrame, n: int, bandwidth: float = 0.5) -> DataFrame:
    """(id, place): greedy determinantal selection of (id, v) under an RBF kernel; ties: the smallest id.

    Each pick is one pass: every task finds its row of the largest gain given the rows
    chosen so far (n vectors at most), and the best of the tasks' rows is taken.
    """
    kind = dict(df.dtypes)["id"]
    rows = df.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))

    def gains(chosen: np.ndarray):
        kernel = lambda a, b: np.exp(-pairwise.distances("euclidean", a, b) ** 2 / (2 * bandwidth**2))
        root = np.linalg.cholesky(kernel(chosen, chosen)) if len(chosen) else None

        def run(batches):
            best = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, v = batch.column("id"), pairwise._matrix(pa.chunked_array([batch.column("v")]))
                gain = np.ones(len(v))
                if root is not None:
                    gain -= (np.linalg.solve(root, kernel(chosen, v)) ** 2).sum(axis=0)
                gain = np.round(gain, 9)
                names = ids.to_numpy(zero_copy_only=False)
                i = int(np.lexsort((names, -gain))[0])
                if best is None or (-gain[i], names[i]) < (-best[0], best[1]):
                    best = (gain[i], names[i], v[i].tolist())
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array([float(best[0])]), pa.array([best[1]]), pa.array([best[2]], pa.list_(pa.float64()))], ["gain", "id", "v"])

        return run

    picked: list = []
    while len(picked) < n:
        chosen = np.array([p.v for p in picked])
        best = rows.mapInArrow(gains(chosen), f"gain double, id {kind}, v array<double>").orderBy(F.desc("gain"), "id").limit(1).collect()
        if not best or best[0].gain <= 1e-9:
            break
        picked.append(best[0])
    return df.sparkSession.createDataFrame([(p.id, i + 1) for i, p in enumerate(picked)], f"id {kind}, place long")  # n rows


def diversity_ratios(sample: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean ratio of variances, of covered ranges, and of mean pairwise distances."""
    var = lambda df, p: df.agg(*[F.var_samp(c).alias(f"{p}v_{c}") for c in columns], *[(F.max(c) - F.min(c)).alias(f"{p}r_{c}") for c in columns])
    both = var(sample, "s").crossJoin(var(train, "t"))  # one row each
    mean = lambda x: sum((F.coalesce(F.try_divide(F.col(f"s{x}_{c}"), F.col(f"t{x}_{c}")), F.lit(0.0)) for c in columns), F.lit(0.0)) / len(columns)
    vec = lambda df: df.select("id", F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    d = pairwise.mean_pairwise(vec(sample)).select(F.col("mean_distance").alias("a")).crossJoin(pairwise.mean_pairwise(vec(train)).select(F.col("mean_distance").alias("b")))  # one row each
    return both.select(mean("v").alias("variance_ratio"), mean("r").alias("coverage_ratio")).crossJoin(d.select(F.try_divide("a", "b").alias("distance_ratio")))


def diversity_summary(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """One row: mean coefficient of variation and normalised entropy, in percent, and 0.6 / 0.4 of them."""
    cv = df.agg(*[F.try_divide(F.stddev_samp(c), F.abs(F.avg(c))).alias(c) for c in numeric])
    parts = F.array_compact(F.array(*[F.col(c) for c in numeric]))
    cv = cv.select((F.coalesce(F.try_divide(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.size(parts)), F.lit(0.0)) * 100).alias("cv"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("x")) for c in text])).alias("e")).select("e.*")
    counts = long.where(F.col("x").isNotNull()).groupBy("c", "x").agg(F.count("*").alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("c")))  # one row per category
    entropy = share.groupBy("c").agg((-F.sum(F.col("p") * F.ln(F.col("p") + 1e-10))).alias("h"), F.count("*").alias("k")).where("k > 1")
    entropy = entropy.agg((F.coalesce(F.avg(F.col("h") / F.ln(F.col("k").cast("double"))), F.lit(0.0)) * 100).alias("entropy"))
    return cv.crossJoin(entropy).withColumn("overall", 0.6 * F.col("cv") + 0.4 * F.col("entropy"))  # one row each


def diversity_score(df: DataFrame, key: str, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """One row: :func:`diversity_summary`, mean and smallest distance of two rows (numbers scaled to unit deviation, gaps 0), percent of repeated rows.

    Distances are null with fewer than two rows.
    """
    filled = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric])
    stats = moments(filled, numeric, ["mean", "sd0"])
    unit = [(F.col(c) - F.col(f"{c}__mean")) / (F.when(F.col(f"{c}__sd0") > 0, F.col(f"{c}__sd0")).otherwise(F.lit(1.0)) + 1e-8) for c in numeric]
    rows = with_moments(filled, stats).select(F.col(key).alias("id"), F.array(*unit).alias("v"))
    mean = pairwise.mean_pairwise(rows)
    names = [f"x{i}" for i in range(len(numeric))]
    least = pairwise.least_distance(rows.select("id", *[F.col("v")[i].alias(x) for i, x in enumerate(names)]), names)
    groups = df.groupBy(*numeric, *text).agg(F.count("*").alias("n"))
    again = groups.agg(F.coalesce(F.try_divide(F.sum(F.col("n") - 1), F.sum("n")) * 100, F.lit(0.0)).alias("duplicate_percent"))
    return diversity_summary(df, numeric, text).crossJoin(mean).crossJoin(least).crossJoin(again)  # one row each

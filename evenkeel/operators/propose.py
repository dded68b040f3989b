"""Anchors and proposers: typical, stratified, boundary and discriminative anchors; SMOTE; copula; leaf resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..functions.reliable import checkpoint
from . import pairwise
from .quantiles import finite, quantile_row
from .transform import drop_moments, moments, numbered, with_moments

STRATA = (0.10, 0.15, 0.50, 0.15, 0.10)


def _draw(df: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """n rows without replacement, by a hash of the key."""
    return df.withColumn("__u", uniform(F.col(key), seed)).orderBy("__u", key).limit(n).drop("__u")


def typical(df: DataFrame, columns: Sequence[str], n: int, key: str, seed: str = "typical") -> DataFrame:
    """n of the 2n rows with the smallest mean |z| over columns that vary."""
    stats = moments(df, columns, ["mean", "sd1"])
    out = with_moments(df, stats)
    z = [F.when(F.col(f"{c}__sd1") > 0, F.abs((F.col(c) - F.col(f"{c}__mean")) / F.when(F.col(f"{c}__sd1") > 0, F.col(f"{c}__sd1")))) for c in columns]
    present = F.array_compact(F.array(*z))
    mean = F.coalesce(F.try_divide(F.aggregate(present, F.lit(0.0), lambda s, x: s + x), F.size(present)), F.lit(0.0))
    out = drop_moments(out.withColumn("typicality", F.round(1 / (1 + mean), 9)), stats)
    return _draw(out.orderBy(F.desc("typicality"), key).limit(2 * n), n, key, seed)


def strata(df: DataFrame, column: str, parts: int = 5) -> DataFrame:
    """``stratum`` 0 to parts - 1 by exact quantile edges, each closed on the right, the lowest inclusive."""
    at = [i / parts for i in range(1, parts)]
    edges = quantile_row(df, [column], at).select(F.col(column).alias("__edges"))
    out = df.crossJoin(F.broadcast(edges))  # one row
    over = F.aggregate("__edges", F.lit(0), lambda s, e: s + (F.col(column) > e).cast("int"))
    return out.withColumn("stratum", over).drop("__edges")


def stratified(df: DataFrame, column: str, n: int, key: str, shares: Sequence[float] = STRATA, seed: str = "strata") -> DataFrame:
    """max(1, int(n * share)) rows of each quantile stratum, by a hash of the key."""
    own = strata(df, column, len(shares)).withColumn("__u", uniform(F.col(key), seed))
    quotas = [max(1, int(n * s)) for s in shares]
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("stratum") + 1)
    # The literal bound is what lets each task pass on only its first rows of a stratum.
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("__u", key))
    return own.withColumn("__place", place).where(F.col("__place") <= max(quotas)).where(F.col("__place") <= quota).drop("__u", "__place")


def terciles(df: DataFrame, column: str, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """``band``: low (<= the lower quantile), high (> the upper), else middle."""
    edges = quantile_row(df, [column], [low, high]).select(F.col(column).alias("__e"))
    out = df.crossJoin(F.broadcast(edges))  # one row
    return out.withColumn("band", F.when(F.col(column) <= F.col("__e")[0], "low").when(F.col(column) > F.col("__e")[1], "high").otherwise("middle")).drop("__e")


def distance_band(df: DataFrame, columns: Sequence[str], n: int, key: str, odd: bool) -> DataFrame:
    """Rows far from the mean: by scaled distance descending the first 30 percent, or 20 to 50 percent in odd rounds, 2n at least."""
    stats = moments(df, columns, ["mean", "sd1"])
    out = with_moments(df, stats)
    z = sum((F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__sd1")), F.lit(0.0)) ** 2 for c in columns), F.lit(0.0))
    out = drop_moments(out.withColumn("distance", F.round(F.sqrt(z), 9)), stats)
    total = df.count()
    low = int(0.2 * total) if odd else 0
    size = max(2 * n, int(0.3 * total))
    return out.orderBy(F.desc("distance"), key).offset(low).limit(size)


def edges(df: DataFrame, columns: Sequence[str], n: int, key: str, iteration: int) -> DataFrame:
    """n rows far from the centroid (unscaled): of the farthest 30 percent, or of 20 to 50 percent in odd rounds, 2n rows at least."""
    means = moments(df, columns, ["mean"])
    gap = sum(((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.coalesce(F.col(f"{c}__mean"), F.lit(0.0))) ** 2 for c in columns), F.lit(0.0))
    out = drop_moments(with_moments(df, means).withColumn("__gap", F.round(F.sqrt(gap), 9)), means)
    total = df.count()
    low, high = (int(0.2 * total), int(0.5 * total)) if iteration % 2 else (0, int(0.3 * total))
    band = out.orderBy(F.desc("__gap"), key).offset(low).limit(max(high - low, 2 * n)).drop("__gap")
    return _draw(band, n, key, f"edges {iteration}")


def spread(df: DataFrame, columns: Sequence[str], n: int, key: str, iteration: int) -> DataFrame:
    """n rows, a third from each tercile of one column, the next column each round; what a tercile lacks comes from the rest."""
    own = terciles(df, columns[iteration % len(columns)]).withColumn("__u", uniform(F.col(key), f"spread {iteration}"))
    quota = lambda i: n // 3 + (i < n % 3)
    wanted = F.when(F.col("band") == "low", quota(0)).when(F.col("band") == "middle", quota(1)).otherwise(quota(2))
    # No more than the first n of a band can be chosen or fill up.
    place = F.row_number().over(Window.partitionBy("band").orderBy("__u", key))
    first = own.withColumn("__place", place).where(F.col("__place") <= n)
    return first.orderBy(F.col("__place") > wanted, "__u", key).limit(n).drop("band", "__u", "__place")


def few_shot(df: DataFrame, columns: Sequence[str], n: int, key: str, iteration: int = 0, strategy: str = "mixed") -> DataFrame:
    """n example rows that change with the round: ``rotate`` (nearest to k-means centres), ``edges``, ``spread``, or ``mixed``, one after another.

    A frame of n rows or fewer comes back whole, as do no columns with a hash draw.  Two
    centres may have the same nearest row and a cluster may be empty, so ``rotate`` can
    give fewer.
    """
    from .models import central

    if strategy == "mixed":
        strategy = ("rotate", "edges", "spread")[iteration % 3]
    if strategy not in ("rotate", "edges", "spread"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if df.limit(n + 1).count() <= n:
        return df
    if not columns:
        return _draw(df, n, key, f"few {iteration}")
    if strategy != "rotate":
        return (edges if strategy == "edges" else spread)(df, columns, n, key, iteration)
    v = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    chosen = central(df.select(F.col(key).alias("id"), v.alias("v")), n, seed=42 + 7 * iteration).select(F.col("id").alias("__id")).distinct()
    return df.join(F.broadcast(chosen), F.col(key) == F.col("__id"), "left_semi")  # n rows


def boundary(minority: DataFrame, majority: DataFrame, n: int, k: int = 5, seed: str = "boundary") -> DataFrame:
    """n of the 2n minority rows of (id, v) closest to the majority, by the mean of the k nearest."""
    near = pairwise.neighbours(minority, majority, k).groupBy("id").agg(F.round(F.avg("distance"), 9).alias("distance"))
    return _draw(near.orderBy("distance", "id").limit(2 * n), n, "id", seed)


def smote(minority: DataFrame, n: int, k: int = 5, seed: str = "smote") -> DataFrame:
    """(id, sample, neighbour, v): points between a minority row and one of its k nearest, n in all.

    Every row of (id, v) gives n // rows samples, n % rows of them one more; k is clamped
    to what there is.  Everything is drawn by a hash of the id and the sample's number.
    """
    total = minority.count()
    if total < 2:
        return minority.select("id", F.lit(0).alias("sample"), F.col("id").alias("neighbour"), "v").limit(0)
    k = min(k, total - 1)
    near = pairwise.neighbours(minority, minority, k, exclude_self=True)
    own = numbered(minority, "id", seed, "__place") if n % total else minority.withColumn("__place", F.lit(total + 1))
    base = own.withColumn("sample", F.explode(F.expr(f"filter(sequence(1, {n // total + 1}), i -> i <= {n // total} or __place <= {n % total})")))
    key = F.concat_ws("#", F.col("id").cast("string"), F.col("sample").cast("string"))
    base = base.withColumn("place", (F.floor(uniform(key, seed + " neighbour") * k) + 1).cast("int")).withColumn("u", uniform(key, seed + " step"))
    picked = base.join(near.select("id", "neighbour", "place"), ["id", "place"]).join(minority.select(F.col("id").alias("neighbour"), F.col("v").alias("w")), "neighbour")
    return picked.select("id", "sample", "neighbour", F.zip_with("v", "w", lambda x, y: x + F.col("u") * (y - x)).alias("v"))


#: Cells of equal width that draws and the shares of leaves are placed in, and buckets of a leaf's rows.
CELLS = 1024


def _numbered_in(df: DataFrame, group: str, columns: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 1 inside each group by a hash of their columns, in two levels; only equal rows can change places."""
    own = df.withColumn("__h", F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])))
    own = own.withColumn("__b", F.pmod(F.xxhash64("__h"), F.lit(CELLS)))
    counts = own.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("__group"), F.col("__b").alias("__bucket"), before.alias("__before"))
    ranked = own.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__b").orderBy("__h")))
    out = ranked.join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__b") == F.col("__bucket")))
    return out.withColumn(name, F.col("__before") + F.col("__r")).drop("__h", "__b", "__r", "__n", "__group", "__bucket", "__before")


def leaf_resample(rows: DataFrame, leaf: str, columns: Sequence[str], n: int, weight: float = 0.5, group: str | None = None, seed: str = "leaf") -> DataFrame:
    """n rows drawn from leaves with probability weight * fairness / total + (1 - weight) / leaves, with normal noise of a tenth of the leaf's deviation."""
    stats = rows.groupBy(leaf).agg(F.count("*").alias("n"), *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"sd_{c}") for c in columns], *([F.avg(F.col(group).cast("double")).alias("p")] if group else []))
    whole = rows.agg(F.avg(F.col(group).cast("double")).alias("all_p")) if group else None
    stats = stats.crossJoin(F.broadcast(whole)).withColumn("fair", 1 / (1 + 2 * F.abs(F.col("p") - F.col("all_p")))) if group else stats.withColumn("fair", F.lit(1.0))  # one row
    everything, order = Window.partitionBy(F.lit(1)), Window.orderBy(leaf)  # one row per leaf
    stats = stats.withColumn("share", weight * F.col("fair") / F.sum("fair").over(everything) + (1 - weight) / F.count("*").over(everything))
    last = F.row_number().over(order) == F.count("*").over(everything)
    stats = stats.withColumn("upto", F.when(last, 1.0).otherwise(F.sum("share").over(order)))
    stats = stats.withColumn("from", F.coalesce(F.lag("upto").over(order), F.lit(0.0)))
    cells = F.sequence(F.floor(F.col("from") * CELLS), F.floor(F.col("upto") * CELLS))
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(F.col("id"), seed).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    # A leaf lies in CELLS // leaves cells or so: a draw meets the leaves of its own cell only.
    chosen = draws.join(stats.withColumn("cell", F.explode(cells)), "cell").where((F.col("u") >= F.col("from")) & (F.col("u") < F.col("upto")))
    chosen = chosen.withColumn("pick", F.floor(uniform(F.col("draw"), seed + " row") * F.col("n")) + 1)
    out = chosen.join(_numbered_in(rows, leaf, columns, "pick"), [leaf, "pick"])
    normal = lambda c: F.sqrt(-2 * F.ln(uniform(F.col("draw"), f"{seed} a {c}") + 1e-12)) * F.cos(2 * np.pi * uniform(F.col("draw"), f"{seed} b {c}"))
    return out.select("draw", leaf, *[(F.col(c) + 0.1 * F.col(f"sd_{c}") * normal(c)).alias(c) for c in columns])


def copula(df: DataFrame, numeric: Sequence[str], n: int, knots: int = 201, seed: int = 7) -> DataFrame:
    """n rows from a Gaussian copula: exact quantiles as marginals, correlations of the rows; a stand-in for neural proposers.

    What is fitted, ``knots`` quantiles per column and one correlation matrix, is bounded;
    sampling runs in tasks, each row from its own seed.
    """
    from .profile import correlations

    at = [i / (knots - 1) for i in range(knots)]
    fitted = quantile_row(df, numeric, at).first()
    quantiles = [np.array(fitted[c], float) for c in numeric]
    r = np.eye(len(numeric))
    for row in correlations(df, numeric).collect():  # one row per pair of columns
        i, j = numeric.index(row.c1), numeric.index(row.c2)
        r[i, j] = r[j, i] = row.r or 0.0
    values, axes = np.linalg.eigh(r)
    root = axes * np.sqrt(np.maximum(values, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from math import erf

        for pdf in batches:
            z = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(len(numeric)) for i in pdf["id"]]) @ root.T if len(pdf) else np.zeros((0, len(numeric)))
            u = 0.5 * (1 + np.vectorize(erf, otypes=[float])(z / np.sqrt(2)))
            yield pd.DataFrame({"id": pdf["id"], **{c: np.interp(u[:, k], at, quantiles[k]) for k, c in enumerate(numeric)}})

    return df.sparkSession.range(n).mapInPandas(run, "id long, " + ", ".join(f"{c} double" for c in numeric))


def _reach(first: np.ndarray, size: float, now: np.ndarray, bound: float) -> float:
    """The largest product with ``now`` of any vector of length 1 at most whose product with ``first``, ``size`` long, is at most ``bound``."""
    if bound == -math.inf:
        return bound
    if size <= 0:
        return float(np.linalg.norm(now))
    along = float(now @ first) / size
    across = float(np.linalg.norm(now - first * (along / size)))
    most = max(-1.0, min(1.0, bound / size))
    if along <= most * math.hypot(along, across):  # the vector in the direction of ``now`` itself is allowed
        return math.hypot(along, across)
    return most * along + math.sqrt(1 - most * most) * across


def prune_redundant(df: DataFrame, keep: int, ahead: int = 16384) -> DataFrame:
    """(id): ``keep`` rows of (id, v) after dropping, one by one, the row most similar to the others on average; ties: the smallest id.

    A row's similarity to all others is its unit vector times the sum of all unit vectors,
    so a pass over the rows needs no pairs.  Each pass brings the ``ahead`` rows with the
    largest sums and the largest sum of the rest, and drops are taken from those rows as
    long as none of the rest can have overtaken them.  What the rest can reach is bounded by
    Cauchy and Schwarz: of a row only its part along the sum of all, at most that of the
    largest, and the length of its remainder are known, and so are those of what was dropped.
    Any number of rows goes; the more alike they are, the more passes it takes.
    """
    kind = dict(df.dtypes)["id"]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = checkpoint(df.select("id", F.transform("v", lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12))).alias("u")))
    sums = unit.select(F.posexplode("u").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()  # one number per dimension
    whole, left = np.array([r.x for r in sums]), unit.count()
    dropped = df.sparkSession.createDataFrame([], f"id {kind}")
    while left > keep:
        rows = unit.join(dropped, "id", "left_anti")
        score = F.aggregate(F.zip_with("u", F.array(*[F.lit(float(x)) for x in whole]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        top = rows.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "id").limit(ahead + 1).collect()
        bound = top[ahead].score if len(top) > ahead else -math.inf
        top = sorted(top[:ahead], key=lambda r: r.id)
        u, score, alive, taken = np.array([r.u for r in top]), np.array([r.score for r in top]), np.ones(len(top), bool), []
        first, size = whole, float(np.linalg.norm(whole))
        while left > keep and alive.any():
            i = int(np.argmax(np.where(alive, np.round(score, 9), -np.inf)))
            if taken and score[i] <= _reach(first, size, whole, bound) + 1e-8:
                break
            alive[i] = False
            taken.append(top[i].id)
            whole, score, left = whole - u[i], score - u @ u[i], left - 1
        dropped = checkpoint(dropped.unionByName(df.sparkSession.createDataFrame([(x,) for x in taken], f"id {kind}")))  # ``ahead`` rows a pass
    return unit.join(dropped, "id", "left_anti").select("id")


def match_distribution(df: DataFrame, train: DataFrame, columns: Sequence[str], limit: float = 1.0, buckets: int = 4096) -> DataFrame:
    """(id): the batch after dropping, column by column, the rows farthest from the training mean until the batch mean is within ``limit`` deviations.

    At least max(10, half) rows stay; ties go by the smallest id; constant training columns
    are passed over, nulls are never dropped for their column.  The batch mean after any
    number of drops is a prefix sum in the order of distance, taken in two levels, so any
    number of rows goes and no task holds a column.
    """
    one = moments(train, columns, ["mean", "sd1"]).first()  # one row
    left = checkpoint(df.select("id", *[finite(F.col(c)).alias(c) for c in columns]))
    least = max(10, left.count() // 2)
    for c in columns:
        mean, sd = one[f"{c}__mean"], one[f"{c}__sd1"]
        if not sd:
            continue
        far = F.abs(F.col(c) - mean) / sd
        now = left.agg(F.count("*").alias("rows"), F.count(c).alias("n"), F.sum(c).alias("total"), F.max(far).alias("most")).first()
        if not now.n or abs(now.total / now.n - mean) / sd <= limit or now.rows <= least:
            continue
        own = left.where(F.col(c).isNotNull()).select("id", F.col(c).alias("x"), far.alias("far")).withColumn("b", -F.floor(F.col("far") / now.most * buckets))
        each = own.groupBy("b").agg(F.count("*").alias("m"), F.sum("x").alias("s"))  # buckets + 1 rows at most
        earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        each = each.select("b", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("m0"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("s0"))
        inside = Window.partitionBy("b").orderBy(F.desc("far"), "id").rowsBetween(Window.unboundedPreceding, 0)
        own = own.withColumn("m1", F.count("*").over(inside)).withColumn("s1", F.sum("x").over(inside)).join(F.broadcast(each), "b")
        own = own.select("id", (F.col("m0") + F.col("m1")).alias("k"), (F.col("s0") + F.col("s1")).alias("gone"))
        rest = F.try_divide(F.lit(now.total) - F.col("gone"), F.lit(now.n) - F.col("k"))
        enough = (F.abs(rest - mean) / sd <= limit) | (F.lit(now.rows) - F.col("k") <= least)
        last = own.where(enough).agg(F.min("k")).first()[0]
        left = checkpoint(left.join(own.where(F.col("k") <= last).select("id"), "id", "left_anti"))
    return left.select("id")

"""Rank statistics over result tables: ranks, Friedman, Wilcoxon, Holm, summaries, completeness."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policies
from ..functions.policies import NEMENYI_Q
from ..functions.reliable import checkpoint
from .profile import correlations


def average_ranks(df: DataFrame, block: Sequence[str], value: str, descending: bool = True, name: str = "rank") -> DataFrame:
    """Ranks inside each block, ties sharing their mean rank."""
    order = F.desc(value) if descending else F.asc(value)
    first = F.rank().over(Window.partitionBy(*block).orderBy(order))
    ties = F.count("*").over(Window.partitionBy(*block, value))
    return df.withColumn(name, first + (ties - 1) / 2)


def mean_ranks(df: DataFrame, block: Sequence[str], method: str, value: str) -> DataFrame:
    """(method, mean_rank, n_blocks)."""
    return average_ranks(df, block, value).groupBy(method).agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n_blocks"))


def chi2_tail(statistic: DataFrame, x: str, dof: str, name: str) -> DataFrame:
    """The frame with the upper tail of the chi-square distribution, in closed form for any whole degrees of freedom."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if np.isnan(u) or np.isnan(k) else policies.chi2_sf(u, int(k)) for u, k in zip(a.astype(float), b.astype(float))], dtype=float)

    return statistic.withColumn(name, tail(F.col(x).cast("double"), F.col(dof).cast("double")))  # one row per test


def friedman(df: DataFrame, block: Sequence[str], method: str, value: str) -> DataFrame:
    """One row: statistic (tie-corrected), degrees of freedom, p, numbers of blocks and methods."""
    r = average_ranks(df, block, value)
    size = r.agg(F.count_distinct(*block).alias("n"), F.count_distinct(method).alias("k"))
    sums = r.groupBy(method).agg(F.sum("rank").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    ties = r.groupBy(*block, value).agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    one = size.crossJoin(sums).crossJoin(ties)  # one row each
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    out = one.withColumn("statistic", F.try_divide(raw, 1 - F.col("ties") / (n * k * (k * k - 1)))).withColumn("dof", F.col("k") - 1)
    return chi2_tail(out, "statistic", "dof", "p_value").select("statistic", "dof", "p_value", F.col("n").alias("n_blocks"), F.col("k").alias("n_methods"))


def paired(df: DataFrame, block: Sequence[str], method: str, value: str, reference: str) -> DataFrame:
    """(method, *block, diff): the reference's value minus each other method's in the same block."""
    base = df.where(F.col(method) == reference).select(*[F.col(b).alias(f"__{b}") for b in block], F.col(value).alias("__v"))
    cond = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in block]
    return df.where(F.col(method) != reference).join(base, cond).select(method, *block, (F.col("__v") - F.col(value)).alias("diff"))


def signed_ranks(pairs: DataFrame, group: str) -> DataFrame:
    """(group, n, w_plus, w_minus, rank_biserial): ranks of absolute differences, zeros dropped."""
    r = average_ranks(pairs.where("diff != 0").withColumn("size", F.abs("diff")), [group], "size", descending=False)
    out = r.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.when(F.col("diff") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("diff") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    return out.withColumn("rank_biserial", (F.col("w_plus") - F.col("w_minus")) / (F.col("n") * (F.col("n") + 1) / 2))


#: Up to so many differences the null distribution is counted exactly; beyond, it is taken as normal.
EXACT = 200


def _exact_tails(table: pa.Table) -> pa.Table:
    """Both tails of a group's rank sum, by counting the sign patterns of every sum (ranks are halves at the least)."""
    ranks = np.sort(np.round(2 * table.column("rank").to_numpy())).astype(np.int64)
    w = int(round(2 * table.column("w")[0].as_py()))
    share = np.zeros(int(ranks.sum()) + 1)
    share[0] = 1.0
    for r in ranks.tolist():
        moved = np.concatenate([np.zeros(r), share[:-r]])
        share = (share + moved) / 2
    low, high = share[: w + 1].sum(), share[w:].sum()
    return pa.table([table.column("grp")[:1], pa.array([min(1.0, 2 * min(low, high))])], ["grp", "exact"])


def wilcoxon(pairs: DataFrame, group: str, most: int = EXACT) -> DataFrame:
    """(group, n, statistic, p_value): two-sided signed-rank test, zeros dropped, ties sharing their rank.

    Exact for up to ``most`` differences, by the distribution of the rank sum; beyond that
    by the normal distribution, its variance corrected for ties.  No group is left out.
    """
    r = average_ranks(pairs.where("diff != 0").withColumn("size", F.abs("diff")), [group], "size", descending=False)
    ties = r.groupBy(group, "size").agg(F.count("*").alias("t")).groupBy(group).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    g = r.groupBy(group).agg(F.sum(F.when(F.col("diff") > 0, F.col("rank")).otherwise(0.0)).alias("w"), F.count("*").alias("n")).join(ties, group)
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.abs(F.col("w") - n * (n + 1) / 4) / spread

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.astype(float).map(lambda v: None if np.isnan(v) else math.erfc(v / math.sqrt(2)))

    kind = dict(pairs.dtypes)[group]
    small = r.join(g.where(F.col("n") <= most).select(group, "w"), group).select(F.col(group).alias("grp"), "rank", "w")  # ``most`` rows a group
    exact = small.groupBy("grp").applyInArrow(_exact_tails, f"grp {kind}, exact double")
    out = g.join(exact, F.col(group) == F.col("grp"), "left")
    return out.select(group, "n", F.col("w").alias("statistic"), F.coalesce("exact", tail(z)).alias("p_value"))


def bundle(results: DataFrame, block: Sequence[str], method: str, value: str, reference: str) -> DataFrame:
    """(report, name, measure, value): every statistic of a table of results in one long table.

    Mean ranks, Friedman's test, the critical difference, and for each method against the
    reference the mean of both, signed-rank test, Holm's adjustment and effect size.
    """
    cells = checkpoint(results.groupBy(*block, method).agg(F.round(F.avg(value), 9).alias(value)))
    ranks = checkpoint(mean_ranks(cells, block, method, value))
    pairs = paired(cells, block, method, value, reference)
    tests = holm(wilcoxon(pairs, method)).join(signed_ranks(pairs, method).select(method, "rank_biserial"), method, "left")
    parts = [
        ("ranks", ranks, F.col(method), ["mean_rank", "n_blocks"]),
        ("friedman", friedman(cells, block, method, value), F.lit("all"), ["statistic", "dof", "p_value", "n_blocks", "n_methods"]),
        ("critical_difference", critical_difference(ranks), F.lit("all"), ["cd"]),
        ("means", cells.groupBy(method).agg(F.avg(value).alias("mean")), F.col(method), ["mean"]),
        ("pairwise", tests, F.col(method), ["n", "statistic", "p_value", "p_holm", "rank_biserial"]),
    ]
    out = None
    for report, df, name, measures in parts:
        each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        one = df.select(F.lit(report).alias("report"), name.cast("string").alias("name"), F.explode(each).alias("x")).select("report", "name", "x.measure", "x.value")
        out = one if out is None else out.unionByName(one)
    return out


def holm(df: DataFrame, p: str = "p_value", name: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment of a column of p-values (one row per comparison)."""
    order = Window.orderBy(p)
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    raw = df.withColumn("__raw", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    return raw.withColumn(name, F.max("__raw").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))).drop("__raw")


def critical_difference(ranks: DataFrame) -> DataFrame:
    """(n_methods, n_blocks, cd) of Nemenyi's test from mean ranks."""
    q = F.create_map(*[F.lit(x) for kv in NEMENYI_Q.items() for x in kv])
    one = ranks.agg(F.count("*").cast("int").alias("n_methods"), F.max("n_blocks").alias("n_blocks"))
    k = F.col("n_methods")
    return one.withColumn("cd", F.try_element_at(q, k) * F.sqrt(k * (k + 1) / (6.0 * F.col("n_blocks"))))


def summary(df: DataFrame, by: Sequence[str], value: str, distinct: Sequence[str]) -> DataFrame:
    """Runs, distinct keys, mean and sample deviation (0 for a single run) of each group."""
    return df.groupBy(*by).agg(F.count("*").alias("n_runs"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct], F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Rows numbered by the order, nulls last; the frame is a summary with one row per variant."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def wide_means(df: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    """Means with one column for each of the given values."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(value))


def completeness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every combination of the keys' values, and whether a result exists."""
    grid = None
    for k in keys:
        one = df.select(k).distinct()
        grid = one if grid is None else grid.crossJoin(one)  # the grid itself is the result
    return grid.join(df.select(*keys).distinct().withColumn("exists", F.lit(True)), list(keys), "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def duplicate_ratio(df: DataFrame, fingerprint: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows that repeat an earlier one."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), (1 - F.try_divide(F.count_distinct(fingerprint).cast("double"), F.count("*").cast("double"))).alias("duplicate_ratio"))


def correlation_distance(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean absolute difference of the pairwise correlations, null counting as 0; null with under 3 rows of ``b`` or 2 columns."""
    ra, rb = correlations(a, columns), correlations(b, columns).withColumnRenamed("r", "s").drop("is_strong")
    rows = b.agg(F.count("*").alias("n"))
    out = ra.join(rb, ["c1", "c2"]).agg(F.avg(F.abs(F.coalesce("r", F.lit(0.0)) - F.coalesce("s", F.lit(0.0)))).alias("d")).crossJoin(rows)  # one row each
    return out.select(F.when((F.col("n") >= 3) & F.lit(len(columns) >= 2), F.col("d")).alias("correlation_distance"))

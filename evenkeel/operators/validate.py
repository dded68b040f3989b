"""Gates on proposed rows: schema, range, z-score, fidelity; and the counters of a funnel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transform import drop_moments, moments, with_moments


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def schema_errors(df: DataFrame, train: DataFrame, numeric: Sequence[str], categories: Mapping[str, Sequence] | None = None, integral: Sequence[str] = (), margin: float = 0.0, allow_null: bool = False) -> DataFrame:
    """``errors``: an array of what is wrong with each row.  ``margin`` widens ranges by a share of their width."""
    stats = moments(train, numeric)
    out = with_moments(df, stats)
    tests: list[Column] = []
    for c in numeric:
        low, high = F.col(f"{c}__min"), F.col(f"{c}__max")
        room = (high - low) * margin
        x = F.col(c)
        if not allow_null:
            tests.append(F.when(x.isNull() | F.isnan(x), F.lit(f"{c}: missing")))
        tests.append(F.when((x < low - room) | (x > high + room), F.lit(f"{c}: out of range")))
        if c in integral:
            tests.append(F.when(x != F.floor(x), F.lit(f"{c}: not integral")))
    for c, values in (categories or {}).items():
        if not allow_null:
            tests.append(F.when(F.col(c).isNull(), F.lit(f"{c}: missing")))
        tests.append(F.when(~F.col(c).isin(list(values)), F.lit(f"{c}: unknown category")))
    return drop_moments(out.withColumn("errors", F.array_compact(F.array(*tests))), stats)


def range_gate(df: DataFrame, train: DataFrame, columns: Sequence[str], share: float = 0.2, least: float = 0.5, name: str = "in_range") -> DataFrame:
    """Not null and within the training range widened by max(share of its width, least)."""
    stats = moments(train, columns)
    out = with_moments(df, stats)
    tests = []
    for c in columns:
        low, high = F.col(f"{c}__min"), F.col(f"{c}__max")
        room = F.greatest((high - low) * share, F.lit(least))
        tests.append(F.coalesce(F.col(c).between(low - room, high + room), F.lit(False)))
    return drop_moments(out.withColumn(name, _all(tests)), stats)


def z_gate(df: DataFrame, train: DataFrame, columns: Sequence[str], limit: float = 4.5, name: str = "z_ok") -> DataFrame:
    """|x - mean| / sample deviation below the limit in every column that varies; null fails."""
    stats = moments(train, columns)
    out = with_moments(df, stats)
    tests = [(F.coalesce(F.col(f"{c}__sd1"), F.lit(0.0)) == 0) | F.coalesce(F.abs(F.col(c) - F.col(f"{c}__mean")) < limit * F.col(f"{c}__sd1"), F.lit(False)) for c in columns]
    return drop_moments(out.withColumn(name, _all(tests)), stats)


def adaptive_gate(df: DataFrame, train: DataFrame, columns: Sequence[str], name: str = "inside") -> DataFrame:
    """Null or strictly within the training range; ``fidelity`` is the mean of 1 / (1 + |z|), nulls and constants adding 0."""
    stats = moments(train, columns)
    out = with_moments(df, stats)
    tests = [F.col(c).isNull() | F.col(c).between(F.col(f"{c}__min"), F.col(f"{c}__max")) for c in columns]
    parts = [F.coalesce(F.when(F.col(f"{c}__sd1") > 0, 1 / (1 + F.abs((F.col(c) - F.col(f"{c}__mean")) / F.when(F.col(f"{c}__sd1") > 0, F.col(f"{c}__sd1"))))), F.lit(0.0)) for c in columns]
    return drop_moments(out.withColumn(name, _all(tests)).withColumn("fidelity", sum(parts, F.lit(0.0)) / len(columns)), stats)


def fairness_gate(df: DataFrame, targets: Mapping[str, Sequence[str]], name: str = "fair") -> DataFrame:
    """Every sensitive attribute present and among its target groups; an attribute without targets accepts all."""
    tests = [F.coalesce(F.col(c).cast("string").isin([str(v) for v in values]), F.lit(False)) for c, values in targets.items() if values]
    return df.withColumn(name, _all(tests))


def verdicts(df: DataFrame, gates: Sequence[str], strict: Sequence[str] = ()) -> DataFrame:
    """``valid``: the conjunction of the gates, in strict mode of the warnings too."""
    return df.withColumn("valid", _all([F.col(g) for g in (*gates, *strict)]))


def counters(df: DataFrame, gates: Sequence[str]) -> DataFrame:
    """One row: rows in, rows failing each gate, rows valid, and the valid share (1.0 duplicates are not assumed of nothing)."""
    out = df.agg(F.count("*").alias("n"), *[F.count(F.when(~F.col(g), 1)).alias(f"fail_{g}") for g in gates], F.count(F.when(_all([F.col(g) for g in gates]), 1)).alias("n_valid"))
    return out.withColumn("valid_rate", F.coalesce(F.try_divide(F.col("n_valid"), F.col("n")), F.lit(0.0)))


def audited(df: DataFrame, train: DataFrame, columns: Sequence[str], targets: Mapping[str, Sequence[str]], statistical: bool = True) -> DataFrame:
    """``valid``: inside the training range and of a target group; without ``statistical`` the group alone decides."""
    out = fairness_gate(adaptive_gate(df, train, columns), targets)
    return out.withColumn("valid", (F.col("inside") | F.lit(not statistical)) & F.col("fair"))

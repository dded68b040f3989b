"""Duplicates among proposed rows: exact against what exists and the batch, and by distance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fingerprint
from . import pairwise
from .quantiles import finite


def exact(df: DataFrame, known: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """``df`` with ``seen``: "known" if the fingerprint exists already, "batch" if an earlier row has it, else "new".

    The first row of a fingerprint is its smallest key, found by partial aggregation and
    an equi-join, so a row repeated very often does not fill one window.
    """
    kinds = dict(df.dtypes)
    fp = fingerprint([(c, kinds[c]) for c in columns])
    own = df.withColumn("__fp", fp)
    before = known.select(fp.alias("__fp")).distinct().withColumn("__known", F.lit(True))
    first = own.groupBy("__fp").agg(F.min(key).alias("__first"))
    out = own.join(first, "__fp").join(before, "__fp", "left")
    seen = F.when(F.col("__known"), "known").when(F.col(key) != F.col("__first"), "batch").otherwise("new")
    return out.withColumn("seen", seen).drop("__fp", "__first", "__known")


def keep_new(df: DataFrame, known: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    return exact(df, known, columns, key).where("seen = 'new'").drop("seen")


def far_from(df: DataFrame, known: DataFrame, columns: Sequence[str], bound: float) -> DataFrame:
    """Rows with nothing known closer than the bound (both sides already scaled; id column ``id``)."""
    # Equal vectors are as close to the same rows: one of each is compared, and names the others.
    one = pairwise.first_of_each(df, columns)
    close = pairwise.touching(one, pairwise.first_of_each(known, columns), columns, bound).select(*columns)
    return df.join(close.hint("shuffle_merge"), list(columns), "left_anti").select(*df.columns)


def spread_out(df: DataFrame, columns: Sequence[str], bound: float) -> DataFrame:
    """In the order of ``id``, drop each row closer than the bound to an earlier kept one; rows that lack a number are close to none.

    Only the first of equal vectors can stay: what drops it drops the others, or else it does.
    """
    if bound <= 0:
        return df
    kept = pairwise.spaced(pairwise.first_of_each(df, columns), columns, bound)
    loose = reduce(lambda a, b: a | b, [finite(F.col(c)).isNull() for c in columns])
    return df.where(loose).unionByName(df.where(~loose).join(kept.hint("shuffle_merge"), "id", "left_semi").select(*df.columns))


def anti_similar(df: DataFrame, known: DataFrame, columns: Sequence[str], bound: float = 0.1) -> DataFrame:
    """Rows at least the bound from everything known and from every earlier kept row."""
    return spread_out(far_from(df, known, columns, bound), columns, bound)


def gower(df: DataFrame, known: DataFrame, bound: float = 0.05, categories: int = 0) -> DataFrame:
    """(id, distance, is_duplicate): nearest known row by Gower distance over ``v`` (numbers scaled by range, then codes)."""
    return pairwise.nearest(df, known, "gower", categories=categories).withColumn("is_duplicate", F.col("distance") < bound)


def cosine(df: DataFrame, known: DataFrame, bound: float = 0.95) -> DataFrame:
    """(id, similarity, is_duplicate): the most similar known row."""
    d = pairwise.nearest(df, known, "cosine")
    return d.select("id", (1 - F.col("distance")).alias("similarity"), (1 - F.col("distance") >= bound).alias("is_duplicate"))


def funnel_of(df: DataFrame, first: str, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """(stage, n, dropped) of a funnel whose stages are conditions on the rows, by one aggregation."""
    passed, counts = F.lit(True), [F.count("*").alias("n0")]
    for i, (_, condition) in enumerate(stages, 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count(F.when(passed, 1)).alias(f"n{i}"))
    names = [first, *[name for name, _ in stages]]
    each = [F.struct(F.lit(name).alias("stage"), F.col(f"n{i}").alias("n"), (F.col(f"n{max(0, i - 1)}") - F.col(f"n{i}")).alias("dropped")) for i, name in enumerate(names)]
    return df.agg(*counts).select(F.explode(F.array(*each)).alias("x")).select("x.*")


def funnel(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(stage, n, dropped): rows left after each stage of a funnel, in order."""
    out = None
    for i, (name, df) in enumerate(stages):
        row = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("place"), F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    from pyspark.sql import Window

    dropped = F.lag("n").over(Window.orderBy("place")) - F.col("n")  # one row per stage
    return out.withColumn("dropped", F.coalesce(dropped, F.lit(0))).drop("place")


def without(df: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose key is not among the others; unlike an anti-join, null keys equal each other."""
    keys = gone.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(key)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(key)])
    return df.join(keys, same, "left_anti")


def shared_columns(*frames: DataFrame) -> list[str]:
    """The columns that all frames have, in the first one's order."""
    return [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]


def shared_values(df: DataFrame, group: str, value: str) -> DataFrame:
    """The values that occur in every group, such as the seeds that all methods ran."""
    groups = df.agg(F.count_distinct(group).alias("__k"))
    found = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(group).alias("__m"))
    return found.crossJoin(F.broadcast(groups)).where("__m = __k").select(value)  # one row

"""What a loop remembers: the tail of the accepted rows, layered duplicate checks, column orders."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sorted_fingerprint
from ..functions.reliable import checkpoint
from . import pairwise


def tail(df: DataFrame, n: int, order: str) -> DataFrame:
    """The last n rows by the order; a top-n, so no window over all rows."""
    return df.orderBy(F.desc(order)).limit(n)


def layers(df: DataFrame, memory: DataFrame, columns: Sequence[str], cosine: float = 0.95, gower: float = 0.05, window: int = 100, key: str = "id") -> DataFrame:
    """(key, verdict): "hash" if the row is remembered exactly, "cosine" or "gower" if it is too close, else "new".

    Cheap layers first, each only over what the one before let through; Gower looks at the
    last ``window`` remembered rows.  Columns are numeric; Gower scales by the range of
    both sides.
    """
    kinds = [(c, "double") for c in columns]
    cast = [F.col(c).cast("double").alias(c) for c in columns]
    df, memory = df.select(key, *cast), memory.select(key, *cast)
    known = memory.select(sorted_fingerprint(kinds).alias("__fp")).distinct()
    own = df.withColumn("__fp", sorted_fingerprint(kinds))
    seen = own.join(known, "__fp", "left_semi").select(key, F.lit("hash").alias("verdict"))
    # Each layer's input is written once: it is read for the verdict and by the next layer.
    rest = checkpoint(own.join(known, "__fp", "left_anti").drop("__fp"))
    both = df.unionByName(memory).agg(*[F.min(c).alias(f"{c}__min") for c in columns], *[F.max(c).alias(f"{c}__max") for c in columns])
    scaled = F.array(*[F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__min"), F.col(f"{c}__max") - F.col(f"{c}__min")), F.lit(0.5)) for c in columns])
    vectors = lambda x: x.crossJoin(F.broadcast(both)).select(F.col(key).alias("id"), scaled.alias("v"))  # noqa: E731  one row
    near = checkpoint(pairwise.nearest(vectors(rest), vectors(memory), "cosine").where(F.col("distance") <= 1 - cosine).select(F.col("id").alias(key)))
    after = checkpoint(rest.join(near, key, "left_anti"))
    close = checkpoint(pairwise.nearest(vectors(after), vectors(tail(memory, window, key)), "gower").where(F.col("distance") < gower).select(F.col("id").alias(key)))
    out = seen.unionByName(near.withColumn("verdict", F.lit("cosine"))).unionByName(close.withColumn("verdict", F.lit("gower")))
    return out.unionByName(after.join(close, key, "left_anti").select(key, F.lit("new").alias("verdict")))


def column_order(columns: Sequence[str], iteration: int, seed: int = 42) -> list[str]:
    """The columns in an order that changes with the iteration and with nothing else."""
    return sorted(columns, key=lambda c: hashlib.md5(f"{c}|{seed + 17 * iteration}".encode()).hexdigest())


def report(memory: DataFrame, columns: Sequence[str], most: int, pruned: int = 0) -> DataFrame:
    """One row: rows remembered, different ones among them, the limit, how often it was pruned, and the share of the limit in use."""
    kinds = dict(memory.dtypes)
    own = memory.select(sorted_fingerprint([(c, kinds[c]) for c in columns]).alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    out = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_hashes"))
    return out.select("n_rows", "n_hashes", F.lit(most).alias("most"), F.lit(pruned).alias("n_pruned"), F.coalesce(F.try_divide(F.col("n_rows"), F.lit(most)), F.lit(0.0)).alias("utilisation"))

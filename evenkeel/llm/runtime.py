"""What several operators share: reliable checkpoints and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null id wherever ids are ordered or joined.
NULL_ID = -(1 << 63)


#: Rows of text that Spark hands to a Python worker at once.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bound what an Arrow batch of texts takes on both sides; a larger setting of the session is lowered."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset and all runs on one machine (tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="evenkeel-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through files that every executor can reach."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The frame written once, as Parquet in the shared folder, and read back.

    Smaller than :func:`checkpoint`, and its columns are pruned when read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/evenkeel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """Joined by shuffling both sides, whatever Spark makes of its size.

    A table that grows with the corpus is broadcast while its compressed shuffle is small,
    and then fills the driver many times over.
    """
    return df.hint("shuffle_merge")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    ``edges`` has the columns ``a`` and ``b`` (bigint).  Alternates large-star and
    small-star contraction, so the number of rounds is logarithmic for the shapes met
    in practice and a round moves no more rows than there are edges.  Minimums are
    taken by partial aggregation and brought back by a join that AQE can split, so a
    node with very many edges does not land in one task.  Nodes without an edge, and
    loops, are absent.  Ties cannot occur: ids are compared as integers.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now = checkpoint(now)
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(dealt(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(least), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        mark = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = small
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

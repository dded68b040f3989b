"""Deterministic task views on the driver's tables, and the same views as SQL.

A task view is a labelled table with an explicit ``row_id`` and ``y`` (1: minority).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NUMERIC = ["quantity", "extendedprice", "discount", "tax", "linenumber"]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items; the minority is what was returned of fulfilled orders."""
    t = table(spark, sf_dir, "lineitem")
    two = lambda c: (F.col(c) + 0.0).try_cast("decimal(18,2)").cast("string")  # noqa: E731  a format costs several times as much
    key = F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", two("l_quantity"), two("l_extendedprice"), two("l_discount"), two("l_tax"), F.col("l_shipdate").cast("date").cast("string")))
    return t.select(
        key.alias("row_id"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).cast("int").alias("y"),
        (F.col("l_quantity") + 0.0).alias("quantity"),
        (F.col("l_extendedprice") + 0.0).alias("extendedprice"),
        (F.col("l_discount") + 0.0).alias("discount"),
        (F.col("l_tax") + 0.0).alias("tax"),
        F.col("l_linenumber").cast("double").alias("linenumber"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
    )


ITEMS = """items AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, printf('%.2f', l_quantity + 0.0), printf('%.2f', l_extendedprice + 0.0),
             printf('%.2f', l_discount + 0.0), printf('%.2f', l_tax + 0.0), strftime(l_shipdate, '%Y-%m-%d'))) AS row_id,
         CAST(l_returnflag = 'R' AND l_linestatus = 'F' AS INTEGER) AS y, l_quantity + 0.0 AS quantity, l_extendedprice + 0.0 AS extendedprice,
         l_discount + 0.0 AS discount, l_tax + 0.0 AS tax, CAST(l_linenumber AS DOUBLE) AS linenumber, l_returnflag AS returnflag, l_linestatus AS linestatus
  FROM lineitem)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed minority rows: each minority item varied in one of five ways, two of them not valid."""
    t = items(spark, sf_dir).where("y = 1")
    k = F.floor(uniform(F.col("row_id"), "kind") * 5).cast("int")
    return t.select(
        "row_id",
        k.alias("kind"),
        F.when(k == 0, F.col("quantity") * 1.12).otherwise(F.col("quantity")).alias("quantity"),
        F.when(k == 1, F.col("extendedprice") * 0.88).when(k == 4, F.col("extendedprice") * 100).otherwise(F.col("extendedprice")).alias("extendedprice"),
        F.when(k == 2, F.col("discount") + 0.01).otherwise(F.col("discount")).alias("discount"),
        "tax",
        "linenumber",
        "returnflag",
    )


CANDIDATES = """kinds AS (
  SELECT *, CAST(floor(('0x' || substr(md5(row_id || '|kind'), 1, 8))::BIGINT / 4294967296.0 * 5) AS INTEGER) AS kind FROM items WHERE y = 1),
candidates AS (
  SELECT row_id, kind, CASE WHEN kind = 0 THEN quantity * 1.12 ELSE quantity END AS quantity,
         CASE WHEN kind = 1 THEN extendedprice * 0.88 WHEN kind = 4 THEN extendedprice * 100 ELSE extendedprice END AS extendedprice,
         CASE WHEN kind = 2 THEN discount + 0.01 ELSE discount END AS discount, tax, linenumber, returnflag FROM kinds)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; the minority is toxic, quality and lang are sensitive."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", F.col("toxic").cast("int").alias("y"), F.col("quality").cast("int").alias("quality"), "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))


LABELLED = """labelled AS (
  SELECT d.doc_id, CAST(toxic AS INTEGER) AS y, CAST(quality AS INTEGER) AS quality, lang, source, CAST(n_chars AS DOUBLE) AS n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score that is half right, and the prediction it makes."""
    t = labelled(spark, sf_dir)
    score = F.round(0.25 * F.col("y") + 0.75 * uniform(F.col("doc_id"), "score"), 2)
    return t.withColumn("score", score).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


PREDICTIONS = """scored AS (
  SELECT *, round(0.25 * y + 0.75 * (('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|score'), 1, 8))::BIGINT / 4294967296.0), 2) AS score FROM labelled),
predictions AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS pred FROM scored)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of experiment results: dataset, method, seed, classifier and a metric."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    t = o.join(c, o["o_custkey"] == c["c_custkey"])
    return t.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("c_mktsegment").alias("method"), F.year("o_orderdate").alias("seed"), F.col("o_orderstatus").alias("classifier")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("metric"), F.count("*").alias("n")
    )


RESULTS = """results AS (
  SELECT o_orderpriority AS dataset, c_mktsegment AS method, CAST(year(o_orderdate) AS INTEGER) AS seed, o_orderstatus AS classifier,
         round(avg(o_totalprice), 4) AS metric, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings; the minority is label 0."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("y"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))


VECTORS = """vectors AS (SELECT vec_id AS id, CAST(label = 0 AS INTEGER) AS y, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""

"""Result tables, manifests and configuration."""

from __future__ import annotations

import json
import platform
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parsing import flatten_results

RESULT_SCHEMA = (
    "experiment_id string, dataset string, method string, seed int, success boolean, error string, execution_time double, n_generated long, "
    "avg_performance map<string,double>, performance_metrics map<string,map<string,double>>, fairness_metrics map<string,map<string,double>>, timestamp string"
)


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _place(spark, path)
    return fs.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system that Spark reaches."""
    fs, where = _place(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """A row per result file, failed runs included; a file that is no result has nulls only."""
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", "true").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A row per run and classifier from result files, one JSON object each; failed runs are dropped."""
    return flatten_results(read_outcomes(spark, path))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    """A split table, partitioned so that a seed and a split are read alone."""
    df.write.mode("overwrite").partitionBy("seed", "split").parquet(path)


def read_split(spark: SparkSession, path: str, seed: int, split: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("seed") == seed) & (F.col("split") == split))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def load_config(path: str | Path, required: tuple[str, ...] = ("name",)) -> dict:
    """A YAML configuration; what is required must be there."""
    with open(path, encoding="utf-8") as f:
        out = yaml.safe_load(f) or {}
    if missing := [k for k in required if k not in out]:
        raise ValueError(f"{path}: missing {', '.join(missing)}")
    return out


def environment(spark: SparkSession, packages: tuple[str, ...] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict:
    """Versions a result depends on: Python, platform, Spark and packages; null for what is not installed."""

    def of(name: str) -> str | None:
        try:
            return version(name)
        except PackageNotFoundError:
            return None

    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "packages": {p: of(p) for p in packages}}


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table as Markdown for people to read: its first ``most`` rows, and a last line where there are more."""
    rows = df.limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows[:most]]
    return "\n".join(lines + ([f"(only the first {most} rows)"] if len(rows) > most else []))


def write_report(df: DataFrame, path: str, title: str = "report") -> None:
    """The whole table as CSV and JSON folders below the path, a Markdown extract and the environment beside them."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("header", True).csv(f"{path}/{title}.csv")
    df.write.mode("overwrite").json(f"{path}/{title}.json")
    write_text(spark, f"{path}/{title}.md", markdown(df) + "\n")
    write_text(spark, f"{path}/environment.json", json.dumps(environment(spark), indent=1))

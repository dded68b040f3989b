"""Parsers of semi-structured text: proposals as CSV in prose, JSON samples, nested results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON column beside the other columns; ``ok`` is false where it is not valid JSON."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    # An object that parses to all nulls is still valid; what is not JSON has no top-level type.
    ok = F.coalesce(F.try_parse_json(column).isNotNull(), F.lit(False)) if hasattr(F, "try_parse_json") else F.get_json_object(column, "$").isNotNull()
    return df.withColumn("__parsed", parsed).withColumn("ok", ok).select(*df.columns, "ok", "__parsed.*")


def parse_csv_text(df: DataFrame, column: str, fields: Mapping[str, str], separator: str = ",") -> DataFrame:
    """A row per well-formed line of a CSV answer: fences and an exact header are dropped, short lines skipped.

    ``line_no`` counts the lines between the fences from 1, header included.  A cell that
    does not fit its type is null.
    """
    names = list(fields)
    body = F.regexp_replace(F.trim(F.regexp_replace(column, r"(?m)^```.*$", "")), r"^[\r\n]+|[\r\n]+$", "")
    lines = df.select(*[c for c in df.columns if c != column], F.posexplode(F.split(body, r"\r?\n")).alias("__at", "__line"))
    cells = F.split("__line", f"\\{separator}")
    header = F.lower(F.regexp_replace("__line", r"\s", "")) == separator.join(names).lower()
    kept = lines.withColumn("__cells", cells).where(~header & (F.size("__cells") == len(names)))
    values = [F.trim(F.trim(F.col("__cells")[i]), F.lit('"')).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields.items())]
    return kept.select(*[c for c in df.columns if c != column], (F.col("__at") + 1).alias("line_no"), *values)


def flatten_results(df: DataFrame, metrics: str = "performance_metrics") -> DataFrame:
    """Nested results (classifier to metric to value) as a row per run and classifier; failed runs are dropped."""
    kept = df.where(F.coalesce(F.col("success"), F.lit(False)))
    rows = kept.select("dataset", "method", "seed", F.explode(F.map_entries(metrics)).alias("e"))
    pick = lambda m: F.try_element_at(F.col("e.value"), F.lit(m)).alias(m)
    return rows.select("dataset", "method", "seed", F.col("e.key").alias("classifier"), pick("f1"), pick("roc_auc"), pick("balanced_accuracy"))

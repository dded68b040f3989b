"""Queries of the operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation, learning, profiling, proposals, streams, transforms
from .registry import ORACLES, QUERIES

_FLAGSHIP = "flagship"
_ = evaluation, learning, profiling, proposals, streams, transforms


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[_FLAGSHIP](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""Batches of experiments over datasets, methods and seeds: what is left to do, runs with resume, a summary.

The driver loops over the grid, which is a list given by hand; the data of each run stay in its frames.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.results import exists, read_outcomes, write_text

log = logging.getLogger(__name__)
KEYS = ["dataset", "method", "seed"]
#: A run gets (dataset, method, seed) and returns fields of :data:`evenkeel.sources.results.RESULT_SCHEMA`.
Run = Callable[[str, str, int], Mapping]


def grid(datasets: Sequence[str], methods: Sequence[str], seeds: Sequence[int]) -> list[tuple[str, str, int]]:
    """Every combination once, repeated names left out, in the order given."""
    if not seeds:
        raise ValueError("at least one seed is needed")
    return list(product(dict.fromkeys(datasets), dict.fromkeys(methods), dict.fromkeys(seeds)))


def pending(wanted: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The (dataset, method, seed) without a successful outcome; failed runs are wanted again."""
    return wanted.join(outcomes.where(F.coalesce(F.col("success"), F.lit(False))).select(*KEYS), KEYS, "left_anti")


def run_batch(
    spark: SparkSession, datasets: Sequence[str], methods: Sequence[str], seeds: Sequence[int], run: Run, output: str,
    name: str = "batch", resume: bool = True, clock: Callable[[], float] = time.monotonic,
) -> dict:
    """Run what is left of the grid and return the summary, which is written beside the results.

    Each run's outcome is one JSON file, ``dataset/method/seedN.json``.  A run that raises
    is recorded as failed with its error and the batch goes on; with ``resume`` only
    successful ones are passed over.
    """
    todo = grid(datasets, methods, seeds)
    total, done, failed, began = len(todo), 0, 0, clock()
    if resume and exists(spark, output):
        wanted = spark.createDataFrame(todo, "dataset string, method string, seed int")
        left = {tuple(r) for r in pending(wanted, read_outcomes(spark, output)).collect()}  # the grid at most
        todo = [x for x in todo if x in left]
    skipped = total - len(todo)
    for i, (dataset, method, seed) in enumerate(todo, 1):
        start = clock()
        record = {"experiment_id": f"{dataset}_{method}_seed{seed}", "dataset": dataset, "method": method, "seed": seed}
        try:
            record |= {"success": True, **run(dataset, method, seed)}
        except Exception as e:  # one failure must not end the batch; it is kept in the record
            record |= {"success": False, "error": f"{type(e).__name__}: {e}"}
        record["execution_time"] = clock() - start
        done, failed = done + bool(record["success"]), failed + (not record["success"])
        write_text(spark, f"{output}/{dataset}/{method}/seed{seed}.json", json.dumps(record))
        spent = clock() - began
        log.info("%d of %d: %s, %d done, %d failed, %d skipped, %.0f s spent, %.0f s left", i, len(todo), record["experiment_id"], done, failed, skipped, spent, spent / i * (len(todo) - i))
    spent = clock() - began
    summary = {"name": name, "total": total, "completed": done, "failed": failed, "skipped": skipped, "seconds": spent, "seconds_per_run": spent / max(1, done + failed)}
    write_text(spark, f"{output}/_{name}_summary.json", json.dumps(summary))  # the underscore keeps it out of the results
    return summary

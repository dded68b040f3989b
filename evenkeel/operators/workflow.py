"""The oversampling loop: propose, gate, deduplicate, select, until the classes balance.

The driver holds counters only; rows stay in checkpointed frames.  A stopped run can go
on: selected rows are written per iteration and read back by the next run.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policies import temperature
from ..functions.reliable import checkpoint
from ..sources.results import exists, write_text
from . import dedup, propose, transform, validate

#: A proposer gets (minority, n, iteration, temperature) and returns rows with the columns and a key.
Proposer = Callable[[DataFrame, int, int, float], DataFrame]
#: About how many different rows an anchor gives at one temperature.
VARIANTS = 8
#: Steps of fidelity by which rows are counted before the last step is ranked.
STEPS = 4096


def heat_at(step: int, steps: int) -> float:
    """The temperature of a step; without a last step it goes on through [0.7, 1.0] and never comes back to a value."""
    return temperature(step, steps) if steps else 1.0 - 0.3 * (step * 0.6180339887498949 % 1.0)


def best(df: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows of the highest fidelity, then smallest key: whole steps of fidelity by counts, only the last one ranked."""
    own = df.withColumn("__step", F.floor(F.round("fidelity", 9) * STEPS))
    left = n
    for step, m in sorted(((r[0], r[1]) for r in own.groupBy("__step").count().collect()), reverse=True):  # STEPS + 1 rows at most
        if m > left:
            last = own.where(F.col("__step") == step).orderBy(F.desc(F.round("fidelity", 9)), key).limit(left)
            return own.where(F.col("__step") > step).unionByName(last).drop("__step")
        left -= m
    return df


@dataclass
class Oversampler:
    """``fit_generate(df)`` returns new minority rows: key, columns, y and the iteration that gave them."""

    columns: Sequence[str]
    key: str = "row_id"
    label: str = "y"
    target_ratio: float = 1.0
    #: Rows proposed at once; 0 asks for twice what is missing.
    batch: int = 1000
    anchors: int = 200
    #: 0 sets no limit: the loop ends when the classes balance or it stalls.
    max_iterations: int = 0
    stall_iterations: int = 2
    z_limit: float = 4.5
    proposer: Proposer | None = None
    output: str | None = None
    #: Where each iteration's validated rows (``validated``), the whole result (``resampled``) and the counters
    #: (``progress.json``) are written, as far as given.
    artifacts: str | None = None
    history: list[dict] = field(default_factory=list)

    def get_params(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "history"}

    def set_params(self, **params) -> "Oversampler":
        for k, v in params.items():
            if k not in self.__dict__:
                raise ValueError(f"unknown parameter {k!r}")
            setattr(self, k, v)
        return self

    def _offline(self, minority: DataFrame, n: int, step: int, heat: float) -> DataFrame:
        """Anchors varied by deterministic factors, wider at higher temperature.

        An anchor gives a few different rows only, so where many are wanted each minority row is one.
        """
        many = n > VARIANTS * self.anchors
        anchors = minority if many else propose.typical(minority, self.columns, self.anchors, self.key, seed=f"anchors {step}")
        tagged = anchors.select(F.concat_ws("#", F.lit(str(step)), F.col(self.key).cast("string")).alias("anchor_id"), *self.columns)
        rows = transform.vary(tagged, n, "anchor_id", self.columns, factors=[1 + 0.12 * heat, 1 - 0.12 * heat, 1 + 0.10 * heat])
        return rows.select(F.concat_ws("#", "anchor_id", "sample").alias(self.key), *self.columns)

    def fit_generate(self, df: DataFrame) -> DataFrame:
        counts = {r[0]: r[1] for r in df.groupBy(self.label).count().collect() if r[0] is not None}  # two rows
        if set(counts) != {0, 1}:
            raise ValueError("the label must have the two values 0 and 1")
        wanted = max(0, int(counts[0] * self.target_ratio) - counts[1])
        minority = df.where(F.col(self.label) == 1).select(F.col(self.key).cast("string").alias(self.key), *[F.col(c).cast("double").alias(c) for c in self.columns])
        kept = checkpoint(self._resume(df))  # its files' folders are not written again: iterations go on where they ended
        have, last = kept.agg(F.count("*"), F.max("iteration")).first()
        stalled, step = 0, 0 if last is None else last + 1
        self.history.clear()
        while have < wanted and (not self.max_iterations or step < self.max_iterations) and stalled < self.stall_iterations:
            n = min(self.batch or 2 * (wanted - have), max(wanted - have, 1) * 2)
            heat = heat_at(step, self.max_iterations)
            proposed = (self.proposer or self._offline)(minority, n, step, heat)
            stats = transform.moments(minority, self.columns)
            proposed = transform.impute(transform.clip(proposed, self.columns, stats), minority, self.columns)
            known = minority.select(*self.columns).unionByName(kept.select(*self.columns))
            new = dedup.keep_new(proposed, known, self.columns, self.key)
            gated = checkpoint(validate.adaptive_gate(validate.z_gate(new, minority, self.columns, self.z_limit), minority, self.columns).where("z_ok AND inside"))
            chosen = checkpoint(best(gated, wanted - have, self.key).select(self.key, *self.columns, F.lit(1).alias(self.label), F.lit(step).alias("iteration")))
            got = chosen.count()
            self.history.append({"iteration": step, "proposed": n, "selected": got, "temperature": heat})
            if self.output:
                chosen.write.mode("overwrite").parquet(f"{self.output}/iteration={step:05d}")
            kept, have = checkpoint(kept.unionByName(chosen)), have + got
            stalled = 0 if got else stalled + 1
            step += 1
            if self.artifacts:
                rows = gated.select(self.key, *self.columns, F.lit(1).alias(self.label)).dropDuplicates(list(self.columns))
                rows.write.mode("overwrite").parquet(f"{self.artifacts}/validated/iteration={step - 1:05d}")
                state = {"wanted": wanted, "selected": have, "stalled": stalled, "iterations": self.history}
                write_text(df.sparkSession, f"{self.artifacts}/progress.json", json.dumps(state))
        if self.artifacts:
            self._union(df, kept.drop("iteration")).write.mode("overwrite").parquet(f"{self.artifacts}/resampled")
        return kept

    def resampled(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` and the new ones."""
        return self._union(df, self.fit_generate(df).drop("iteration"))

    def _union(self, df: DataFrame, new: DataFrame) -> DataFrame:
        return df.select(F.col(self.key).cast("string").alias(self.key), *[F.col(c).cast("double").alias(c) for c in self.columns], self.label).unionByName(new)

    def _resume(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        schema = f"{self.key} string, " + ", ".join(f"{c} double" for c in self.columns) + f", {self.label} int, iteration int"
        empty = spark.createDataFrame([], schema)
        if not self.output or not exists(spark, self.output):
            return empty
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.output)

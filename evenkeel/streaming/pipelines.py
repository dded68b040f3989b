"""Streams of proposals: duplicate state, bounded memory, gated micro-batches, windows over events."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import fingerprint
from ..operators import validate


def read_parquet(spark, path: str, schema, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def deduplicated(stream: DataFrame, columns: Sequence[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each fingerprint once; with a time column the state is dropped behind the watermark."""
    kinds = dict(stream.dtypes)
    own = stream.withColumn("fp", fingerprint([(c, kinds[c]) for c in columns]))
    if time is None:
        return own.dropDuplicates(["fp"]).drop("fp")
    return own.withWatermark(time, late).dropDuplicatesWithinWatermark(["fp"]).drop("fp")


def bounded_memory(stream: DataFrame, key: str, value: str, most: int = 1000, groups: int = 16) -> DataFrame:
    """(value): values not among the last ``most`` of their hash group; the oldest are forgotten first."""

    def run(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else ())
        known = set(held)
        for pdf in batches:
            fresh = []
            for v in pdf["value"]:
                if v not in known:
                    fresh.append(v)
                    held.append(v)
                    known.add(v)
                    if len(held) > most:
                        known.discard(held.popleft())
            yield pd.DataFrame({"value": fresh}, dtype=object)
        state.update((list(held),))

    rows = stream.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("grp"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("grp").applyInPandasWithState(run, "value string", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def gated_batches(stream: DataFrame, train: DataFrame, columns: Sequence[str], output: str, checkpoint: str):
    """Each micro-batch through the range and z gates, appended as Parquet; the checkpoint is what a restart goes on from."""

    def each(batch: DataFrame, number: int) -> None:
        ok = validate.z_gate(validate.range_gate(batch, train, columns), train, columns).where("in_range AND z_ok")
        ok.drop("in_range", "z_ok").withColumn("batch", F.lit(number)).write.mode("append").parquet(output)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(stream: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling windows over events (beyond the batch operators): count and sum by kind."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")

"""Streaming queries, run to the end of the table they read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.reliable import shared_folder
from ..streaming import pipelines
from . import views as V
from .registry import query


def _drain(stream, mode="append"):
    """The stream's result as a written table in the shared folder; the driver holds none of it."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "complete":  # each batch has the whole result and replaces the last one
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/rows"))
    else:
        writer = writer.format("parquet").option("path", f"{place}/rows")
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def _events(spark, sf):
    """The events table as a stream; a single file is one micro-batch."""
    schema = V.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parque[t]")


@query("stream_dedup", "SELECT event_type, user_id FROM (SELECT DISTINCT event_type, user_id FROM events)")
def stream_dedup(spark, sf):
    return _drain(pipelines.deduplicated(_events(spark, sf).select("event_type", "user_id"), ["event_type", "user_id"]))


@query("stream_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_counts(spark, sf):
    out = _drain(pipelines.event_counts(_events(spark, sf)), "complete")
    return out.withColumn("total", F.round("total", 4)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


_GATED = """m AS (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_samp(value) AS sd FROM events WHERE event_type = 'purchase')
SELECT event_id, value FROM events, m WHERE event_type <> 'purchase' AND value BETWEEN lo - greatest((hi - lo) * 0.2, 0.5) AND hi + greatest((hi - lo) * 0.2, 0.5) AND abs(value - mu) < 4.5 * sd"""


@query("stream_gated", f"WITH {_GATED}")
def stream_gated(spark, sf):
    """Events that are no purchases, through the gates fitted on purchases, batch by batch."""
    train = V.table(spark, sf, "events").where("event_type = 'purchase'").select("value")
    place = f"{shared_folder(spark)}/gated-{uuid.uuid4().hex}"
    rest = _events(spark, sf).where("event_type <> 'purchase'").select("event_id", "value")
    pipelines.gated_batches(rest, train, ["value"], f"{place}/rows", f"{place}/state").awaitTermination()
    return spark.read.schema("event_id long, value double, batch long").parquet(f"{place}/rows").select("event_id", "value")

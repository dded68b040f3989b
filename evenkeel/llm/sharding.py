"""Rendezvous (highest-random-weight) sharding of stable record keys, in DataFrame functions only.

Every shard draws a hash for a key, and the key goes to the shard with the best draw:
the largest digest for equal weights, the smallest ``-ln(u) / weight`` otherwise.  The
law is ``key``: nothing but the id and the shards decides.  A further shard takes the
keys whose draw for it is the best of all, so no key moves between the others.

Slots inside a shard are gapless: rows are counted by (shard, hash bucket of the key),
the counts are summed over buckets, and rows are numbered inside each bucket.  No
window group holds more than one bucket of one shard, and texts are never shuffled.

Defined results: a null text has size 16 and the CRC of no bytes; all null ids are one
key; rows with the same id share a shard and get different slots, ordered by CRC and
size; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 40
OVERHEAD = 16
BUCKET_DIGITS = 3


def draw(key: Column, shard: Column) -> Column:
    """The digest that a shard draws for a key."""
    return F.md5(F.concat(key, F.lit(":"), shard.cast("string")))


def uniform(digest: Column) -> Column:
    """The digest's first 52 bits as a number strictly between 0 and 1."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def shard_of(key: Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard of a key (a string column); ties go to the smaller shard."""
    if weights is None:
        draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(draw(key, i).alias("d"), (-i).alias("i")))
        return (-F.array_max(draws)["i"]).cast("int")
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("a positive weight for each shard is needed")
    each = [F.struct((-F.log(uniform(draw(key, F.lit(i)))) / float(w)).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*each))["i"].cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """One row per document: its shard, its slot there, and its shard if there were one more."""
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    shard = shard_of(key, shards, weights)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard.alias("shard"),
        key.alias("key"),
    ).withColumn("bucket", F.substring(F.md5("key"), 1, BUCKET_DIGITS))
    counts = docs.select(shard.alias("shard"), F.substring(F.md5(key), 1, BUCKET_DIGITS).alias("bucket")).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("shard", "bucket", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    rows = rows.withColumn("inside", inside).join(before, ["shard", "bucket"])
    if weights is None:
        k = F.col("key")
        grown = F.when(draw(k, F.lit(shards)) > draw(k, F.col("shard")), F.lit(shards)).otherwise(F.col("shard"))
    else:
        grown = shard_of(F.col("key"), shards + 1, [*weights, grown_weight])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"), grown.cast("int").alias("grown_shard")
    )


ORACLE_SQL = r"""
WITH k AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
d AS (
  SELECT k.*, CAST((SELECT max_by(i, md5(key || ':' || i)) FROM range(0, 40) r(i)) AS INTEGER) AS shard,
         CAST((SELECT max_by(i, md5(key || ':' || i)) FROM range(0, 41) r(i)) AS INTEGER) AS grown_shard
  FROM k),
crc AS (
  SELECT list(c ORDER BY n) AS tab FROM (
    SELECT n, list_reduce(range(0, 8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, n) AS c
    FROM range(0, 256) r(n))),
x AS (
  SELECT d.*, xor(4294967295, list_reduce(
           CASE WHEN t = '' THEN []::BIGINT[] ELSE list_transform(range(1, strlen(t) + 1), lambda j: ('0x' || substr(hex(encode(t)), 2 * j - 1, 2))::BIGINT) END,
           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM d, crc)
SELECT doc_id, CAST(strlen(t) + 16 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key), 1, 3), doc_id, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
FROM x
"""

"""The corpus pipeline: five stages over ``documents``, each written and read again.

1. ``language_id``: documents whose language cannot be determined go.
2. ``near_dedup``: of each SimHash component one document stays, the smallest id.
   Texts under one id, or without an id, are documents of their own.
3. ``substring_dedup``: words of passages that also start earlier go; a text all of
   whose words went goes too.
4. ``mix``: documents as often, and as long, as the source mix takes them, in the order
   of the schedule's slots.
5. ``encode``: token ids, and the text decoded from them.

Every stage but the last returns the columns of ``documents``.  A stage works on all
its predecessor kept, whatever its size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import byte_bpe, language_id, mixing, simhash, substring_dedup
from evenkeel.llm.runtime import dealt, shared_dir


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects ``und``; the predicted language fills a missing one."""
    rest = [c for c in docs.columns if c != "text"]
    found = language_id.identify(docs, carry=rest).where(F.col("lang_pred") != language_id.UNDETERMINED)
    own = {c: F.col(f"row.`{c}`") for c in rest} | {"text": F.col("text")}
    if "lang" in rest:
        own["lang"] = F.coalesce("row.lang", "lang_pred")
    return found.select(*[own[c].alias(c) for c in docs.columns])


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component, of texts that share it or have none the smallest hash; one row of it if the row is repeated."""
    # The row travels as a struct, so no name of the input can clash with the keys.
    own = docs.select(*simhash.row_keys(docs), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # The join leaves the rows partitioned and sorted by this key, so dropping repeats needs no further shuffle.
    return own.join(dealt(simhash.leaders(docs)), ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"]).select("row.*")


def stage_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the texts that lost words; drops those that lost all of them."""
    rest = [c for c in docs.columns if c != "text"]
    null = "null"
    while null in docs.columns:
        null += "_"
    marked = docs.withColumn(null, F.col("text").isNull())
    out = substring_dedup.dedup_substrings(marked, carry=[*rest, null]).where("n_removed = 0 OR n_removed < n_words")
    own = {c: F.col(f"row.`{c}`") for c in rest} | {"text": F.when(~F.col(f"row.`{null}`"), F.col("kept"))}
    if "n_chars" in rest:
        own["n_chars"] = F.length(own["text"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[own[c].alias(c) for c in docs.columns])


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids, and the text decoded from the ids."""
    return byte_bpe.round_trip(docs, carry=["doc_id", "source", "lang"])


STAGES = [
    ("language_id", stage_language_id),
    ("simhash_near_dedup", stage_near_dedup),
    ("substring_dedup", stage_substring_dedup),
    ("mix_sources", stage_mix),
    ("byte_bpe", stage_encode),
]

#: Language models, fingerprints and ranks are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Queries that train models (no SQL can give their rows) and the workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, transform
from ..operators.workflow import Oversampler
from . import views as V
from .registry import query

N = ["quantity", "extendedprice", "discount", "tax"]


@query("ml_regions")
def ml_regions(spark, sf):
    return models.diversity_targets(models.regions(V.vectors(spark, sf).where("y = 1").select("id", "v"), 4))


@query("ml_leaf_fairness")
def ml_leaf_fairness(spark, sf):
    t = V.items(spark, sf).withColumn("g", (F.col("discount") > 0.05).cast("int")).select("y", "g", *N)
    return models.leaf_fairness(models.leaves(t, N, trees=100, depth=5), "g")


@query("ml_classifiers")
def ml_classifiers(spark, sf):
    v = V.vectors(spark, sf)
    names = [f"x{i}" for i in range(len(v.select("v").first().v))]
    t = transform.stratified_split(v.select("id", "y", *[F.col("v")[i].alias(x) for i, x in enumerate(names)]), "id")
    return models.compare_classifiers(t.where("split = 'train'"), t.where("split = 'test'"), names)


@query("ml_threshold")
def ml_threshold(spark, sf):
    t = V.vectors(spark, sf)
    return models.near_duplicate_threshold(t.select("id", "v"), t.count(), 9.0)


@query("ml_similarity_threshold")
def ml_similarity_threshold(spark, sf):
    t = V.vectors(spark, sf)
    return models.similarity_threshold(t.select("id", "y", "v"))


@query("anc_discriminative")
def anc_discriminative(spark, sf):
    return models.discriminative(V.items(spark, sf), N, 12, "row_id")


@query("anc_central")
def anc_central(spark, sf):
    return models.central(V.vectors(spark, sf).where("y = 1").select("id", "v"), 5)


@query("wf_oversample")
def wf_oversample(spark, sf):
    """Oversample toxic documents by length and quality until the classes balance, or the loop stalls."""
    t = V.labelled(spark, sf).select("doc_id", "y", "n_chars", F.length("source").cast("double").alias("source_length"))
    return Oversampler(["n_chars", "source_length"], key="doc_id", batch=0).fit_generate(t)

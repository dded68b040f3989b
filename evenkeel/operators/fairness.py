"""Fairness audits on labels: group distributions, gaps, targets and re-audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import severity


def long_groups(df: DataFrame, attributes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row per attribute: (attribute, group, *keep), so that all attributes go through one shuffle."""
    each = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group")) for a in attributes]
    return df.select(*keep, F.explode(F.array(*each)).alias("x")).select("x.attribute", "x.group", *keep).where(F.col("group").isNotNull())


def group_distributions(df: DataFrame, attributes: Sequence[str], label: str = "y") -> DataFrame:
    """Share of each group within either class; a group absent from a class has share 0."""
    counts = long_groups(df, attributes, [label]).groupBy("attribute", "group").agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("n_minority"), F.count(F.when(F.col(label) == 0, 1)).alias("n_majority")
    )
    whole = Window.partitionBy("attribute")  # one row per group by now
    return counts.withColumn("p_minority", F.coalesce(F.try_divide(F.col("n_minority"), F.sum("n_minority").over(whole)), F.lit(0.0))).withColumn(
        "p_majority", F.coalesce(F.try_divide(F.col("n_majority"), F.sum("n_majority").over(whole)), F.lit(0.0))
    )


def underrepresented(distributions: DataFrame, factor: float = 0.7) -> DataFrame:
    """Groups whose share in the minority is below ``factor`` of their share in the majority."""
    return distributions.where(F.col("p_minority") < factor * F.col("p_majority")).withColumn("shortfall", F.col("p_majority") - F.col("p_minority"))


def label_parity(df: DataFrame, attributes: Sequence[str], label: str = "y", limit: float = 0.05) -> DataFrame:
    """Demographic parity difference of the label, for attributes of exactly two groups."""
    rates = long_groups(df, attributes, [label]).groupBy("attribute", "group").agg(F.avg(F.col(label).cast("double")).alias("rate"))
    out = rates.groupBy("attribute").agg(
        F.count("*").alias("n_groups"), (F.max("rate") - F.min("rate")).alias("dpd"),
        F.max(F.struct("rate", "group")).alias("high"), F.min(F.struct("rate", "group")).alias("low"),
    ).where("n_groups = 2")
    return out.select("attribute", "dpd", F.col("high.group").alias("privileged"), F.col("low.group").alias("unprivileged"), severity(F.col("dpd")).alias("severity"), (F.col("dpd") > limit).alias("violation"))


def targets(distributions: DataFrame, factor: float = 0.7) -> DataFrame:
    """How many minority rows to add for each under-represented group, and how urgently."""
    n = F.sum("n_minority").over(Window.partitionBy("attribute"))
    t = distributions.withColumn("n_all", n)
    t = t.where(F.col("p_minority") < factor * F.col("p_majority")).withColumn("gap", F.col("p_majority") - F.col("p_minority"))
    wanted = F.greatest(F.lit(0), F.floor(F.col("gap") * F.col("n_all") * 2))
    level = severity(F.col("gap"))
    priority = F.when(level == "high", 1).when(level == "medium", 2).otherwise(3)
    return t.select("attribute", "group", "gap", wanted.cast("long").alias("n_target"), level.alias("severity"), priority.alias("priority"))


def counterfactual_pairs(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(attribute, a, b): the two values of each binary attribute."""
    groups = long_groups(df, attributes, []).groupBy("attribute").agg(F.sort_array(F.collect_set("group")).alias("g"))
    return groups.where(F.size("g") == 2).select("attribute", F.col("g")[0].alias("a"), F.col("g")[1].alias("b"))


def reaudit(before: DataFrame, after: DataFrame, attributes: Sequence[str], label: str = "y", limit: float = 0.05) -> DataFrame:
    """Parity of the label before and after rows were added: gaps, improvement, target met."""
    old, new = (label_parity(x, attributes, label, limit).select("attribute", F.col("dpd").alias(name)) for x, name in ((before, "dpd_before"), (after, "dpd_after")))
    out = old.join(new, "attribute")
    return out.withColumn("improvement", F.col("dpd_before") - F.col("dpd_after")).withColumn("met", F.col("dpd_after") <= limit)


def balance_constraints(distributions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(attribute, group, proportion, from_target, priority): what share each group should have of new rows.

    An attribute with targets (:func:`targets`) asks for its target groups' majority shares;
    one without keeps the minority's own distribution, at priority 2.
    """
    aims = wanted.select("attribute", "group", F.col("priority"))
    named = aims.select("attribute").distinct().withColumn("named", F.lit(True))
    own = distributions.where("n_minority > 0 OR n_majority > 0").join(named, "attribute", "left").join(aims, ["attribute", "group"], "left")
    kept = own.where("named IS NULL AND p_minority > 0 OR priority IS NOT NULL")
    target = F.col("priority").isNotNull()
    return kept.select("attribute", "group", F.when(target, F.col("p_majority")).otherwise(F.col("p_minority")).alias("proportion"), target.alias("from_target"), F.coalesce("priority", F.lit(2)).alias("priority"))


def diversity_plan(wanted: DataFrame, regions: DataFrame, sparse: float = 0.5, default: int = 100) -> DataFrame:
    """(attribute, group, n_regions, n_target, priority): fairness targets whose group has regions below the density ``sparse``.

    ``regions`` has (attribute, group, density), attribute and group null for a region of
    all rows.  Without any such target the sparse regions of all rows get ``default`` rows
    at priority 2; without those the plan is empty.
    """
    thin = regions.where(F.col("density") < sparse).groupBy("attribute", "group").agg(F.count("*").alias("n_regions"))
    own = wanted.join(thin, ["attribute", "group"]).select("attribute", "group", "n_regions", "n_target", "priority")
    whole = thin.where("attribute IS NULL").select("attribute", "group", "n_regions", F.lit(default).cast("long").alias("n_target"), F.lit(2).alias("priority"))
    none = own.agg((F.count("*") == 0).alias("__none"))
    return own.unionByName(whole.crossJoin(F.broadcast(none)).where("__none").drop("__none"))  # one row each

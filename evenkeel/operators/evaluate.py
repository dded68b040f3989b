"""Classification and fairness metrics from labels, predictions and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def cells(label: str = "y", pred: str = "pred") -> dict[str, Column]:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return {"tp": F.count(F.when(y & p, 1)), "fp": F.count(F.when(~y & p, 1)), "tn": F.count(F.when(~y & ~p, 1)), "fn": F.count(F.when(y & ~p, 1))}


def _metrics(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = df.withColumns({
        "accuracy": _div(tp + tn, tp + fp + tn + fn), "precision": _div(tp, tp + fp), "recall": _div(tp, tp + fn),
        "f1": _div(2 * tp, 2 * tp + fp + fn), "specificity": _div(tn, tn + fp),
        "mcc": _div(tp.cast("double") * tn - fp.cast("double") * fn, F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))),
    })
    return out.withColumns({"balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2, "g_mean": F.sqrt(F.col("recall") * F.col("specificity"))})


def classification(df: DataFrame, label: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Confusion cells and the metrics from them; what divides by zero is 0."""
    return _metrics(df.groupBy(*by).agg(*[v.alias(k) for k, v in cells(label, pred).items()]))


def per_class(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    sides = df.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(label) == F.col(pred)).cast("int").alias("h")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("x"))
    out = sides.groupBy(F.col("x.c").alias("class")).agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), F.sum("x.h").alias("hits"))
    out = out.withColumns({"precision": _div(F.col("hits"), F.col("predicted")), "recall": _div(F.col("hits"), F.col("support"))})
    return out.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("predicted", "hits")


def score_table(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """One row per distinct score, highest first: its positives and negatives, and both cumulated.

    Scores are first counted (combined before the shuffle); the running sums then go over
    distinct scores only, in two levels by the score's leading digits.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg"))
    counts = counts.withColumn("band", F.floor(F.col("score") * 64))
    bands = counts.groupBy("band").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    over = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)  # one row per band
    bands = bands.select("band", F.coalesce(F.sum("bp").over(over), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("band").orderBy(F.desc("score"))
    out = counts.withColumn("ip", F.sum("pos").over(inside)).withColumn("in", F.sum("neg").over(inside)).join(bands, "band")
    return out.select("score", "pos", "neg", (F.col("p0") + F.col("ip")).alias("tp"), (F.col("n0") + F.col("in")).alias("fp"))


def roc_auc(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """One row: roc_auc (ties count half) and average precision; null with a single class."""
    t = score_table(df, label, score)
    totals = t.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("pos").cast("double") * (F.col("fp") - F.col("neg") + F.col("neg") / 2.0)).alias("below"),
        F.sum(F.col("pos") * F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))).alias("ap"),
    )
    return totals.select((1 - F.try_divide(F.col("below"), F.col("p").cast("double") * F.col("n"))).alias("roc_auc"), F.try_divide("ap", "p").alias("pr_auc"))


def curves(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """ROC and PR points: a row per distinct score taken as threshold."""
    t = score_table(df, label, score)
    totals = t.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    out = t.crossJoin(F.broadcast(totals))  # one row
    return out.select("score", _div(F.col("fp"), F.col("n")).alias("fpr"), _div(F.col("tp"), F.col("p")).alias("tpr"), _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def best_threshold(df: DataFrame, metric: str = "f1", steps: int = 100, label: str = "y", score: str = "score") -> DataFrame:
    """The threshold of 0.1 to 0.9 in equal steps with the best metric; of equals the lowest."""
    t = score_table(df, label, score)
    grid = F.sequence(F.lit(0), F.lit(steps - 1))
    hits = t.select("pos", "neg", "score", F.explode(grid).alias("i")).withColumn("threshold", F.lit(0.1) + F.lit(0.8) * F.col("i") / (steps - 1))
    on = F.col("score") >= F.col("threshold")
    rows = hits.groupBy("i", "threshold").agg(F.sum(F.when(on, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(on, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~on, F.col("neg")).otherwise(0)).alias("tn"), F.sum(F.when(~on, F.col("pos")).otherwise(0)).alias("fn"))
    ranked = _metrics(rows).withColumn("key", F.round(metric, 9))
    best = ranked.agg(F.min_by(F.struct("threshold", F.col(metric).alias("value")), F.struct((-F.col("key")).alias("k"), "i")).alias("x"))
    return best.select(F.lit(metric).alias("metric"), "x.threshold", "x.value")


def group_rates(df: DataFrame, attributes: Sequence[str], label: str = "y", pred: str = "pred") -> DataFrame:
    """(attribute, group, n, selection_rate, tpr, fpr); a group without positives (negatives) has tpr (fpr) 0."""
    each = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group")) for a in attributes]
    long = df.select(label, pred, F.explode(F.array(*each)).alias("x")).select("x.attribute", "x.group", label, pred).where(F.col("group").isNotNull())
    out = long.groupBy("attribute", "group").agg(F.count("*").alias("n"), F.avg(F.col(pred).cast("double")).alias("selection_rate"), *[v.alias(k) for k, v in cells(label, pred).items()])
    return out.select("attribute", "group", "n", "selection_rate", _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"), _div(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def fairness(df: DataFrame, attributes: Sequence[str], label: str = "y", pred: str = "pred") -> DataFrame:
    """Demographic parity and equalised odds, as difference and ratio, of each attribute."""
    r = group_rates(df, attributes, label, pred).groupBy("attribute")
    gap = lambda c: F.max(c) - F.min(c)
    ratio = lambda c: _div(F.min(c), F.max(c))
    return r.agg(
        gap("selection_rate").alias("dpd"), ratio("selection_rate").alias("dpr"), F.greatest(gap("tpr"), gap("fpr")).alias("eod"), F.least(ratio("tpr"), ratio("fpr")).alias("eor")
    )


def fairness_summary(metrics: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Averages over attributes, the largest violation, and whether every limit holds."""
    limits = limits or {"dpd": 0.1, "eod": 0.1, "dpr": 0.8, "eor": 0.8}
    passed = [F.bool_and(F.col(c) <= v if c in ("dpd", "eod") else F.col(c) >= v).alias(f"pass_{c}") for c, v in limits.items()]
    averages = [F.avg(F.abs(c)).alias(f"avg_{c}") for c in ("dpd", "dpr", "eod", "eor")]
    return metrics.agg(*averages, F.max(F.greatest("dpd", "eod")).alias("max_violation"), *passed)


def binary_fairness(df: DataFrame, attribute: str, privileged: str, label: str = "y", pred: str = "pred") -> DataFrame:
    """Unprivileged against privileged group of a binary attribute, and the Theil index of benefits."""
    g = F.col(attribute).cast("string") == privileged
    rate = lambda mask, of: _div(F.count(F.when(mask & of, 1)), F.count(F.when(mask, 1)))
    p, y = F.col(pred) == 1, F.col(label) == 1
    benefit = (F.col(pred) - F.col(label) + 1).cast("double")
    mean = df.agg(F.avg(benefit).alias("mu"))
    rows = df.crossJoin(F.broadcast(mean))  # one row
    part = F.when(benefit > 0, benefit / F.col("mu") * F.ln(benefit / F.col("mu"))).otherwise(0.0)
    out = rows.agg(
        rate(~g, p).alias("su"), rate(g, p).alias("sp"), rate(~g & y, p).alias("tu"), rate(g & y, p).alias("tp"), rate(~g & ~y, p).alias("fu"), rate(g & ~y, p).alias("fp"), F.avg(part).alias("theil")
    )
    su, sp, tu, tp, fu, fp = (F.col(c) for c in ("su", "sp", "tu", "tp", "fu", "fp"))
    return out.select(F.lit(attribute).alias("attribute"), (su - sp).alias("spd"), _div(su, sp).alias("disparate_impact"), (tu - tp).alias("equal_opportunity"), ((tu - tp + fu - fp) / 2).alias("average_odds"), F.col("theil"))


def all_fairness(df: DataFrame, attribute: str, privileged: str, label: str = "y", pred: str = "pred") -> DataFrame:
    """One row: both families, :func:`fairness` over all groups and :func:`binary_fairness` against the privileged one."""
    return fairness(df, [attribute], label, pred).join(binary_fairness(df, attribute, privileged, label, pred), "attribute")  # one row each

"""Profiling: balance, columns, correlations, constraints, class overlap, complexity."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import complexity_category, imbalance_category, size_category
from .quantiles import finite, quantiles, value_counts


def balance(df: DataFrame, label: str = "y", target_ratio: float = 1.0, features: int | None = None) -> DataFrame:
    """Class counts, minority and majority class, imbalance ratio, balancing gap and categories; one row.

    Ties go to the smaller class value.  One class only: ratio null and gap 0.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("c")).agg(F.count("*").alias("n"))
    one = counts.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_classes"),
        F.min(F.struct("n", "c")).alias("low"),
        F.max(F.struct("n", (-F.col("c")).alias("c"))).alias("high"),
    )
    out = one.select(
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        "n_classes",
        F.col("low.c").alias("minority_class"),
        (-F.col("high.c")).alias("majority_class"),
        F.col("low.n").alias("n_minority"),
        F.col("high.n").alias("n_majority"),
        F.when(F.col("n_classes") > 1, F.round(F.try_divide(F.col("high.n"), F.col("low.n")), 6)).alias("imbalance_ratio"),
        F.greatest(F.lit(0), F.floor(F.col("high.n") * target_ratio) - F.col("low.n")).alias("gap"),
    )
    out = out.withColumn("size_category", size_category(F.col("n_rows"))).withColumn("imbalance_category", imbalance_category(F.col("imbalance_ratio")))
    return out.withColumn("complexity_category", complexity_category(F.lit(features))) if features is not None else out


def _stack(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One wide aggregate row, fields named ``column__field``, to a row per column."""
    each = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in columns]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def numeric_columns(df: DataFrame, columns: Sequence[str], fence: float = 3.0, discrete_limit: int = 20) -> DataFrame:
    """Per numeric column: nulls, distinct values, moments, quartiles, skewness, outlier fence and kind.

    Moments are one aggregation over all columns, quartiles and distinct counts come from
    counted values.  Skewness is bias-corrected; a constant column has skewness null; an
    empty or all-null one has every statistic null.  NaN and infinities count as nulls.
    """
    aggs: list[Column] = []
    for c in columns:
        x = finite(F.col(c))
        n, sd = F.count(x), F.stddev_pop(x)
        skew = F.try_divide(F.avg(x * x * x) - 3 * F.avg(x) * F.avg(x * x) + 2 * F.avg(x) * F.avg(x) * F.avg(x), sd * sd * sd)
        aggs += [
            (F.count("*") - n).alias(f"{c}__n_null"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
            F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__sd"),
            (skew * F.try_divide(F.sqrt(n.cast("double") * (n - 1)), (n - 2).cast("double"))).alias(f"{c}__skewness"),
            F.bool_and(x == F.floor(x)).alias(f"{c}__integral"),
        ]
    moments = _stack(df.agg(*aggs), columns, ["n_null", "min", "max", "mean", "sd", "skewness", "integral"])
    names = F.array(*[F.lit(c) for c in columns])
    found = quantiles(value_counts(df, columns), [0.25, 0.5, 0.75]).select(F.element_at(names, F.col("c") + 1).alias("column"), "n_unique", "q")
    out = moments.join(found, "column", "left")  # a row per column on both sides
    out = out.select("column", "n_null", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "min", "max", "mean", "sd", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "skewness", "integral")
    spread = F.col("q3") - F.col("q1")
    kind = F.when(F.col("n_unique") == 2, "binary").when(F.col("n_unique") <= discrete_limit, "ordinal").when(F.col("integral"), "discrete").otherwise("continuous")
    return out.withColumn("fence_low", F.col("q1") - fence * spread).withColumn("fence_high", F.col("q3") + fence * spread).withColumn("kind", kind).drop("integral")


def feature_kinds(df: DataFrame, columns: Sequence[str], few: int = 10) -> DataFrame:
    """(n_categorical, n_numeric): text columns and those with fewer than ``few`` values are categorical; one row."""
    text = [c for c, kind in df.select(*columns).dtypes if kind in ("string", "boolean")]
    rest = [c for c in columns if c not in text]
    if not rest:
        return df.sparkSession.range(1).select(F.lit(len(text)).cast("long").alias("n_categorical"), F.lit(0).cast("long").alias("n_numeric"))
    distinct = value_counts(df, rest).groupBy("c").agg(F.count("*").alias("n"))  # a row per column
    many = distinct.agg(F.count(F.when(F.col("n") >= few, 1)).alias("n_numeric"))
    return many.select((F.lit(len(columns)) - F.col("n_numeric")).alias("n_categorical"), "n_numeric")


#: Word sets that make a text column ordinal if all of them occur.
ORDINAL_WORDS = (
    ("low", "medium", "high"), ("small", "medium", "large"), ("poor", "fair", "good", "excellent"),
    ("never", "rarely", "sometimes", "often", "always"), ("none", "some", "many"), ("bad", "neutral", "good"),
)


def text_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column: nulls, distinct values, mode (ties: smallest), its count, sorted categories, ordinal or not."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    words = F.array(*[F.array(*[F.lit(w) for w in s]) for s in ORDINAL_WORDS])
    lower = F.collect_set(F.lower("value"))
    seen = F.col("value").isNotNull()
    best = F.max(F.when(seen, F.col("n")))
    out = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_unique"),
        best.alias("mode_count"),
        F.min_by("value", F.when(seen, F.struct((-F.col("n")).alias("k"), "value"))).alias("mode"),
        F.array_join(F.sort_array(F.collect_list("value")), ",").alias("categories"),
        (F.exists(words, lambda s: F.size(F.array_except(s, lower)) == 0) | F.bool_and(F.col("value").try_cast("double").isNotNull())).alias("is_ordinal"),
    )
    return out.withColumn("is_ordinal", F.coalesce((F.col("n_unique") > 2) & F.col("is_ordinal"), F.lit(False)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r from moments; null where a column is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.stddev_pop(x) * F.stddev_pop(y)))


def correlations(df: DataFrame, columns: Sequence[str], strong: float = 0.7) -> DataFrame:
    """(c1, c2, r, is_strong) for each pair of columns, by one aggregation."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    each = [F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    out = row.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return out.withColumn("is_strong", F.coalesce(F.abs("r") >= strong, F.lit(False)))


def correlated_with(pairs: DataFrame) -> DataFrame:
    """(column, partners): the strong partners of each column, sorted."""
    strong = pairs.where("is_strong")
    both = strong.select(F.col("c1").alias("column"), F.col("c2").alias("partner")).unionByName(strong.select(F.col("c2").alias("column"), F.col("c1").alias("partner")))
    return both.groupBy("column").agg(F.array_join(F.sort_array(F.collect_set("partner")), ",").alias("partners"))


def exclusive_pairs(df: DataFrame, columns: Sequence[str], share: float = 0.05) -> DataFrame:
    """(c1, c2, both_share, exclusive): columns that both have nulls and are hardly ever filled together."""
    pairs = list(combinations(columns, 2))
    aggs = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{c}") for c in columns]
    aggs += [F.avg(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1.0).otherwise(0.0)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]
    each = [
        F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"s{i}").alias("both_share"), ((F.col(f"n_{a}") > 0) & (F.col(f"n_{b}") > 0) & (F.col(f"s{i}") < share)).alias("exclusive"))
        for i, (a, b) in enumerate(pairs)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*each)).alias("x")).select("x.*")


def implication_violations(df: DataFrame, condition: str, implied: str) -> DataFrame:
    """(n_condition, n_violations, holds) of "where the condition holds, so does the implied one"."""
    c, i = F.expr(condition), F.expr(implied)
    out = df.agg(F.count(F.when(c, 1)).alias("n_condition"), F.count(F.when(c & ~F.coalesce(i, F.lit(False)), 1)).alias("n_violations"))
    return out.withColumn("holds", F.col("n_violations") == 0)


def class_overlap(df: DataFrame, columns: Sequence[str], label: str = "y") -> DataFrame:
    """Per column the shared share, in percent, of the two classes' ranges."""
    one, zero = F.col(label) == 1, F.col(label) == 0
    aggs = []
    for c in columns:
        for name, cls in (("a", one), ("b", zero)):
            aggs += [F.min(F.when(cls, F.col(c))).alias(f"{c}__{name}_low"), F.max(F.when(cls, F.col(c))).alias(f"{c}__{name}_high")]
    out = _stack(df.agg(*aggs), columns, ["a_low", "a_high", "b_low", "b_high"])
    shared = F.greatest(F.lit(0.0), F.least("a_high", "b_high") - F.greatest("a_low", "b_low"))
    union = F.greatest("a_high", "b_high") - F.least("a_low", "b_low")
    return out.withColumn("overlap_percent", F.coalesce(F.try_divide(shared, union) * 100, F.lit(0.0)))


def crosstab(df: DataFrame, group: str, label: str = "y") -> DataFrame:
    """Rows and class shares of each group."""
    out = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.avg((F.col(label) == 0).cast("double")).alias("share_0"), F.avg((F.col(label) == 1).cast("double")).alias("share_1"))
    return out


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sd, min, quartiles and max of each column."""
    own = _stack(df.agg(*[F.count(finite(F.col(c))).alias(f"{c}__count") for c in columns]), columns, ["count"])
    return own.join(numeric_columns(df, columns), "column").select("column", "count", "mean", "sd", "min", "q1", "median", "q3", "max")


def class_statistics(df: DataFrame, columns: Sequence[str], label: str = "y", classes: Sequence = (0, 1)) -> DataFrame:
    """(column, y, min, max, mean, median, sd, p10, p25, p75, p90) of each column in each class; null where a class has no values."""
    each = [(c, k, f"{c}|{k}") for c in columns for k in classes]
    split = df.select(*[F.when(F.col(label) == k, finite(F.col(c))).alias(name) for c, k, name in each])
    q = lambda name: F.col(f"`{name}`")  # noqa: E731  a name with a bar in it
    plain = split.agg(*[F.struct(F.min(q(n)).alias("min"), F.max(q(n)).alias("max"), F.avg(q(n)).alias("mean"), F.stddev_samp(q(n)).alias("sd")).alias(f"{n}|m") for _, _, n in each])
    at = quantiles(value_counts(split, [f"`{n}`" for _, _, n in each]), [0.1, 0.25, 0.5, 0.75, 0.9])  # a row per column and class
    rows = plain.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(c).alias("column"), F.lit(k).alias("y"), q(f"{n}|m").alias("m")) for i, (c, k, n) in enumerate(each)])).alias("e")).select("e.*")
    out = rows.join(at, "c", "left")
    return out.select("column", "y", "m.min", "m.max", "m.mean", F.col("q")[2].alias("median"), "m.sd", *[F.col("q")[i].alias(f"p{p}") for i, p in ((0, 10), (1, 25), (3, 75), (4, 90))])


def class_frequencies(df: DataFrame, column: str, k: int = 4, label: str = "y") -> DataFrame:
    """(y, value, share): the k most frequent values of each class and their share of its filled rows; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(label).alias("y"), F.col(column).alias("value")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("y").agg(F.sum("n").alias("t"))  # one row per class
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k).join(F.broadcast(totals), "y").select("y", "value", (F.col("n") / F.col("t")).alias("share"))


def top_categories(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values with their counts; ties by value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(k)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n): equal-width bins over the column's range, the last one closed; what a plot would show."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins))
    counted = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # span: one row
    grid = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    width = (F.col("hi") - F.col("lo")) / bins
    out = grid.join(counted, "bin", "left")
    return out.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def complexity(df: DataFrame, numeric: Sequence[str], text: Sequence[str], label: str = "y") -> DataFrame:
    """One row of complexity measures and their weighted score in [0, 1]."""
    pairs = list(combinations(numeric, 2))
    p = len(numeric) + len(text)
    # Of the whole matrix of absolute correlations, diagonal as zero.
    mean_r = sum((F.coalesce(F.abs(correlation(F.col(a), F.col(b))), F.lit(0.0)) for a, b in pairs), F.lit(0.0)) * 2 / max(1, len(numeric) ** 2)
    cardinality = sum((F.count_distinct(c) for c in text), F.lit(0)) / max(1, len(text))
    minority = F.count(F.when(F.col(label) == 1, 1))
    ratio = F.try_divide(F.count(F.when(F.col(label) == 0, 1)), minority)
    row = df.agg(F.count("*").alias("n_rows"), minority.alias("n_minority"), ratio.alias("ratio"), cardinality.alias("avg_cardinality"), mean_r.alias("mean_abs_r"))
    parts = [
        0.15 * F.least(F.lit(1.0), F.lit(p / 50.0)),
        0.20 * F.least(F.lit(1.0), F.coalesce(F.col("ratio"), F.lit(0.0)) / 20.0),
        0.25 * F.least(F.lit(1.0), F.try_divide(F.lit(1000.0), F.greatest(F.col("n_minority"), F.lit(1)).cast("double")) / 10.0),
        0.15 * F.least(F.lit(1.0), F.col("avg_cardinality") / 20.0),
        0.10 * F.col("mean_abs_r"),
        F.lit(0.15 * len(text) / max(1, p)),
    ]
    return row.withColumn("n_features", F.lit(p)).withColumn("score", sum(parts, F.lit(0.0)))

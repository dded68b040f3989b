"""Transforms: targets, encoders, imputation, scaling, clipping, splits, protected groups."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform
from .quantiles import quantile_row, value_counts


def build_target(df: DataFrame, column: str, positive: str | None = None, default: int = 0, name: str = "y") -> DataFrame:
    """A 0/1 label: equality with ``positive``, or the number itself; what cannot be read is ``default``."""
    if positive is not None:
        label = F.coalesce((F.col(column).cast("string") == positive).cast("int"), F.lit(default))
    else:
        label = F.coalesce(F.col(column).try_cast("int"), F.lit(default))
    return df.withColumn(name, label)


#: The statistics that :func:`moments` can give.
MOMENTS = {"mean": F.avg, "sd1": F.stddev_samp, "sd0": F.stddev_pop, "min": F.min, "max": F.max}


def moments(df: DataFrame, columns: Sequence[str], which: Sequence[str] = tuple(MOMENTS)) -> DataFrame:
    """One row: the wanted of mean, sample and population deviation, min, max and median of each column, as ``column__mean``."""
    plain = [m for m in which if m != "median"]
    out = df.agg(*[MOMENTS[m](c).alias(f"{c}__{m}") for c in columns for m in plain]) if plain else None
    if "median" in which:
        middle = quantile_row(df, columns, [0.5]).select(*[F.col(c)[0].alias(f"{c}__median") for c in columns])
        out = middle if out is None else out.crossJoin(middle)  # one row each
    return out


def with_moments(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Each row beside the one row of statistics; a column of ``df`` with the name of a statistic is an error."""
    if clash := sorted(set(df.columns) & set(stats.columns)):
        raise ValueError(f"columns named like statistics: {', '.join(clash)}")
    return df.crossJoin(F.broadcast(stats))  # one row


def drop_moments(df: DataFrame, stats: DataFrame) -> DataFrame:
    """The frame without the statistics' columns; no other column goes, whatever its name."""
    return df.drop(*stats.columns)


def label_dimension(df: DataFrame, column: str) -> DataFrame:
    """(value, code): sorted distinct trimmed values, null as "missing", numbered from 0."""
    values = df.select(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("missing")).alias("value")).distinct()
    return values.withColumn("code", (F.dense_rank().over(Window.orderBy("value")) - 1).cast("int"))  # one row per category


def label_encode(df: DataFrame, column: str, dimension: DataFrame, name: str | None = None) -> DataFrame:
    """Codes of a column; a value the dimension lacks, or null, gets code 0."""
    d = dimension.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    out = df.join(d, F.trim(F.col(column).cast("string")) == F.col("__value"), "left")
    return out.withColumn(name or f"{column}_code", F.coalesce("__code", F.lit(0))).drop("__value", "__code")


def label_decode(df: DataFrame, column: str, dimension: DataFrame, name: str) -> DataFrame:
    """The value of a code; a code the dimension lacks gives the value of code 0."""
    d = dimension.select(F.col("code").alias("__code"), F.col("value").alias("__value"))
    first = dimension.where("code = 0").select(F.col("value").alias("__first"))
    out = df.join(d, F.col(column) == F.col("__code"), "left").crossJoin(F.broadcast(first))  # one row
    return out.withColumn(name, F.coalesce("__value", "__first")).drop("__code", "__value", "__first")


def zscore(df: DataFrame, columns: Sequence[str], stats: DataFrame) -> DataFrame:
    """(x - mean) / population deviation; a constant column gives 0."""
    out = with_moments(df, stats)
    return drop_moments(out.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__sd0")), F.when(F.col(c).isNotNull(), 0.0)) for c in columns}), stats)


def unscale(df: DataFrame, columns: Sequence[str], stats: DataFrame) -> DataFrame:
    """The inverse of :func:`zscore`."""
    out = with_moments(df, stats)
    return drop_moments(out.withColumns({c: F.col(c) * F.col(f"{c}__sd0") + F.col(f"{c}__mean") for c in columns}), stats)


def impute(df: DataFrame, train: DataFrame, numeric: Sequence[str], text: Sequence[str] = (), missing: str | None = None) -> DataFrame:
    """Numbers that cannot be read become the training median (else 0); text its mode, or ``missing``."""
    out = df
    if numeric:
        read = train.select([F.col(c).try_cast("double").alias(c) for c in numeric])
        stats = moments(read, numeric, ["median"])
        out = with_moments(df.withColumns({c: F.col(c).try_cast("double") for c in numeric}), stats)
        out = drop_moments(out.withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.col(f"{c}__median"), F.lit(0.0)) for c in numeric}), stats)
    for c in text:
        if missing is not None:
            out = out.withColumn(c, F.coalesce(c, F.lit(missing)))
            continue
        counts = train.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
        mode = counts.agg(F.min_by("value", F.struct((-F.col("n")).alias("k"), "value")).alias("__mode"))
        out = out.crossJoin(F.broadcast(mode)).withColumn(c, F.coalesce(c, "__mode")).drop("__mode")  # one row
    return out


def align(df: DataFrame, train: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The training columns in their order: missing ones added, extra ones dropped, gaps filled by the median."""
    out = df.select(*keep, *[(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in columns])
    return impute(out, train, columns)


def clip(df: DataFrame, columns: Sequence[str], stats: DataFrame) -> DataFrame:
    """Values drawn into the training range; ``n_clipped`` counts the row's changed cells."""
    out = with_moments(df, stats)
    changed = [F.coalesce(((F.col(c) < F.col(f"{c}__min")) | (F.col(c) > F.col(f"{c}__max"))).cast("int"), F.lit(0)) for c in columns]
    out = out.withColumn("n_clipped", sum(changed, F.lit(0)))
    bounded = {c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"{c}__max")), F.col(f"{c}__min"))) for c in columns}
    return drop_moments(out.withColumns(bounded), stats)


_RULE = re.compile(r"^\s*\w+\s*(>=|<=|>|<)\s*(-?\d+(?:\.\d+)?)\s*$")


def protected(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """0/1 flags ``is_<column>``: a rule is a comparison such as "age < 25", or a category to equal."""
    flags: dict[str, Column] = {}
    for c, rule in rules.items():
        found = _RULE.match(rule)
        value = F.col(c)
        if found:
            op, bound = found[1], float(found[2])
            x = value.try_cast("double")
            test = {">=": x >= bound, "<=": x <= bound, ">": x > bound, "<": x < bound}[op]
        else:
            test = value.cast("string") == rule
        flags[f"is_{c}"] = F.coalesce(test, F.lit(False)).cast("int")
    return df.withColumns(flags)


def real_map(df: DataFrame, column: str, low: float, high: float, stats: DataFrame, name: str) -> DataFrame:
    """A normalised column (its training range) mapped linearly to [low, high]; null goes to the middle, outside is clipped."""
    out = with_moments(df, stats)
    part = F.coalesce(F.try_divide(F.col(column) - F.col(f"{column}__min"), F.col(f"{column}__max") - F.col(f"{column}__min")), F.lit(0.5))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))
    return drop_moments(out.withColumn(name, low + part * (high - low)), stats)


def quantile_profile(df: DataFrame, columns: Sequence[str], at: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(column, p10, p25, ...), exact."""
    row = quantile_row(df, columns, at)
    each = [F.struct(F.lit(c).alias("column"), *[F.col(c)[i].alias(f"p{round(100 * x)}") for i, x in enumerate(at)]) for c in columns]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def numbered(df: DataFrame, key: str, seed: str, name: str, digits: int = 2) -> DataFrame:
    """Rows numbered from 1 in the order of a hash of the key, in two levels: counts per hash prefix, then inside each."""
    own = df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))).withColumn("__b", F.substring("__h", 1, digits))
    counts = own.groupBy("__b").agg(F.count("*").alias("__n"))  # 16 ** digits rows at most
    before = counts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    return own.withColumn("__r", inside).join(before, "__b").withColumn(name, F.col("__before") + F.col("__r")).drop("__h", "__b", "__r", "__before")


def stratified_split(df: DataFrame, key: str, label: str = "y", seed: int = 42, parts: Mapping[str, float] | None = None, digits: int = 2) -> DataFrame:
    """``split`` for each row: shares of each class, in the order of a hash of the key.

    Rows are numbered inside (class, hash prefix) and the counts summed over prefixes, so
    a class that holds most rows is not one window group.
    """
    parts = parts or {"train": 0.6, "val": 0.2, "test": 0.2}
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    own = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, digits))
    counts = own.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    one = Window.partitionBy(label)
    before = counts.select(
        F.col(label).alias("__label"), F.col("__b").alias("__bucket"),
        F.coalesce(F.sum("__n").over(one.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(one).alias("__all"),
    )
    ranked = own.withColumn("__r", F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key)))
    out = ranked.join(before, ranked[label].eqNullSafe(before["__label"]) & (ranked["__b"] == before["__bucket"]))
    place, split, upto = F.col("__before") + F.col("__r"), None, 0.0
    for name, share in list(parts.items())[:-1]:
        upto += share
        test = place <= F.round(F.col("__all") * round(upto, 9))
        split = F.when(test, name) if split is None else split.when(test, name)
    last = list(parts)[-1]
    return out.withColumn("split", split.otherwise(last) if split is not None else F.lit(last)).drop("__h", "__b", "__r", "__label", "__bucket", "__before", "__all")


def embed(df: DataFrame, numeric: Sequence[str], text: Sequence[str], stats: DataFrame, name: str = "v") -> DataFrame:
    """A row as a vector: min-max numbers (constant: 0.5), hashed categories."""
    from ..functions.columns import category_code, scaled

    out = with_moments(df, stats)
    parts = [scaled(F.col(c), F.col(f"{c}__min"), F.col(f"{c}__max")) for c in numeric] + [category_code(F.col(c)) / 10000.0 for c in text]
    return drop_moments(out.withColumn(name, F.array(*parts)), stats)


def vary(anchors: DataFrame, n: int, key: str, numeric: Sequence[str], text: Mapping[str, Sequence[str]] | None = None, factors: Sequence[float] = (1.12, 0.88, 1.10)) -> DataFrame:
    """Rows proposed from anchors: each copies an anchor and changes one number, sometimes two, by a factor.

    Every anchor gets max(1, n // anchors) rows and n % anchors of them, by a hash of the
    key, one more.  A category is kept with 80 percent and otherwise switched.  Deterministic by key.
    """
    total = anchors.count()
    if total == 0:
        return anchors.withColumn("sample", F.lit(0))
    share, rest = max(1, n // total), n % total if n >= total else 0
    own = numbered(anchors, key, "one more", "__place") if rest else anchors.withColumn("__place", F.lit(total + 1))
    out = own.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(share) + (F.col("__place") <= rest).cast("int"))))
    seed = F.concat_ws("#", F.col(key).cast("string"), F.col("sample").cast("string"))
    first = F.floor(uniform(seed, "first") * len(numeric)).cast("int")
    second = F.when(uniform(seed, "two") < 0.5, F.floor(uniform(seed, "second") * len(numeric)).cast("int")).otherwise(-1)
    factor = lambda salt: F.element_at(F.array(*[F.lit(x) for x in factors]), F.floor(uniform(seed, salt) * len(factors)).cast("int") + 1)
    out = out.withColumns({"__first": first, "__second": second, "__f1": factor("f1"), "__f2": factor("f2"), "__seed": seed})
    changes = {c: F.when(F.col("__first") == i, F.col(c) * F.col("__f1")).when(F.col("__second") == i, F.col(c) * F.col("__f2")).otherwise(F.col(c)) for i, c in enumerate(numeric)}
    for c, values in (text or {}).items():
        pick = F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(uniform(F.col("__seed"), f"pick {c}") * len(values)).cast("int") + 1)
        changes[c] = F.when(uniform(F.col("__seed"), f"keep {c}") < 0.8, F.col(c)).otherwise(pick)
    return out.withColumns(changes).drop("__place", "__first", "__second", "__f1", "__f2", "__seed")


def needs_encoding(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that are not numbers yet."""
    kinds = dict(df.dtypes)
    return [c for c in columns if not (kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal"))]


def value_kinds(df: DataFrame, columns: Sequence[str], near: float = 0.5, few: int = 20) -> DataFrame:
    """(column, kind, low, high, n_unique): how a column's numbers are to be read.

    ``ordinal``: 2 to ``few`` values, not all within 0.01 of whole numbers, so scaled codes.
    ``continuous``: more values, mean within ``near`` of 0 and deviation within it of 1.
    Else ``categorical``.  A column without values is categorical with null bounds.
    """
    counts = value_counts(df, columns)
    x, n = F.col("x"), F.col("n")
    # Moments of counted values: one row per column from one aggregation.
    total = F.sum(n)
    mean = F.sum(x * n) / total
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum(x * x * n) - F.sum(x * n) * F.sum(x * n) / total, total - 1)))
    one = counts.groupBy("c").agg(
        mean.alias("mean"), spread.alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n_unique"), F.bool_or(F.abs(x - F.rint(x)) > 0.01).alias("scaled")
    )
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "c int, column string")
    kind = F.when(F.col("n_unique").between(2, few) & F.col("scaled"), "ordinal").when((F.col("n_unique") > few) & (F.abs("mean") < near) & (F.abs(F.col("sd") - 1) < near), "continuous").otherwise("categorical")
    return names.join(one, "c", "left").select("column", kind.alias("kind"), "low", "high", F.coalesce("n_unique", F.lit(0)).alias("n_unique"))  # a row per column


def levels(df: DataFrame, column: str) -> DataFrame:
    """(index, value): the distinct numbers of an ordinal column in order, numbered from 1."""
    values = value_counts(df, [column]).select(F.col("x").alias("value"))
    return values.select(F.row_number().over(Window.orderBy("value")).alias("index"), "value")  # one row per level


def ordinal_index(df: DataFrame, column: str, steps: DataFrame, name: str) -> DataFrame:
    """The number of the level nearest to a value, the lower one between two; null is the first."""
    all_steps = steps.agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("__steps"))  # one row per level
    gap = F.transform("__steps", lambda s: F.struct(F.abs(s["value"] - F.col(column)).alias("gap"), s["index"].alias("index")))
    found = F.when(F.col(column).isNull(), F.lit(1)).otherwise(F.array_min(gap)["index"])
    return df.crossJoin(F.broadcast(all_steps)).withColumn(name, found).drop("__steps")  # one row


def hashed_level(column: Column, values: Sequence) -> Column:
    """One of the values, by a hash of the column's text and nothing else; null gives what the first value's text does."""
    text = F.coalesce(column.cast("string"), F.lit(str(values[0])))
    at = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % len(values)
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def normalised(df: DataFrame, ranges: Mapping[str, tuple[float, float]], bounds: Mapping[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """Real values mapped to normalised bounds, and one row with how many of each column lay outside their range.

    Null and NaN become the middle of the range; what lies outside is drawn to its end
    first.  A range of no width gives 0.
    """
    mapped, outside = {}, []
    for c, (low, high) in ranges.items():
        x = F.col(c).cast("double")
        x = F.coalesce(F.when(~F.isnan(x), x), F.lit((low + high) / 2))
        outside.append(F.count(F.when((x < low) | (x > high), 1)).alias(c))
        a, b = bounds[c]
        mapped[c] = F.lit(0.0) if high == low else (F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)) - low) / (high - low) * (b - a) + a
    return df.withColumns(mapped), df.agg(*outside)

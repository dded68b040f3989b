"""Column-valued building blocks.  Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on nothing but the key and the salt."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|" + salt))), 1, 8), 16, 10).cast("bigint") / 4294967296.0


def canonical(column: Column, kind: str) -> Column:
    """A value's text: floats with six decimals and without a negative zero, null as NULL."""
    if kind in ("double", "float"):
        x = column.cast("double") + 0.0
        # A decimal's text is several times cheaper than a format; what it cannot say, NaN, infinities and 33 digits, is formatted.
        text = F.when(x.isNull(), F.lit(None)).when((x < 0) & (x > -5e-7), "-0.000000").otherwise(F.coalesce(x.try_cast("decimal(38,6)").cast("string"), F.format_string("%.6f", x)))
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def fingerprint(columns: Sequence[tuple[str, str]]) -> Column:
    """md5 of a row's canonical text, columns in the given order (name, type)."""
    return F.md5(F.concat_ws("|", *[canonical(F.col(c), k) for c, k in columns]))


def sorted_fingerprint(columns: Sequence[tuple[str, str]]) -> Column:
    """sha-256 of the row as key-sorted ``name=value`` pairs."""
    pairs = [F.concat(F.lit(c + "="), canonical(F.col(c), k)) for c, k in sorted(columns)]
    return F.sha2(F.concat_ws(",", *pairs), 256)


def category_code(column: Column, modulus: int = 10000) -> Column:
    """A stable number for a category."""
    return (F.conv(F.substring(F.md5(column.cast("string")), 1, 8), 16, 10).cast("bigint") % modulus).cast("double")


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max to [0, 1]; a constant column gives 0.5."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.5))


def euclidean(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b)]))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def plain_number(value: Column) -> Column:
    """Text of a number for prompts: none, one or two decimals by its size."""
    size = F.abs(value)
    return F.when(size >= 100, F.format_string("%.0f", value)).when(size >= 1, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value))


def severity(gap: Column) -> Column:
    """none, low, medium or high for a parity gap, by 0.05, 0.2 and 0.5."""
    return F.when(gap < 0.05, "none").when(gap < 0.2, "low").when(gap < 0.5, "medium").otherwise("high")


def size_category(n: Column) -> Column:
    return F.when(n < 500, "very_small").when(n < 5000, "small").when(n < 50000, "medium").otherwise("large")


def imbalance_category(ratio: Column) -> Column:
    return F.when(ratio < 3, "mild").when(ratio < 7, "moderate").otherwise("severe")


def complexity_category(features: Column) -> Column:
    return F.when(features < 10, "low").when(features <= 50, "medium").otherwise("high")


#: Name parts and the range that a feature of such a name usually has; the first match counts.
NAME_RANGES = (
    ("age", 18, 90), ("hour", 0, 100), ("income", 0, 500000), ("capital", 0, 100000), ("gain", 0, 100000), ("loss", 0, 100000),
    ("balance", -10000, 100000), ("amount", 0, 100000), ("credit", 0, 50000), ("duration", 0, 100), ("rate", 0, 100), ("weight", 0, 1000000),
    ("fnlwgt", 10000, 1500000), ("education", 0, 20), ("num", 0, 20), ("campaign", 0, 50), ("pdays", -1, 999), ("previous", 0, 50),
    ("emp", -5, 5), ("cons", -50, 100), ("euribor", 0, 10), ("nr", 4000, 6000),
)


def guessed_range(name: Column) -> tuple[Column, Column]:
    """(low, high) by the first known part of the name, case, hyphens and underscores aside; else 0 to 100."""
    lows, highs = F.lit(0.0), F.lit(100.0)
    plain = F.translate(F.lower(name), "-_", "")
    for part, low, high in reversed(NAME_RANGES):
        hit = F.contains(plain, F.lit(part))
        lows, highs = F.when(hit, float(low)).otherwise(lows), F.when(hit, float(high)).otherwise(highs)
    return lows, highs

"""Named datasets: a specification, the encoded frame it gives, and checks of what refers to it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transform
from ..operators.experiments import grid
from .results import load_config, read_csv


@dataclass(frozen=True)
class Spec:
    """Where a dataset lies and what its columns mean; ``positive`` is the target's value of class 1, or None for a 0/1 target."""

    path: str
    target: str
    key: str
    numeric: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    protected: tuple[str, ...] = ()
    positive: str | None = None


@dataclass(frozen=True)
class Dataset:
    """``frame`` has key, encoded features and y; ``stats`` and ``dimensions`` turn them back."""

    frame: DataFrame
    spec: Spec
    stats: DataFrame
    dimensions: Mapping[str, DataFrame] = field(default_factory=dict)

    @property
    def info(self) -> dict:
        s = self.spec
        return {"features": [*s.numeric, *s.text], "categorical": list(s.text), "numerical": list(s.numeric), "protected": list(s.protected), "target": s.target, "n_features": len(s.numeric) + len(s.text)}

    def decoded(self) -> DataFrame:
        """Numbers unscaled and codes as their categories again."""
        out = transform.unscale(self.frame, self.spec.numeric, self.stats) if self.spec.numeric else self.frame
        for c, d in self.dimensions.items():
            out = transform.label_decode(out, c, d, c)
        return out.select(*self.frame.columns)


def encode(df: DataFrame, spec: Spec) -> Dataset:
    """Missing numbers become the median and are scaled, categories become codes, the target 0/1."""
    out = transform.build_target(df, spec.target, spec.positive, name="__y")
    out = out.select(spec.key, *spec.numeric, *spec.text, F.col("__y").alias("y"))
    out = transform.impute(out, out, spec.numeric)
    stats = transform.moments(out, spec.numeric, ["mean", "sd0"]) if spec.numeric else out.sparkSession.range(1)
    dimensions = {c: transform.label_dimension(out, c) for c in spec.text}
    for c, d in dimensions.items():
        out = transform.label_encode(out, c, d, c)
    out = transform.zscore(out, spec.numeric, stats) if spec.numeric else out
    return Dataset(out.select(spec.key, *spec.numeric, *spec.text, "y"), spec, stats, dimensions)


def load(spark: SparkSession, name: str, specs: Mapping[str, Spec], root: str) -> Dataset:
    """The encoded dataset of that name, from Parquet or CSV below ``root``."""
    if name not in specs:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(specs))}")
    path = f"{root}/{specs[name].path}"
    return encode(read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path), specs[name])


def configs(folder: str | Path) -> list[str]:
    """Names of the YAML configurations in a folder, sorted."""
    return sorted(p.stem for p in Path(folder).glob("*.y*ml"))


def experiments(path: str | Path, datasets: Sequence[str], methods: Sequence[str]) -> list[tuple[str, str, int]]:
    """The grid of an experiment's configuration; datasets and methods that are not known, and no seeds, are errors.

    Methods come in named groups (``methods``) or as ``variants`` with a name each.
    """
    c = load_config(path, ("name", "datasets", "seeds"))
    names = [m for group in (c.get("methods") or {}).values() for m in group] or [v["name"] for v in c.get("variants") or []]
    if not names:
        raise ValueError(f"{path}: neither methods nor variants")
    unknown = [d for d in c["datasets"] if d not in datasets] + ([m for m in names if m not in methods] if c.get("methods") else [])
    if unknown:
        raise ValueError(f"{path}: unknown {', '.join(map(str, unknown))}")
    return grid(c["datasets"], names, c["seeds"])

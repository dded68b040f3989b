"""Leaf fairness by brute force, and over all rows of the query's table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import models
from evenkeel.plans import learning


def test_leaf_fairness_by_brute_force(spark):
    rows = [(t, float((i * (t + 3)) % 5), i * i % 3) for t in range(2) for i in range(60)]
    got = {(r.tree, r.leaf): (r.n, r.fairness) for r in models.leaf_fairness(spark.createDataFrame(rows, "tree int, leaf double, g int"), "g").collect()}
    want = {}
    for tree, leaf in {r[:2] for r in rows}:
        whole, own = (Counter(g for t, x, g in rows if t == tree and (every or x == leaf)) for every in (True, False))
        n, total = sum(own.values()), sum(whole.values())
        want[tree, leaf] = (n, pytest.approx(1 / (1 + sum(abs(whole[g] / total - own[g] / n) for g in whole))))
    assert got == want


def test_query_places_all_rows_in_the_reference_trees(spark, monkeypatch):
    rows = [(str(i), int(i % 9 == 0), float(i % 50), float(i * 7 % 100), i % 11 / 100, i % 9 / 100) for i in range(400)]
    t = spark.createDataFrame(rows, "row_id string, y int, quantity double, extendedprice double, discount double, tax double")
    seen = {}

    def leaves(df, columns, label="y", trees=10, depth=5):
        seen.update(rows=df.count(), trees=trees, depth=depth)
        return df.select("g", F.lit(0).alias("tree"), F.lit(0.0).alias("leaf"))

    monkeypatch.setattr(learning.V, "items", lambda spark, sf: t)
    monkeypatch.setattr(learning.models, "leaves", leaves)
    assert learning.ml_leaf_fairness(spark, None).first().n == 400
    assert seen == {"rows": 400, "trees": 100, "depth": 5}


def test_leaves_of_cells_are_those_of_rows(spark, monkeypatch):
    """The model is fitted on cells of equal bins, each with the weight of its rows, and no row is lost; it places them as one fitted on every row."""
    rows = [(i % 3, int(i * i % 17 < 5), float(i * i % 13), float(i % 7) + i % 3) for i in range(1500)] + [(0, 1, None, 1.0), (0, 1, float("nan"), 1.0)]
    t = spark.createDataFrame(rows, "g int, y int, a double, b double")
    seen, fit = [], models.GBTClassifier.fit

    def fitted(self, df):
        seen.append((df.count(), df.agg(F.sum("weight")).first()[0]))
        return fit(self, df)

    monkeypatch.setattr(models.GBTClassifier, "fit", fitted)
    got = {(r.tree, r.leaf): (r.n, r.fairness) for r in models.leaf_fairness(models.leaves(t, ["a", "b"], trees=4, depth=3), "g").collect()}
    assert seen == [(len({(r[1], r[2], r[3]) for r in rows[:1500]}), 1500.0)]
    monkeypatch.undo()
    whole = models.assemble(t, ["a", "b"])
    plain = models.GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, stepSize=0.1, seed=models.SEED).setLeafCol("leaves").fit(whole).transform(whole)
    plain = plain.select("g", F.posexplode(models.vector_to_array("leaves")).alias("tree", "leaf"))
    want = {(r.tree, r.leaf): (r.n, pytest.approx(r.fairness)) for r in models.leaf_fairness(plain, "g").collect()}
    assert got == want and len({k[0] for k in got}) == 4


def test_bins_come_from_all_values(spark):
    t = spark.range(6400).select(F.col("id").cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("few"), F.lit(None).cast("double").alias("none"))
    many, few, none = models.cut_points(t, ["x", "few", "none"])
    assert few == [0.0, 1.0, 2.0, 3.0, 4.0] and none == [] and len(many) == models.BINS - 1
    got = t.groupBy(models.bin_of(F.col("x"), many).alias("bin")).count().collect()
    assert sorted(r.bin for r in got) == [float(i) for i in range(models.BINS)] and {r["count"] for r in got} == {200}
    assert [r[0] for r in spark.createDataFrame([(-9.0,), (2.0,), (2.5,), (9.0,)], "v double").select(models.bin_of(F.col("v"), few)).collect()] == [0.0, 2.0, 3.0, 5.0]

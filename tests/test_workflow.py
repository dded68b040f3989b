"""The oversampling loop without limits goes on until the classes balance."""

import pytest
from pyspark.sql import functions as F

from evenkeel.operators.workflow import Oversampler, best
from evenkeel.plans import learning


def frame(spark, minority, majority):
    rows = [(i, int(i < minority), 10.0 + i % 97 + i / 1000, 5.0 + (i * 7) % 50) for i in range(minority + majority)]
    return spark.createDataFrame(rows, "row_id long, y int, a double, b double")


@pytest.mark.parametrize("minority, batch", [(40, 0), (4, 0), (40, 200)])
def test_no_limit_closes_the_gap(spark, minority, batch):
    df = frame(spark, minority, 1000)
    w = Oversampler(["a", "b"], batch=batch, anchors=20)
    new = w.fit_generate(df)
    assert new.count() == 1000 - minority == sum(h["selected"] for h in w.history)
    assert new.select("row_id").distinct().count() == new.select("a", "b").distinct().count() == 1000 - minority
    assert new.select("a", "b").join(df.where("y = 1"), ["a", "b"]).count() == 0


def test_no_limit_ends_on_a_stall(spark):
    df = frame(spark, 40, 100)
    nothing = lambda minority, n, step, heat: minority.select(F.col("row_id"), "a", "b")
    w = Oversampler(["a", "b"], proposer=nothing)
    assert w.fit_generate(df).count() == 0 and len(w.history) == w.stall_iterations


def test_registered_query_has_no_caps(spark, monkeypatch):
    df = frame(spark, 150, 2000).select(F.col("row_id").alias("doc_id"), "y", F.col("a").alias("n_chars"), F.repeat(F.lit("s"), F.col("b").cast("int")).alias("source"))
    monkeypatch.setattr(learning.V, "labelled", lambda spark, sf: df)
    assert learning.wf_oversample(spark, None).count() == 1850


def test_best_is_the_sorted_head(spark):
    df = spark.createDataFrame([(f"{i:03d}", (i * 37 % 11) / 11) for i in range(100)], "row_id string, fidelity double")
    for n in (1, 9, 10, 55, 100, 200):
        want = [r[0] for r in df.orderBy(F.desc(F.round("fidelity", 9)), "row_id").limit(n).collect()]
        assert sorted(want) == sorted(r[0] for r in best(df, n, "row_id").collect())

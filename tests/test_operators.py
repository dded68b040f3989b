"""Operators on literal frames with answers by hand, and properties that must hold."""

import math

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import columns as C
from evenkeel.functions import policies
from evenkeel.operators import dedup, evaluate, fairness, pairwise, profile, propose, select, stats, transform, validate
from evenkeel.operators.workflow import Oversampler
from evenkeel.sources import parsing, results


def test_mode_ties_and_constant_columns(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("a", 1.0), ("b", 1.0), ("c", 1.0)], "t string, x double")
    row = profile.text_columns(df, ["t"]).first()
    assert (row["mode"], row.mode_count, row.n_unique) == ("a", 2, 3)
    num = profile.numeric_columns(df, ["x"]).first()
    assert num.sd == 0 and num.skewness is None and num.kind == "ordinal"
    assert profile.correlations(df.withColumn("y", F.rand(1)), ["x", "y"]).first().r is None


def test_ordinal_words(spark):
    df = spark.createDataFrame([("low", "red"), ("high", "green"), ("medium", "blue")], "a string, b string")
    assert {r.column: r.is_ordinal for r in profile.text_columns(df, ["a", "b"]).collect()} == {"a": True, "b": False}


def test_exclusive_and_implied(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (2, None), (None, 2)], "a int, b int")
    assert profile.exclusive_pairs(df, ["a", "b"]).first().exclusive
    assert profile.implication_violations(df, "a IS NOT NULL", "b IS NULL").first().holds


def test_one_class_and_empty_frames(spark):
    one = spark.createDataFrame([(1, 1, 2.0)], "id long, y int, x double")
    row = profile.balance(one).first()
    assert row.imbalance_ratio is None and row.gap == 0
    none = one.where("false")
    assert profile.balance(none).first().n_rows == 0
    assert evaluate.roc_auc(one.select("y", F.col("x").alias("score"))).first().roc_auc is None
    assert validate.counters(none.withColumn("ok", F.lit(True)), ["ok"]).first().valid_rate == 0
    for gate in (validate.range_gate, validate.z_gate, validate.adaptive_gate):
        assert gate(none, one, ["x"]).count() == 0 and gate(one, one, ["x"]).count() == 1
    assert dedup.exact(none, one, ["x"], "id").count() == 0


def test_bad_numbers(spark):
    df = spark.createDataFrame([(1, "1.5"), (2, "x"), (3, None), (4, "NaN"), (5, "-0.0"), (6, "3.5")], "id int, x string")
    got = {r.id: r.x for r in transform.impute(df, df.where("id IN (1, 6)"), ["x"]).collect()}
    assert got == {1: 1.5, 2: 2.5, 3: 2.5, 4: 2.5, 5: 0.0, 6: 3.5}
    minus = spark.createDataFrame([(-0.0,), (0.0,)], "x double").select(C.fingerprint([("x", "double")]).alias("f")).distinct()
    assert minus.count() == 1


def test_gates_reject_nulls_as_defined(spark):
    train = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    df = spark.createDataFrame([(1, None), (2, 12.0), (3, 12.1), (4, 5.0)], "id int, x double")
    assert [r.id for r in validate.range_gate(df, train, ["x"]).where("in_range").orderBy("id").collect()] == [2, 4]
    assert [r.id for r in validate.adaptive_gate(df, train, ["x"]).where("inside").orderBy("id").collect()] == [1, 4]
    assert [r.id for r in validate.z_gate(df, train, ["x"], 2.0).where("z_ok").orderBy("id").collect()] == [4]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, score double")
    row = evaluate.roc_auc(df).first()
    assert row.roc_auc == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    twice = evaluate.roc_auc(df.withColumn("score", F.col("score") * F.col("score"))).first()
    assert twice.roc_auc == pytest.approx(row.roc_auc) and twice.pr_auc == pytest.approx(row.pr_auc)


def test_rank_statistics_by_hand(spark):
    order = [[1, 2, 3, 4, 5]] * 4 + [[2, 1, 3, 4, 5]] * 4
    df = spark.createDataFrame([(f"d{i}", f"m{m}", float(-r)) for i, row in enumerate(order) for m, r in enumerate(row)], "dataset string, method string, metric double")
    ranks = {r.method: r.mean_rank for r in stats.mean_ranks(df, ["dataset"], "method", "metric").collect()}
    assert ranks == {"m0": 1.5, "m1": 1.5, "m2": 3.0, "m3": 4.0, "m4": 5.0} and sum(ranks.values()) == 15
    f = stats.friedman(df, ["dataset"], "method", "metric").first()
    want = 12 / (8 * 5 * 6) * sum((8 * r) ** 2 for r in ranks.values()) - 3 * 8 * 6
    assert f.statistic == pytest.approx(want) and f.p_value == pytest.approx(policies.chi2_sf(want, 4))
    w = {r.method: r.p_value for r in stats.wilcoxon(stats.paired(df, ["dataset"], "method", "metric", "m0"), "method").collect()}
    assert w["m4"] == pytest.approx(2 / 256)
    adjusted = stats.holm(spark.createDataFrame([(x,) for x in (0.01, 0.04, 0.03, 0.005)], "p_value double")).collect()
    assert sorted(round(r.p_holm, 6) for r in adjusted) == [0.02, 0.03, 0.06, 0.06]
    assert all(r.p_holm >= r.p_value for r in adjusted)
    assert stats.critical_difference(stats.mean_ranks(df, ["dataset"], "method", "metric")).first().cd == pytest.approx(2.728 * math.sqrt(30 / 48))


def test_published_cross_checks():
    assert policies.chi2_sf(15.5, 4) == pytest.approx(0.00377, abs=1e-5)
    assert policies.critical_difference(5, 8) == pytest.approx(2.157, abs=1e-3)
    assert policies.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4) and policies.chi2_sf(7.815, 3) == pytest.approx(0.05, abs=1e-4)


def test_greedy_keeps_first_in_chains(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.9), (3, 1.8), (4, 5.0), (5, 1.8)], "id long, x double")
    assert [r.id for r in dedup.spread_out(df, ["x"], 1.0).orderBy("id").collect()] == [1, 3, 4]
    known = spark.createDataFrame([(9, 5.1)], "id long, x double")
    assert [r.id for r in dedup.anti_similar(df, known, ["x"], 1.0).orderBy("id").collect()] == [1, 3]


def test_greedy_matches_brute_force(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, rnd.random(), rnd.random()) for i in range(200)]
    kept = []
    for r in rows:
        if all(math.dist(r[1:], k[1:]) >= 0.1 for k in kept):
            kept.append(r)
    got = dedup.spread_out(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"], 0.1)
    assert sorted(r.id for r in got.collect()) == [k[0] for k in kept]


def test_skyline(spark):
    rows = [(1, 1.0, 2.0), (2, 2.0, 1.0), (3, 1.0, 1.0), (4, 2.0, 1.0), (5, None, 9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    assert sorted(r.id for r in select.pareto(df, ["a", "b"]).collect()) == [1, 2, 4]


def test_gower_is_a_bounded_distance(spark):
    import numpy as np

    v = np.array([[0.0, 1.0, 3.0], [1.0, 0.5, 3.0], [0.2, np.nan, 4.0]])
    d = pairwise.distances("gower", v, v, categories=1)
    assert (d[:2, :2] == d[:2, :2].T).all() and d[0, 0] == 0 and d.max() <= 1 and d[2, 2] == pytest.approx(1 / 3)


def test_neighbours_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "ROWS", 16)
    rows = [(i, [float(i % 10), float(i // 10)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = pairwise.neighbours(df, df, 3, exclude_self=True).where("id = 0").orderBy("place").collect()
    assert [(r.neighbour, r.distance) for r in got] == [(1, 1.0), (10, 1.0), (11, pytest.approx(math.sqrt(2)))]


def test_split_is_a_partition(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    a = transform.stratified_split(df, "id")
    assert a.count() == 500 and a.select("id").distinct().count() == 500
    n = {(r.y, r.split): r["count"] for r in a.groupBy("y", "split").count().collect()}
    assert n == {(0, "train"): 240, (0, "val"): 80, (0, "test"): 80, (1, "train"): 60, (1, "val"): 20, (1, "test"): 20}
    assert {tuple(r) for r in transform.stratified_split(df.repartition(7), "id").collect()} == {tuple(r) for r in a.collect()}


def test_samples_add_up(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i)], float(i)) for i in range(7)], "id long, v array<double>, x double")
    assert propose.smote(df.select("id", "v"), 17).count() == 17 and propose.smote(df.select("id", "v"), 3).count() == 3
    assert transform.vary(df, 17, "id", ["x"]).count() == 17
    assert sorted(r.k for r in transform.numbered(df, "id", "s", "k").collect()) == list(range(1, 8))


def test_strata_with_ties(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 1, 1, 1, 2, 3, 4, 5, 6, 7])], "id long, x double")
    assert [r.stratum for r in propose.strata(df, "x").orderBy("id").collect()] == [0, 0, 0, 0, 2, 2, 3, 3, 4, 4]


def test_parsers(spark):
    text = "```csv\na,b\n1,x\nbroken\n2.5,\"y\"\n```"
    got = parsing.parse_csv_text(spark.createDataFrame([(text,)], "t string"), "t", {"a": "double", "b": "string"}).orderBy("line_no").collect()
    assert [(r.line_no, r.a, r.b) for r in got] == [(2, 1.0, "x"), (4, 2.5, "y")]
    got = parsing.parse_json(spark.createDataFrame([('{"k": 1}',), ("{oops",), (None,)], "j string"), "j", "k int").collect()
    assert [(r.k, r.ok) for r in got] == [(1, True), (None, False), (None, False)]


def test_results_and_manifest(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"dataset": "d", "method": "m", "seed": 1, "success": true, "performance_metrics": {"rf": {"f1": 0.5}, "lr": {"f1": 0.25, "roc_auc": 0.75}}}')
    (tmp_path / "s.json").write_text('{"dataset": "d", "method": "m", "seed": 2, "success": false}')
    got = {r.classifier: (r.f1, r.roc_auc) for r in results.read_results(spark, str(tmp_path)).collect()}
    assert got == {"rf": (0.5, None), "lr": (0.25, 0.75)}
    assert results.manifest(spark, str(tmp_path)).count() == 2
    (tmp_path / "c.yaml").write_text("name: x\n")
    assert results.load_config(tmp_path / "c.yaml") == {"name": "x"}
    with pytest.raises(ValueError):
        results.load_config(tmp_path / "c.yaml", ("target",))


def test_label_codes(spark):
    df = spark.createDataFrame([("b",), (" a ",), (None,)], "t string")
    d = transform.label_dimension(df, "t")
    assert [(r.value, r.code) for r in d.orderBy("code").collect()] == [("a", 0), ("b", 1), ("missing", 2)]
    coded = transform.label_encode(spark.createDataFrame([("b",), ("zz",), (None,)], "t string"), "t", d)
    assert sorted(r.t_code for r in coded.collect()) == [0, 0, 1]


def test_fair_targets(spark):
    rows = [(1, "f")] * 1 + [(1, "m")] * 9 + [(0, "f")] * 50 + [(0, "m")] * 50
    dist = fairness.group_distributions(spark.createDataFrame(rows, "y int, sex string"), ["sex"])
    got = fairness.targets(dist).collect()
    assert [(r.group, r.n_target, r.severity, r.priority) for r in got] == [("f", 8, "medium", 2)]


def test_policies():
    assert policies.temperature(0, 10) == 1.0 and policies.temperature(9, 10) == pytest.approx(0.7)
    assert 5 <= policies.batch_size(30, 1000) <= 50
    assert policies.converged([0.1, 0.001, 0.001, 0.002], False) == "no progress" and policies.converged([0.1], True) is None
    assert policies.hosted_budget(100, 20) >= 5 and policies.few_shot_count(50) == 10
    assert policies.iteration_budget(1000, 0.12, 20, 0.5).capped


def test_workflow_reaches_the_gap_or_stalls(spark, tmp_path):
    rows = [(i, int(i < 30), float(i % 30) + i / 100, float((i * 7) % 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double")
    w = Oversampler(["a", "b"], batch=60, max_iterations=4, output=str(tmp_path / "out"))
    new = w.fit_generate(df)
    n = new.count()
    assert 0 < n <= 40 and new.select("row_id").distinct().count() == n
    lows = df.where("y = 1").agg(F.min("a"), F.max("a")).first()
    assert new.where((F.col("a") < lows[0]) | (F.col("a") > lows[1])).count() == 0
    assert sum(h["selected"] for h in w.history) == n
    again = Oversampler(["a", "b"], batch=60, max_iterations=0, output=str(tmp_path / "out"))
    assert again.fit_generate(df).count() == n  # what was selected is read back
    with pytest.raises(ValueError):
        w.fit_generate(df.where("y = 1"))


def test_distance_scores_stay_apart_from_the_diversity_of_a_table(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 4.0), (3, 9.0)], "id long, d double")
    got = df.select("id", select.distance_score(F.col("d")).alias("s")).orderBy("id").collect()
    assert [round(r.s, 9) for r in got] == [0.2, 0.9, 1.0]


def test_copies_and_crowded_cells_make_no_pairs(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    points = [(rnd.random(), rnd.random()) for _ in range(120)]
    rows = [(f"{rnd.random():.12f}", *p) for p in points for _ in range(20)] + [("n1", None, 0.5), ("n2", float("nan"), 0.5), ("n3", float("inf"), 0.5), ("n4", float("inf"), 0.5)]
    known = [(f"k{i}", rnd.random(), rnd.random()) for i in range(9)] * 3
    near = lambda a, b: math.dist(a[1:], b[1:]) < 0.1
    a, b = (spark.createDataFrame(x, "id string, x double, y double") for x in (rows, known))

    def never(*args, **kwargs):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(pairwise, "near", never)
    got = lambda df: sorted(r.id for r in df.collect())
    loose = ["n1", "n2", "n3", "n4"]
    assert got(dedup.spread_out(a, ["x", "y"], 0.1)) == sorted(_first(rows[:-4], near) + loose)
    apart = [r for r in rows[:-4] if not any(near(r, k) for k in known)]
    assert got(dedup.far_from(a, b, ["x", "y"], 0.1)) == sorted([r[0] for r in apart] + loose)
    assert got(dedup.anti_similar(a, b, ["x", "y"], 0.1)) == sorted(_first(apart, near) + loose)
    for local in (0, 5):
        assert got(pairwise.spaced(pairwise.first_of_each(a, ["x", "y"]), ["x", "y"], 0.1, local=local)) == sorted(_first(rows[:-4], near))


def _first(rows, near):
    kept = []
    for r in sorted(rows):
        if not any(near(r, k) for k in kept):
            kept.append(r)
    return [r[0] for r in kept]


@pytest.mark.parametrize("rows", [1024, 16])
def test_mean_and_least_distances_by_brute_force(spark, rows):
    import random

    rnd = random.Random(6)
    points = [(rnd.random(), float(rnd.randrange(4))) for _ in range(90)]
    frame = lambda x: spark.createDataFrame([(i, list(p)) for i, p in enumerate(x)], "id long, v array<double>")
    flat = lambda x: spark.createDataFrame([(i, *p) for i, p in enumerate(x)], "id long, x double, y double")
    pairs = [(p, q) for i, p in enumerate(points + points[:7]) for q in (points + points[:7])[:i]]
    assert pairwise.mean_pairwise(frame(points + points[:7])).first()[0] == pytest.approx(sum(math.dist(*x) for x in pairs) / len(pairs))
    gaps = [(None, 1.0), (0.4, float("nan")), (float("nan"), None), *points]
    bad = lambda x: x is None or math.isnan(x)
    gower = lambda p, q: ((1 if bad(p[0]) or bad(q[0]) else abs(p[0] - q[0])) + (1 if bad(p[1]) or bad(q[1]) else p[1] != q[1])) / 2
    pairs = [(p, q) for i, p in enumerate(gaps) for q in gaps[:i]]
    assert pairwise.mean_pairwise(frame(gaps), "gower", categories=1).first()[0] == pytest.approx(sum(gower(*x) for x in pairs) / len(pairs))
    least = min(math.dist(p, q) for i, p in enumerate(points) for q in points[:i])
    assert pairwise.least_distance(flat(points), ["x", "y"], rows).first()[0] == pytest.approx(least)
    assert pairwise.least_distance(flat(points + points[:1]), ["x", "y"], rows).first()[0] == 0.0
    assert pairwise.least_distance(flat(points[:1] + [(None, 1.0)]), ["x", "y"], rows).first()[0] is None

"""Operators that once refused large inputs, and statistics from counted values, against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import models, pairwise, profile, propose, quantiles, select, stats, transform


def test_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(1)
    data = {"a": rnd.normal(size=500), "b": rnd.integers(0, 4, 500).astype(float), "c": np.concatenate([rnd.normal(size=499), [1e9]]), "d": np.full(500, 7.0), "e": np.full(500, np.nan)}
    rows = [(*(float(v) for v in r),) for r in zip(*data.values())] + [(None,) * 5, (float("inf"), None, float("-inf"), None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    at = [0, 0.1, 0.25, 0.5, 0.77, 1]
    got = quantiles.quantile_row(df, list(data), at).first()
    for c in "abcd":
        assert np.allclose(got[c], np.quantile(data[c], at), rtol=1e-12)
    assert got["e"] is None
    col = {r.column: r for r in profile.numeric_columns(df, list(data)).collect()}
    assert [col[c].n_unique for c in "abcde"] == [500, len(set(data["b"])), 500, 1, 0] and col["e"].q1 is None and col["a"].n_null == 2
    assert [r["count"] for r in profile.describe(df, ["a", "e"]).orderBy("column").collect()] == [500, 0]
    assert tuple(profile.feature_kinds(df.withColumn("t", F.lit("x")), ["a", "b", "d", "t"]).first()) == (3, 1)
    assert quantiles.quantile_row(df.where("false"), ["a"], at).first()["a"] is None


def test_ordinal_needs_all_words_of_a_set(spark):
    df = spark.createDataFrame([("Low", "low", "none"), ("High", "high", "some"), ("medium", "x", "many"), ("unknown", "y", None)], "a string, b string, c string")
    assert {r.column: r.is_ordinal for r in profile.text_columns(df, ["a", "b", "c"]).collect()} == {"a": True, "b": False, "c": True}


def test_statistics_leave_other_columns_alone(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 6.0)], "x double, my__col double")
    got = transform.zscore(df, ["x"], transform.moments(df, ["x"])).orderBy("x")
    assert got.columns == ["x", "my__col"] and [tuple(r) for r in got.collect()] == [(-1.0, 5.0), (1.0, 6.0)]
    with pytest.raises(ValueError):
        transform.zscore(df.withColumn("x__mean", F.lit(0)), ["x"], transform.moments(df, ["x"]))


@pytest.mark.parametrize("n, decimals", [(12, 6), (18, 6), (18, 0)])
def test_wilcoxon_counts_every_sign_pattern(spark, n, decimals):
    rnd = random.Random(n)
    diffs = [round(rnd.uniform(-4, 6), decimals) for _ in range(n)] + [0.0]
    got = stats.wilcoxon(spark.createDataFrame([("m", d) for d in diffs], "method string, diff double"), "method").first()
    own = [d for d in diffs if d]
    size = sorted(abs(d) for d in own)
    rank = {s: (size.index(s) + 1 + size.index(s) + size.count(s)) / 2 for s in size}
    w = sum(rank[abs(d)] for d in own if d > 0)
    sums = np.zeros(1)
    for d in own:
        sums = np.concatenate([sums, sums + rank[abs(d)]])
    assert got.n == len(own) and got.statistic == w
    assert got.p_value == pytest.approx(min(1, 2 * min((sums <= w + 1e-9).mean(), (sums >= w - 1e-9).mean())), abs=1e-9)


def test_wilcoxon_of_many_differences_leaves_no_group_out(spark):
    rnd = random.Random(3)
    diffs = [round(rnd.gauss(0.1, 1), 2) for _ in range(150)]
    df = spark.createDataFrame([("m", d) for d in diffs], "method string, diff double")
    exact, normal = (stats.wilcoxon(df, "method", most=m).first().p_value for m in (200, 100))
    assert normal == pytest.approx(exact, abs=0.01)


def test_friedman_of_an_even_number_of_methods(spark):
    values = [(7.0, 9.9, 8.5, 5.1), (5.3, 5.7, 4.7, 3.5), (4.9, 7.6, 5.5, 2.8), (8.8, 8.9, 8.1, 3.3)]
    df = spark.createDataFrame([(b, m, v) for b, row in enumerate(values) for m, v in enumerate(row)], "block int, method int, value double")
    row = stats.friedman(df, ["block"], "method", "value").first()
    ranks = [sum(sorted(r, reverse=True).index(r[m]) + 1 for r in values) for m in range(4)]
    x = 12 / (4 * 4 * 5) * sum(s * s for s in ranks) - 3 * 4 * 5
    tail = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)  # three degrees of freedom
    assert row.statistic == pytest.approx(x) and row.dof == 3 and row.p_value == pytest.approx(tail)


def test_greedy_does_not_end_undecided(spark):
    df = spark.createDataFrame([(i,) for i in range(8)], "id long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(7)], "id long, other long")
    assert [r.id for r in pairwise.greedy(df, pairs).orderBy("id").collect()] == [0, 2, 4, 6]
    with pytest.raises(RuntimeError):
        pairwise.greedy(df, pairs, max_rounds=2)


@pytest.mark.parametrize("ahead", [4096, 3])
def test_prune_matches_brute_force(spark, ahead):
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(40, 6)) + np.repeat(rnd.normal(size=(4, 6)) * 2, 10, axis=0)
    v[7] = v[3]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    alive = list(range(40))
    while len(alive) > 12:
        sums = np.round(unit[alive] @ unit[alive].sum(axis=0), 9)
        del alive[int(np.argmax(sums))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    assert sorted(r.id for r in propose.prune_redundant(df, 12, ahead).collect()) == alive


def test_matched_distribution_by_brute_force(spark):
    rnd = random.Random(8)
    train = [(rnd.gauss(0, 1), rnd.gauss(0, 2), 3.0) for _ in range(200)]
    batch = [(i, rnd.gauss(0, 1) + (9 if i % 3 == 0 else 0), rnd.gauss(0, 2) + (30 if i % 5 == 0 else 0), 1.0) for i in range(90)] + [(90, None, 4.0, 1.0)]
    left = list(batch)
    for k in (1, 2):
        mean, sd = np.mean([t[k - 1] for t in train]), np.std([t[k - 1] for t in train], ddof=1)
        off = lambda: abs(np.mean([r[k] for r in left if r[k] is not None]) - mean) / sd  # noqa: B023, E731
        while off() > 1 and len(left) > 45:
            left.remove(max((r for r in left if r[k] is not None), key=lambda r: (abs(r[k] - mean), -r[0])))  # noqa: B023
    df = spark.createDataFrame(batch, "id long, a double, b double, c double").repartition(4)
    got = propose.match_distribution(df, spark.createDataFrame(train, "a double, b double, c double"), ["a", "b", "c"], buckets=16)
    assert sorted(r.id for r in got.collect()) == [r[0] for r in left] and len(left) < 91


def test_dpp_matches_brute_force(spark):
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(25, 2))
    kernel = np.exp(-((v[:, None] - v[None]) ** 2).sum(axis=2) / 0.5)
    chosen = []
    for _ in range(6):
        dets = [round(np.linalg.det(kernel[np.ix_(chosen + [i], chosen + [i])]) / (np.linalg.det(kernel[np.ix_(chosen, chosen)]) if chosen else 1), 9) if i not in chosen else -1 for i in range(25)]
        chosen.append(int(np.argmax(dets)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    assert [r.id for r in select.dpp(df, 6).orderBy("place").collect()] == chosen
    assert select.dpp(df.where("false"), 3).count() == 0


def test_dimensions_and_thresholds(spark):
    rnd = np.random.default_rng(7)
    v = rnd.normal(size=(300, 5)) * [5, 4, 0.1, 0.1, 0.1]
    df = spark.createDataFrame([(i, int(i < 60), x.tolist()) for i, x in enumerate(v)], "id long, y int, v array<double>")
    held = np.cumsum(np.linalg.eigvalsh(np.cov(v.T, bias=True))[::-1])
    assert models.dimensions(df) == (int(np.searchsorted(held / held[-1], 0.95)) + 1, 5)
    row = models.similarity_threshold(df)
    z = ((v - v.mean(axis=0)) / v.std(axis=0))[:60]
    d = np.sort(np.linalg.norm(z[:, None] - z[None], axis=2), axis=1)[:, 5].mean()
    scaled = np.cumsum(np.linalg.eigvalsh(np.corrcoef(v.T))[::-1])
    dim = int(np.searchsorted(scaled / scaled[-1], 0.95)) + 1
    want = 0.80 + 0.02 * math.log10(300) + 0.05 * (1 - dim / 5) - 0.05 * 0.4 + 0.05 / (1 + d)
    assert row.first().threshold == pytest.approx(want, abs=1e-6) and row.first().ratio == 4
    assert models.mean_leaf_fairness(spark.createDataFrame([(0.5,), (1.0,)], "fairness double")).first().mean_fairness == 0.75


def test_central_rows_are_the_closest_to_their_centres(spark):
    rnd = np.random.default_rng(2)
    centres = np.array([[0, 0], [20, 0], [0, 20]])
    v = np.concatenate([c + rnd.normal(size=(30, 2)) for c in centres])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    want = {30 * k + int(np.argmin(np.linalg.norm(v[30 * k : 30 * k + 30] - v[30 * k : 30 * k + 30].mean(axis=0), axis=1))) for k in range(3)}
    assert {r.id for r in models.central(df, 3).collect()} == want


def test_discriminative_rows_are_minority_rows_far_from_the_majority(spark):
    rows = [(i, 1, 10.0 + i % 5) for i in range(20)] + [(100 + i, 1, 0.5) for i in range(5)] + [(200 + i, 0, i % 4 * 0.3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, x double")
    assert all(r.id < 20 for r in models.discriminative(df, ["x"], 5, "id").collect())


def test_classifiers_learn_what_can_be_learnt(spark):
    rnd = random.Random(1)
    rows = [(int(a + b > 1), a, b) for a, b in ((rnd.random(), rnd.random()) for _ in range(400))]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    got = {r.classifier: r for r in models.compare_classifiers(df.limit(300), df, ["a", "b"]).collect()}
    assert len(got) == 3 and all(r.accuracy > 0.85 and r.roc_auc > 0.9 and r.tp + r.fp + r.tn + r.fn == 400 for r in got.values())


def test_leaf_resample_draws_from_fair_leaves(spark):
    rows = [(leaf, g, float(leaf * 100 + i)) for leaf in range(3) for i in range(40) for g in ([i % 2] if leaf else [0])]
    df = spark.createDataFrame(rows, "leaf int, g int, x double")
    got = propose.leaf_resample(df, "leaf", ["x"], 600, group="g").collect()
    n = [sum(r.leaf == k for r in got) for k in range(3)]
    assert sum(n) == 600 and n[0] < n[1] and n[0] < n[2]  # leaf 0 holds one group only


def test_regions_by_hand(spark):
    rnd = np.random.default_rng(3)
    v = np.concatenate([rnd.normal(size=(40, 2)), [50, 0] + 5 * rnd.normal(size=(40, 2))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = models.regions(df, 2).collect()
    assert len(got) == 2
    spread = sorted(got, key=lambda r: r.density)
    assert spread[0].density < spread[1].density and all(0 < r.density < 1 for r in got)
    assert models.diversity_targets(models.regions(df, 2), 10).count() >= 1


def test_prune_takes_few_passes_over_rows_alike(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    v = np.array([1.0, 0.5, 0.0, 0.0, 0.2]) + rnd.normal(size=(400, 5)) * 0.4
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    alive = list(range(400))
    while len(alive) > 12:
        sums = np.round(unit[alive] @ unit[alive].sum(axis=0), 9)
        del alive[int(np.argmax(sums))]
    passes, cut = [], propose.checkpoint
    monkeypatch.setattr(propose, "checkpoint", lambda df: passes.append(1) or cut(df))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    assert sorted(r.id for r in propose.prune_redundant(df, 12, 200).collect()) == alive
    assert len(passes) <= 15


def test_reach_of_the_rows_not_brought_is_sound_and_close():
    rnd = np.random.default_rng(9)
    for _ in range(50):
        rows = rnd.normal(size=(300, 4)) * 0.4 + 1
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        first, scores = rows.sum(axis=0), rows @ rows.sum(axis=0)
        order = np.argsort(-scores)
        rest, gone = order[100:], order[:60]
        now = first - rows[gone].sum(axis=0)
        most = propose._reach(first, float(np.linalg.norm(first)), now, float(scores[rest].max()))
        assert (rows[rest] @ now).max() <= most + 1e-9
        assert most < scores[rest].max() - 30  # counting 1 for each drop would say 60 more instead

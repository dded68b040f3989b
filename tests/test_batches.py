"""Batches with resume, named datasets, reports, artifacts, few-shot choices, mappings, sets and the remote client."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions import policies
from evenkeel.functions.columns import canonical
from evenkeel.operators import dedup, experiments, fairness, memory, models, profile, propose, select, transform
from evenkeel.operators.workflow import Oversampler
from evenkeel.sources import catalog, remote, results


def test_batch_runs_records_and_resumes(spark, tmp_path):
    asked = []

    def run(dataset, method, seed):
        asked.append((dataset, method, seed))
        if method == "bad" and len(asked) < 9:
            raise ValueError("no rows")
        return {"n_generated": seed, "performance_metrics": {"forest": {"f1": 0.5, "roc_auc": 0.75, "balanced_accuracy": 0.5}}}

    out = str(tmp_path / "runs")
    first = experiments.run_batch(spark, ["a", "b", "a"], ["good", "bad"], [1, 2], run, out)
    assert (first["total"], first["completed"], first["failed"], first["skipped"]) == (8, 4, 4, 0) and len(asked) == 8
    assert results.read_results(spark, out).count() == 4
    again = experiments.run_batch(spark, ["a", "b"], ["good", "bad"], [1, 2], run, out)
    assert (again["completed"], again["failed"], again["skipped"]) == (4, 0, 4)
    assert {a[1] for a in asked[8:]} == {"bad"}
    assert experiments.run_batch(spark, ["a", "b"], ["good", "bad"], [1, 2], run, out)["skipped"] == 8
    assert json.loads((tmp_path / "runs" / "_batch_summary.json").read_text())["skipped"] == 8
    with pytest.raises(ValueError):
        experiments.grid(["a"], ["m"], [])


def test_catalog_encodes_and_decodes(spark, tmp_path):
    rows = [(1, 1.0, "u", "yes"), (2, None, " v", "no"), (3, 3.0, None, None), (4, 5.0, "u", "yes")]
    spark.createDataFrame(rows, "k int, x double, c string, t string").coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    specs = {"d": catalog.Spec("d.parquet", "t", "k", ("x",), ("c",), ("c",), "yes")}
    d = catalog.load(spark, "d", specs, str(tmp_path))
    got = {r.k: r for r in d.frame.collect()}
    x = np.array([1.0, 3.0, 3.0, 5.0])
    assert np.allclose([got[k].x for k in (1, 2, 3, 4)], (x - x.mean()) / x.std())
    assert [got[k].c for k in (1, 2, 3, 4)] == [1, 2, 0, 1] and [got[k].y for k in (1, 2, 3, 4)] == [1, 0, 0, 1]
    back = {r.k: (round(r.x, 9), r.c) for r in d.decoded().collect()}
    assert back == {1: (1.0, "u"), 2: (3.0, "v"), 3: (3.0, "missing"), 4: (5.0, "u")}
    assert d.info["n_features"] == 2 and d.info["categorical"] == ["c"]
    with pytest.raises(ValueError):
        catalog.load(spark, "e", specs, str(tmp_path))


def test_experiment_configs(tmp_path):
    (tmp_path / "m.yaml").write_text("name: m\ndatasets: [a, b]\nseeds: [1, 2]\nmethods: {base: [s], own: [q, s]}\n")
    (tmp_path / "v.yml").write_text("name: v\ndatasets: [a]\nseeds: [1]\nvariants: [{name: full}, {name: less}]\n")
    assert catalog.configs(tmp_path) == ["m", "v"]
    assert len(catalog.experiments(tmp_path / "m.yaml", ["a", "b"], ["s", "q"])) == 8
    assert catalog.experiments(tmp_path / "v.yml", ["a"], []) == [("a", "full", 1), ("a", "less", 1)]
    with pytest.raises(ValueError, match="b, q"):
        catalog.experiments(tmp_path / "m.yaml", ["a"], ["s"])


def test_reports(spark, tmp_path):
    df = spark.range(5).select("id", F.lit("x").alias("s"))
    results.write_report(df, str(tmp_path / "r"), "t")
    assert results.read_csv(spark, str(tmp_path / "r" / "t.csv")).count() == 5
    assert spark.read.json(str(tmp_path / "r" / "t.json")).count() == 5
    assert json.loads((tmp_path / "r" / "environment.json").read_text())["spark"] == spark.version
    assert results.markdown(df, 2).endswith("(only the first 2 rows)") and "only" not in results.markdown(df, 5)


def test_artifacts_and_resume(spark, tmp_path):
    rows = [(i, int(i < 30), 10.0 + i % 97 + i / 1000, 5.0 + (i * 7) % 50) for i in range(230)]
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double")
    place = tmp_path / "art"
    first = Oversampler(["a", "b"], batch=60, anchors=20, max_iterations=1, output=str(tmp_path / "out"), artifacts=str(place))
    had = {r.row_id for r in first.fit_generate(df).collect()}
    assert spark.read.parquet(str(place / "resampled")).count() == 230 + len(had)
    assert spark.read.parquet(str(place / "validated")).count() >= len(had) > 0
    assert json.loads((place / "progress.json").read_text())["selected"] == len(had)
    whole = Oversampler(["a", "b"], batch=60, anchors=20, output=str(tmp_path / "out")).fit_generate(df)
    assert whole.count() == 170 == whole.select("a", "b").distinct().count()
    assert had <= {r.row_id for r in whole.collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 170


def test_few_shot(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(z)) for i, (x, z) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    far = sorted(rows, key=lambda r: -np.hypot(r[1] - np.mean([s[1] for s in rows]), r[2] - np.mean([s[2] for s in rows])))
    for i, band in ((1, far[40:100]), (4, far[:60])):
        got = {r.id for r in propose.few_shot(df, ["a", "b"], 9, "id", i).collect()}
        assert len(got) == 9 and got <= {r[0] for r in band}
    cut = np.quantile([r[2] for r in rows], [0.33, 0.67])
    got = [r.b for r in propose.few_shot(df, ["a", "b"], 8, "id", 5).collect()]
    assert [sum(x <= cut[0] for x in got), sum(cut[0] < x <= cut[1] for x in got), sum(x > cut[1] for x in got)] == [3, 3, 2]
    assert 1 <= propose.few_shot(df, ["a", "b"], 6, "id", 0).count() <= 6
    assert propose.few_shot(df.limit(3), ["a"], 6, "id", 1).count() == 3
    same = df.withColumn("a", F.lit(1.0))  # one tercile only: it fills the rest
    assert propose.spread(same, ["a"], 7, "id", 0).count() == 7
    with pytest.raises(ValueError):
        propose.few_shot(df, ["a"], 6, "id", 0, "none")


def test_diverse_and_representatives(spark):
    rows = [(i, [float(10 * (i % 8)), float(i // 8) / 10]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    first = models.diverse(df, 4, 0)
    assert first.count() == 4
    held = df.where("id % 8 < 2")
    again = {r.id for r in models.diverse(df, 2, 1, held).collect()}
    assert len(again) == 2 and all(i % 8 >= 4 for i in again)
    assert models.diverse(df.limit(3), 4).count() == 3
    assert models.representatives(df, 8).count() <= 8 and models.representatives(df, 80).count() == 80


def test_leaf_resample_draws_every_row_once_asked(spark):
    rows = [(i % 3 if i % 2 else 0, float(i % 50), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "leaf int, x double, g int")
    out = propose.leaf_resample(df, "leaf", ["x"], 3000, group="g")
    assert out.count() == 3000 == out.select("draw").distinct().count()
    share = {r.leaf: r["count"] / 3000 for r in out.groupBy("leaf").count().collect()}
    own = {k: [r[2] for r in rows if r[0] == k] for k in (0, 1, 2)}
    fair = {k: 1 / (1 + 2 * abs(np.mean(v) - 0.5)) for k, v in own.items()}
    want = {k: 0.5 * f / sum(fair.values()) + 0.5 / 3 for k, f in fair.items()}
    assert all(abs(share[k] - want[k]) < 0.04 for k in want)
    numbers = propose._numbered_in(df, "leaf", ["x"], "p").groupBy("leaf").agg(F.count_distinct("p").alias("d"), F.max("p").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.d == r.m == r.n for r in numbers)


def test_value_mappings(spark):
    df = spark.createDataFrame([(0, 5.0), (1, -3.0), (2, 99.0), (3, None), (4, float("nan"))], "k int, x double")
    mapped, outside = transform.normalised(df, {"x": (0.0, 10.0)}, {"x": (-2.0, 2.0)})
    assert [r.x for r in mapped.orderBy("k").collect()] == [0.0, -2.0, 2.0, 0.0, 0.0] and outside.first().x == 2
    steps = transform.levels(spark.createDataFrame([(-1.2,), (0.3,), (0.3,), (1.9,)], "z double"), "z")
    got = transform.ordinal_index(spark.createDataFrame([(0, -5.0), (1, 0.4), (2, 1.0), (3, None)], "k int, z double"), "z", steps, "i")
    assert [r.i for r in got.orderBy("k").collect()] == [1, 2, 2, 1]
    values = spark.range(200).select(transform.hashed_level(F.col("id"), ["p", "q", "r"]).alias("v")).groupBy("v").count().collect()
    assert {r.v for r in values} == {"p", "q", "r"} and min(r["count"] for r in values) > 40
    assert transform.needs_encoding(spark.createDataFrame([(1, "a", True)], "a int, b string, c boolean"), ["a", "b", "c"]) == ["b", "c"]
    empty = transform.value_kinds(spark.createDataFrame([], "x double"), ["x"]).first()
    assert (empty.kind, empty.low, empty.n_unique) == ("categorical", None, 0)


def test_plan_sets_memory_and_empty_frames(spark):
    wanted = spark.createDataFrame([("s", "f", 7, 1), ("s", "m", 3, 2)], "attribute string, `group` string, n_target long, priority int")
    regions = spark.createDataFrame([("s", "f", 0.2), ("s", "f", 0.4), ("s", "f", 0.9), ("s", "m", 0.8), (None, None, 0.1)], "attribute string, `group` string, density double")
    assert [tuple(r) for r in fairness.diversity_plan(wanted, regions).collect()] == [("s", "f", 2, 7, 1)]
    assert [tuple(r) for r in fairness.diversity_plan(wanted.limit(0), regions).collect()] == [(None, None, 1, 100, 2)]
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x"), (3, "y")], "k int, s string")
    left = dedup.without(a, a.where("s IS NULL OR s = 'y'"), ["k", "s"])
    assert [tuple(r) for r in left.collect()] == [(2, "x"), (2, "x")]
    assert dedup.shared_columns(a, a.select("s", F.lit(1).alias("z"))) == ["s"]
    assert tuple(memory.report(a, ["k", "s"], 8, 1).first()) == (4, 3, 8, 1, 0.5)
    assert tuple(memory.report(a.limit(0), ["k"], 8).first()) == (0, 0, 8, 0, 0.0)
    none = profile.class_statistics(a.select(F.lit(1).alias("y"), F.col("k").alias("x")), ["x"])
    assert [(r.y, r["min"], r.median) for r in none.orderBy("y").collect()] == [(0, None, None), (1, 1.0, 2.0)]
    one = select.diversity_score(a.limit(1).withColumn("i", F.lit(1)), "i", ["k"], ["s"]).first()
    assert one.min_distance is None and one.duplicate_percent == 0


def test_canonical_numbers(spark):
    xs = [0.0, -0.0, -5e-7, 5e-7, -4.9e-7, 1.0000005, 123456.7891234, -2.5, 1e30, 1e33, 1e300, -1e300, 1e-300, float("nan"), float("inf")]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(canonical(F.col("x"), "double").alias("a"), F.format_string("%.6f", F.col("x") + 0.0).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert spark.createDataFrame([(None,)], "x double").select(canonical(F.col("x"), "double").alias("a")).first().a == "NULL"


def test_feedback():
    text, share = policies.feedback(2, {"sex": 0.3, "age": 0.2}, {"sex": 0.05, "age": 0.15}, {"sex": 0.1, "age": 0.1})
    assert share == 0.5 and "sex: 0.3000 -> 0.0500 (+0.2500), met" in text and "Next: age by 0.0500" in text
    assert policies.feedback(1, {}, {}, {})[1] == 1.0


def test_remote_endpoint(spark):
    seen = []

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body["messages"][0]["content"]))
            if len(seen) == 1:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            reply = json.dumps({"choices": [{"message": {"content": "a,b\n1,2"}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    presets = {"here": {"url": f"http://127.0.0.1:{server.server_port}/v1", "model": "m", "key_variable": "MODEL_KEY"}}
    try:
        e = remote.resolve("here", presets, {"MODEL_KEY": "k"}, temperature=0.1)
        assert e.temperature == 0.1
        asked = spark.createDataFrame([(1, "hello")], "id long, prompt string")
        got = remote.answers(asked, e).first()
        assert got.text == "a,b\n1,2" and seen == [("/v1/chat/completions", "Bearer k", "hello")] * 2
    finally:
        server.shutdown()
    for name, env in (("there", {}), ("here", {})):
        with pytest.raises(ValueError):
            remote.resolve(name, presets, env)
    replies = spark.createDataFrame([(1, "abcdefgh", "abcd"), (2, "abcd", " ")], "id long, prompt string, text string")
    assert tuple(remote.call_statistics(replies).first()) == (2, 1, 3, 2, 2.5)
    lines = remote.constraints(profile.class_statistics(spark.createDataFrame([(1, 1.0), (1, 3.0)], "y int, x double"), ["x"], classes=(1,)))
    assert lines == "x: 1.00 to 3.00, half of the values from 1.50 to 2.50, middle 2.00"

"""Streams with state: bounded memory forgets the oldest, gated batches append what passes and go on after a restart."""

from evenkeel.streaming import pipelines


def _files(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, x double").coalesce(1).write.mode("append").parquet(path)


def test_bounded_memory_forgets_the_oldest(spark, tmp_path):
    path = str(tmp_path / "in")
    _files(spark, path, [[(str(v), 0.0) for v in (1, 2, 3, 1, 4, 2, 1)]])
    stream = pipelines.read_parquet(spark, path, "k string, x double")
    out = pipelines.bounded_memory(stream, "x", "k", most=3, groups=1)
    query = out.writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    held, want = [], []
    for v in "1231421":
        if v not in held:
            want.append(v)
            held = (held + [v])[-3:]
    assert [r.value for r in spark.table("held").collect()] == want


def test_gated_batches_append_and_resume(spark, tmp_path):
    train = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    _files(spark, path, [[("a", 50.0), ("b", 500.0), ("c", None)]])
    pipelines.gated_batches(pipelines.read_parquet(spark, path, "k string, x double"), train, ["x"], out, mark).awaitTermination()
    _files(spark, path, [[("d", 110.0), ("e", -90.0)]])
    pipelines.gated_batches(pipelines.read_parquet(spark, path, "k string, x double"), train, ["x"], out, mark).awaitTermination()
    assert sorted((r.k, r.x) for r in spark.read.parquet(out).collect()) == [("a", 50.0), ("d", 110.0)]

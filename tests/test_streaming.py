import pytest
from pyspark.sql import functions as F

from tidemark import Kind, SeriesSchema
from tidemark.errors import TidemarkError
from tidemark.streaming import admit_stream, latest_version, number_stream, retained_sink, running_stats, state_session, windowed_stats

SCHEMA = "n long, k string, t long"
BATCHES = [[(0, "a", 100), (1, "a", 200), (2, "a", 150)], [(3, "a", 200), (4, "a", 201), (5, "b", 1)], [(6, "b", 1), (7, "b", 2)]]


def write(spark, path, batch):
    spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, make):
    """One micro-batch for each of BATCHES, in a query that is stopped and started again."""
    source, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    for batch in BATCHES:
        write(spark, source, batch)
        stream = make(state_session(spark).readStream.schema(SCHEMA).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    return spark.read.parquet(out)


def test_admission_over_restarts(spark, tmp_path):
    found = run(spark, tmp_path, lambda s: admit_stream(s, ["k"], "n", "t"))
    assert sorted(r["n"] for r in found.collect()) == [0, 1, 4, 5, 7]


def test_numbers_over_restarts(spark, tmp_path):
    found = run(spark, tmp_path, lambda s: number_stream(s, ["k"], "n", "t"))
    assert sorted((r["k"], r["n"], r["t"]) for r in found.collect()) == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 4), ("a", 4, 5), ("b", 5, 1), ("b", 6, 2), ("b", 7, 3)]


def test_retained_sink_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "kept")
    sink = retained_sink(path, ["k"], "t", 2)
    assert latest_version(spark, path) is None
    for i, batch in enumerate(BATCHES):
        sink(spark.createDataFrame(batch, SCHEMA), i)
    sink(spark.createDataFrame(BATCHES[-1], SCHEMA), len(BATCHES) - 1)
    kept = latest_version(spark, path)
    assert sorted(r["t"] for r in kept.where(F.col("k") == "a").collect()) == [200, 201]


def test_running_statistics(spark, tmp_path):
    source = str(tmp_path / "in")
    for batch in BATCHES:
        write(spark, source, batch)
    schema = SeriesSchema.of(time="t", t=Kind.I64, n=Kind.I64)
    view = running_stats(spark.readStream.schema(SCHEMA).parquet(source), schema, ["k"], "n")
    query = view.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert {r["k"]: r["count"] for r in spark.table("running").collect()} == {"a": 5, "b": 3}


def test_the_callers_session_stays_as_it_is(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    run(spark, tmp_path, lambda s: admit_stream(s, ["k"], "n", "t"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    with pytest.raises(TidemarkError, match="RocksDB"):
        admit_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["k"], "n", "t")


def test_windows_drop_late_rows(spark, tmp_path):
    """Windows of ten seconds; rows over twenty seconds behind the newest are left out, and closed windows come once."""
    second, source, out = 1_000_000, str(tmp_path / "in"), str(tmp_path / "out")
    schema = SeriesSchema.of(time="t", t=Kind.I64, n=Kind.I64)
    for batch in ([(1, "a", 1 * second), (2, "a", 9 * second), (3, "b", 11 * second)], [(4, "a", 100 * second)], [(5, "a", 2 * second), (6, "a", 95 * second)], [(7, "a", 200 * second)], [(8, "a", 201 * second)]):
        write(spark, source, batch)
        view = windowed_stats(spark.readStream.schema(SCHEMA).parquet(source), schema, ["k"], "n", "10 seconds", "20 seconds")
        query = view.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    found = {(r["window_start"] // second, r["k"]): (r["count"], r["sum"]) for r in spark.read.parquet(out).collect()}
    assert found == {(0, "a"): (2, 3.0), (10, "b"): (1, 3.0), (90, "a"): (1, 6.0), (100, "a"): (1, 4.0)}

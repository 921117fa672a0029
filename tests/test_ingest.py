from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark import Kind, NotMonotonic, SchemaError, Series, SeriesFull, SeriesSchema
from tidemark.errors import StoreLocked
from tidemark.operators import admit_monotonic, admit_monotonic_split, assign_sequence, assign_sequence_single, assign_sequence_split, fence_index, frames, lower_bounds, multi_range, places, rejects, rejects_split, retain_newest
from tidemark.sources import SeriesStore, decode_logs, encode_logs, export_log, header_of, read_logs, record_log, ring_state
from tidemark.sources.log import decode_log

VALUE = SeriesSchema.of(timestamp=Kind.I64, value=Kind.F64)
ARRIVING = "n long, k string, timestamp long, value double"


def test_admission(spark):
    rows = spark.createDataFrame([(0, "a", 100, 1.0), (1, "a", 200, 2.0), (2, "a", 199, 3.0), (3, "a", 200, 4.0), (4, "a", 201, 5.0), (5, "b", 1, 6.0)], ARRIVING)
    assert sorted(r["n"] for r in admit_monotonic(rows, ["k"], "n", "timestamp").collect()) == [0, 1, 4, 5]
    assert sorted(r["n"] for r in rejects(rows, ["k"], "n", "timestamp").collect()) == [2, 3]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=12), st.integers(-1, 6))
def test_admission_against_a_loop(spark, arriving, last):
    rows = spark.createDataFrame([(i, "a", t, 0.0) for i, t in enumerate(arriving)], ARRIVING)
    stored = spark.createDataFrame([("a", last)], "k string, timestamp long")
    want, most = [], last
    for i, t in enumerate(arriving):
        if t > most:
            want.append(i)
            most = t
    assert sorted(r["n"] for r in admit_monotonic(rows, ["k"], "n", "timestamp", stored).collect()) == want


def test_sequence(spark):
    rows = spark.createDataFrame([(i, "a", 999, float(i)) for i in range(5)], ARRIVING)
    stored = spark.createDataFrame([("a", 10)], "k string, timestamp long")
    assert [r["timestamp"] for r in assign_sequence(rows, ["k"], "n", "timestamp", stored).orderBy("n").collect()] == [11, 12, 13, 14, 15]
    assert [r["timestamp"] for r in assign_sequence_single(rows, "n", "timestamp").orderBy("n").collect()] == [1, 2, 3, 4, 5]


def test_append(spark):
    start = Series(spark.createDataFrame([(100, 1.0), (200, 2.0)], VALUE.spark()), VALUE)
    batch = spark.createDataFrame([(0, 199, 0.0), (1, 200, 0.0), (2, 201, 3.0)], "n long, timestamp long, value double")
    grown = Series(start.df.selectExpr("'a' AS k", "*"), VALUE, ["k"]).append(batch.selectExpr("'a' AS k", "*"), "n")
    assert [r["timestamp"] for r in grown.load().collect()] == [100, 200, 201]
    with pytest.raises(NotMonotonic):
        Series(start.df.selectExpr("'a' AS k", "*"), VALUE, ["k"]).append(batch.selectExpr("'a' AS k", "*"), "n", on_reject="raise")


def test_numbered_ring(spark):
    empty = spark.createDataFrame([], "k string, timestamp long, value double")
    first = spark.createDataFrame([("a", i, 0, v) for i, v in enumerate([1.1, 2.2, 3.3, 4.4])], "k string, n long, timestamp long, value double")
    ring = Series(empty, VALUE, ["k"], keep=3).append_numbered(first, "n")
    ring = ring.append_numbered(spark.createDataFrame([("a", 0, 0, 5.5)], "k string, n long, timestamp long, value double"), "n")
    assert [(r["timestamp"], r["value"]) for r in ring.load().collect()] == [(3, 3.3), (4, 4.4), (5, 5.5)]


def test_retention_keeps_the_newest(spark):
    rows = spark.range(15).selectExpr("'a' AS k", "id * 100 AS timestamp")
    assert sorted(r["timestamp"] for r in retain_newest(rows, ["k"], "timestamp", 5).collect()) == [1000, 1100, 1200, 1300, 1400]


def test_lower_bounds_and_fences(spark):
    rows = spark.range(2500).selectExpr("'a' AS k", "id * 2 AS t")
    assert lower_bounds(rows, ["k"], "t", [-1, 0, 1, 2, 4998, 4999]).first()[1:] == (0, 0, 1, 1, 2499, 2500)
    assert [tuple(r)[1:] for r in fence_index(rows, ["k"], "t").orderBy("place").collect()] == [(0, 0), (2048, 1024), (4096, 2048)]


def test_store(spark, tmp_path):
    path = str(tmp_path / "series")
    store = SeriesStore(spark, path, VALUE, keep=2)
    store.append(spark.createDataFrame([("a", i, t, float(t)) for i, t in enumerate([100, 200, 150, 300])], "series string, n long, timestamp long, value double"), "n")
    again = SeriesStore(spark, path, VALUE, keep=2)
    assert [r["timestamp"] for r in again.series("a").load().collect()] == [200, 300]
    again.append_numbered(spark.createDataFrame([("a", 0, 0, 1.0)], "series string, n long, timestamp long, value double"), "n")
    assert again.series("a").latest_value("value") == (1.0, 301)
    again.compact(str(tmp_path / "small"))
    assert SeriesStore(spark, str(tmp_path / "small"), VALUE).series("a").count() == 2
    with pytest.raises(SchemaError):
        SeriesStore(spark, path, SeriesSchema.of(timestamp=Kind.I64, value=Kind.F64, extra=Kind.U8))
    again.drop()
    assert SeriesStore(spark, path, VALUE).series().count() == 0


def test_store_that_stops_when_full(spark, tmp_path):
    store = SeriesStore(spark, str(tmp_path / "s"), VALUE, keep=2, stop_when_full=True)
    batch = spark.createDataFrame([("a", i, t, 0.0) for i, t in enumerate([1, 2, 3])], "series string, n long, timestamp long, value double")
    with pytest.raises(SeriesFull):
        store.append(batch, "n")
    assert store.rows().count() == 0 and store.keep == 2
    store.append(batch.where("n < 2"), "n")
    assert [r["timestamp"] for r in store.series("a").load().collect()] == [1, 2]
    with pytest.raises(SeriesFull):
        store.append_numbered(batch.where("n = 2"), "n")
    # a byte budget of the header and two records
    budget = Series(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 1.0)], "k string, timestamp long, value double"), VALUE, ["k"], max_bytes=12 + 2 * VALUE.record_bytes + 5, stop_when_full=True)
    assert budget.keep == 2
    with pytest.raises(SeriesFull):
        budget.append(batch.selectExpr("'a' AS k", "n", "timestamp", "value"), "n")
    assert budget.append(batch.where("n = 2").selectExpr("'b' AS k", "n", "timestamp", "value"), "n").count() == 4
    full = Series(spark.createDataFrame([(1, 1.0), (2, 2.0)], VALUE.spark()), VALUE, keep=2, stop_when_full=True)
    with pytest.raises(SeriesFull):
        full._grown(spark.createDataFrame([(3, 3.0)], VALUE.spark()))


def test_one_writer_at_a_time(spark, tmp_path):
    store = SeriesStore(spark, str(tmp_path / "s"), VALUE)
    batch = spark.createDataFrame([("a", 0, 1, 0.0)], "series string, n long, timestamp long, value double")
    with store.writing():
        with pytest.raises(StoreLocked):
            SeriesStore(spark, str(tmp_path / "s"), VALUE).append(batch, "n")
        with pytest.raises(StoreLocked):
            store.drop()
    store.append(batch, "n")
    store._file(store.lock_path)[0].create(store._file(store.lock_path)[1], False).close()  # a writer that died
    with pytest.raises(StoreLocked):
        store.append(batch, "n")
    store.break_lock()
    store.append(batch.selectExpr("series", "n", "timestamp + 1 AS timestamp", "value"), "n")
    assert store.rows().count() == 2


def test_operators_leave_the_callers_columns_alone(spark):
    """Columns of the operators' own names, null keys, ties and nothing at all."""
    own = ["_rank", "_most", "_last", "_part", "_carry", "_place", "_bucket", "_of", "_parts", "_key0", "_rows", "place_"]
    rows = spark.createDataFrame([(0, "a", 1, 1.0), (1, "a", 1, 2.0), (2, None, 5, 3.0), (3, None, 4, 4.0), (4, "a", 2, None)], ARRIVING).selectExpr("*", *(f"n * 10 AS {c}" for c in own))
    stored = spark.createDataFrame([("a", 1), (None, 3)], "k string, timestamp long")
    for admit, reject in ((admit_monotonic, rejects), (admit_monotonic_split, rejects_split)):
        for known, want in ((None, [0, 2, 4]), (stored, [2, 4])):
            found = admit(rows, ["k"], "n", "timestamp", known)
            assert found.columns == rows.columns and sorted(r["n"] for r in found.collect()) == want
            assert all(r[c] == r["n"] * 10 for r in found.collect() for c in own)
            assert sorted(r["n"] for r in reject(rows, ["k"], "n", "timestamp", known).collect()) == sorted({0, 1, 2, 3, 4} - set(want))
        assert admit(rows.limit(0), ["k"], "n", "timestamp", stored).count() == 0
    for number in (assign_sequence, assign_sequence_split):
        found = number(rows, ["k"], "n", "timestamp", stored)
        assert found.columns == rows.columns and {r["n"]: r["timestamp"] for r in found.collect()} == {0: 2, 1: 3, 4: 4, 2: 4, 3: 5}
    for found in (places(rows, ["k"], "n"), retain_newest(rows, ["k"], "n", 2), retain_newest(rows, [], "n", 2)):
        assert all(r[c] == r["n"] * 10 for r in found.collect() for c in own)
    ranges = spark.createDataFrame([("a", 0, 2), ("a", 0, 2), (None, 0, 9)], "k string, range_start long, range_end long")
    met = multi_range(rows, ranges, ["k"], "timestamp", 4)
    assert sorted(r["n"] for r in met.collect()) == [0, 0, 1, 1] and set(own) <= set(met.columns)
    assert sorted(r["n"] for r in frames(rows.drop("place_"), ["k"], "n", "_rank", "_last", 2).withColumn("n", F.col("frame")).collect()) == [0, 0]


def test_keyless_series_goes_on_after_the_stored_rows(spark):
    series = Series(spark.createDataFrame([(100, 1.0), (200, 2.0)], VALUE.spark()), VALUE)
    batch = spark.createDataFrame([(0, 199, 0.0), (1, 201, 0.0), (2, 201, 3.0)], "n long, timestamp long, value double")
    assert [r["timestamp"] for r in series.append(batch, "n").load().collect()] == [100, 200, 201]
    assert [r["timestamp"] for r in series.append_numbered(batch, "n").load().collect()] == [100, 200, 201, 202, 203]


def test_headers(spark, tmp_path):
    other = SeriesSchema.of(timestamp=Kind.I64, value=Kind.I64)
    rows = spark.createDataFrame([("a", 1, 1.0)], "k string, timestamp long, value double")
    export_log(encode_logs(rows, VALUE, "k"), "a", str(tmp_path / "a.bin"))
    assert read_logs(spark, str(tmp_path), VALUE, header=header_of(VALUE)).count() == 1
    assert record_log(spark, str(tmp_path / "a.bin"), VALUE, header=header_of(VALUE)).count() == 1
    for read in (lambda h: read_logs(spark, str(tmp_path), VALUE, header=h).count(), lambda h: record_log(spark, str(tmp_path / "a.bin"), VALUE, header=h).count()):
        with pytest.raises(Exception, match="another schema"):
            read(header_of(other))
        with pytest.raises(Exception, match="another mark"):
            read(header_of(VALUE, b"NONE"))
    (tmp_path / "a.bin").write_bytes(b"TIDE")
    with pytest.raises(Exception, match="no header"):
        read_logs(spark, str(tmp_path), VALUE, header=header_of(VALUE)).count()
    # one mark, but not one digest, for names, types and their order
    assert len({header_of(VALUE), header_of(other), header_of(SeriesSchema.of(value=Kind.F64, timestamp=Kind.I64))}) == 3


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 10, 14, 15])
def test_wrapped_logs(spark, n):
    """i of 0 to n - 1 in a log of five records: the newest five, and where the writer goes on."""
    schema = SeriesSchema.of(timestamp=Kind.I64, value=Kind.F64, id=Kind.U64)
    rows = spark.range(n).selectExpr("'a' AS k", "id * 100 AS timestamp", "cast(id AS double) AS value", "cast(id AS decimal(20, 0)) AS id")
    files = encode_logs(rows, schema, "k", capacity=5)
    kept = decode_logs(files, schema, header=header_of(schema)).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["value"], int(r["id"])) for r in kept] == [(100 * i, float(i), i) for i in range(max(0, n - 5), n)]
    state = [tuple(r) for r in ring_state(files, schema, 5, header=header_of(schema)).collect()]
    assert state == ([("a", min(n, 5), 100 * (n - 1), n % 5 if n >= 5 else n, n > 5 and n % 5 > 0)] if n else [])


def test_long_series_are_written_in_parts(spark):
    rows = spark.range(1_000).selectExpr("'a' AS k", "id AS timestamp", "cast(id AS double) AS value")
    parts = encode_logs(rows, VALUE, "k", part_records=64).orderBy("part").collect()
    assert [r["part"] for r in parts] == list(range(16)) and [len(r["content"]) for r in parts] == [12 + 64 * 16] + [64 * 16] * 14 + [40 * 16]
    data = b"".join(bytes(r["content"]) for r in parts)
    assert decode_log(data, VALUE, header_of(VALUE))["timestamp"].tolist() == list(range(1_000))


def test_log_round_trip(spark, tmp_path):
    schema = SeriesSchema.of(timestamp=Kind.I64, v=Kind.U64, f=Kind.F64, b=Kind.BOOL, s=Kind.STRING, small=Kind.U8)
    random = np.random.default_rng(12345)
    numbers = random.integers(0, 2**64, 1000, dtype=np.uint64).tolist()
    rows = spark.createDataFrame([(i, Decimal(v), float(i), i % 2 == 0, "x" * (i % 129), i % 256) for i, v in enumerate(numbers)], schema.spark())
    header = b"TEST" + bytes(8)
    assert export_log(encode_logs(rows.selectExpr("'a' AS k", "*"), schema, "k", header), "a", str(tmp_path / "a.bin")) == 12 + 1000 * schema.record_bytes
    back = read_logs(spark, str(tmp_path), schema, header=header)
    assert back.select("series").distinct().first()[0] == "a"
    assert [tuple(r) for r in back.drop("series").orderBy("timestamp").collect()] == [tuple(r) for r in rows.orderBy("timestamp").collect()]
    ranged = record_log(spark, str(tmp_path / "*.bin"), schema, rows_per_task=64)
    assert ranged.rdd.getNumPartitions() == 16
    assert [tuple(r) for r in ranged.drop("series").orderBy("timestamp").collect()] == [tuple(r) for r in rows.orderBy("timestamp").collect()]
    few = record_log(spark, str(tmp_path / "*.bin"), schema, start=100, end=130, rows_per_task=64)
    assert few.rdd.getNumPartitions() == 2 and sorted(r["timestamp"] for r in few.collect()) == list(range(100, 130))
    none = record_log(spark, str(tmp_path / "*.bin"), schema, start=5000, end=6000, rows_per_task=64)
    assert none.count() == 0
    (tmp_path / "a.bin").write_bytes((tmp_path / "a.bin").read_bytes()[:-1])
    with pytest.raises(Exception, match="multiple"):
        read_logs(spark, str(tmp_path), schema).count()


def test_wrapped_log_is_read_by_time(spark, tmp_path):
    schema = SeriesSchema.of(timestamp=Kind.I64, value=Kind.F64)
    wrapped = np.array([(t, float(t)) for t in (70, 80, 30, 40, 50, 60)], [("timestamp", "<i8"), ("value", "<f8")])
    (tmp_path / "w.bin").write_bytes(bytes(12) + wrapped.tobytes())
    rows = record_log(spark, str(tmp_path / "w.bin"), schema, start=35, end=75, rows_per_task=4)
    assert [r["timestamp"] for r in rows.orderBy("timestamp").collect()] == [40, 50, 60, 70]

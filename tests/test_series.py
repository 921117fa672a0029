import math
import sys
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark import EmptySeries, Kind, Series, SeriesSchema, TypeMismatch, UnknownField
from tidemark.operators import frame_checksum, frames, multi_range

VALUE = SeriesSchema.of(timestamp=Kind.I64, value=Kind.F64)
MAX = sys.float_info.max


def series(spark, rows, schema=VALUE, **options):
    return Series(spark.createDataFrame(rows, schema.spark()), schema, **options)


def times(df):
    return [r["timestamp"] for r in df.collect()]


def hundreds(n, factor=1.0):
    return [(100 * i, factor * i) for i in range(1, n + 1)]


def test_half_open_range(spark):
    s = series(spark, hundreds(5))
    assert times(s.range(200, 450).load()) == [200, 300, 400]
    assert times(s.range(200, 400).load()) == [200, 300]
    assert times(s.range(450, 200).load()) == []


def test_bounded_series(spark):
    s = series(spark, hundreds(5), keep=3)
    assert times(s.load()) == [300, 400, 500]
    assert times(s.range(350, 550).load()) == [400, 500]
    s = series(spark, hundreds(10), keep=3)
    assert times(s.load()) == [800, 900, 1000]
    assert times(s.range(850, 950).load()) == [900]
    assert times(s.range(850, 1050).load()) == [900, 1000]


def test_bounded_ranges(spark):
    s = series(spark, [(t, 10.0 * t) for t in range(1, 8)], keep=5)
    assert [times(s.range(*r).load()) for r in ((1, 6), (2, 7), (3, 8))] == [[3, 4, 5], [3, 4, 5, 6], [3, 4, 5, 6, 7]]


def test_stop_when_full(spark):
    assert times(series(spark, hundreds(5), keep=2, stop_when_full=True).load()) == [100, 200]


def test_statistics(spark):
    s = series(spark, hundreds(5, 10.0))
    assert s.stats("value", 0, 600).first() == (10.0, 50.0, 150.0, 5, 30.0)
    assert s.stats("value", 200, 450).first() == (20.0, 40.0, 90.0, 3, 30.0)
    assert s.latest_value("value") == s.latest_value(1) == (50.0, 500)
    assert s.stats(1, 0, 600).first() == s.stats("value", 0, 600).first()
    with pytest.raises(UnknownField):
        s.stats(2)
    bounded = series(spark, hundreds(7, 10.0), keep=5)
    assert bounded.latest_value("value") == (70.0, 700)
    assert bounded.stats("value", 0, 1000).first() == (30.0, 70.0, 250.0, 5, 50.0)
    assert bounded.stats("value", 400, 650).first() == (40.0, 60.0, 150.0, 3, 50.0)


def test_empty(spark):
    s = series(spark, [])
    assert s.count() == 0
    assert s.stats("value").first() == (0.0, 0.0, 0.0, 0, 0.0)
    assert s.latest("value").collect() == []
    with pytest.raises(EmptySeries):
        s.latest_value("value")
    with pytest.raises(UnknownField):
        s.stats("other", 5, 1)


def test_strings(spark):
    schema = SeriesSchema.of(timestamp=Kind.I64, price=Kind.F64, event=Kind.STRING)
    s = series(spark, [(100, 100.0, "deposit"), (200, 50.0, "withdraw"), (300, 200.0, "deposit"), (400, 1.0, "x" * 128)], schema)
    assert times(s.where(event="deposit").load()) == [100, 300]
    assert times(s.where(event="x" * 128).load()) == [400]
    assert s.stats("event").first() == (0.0, 0.0, 0.0, 4, 0.0)
    with pytest.raises(TypeMismatch):
        s.latest("event")


def test_other_types(spark):
    schema = SeriesSchema.of(timestamp=Kind.I64, flag=Kind.BOOL, big=Kind.U64, small=Kind.U8)
    top = 2**64 - 1
    s = series(spark, [(100, True, Decimal(top), 255), (200, False, Decimal(1), 0), (300, True, Decimal(2), 7)], schema)
    assert times(s.where(flag=True).load()) == [100, 300]
    assert times(s.where(flag=False).load()) == [200]
    assert times(s.where(big=top).load()) == [100]
    assert s.stats("flag").first() == (0.0, 1.0, 2.0, 3, 2 / 3)
    assert s.stats("big").first()["max"] == float(top)
    assert s.stats("small").first()["max"] == 255.0
    assert s.latest_value("flag") == (1.0, 300)


def test_query_with_filters(spark):
    schema = SeriesSchema.of(timestamp=Kind.I64, price=Kind.F64, event=Kind.I64)
    s = series(spark, [(100, 100.0, 1), (200, 50.0, 2), (300, 200.0, 1)], schema)
    assert times(s.query(0, 1000, {"event": 1})) == [100, 300]
    assert times(s.query(0, 300, [{"event": 1}, {"price": 100.0}])) == [100]
    assert times(s.query(0, 1000)) == [100, 200, 300]
    with pytest.raises(TypeMismatch):
        s.query(0, 0, {"event": 1.0})  # even over an empty range


def test_nan_and_zero_equality(spark):
    s = series(spark, [(1, math.nan), (2, -0.0), (3, 3.0)])
    assert times(s.where(value=math.nan).load()) == []
    assert times(s.where(value=0.0).load()) == [2]


def fold(values):
    """The statistics' definition, one value after another."""
    if not values:
        return (0.0, 0.0, 0.0, 0, 0.0)
    low, high, total = MAX, -MAX, 0.0
    for v in values:
        low, high = (v if v < low else low), (v if v > high else high)
        total += v
    return (low, high, total, len(values), total / len(values))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.5, -2.25, math.nan, math.inf, -math.inf, 1e300]), max_size=5))
def test_statistics_against_a_fold(spark, values):
    got = series(spark, [(i, v) for i, v in enumerate(values)]).stats("value").first()
    for a, b in zip(got, fold(values), strict=True):
        assert a == b or (math.isnan(a) and math.isnan(b))


def test_ranges_split(spark):
    s = series(spark, hundreds(20))
    whole, left, right = (s.stats("value", *r).first() for r in ((0, 3000), (0, 900), (900, 3000)))
    assert whole["count"] == left["count"] + right["count"] and whole["sum"] == left["sum"] + right["sum"]
    assert whole["min"] == min(left["min"], right["min"]) and whole["max"] == max(left["max"], right["max"])


def test_frames(spark):
    rows = spark.range(2500).selectExpr("id AS timestamp", "cast(id AS double) AS usd", "cast(id AS double) AS volume", "'a' AS k")
    found = frames(rows, ["k"], "timestamp", "volume", "usd").orderBy("frame").collect()
    assert [(r["frame"], r["sum"], r["mean"]) for r in found] == [(0, 499500.0, 499.5), (1, 1499500.0, 1499.5)]
    assert frame_checksum(frames(rows, ["k"], "timestamp", "volume", "usd")).first() == (2, 1999000.0 + 1999.0)


def test_many_ranges(spark):
    rows = spark.range(5000).selectExpr("'a' AS k", "id * 1000 AS t", "cast(id AS double) AS v")
    ranges = spark.createDataFrame([("a", 0, 10_000), ("a", 9_999, 10_001), ("a", 500_000, 1_500_000), ("a", 5, 5), ("a", 9, 3), ("b", 0, 10_000)], "k string, range_start long, range_end long")
    found = multi_range(rows, ranges, ["k"], "t", 100_000)
    assert {r["range_start"]: r["count"] for r in found.groupBy("range_start").count().collect()} == {0: 10, 9_999: 1, 500_000: 1000}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

from dataclasses import dataclass
from decimal import Decimal
from typing import Annotated

import pytest

from tidemark import Field, Kind, SchemaError, SeriesSchema, TypeMismatch, UnknownField
from tidemark.functions import equals

TRADE = SeriesSchema.of(timestamp=Kind.I64, usd=Kind.F64, volume=Kind.F64)


def test_record_bytes_and_capacity():
    assert TRADE.record_bytes == 24
    assert TRADE.capacity(60) == 2
    assert SeriesSchema.of(timestamp=Kind.I64, price=Kind.F64, event=Kind.STRING).record_bytes == 144
    with pytest.raises(SchemaError):
        TRADE.capacity(30)


@pytest.mark.parametrize("fields", [(), (Field("value", Kind.F64), Field("id", Kind.U64)), (Field("timestamp", Kind.F64),), (Field("timestamp", Kind.I64), Field("a", Kind.F64), Field("a", Kind.I64))])
def test_invalid_schemas(fields):
    with pytest.raises(SchemaError):
        SeriesSchema(fields)


def test_no_evolution():
    with pytest.raises(SchemaError):
        TRADE.require_same(SeriesSchema.of(timestamp=Kind.I64, usd=Kind.F64, volume=Kind.F64, extra=Kind.U8))
    with pytest.raises(SchemaError):
        TRADE.require_same(SeriesSchema.of(timestamp=Kind.I64, volume=Kind.F64, usd=Kind.F64))


def test_from_dataclass():
    @dataclass
    class Row:
        timestamp: int
        price: float
        active: bool
        level: Annotated[int, Kind.U8]

    assert [f.kind for f in SeriesSchema.from_dataclass(Row).fields] == [Kind.I64, Kind.F64, Kind.BOOL, Kind.U8]


def test_positions():
    assert TRADE.position("volume") == 2
    with pytest.raises(UnknownField):
        TRADE.position("price")


ALL = SeriesSchema.of(timestamp=Kind.I64, f=Kind.F64, u=Kind.U64, b=Kind.BOOL, s=Kind.STRING, small=Kind.U8)


@pytest.mark.parametrize(("name", "value"), [("timestamp", 1.0), ("timestamp", True), ("timestamp", "1"), ("f", 1), ("u", -1), ("u", 2**64), ("b", 1), ("s", 1), ("s", "x" * 129), ("small", 3), ("timestamp", 2**63)])
def test_literals_of_another_type(spark, name, value):
    with pytest.raises(TypeMismatch):
        equals(ALL, name, value)


def test_unknown_field(spark):
    with pytest.raises(UnknownField):
        equals(ALL, "nothing", 1)


def test_bad_rows_fail(spark):
    schema = SeriesSchema.of(timestamp=Kind.I64, u=Kind.U64, s=Kind.STRING)
    good = spark.createDataFrame([(1, Decimal(2**64 - 1), "x" * 128)], "timestamp long, u decimal(20,0), s string")
    assert schema.conform(good).count() == 1
    for row in [(None, Decimal(1), "a"), (1, None, "a"), (1, Decimal(-1), "a"), (1, Decimal(1), "é" * 65)]:
        bad = spark.createDataFrame([row], "timestamp long, u decimal(20,0), s string")
        with pytest.raises(Exception, match="null|unsigned|bytes"):
            schema.conform(bad).collect()
    with pytest.raises(SchemaError):
        schema.conform(good.drop("u"))
    with pytest.raises(SchemaError):
        schema.conform(good.withColumn("u", good.s))

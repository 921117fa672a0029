"""Strictly typed equality, checked against the schema before any column is built."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import TypeMismatch
from tidemark.schema import STRING_BYTES, Kind, SeriesSchema

_I64, _U64 = 2**63, 2**64


def _fits(kind: Kind, value: Any) -> bool:
    if kind is Kind.BOOL:
        return isinstance(value, bool)
    if isinstance(value, bool):
        return False
    if kind is Kind.I64:
        return isinstance(value, int) and -_I64 <= value < _I64
    if kind is Kind.U64:
        return isinstance(value, (int, Decimal)) and value == int(value) and 0 <= value < _U64
    if kind is Kind.F64:
        return isinstance(value, float)
    if kind is Kind.STRING:
        return isinstance(value, str) and len(value.encode()) <= STRING_BYTES
    return False  # there is no equality on 8-bit fields


def equals(schema: SeriesSchema, name: str, value: Any) -> Column:
    """``name == value``; the literal's type must be the field's.

    NaN equals nothing, and -0.0 equals 0.0.
    """
    kind = schema.kind(name)
    if not _fits(kind, value):
        raise TypeMismatch(f"{name} is {kind.name}: {value!r} doesn't fit")
    c = F.col(name)
    if kind is Kind.F64:
        # Spark takes NaN for equal to itself
        return F.lit(False) if value != value else (c == F.lit(value)) & ~F.isnan(c)
    if kind is Kind.U64:
        return c == F.lit(str(int(value))).cast("decimal(20,0)")
    return c == F.lit(value)


def conjunction(schema: SeriesSchema, **values: Any) -> Column:
    """All equalities; true for none."""
    return reduce(lambda a, b: a & b, (equals(schema, n, v) for n, v in values.items()), F.lit(True))

"""Field types, schemas and their validation."""

from __future__ import annotations

import dataclasses
import typing
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SchemaError, UnknownField

TIME = "timestamp"
STRING_BYTES = 128
#: Bytes that a stored log begins with, before its records.
LOG_HEADER_BYTES = 12


class Kind(Enum):
    """A field type: bytes in a stored record, Spark type, numpy type."""

    I64 = (8, T.LongType(), "<i8")
    F64 = (8, T.DoubleType(), "<f8")
    U64 = (8, T.DecimalType(20, 0), "<u8")
    U8 = (1, T.ShortType(), "u1")
    STRING = (STRING_BYTES, T.StringType(), f"S{STRING_BYTES}")
    BOOL = (1, T.BooleanType(), "?")

    @property
    def width(self) -> int:
        return self.value[0]

    @property
    def spark(self) -> T.DataType:
        return self.value[1]

    @property
    def numpy(self) -> str:
        return self.value[2]


_BY_SPARK = {T.ByteType: Kind.I64, T.IntegerType: Kind.I64, T.LongType: Kind.I64, T.FloatType: Kind.F64, T.DoubleType: Kind.F64, T.StringType: Kind.STRING, T.BooleanType: Kind.BOOL, T.ShortType: Kind.U8}
_BY_PYTHON = {int: Kind.I64, float: Kind.F64, bool: Kind.BOOL, str: Kind.STRING}


def kind_of(data_type: T.DataType) -> Kind:
    """The kind that a Spark column holds."""
    if isinstance(data_type, T.DecimalType) and data_type.scale == 0:
        return Kind.U64
    found = _BY_SPARK.get(type(data_type))
    if found is None:
        raise SchemaError(f"no field type for {data_type.simpleString()}")
    return found


@dataclass(frozen=True)
class Field:
    name: str
    kind: Kind


@dataclass(frozen=True)
class SeriesSchema:
    """An ordered list of fields, one of which is the 64-bit integer time."""

    fields: tuple[Field, ...]
    time: str = TIME

    def __post_init__(self):
        if not self.fields:
            raise SchemaError("a schema needs fields")
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise SchemaError(f"field names repeat: {names}")
        if Field(self.time, Kind.I64) not in self.fields:
            raise SchemaError(f"no 64-bit integer field {self.time!r}")

    @classmethod
    def of(cls, time: str = TIME, **kinds: Kind) -> SeriesSchema:
        return cls(tuple(Field(n, k) for n, k in kinds.items()), time)

    @classmethod
    def from_spark(cls, schema: T.StructType, time: str = TIME) -> SeriesSchema:
        return cls(tuple(Field(f.name, kind_of(f.dataType)) for f in schema), time)

    @classmethod
    def from_dataclass(cls, record: type, time: str = TIME) -> SeriesSchema:
        """From a dataclass or NamedTuple of int, float, bool and str, or of Kind annotations."""
        hints = typing.get_type_hints(record, include_extras=True)
        names = [f.name for f in dataclasses.fields(record)] if dataclasses.is_dataclass(record) else list(hints)
        fields = []
        for name in names:
            hint = hints[name]
            marks = [m for m in getattr(hint, "__metadata__", ()) if isinstance(m, Kind)]
            kind = marks[0] if marks else _BY_PYTHON.get(hint)
            if kind is None:
                raise SchemaError(f"no field type for {name}: {hint}")
            fields.append(Field(name, kind))
        return cls(tuple(fields), time)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def record_bytes(self) -> int:
        return sum(f.kind.width for f in self.fields)

    def position(self, name: str) -> int:
        """The index of a field."""
        if name not in self.names:
            raise UnknownField(f"{name!r} is not one of {self.names}")
        return self.names.index(name)

    def resolve(self, field: str | int) -> str:
        """A field's name, from its name or its index."""
        if isinstance(field, int):
            if not 0 <= field < len(self.fields):
                raise UnknownField(f"{field} is not an index of {self.names}")
            return self.names[field]
        return self.names[self.position(field)]

    def kind(self, name: str) -> Kind:
        return self.fields[self.position(name)].kind

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.kind.spark, False) for f in self.fields])

    def capacity(self, max_bytes: int) -> int:
        """Records that a byte budget holds after the log's header."""
        n = (max_bytes - LOG_HEADER_BYTES) // self.record_bytes
        if n < 1:
            raise SchemaError(f"{max_bytes} bytes don't hold a record of {self.record_bytes}")
        return n

    def require_same(self, other: SeriesSchema) -> None:
        """Names, types and order must agree: schemas don't evolve."""
        if self != other:
            raise SchemaError(f"stored {self.names}, given {other.names}, or their types differ")

    def violations(self) -> Column:
        """What is wrong with a row: null where it is a valid record."""
        checks = []
        for f in self.fields:
            c = F.col(f.name)
            checks.append(F.when(c.isNull(), F.lit(f"{f.name}: null")))
            if f.kind is Kind.STRING:
                checks.append(F.when(F.octet_length(c) > STRING_BYTES, F.lit(f"{f.name}: over {STRING_BYTES} bytes")))
            elif f.kind is Kind.U8:
                checks.append(F.when((c < 0) | (c > 255), F.lit(f"{f.name}: not in 0 to 255")))
            elif f.kind is Kind.U64:
                checks.append(F.when((c < 0) | (c > F.lit("18446744073709551615").cast("decimal(20,0)")), F.lit(f"{f.name}: no unsigned 64-bit number")))
        return F.coalesce(*checks)

    def conform(self, df: DataFrame) -> DataFrame:
        """The schema's columns, cast where that loses nothing; a bad row fails when it is read."""
        missing = [n for n in self.names if n not in df.columns]
        if missing:
            raise SchemaError(f"missing fields: {missing}")
        kinds = {f.name: kind_of(df.schema[f.name].dataType) for f in self.fields}
        for f in self.fields:
            if kinds[f.name] is not f.kind and not (f.kind in (Kind.U64, Kind.U8) and kinds[f.name] in (Kind.I64, Kind.U8)):
                raise SchemaError(f"{f.name} is {kinds[f.name].name}, not {f.kind.name}")
        rest = [c for c in df.columns if c not in self.names]
        checked = df.withColumn("_bad", self.violations())
        checked = checked.where(F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad")).cast("boolean")).otherwise(F.lit(True))).drop("_bad")
        return checked.select(*rest, *(F.col(f.name).cast(f.kind.spark).alias(f.name) for f in self.fields))

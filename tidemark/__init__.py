"""A PySpark-native time-series engine.

Keyed series of an integer time and typed fields: strict admission or assigned
sequence numbers, bounded retention, half-open range scans with strictly typed
equality filters, statistics, latest values, count frames, and many ranges at once.
Everything is a lazily composed DataFrame.
"""

from tidemark.errors import EmptySeries, NotMonotonic, SchemaError, SeriesFull, TidemarkError, TypeMismatch, UnknownField
from tidemark.schema import Field, Kind, SeriesSchema
from tidemark.series import Series

__all__ = ["EmptySeries", "Field", "Kind", "NotMonotonic", "SchemaError", "Series", "SeriesFull", "SeriesSchema", "TidemarkError", "TypeMismatch", "UnknownField"]

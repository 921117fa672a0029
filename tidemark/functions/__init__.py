"""Column expressions."""

from tidemark.functions.predicates import conjunction, equals
from tidemark.functions.statistics import as_number, latest, statistics
from tidemark.functions.time import micros, time_literal

__all__ = ["as_number", "conjunction", "equals", "latest", "micros", "statistics", "time_literal"]

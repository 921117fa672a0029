"""Typed errors; nothing is reported as an empty result."""


class TidemarkError(Exception):
    """Any error of this library."""


class SchemaError(TidemarkError, ValueError):
    """A schema is invalid, lacks its time field, or differs from the stored one."""


class UnknownField(TidemarkError, KeyError):
    """No field of that name."""


class TypeMismatch(TidemarkError, TypeError):
    """A literal's type isn't the field's, or the operation isn't defined for the type."""


class NotMonotonic(TidemarkError, ValueError):
    """A batch has times that don't strictly increase."""


class SeriesFull(TidemarkError, ValueError):
    """A bounded series that stops when full has no room."""


class StoreLocked(TidemarkError, RuntimeError):
    """Another writer holds the store."""


class EmptySeries(TidemarkError, LookupError):
    """There is no latest value."""

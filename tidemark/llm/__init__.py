"""Training-data operators.

Nothing else in the library imports this subpackage; it can be removed without
touching the time-series engine.
"""

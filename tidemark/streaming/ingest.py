"""Per-series state: the last admitted time, or the last number.

There is no lateness: a row that isn't ahead of its series is rejected, which a
watermark (global progress) can't say.  Rows of a micro-batch are put in order of an
arrival column, since a shuffle doesn't keep theirs, so a series' rows of one batch are
held by one task: bound a batch at its source (``maxFilesPerTrigger``,
``maxOffsetsPerTrigger``).  The session must use the RocksDB state store;
``state_session`` gives one that does and leaves the caller's as it is.

Defined cases: a null key is a series of its own; rows with a null time are let through
only before their series has a time; rows of one arrival keep the order they come in;
a batch without rows changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.errors import TidemarkError

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB."""
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set(PROVIDER, ROCKSDB)
    return session


class _LastTime(StatefulProcessor):
    """Keeps the greatest time and lets through what exceeds it."""

    def __init__(self, arrival: str, time: str):
        self._arrival, self._time = arrival, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "t long")

    def _change(self, rows: pd.DataFrame, last: int | None) -> pd.DataFrame:
        before = rows[self._time].cummax().shift(1)
        if last is not None:
            before = before.fillna(last).clip(lower=last)
        return rows[before.isna() | (rows[self._time] > before)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self._arrival, kind="stable")
        state = self._last.get() if self._last.exists() else None
        out = self._change(batch, None if state is None else state[0])
        if len(out):
            self._last.update((int(out[self._time].iloc[-1]),))
            yield out

    def close(self) -> None:
        pass


class _Counter(_LastTime):
    """Keeps a counter and numbers what arrives."""

    def _change(self, rows: pd.DataFrame, last: int | None) -> pd.DataFrame:
        first = (last or 0) + 1
        return rows.assign(**{self._time: range(first, first + len(rows))})


def _apply(stream: DataFrame, keys: list[str], processor: StatefulProcessor) -> DataFrame:
    if stream.sparkSession.conf.get(PROVIDER, None) != ROCKSDB:
        raise TidemarkError("keyed state needs the RocksDB state store: read the stream in state_session(spark)")
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=stream.schema, outputMode="Append", timeMode="None")


def admit_stream(stream: DataFrame, keys: list[str], arrival: str, time: str) -> DataFrame:
    """Rows, by arrival, whose integer time exceeds all earlier ones of their series."""
    return _apply(stream, keys, _LastTime(arrival, time))


def number_stream(stream: DataFrame, keys: list[str], arrival: str, time: str) -> DataFrame:
    """Rows whose integer time is replaced by 1, 2, 3 ... in each series."""
    return _apply(stream, keys, _Counter(arrival, time))

"""The streaming queries: a table is read as a stream until nothing is left."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions import micros
from tidemark.schema import Kind, SeriesSchema
from tidemark.storage import shared_folder
from tidemark.streaming import admit_stream, latest_version, number_stream, retained_sink, running_latest, running_stats, state_session, windowed_stats

TIMEOUT = 600
#: Files that a micro-batch reads at most.
FILES_A_BATCH = 16


def _folder(spark: SparkSession) -> str:
    """A folder of its own for a query's progress and output, in the shared place."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4()}"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    # as a pattern, since a plain path must be a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(f"{path}*")


def _finish(writer: DataStreamWriter, folder: str) -> None:
    running = writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    if not running.awaitTermination(TIMEOUT):
        running.stop()
        raise TimeoutError("the stream did not end")


def monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    rows = _read(state_session(spark), sf_dir, "orders").select("o_orderkey", "o_orderpriority", micros("o_orderdate").alias("t"))
    admitted = admit_stream(rows, ["o_orderpriority"], "o_orderkey", "t")
    _finish(admitted.writeStream.format("parquet").option("path", f"{folder}/rows"), folder)
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    rows = _read(state_session(spark), sf_dir, "events").select("event_id", "event_type", micros("ts").alias("t"))
    numbered = number_stream(rows, ["event_type"], "event_id", "t")
    _finish(numbered.writeStream.format("parquet").option("path", f"{folder}/rows"), folder)
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


VALUES = SeriesSchema.of(time="t", t=Kind.I64, value=Kind.F64)


def _view(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a running view of the events holds in the end."""
    folder = _folder(spark)
    rows = _read(spark, sf_dir, "events").select("event_type", micros("ts").alias("t"), "value")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/view")

    _finish(make(rows).writeStream.outputMode("complete").foreachBatch(keep), folder)
    return spark.read.parquet(f"{folder}/view")


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, lambda rows: running_latest(rows, VALUES, ["event_type"], "value"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, lambda rows: running_stats(rows, VALUES, ["event_type"], "value"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, lambda rows: windowed_stats(rows, VALUES, ["event_type"], "value", "1 day", "365 days"))


def retained(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    folder = _folder(spark)
    rows = _read(spark, sf_dir, "events").select("event_id", "event_type", micros("ts").alias("t"))
    _finish(rows.writeStream.foreachBatch(retained_sink(f"{folder}/newest", ["event_type"], "t", n)), folder)
    found = latest_version(spark, f"{folder}/newest")
    return found if found is not None else spark.createDataFrame([], rows.schema).select(F.col("event_id"), "event_type", "t")

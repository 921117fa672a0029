"""A sink that keeps the newest rows of each series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import retain_newest


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were written to the end."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    done = []
    for status in files.listStatus(top):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            done.append(int(name[1:]))
    return sorted(done)


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """What the sink holds now."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else None


def retained_sink(path: str, keys: list[str], time: str, n: int) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: version ``id + 1`` is the newest ``n`` rows after batch ``id``.

    A batch that runs again overwrites its own version from the one before it, so the
    result is the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [v for v in _versions(spark, path) if v <= batch_id]
        rows = batch if not earlier else spark.read.parquet(f"{path}/v{earlier[-1]}").unionByName(batch)
        retain_newest(rows, keys, time, n).write.mode("overwrite").parquet(f"{path}/v{batch_id + 1}")

    return write

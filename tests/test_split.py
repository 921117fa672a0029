"""Series that span tasks, held against the windows that don't."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import admit_monotonic, admit_monotonic_split, assign_sequence, assign_sequence_single, assign_sequence_split, places


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(5)
    # one series has two thirds of the rows; one has no key; some times are null
    found = [(i, draw.choice(["hot"] * 6 + ["b", "c", None]), None if i % 97 == 0 else draw.randint(0, 40) + i // 3) for i in range(3_000)]
    draw.shuffle(found)
    return spark.createDataFrame(found, "n long, k string, t long")


@pytest.fixture(autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def same(a, b):
    def plain(df):
        return sorted(map(repr, (tuple(r) for r in df.collect())))

    assert plain(a) == plain(b)


@pytest.mark.parametrize("keys", [["k"], []])
def test_admission(rows, keys):
    same(admit_monotonic_split(rows, keys, "n", "t"), admit_monotonic(rows, keys, "n", "t"))


def test_numbers(rows):
    same(assign_sequence_split(rows, ["k"], "n", "t"), assign_sequence(rows, ["k"], "n", "t"))
    stored = rows.where("n < 50 AND k IS NOT NULL")
    same(assign_sequence_split(rows, ["k"], "n", "t", stored), assign_sequence(rows, ["k"], "n", "t", stored))


def test_one_series(rows):
    found = {r["n"]: r["t"] for r in assign_sequence_single(rows, "n", "t", first=8).collect()}
    assert found == {i: i + 8 for i in range(3_000)}


def test_places_span_partitions(rows):
    found = places(rows, ["k"], "n").withColumn("part", F.spark_partition_id())
    for key in ("hot", "b", None):
        got = [r["place"] for r in found.where(F.col("k").eqNullSafe(F.lit(key))).orderBy("n").collect()]
        assert got == list(range(len(got)))


def test_no_rows(rows):
    assert admit_monotonic_split(rows.where("false"), ["k"], "n", "t").isEmpty()
    assert assign_sequence_split(rows.where("false"), ["k"], "n", "t").isEmpty()

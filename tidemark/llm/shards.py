"""Contiguous shards of equal byte size, by global prefix sums; DataFrame functions only.

Rows are ordered by id (then by the text's checksum and size) in range partitions.
Each partition's totals are summed; the prefix sums over those few totals give every
partition its offset, and a running sum inside the partition gives every row its
place in the whole.  The row's middle byte falls into one of ``shards`` equal spans,
which is its shard, so shards are contiguous and differ by about one row.

Only (id, size, checksum) is moved: 24 bytes a row, whatever the texts' lengths.
The range partitions are checkpointed, so totals and running sums see the same ones
after a lost executor.  The totals, one row a partition, are the only thing that is
broadcast or meets in one task.

Defined cases: a null text has no bytes and checksum 0; null ids come first; rows
that repeat follow each other in any order (their results are the same set); an
empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import durable

SHARDS = 40
ROW_BYTES = 16
#: Rows in a range partition, about; and the most partitions, which bounds the totals.
PARTITION_ROWS, MAX_PARTITIONS = 4_000, 20_000


def shard(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    spark = documents.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = durable(slim)  # texts are read once: the count, the range's sample and the shuffle take what is left of them
    parts = min(MAX_PARTITIONS, max(least, slim.count() // PARTITION_ROWS))
    order = ["doc_id", "text_crc32", "size"]
    ranged = durable(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("total"))
    up_to = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # at most MAX_PARTITIONS rows
    placed = ranged.withColumns({"upto": F.sum("size").over(up_to), "n": F.count("*").over(up_to)}).join(F.broadcast(offsets), "part")
    # twice the middle of the row, so that all stays in whole numbers
    number = F.expr(f"cast(cast({shards} as decimal(20, 0)) * (2 * (bytes_before + upto) - size) div (2 * total) as int)")
    placed = placed.select(*order, (F.col("rows_before") + F.col("n") - 1).alias("place"), F.least(number, F.lit(shards - 1)).alias("shard"))
    placed = durable(placed)
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


# CRC-32 of each half byte, for the reflected polynomial.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents
), b AS (
  SELECT doc_id, size, list_transform(string_split(x, ''), lambda c: instr('123456789ABCDEF', c)) AS h FROM d
), n AS (
  SELECT doc_id, size, list_prepend(4294967295, list_transform(range(2 * size - 32), lambda i: h[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END])) AS halves FROM b
), k AS (
  SELECT doc_id, size, xor(list_reduce(halves, lambda c, y: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][xor(c & 15, y) + 1])), 4294967295) AS text_crc32 FROM n
), o AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM k
), s AS (
  SELECT *, CAST(least(39, (40 * (2 * upto - size)) // (2 * total)) AS INTEGER) AS shard FROM o
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""

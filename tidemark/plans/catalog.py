"""``QUERIES`` and ``ORACLE_SQL``: every operator over whole tables, and the same in SQL.

``events`` is the series table: series ``event_type``, time ``ts``.  ``orders`` is
the table that arrives out of order: arrival ``o_orderkey``, time ``o_orderdate``,
series ``o_orderpriority``.  Times leave as microseconds since 1970.  Sums are
rounded to 4 places and means to 6, since a distributed sum has no fixed order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import SeriesFull, TidemarkError
from tidemark.functions import equals, micros, time_literal
from tidemark.operators import (
    admit_monotonic,
    admit_monotonic_split,
    assign_sequence,
    assign_sequence_single,
    assign_sequence_split,
    fence_index,
    frame_checksum,
    frames,
    in_order,
    lower_bounds,
    multi_range,
    places,
    range_scan,
    rejects,
    retain_newest,
    retain_oldest,
)
from tidemark.plans import streams
from tidemark.schema import LOG_HEADER_BYTES, Kind, SeriesSchema
from tidemark.series import Series
from tidemark.sources import SeriesStore, decode_logs, encode_logs, header_of, ring_state
from tidemark.storage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: A week, in microseconds: 2024-01-08 to 2024-01-15.
LOW, HIGH = 1_704_672_000_000_000, 1_705_276_800_000_000
DAY, HOUR = 86_400_000_000, 3_600_000_000
KEEP = 100
EVENTS = SeriesSchema.of(time="t", event_id=Kind.I64, t=Kind.I64, user_id=Kind.I64, event_type=Kind.STRING, value=Kind.F64, props=Kind.STRING)
MAX_SQL = "1.7976931348623157e308::DOUBLE"


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def named(df: DataFrame) -> DataFrame:
    """Event rows with the time as microseconds ``t``."""
    return df.select("event_id", micros("ts").alias("t"), "user_id", "event_type", "value", "props")


def week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(range_scan(raw(spark, sf_dir), "ts", time_literal(LOW), time_literal(HIGH)))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", micros("o_orderdate").alias("t"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"sum": F.round("sum", 4), "mean": F.round("mean", 6)})


ROWS = "SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value, props FROM events"
IN_WEEK = "ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'"


def stats_sql(value: str, source: str, keys: str = "") -> str:
    """The statistics' rules in SQL, for a float expression."""
    group = f" GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
SELECT {lead}CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE least(coalesce(min(v) FILTER (NOT isnan(v)), {MAX_SQL}), {MAX_SQL}) END AS min,
  CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE greatest(coalesce(max(v) FILTER (NOT isnan(v)), -{MAX_SQL}), -{MAX_SQL}) END AS max,
  round(coalesce(sum(v), 0.0::DOUBLE), 4) AS sum, count(*) AS count,
  round(CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE sum(v) / count(*) END, 6) AS mean
FROM (SELECT *, CAST({value} AS DOUBLE) AS v FROM {source}){group}"""


# --- scans


@query(ROWS)
def load_all(spark, sf_dir):
    return in_order(named(raw(spark, sf_dir)), "t")


@query("SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def series_count(spark, sf_dir):
    return Series(named(raw(spark, sf_dir)), EVENTS, ["event_type"]).counts()


@query(f"{ROWS} WHERE {IN_WEEK}")
def range_scan_week(spark, sf_dir):
    return week(spark, sf_dir)


@query(f"{ROWS} WHERE ts >= (SELECT min(ts) FROM events WHERE event_id = 100) AND ts < (SELECT min(ts) FROM events WHERE event_id = 200)")
def range_scan_boundary(spark, sf_dir):
    events = raw(spark, sf_dir)
    row = events.where(F.col("event_id").isin(100, 200)).agg(*(F.min(F.when(F.col("event_id") == n, micros("ts"))).alias(f"t{n}") for n in (100, 200))).first()
    return named(range_scan(events, "ts", time_literal(row["t100"]), time_literal(row["t200"])))


@query("SELECT count(*) AS rows FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-08'")
def range_scan_empty(spark, sf_dir):
    return range_scan(raw(spark, sf_dir), "ts", time_literal(HIGH), time_literal(LOW)).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT event_id, epoch_us(ts) AS t, value FROM events")
def projection(spark, sf_dir):
    return named(raw(spark, sf_dir)).select("event_id", "t", "value")


# --- filters


@query(f"{ROWS} WHERE user_id = 7")
def filter_i64(spark, sf_dir):
    return named(raw(spark, sf_dir)).where(equals(EVENTS, "user_id", 7))


@query(f"{ROWS} WHERE value = 12.31::DOUBLE")
def filter_f64(spark, sf_dir):
    return named(raw(spark, sf_dir)).where(equals(EVENTS, "value", 12.31))


@query("SELECT count(*) AS rows FROM (SELECT CASE WHEN value < 1 THEN 'nan'::DOUBLE ELSE value END AS v FROM events) WHERE v = 'nan'::DOUBLE AND NOT isnan(v)")
def filter_f64_nan(spark, sf_dir):
    holes = named(raw(spark, sf_dir)).withColumn("value", F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value")))
    return holes.where(equals(EVENTS, "value", float("nan"))).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT count(*) AS rows FROM (SELECT CASE WHEN value < 1 THEN -0.0::DOUBLE ELSE value END AS v FROM events) WHERE v = 0.0::DOUBLE")
def filter_f64_zero(spark, sf_dir):
    zeros = named(raw(spark, sf_dir)).withColumn("value", F.when(F.col("value") < 1, F.lit(-0.0)).otherwise(F.col("value")))
    return zeros.where(equals(EVENTS, "value", 0.0)).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT event_id, CAST(18446744073709551615::HUGEINT - event_id AS VARCHAR) AS big FROM events WHERE 18446744073709551615::HUGEINT - event_id = 18446744073709551573::HUGEINT")
def filter_u64(spark, sf_dir):
    schema = SeriesSchema.of(time="t", t=Kind.I64, big=Kind.U64)
    big = (F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("event_id").cast("decimal(20,0)")).cast("decimal(20,0)")
    found = named(raw(spark, sf_dir)).withColumn("big", big).where(equals(schema, "big", 2**64 - 1 - 42))
    return found.select("event_id", F.col("big").cast("string").alias("big"))


@query(f"{ROWS} WHERE event_type = 'error'")
def filter_string(spark, sf_dir):
    return named(raw(spark, sf_dir)).where(equals(EVENTS, "event_type", "error"))


@query("SELECT event_id, value > 50 AS large FROM events WHERE value > 50")
def filter_bool(spark, sf_dir):
    schema = SeriesSchema.of(time="t", t=Kind.I64, large=Kind.BOOL)
    return named(raw(spark, sf_dir)).withColumn("large", F.col("value") > 50).where(equals(schema, "large", True)).select("event_id", "large")


@query(f"{ROWS} WHERE {IN_WEEK} AND user_id = 7 AND event_type = 'view'")
def filter_conjunction(spark, sf_dir):
    return Series(week(spark, sf_dir), EVENTS).where(user_id=7, event_type="view").df


@query(f"{ROWS} WHERE value > 40")
def filter_greater(spark, sf_dir):
    return Series(named(raw(spark, sf_dir)), EVENTS).where(F.col("value") > 40).df


# --- statistics


@query(stats_sql("value", f"events WHERE {IN_WEEK}", "event_type"))
def stats_by_series(spark, sf_dir):
    return rounded(Series(week(spark, sf_dir), EVENTS, ["event_type"]).stats("value"))


def _stats(df: DataFrame, kind: Kind, name: str) -> DataFrame:
    return rounded(Series(df, SeriesSchema.of(time="t", **{"t": Kind.I64, name: kind})).stats(name))


@query(stats_sql("value", f"events WHERE {IN_WEEK}"))
def stats_f64(spark, sf_dir):
    return _stats(week(spark, sf_dir), Kind.F64, "value")


@query(stats_sql("user_id", f"events WHERE {IN_WEEK}"))
def stats_i64(spark, sf_dir):
    return _stats(week(spark, sf_dir), Kind.I64, "user_id")


@query("SELECT min, max, count FROM (" + stats_sql("18446744073709551615::HUGEINT - event_id", f"events WHERE {IN_WEEK}") + ")")
def stats_u64(spark, sf_dir):
    big = (F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("event_id").cast("decimal(20,0)")).cast("decimal(20,0)")
    return _stats(week(spark, sf_dir).withColumn("big", big), Kind.U64, "big").select("min", "max", "count")


@query(stats_sql("user_id & 255", "events"))
def stats_u8(spark, sf_dir):
    return _stats(named(raw(spark, sf_dir)).withColumn("small", F.col("user_id").bitwiseAND(255).cast("short")), Kind.U8, "small")


@query(stats_sql("value > 50", "events"))
def stats_bool(spark, sf_dir):
    return _stats(named(raw(spark, sf_dir)).withColumn("large", F.col("value") > 50), Kind.BOOL, "large")


@query(stats_sql("0.0", "events"))
def stats_string(spark, sf_dir):
    return _stats(named(raw(spark, sf_dir)), Kind.STRING, "event_type")


@query(stats_sql("value", "events WHERE ts < TIMESTAMP '1990-01-01'"))
def stats_empty(spark, sf_dir):
    return _stats(named(raw(spark, sf_dir).where(F.col("ts") < time_literal(631_152_000_000_000))), Kind.F64, "value")


@query("SELECT event_type, min, max, isnan(sum) AS nan_sum, count, isnan(mean) AS nan_mean FROM (" + stats_sql("CASE WHEN value < 1 OR event_type = 'error' THEN 'nan'::DOUBLE ELSE value END", "events", "event_type") + ")")
def stats_nan(spark, sf_dir):
    holes = named(raw(spark, sf_dir)).withColumn("value", F.when((F.col("value") < 1) | (F.col("event_type") == "error"), F.lit(float("nan"))).otherwise(F.col("value")))
    found = Series(holes, EVENTS, ["event_type"]).stats("value")
    return found.select("event_type", "min", "max", F.isnan("sum").alias("nan_sum"), "count", F.isnan("mean").alias("nan_mean"))


@query("SELECT event_type, CAST(min AS VARCHAR) = 'inf' AS inf_min, min > 1e308 AS top_min, CAST(max AS VARCHAR) = 'inf' AS inf_max, count FROM (" + stats_sql("'inf'::DOUBLE", "events", "event_type") + ")")
def stats_infinite(spark, sf_dir):
    found = Series(named(raw(spark, sf_dir)).withColumn("value", F.lit(float("inf"))), EVENTS, ["event_type"]).stats("value")
    infinite = F.lit(float("inf"))
    return found.select("event_type", (F.col("min") == infinite).alias("inf_min"), (F.col("min") > 1e308).alias("top_min"), (F.col("max") == infinite).alias("inf_max"), "count")


@query(stats_sql("value", "events WHERE event_id = 5"))
def stats_single(spark, sf_dir):
    return _stats(named(raw(spark, sf_dir)).where("event_id = 5"), Kind.F64, "value")


# --- latest values


@query("SELECT event_type, arg_max(value, ts) AS value, epoch_us(max(ts)) AS timestamp FROM events GROUP BY event_type")
def latest_by_series(spark, sf_dir):
    return Series(named(raw(spark, sf_dir)), EVENTS, ["event_type"]).latest("value")


@query("SELECT arg_max(value, ts) AS value, epoch_us(max(ts)) AS timestamp FROM events")
def latest_f64(spark, sf_dir):
    return Series(named(raw(spark, sf_dir)), EVENTS).latest("value")


@query("SELECT CAST(arg_max(user_id, ts) AS DOUBLE) AS value, epoch_us(max(ts)) AS timestamp FROM events")
def latest_i64(spark, sf_dir):
    return Series(named(raw(spark, sf_dir)), EVENTS).latest("user_id")


@query("SELECT CAST(CAST(arg_max(value > 50, ts) AS INTEGER) AS DOUBLE) AS value, epoch_us(max(ts)) AS timestamp FROM events")
def latest_bool(spark, sf_dir):
    schema = SeriesSchema.of(time="t", t=Kind.I64, large=Kind.BOOL)
    return Series(named(raw(spark, sf_dir)).withColumn("large", F.col("value") > 50), schema).latest("large")


# --- admission, numbering and retention

_AHEAD = "SELECT *, max(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM orders"


@query(f"SELECT o_orderkey, o_orderpriority, epoch_us(o_orderdate) AS t FROM ({_AHEAD}) WHERE most IS NULL OR o_orderdate > most")
def ingest_monotonic(spark, sf_dir):
    return admit_monotonic(orders(spark, sf_dir), ["o_orderpriority"], "o_orderkey", "t")


@query(f"SELECT o_orderpriority, count(*) AS rejected FROM ({_AHEAD}) WHERE o_orderdate <= most GROUP BY o_orderpriority")
def ingest_rejects(spark, sf_dir):
    return rejects(orders(spark, sf_dir), ["o_orderpriority"], "o_orderkey", "t").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("rejected"))


@query("""
WITH stored AS (SELECT o_orderpriority, max(o_orderdate) AS last FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY o_orderpriority),
fresh AS (SELECT o.*, last, max(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most
  FROM orders o LEFT JOIN stored USING (o_orderpriority))
SELECT o_orderkey, o_orderpriority, epoch_us(o_orderdate) AS t FROM fresh WHERE (most IS NULL OR o_orderdate > most) AND (last IS NULL OR o_orderdate > last)""")
def ingest_monotonic_resume(spark, sf_dir):
    rows = orders(spark, sf_dir)
    return admit_monotonic(rows, ["o_orderpriority"], "o_orderkey", "t", rows.where(F.col("t") < 788_918_400_000_000))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS t FROM events")
def ingest_sequence(spark, sf_dir):
    return assign_sequence(named(raw(spark, sf_dir)).select("event_id", "event_type", "t"), ["event_type"], "event_id", "t")


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) + 1000 AS t FROM events")
def ingest_sequence_resume(spark, sf_dir):
    rows = named(raw(spark, sf_dir)).select("event_id", "event_type", "t")
    stored = rows.select("event_type").distinct().withColumn("t", F.lit(1000).cast("long"))
    return assign_sequence(rows, ["event_type"], "event_id", "t", stored)


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS t FROM events")
def ingest_sequence_single(spark, sf_dir):
    return assign_sequence_single(named(raw(spark, sf_dir)).select("event_id", "t"), "event_id", "t")


@query(ORACLE_SQL["ingest_monotonic"])
def ingest_monotonic_split(spark, sf_dir):
    return admit_monotonic_split(orders(spark, sf_dir), ["o_orderpriority"], "o_orderkey", "t")


@query(ORACLE_SQL["ingest_sequence"])
def ingest_sequence_split(spark, sf_dir):
    return assign_sequence_split(named(raw(spark, sf_dir)).select("event_id", "event_type", "t"), ["event_type"], "event_id", "t")


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS place FROM events")
def series_places(spark, sf_dir):
    return places(named(raw(spark, sf_dir)).select("event_id", "event_type", "t"), ["event_type"], "t").drop("t")


def _newest(columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rn FROM events) WHERE rn <= {KEEP}"


@query(_newest("event_id, epoch_us(ts) AS t, user_id, event_type, value, props"))
def retain_last_n(spark, sf_dir):
    return retain_newest(named(raw(spark, sf_dir)), ["event_type"], "t", KEEP)


@query(f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= {KEEP}")
def retain_first_n(spark, sf_dir):
    return retain_oldest(named(raw(spark, sf_dir)), ["event_type"], "event_id", KEEP).select("event_id", "event_type")


@query(f"SELECT event_id, epoch_us(ts) AS t, event_type FROM ({_newest('*')}) WHERE ts >= TIMESTAMP '2024-01-30'")
def ring_range(spark, sf_dir):
    kept = Series(named(raw(spark, sf_dir)), EVENTS, ["event_type"], keep=KEEP)
    return kept.range(1_706_572_800_000_000, 2**62).df.select("event_id", "t", "event_type")


@query(stats_sql("value", f"({_newest('event_type, value')})", "event_type"))
def ring_stats(spark, sf_dir):
    return rounded(Series(named(raw(spark, sf_dir)), EVENTS, ["event_type"], keep=KEEP).stats("value"))


@query(f"SELECT event_type, arg_max(value, t) AS value, max(t) AS timestamp FROM ({_newest('event_type, value, epoch_us(ts) AS t')}) GROUP BY event_type")
def ring_latest(spark, sf_dir):
    return Series(named(raw(spark, sf_dir)), EVENTS, ["event_type"], keep=KEEP).latest("value")


# --- frames, indexes and many ranges

_FRAMES = """SELECT event_type, frame, min(t) AS start, sum(value) AS mean_sum, sum(user_id) AS sum, avg(value) AS mean
FROM (SELECT *, epoch_us(ts) AS t, (row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1) // 100 AS frame FROM events)
GROUP BY event_type, frame HAVING count(*) = 100"""


@query(f"SELECT event_type, frame, start, round(mean_sum, 4) AS mean_sum, CAST(sum AS DOUBLE) AS sum, round(mean, 6) AS mean FROM ({_FRAMES})")
def frame_stats(spark, sf_dir):
    found = frames(named(raw(spark, sf_dir)), ["event_type"], "t", "user_id", "value", 100)
    return found.select("event_type", "frame", "start", F.round("mean_sum", 4).alias("mean_sum"), F.col("sum").cast("double").alias("sum"), F.round("mean", 6).alias("mean"))


@query(f"SELECT count(*) AS frames, round(coalesce(sum(sum + mean), 0), 4) AS checksum FROM ({_FRAMES})")
def frame_totals(spark, sf_dir):
    found = frame_checksum(frames(named(raw(spark, sf_dir)), ["event_type"], "t", "user_id", "value", 100))
    return found.withColumn("checksum", F.round("checksum", 4))


@query("""
SELECT event_type, frame, arg_min(value, t) AS open, max(value) AS high, min(value) AS low, arg_max(value, t) AS close
FROM (SELECT *, epoch_us(ts) AS t, (row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1) // 100 AS frame FROM events) GROUP BY event_type, frame""")
def frame_open_close(spark, sf_dir):
    placed = places(named(raw(spark, sf_dir)).select("event_type", "t", "value"), ["event_type"], "t")
    framed = placed.withColumn("frame", F.floor(F.col("place") / 100).cast("long"))
    return framed.groupBy("event_type", "frame").agg(F.min_by("value", "t").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "t").alias("close"))


@query(f"SELECT event_type, count(*) FILTER (WHERE t < {LOW}) AS t0, count(*) FILTER (WHERE t < {HIGH}) AS t1, count(*) FILTER (WHERE t < 0) AS t2 FROM ({ROWS}) GROUP BY event_type")
def lower_bound(spark, sf_dir):
    return lower_bounds(named(raw(spark, sf_dir)), ["event_type"], "t", [LOW, HIGH, 0])


@query("SELECT event_type, t, place FROM (SELECT event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS place FROM events) WHERE place % 1024 = 0")
def time_fences(spark, sf_dir):
    return fence_index(named(raw(spark, sf_dir)), ["event_type"], "t")


@query(f"""
WITH kinds AS (SELECT DISTINCT event_type FROM events), starts AS (SELECT unnest(range(1704067200000000, 1704067200000000 + 30 * {DAY}, {HOUR})) AS range_start),
ranges AS (SELECT event_type, range_start, range_start + {90 * 60_000_000} AS range_end FROM kinds, starts)
SELECT e.event_type, range_start, count(*) AS rows, round(sum(value), 4) AS sum FROM ({ROWS}) e JOIN ranges r ON e.event_type = r.event_type AND t >= range_start AND t < range_end GROUP BY e.event_type, range_start""")
def multi_range_scan(spark, sf_dir):
    events = named(raw(spark, sf_dir)).select("event_type", "t", "value")
    first = 1_704_067_200_000_000
    kinds = events.select("event_type").distinct()
    ranges = kinds.withColumn("range_start", F.explode(F.sequence(F.lit(first), F.lit(first + 30 * DAY - HOUR), F.lit(HOUR)))).withColumn("range_end", F.col("range_start") + 90 * 60_000_000)
    found = multi_range(events, ranges, ["event_type"], "t", 2 * HOUR)
    return found.groupBy("event_type", "range_start").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("sum"))


# --- stored logs


@query("SELECT event_type AS series, event_id, epoch_us(ts) AS t, value, value > 50 AS large FROM events")
def log_round_trip(spark, sf_dir):
    schema = SeriesSchema.of(time="t", t=Kind.I64, event_id=Kind.I64, value=Kind.F64, large=Kind.BOOL)
    header = header_of(schema)
    rows = named(raw(spark, sf_dir)).withColumn("large", F.col("value") > 50)
    parts = encode_logs(rows, schema, "event_type", part_records=5_000)
    # a later part has no header of its own
    files = parts.select("series", F.when(F.col("part") == 0, F.col("content")).otherwise(F.concat(F.lit(header), F.col("content"))).alias("content"))
    return decode_logs(files, schema, header=header)


LOG = SeriesSchema.of(time="t", t=Kind.I64, event_id=Kind.I64, value=Kind.F64)


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of KEEP records that have wrapped around; each is one part."""
    return encode_logs(named(raw(spark, sf_dir)), LOG, "event_type", capacity=KEEP).select("series", "content")


@query(f"SELECT event_type AS series, event_id, epoch_us(ts) AS t, value FROM ({_newest('*')})")
def log_wrapped(spark, sf_dir):
    return decode_logs(_wrapped(spark, sf_dir), LOG, header=header_of(LOG))


@query(f"""
SELECT event_type AS series, least(count(*), {KEEP}) AS records, epoch_us(max(ts)) AS last, CASE WHEN count(*) < {KEEP} THEN count(*) ELSE count(*) % {KEEP} END AS cursor, count(*) > {KEEP} AND count(*) % {KEEP} > 0 AS wrapped
FROM events GROUP BY event_type""")
def log_recovery(spark, sf_dir):
    return ring_state(_wrapped(spark, sf_dir), LOG, KEEP, header=header_of(LOG))


# --- a series and a store that grow



def _halves(df: DataFrame, arrival: str) -> tuple[DataFrame, DataFrame]:
    """The rows that arrive first, then the others."""
    row = df.agg(F.min(arrival).alias("a"), F.max(arrival).alias("b")).first()
    middle = ((row["a"] or 0) + (row["b"] or 0)) // 2
    return df.where(F.col(arrival) < middle), df.where(F.col(arrival) >= middle)


ARRIVALS = SeriesSchema.of(time="t", t=Kind.I64, o_orderkey=Kind.I64)
EVENT_IDS = SeriesSchema.of(time="t", t=Kind.I64, event_id=Kind.I64)


def _store(spark: SparkSession, schema: SeriesSchema, key: str, **bound) -> SeriesStore:
    """A new store in the shared folder."""
    return SeriesStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4()}", schema, key, **bound)


@query(ORACLE_SQL["ingest_monotonic"])
def series_append(spark, sf_dir):
    first, second = _halves(orders(spark, sf_dir), "o_orderkey")
    empty = first.limit(0).select("o_orderpriority", "t", "o_orderkey")
    return Series(empty, ARRIVALS, ["o_orderpriority"]).append(first, "o_orderkey").append(second, "o_orderkey").df


@query(ORACLE_SQL["ingest_monotonic"])
def store_append(spark, sf_dir):
    store = _store(spark, ARRIVALS, "o_orderpriority")
    for batch in _halves(orders(spark, sf_dir), "o_orderkey"):
        store.append(batch, "o_orderkey")
    return SeriesStore(spark, store.path, ARRIVALS, "o_orderpriority").rows()


@query(ORACLE_SQL["ingest_sequence"])
def store_append_numbered(spark, sf_dir):
    store = _store(spark, EVENT_IDS, "event_type")
    for batch in _halves(named(raw(spark, sf_dir)).select("event_type", "t", "event_id"), "event_id"):
        store.append_numbered(batch, "event_id")
    return store.rows()


@query(_newest("event_id, event_type, epoch_us(ts) AS t"))
def store_ring_compacted(spark, sf_dir):
    """A byte budget of KEEP records; what it keeps goes to another folder."""
    store = _store(spark, EVENT_IDS, "event_type", max_bytes=LOG_HEADER_BYTES + KEEP * EVENT_IDS.record_bytes)
    store.append(named(raw(spark, sf_dir)).select("event_type", "t", "event_id"), "event_id")
    target = f"{store.path}-small"
    store.compact(target)
    return SeriesStore(spark, target, EVENT_IDS, "event_type").rows()


@query("SELECT 0 AS rows_after, count(*) AS rows_before FROM events")
def store_drop(spark, sf_dir):
    """Numbered on the way in: the store takes every row, also those whose times don't increase with the ids."""
    store = _store(spark, EVENT_IDS, "event_type")
    store.append_numbered(named(raw(spark, sf_dir)).select("event_type", "t", "event_id"), "event_id")
    before = store.rows().count()
    store.drop()
    return spark.createDataFrame([(before, store.rows().count())], "rows_before long, rows_after long").selectExpr("cast(rows_after AS int) AS rows_after", "rows_before")


@query(f"SELECT event_type, count(*) > {KEEP} AS raised, least(count(*), {KEEP}) AS rows FROM events GROUP BY event_type")
def store_full(spark, sf_dir):
    """Whether each series, appended alone, is more than a store of KEEP rows takes, and what then is in it."""
    events = named(raw(spark, sf_dir)).select("event_type", "t", "event_id")
    store, out = _store(spark, EVENT_IDS, "event_type", keep=KEEP, stop_when_full=True), []
    for kind in [r[0] for r in events.select("event_type").distinct().collect()]:  # five of them
        own, raised = events.where(F.col("event_type") == kind), False
        try:
            store.append(own, "event_id")
        except SeriesFull:
            raised = True
            store.append(retain_oldest(own, ["event_type"], "event_id", KEEP), "event_id")
        out.append((kind, raised))
    counts = store.rows().groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))
    return spark.createDataFrame(out, "event_type string, raised boolean").join(counts, "event_type")


@query(ORACLE_SQL["stats_by_series"])
def stats_by_index(spark, sf_dir):
    """By the field's index instead of its name."""
    return rounded(Series(week(spark, sf_dir), EVENTS, ["event_type"]).stats(EVENTS.position("value")))


@query("SELECT 'unsigned 8 bit' AS literal, 'refused' AS answer UNION ALL SELECT 'float for an integer', 'refused' UNION ALL SELECT 'unknown field', 'refused' UNION ALL SELECT 'another schema', 'refused' UNION ALL SELECT 'field of a string', 'refused'")
def strict_types(spark, sf_dir):
    """What raises before anything runs."""
    schema = SeriesSchema.of(time="t", t=Kind.I64, small=Kind.U8, value=Kind.F64)
    series = Series(week(spark, sf_dir), EVENTS)
    store = _store(spark, EVENT_IDS, "event_type")
    store.append(named(raw(spark, sf_dir)).select("event_type", "t", "event_id"), "event_id")
    tries = {
        "unsigned 8 bit": lambda: equals(schema, "small", 1),
        "float for an integer": lambda: equals(EVENTS, "user_id", 7.0),
        "unknown field": lambda: series.stats("nothing"),
        "another schema": lambda: SeriesStore(spark, store.path, ARRIVALS, "event_type"),
        "field of a string": lambda: series.latest("event_type"),
    }
    out = []
    for name, attempt in tries.items():
        try:
            attempt()
            out.append((name, "taken"))
        except TidemarkError:
            out.append((name, "refused"))
    return spark.createDataFrame(out, "literal string, answer string")


# --- streams


@query(ORACLE_SQL["ingest_monotonic"])
def stream_monotonic(spark, sf_dir):
    return streams.monotonic(spark, sf_dir)


@query(ORACLE_SQL["ingest_sequence"])
def stream_sequence(spark, sf_dir):
    return streams.sequence(spark, sf_dir)


@query(ORACLE_SQL["latest_by_series"])
def stream_latest(spark, sf_dir):
    return streams.latest(spark, sf_dir)


@query(stats_sql("value", "events", "event_type"))
def stream_stats(spark, sf_dir):
    return rounded(streams.stats(spark, sf_dir))


@query(f"""
SELECT epoch_us(day) AS window_start, event_type, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(*) AS count, round(avg(value), 6) AS mean
FROM (SELECT *, date_trunc('day', ts) AS day FROM events) GROUP BY day, event_type""")
def stream_windows(spark, sf_dir):
    return rounded(streams.windows(spark, sf_dir))


@query(_newest("event_id, event_type, epoch_us(ts) AS t"))
def stream_retained(spark, sf_dir):
    return streams.retained(spark, sf_dir, KEEP)

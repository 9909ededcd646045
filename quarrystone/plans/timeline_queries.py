"""Timeline queries: events on the business axis, orders on the capture axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.keys import stable_key
from quarrystone.functions.timeparse import is_time_field, utc_text, with_time
from quarrystone.operators import timeline
from quarrystone.plans.tables import table


def case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    business = table(spark, sf_dir, "events").select(
        F.lit("business").alias("axis"), stable_key(F.lit("business"), F.col("event_id")).alias("event_id"), micros("ts").alias("sort_key"),
        F.lit(None).cast("string").alias("local_key"), F.col("user_id").alias("record")
    )
    capture = table(spark, sf_dir, "orders").select(
        F.lit("capture"), stable_key(F.lit("capture"), F.col("o_orderkey")), micros("o_orderdate"), F.lit(None).cast("string"), F.col("o_custkey")
    )
    return timeline.with_order_key(business.union(capture))


def timeline_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.with_sequence(case_events(spark, sf_dir)).select("axis", "event_id", "stable_order_key", "stable_sequence")


def timeline_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sequence_gates(timeline.with_sequence(case_events(spark, sf_dir)))


def record_time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.record_bounds(case_events(spark, sf_dir).filter("axis = 'business'"), "record")


def raw_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in ten ways, some of which are no times."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    at = lambda fmt: F.date_format(F.timestamp_micros(us), fmt)
    kind = F.col("event_id") % 10
    raw = (
        F.when(kind == 0, F.floor(us / 1_000_000).cast("string"))
        .when(kind == 1, F.floor(us / 1_000).cast("string"))
        .when(kind == 2, us.cast("string"))
        .when(kind == 3, at("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 4, at("yyyy-MM-dd'T'HH:mm:ss'+08:00'"))
        .when(kind == 5, at("yyyy-MM-dd HH:mm:ss"))
        .when(kind == 6, at("yyyy/MM/dd"))
        .when(kind == 7, F.lit("123456789"))
        .when(kind == 8, F.lit("not-a-time"))
        .otherwise(at("yyyy-MM-dd HH:mm"))
    )
    return e.select("event_id", raw.alias("raw"), F.when(F.col("event_id") % 20 == 5, "+02:00").alias("zone"))


def timestamp_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = with_time(raw_times(spark, sf_dir), "t", "raw", "zone")
    return parsed.select("event_id", "raw", "t.sort_key", utc_text(F.col("t.sort_key")).alias("utc"), "t.local_key", "t.status", "t.basis", "t.precision")


def time_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamp_normalise(spark, sf_dir).groupBy("status", "basis", "precision").agg(F.count("*").alias("events"))


def time_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the columns of all tables count as time fields."""
    names = [(t, c) for t in ("orders", "lineitem", "events", "documents", "part") for c in table(spark, sf_dir, t).columns]
    extra = [("extra", c) for c in ("created_at", "send_time", "time_flag", "open_times", "ship_date", "sender", "timezone", "timestamp")]
    return spark.createDataFrame(names + extra, "table_name string, field string").withColumn("is_time", is_time_field(F.col("field")))


QUERIES = {f.__name__: f for f in (timeline_sequence, timeline_gates, record_time_bounds, timestamp_normalise, time_profile, time_fields)}

EVENTS_SQL = """
ev AS (SELECT 'business' AS axis, sha256('business' || chr(0) || event_id) AS event_id, epoch_us(ts) AS k, user_id AS record FROM events
       UNION ALL SELECT 'capture', sha256('capture' || chr(0) || o_orderkey), epoch_us(o_orderdate), o_custkey FROM orders),
keyed AS (SELECT *, 'A:' || lpad((k::hugeint + 10000000000000000000::hugeint)::varchar, 20, '0') || ':' || axis || ':' || event_id AS stable_order_key FROM ev),
seq AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY stable_order_key, event_id) AS stable_sequence FROM keyed)"""
RAW_SQL = """
raws AS (SELECT event_id, CASE event_id % 10
  WHEN 0 THEN (epoch_us(ts) // 1000000)::varchar WHEN 1 THEN (epoch_us(ts) // 1000)::varchar WHEN 2 THEN epoch_us(ts)::varchar
  WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+08:00') WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 6 THEN strftime(ts, '%Y/%m/%d') WHEN 7 THEN '123456789' WHEN 8 THEN 'not-a-time' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS raw,
  ts, event_id % 10 AS kind, event_id % 20 = 5 AS hinted FROM events),
norm AS (SELECT event_id, raw,
  CASE WHEN kind IN (0, 3) THEN epoch_us(date_trunc('second', ts)) WHEN kind = 1 THEN epoch_us(ts) // 1000 * 1000 WHEN kind = 2 THEN epoch_us(ts)
       WHEN kind = 4 THEN epoch_us(date_trunc('second', ts)) - 28800000000 WHEN kind = 5 AND hinted THEN epoch_us(date_trunc('second', ts)) - 7200000000 END AS sort_key,
  CASE WHEN kind = 5 AND NOT hinted THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000000') WHEN kind = 6 THEN strftime(date_trunc('day', ts), '%Y-%m-%dT00:00:00.000000')
       WHEN kind = 9 THEN strftime(ts, '%Y-%m-%dT%H:%M:00.000000') END AS local_key,
  CASE WHEN kind <= 4 OR hinted THEN 'absolute' WHEN kind IN (5, 6, 9) THEN 'local_unzoned' ELSE 'unparsed' END AS status,
  CASE kind WHEN 0 THEN 'epoch_seconds' WHEN 1 THEN 'epoch_milliseconds' WHEN 2 THEN 'epoch_microseconds' WHEN 3 THEN 'iso_with_offset' WHEN 4 THEN 'iso_with_offset'
       WHEN 5 THEN CASE WHEN hinted THEN 'local_with_sibling_offset' ELSE 'local_datetime' END WHEN 6 THEN 'local_datetime' WHEN 9 THEN 'local_datetime' ELSE 'unknown' END AS basis,
  CASE kind WHEN 0 THEN 'second' WHEN 1 THEN 'millisecond' WHEN 2 THEN 'microsecond' WHEN 3 THEN 'second' WHEN 4 THEN 'second' WHEN 5 THEN 'second' WHEN 6 THEN 'day' WHEN 9 THEN 'minute' ELSE 'unknown' END AS precision
  FROM raws)"""

ORACLES = {
    "timeline_sequence": f"WITH {EVENTS_SQL} SELECT axis, event_id, stable_order_key, stable_sequence FROM seq",
    "timeline_gates": f"""WITH {EVENTS_SQL}, b AS (SELECT *, lag(k) OVER (PARTITION BY axis ORDER BY stable_sequence) > k AS back FROM seq)
SELECT axis, count(*) AS events, min(stable_sequence) = 1 AND max(stable_sequence) = count(*) AND count(DISTINCT stable_sequence) = count(*) AS contiguous,
       count(*) FILTER (WHERE back) AS inversions FROM b GROUP BY ALL""",
    "record_time_bounds": "SELECT user_id AS record, count(*) AS events, min(epoch_us(ts)) AS first_event_sort_key, max(epoch_us(ts)) AS last_event_sort_key FROM events GROUP BY ALL",
    "timestamp_normalise": f"WITH {RAW_SQL} SELECT event_id, raw, sort_key, strftime(make_timestamp(sort_key), '%Y-%m-%dT%H:%M:%S.%fZ') AS utc, local_key, status, basis, precision FROM norm",
    "time_profile": f"WITH {RAW_SQL} SELECT status, basis, precision, count(*) AS events FROM norm GROUP BY ALL",
    "time_fields": r"""
WITH n AS (
  SELECT table_name, column_name AS field FROM (
    SELECT 'orders' AS table_name, column_name FROM (DESCRIBE orders) UNION ALL SELECT 'lineitem', column_name FROM (DESCRIBE lineitem)
    UNION ALL SELECT 'events', column_name FROM (DESCRIBE events) UNION ALL SELECT 'documents', column_name FROM (DESCRIBE documents) UNION ALL SELECT 'part', column_name FROM (DESCRIBE part))
  UNION ALL SELECT 'extra', unnest(['created_at', 'send_time', 'time_flag', 'open_times', 'ship_date', 'sender', 'timezone', 'timestamp']))
SELECT table_name, field, field NOT IN ('time_flag', 'sender', 'timezone') AND NOT regexp_matches(field, '(_flag|_status|_timezone|_times)$')
  AND (field IN ('date', 'time', 'timestamp', 'datetime') OR regexp_matches(field, '(_time|_date|_timestamp|_datetime|_at)$')) AS is_time FROM n""",
}

"""Timestamps from mixed raw values, with what is known of their zone kept apart from what is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Epoch bands (seconds 2000-01-01 to 2100-01-01 and the same in finer units).
EPOCH_UNITS = (("second", 1, 1_000_000), ("millisecond", 1_000, 1_000), ("microsecond", 1_000_000, 1), ("nanosecond", 1_000_000_000, None))
EPOCH_LOW, EPOCH_HIGH = 946684800, 4102444800
#: Names of time fields and of fields that only look like them.
TIME_NAMES = ("date", "time", "timestamp", "datetime")
TIME_ENDINGS = ("_time", "_date", "_timestamp", "_datetime", "_at")
NOT_TIME_ENDINGS = ("_flag", "_status", "_timezone", "_times")
NOT_TIME_NAMES = (
    "timezone", "time_zone", "time_flag", "times_flag", "send_status", "sender", "receive_origin_sender", "delay_send_flag", "stat_open_times_flag",
    "stat_open_times_unreply_flag"
)

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?$"
ISO_ZONED = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)(Z|z|[+-]\d{2}:?\d{2})$"
SLASHED = r"^\d{4}/\d{1,2}/\d{1,2}( \d{1,2}:\d{2}:\d{2})?$"


def is_time_field(key: Column) -> Column:
    """key: a normalised field name."""
    ends = lambda endings: F.rlike(key, F.lit("(" + "|".join(endings) + ")$"))
    return ~key.isin(*NOT_TIME_NAMES) & ~ends(NOT_TIME_ENDINGS) & (key.isin(*TIME_NAMES) | ends(TIME_ENDINGS))


def offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC of Z, UTC, GMT or +-HH:MM up to 14 hours; null for all else."""
    z = F.upper(F.trim(zone))
    sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(z, r"[^0-9]", "")
    minutes = F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")
    shaped = F.rlike(z, F.lit(r"^[+-]\d{2}:?\d{2}$")) & (minutes <= 14 * 60)
    return F.when(z.isin("Z", "UTC", "GMT"), F.lit(0)).when(shaped, sign * minutes)


def _local_micros(text: Column) -> Column:
    """Microseconds of a local time, as if it were UTC; null where it is no valid time."""
    iso = F.regexp_replace(F.regexp_replace(text, ",", "."), "T", " ")
    parts = F.split(F.get(F.split(text, " "), 0), "/")
    slashed = F.concat(
        F.get(parts, 0), F.lit("-"), F.lpad(F.get(parts, 1), 2, "0"), F.lit("-"), F.lpad(F.get(parts, 2), 2, "0"),
        F.when(F.contains(text, F.lit(" ")), F.concat(F.lit(" "), F.lpad(F.get(F.split(text, " "), 1), 8, "0"))).otherwise("")
    )
    cast = lambda c: F.unix_micros(c.try_cast("timestamp_ntz").cast("timestamp"))
    return F.when(F.rlike(text, F.lit(ISO)), cast(iso)).when(F.rlike(text, F.lit(SLASHED)), cast(slashed))


def _parsed(text: Column, zone_hint: Column | None) -> Column:
    """What a trimmed text can be read as, in microseconds: struct(key, unit) of an epoch, zoned, hinted, local."""
    number = F.when(F.rlike(text, F.lit(r"^-?\d{10,19}(\.\d+)?$")), text.cast("decimal(38,9)"))
    size = F.abs(number)
    unit = key = F.lit(None)
    for name, scale, micros in reversed(EPOCH_UNITS):
        inside = (size >= F.lit(EPOCH_LOW * scale).cast("decimal(38,9)")) & (size <= F.lit(EPOCH_HIGH * scale).cast("decimal(38,9)"))
        unit = F.when(inside, F.lit(name)).otherwise(unit)
        value = F.floor(number / 1000) if micros is None else F.floor(number * micros)
        key = F.when(inside, value.cast("long")).otherwise(key)
    minute = F.lit(60_000_000).cast("long")
    zoned = _local_micros(F.regexp_extract(text, ISO_ZONED, 1)) - offset_minutes(F.regexp_extract(text, ISO_ZONED, 2)) * minute
    local = _local_micros(text)
    beside = offset_minutes(zone_hint) if zone_hint is not None else F.lit(None).cast("int")
    return F.struct(key.cast("long").alias("key"), unit.cast("string").alias("unit"), zoned.alias("zoned"), local.alias("local"), (beside * minute).alias("beside"))


def _decided(text: Column, p: Column) -> Column:
    """struct(sort_key, local_key, status, basis, precision) of what _parsed() has found."""
    key, local, hinted = p["key"], p["local"], p["local"] - p["beside"]
    sort_key = F.coalesce(key, p["zoned"], hinted)
    basis = (
        F.when(key.isNotNull(), F.concat(F.lit("epoch_"), p["unit"], F.lit("s"))).when(p["zoned"].isNotNull(), "iso_with_offset")
        .when(hinted.isNotNull(), "local_with_sibling_offset").when(local.isNotNull(), "local_datetime").otherwise("unknown")
    )
    precision = (
        F.when(key.isNotNull(), p["unit"])
        .when(F.rlike(text, F.lit(r"(?i)[.,]\d+(Z|[+-]\d\d:?\d\d)?$")), "fractional_second")
        .when(F.rlike(text, F.lit(r"\d{1,2}:\d{2}:\d{2}")), "second")
        .when(F.rlike(text, F.lit(r"\d{1,2}:\d{2}")), "minute")
        .when(F.rlike(text, F.lit(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}")), "day")
        .otherwise("unknown")
    )
    status = F.when(sort_key.isNotNull(), "absolute").when(local.isNotNull(), "local_unzoned").otherwise("unparsed")
    local_key = F.when(sort_key.isNull() & local.isNotNull(), F.date_format(F.timestamp_micros(local), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.struct(sort_key.alias("sort_key"), local_key.alias("local_key"), status.alias("status"), basis.alias("basis"), precision.alias("precision"))


def normalised_time(raw: Column, zone_hint: Column | None = None) -> Column:
    """with_time() as one expression, for a value or two; what is said about a text parses it anew each time."""
    text = F.trim(raw)
    return _decided(text, _parsed(text, zone_hint))


def with_time(rows: DataFrame, name: str, raw: str, zone: str | None = None) -> DataFrame:
    """rows with struct(sort_key, local_key, status, basis, precision) of a raw string, as name.

    A number of 10 to 19 digits counts as an epoch if it lies in one of the bands; a time with an offset is absolute, as is
    a local one with an offset beside it; any other local time stays local and is never taken for UTC.  Each text is parsed in one projection and
    judged in the next, so nothing is parsed again for each thing that is said about it."""
    text = rows.withColumn("_text", F.trim(F.col(raw)))
    parsed = text.withColumn("_parsed", _parsed(F.col("_text"), F.col(zone) if zone else None))
    return parsed.withColumn(name, _decided(F.col("_text"), F.col("_parsed"))).drop("_text", "_parsed")


def utc_text(sort_key: Column) -> Column:
    return F.date_format(F.timestamp_micros(sort_key), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def order_key(sort_key: Column, local_key: Column, axis: Column, event_id: Column) -> Column:
    """A: absolute before L: local before Z: unknown; every key ends with the axis and the event."""
    shifted = F.lpad((sort_key.cast("decimal(20,0)") + F.lit("10000000000000000000").cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.when(sort_key.isNotNull(), F.concat_ws(":", F.lit("A"), shifted, axis, event_id)).when(local_key.isNotNull(), F.concat_ws(":", F.lit("L"), local_key, axis, event_id)).otherwise(F.concat_ws(":", F.lit("Z"), axis, event_id))

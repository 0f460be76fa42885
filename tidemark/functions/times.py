"""Timestamps on the wire: UTC text, strict and lenient parsing, day buckets, feed dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?"
_OFFSET = r"(Z|z|[+-]\d{2}(:?\d{2})?)$"


def parse_utc(text: Column) -> Column:
    """An ISO timestamp with an offset as a timestamp; null without one (Spark alone would accept naive texts)."""
    return F.when(text.rlike(_ISO + _OFFSET), F.try_to_timestamp(text))


def parse_lenient(text: Column) -> Column:
    """As parse_utc, but a text without an offset is in UTC."""
    return F.when(text.rlike(_ISO + r"\s*(" + _OFFSET[:-1] + r")?$") | text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text))


def required(value: Column, field: str) -> Column:
    """``value``, or an error that names the field where it is null."""
    return F.coalesce(value, F.raise_error(F.lit(f"{field} must be an ISO timestamp with an offset")).cast("timestamp"))


def utc_text(value: Column) -> Column:
    """ISO text ending in Z, whatever the session's zone: no fraction where it is zero, else six digits."""
    wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz"))
    micros = F.pmod(F.unix_micros(value), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def day_bucket(published: Column) -> Column:
    """The UTC day of a publication time, its leading date if it does not parse, else ``unknown``."""
    text = F.trim(F.coalesce(published, F.lit("")))
    day = F.nullif(F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}", 0), F.lit(""))
    return F.coalesce(F.date_format(parse_lenient(text), "yyyy-MM-dd"), day, F.lit("unknown"))


def feed_date(text: Column) -> Column:
    """An RFC 2822 date as a timestamp, the weekday dropped; null if it does not parse."""
    bare = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""))
    zoned = F.regexp_replace(bare, r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss")))

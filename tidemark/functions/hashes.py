"""Identity hashes: SHA-256 over canonical texts and sorted-key JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import WHITE, normalize_title, ticker_list
from tidemark.functions.times import day_bucket
from tidemark.functions.urls import normalize_url


def _json(*fields: Column) -> Column:
    """Compact JSON with nulls; the fields come in the order of their names."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def content_hash(title: Column, url: Column, published: Column) -> Column:
    """Title and day; without a day title and URL; without a title the URL."""
    name, day, has_url = normalize_title(title), day_bucket(published), F.coalesce(url, F.lit("")) != ""
    by_title = F.when(day != "unknown", F.concat(F.lit("title:"), name, F.lit("|day:"), day))
    by_title = by_title.when(has_url, F.concat(F.lit("title:"), name, F.lit("|url:"), normalize_url(url))).otherwise(F.concat(F.lit("title:"), name, F.lit("|day:unknown")))
    by_url = F.when(has_url, F.concat(F.lit("url:"), normalize_url(url))).otherwise(F.lit(""))
    return F.sha2(F.when(name != "", by_title).otherwise(by_url), 256)


def legacy_hash(title: Column, url: Column) -> Column:
    """The older hash: lower-case title without final punctuation, else the lower-case URL."""
    name = F.regexp_replace(F.regexp_replace(F.trim(F.lower(title)), WHITE + "+", " "), "[.,!?;:]+$", "")
    return F.sha2(F.when((name == "") & (F.coalesce(url, F.lit("")) != ""), F.lower(F.trim(url))).otherwise(name), 256)


def observation_hash(source: Column, title: Column, url: Column, tickers: Column) -> Column:
    return F.sha2(_json(F.lower(F.trim(source)).alias("source"), ticker_list(tickers).alias("source_tickers"), F.trim(title).alias("title"), normalize_url(url).alias("url")), 256)


def change_hash(operation: Column, news_id: Column, content: Column, updated: Column) -> Column:
    return F.sha2(_json(content.alias("content_hash"), news_id.cast("long").alias("news_id"), operation.alias("operation"), updated.alias("updated_at")), 256)


def calendar_event_id(scheduled: Column, country: Column, title: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.coalesce(scheduled, F.lit("")), F.upper(F.coalesce(country, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))), 256)


def snapshot_token(fetched: Column, stale: Column, payload: Column) -> Column:
    return F.concat(F.lit("cal_"), F.substring(F.sha2(F.concat_ws(":", fetched, stale.cast("int").cast("string"), payload), 256), 1, 40))


#: Ordinals of a leaf of an ordered digest.
LEAF = 1_024


def ordered_digest(rows: DataFrame, ordinal: str, value: str, *by: str) -> DataFrame:
    """(by, digest): one SHA-256 of the ``value`` texts of each group in the order of their ``ordinal`` (from 1; all rows, where
    there is no ``by``): the digest of the digests of LEAF ordinals each.

    Leaves are grouped by their range of ordinals, so no task sees a group whole, and the digest is the same however rows are
    dealt to partitions. Without rows and ``by`` it is the digest of an empty text.
    """
    joined = lambda order, text: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), ","), 256)
    leaves = rows.groupBy(*by, F.floor((F.col(ordinal) - 1) / LEAF).alias("_leaf")).agg(joined(ordinal, value).alias("_digest"))
    return leaves.groupBy(*by).agg(joined("_leaf", "_digest").alias("digest"))

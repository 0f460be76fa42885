"""Feed sources: landed JSON and RSS files to records of one schema.

Polling leaves each response as a file; these readers parse, normalise and cap them. A record has source,
title, summary, url, image_url, published_at (as text) and source_tickers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.hashes import content_hash, legacy_hash
from tidemark.functions.text import clean_text, ticker_list
from tidemark.functions.times import feed_date, parse_utc, required, utc_text
from tidemark.functions.urls import normalize_url

RECORD = ("source", "title", "summary", "url", "image_url", "published_at", "source_tickers")
RAW = {
    "finnhub": "headline string, url string, datetime long, related string, source string, summary string, image string",
    "massive": "title string, article_url string, published_utc string, publisher struct<name:string>, tickers array<string>, description string, image_url string",
    "newsapi": "title string, url string, description string, urlToImage string, publishedAt string, source struct<name:string>",
    "gnews": "title string, url string, description string, image string, publishedAt string, source struct<name:string>",
    "rss": "title string, link string, pubDate string, source string, category array<struct<_domain:string,_VALUE:string>>",
}


def _none() -> Column:
    return F.array().cast("array<string>")


def _records(rows: DataFrame, **columns: Column) -> DataFrame:
    """RECORD columns of rows that have a title and a URL; raw columns in ``_keep`` stay."""
    keep = [c for c in ("_feed", "_at") if c in rows.columns]
    out = rows.select(*keep, *[columns[c].alias(c) for c in RECORD])
    return out.where((F.col("title") != "") & (F.col("url") != ""))


def finnhub(raw: DataFrame) -> DataFrame:
    stamp = F.when(F.coalesce("datetime", F.lit(0)) != 0, utc_text(F.timestamp_seconds("datetime")))
    related = F.filter(F.transform(F.split(F.coalesce("related", F.lit("")), ","), lambda t: F.upper(F.trim(t))), lambda t: t != "")
    return _records(raw, source=F.concat(F.lit("finnhub/"), F.coalesce("source", F.lit("unknown"))), title=clean_text(F.col("headline"), ""), summary=clean_text(F.col("summary")), url=clean_text(F.col("url"), ""), image_url=F.nullif("image", F.lit("")), published_at=stamp, source_tickers=F.slice(related, 1, 100))


def massive(raw: DataFrame) -> DataFrame:
    """A text without Z and without + gets a Z, so a negative offset becomes malformed and is nulled later."""
    stamp = F.coalesce("published_utc", F.lit(""))
    stamp = F.when((stamp != "") & ~F.endswith(stamp, F.lit("Z")) & ~F.contains(stamp, F.lit("+")), F.concat(stamp, F.lit("Z"))).otherwise(stamp)
    tickers = F.transform(F.filter(F.slice(F.coalesce("tickers", _none()), 1, 100), lambda t: F.coalesce(t, F.lit("")) != ""), F.upper)
    return _records(raw, source=F.concat(F.lit("massive/"), F.coalesce("publisher.name", F.lit("Massive"))), title=clean_text(F.col("title"), ""), summary=F.nullif(F.substring(clean_text(F.col("description"), ""), 1, 500), F.lit("")), url=clean_text(F.col("article_url"), ""), image_url=F.col("image_url"), published_at=stamp, source_tickers=tickers)


def newsapi(raw: DataFrame, label: str) -> DataFrame:
    name = F.coalesce(F.nullif("source.name", F.lit("")), F.lit(label))
    rows = _records(raw, source=F.concat(F.lit("newsapi/"), name), title=clean_text(F.col("title"), ""), summary=clean_text(F.col("description")), url=clean_text(F.col("url"), ""), image_url=F.nullif("urlToImage", F.lit("")), published_at=F.nullif("publishedAt", F.lit("")), source_tickers=_none())
    return rows.where("title <> '[Removed]'")


def gnews(raw: DataFrame, label: str) -> DataFrame:
    name = F.coalesce(F.nullif("source.name", F.lit("")), F.lit(label))
    return _records(raw, source=F.concat(F.lit("gnews/"), name), title=clean_text(F.col("title"), ""), summary=clean_text(F.col("description")), url=clean_text(F.col("url"), ""), image_url=F.nullif("image", F.lit("")), published_at=F.nullif("publishedAt", F.lit("")), source_tickers=_none())


def without_source(title: Column, source: Column) -> Column:
    """``title`` up to the last ` - source`, trimmed; unchanged without one."""
    mark = F.concat(F.lit(" - "), source)
    after = F.length(F.call_function("substring_index", title, mark, F.lit(-1))) + F.length(mark)
    return F.when(F.contains(title, mark), F.trim(title.substr(F.lit(1), F.length(title) - after))).otherwise(title)


def google(items: DataFrame) -> DataFrame:
    """The date is written with a Z whatever its offset; one that does not parse stays as it is."""
    source = clean_text(F.col("source"), "Google News")
    local = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.col("pubDate"), r"^\s*[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|UT|Z|[+-]\d{4})$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    stamp = F.coalesce(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("pubDate"), F.lit(""))
    return _records(items, source=F.concat(F.lit("google/"), source), title=without_source(clean_text(F.col("title"), ""), source), summary=F.lit(None).cast("string"), url=clean_text(F.col("link"), ""), image_url=F.lit(None).cast("string"), published_at=stamp, source_tickers=_none())


def seekingalpha(items: DataFrame, kind: str = "breaking") -> DataFrame:
    """Symbols among the categories are tickers; the first six are the summary. Dates are converted to UTC."""
    named = F.filter(F.coalesce("category", F.array().cast("array<struct<_domain:string,_VALUE:string>>")), lambda c: F.contains(F.coalesce(c["_domain"], F.lit("")), F.lit("symbol")) & (F.coalesce(c["_VALUE"], F.lit("")) != ""))
    tickers = F.transform(named, lambda c: F.upper(c["_VALUE"]))
    summary = F.when(F.size(tickers) > 0, F.concat(F.lit("["), F.array_join(F.slice(tickers, 1, 6), ", "), F.lit("]")))
    stamp = F.coalesce(utc_text(feed_date(F.col("pubDate"))), clean_text(F.col("pubDate"), ""), F.lit(""))
    return _records(items, source=F.lit(f"seekingalpha/{kind}"), title=clean_text(F.col("title"), ""), summary=summary, url=clean_text(F.col("link"), ""), image_url=F.lit(None).cast("string"), published_at=stamp, source_tickers=F.slice(tickers, 1, 100))


def read_json(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Landed responses, one JSON list a file; anything but a list of objects is an error."""
    return spark.read.schema(RAW[source]).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_rss(spark: SparkSession, path: str, item: str = "item") -> DataFrame:
    return spark.read.format("xml").schema(RAW["rss"]).option("rowTag", item).load(path).withColumn("_feed", F.input_file_name())


def capped(items: DataFrame, most: int = 30, feed: str = "_feed", order: str = "_at") -> DataFrame:
    """The first ``most`` items of each feed."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(feed).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def first_seen(records: DataFrame, key: str, order: str = "_at") -> DataFrame:
    """The first record of each title or URL."""
    names = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("r")).select(key, "r.*").select(*records.columns)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@dataclass(frozen=True)
class Source:
    name: str
    parse: Callable[[DataFrame], DataFrame]
    needs_key: bool = False
    group: str | None = None


REGISTRY = {
    s.name: s
    for s in (
        Source("finnhub", finnhub, True), Source("massive", massive, True), Source("google", google),
        Source("seekingalpha_breaking", lambda d: seekingalpha(d, "breaking"), group="seekingalpha"), Source("seekingalpha_daily", lambda d: seekingalpha(d, "daily"), group="seekingalpha"),
        Source("newsapi", lambda d: newsapi(d, "NewsAPI"), True), Source("gnews", lambda d: gnews(d, "GNews"), True),
    )
}


def prepared(records: DataFrame, fetched: Column) -> DataFrame:
    """Records ready to insert: canonical URL, UTC times, hashes, tickers.

    The hash is of the publication text as it came; a text without an offset is then nulled, so such an item's
    day is that of its fetch. A record without source, title or URL is an error.
    """
    whole = F.coalesce((F.trim("source") != "") & (F.trim("title") != "") & (F.trim("url") != ""), F.lit(False))
    rows = records.withColumn("source", F.when(whole, F.trim("source")).otherwise(F.raise_error(F.lit("source, title, and url are required")).cast("string")))
    title, url, published = F.trim("title"), F.trim("url"), F.col("published_at")
    keep = [c for c in ("_feed", "_at", "pos") if c in records.columns]
    return rows.select(
        *keep, F.substring("source", 1, 500).alias("source"), F.substring(title, 1, 4_000).alias("title"), F.substring("summary", 1, 50_000).alias("summary"), F.substring(normalize_url(url), 1, 8_000).alias("url"),
        F.substring(F.nullif("image_url", F.lit("")), 1, 8_000).alias("image_url"), parse_utc(published).alias("published_at"), required(fetched, "fetched_at").alias("fetched_at"), ticker_list(F.col("source_tickers")).alias("source_tickers"),
        content_hash(title, url, published).alias("content_hash"), legacy_hash(title, url).alias("legacy_hash"), required(fetched, "fetched_at").alias("updated_at"), title.alias("original_title"), url.alias("original_url"),
    )

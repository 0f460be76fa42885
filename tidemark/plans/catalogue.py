"""The registered queries of the feed engine and their SQL counterparts.

The tables play the engine's roles: ``events`` is the change log and the observation log (sequence event_id + 1,
key user_id, availability ts, source event_type, ``error`` a tombstone), ``pages`` are feed items, ``documents``
titles and texts, ``orders`` calendar candidates and entities, ``lineitem`` and ``customer`` what refers to them.
Times without a zone stay without one, so results do not depend on the session's zone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions import hashes, text, times, urls
from tidemark.operators import calendar, changes, dedup, health, migrate, retention, schema, store
from tidemark.plans import paging
from tidemark.sources import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF, AFTER = "2024-01-20 00:00:00", "2024-01-10 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _at(value: str) -> Column:
    return F.to_timestamp_ntz(F.lit(value))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select(
        (F.col("event_id") + 1).alias("change_sequence"), F.col("user_id").alias("news_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"),
        F.col("event_type").alias("source"), F.col("ts").alias("available_at"), "value",
    )


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select((F.col("event_id") + 1).alias("observation_id"), F.col("user_id").alias("canonical_news_id"), F.col("event_type").alias("source"), F.col("ts").alias("observed_at"))


LOG = "log AS (SELECT event_id + 1 AS change_sequence, user_id AS news_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS operation, event_type AS source, ts AS available_at, value FROM events)"
_ROW = ("change_sequence", "news_id", "operation", "source")
_IN = f"available_at <= TIMESTAMP '{AS_OF}'"


# The change log.


@query(f"WITH {LOG} SELECT coalesce(max(change_sequence), 0)::BIGINT AS watermark FROM log WHERE {_IN}")
def changes_watermark(spark, d):
    return changes.watermark(_log(spark, d), _at(AS_OF))


# Nothing of a window is pinned: the watermark is the log's at AS_OF, the checkpoint its watermark at AFTER, and the
# floor the last row of the first page.

_MARK = "(SELECT coalesce(max(change_sequence), 0) FROM log WHERE available_at <= TIMESTAMP '{0}')"
_FRESH = f"FROM log WHERE {_IN} AND available_at > TIMESTAMP '{AFTER}' AND change_sequence <= {_MARK.format(AS_OF)}"


def _mark(log: DataFrame, at: str) -> int:
    return changes.watermark(log, _at(at)).first()[0]


def _fresh(log: DataFrame, floor: int = 0) -> DataFrame:
    return changes.window(log, watermark=_mark(log, AS_OF), as_of=_at(AS_OF), after=_at(AFTER), floor=floor)


@query(f"WITH {LOG} SELECT change_sequence, news_id, operation, source {_FRESH} ORDER BY 1 LIMIT 51")
def changes_page_window(spark, d):
    return changes.page(_fresh(_log(spark, d)), 50).select(*_ROW)


@query(f"WITH {LOG} SELECT change_sequence, news_id, operation, source FROM log WHERE {_IN} AND change_sequence > {_MARK.format(AFTER)} AND change_sequence <= {_MARK.format(AS_OF)} ORDER BY 1 LIMIT 501")
def changes_page_checkpoint(spark, d):
    log = _log(spark, d)
    return changes.page(changes.window(log, watermark=_mark(log, AS_OF), as_of=_at(AS_OF), after=_at(AFTER), checkpoint=_mark(log, AFTER)), 500).select(*_ROW)


@query(f"WITH {LOG} SELECT change_sequence, news_id, operation, source {_FRESH} AND change_sequence > (SELECT coalesce(max(change_sequence), 0) FROM (SELECT change_sequence {_FRESH} ORDER BY 1 LIMIT 50)) ORDER BY 1 LIMIT 51")
def changes_next_page(spark, d):
    log = _log(spark, d)
    floor = changes.page(_fresh(log), 49).agg(F.coalesce(F.max("change_sequence"), F.lit(0))).first()[0]  # the 50 rows shown
    return changes.page(_fresh(log, floor), 50).select(*_ROW)


_STATE = f"WITH {LOG} SELECT news_id, change_sequence, operation, source FROM log WHERE {_IN} QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY change_sequence DESC) = 1"


@query(_STATE)
def state_as_of(spark, d):
    return changes.state_as_of(_log(spark, d), _at(AS_OF)).select("news_id", "change_sequence", "operation", "source")


@query(f"SELECT * FROM ({_STATE}) WHERE operation <> 'delete'")
def live_as_of(spark, d):
    return changes.state_as_of(_log(spark, d), _at(AS_OF), live=True).select("news_id", "change_sequence", "operation", "source")


_EVIDENCE = """
  firsts AS (SELECT user_id, lower(event_type) AS k, min(event_id) AS o, min(ts) AS seen FROM events GROUP BY 1, 2),
  met AS (SELECT l.change_sequence, f.o, f.seen, e.event_type FROM log l JOIN firsts f ON f.user_id = l.news_id AND f.seen <= l.available_at JOIN events e ON e.event_id = f.o)"""


@query(f"WITH {LOG}, {_EVIDENCE} SELECT change_sequence, string_agg(event_type, ',' ORDER BY seen, o) AS sources, count(*)::BIGINT AS source_count FROM met GROUP BY 1")
def source_evidence_asof(spark, d):
    found = changes.source_evidence(_log(spark, d), _observations(spark, d))
    return found.select("change_sequence", F.array_join("sources", ",").alias("sources"), "source_count")


# One entity's evidence goes by the number of an observation alone; here it is numbered backwards in time.


@query(f"SELECT user_id AS news_id, string_agg(event_type, ',' ORDER BY o) AS sources FROM (SELECT user_id, event_type, min(100000000 - event_id) AS o FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2) GROUP BY 1")
def source_evidence_by_key(spark, d):
    seen = _observations(spark, d).withColumn("observation_id", 100_000_001 - F.col("observation_id"))
    return changes.evidence_by_key(seen, _at(AS_OF)).select("news_id", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {LOG}, {_EVIDENCE} SELECT change_sequence, string_agg(event_type, ',' ORDER BY seen, o) AS sources, count(*)::BIGINT AS source_count FROM met GROUP BY 1")
def source_evidence_kept_up(spark, d):
    """As source_evidence_asof, from the first sightings up to AFTER and the observations since then alone."""
    seen = _observations(spark, d)
    known = changes.first_sightings(seen.where(F.col("observed_at") <= _at(AFTER)))
    found = changes.source_evidence(_log(spark, d), changes.merged_sightings(known, seen.where(F.col("observed_at") > _at(AFTER))))
    return found.select("change_sequence", F.array_join("sources", ",").alias("sources"), "source_count")


@query(f"""WITH {LOG}, {_EVIDENCE}, n AS (SELECT change_sequence, count(*) AS n FROM met GROUP BY 1)
SELECT l.change_sequence AS sequence, l.operation, l.news_id, CASE WHEN operation = 'upsert' THEN n.n END::BIGINT AS source_count FROM log l LEFT JOIN n USING (change_sequence)""")
def change_envelopes(spark, d):
    log = _log(spark, d)
    blank = {c: F.lit(None).cast("string") for c in ("title", "summary", "url", "image_url", "published_at", "fetched_at", "source_tickers", "content_hash", "updated_at")}
    out = changes.envelopes(log.withColumns(blank), _observations(spark, d))
    return out.select("sequence", "operation", "news_id", F.col("news.source_count").cast("long").alias("source_count"))


@query(f"WITH {LOG} SELECT change_sequence, news_id FROM log WHERE available_at >= TIMESTAMP '{AS_OF}' OR change_sequence IN (SELECT max(change_sequence) FROM log GROUP BY news_id)")
def change_compaction(spark, d):
    return changes.compacted(_log(spark, d), _at(AS_OF)).select("change_sequence", "news_id")


@query("""WITH r AS (SELECT event_id + 1 AS sequence, props, octet_length(encode(to_json({'sequence': event_id + 1, 'props': props})::VARCHAR)) + 1 AS size FROM events ORDER BY event_id LIMIT 501)
SELECT sequence, octet_length(encode(props))::BIGINT AS size FROM r QUALIFY sum(size) OVER (ORDER BY sequence) < 12000""")
def byte_bounded_page(spark, d):
    rows = changes.page(_read(spark, d, "events").select((F.col("event_id") + 1).alias("change_sequence"), "props"), paging.MOST_ROWS)
    return paging.bounded(rows.withColumnRenamed("change_sequence", "sequence"), 12_000).select("sequence", F.octet_length("props").cast("long").alias("size"))


@query(f"WITH {LOG} SELECT strftime(available_at, '%Y-%m-%d') AS day, operation, count(*)::BIGINT AS n FROM log GROUP BY 1, 2")
def change_activity(spark, d):
    return _log(spark, d).groupBy(F.date_format("available_at", "yyyy-MM-dd").alias("day"), "operation").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT event_id, user_id, event_type, min(event_id) OVER (PARTITION BY user_id, event_type) AS o, min(event_id) OVER (PARTITION BY user_id) AS u FROM events)
SELECT CASE WHEN event_id = u THEN 'insert' WHEN event_id = o AND event_type IN ('click', 'view') THEN 'tickers' WHEN event_id = o THEN 'corroboration' ELSE 'none' END AS effect, count(*)::BIGINT AS n FROM o GROUP BY 1""")
def duplicate_effects(spark, d):
    rows = _read(spark, d, "events").select("event_id", "user_id", "event_type")
    first = rows.groupBy("user_id").agg(F.min("event_id").alias("event_id")).select("event_id", F.lit(True).alias("opens"))
    own = rows.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).select("event_id", F.lit(True).alias("new"))
    marked = rows.join(first, "event_id", "left").join(own, "event_id", "left").select("event_type", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("opens", "new")])
    effect = F.when(F.col("opens"), "insert").otherwise(dedup.duplicate_effect(F.col("new"), F.col("new") & F.col("event_type").isin("click", "view")))
    return marked.groupBy(effect.alias("effect")).agg(F.count("*").alias("n"))


# Text, URLs, times, hashes.

_TITLE = r"<title>([^<]*)</title>"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", _TITLE, 1).alias("title"))


_PAGES = f"p AS (SELECT page_id, url, regexp_extract(html, '{_TITLE}', 1) AS title FROM pages)"
_NORMAL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_KEYS = "', '".join(urls.TRACKING_KEYS)
_CODE = "replace(replace(replace(url_encode({0}), '%20', '+'), '%7E', '~'), '*', '%2A')"
_URL_SQL = rf"""
  u0 AS (SELECT *, regexp_extract(trim(url), '^(?i)(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['s', 'h', 'p', 'q']) AS m FROM p),
  u1 AS (SELECT *, lower(m.s) AS s, regexp_replace(regexp_replace(lower(m.h), '^.*@', ''), ':$', '') AS h0, regexp_replace(CASE WHEN m.p = '' THEN '/' ELSE m.p END, '/{{2,}}', '/', 'g') AS pa,
    list_sort(list_filter(list_transform(list_filter(string_split(m.q, '&'), lambda x: x <> ''),
      lambda x: {{'k': url_decode(replace(string_split(x, '=')[1], '+', ' ')), 'v': url_decode(replace(regexp_replace(x, '^[^=]*=?', ''), '+', ' '))}}),
      lambda y: NOT (starts_with(lower(y.k), 'utm_') OR lower(y.k) IN ('{_KEYS}')))) AS kv FROM u0),
  urls AS (SELECT page_id, title, url, CASE WHEN s = '' OR h0 = '' THEN trim(url) ELSE s || '://' || CASE WHEN s = 'http' THEN regexp_replace(h0, ':80$', '') ELSE regexp_replace(h0, ':443$', '') END || pa ||
    CASE WHEN len(kv) = 0 THEN '' ELSE '?' || array_to_string(list_transform(kv, lambda y: {_CODE.format("y.k")} || '=' || {_CODE.format("y.v")}), '&') END END AS canonical FROM u1)"""


@query(f"WITH {_PAGES}, {_URL_SQL} SELECT page_id, canonical FROM urls")
def url_canonical(spark, d):
    return _pages(spark, d).select("page_id", urls.normalize_url(F.col("url")).alias("canonical"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/]*@', '\1') AS safe FROM pages")
def url_safe(spark, d):
    return _read(spark, d, "pages").select("page_id", text.safe_url(F.col("url")).alias("safe"))


@query(f"WITH {_PAGES} SELECT page_id, {_NORMAL.format('title')} AS normal FROM p")
def title_normalized(spark, d):
    return _pages(spark, d).select("page_id", text.normalize_title(F.col("title")).alias("normal"))


@query(f"WITH {_PAGES} SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(title, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS clean FROM p")
def title_clean(spark, d):
    return _pages(spark, d).select("page_id", text.clean_text(F.col("title")).alias("clean"))


@query(f"WITH {_PAGES}, {_URL_SQL} SELECT page_id, sha256(CASE WHEN {_NORMAL.format('title')} <> '' THEN 'title:' || {_NORMAL.format('title')} || '|url:' || canonical ELSE 'url:' || canonical END) AS hash FROM urls")
def content_hash(spark, d):
    return _pages(spark, d).select("page_id", hashes.content_hash(F.col("title"), F.col("url"), F.lit(None).cast("string")).alias("hash"))


@query(f"WITH {_PAGES} SELECT page_id, sha256(CASE WHEN t = '' THEN lower(trim(url)) ELSE t END) AS hash FROM (SELECT *, regexp_replace(regexp_replace(trim(lower(title)), '\\s+', ' ', 'g'), '[.,!?;:]+$', '') AS t FROM p)")
def legacy_hash(spark, d):
    return _pages(spark, d).select("page_id", hashes.legacy_hash(F.col("title"), F.col("url")).alias("hash"))


@query(f"""WITH {_PAGES}, {_URL_SQL} SELECT page_id, sha256('{{"source":"gnews","source_tickers":["AMD"],"title":' || to_json(trim(title))::VARCHAR || ',"url":' || to_json(canonical)::VARCHAR || '}}') AS hash FROM urls""")
def observation_identity(spark, d):
    return _pages(spark, d).select("page_id", hashes.observation_hash(F.lit(" GNews "), F.col("title"), F.col("url"), F.array(F.lit("$amd"), F.lit(""), F.lit("AMD"))).alias("hash"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT06:30:00Z') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT21:00:00.250000Z') END AS wire FROM orders""")
def parsed_times(spark, d):
    """Texts with an offset are instants; naive and other texts are none."""
    day, turn = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    stamp = F.when(turn == 0, F.concat(day, F.lit("T08:30:00+02:00"))).when(turn == 1, F.concat(day, F.lit(" 21:00:00.25Z"))).when(turn == 2, F.concat(day, F.lit("T08:30:00"))).otherwise(F.concat(F.lit("on "), day))
    return _read(spark, d, "orders").select("o_orderkey", times.utc_text(times.parse_utc(stamp)).alias("wire"))


@query("SELECT event_id, sha256('{\"content_hash\":\"' || sha256(event_type) || '\",\"news_id\":' || user_id || ',\"operation\":\"' || CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END || '\",\"updated_at\":\"' || strftime(ts, '%Y-%m-%d') || '\"}') AS hash FROM events")
def change_hash(spark, d):
    log = _read(spark, d, "events")
    operation = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return log.select("event_id", hashes.change_hash(operation, F.col("user_id"), F.sha2("event_type", 256), F.date_format("ts", "yyyy-MM-dd")).alias("hash"))


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS bucket, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def day_bucket_counts(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    key = F.col("o_orderkey") % 7  # the forms that publication times come in
    stamp = F.when(key == 0, F.lit("sometime")).when(key == 1, F.concat(day, F.lit("T23:30:00Z"))).when(key == 2, F.concat(day, F.lit(" late"))).when(key == 3, F.concat(day, F.lit("T12:00:00+05:30"))).otherwise(day)
    return _read(spark, d, "orders").groupBy(times.day_bucket(stamp).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || 'Z' AS wire, epoch_us(ts)::BIGINT AS micros FROM events")
def utc_wire(spark, d):
    # The table's times have no zone: they are instants of UTC, whatever the session's zone is.
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    return _read(spark, d, "events").select("event_id", times.utc_text(instant).alias("wire"), F.unix_micros(instant).alias("micros"))


_SQ = lambda pattern: pattern.replace("'", "''")


_URL_OUT = r"""'(?i)(https?://)(?:[^\s"''<>/?#@]*@)?([^\s"''<>?#]*)[^\s"''<>]*', '\1\2', 'g'"""
_redacted = lambda of: rf"regexp_replace(regexp_replace(regexp_replace({of}, {_URL_OUT}), '{_SQ(text.BEARER)}', 'Bearer [REDACTED]', 'g'), '{_SQ(text.SECRET_FIELD)}', '\1=[REDACTED]', 'g')"


@query(f"SELECT doc_id, sha256({_redacted('text')}) AS redacted FROM documents")
def redacted_text(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.sha2(text.redact(F.col("text")), 256).alias("redacted"))


_SAFE = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/]*@', '\1')"


@query(f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'HTTP 503 at ' || {_SAFE} WHEN 1 THEN 'ConnectError at ' || {_SAFE} ELSE {_redacted("'ValueError: no key in ' || url")} END AS message FROM pages")
def safe_messages(spark, d):
    turn = F.col("page_id") % 3
    message = text.safe_message(F.when(turn == 1, "ConnectError").otherwise("ValueError"), F.concat(F.lit("no key in "), F.col("url")), F.when(turn == 0, 503), F.when(turn < 2, F.col("url")))
    return _read(spark, d, "pages").select("page_id", message.alias("message"))


@query("SELECT p_partkey, CASE WHEN regexp_full_match(t, '[A-Z0-9][A-Z0-9.^/_-]{0,19}') THEN t ELSE '' END AS ticker FROM (SELECT p_partkey, regexp_replace(upper(trim('$' || p_brand)), '^\\$+', '') AS t FROM part)")
def ticker_normalized(spark, d):
    return _read(spark, d, "part").select("p_partkey", text.normalize_ticker(F.concat(F.lit("$"), F.col("p_brand"))).alias("ticker"))


# Entity resolution.

_WHOLE = "t AS (SELECT doc_id, source, sha256(text) AS title FROM documents)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the digest of their whole text, so that no text is shuffled."""
    return _read(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("title"))


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {_NORMAL.format('text')}) AS first_id FROM documents")
def exact_dedup(spark, d):
    return dedup.first_of_each(_read(spark, d, "documents").select("doc_id", F.sha2(text.normalize_title(F.col("text")), 256).alias("k")), "k", "doc_id", "first_id").select("doc_id", "first_id")


@query(f"""WITH {_PAGES}, n AS (SELECT page_id, {_NORMAL.format('title')} AS t FROM p), c AS (SELECT t, min(page_id) AS page_id FROM n WHERE t <> '' GROUP BY 1),
k AS (SELECT page_id, t, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS w FROM c),
q AS (SELECT *, list_sort(list_filter(w, lambda x: regexp_full_match(x, '\\p{{Nd}}+'))) AS nums FROM k)
SELECT a.page_id, b.page_id AS prior FROM q a JOIN q b ON b.page_id < a.page_id AND a.nums = b.nums
WHERE 25 * len(list_intersect(a.w, b.w)) >= 23 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))
UNION ALL SELECT n.page_id, c.page_id FROM n JOIN c USING (t) WHERE n.page_id <> c.page_id""")
def near_dup_pairs(spark, d):
    """Pairs of similar titles by their token overlap: first pages of each title with earlier ones, copies with their first."""
    return dedup.similar_classes(_titled(spark, d), ratio=False).select(F.col("pos").alias("page_id"), "prior")


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select(F.col("page_id").alias("pos"), F.lit("day").alias("bucket"), text.normalize_title(F.col("title")).alias("title"))


@query()
def near_dup_pairs_ratio(spark, d):
    """As near_dup_pairs, with those by sequence ratio too, which SQL cannot express. Tests hold it against brute force."""
    return dedup.similar_classes(_titled(spark, d)).select(F.col("pos").alias("page_id"), "prior")


_IDENTITIES = f"""{_PAGES}, {_URL_SQL}, k AS (SELECT page_id, canonical AS u, CASE WHEN {_NORMAL.format('title')} <> '' THEN 'title:' || {_NORMAL.format('title')} || '|day:2024-01-01' ELSE 'url:' || canonical END AS c,
  (SELECT CASE WHEN t = '' THEN lower(trim(url)) ELSE t END FROM (SELECT regexp_replace(regexp_replace(trim(lower(title)), '\\s+', ' ', 'g'), '[.,!?;:]+$', '') AS t)) AS l FROM urls),
old AS (SELECT * FROM k WHERE page_id % 2 = 0), asked AS (SELECT * FROM k WHERE page_id % 2 = 1),
hits AS (SELECT a.page_id, 0 AS rank, o.page_id AS id FROM asked a JOIN old o ON a.c = o.c UNION ALL SELECT a.page_id, 1, o.page_id FROM asked a JOIN old o ON a.l = o.c UNION ALL SELECT a.page_id, 2, o.page_id FROM asked a JOIN old o ON a.u = o.u)"""


def _asked_and_old(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages of odd numbers as incoming items, those of even numbers as entities, all of one day."""
    items = dedup.keyed(_pages(spark, d), F.col("page_id"), F.col("title"), F.col("url"), F.lit("2024-01-01"))
    return items.where("pos % 2 = 1"), items.where("pos % 2 = 0").withColumnRenamed("pos", "news_id")


@query(f"WITH {_IDENTITIES} SELECT page_id, min_by(id, (rank, id)) AS news_id FROM hits GROUP BY 1")
def exact_match_by_key(spark, d):
    return dedup.match_exact(*_asked_and_old(spark, d)).withColumnRenamed("pos", "page_id")


@query(f"WITH {_IDENTITIES} SELECT page_id, min(id) AS news_id FROM hits GROUP BY 1")
def exact_match_smallest(spark, d):
    return dedup.match_any(*_asked_and_old(spark, d)).withColumnRenamed("pos", "page_id")


@query()
def batch_dedup(spark, d):
    """The canonical page of every page by URL and title alone. Tests hold it against a sequential model."""
    items = dedup.keyed(_pages(spark, d), F.col("page_id"), F.col("title"), F.col("url"), F.lit(None).cast("string"))
    return dedup.url_or_title_batch(items).withColumnRenamed("pos", "page_id")


@query()
def greedy_dedup(spark, d):
    """The canonical page of every page. Tests hold it against a sequential model of the rule."""
    pages = _pages(spark, d)
    items = dedup.keyed(pages, F.col("page_id"), F.col("title"), F.col("url"), F.lit(None).cast("string"))
    return dedup.greedy(items).select(F.col("pos").alias("page_id"), "canonical", "matched")


@query(f"""WITH {_WHOLE}, c AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30)
SELECT doc_id, source FROM c QUALIFY row_number() OVER (PARTITION BY title ORDER BY doc_id) = 1""")
def feed_cap_first_seen(spark, d):
    kept = feeds.capped(_texts(spark, d), 30, "source", "doc_id")
    return feeds.first_seen(kept, "title", "doc_id").select("doc_id", "source")


@query("""WITH f AS (SELECT user_id, upper(event_type) AS t, min(event_id) AS o FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(t, ',' ORDER BY o) AS tickers FROM f GROUP BY 1""")
def ticker_merge(spark, d):
    lists = _read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    own = text.ticker_list(F.transform("e", lambda x: x["event_type"]))
    return lists.select("user_id", F.array_join(text.merge_tickers(F.array().cast("array<string>"), own), ",").alias("tickers"))


@query(f"""SELECT user_id, event_type, min(event_id) AS event_id FROM events n WHERE ts > TIMESTAMP '{AFTER}'
AND NOT EXISTS (SELECT 1 FROM events o WHERE o.ts <= TIMESTAMP '{AFTER}' AND o.user_id = n.user_id AND o.event_type = n.event_type) GROUP BY 1, 2""")
def observation_insert_or_ignore(spark, d):
    """Observations since AFTER that are added to those before."""
    rows = _read(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    old, new = rows.where(F.col("ts") <= _at(AFTER)), rows.where(F.col("ts") > _at(AFTER))
    return store.new_only(new, old, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


# Calendar.

_CASE = "CASE o_custkey % 10 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' WHEN 2 THEN 'gbp' WHEN 3 THEN 'JPY' WHEN 4 THEN 'CNY' WHEN 5 THEN 'AUD' WHEN 6 THEN 'CAD' WHEN 7 THEN 'CHF' WHEN 8 THEN 'NZD' ELSE 'SEK' END"
_PRIORITY = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'High' WHEN '2' THEN 'medium' WHEN '3' THEN 'low' WHEN '4' THEN 'holiday' ELSE 'none' END"
_MAP = lambda labels, c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {c} END"
_CALENDAR = f"""raw AS (SELECT o_orderkey, date_diff('week', DATE '1970-01-05', date_trunc('week', o_orderdate)::DATE)::BIGINT AS week, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS date, upper({_CASE}) AS country_code,
  lower({_PRIORITY}) AS impact, CASE WHEN o_orderstatus = 'F' THEN '1.5%' ELSE '' END AS actual FROM orders),
cal AS (SELECT o_orderkey, week, date, country_code, {_MAP(calendar.COUNTRIES, 'country_code')} AS country, impact, {_MAP(calendar.IMPACTS, 'impact')} AS impact_zh, actual FROM raw
  WHERE country_code IN ('{"', '".join(calendar.MAJORS)}') AND (impact IN ('high', 'medium') OR actual <> ''))"""


def _calendar(spark: SparkSession, d: str) -> DataFrame:
    """Normalised events of orders; a week's are a snapshot, named by the order key in the title."""
    raw = _read(spark, d, "orders").select(
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("date"), F.col("o_orderkey").cast("string").alias("title"), F.expr(_CASE).alias("country"),
        F.expr(_PRIORITY).alias("impact"), F.lit("").alias("forecast"), F.lit("").alias("previous"), F.when(F.col("o_orderstatus") == "F", "1.5%").otherwise("").alias("actual"),
    )
    week = F.floor(F.datediff(F.to_date(F.substring("date", 1, 10)), F.lit("1970-01-05")) / 7).cast("long")
    return calendar.normalized(raw).withColumns({"week": week, "o_orderkey": F.col("title").cast("long")})


@query(f"WITH {_CALENDAR} SELECT o_orderkey, country_code, country, impact, impact_zh, actual FROM cal")
def calendar_normalized(spark, d):
    return _calendar(spark, d).select("o_orderkey", "country_code", "country", "impact", "impact_zh", "actual")


_ORDINALS = f"o AS (SELECT week, o_orderkey, row_number() OVER (PARTITION BY week ORDER BY date, sha256(date || chr(10) || country_code || chr(10) || o_orderkey))::BIGINT AS ordinal FROM cal WHERE impact IN ('{"', '".join(calendar.IMPACTS)}'))"


@query(f"WITH {_CALENDAR}, {_ORDINALS} SELECT * FROM o")
def calendar_snapshot(spark, d):
    detail = calendar.snapshot_events(_calendar(spark, d), by=("week",))
    return detail.select("week", F.col("title").cast("long").alias("o_orderkey"), "ordinal")


@query(f"WITH {_CALENDAR}, {_ORDINALS} SELECT * FROM o WHERE week = (SELECT max(week) FROM o) AND ordinal > 2 ORDER BY ordinal LIMIT 11")
def calendar_page(spark, d):
    rows = calendar_snapshot(spark, d)
    last = rows.agg(F.coalesce(F.max("week"), F.lit(0))).first()[0]
    return calendar.event_page(rows.withColumnRenamed("week", "snapshot_sequence"), last, 2, 10).withColumnRenamed("snapshot_sequence", "week")


@query(f"""WITH {_CALENDAR}, {_ORDINALS} SELECT sha256(date || chr(10) || country_code || chr(10) || o_orderkey) AS event_id, country, impact_zh, date AS scheduled_at, left(date, 19) || 'Z' AS scheduled_at_utc, nullif(actual, '') AS actual,
FALSE AS is_stale, '2024-01-20T00:00:00Z' AS source_fetched_at, ordinal FROM o JOIN cal USING (week, o_orderkey)""")
def calendar_wire(spark, d):
    at = F.to_timestamp(F.lit("2024-01-20T00:00:00Z"))
    items = calendar.wire_items(calendar.snapshot_events(_calendar(spark, d), by=("week",)), F.lit(False), at, at)
    return items.select("event_id", "country", "impact_zh", "scheduled_at", "scheduled_at_utc", "actual", "is_stale", "source_fetched_at", "ordinal")


@query(f"WITH {_CALENDAR} SELECT o_orderkey, sha256(date || chr(10) || country_code || chr(10) || o_orderkey) AS event_id FROM cal")
def calendar_event_ids(spark, d):
    return _calendar(spark, d).select("o_orderkey", hashes.calendar_event_id(F.col("date"), F.col("country_code"), F.col("title")).alias("event_id"))


_SNAPS = "s AS (SELECT (event_id + 1) AS snapshot_sequence, ts AS available_at FROM events WHERE event_type = 'view')"


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").where("event_type = 'view'").select((F.col("event_id") + 1).alias("snapshot_sequence"), F.col("ts").alias("available_at"))


@query(f"WITH {_SNAPS} SELECT snapshot_sequence, available_at > TIMESTAMP '{AFTER}' AS has_changes FROM s WHERE {_IN} ORDER BY snapshot_sequence DESC LIMIT 1")
def calendar_has_changes(spark, d):
    return calendar.latest_snapshot(_snapshots(spark, d), _at(AS_OF), _at(AFTER)).select("snapshot_sequence", "has_changes")


@query("""WITH f AS (SELECT event_id, 'cal_' || left(sha256(strftime(ts, '%Y-%m-%dT00:00:00Z') || ':' || (user_id % 2) || ':' || event_type), 40) AS snapshot_token FROM events),
n AS (SELECT snapshot_token, min(event_id) AS o FROM f GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY o)::BIGINT AS snapshot_sequence FROM n)
SELECT event_id, snapshot_token, snapshot_sequence, event_id <> o AS reused FROM f JOIN s USING (snapshot_token)""")
def snapshot_reuse(spark, d):
    """Fetches of a day, stale or not, of one payload are one snapshot."""
    day = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")).cast("timestamp")
    token = hashes.snapshot_token(times.utc_text(day), F.col("user_id") % 2 == 1, F.col("event_type"))
    return calendar.recorded(_read(spark, d, "events").select("event_id", token.alias("snapshot_token")), "event_id").select("event_id", "snapshot_token", "snapshot_sequence", "reused")


# Retention and backfill.


@query(f"WITH {_SNAPS} SELECT snapshot_sequence FROM s WHERE available_at >= TIMESTAMP '{AS_OF}' OR snapshot_sequence = (SELECT coalesce(max(snapshot_sequence), 0) FROM s)")
def snapshot_retention(spark, d):
    return retention.kept_snapshots(_snapshots(spark, d), _at(AS_OF)).select("snapshot_sequence")


_GONE = """gone AS (SELECT o_orderkey AS news_id, o_orderdate FROM orders o WHERE o_orderdate < TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')
  AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.o_orderkey) ORDER BY o_orderdate, o_orderkey LIMIT 500)"""


def _expired(spark: SparkSession, d: str) -> DataFrame:
    entities = _read(spark, d, "orders").select(F.col("o_orderkey").alias("news_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("effective_at"))
    protectors = [(_read(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_orderkey"), (_read(spark, d, "events"), "user_id")]
    return retention.candidates(entities, _at("1997-01-01 00:00:00"), protectors)


@query(f"WITH {_GONE} SELECT news_id FROM gone")
def retention_candidates(spark, d):
    return _expired(spark, d).select("news_id")


@query(f"WITH {_GONE} SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT news_id FROM gone) GROUP BY 1")
def cascade_delete(spark, d):
    rest = retention.cascaded(_read(spark, d, "lineitem"), "l_orderkey", _expired(spark, d), "news_id")
    return rest.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def backfill_missing(spark, d):
    return retention.missing(_read(spark, d, "customer"), _read(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("WITH gone AS (SELECT user_id, max(event_id) + 1 AS s FROM events GROUP BY 1 HAVING max_by(event_type, event_id) = 'error') SELECT user_id AS news_id, 'delete' AS operation, s AS replaced FROM gone")
def tombstones(spark, d):
    dead = changes.state_as_of(_log(spark, d)).where("operation = 'delete'")
    return retention.tombstones(dead.withColumnRenamed("change_sequence", "replaced"), _at(AS_OF)).select("news_id", "operation", "replaced")


# Source health.


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 'disabled' WHEN s_nationkey % 7 = 0 THEN 'not_configured' WHEN s_acctbal < 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'degraded' ELSE 'unavailable' END
WHEN s_acctbal > 9000 THEN 'degraded' ELSE 'ok' END AS status FROM supplier""")
def health_status(spark, d):
    c, lit = F.col, F.lit
    success = F.when(c("s_suppkey") % 2 == 0, lit("2024-01-01"))
    return _read(spark, d, "supplier").select("s_suppkey", health.status(c("s_nationkey") % 5 != 0, c("s_nationkey") % 7 != 0, c("s_acctbal") >= 0, c("s_acctbal") <= 9000, success).alias("status"))


@query("SELECT event_type AS source, max(event_id)::BIGINT AS version, max_by(user_id, event_id) AS last_user FROM events GROUP BY 1")
def health_latest(spark, d):
    log = _read(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("last_user"), F.col("event_id").alias("version"))
    return health.latest(log).select("source", "version", "last_user")


@query("SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS data_through FROM events")
def health_data_through(spark, d):
    log = _read(spark, d, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("data_through"), F.col("event_id").alias("version"))
    return health.data_through(log).select(F.date_format("data_through", "yyyy-MM-dd HH:mm:ss").alias("data_through"))


_RUN = "CASE WHEN s_suppkey % 11 <> 0 AND s_nationkey % 5 = 0 THEN 'disabled' WHEN s_suppkey % 11 <> 0 AND known AND s_nationkey % 6 = 0 THEN 'backoff' WHEN s_nationkey % 7 = 0 THEN 'not_configured' WHEN s_acctbal < 0 THEN 'error' WHEN s_acctbal > 9000 THEN 'degraded' ELSE 'ok' END"


@query(f"""WITH r AS (SELECT *, {_RUN} AS outcome, CASE WHEN known THEN s_nationkey % 4 ELSE 0 END AS failed FROM (SELECT *, s_suppkey % 3 <> 0 AS known FROM supplier)),
n AS (SELECT *, CASE outcome WHEN 'error' THEN failed + 1 WHEN 'ok' THEN 0 WHEN 'degraded' THEN 0 ELSE failed END AS failures FROM r)
SELECT s_suppkey::VARCHAR AS source, outcome, CASE outcome WHEN 'error' THEN CASE WHEN known THEN 'degraded' ELSE 'unavailable' END WHEN 'backoff' THEN 'ok' ELSE outcome END AS status, failures::BIGINT AS consecutive_failures,
CASE WHEN outcome = 'ok' THEN '2024-01-02 00:00:05' WHEN known THEN '2024-01-01 00:00:00' END AS data_through,
CASE WHEN outcome = 'error' THEN strftime(TIMESTAMP '2024-01-02' + to_seconds(least(21600, greatest(60, floor(300 * power(2, least(failures, 6)))))::BIGINT), '%Y-%m-%d %H:%M:%S') WHEN outcome IN ('ok', 'degraded') OR NOT known OR s_nationkey % 6 <> 0 THEN NULL ELSE '2024-01-03 00:00:00' END AS next_attempt_at,
CASE WHEN outcome IN ('ok', 'degraded') THEN s_suppkey % 50 WHEN outcome = 'error' THEN 0 WHEN known THEN 7 END::BIGINT AS raw_count,
CASE WHEN outcome = 'ok' THEN s_suppkey % 20 WHEN outcome IN ('error', 'degraded') THEN 0 WHEN known THEN 7 END::BIGINT AS inserted_count, CASE WHEN known THEN 2 ELSE 1 END::BIGINT AS version FROM n""")
def source_runs(spark, d):
    """What runs of all suppliers as sources leave, two of three with a state before."""
    c, at = F.col, lambda t: F.to_timestamp(F.lit(t))
    rows = _read(spark, d, "supplier")
    name = c("s_suppkey").cast("string").alias("source")
    seven, none = F.lit(7).cast("long"), F.lit(None).cast("string")
    log = rows.where("s_suppkey % 3 <> 0").select(
        name, F.lit("ok").alias("status"), at("2024-01-01 00:00:00").alias("last_success_at"), at("2024-01-01 00:00:00").alias("data_through"), (c("s_nationkey") % 4).cast("long").alias("consecutive_failures"),
        F.when(c("s_nationkey") % 6 == 0, at("2024-01-03 00:00:00")).alias("next_attempt_at"), *[seven.alias(n) for n in ("raw_count", "inserted_count", "duplicates_count")], none.alias("error_code"), F.lit(1).cast("long").alias("version"),
    )
    runs = rows.select(
        name, (c("s_nationkey") % 5 != 0).alias("enabled"), (c("s_nationkey") % 7 != 0).alias("configured"), (c("s_suppkey") % 11 == 0).alias("forced"), F.lit(300).alias("interval_seconds"), F.lit(1.0).alias("spread"),
        at("2024-01-02 00:00:00").alias("attempted_at"), at("2024-01-02 00:00:05").alias("fetched_at"), (c("s_acctbal") >= 0).alias("fetch_ok"), (c("s_acctbal") <= 9000).alias("persisted"),
        (c("s_suppkey") % 50).alias("raw_count"), (c("s_suppkey") % 20).alias("inserted_count"), F.lit(0).alias("duplicates_count"),
    )
    shown = lambda n: F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n)
    return health.after_runs(log, runs).select("source", "outcome", "status", "consecutive_failures", shown("data_through"), shown("next_attempt_at"), "raw_count", "inserted_count", "version")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 <> 0 AND s_nationkey % 7 <> 0 AND NOT (s_suppkey % 3 <> 0 AND s_nationkey % 6 = 0)")
def due_sources(spark, d):
    c, at = F.col, lambda t: F.to_timestamp(F.lit(t))
    rows = _read(spark, d, "supplier").withColumnRenamed("s_suppkey", "source")
    registry = rows.select("source", (c("s_nationkey") % 5 != 0).alias("enabled"), (c("s_nationkey") % 7 != 0).alias("configured"))
    log = rows.where("source % 3 <> 0").select("source", F.when(c("s_nationkey") % 6 == 0, at("2024-01-03 00:00:00")).alias("next_attempt_at"), F.lit(1).alias("version"))
    return health.due(registry, log, at("2024-01-02 00:00:00")).select(c("source").alias("s_suppkey"))


@query("SELECT event_id AS news_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS tickers FROM events")
def legacy_rows(spark, d):
    """Rows of an older table, a view's without update time and tickers."""
    new = F.col("event_type") != "view"
    old = _read(spark, d, "events").select(F.col("event_id").alias("news_id"), F.col("ts").cast("timestamp").alias("fetched_at"), F.when(new, F.col("ts")).cast("timestamp").alias("updated_at"), F.when(new, F.array("event_type")).alias("source_tickers"))
    return schema.migrated(old).select("news_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"), F.size("source_tickers").alias("tickers"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey)::BIGINT + 99 AS n FROM orders")
def sequence_numbers(spark, d):
    return store.numbered(_read(spark, d, "orders").select("o_orderdate", "o_orderkey"), "n", 100, "o_orderdate", "o_orderkey").select("o_orderkey", "n")


@query("SELECT user_id, least(21600, greatest(60, floor(300 * power(2, least(count(*), 6)) * 0.85)))::BIGINT AS delay FROM events WHERE event_type = 'error' GROUP BY 1")
def health_backoff(spark, d):
    failures = _read(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures"))
    return failures.select("user_id", health.backoff_seconds(F.lit(300), F.col("failures"), F.lit(0.85)).alias("delay"))


@query(f"""WITH {_WHOLE}, m AS (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY title) AS f FROM t)
SELECT source, count(*)::BIGINT AS raw, count(*) FILTER (doc_id = f)::BIGINT AS inserted, count(*) FILTER (doc_id <> f)::BIGINT AS duplicates FROM m GROUP BY ROLLUP (source)""")
def ingest_counters(spark, d):
    rows = dedup.first_of_each(_texts(spark, d), "title", "doc_id", "first_id")
    return health.counters(rows.select("source", F.when(F.col("doc_id") != F.col("first_id"), F.lit("title")).alias("matched")))


@query("SELECT event_type AS source, count(DISTINCT user_id)::BIGINT AS keys, count(*)::BIGINT AS observations FROM events GROUP BY 1")
def source_distinct_counts(spark, d):
    return _observations(spark, d).groupBy("source").agg(F.countDistinct("canonical_news_id").alias("keys"), F.count("*").alias("observations"))


# Feeds: pages as the raw items of each source.

_CLEAN = "trim(regexp_replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_ITEMS = f"i AS (SELECT *, {_CLEAN.format('title')} AS clean FROM p WHERE {_CLEAN.format('title')} <> '' AND url <> '')"


def _items(spark: SparkSession, d: str, **columns: Column) -> DataFrame:
    return _pages(spark, d).withColumn("_at", F.col("page_id")).withColumns(columns)


def _shown(records: DataFrame) -> DataFrame:
    return records.select(F.col("_at").alias("page_id"), "source", "title", "summary", "image_url", "published_at", F.array_join("source_tickers", ",").alias("tickers"))


@query(f"""WITH {_PAGES}, {_ITEMS} SELECT page_id, 'finnhub/' || CASE WHEN page_id % 3 = 0 THEN 'CNBC' ELSE 'unknown' END AS source, clean AS title, clean AS summary, CASE WHEN page_id % 2 = 0 THEN NULL ELSE 'i' END AS image_url,
CASE WHEN page_id % 4 <> 0 THEN strftime(make_timestamp((1700000000 + page_id * 61) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS published_at, 'AAPL,' || page_id || ',MSFT' AS tickers FROM i""")
def feed_finnhub(spark, d):
    n = F.col("page_id")
    raw = _items(spark, d, headline=F.col("title"), summary=F.col("title"), datetime=F.when(n % 4 != 0, 1_700_000_000 + n * 61).otherwise(0), related=F.concat(F.lit(" aapl,,"), n, F.lit(", msft ")), source=F.when(n % 3 == 0, "CNBC"), image=F.when(n % 2 == 0, "").otherwise("i"))
    return _shown(feeds.finnhub(raw))


@query(f"""WITH {_PAGES}, {_ITEMS} SELECT page_id, 'massive/' || CASE WHEN page_id % 5 = 0 THEN 'Massive' ELSE 'P' END AS source, clean AS title, left({_CLEAN.format("repeat(title || ' ', 20)")}, 500) AS summary, 'i' AS image_url,
CASE page_id % 3 WHEN 2 THEN '2024-01-02T03:04:05+02:00' ELSE '2024-01-02T03:04:05Z' END AS published_at, 'A,B' || page_id AS tickers FROM i""")
def feed_massive(spark, d):
    n, stamp = F.col("page_id"), F.lit("2024-01-02T03:04:05")
    raw = _items(spark, d, article_url=F.col("url"), description=F.repeat(F.concat("title", F.lit(" ")), F.lit(20)), image_url=F.lit("i"), published_utc=F.concat(stamp, F.when(n % 3 == 0, "Z").when(n % 3 == 1, "").otherwise("+02:00")), publisher=F.when(n % 5 != 0, F.struct(F.lit("P").alias("name"))), tickers=F.array(F.lit("a"), F.lit(""), F.concat(F.lit("b"), n)))
    return _shown(feeds.massive(raw))


_NAMED = "'{0}/' || CASE WHEN page_id % 2 = 0 THEN 'Label' ELSE 'N' END AS source, clean AS title, clean AS summary, CASE WHEN page_id % 3 <> 0 THEN 'i' END AS image_url, CASE WHEN page_id % 5 <> 0 THEN '2024-01-02T03:04:05Z' END AS published_at, '' AS tickers"


def _named(spark: SparkSession, d: str, image: str) -> DataFrame:
    n = F.col("page_id")
    stamp = F.when(n % 5 == 0, "").otherwise("2024-01-02T03:04:05Z")
    return _items(spark, d, title=F.when(n % 7 == 0, "[Removed]").otherwise(F.col("title")), description=F.col("title"), publishedAt=stamp, source=F.struct(F.when(n % 2 == 0, "").otherwise("N").alias("name")), **{image: F.when(n % 3 == 0, "").otherwise("i")})


@query(f"WITH {_PAGES}, {_ITEMS} SELECT page_id, {_NAMED.format('newsapi')} FROM i WHERE page_id % 7 <> 0")
def feed_newsapi(spark, d):
    return _shown(feeds.newsapi(_named(spark, d, "urlToImage"), "Label"))


@query(f"WITH {_PAGES}, {_ITEMS} SELECT * REPLACE (CASE WHEN page_id % 7 = 0 THEN '[Removed]' ELSE title END AS title) FROM (SELECT page_id, {_NAMED.format('gnews')} FROM i)")
def feed_gnews(spark, d):
    return _shown(feeds.gnews(_named(spark, d, "image"), "Label"))


@query(f"""WITH {_PAGES}, {_ITEMS} SELECT page_id, 'google/' || CASE WHEN page_id % 2 = 0 THEN 'Google News' ELSE 'The Paper' END AS source, CASE WHEN page_id % 2 = 0 THEN clean || ' - The Paper' ELSE clean END AS title, NULL AS summary, NULL AS image_url,
CASE page_id % 3 WHEN 0 THEN '2024-01-02T10:00:00Z' WHEN 1 THEN 'yesterday' ELSE '' END AS published_at, '' AS tickers FROM i""")
def feed_google(spark, d):
    n = F.col("page_id")
    return _shown(feeds.google(_items(spark, d, title=F.concat("title", F.lit(" - The Paper")), link=F.col("url"), source=F.when(n % 2 != 0, " The  Paper"), pubDate=F.when(n % 3 == 0, "Tue, 02 Jan 2024 10:00:00 +0200").when(n % 3 == 1, "yesterday"))))


@query(f"""WITH {_PAGES}, {_ITEMS} SELECT page_id, 'seekingalpha/daily' AS source, clean AS title, CASE WHEN page_id % 4 <> 0 THEN '[AAPL, B' || page_id || ']' END AS summary, NULL AS image_url,
CASE page_id % 3 WHEN 0 THEN '2024-01-02T08:00:00Z' WHEN 1 THEN 'two days ago' ELSE '' END AS published_at, CASE WHEN page_id % 4 <> 0 THEN 'AAPL,B' || page_id ELSE '' END AS tickers FROM i""")
def feed_seekingalpha(spark, d):
    n, of = F.col("page_id"), lambda domain, value: F.struct(F.lit(domain).alias("_domain"), value.alias("_VALUE"))
    named = F.when(n % 4 != 0, F.array(of("x/symbol", F.lit("aapl")), of("y", F.lit("no")), of("symbol", F.concat(F.lit("b"), n)), of("symbol", F.lit(""))))
    return _shown(feeds.seekingalpha(_items(spark, d, link=F.col("url"), category=named, pubDate=F.when(n % 3 == 0, "Tue, 02 Jan 2024 10:00:00 +0200").when(n % 3 == 1, " two  days ago")), "daily"))


@query(f"""WITH {_PAGES}, {_URL_SQL}, r AS (SELECT page_id, trim(title) AS t, {_NORMAL.format('title')} AS n, canonical FROM urls WHERE trim(title) <> '') SELECT page_id, 's' AS source, t AS title, canonical AS url,
CASE WHEN page_id % 2 = 0 THEN '2024-01-02T21:30:00Z' END AS published_at, 'AMD' AS tickers, sha256(CASE WHEN n = '' THEN 'url:' || canonical ELSE 'title:' || n || '|day:2024-01-0' || CASE WHEN page_id % 2 = 0 THEN '2' ELSE '3' END END) AS hash FROM r""")
def prepared_news(spark, d):
    """Pages as records ready to insert; a publication text without an offset counts for the hash alone."""
    stamp = F.when(F.col("page_id") % 2 == 0, "2024-01-02T23:30:00+02:00").otherwise("2024-01-03T10:00:00")
    tickers = F.array(F.lit("$amd"), F.lit("not a ticker"), F.lit("AMD"))
    records = _items(spark, d, source=F.lit(" s "), summary=F.lit(None).cast("string"), image_url=F.lit(""), published_at=stamp, source_tickers=tickers).where(F.trim("title") != "")
    out = feeds.prepared(records, F.to_timestamp(F.lit("2024-01-04T00:00:00Z")))
    return out.select(F.col("_at").alias("page_id"), "source", "title", "url", times.utc_text(F.col("published_at")).alias("published_at"), F.array_join("source_tickers", ",").alias("tickers"), F.col("content_hash").alias("hash"))


@query("""WITH l AS (SELECT event_type, event_id // 1024 AS leaf, sha256(string_agg(sha256(props), ',' ORDER BY event_id)) AS h FROM events GROUP BY 1, 2)
SELECT event_type, sha256(string_agg(h, ',' ORDER BY leaf)) AS digest FROM l GROUP BY 1""")
def ordered_digests(spark, d):
    """One digest of the events of each type in their order."""
    rows = _read(spark, d, "events").select("event_type", (F.col("event_id") + 1).alias("ordinal"), F.sha2("props", 256).alias("content_hash"))
    return hashes.ordered_digest(rows, "ordinal", "content_hash", "event_type")


# Stores: what commits leave, over stores that are made of the tables.


def _store(spark: SparkSession, d: str, name: str) -> store.Store:
    """An empty store in the shared folder; it goes when the application ends."""
    path = f"{scratch.root(spark)}/{name}-{uuid.uuid4().hex}"
    made = store.Store(spark, path)
    made._fs.deleteOnExit(made._fs_path(path))
    return made


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Orders as entities, published on their day."""
    day = F.col("o_orderdate").cast("timestamp")
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("news_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").cast("string").alias("title"), F.concat(F.lit("https://o.example/"), "o_orderkey").alias("url"), day.alias("published_at"), day.alias("fetched_at"), F.md5(F.col("o_orderkey").cast("string")).alias("content_hash"))


_NOW = "1999-01-01"
_STORE = """o AS (SELECT o_orderkey AS news_id, o_orderdate, row_number() OVER (ORDER BY o_orderkey)::BIGINT AS n FROM orders), b AS (SELECT max(n) AS n FROM o),
gone AS (SELECT news_id, row_number() OVER (ORDER BY o_orderdate, news_id) AS r FROM (SELECT * FROM o WHERE o_orderdate < TIMESTAMP '1998-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = news_id AND l_returnflag = 'R') ORDER BY o_orderdate, news_id LIMIT 500))"""


@query(f"""WITH {_STORE} SELECT 'change' AS kind, n AS number, news_id, 'upsert' AS operation FROM o WHERE news_id NOT IN (SELECT news_id FROM gone) UNION ALL SELECT 'change', b.n + r, news_id, 'delete' FROM gone, b
UNION ALL SELECT 'observation', n, news_id, NULL FROM o WHERE news_id NOT IN (SELECT news_id FROM gone) UNION ALL SELECT 'state', CASE WHEN g.news_id IS NULL THEN o.n ELSE b.n + r END, o.news_id, CASE WHEN g.news_id IS NULL THEN 'upsert' ELSE 'delete' END FROM b, o LEFT JOIN gone g ON g.news_id = o.news_id""")
def retention_commit(spark, d):
    """Log, observations and state of a store of all orders, once retention has been committed."""
    made, now = _store(spark, d, "retention"), datetime.fromisoformat(f"{_NOW}T00:00:00+00:00")
    migrate.upgrade(made, _entities(spark, d), datetime.fromisoformat("1992-01-01T00:00:00+00:00"))
    retention.cleanup(made, now, [(_read(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_orderkey")])
    made.purge()  # the store is this query's own: nobody reads it as it was
    log, state = (made.read(t).select(F.lit(kind).alias("kind"), F.col("change_sequence").alias("number"), "news_id", "operation") for t, kind in (("news_changes", "change"), ("entities", "state")))
    seen = made.read("news_source_observations").select(F.lit("observation").alias("kind"), F.col("observation_id").alias("number"), F.col("canonical_news_id").alias("news_id"), F.lit(None).cast("string").alias("operation"))
    return log.unionByName(state).unionByName(seen)


@query("""WITH c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey)::BIGINT AS n, md5(c_name) AS h FROM customer)
SELECT 'change' AS kind, n AS number, c_custkey AS news_id, h AS hash FROM c UNION ALL SELECT 'observation', n, c_custkey, sha256('{"source":"legacy","source_tickers":[],"title":' || to_json(c_name)::VARCHAR || ',"url":' || to_json('https://c.example/' || c_custkey)::VARCHAR || '}') FROM c""")
def upgraded_store(spark, d):
    """Baseline changes and first observations of customers as rows of an older table that had no tickers."""
    old = _read(spark, d, "customer").select(F.col("c_custkey").alias("news_id"), F.lit("Legacy").alias("source"), F.col("c_name").alias("title"), F.concat(F.lit("https://c.example/"), "c_custkey").alias("url"), F.lit(datetime(1992, 1, 1, tzinfo=UTC)).alias("fetched_at"), F.md5("c_name").alias("content_hash"))
    made = _store(spark, d, "upgrade")
    migrate.upgrade(made, old, datetime(1993, 1, 1, tzinfo=UTC))
    log = made.read("news_changes").select(F.lit("change").alias("kind"), F.col("change_sequence").alias("number"), "news_id", F.col("payload_hash").alias("hash"))
    return log.unionByName(made.read("news_source_observations").select(F.lit("observation").alias("kind"), F.col("observation_id").alias("number"), F.col("canonical_news_id").alias("news_id"), F.col("observation_hash").alias("hash")))

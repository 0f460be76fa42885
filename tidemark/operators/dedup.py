"""Entity resolution: exact keys, canonical URLs and similar titles of a day, first come first kept.

Items have ``pos`` (their order), content_hash, legacy_hash, url_key, bucket and title (normalised). An item
is a duplicate if an earlier *canonical* item matches it; duplicates register nothing, so this is not
connected components but the lexicographically first independent set. It is found in rounds over the whole
data: an item whose every earlier match is decided is decided too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as fx
from tidemark.functions.hashes import content_hash, legacy_hash
from tidemark.functions.times import day_bucket
from tidemark.functions.urls import normalize_url
from tidemark.scratch import Scratch


def keyed(items: DataFrame, pos: Column, title: Column, url: Column, published: Column, fetched: Column | None = None) -> DataFrame:
    """(pos, content_hash, legacy_hash, url_key, bucket, title) of raw items."""
    return items.select(
        pos.cast("long").alias("pos"), content_hash(title, url, published).alias("content_hash"), legacy_hash(title, url).alias("legacy_hash"),
        normalize_url(url).alias("url_key"), day_bucket(published if fetched is None else F.coalesce(published, fetched)).alias("bucket"), fx.normalize_title(title).alias("title"),
    )


def first_seen(items: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each ``key`` by ``order``, with partial minima before the shuffle."""
    names = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("r")).select(key, "r.*").select(*items.columns)


def first_of_each(items: DataFrame, key: str, pos: str, name: str) -> DataFrame:
    """``items`` with the smallest ``pos`` of the rows that have the same ``key``, as ``name``; nulls are one key."""
    first = items.groupBy(F.col(key).alias("_key")).agg(F.min(pos).alias(name))
    return items.join(first, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


#: Places that the rows of one key are dealt to where they meet what is known of it.
SPREAD = 64


def beside(rows: DataFrame, found: DataFrame, keys: list[str], by: str = "pos") -> DataFrame:
    """``rows`` joined with ``found``, which has one row for each of ``keys``, without all rows of a key in one task.

    What is known of a key goes first to those of its SPREAD places, by a hash of ``by``, that have rows: at most SPREAD of them.
    """
    dealt = rows.withColumn("_place", F.pmod(F.xxhash64(by), F.lit(SPREAD)))
    places = dealt.select(*keys, "_place").distinct().join(found, keys)
    return dealt.join(places, [*keys, "_place"]).drop("_place")


def similar_pairs(items: DataFrame, threshold: float = fx.THRESHOLD, ratio: bool = True, both: bool = False) -> DataFrame:
    """(pos, prior): items with an earlier item of the same bucket and numbers whose title is similar.

    Both ways of being similar need a token overlap of OVERLAP, so sets of two tokens or more share two at least, and
    two of their first n - ceil(OVERLAP * n) + 2, rarest first. Items are joined by pairs of these, and by their only
    token where they have one: a token that many titles share pairs those alone that share a second rare one. The
    order-sensitive ratio is computed for pairs between OVERLAP and the threshold alone, and of these where their common characters allow it. With ``both``, a later item is a prior too.
    """
    titled = items.where("title <> ''").select("pos", "bucket", "title", fx.title_tokens(F.col("title")).alias("tokens"), fx.title_numbers(F.col("title")).alias("numbers"))
    tokens = titled.select("pos", "bucket", "numbers", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = tokens.groupBy("bucket", "numbers", "token").agg(F.count("*").alias("often"))
    ranked = beside(tokens, often, ["bucket", "numbers", "token"]).groupBy("pos", "bucket", "numbers").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("often", "token"))).alias("t"))
    first = F.transform(F.slice("t", 1, (F.col("n") - F.ceil(F.col("n") * fx.OVERLAP) + 2).cast("int")), lambda x: x["token"])
    pairs = F.flatten(F.transform("f", lambda x, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda y: F.concat_ws(" ", F.least(x, y), F.greatest(x, y)))))
    prefix = ranked.withColumn("f", first).select("pos", "bucket", "numbers", "n", F.explode(F.when(F.col("n") > 1, pairs).otherwise(F.col("f"))).alias("token"))
    a, b = prefix.alias("a"), prefix.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("bucket", "numbers", "token")]
    sized = (F.col("a.n") >= F.col("b.n") * fx.OVERLAP) & (F.col("b.n") >= F.col("a.n") * fx.OVERLAP)
    pairs = a.join(b, [*same, F.col("b.pos") != F.col("a.pos") if both else F.col("b.pos") < F.col("a.pos"), sized]).select(F.col("a.pos").alias("pos"), F.col("b.pos").alias("prior")).distinct()
    new, old = titled.select("pos", "title", "tokens"), titled.select(F.col("pos").alias("prior"), F.col("title").alias("prior_title"), F.col("tokens").alias("prior_tokens"))
    scored = pairs.join(new, "pos").join(old, "prior").withColumn("overlap", fx.jaccard(F.col("tokens"), F.col("prior_tokens"))).where(F.col("overlap") >= fx.OVERLAP)
    sure = scored.where((F.col("overlap") >= threshold) | (F.col("title") == F.col("prior_title"))).select("pos", "prior")
    if not ratio:
        return sure
    near = scored.where((F.col("overlap") < threshold) & (F.col("title") != F.col("prior_title")) & (fx.ratio_bound(F.col("title"), F.col("prior_title")) >= threshold)).where(fx.sequence_ratio(F.col("title"), F.col("prior_title")) >= threshold)
    return sure.union(near.select("pos", "prior"))


def similar_classes(items: DataFrame, threshold: float = fx.THRESHOLD, ratio: bool = True) -> DataFrame:
    """(pos, prior): similar titles of a bucket, each distinct title by its first item, later ones with earlier ones, and
    every other item with the first of its title. Items of one title are no pairs of each other."""
    titled = items.where("title <> ''")
    first = titled.groupBy("bucket", "title").agg(F.min("pos").alias("prior"))
    copies = titled.join(first, ["bucket", "title"]).where("pos <> prior").select("pos", "prior")
    return similar_pairs(first.select(F.col("prior").alias("pos"), "bucket", "title"), threshold, ratio).union(copies)


def greedy(items: DataFrame, tmp: Scratch | None = None) -> DataFrame:
    """(pos, canonical, matched): the canonical item of each, itself if it is one, and by what it matched.

    Match priority: content hash, legacy hash, URL, then the earliest similar title. Each distinct title of a bucket is
    compared once: its items are grouped by it as by an exact key, and no pairs of them are made. Positions are distinct
    and not null. The result is a table in ``tmp`` and goes with it, or one that stays.
    """
    with Scratch(items.sparkSession, "resolution") as own:
        return (tmp or own).written(_resolved(items, own), "resolved", keep=tmp is None)


#: Tables of decided items that are read as they are before they become one.
MERGED = 8


def _resolved(items: DataFrame, tmp: Scratch) -> DataFrame:
    exact = every_key = tmp.written(exact_keys(items), "keys")
    titles = tmp.written(items.where("title <> ''").groupBy("bucket", "title").agg(F.min("pos").alias("group")), "titles")
    members = every_member = tmp.written(items.select("pos", "bucket", "title").join(titles, ["bucket", "title"]).select("pos", "group"), "members")
    similar = similar_pairs(titles.select(F.col("group").alias("pos"), "bucket", "title"), both=True)
    links = every_link = tmp.written(similar.select(F.col("pos").alias("group"), F.col("prior").alias("other")).union(titles.select("group", F.col("group").alias("other"))), "pairs")

    def nearest(rows: DataFrame, asked: DataFrame, members: DataFrame, links: DataFrame, **columns: Column) -> DataFrame:
        """``asked`` items with the least of each of ``columns`` over the ``rows`` of their own and of similar titles."""
        of = rows.join(every_member, "pos").groupBy(F.col("group").alias("other")).agg(*[F.min(c).alias(n) for n, c in columns.items()])
        found = links.join(of, "other").groupBy("group").agg(*[F.min(n).alias(n) for n in columns])
        return members.join(asked, "pos", "left_semi").join(found, "group")

    first = lambda c: F.min(F.when(c, F.col("pos")))
    open_, decided, left, n = items.select("pos"), [], None, 0
    while True:
        n += 1
        # Duplicates register nothing, so a round reads canonical and open items alone, and asks for open ones alone.
        live = open_.withColumn("canonical", F.lit(None).cast("boolean"))
        for rows in decided:
            live = live.union(rows.where("canonical"))
        # By key: the first canonical item, and the first that is not decided; an item looks before itself.
        keys = exact.join(live, "pos").groupBy("key").agg(first(F.col("canonical")).alias("kept"), first(F.col("canonical").isNull()).alias("open"))
        by_key = beside(exact.join(open_, "pos"), keys, ["key"]).groupBy("pos").agg(F.max(F.coalesce(F.col("kept") < F.col("pos"), F.lit(False))).alias("hit"), F.max(F.coalesce(F.col("open") < F.col("pos"), F.lit(False))).alias("wait"))
        by_title = nearest(live, open_, members, links, kept=F.when(F.col("canonical"), F.col("pos")), open=F.when(F.col("canonical").isNull(), F.col("pos")))
        by_title = by_title.select("pos", (F.col("kept") < F.col("pos")).alias("hit2"), (F.col("open") < F.col("pos")).alias("wait2"))
        step = open_.join(by_key, "pos", "left").join(by_title, "pos", "left")
        hit, wait = F.coalesce("hit", F.lit(False)) | F.coalesce("hit2", F.lit(False)), F.coalesce("wait", F.lit(False)) | F.coalesce("wait2", F.lit(False))
        step = tmp.written(step.select("pos", F.when(hit, False).when(~wait, True).alias("canonical")), "decided")
        decided.append(step.where("canonical IS NOT NULL"))
        open_ = step.where("canonical IS NULL").select("pos")
        remain = open_.count()
        if not remain:
            break
        if remain == left:
            raise ValueError("positions must be distinct and not null")
        left = remain
        # What has no open item any more is done: keys, titles and links of the rest alone are read again.
        exact = tmp.written(exact.join(exact.join(open_, "pos", "left_semi").select("key"), "key", "left_semi"), f"keys {n}")
        members = tmp.written(members.join(open_, "pos", "left_semi"), f"members {n}")
        links = tmp.written(links.join(members.select("group"), "group", "left_semi"), f"links {n}")
        tmp.drop(f"keys {n - 1}", f"members {n - 1}", f"links {n - 1}")
        if len(decided) == MERGED:
            whole = decided[0]
            for rows in decided[1:]:
                whole = whole.union(rows)
            decided = [tmp.written(whole, "merged")]
    known = decided[0]
    for rows in decided[1:]:
        known = known.union(rows)
    kept, gone = known.where("canonical").select("pos"), known.where("NOT canonical").select("pos")
    owner = every_key.join(kept, "pos").groupBy("key").agg(F.min("pos").alias("owner"))
    by_key = beside(every_key.join(gone, "pos"), owner, ["key"]).where("owner < pos").select("pos", "rank", "owner")
    by_title = nearest(kept, gone, every_member, every_link, owner=F.col("pos")).where("owner < pos").select("pos", F.lit(3).alias("rank"), "owner")
    best = by_key.union(by_title).groupBy("pos").agg(F.min(F.struct("rank", "owner")).alias("m"))
    names = F.element_at(F.array(*map(F.lit, ("content", "legacy", "url", "title"))), F.col("m.rank") + 1)
    out = known.join(best, "pos", "left")
    return out.select("pos", F.when(F.col("canonical"), F.col("pos")).otherwise(F.col("m.owner")).alias("canonical"), F.when(~F.col("canonical"), names).alias("matched"))


def exact_keys(items: DataFrame) -> DataFrame:
    """(pos, rank, key) that an item asks for: content hash, legacy hash, canonical URL. Hashes share one name space."""
    keys = items.select("pos", F.posexplode(F.array("content_hash", "legacy_hash", F.concat(F.lit("url:"), "url_key"))).alias("rank", "key"))
    return keys.where("key <> 'url:'")


def key_hits(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """(pos, rank, news_id): the entity with the smallest id behind each key of an incoming item; ``known(key, news_id)``."""
    owner = known.groupBy("key").agg(F.min("news_id").alias("news_id"))
    return beside(exact_keys(incoming), owner, ["key"]).select("pos", "rank", "news_id")


def exact_hits(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """key_hits among the entities ``existing(news_id, content_hash, url_key)``."""
    return key_hits(incoming, existing.select("news_id", F.explode(F.array("content_hash", F.concat(F.lit("url:"), "url_key"))).alias("key")))


def match_exact(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(pos, news_id) of incoming items that an existing entity's hash or canonical URL matches, by priority of the keys."""
    return exact_hits(incoming, existing).groupBy("pos").agg(F.min_by("news_id", "rank").alias("news_id"))


def match_any(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(pos, news_id) of incoming items with any key of an existing entity: the smallest id of all, as a single insert asks."""
    return exact_hits(incoming, existing).groupBy("pos").agg(F.min("news_id").alias("news_id"))


def url_or_title_batch(items: DataFrame) -> DataFrame:
    """The batch variant without hashes: URLs are global, titles by day, first come first kept. (pos, canonical)."""
    own = F.concat(F.lit("pos:"), F.col("pos").cast("string"))
    return greedy(items.withColumns({"content_hash": own, "legacy_hash": own})).select("pos", "canonical")


def duplicate_effect(observation_new: Column, tickers_changed: Column) -> Column:
    """What a duplicate does to its entity: merge tickers, record corroboration, or nothing."""
    return F.when(tickers_changed, "tickers").when(observation_new, "corroboration").otherwise("none")

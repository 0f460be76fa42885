"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets are shares of all tokens by weight, stopped at a multiple of what a source has. The mix is a
number of equal-token blocks; they go to sources, and a source's blocks to its shards, one by one to
the highest quotient target / (2 * blocks so far + 1). A shard lays its documents end to end in a
seeded order and takes its quota: whole passes, then a run of blocks from a seeded start, around the
end. Sums by source reach the driver. Shards, of which a source has one for each SHARD_TOKENS, are summed
and apportioned in Spark: down a tree whose nodes have FAN children at most, a group each.

Equal rows are one item with a count, in pieces of COPIES rows that fall into shards of their own, so that
neither a key nor a row that makes up much of the table is one shard's, or one task's.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, table
from tidemark.scratch import written

WEIGHTS = (5, 2, 1)
BLOCK = 64
SHARD_TOKENS = 1 << 18
REPEATS = 3
#: Children of a node in the tree of a source's shards: rows of one group.
FAN = 1024
#: Equal rows that stand together in a shard, and rows that a task makes of one in a row.
COPIES = 8192
#: Sources up to which their numbers are broadcast (some 30 MB).
BROADCAST_ROWS = 250_000


def token_count(text: Column) -> Column:
    """Number of words ``[^\x20\x09-\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_CLASS.replace("[", "[^", 1) + "+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, repeats: int = REPEATS) -> dict:
    """Shares of the total by weight; none above ``repeats`` times its size, the excess reshared by weight."""
    left, open_, out = Fraction(sum(sizes.values())), set(sizes), {}
    while open_:
        whole = sum(Fraction(weights[s]) for s in open_)
        share = {s: left * Fraction(weights[s]) / whole if whole else Fraction(0) for s in open_}
        full = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = Fraction(repeats * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def highest_quotients(seats: int, weights: dict, most: dict | None = None) -> dict:
    """Sainte-Lague: ``seats`` dealt one by one to the highest weight / (2 * own + 1), ties to the smaller key.

    ``most`` bounds a key's seats. Seats that every run of the method gives are dealt at once: rounding
    weight / d gives the method's seats for their own sum, and d is found by halving.
    """
    keys = [k for k in weights if weights[k] > 0]
    cap = lambda k, n: n if most is None else min(n, most[k])
    own = dict.fromkeys(weights, 0)
    if not keys or seats <= 0:
        return own
    given = lambda d: {k: cap(k, max(0, -(-(2 * weights[k] / d - 1) // 2))) for k in keys}  # noqa: E731  ceil(w/d - 1/2)
    low, high = Fraction(0), 2 * Fraction(sum(weights.values())) + 1
    for _ in range(64):
        middle = (low + high) / 2
        middle = Fraction(middle.numerator * 2**40 // middle.denominator + 1, 2**40)
        if not low < middle < high:
            break
        low, high = (low, middle) if sum(given(middle).values()) <= seats else (middle, high)
    own |= {k: int(n) for k, n in given(high).items()}
    order = {k: i for i, k in enumerate(keys)}
    heap = [(-Fraction(weights[k]) / (2 * own[k] + 1), order[k], k) for k in keys if most is None or own[k] < most[k]]
    heapq.heapify(heap)
    for _ in range(seats - sum(own.values())):
        if not heap:
            break
        _, _, k = heapq.heappop(heap)
        own[k] += 1
        if most is None or own[k] < most[k]:
            heapq.heappush(heap, (-Fraction(weights[k]) / (2 * own[k] + 1), order[k], k))
    return own


def shares(lengths: DataFrame, counts: DataFrame, most_shards: int, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """(_s, _shard, _quota) of ``lengths`` (_s, _shard, _length), from the blocks ``_own`` of each source in ``counts``.

    Levels of sums go up from the shards until a source is one node; blocks go down by highest quotients, from a node
    to its FAN children at most.
    """
    leaves = lengths.select("_s", F.col("_shard").alias("_node"), F.col("_length").alias("_weight"), F.expr(f"{repeats} * ((_length + {block - 1}) div {block})").alias("_most"))
    levels, up = [leaves], F.expr(f"_node div {FAN}")
    while FAN ** len(levels) < most_shards:
        levels.append(levels[-1].groupBy("_s", up.alias("_node")).agg(F.sum("_weight").alias("_weight"), F.sum("_most").alias("_most")))

    def share(pdf):
        pdf = pdf.sort_values("_node")
        nodes = [int(n) for n in pdf["_node"]]
        own = highest_quotients(int(pdf["_seats"].iloc[0]), dict(zip(nodes, map(int, pdf["_weight"]))), dict(zip(nodes, map(int, pdf["_most"]))))
        return pdf[["_s"]].assign(_up=nodes, _seats=[own[n] for n in nodes])

    given = counts.select("_s", F.lit(0).cast("long").alias("_up"), F.col("_own").alias("_seats"))
    for level in reversed(levels):
        given = level.withColumn("_up", up).join(given, ["_s", "_up"]).groupBy("_s", "_up").applyInPandas(share, "_s long, _up long, _seats long")
    return given.select("_s", F.col("_up").alias("_shard"), F.col("_seats").alias("_quota"))


def laid(items: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """Pieces of ``items`` (_of, _key, _size, _mark, _also, _n: that many equal rows) on the line of their shard.

    Adds source_size, target, ``_copies`` (rows of the piece), ``_begin`` (word at which the first starts) and the shard's
    ``_length``, ``_blocks``, ``_quota`` and ``_start``. ``weights`` is a tuple repeated over the sources by code point,
    null last, or a dict by source.
    """
    spark = items.sparkSession
    per_source = {r[0]: int(r[1]) for r in items.groupBy("_of").agg(F.sum(F.col("_size") * F.col("_n"))).collect()}
    sources = sorted((s for s in per_source if s is not None)) + [None] * (None in per_source)
    weigh = {s: weights[s] if isinstance(weights, dict) else weights[i % len(weights)] for i, s in enumerate(sources)}
    goal = targets(per_source, weigh, repeats)
    own = highest_quotients(round(Fraction(sum(per_source.values()), block)), {s: goal[s] for s in sources}, {s: repeats * -(-per_source[s] // block) for s in sources})
    shards = {s: max(1, per_source[s] // SHARD_TOKENS) for s in sources}
    few = F.broadcast if len(sources) <= BROADCAST_ROWS else lambda df: df
    counts = spark.createDataFrame([(s, i, shards[s], per_source[s], float(goal[s]), own[s]) for i, s in enumerate(sources)], "_source string, _s long, _shards long, source_size long, target double, _own long")

    numbered = items.join(few(counts.select("_source", "_s", "_shards")), F.col("_of").eqNullSafe(F.col("_source"))).drop("_source")
    pieces = numbered.select("*", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPIES})")).alias("_piece")).withColumn("_copies", F.least(F.lit(COPIES), F.expr(f"_n - _piece * {COPIES}")))
    pieces = pieces.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "_key", "_mark", "_also", "_piece"), "_shards")).drop("_shards", "_n")
    lengths = written(pieces.groupBy("_s", "_shard").agg(F.sum(F.col("_size") * F.col("_copies")).alias("_length")), "shards")
    blocks = F.expr(f"(_length + {block - 1}) div {block}")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce("_source", F.lit("None")), F.lit(":"), F.col("_shard").cast("string"))
    quotas = lengths.join(shares(lengths, counts, max(shards.values(), default=1), repeats, block), ["_s", "_shard"]).join(few(counts), "_s").withColumn("_blocks", blocks)
    quotas = quotas.select("_s", "_shard", "source_size", "target", "_length", "_blocks", "_quota", (F.crc32(name.cast("binary")) % F.greatest(F.col("_blocks"), F.lit(1))).alias("_start"))
    order = Window.partitionBy("_s", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), "_key"), "_key", "_size", "_mark", "_also", "_piece").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("_size") * F.col("_copies")
    return pieces.withColumn("_begin", F.sum(words).over(order) - words).join(quotas, ["_s", "_shard"])


def passes() -> Column:
    """Whole passes over a shard that its quota makes."""
    return F.expr("_quota div greatest(_blocks, 1)")


def extra(begin: Column, block: int = BLOCK) -> Column:
    """Words of a row that begins at ``begin`` in the further, partial pass over its shard."""
    end, total = begin + F.col("_size"), F.col("_blocks") * block
    over = lambda a, b: F.greatest(F.lit(0), F.least(end, b) - F.greatest(begin, a))
    first = F.col("_start") * block
    last = first + F.expr("_quota % greatest(_blocks, 1)") * block
    around = F.when(last > total, over(F.lit(0), last - total)).otherwise(F.lit(0))
    return (over(first, F.least(last, F.col("_length"))) + around).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, key: str = "doc_id", source: str = "source", text: str = "text", repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """One row per input row: key, size, source_size, target, taken (words the mix takes, repeats counted).

    Null and empty texts have size 0 and none is taken of them; a null source is a source of its own, the
    last. Repeated rows count as often as they come; rows that tie in key and size are ordered by their texts, and equal
    rows are alike whichever comes first. Texts of any length count whole. An empty table gives an empty result; other columns
    are not read, whatever their names.
    """
    narrow = docs.select(F.col(source).cast("string").alias("_of"), F.col(key).alias("_key"), token_count(F.col(text)).alias("_size"), F.xxhash64(F.col(text)).alias("_mark"), F.lit(0).alias("_also"))
    items = written(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("_n")), "sizes")
    rows = laid(items, weights, repeats, seed=seed).select("*", F.explode(F.expr("sequence(0, int(_copies) - 1)")).alias("_at"))
    words = passes() * F.col("_size") + extra(F.col("_begin") + F.col("_at") * F.col("_size"))
    return rows.select(F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target", words.cast("long").alias("taken"), F.col("_of").alias("source"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, key: str = "doc_id", source: str = "source", text: str = "text", repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """``docs`` in the mix: each row as often as the mix takes it whole, its columns unchanged.

    A document counts for the partial pass if at least half of its words are in it, so documents are never
    cut, whatever their length; those without words, null texts among them, stay once. A null source is a source of its
    own, the last. Repeated rows count as often as they come; rows that tie in key and size are ordered by a digest of all
    their columns, so that reruns agree. An empty table stays empty. Columns come back as they were, whatever their names.
    """
    kinds = dict(docs.dtypes)
    cols = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(f"`{c}`") for c in docs.columns]
    marks = [F.xxhash64(*cols).alias("_mark"), F.xxhash64(F.lit(1), *cols).alias("_also")]  # 128 bits tell rows apart
    narrow = docs.select(F.col(source).cast("string").alias("_of"), F.col(key).alias("_key"), token_count(F.col(text)).alias("_size"), *marks)
    items = written(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("_n")), "sizes")
    half = F.aggregate(F.expr("sequence(0, int(_copies) - 1)"), F.lit(0).cast("long"), lambda n, i: n + F.when(2 * extra(F.col("_begin") + i * F.col("_size")) >= F.col("_size"), 1).otherwise(0))
    times = F.when(F.col("_size") == 0, F.col("_copies")).otherwise(passes() * F.col("_copies") + half)
    decided = laid(items, weights, repeats, seed=seed).select("_mark", "_also", times.alias("_times")).groupBy("_mark", "_also").agg(F.sum("_times").alias("_times"))
    decided = written(decided.where("_times > 0"), "times")
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *marks).groupBy("_mark", "_also").agg(F.first("_row").alias("_row"))
    usual = one.join(decided.where(F.col("_times") <= COPIES), ["_mark", "_also"])
    spread = one.join(decided.where(F.col("_times") > COPIES), ["_mark", "_also"]).select("_row", "_mark", "_times", F.explode(F.expr(f"sequence(0L, (_times - 1) div {COPIES})")).alias("_piece"))
    spread = spread.repartition("_mark", "_piece").withColumn("_times", F.least(F.lit(COPIES), F.expr(f"_times - _piece * {COPIES}")))
    again = lambda rows: rows.select("_row", F.explode(F.expr("sequence(1, int(_times))"))).select("_row.*")
    return again(usual).unionAll(again(spread))


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))

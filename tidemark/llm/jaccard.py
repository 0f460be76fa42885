"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact sorted-array intersection.

Documents with equal shingle sets are one class, found by a set digest. Class representatives are
dealt to tiles: a tile belongs to a size band and to one part of the hash range, and its key digests
the shingles a set has in that part. A band has SPARE more parts than two similar sets of its sizes can
have differing shingles, so two similar sets agree on SPARE parts at least. Parts that are empty on both
sides make no tile; a set with more than SPARE - AGREE empty parts also takes the tiles of its prefix in
hash order, where two similar sets always share a shingle. So similar sets meet in AGREE tiles of parts of
one band, or in a tile of a prefix.

Shared passages make some tiles popular among sets that are not similar. The most popular ones are known
from a sample of SAMPLE sets or so; they are salted, so that no task holds such a tile (balance alone depends
on the sample). Each set leaves its DROP most popular tiles of a band: of the tiles that two sets share, both
keep all but DROP. Tiles of a few members deal their pairs, which are counted: those that meet in fewer than
AGREE - DROP go. In larger tiles not all pairs are made. Each is first compared with one centre, the member that meets most others;
what is then in one component needs no more pairs, and only members outside the tile's largest component
go on, in blocks, against the rest of the centre's tiles. Before sets are intersected exactly, bitmaps bound the overlap: a bit
that only one side has stands for a shingle that only that side has. Tiles with equal members are
compared once. No link between different sets is lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table
from tidemark.llm.graph import components
from tidemark.scratch import Scratch, freeing, written

#: Rows up to which the ids of documents with a candidate, or of copies, are broadcast (about 8 MB); beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: Sets of the sample that finds popular tiles, members there from which a tile is salted, and salted tiles at most.
SAMPLE, OFTEN, SALTED = 10_000, 12, 65_536
#: Shares of the pairs that meet their sets one after the other: a join has a set's bitmap or hashes once a pair on disk.
PAIR_ROUNDS = 2
#: Members of a tile that one task compares at once, on either side.
BLOCK = 1024
BITS_PER_SHINGLE = 8
#: Parts that similar sets agree on at least; how many of them make tiles; how many popular ones a set leaves.
SPARE, AGREE, DROP = 16, 8, 4
#: Members up to which a tile deals its pairs: (SMALL - 1) / 2 a member at most.
SMALL = 8
#: Low bits of a tile key: 1 for tiles of a prefix, 2 for odd bands, and the salt, which is 0 but in popular tiles.
SALT_BITS = 60

_M = [np.array([x], np.uint64) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_S = [np.array([x], np.uint64) for x in (31, 29, 32, 6)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[0])) * _M[0]
    x = (x ^ (x >> _S[1])) * _M[1]
    return x ^ (x >> _S[2])


class WordHashes(dict):
    """64-bit hashes of words; the first 200,000 words are kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = value
        return value


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; A-Z count as a-z.

    Fewer words than ``width`` make one shingle of them all; a null or blank text has none.
    """
    words = (text or "").encode().lower().split()
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(a))
    if size == 0:
        return a
    h = np.full(len(a) - size + 1, size, np.uint64)
    for i in range(size):
        h = mix(h * _M[2] + a[i : len(a) - size + 1 + i])
    return np.unique(h)


class Bands:
    """Size bands for a similarity of ``percent``: where sets of a size are dealt, and to how many parts."""

    def __init__(self, percent: int, ratio: float = 1.5):
        self.percent, self.ratio, self.edges = percent, max(ratio, 100 / percent), [1]

    def band(self, n: int) -> int:
        while self.edges[-1] <= 2 * n + 2:
            self.edges.append(max(self.edges[-1] + 1, int(np.ceil(self.edges[-1] * self.ratio))))
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def levels(self, n: int) -> list[int]:
        """The band of ``n``, and the next if it holds sizes that can be similar to ``n``."""
        b = self.band(n)
        return [b, b + 1] if 100 * n // self.percent >= self.edges[b + 1] else [b]

    def parts(self, level: int) -> int:
        """0 where only equal sets are similar."""
        differing = 2 * (self.edges[level + 1] - 1) * (100 - self.percent) // (100 + self.percent)
        return differing + SPARE if differing else 0


def tile_keys(h: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the tiles of a set, without salt (see SALT_BITS)."""
    found, n = [], len(h)
    for level in bands.levels(n) if n else []:
        if not (k := bands.parts(level)):
            continue
        start = np.searchsorted(h, (np.arange(k) * (2.0**64 / k)).astype(np.uint64))
        filled = np.diff(np.append(start, n)) > 0
        at = np.flatnonzero(filled)
        sums = np.add.reduceat(mix(h + _M[3]), start[at])
        found.append(mix(sums + at.astype(np.uint64) * _M[2] + np.uint64(level) * _M[1]) & ~np.uint64(63) | np.uint64(level % 2 * 2))
        if k - len(at) > SPARE - AGREE:
            prefix = h[: n - -(-bands.percent * n // 100) + 1]
            found.append(mix(mix(prefix + _M[1]) + np.uint64(level) * _M[3]) & ~np.uint64(63) | np.uint64(level % 2 * 2 + 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def digest(h: np.ndarray) -> tuple[int, int]:
    if not len(h):
        return 0, 0
    return int(mix(h).sum(dtype=np.uint64).view(np.int64)), int(mix(h + _M[2]).sum(dtype=np.uint64).view(np.int64))


def bitmap(h: np.ndarray) -> bytes:
    """Power-of-two number of bits, 8 or more a shingle, set by the low bits of each hash."""
    width = 64
    while width < BITS_PER_SHINGLE * len(h):
        width *= 2
    bits = np.zeros(width, bool)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap of ``size`` bytes that the same set would have."""
    b = np.frombuffer(bits, np.uint64)
    while len(b) * 8 > size:
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return b


def may_link(one: np.ndarray, n: int, many: np.ndarray, ns: np.ndarray, percent: int) -> np.ndarray:
    """Which of the bitmaps ``many`` can be of sets similar to ``one``: the overlap's upper bound reaches the least needed."""
    most = np.minimum(n - np.bitwise_count(one & ~many).sum(axis=1, dtype=np.int64), ns - np.bitwise_count(many & ~one).sum(axis=1, dtype=np.int64))
    return (100 + percent) * most >= percent * (n + ns)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted arrays of distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0
    return 100 * common >= percent * (len(a) + len(b) - common) and common > 0


def _by_rounds(pairs: DataFrame, step, label: str, tmp: Scratch) -> DataFrame:
    """``step`` of all the pairs (a, b), PAIR_ROUNDS shares of them in turn."""
    share = F.pmod(F.xxhash64("a", "b"), F.lit(PAIR_ROUNDS))
    return reduce(DataFrame.union, [tmp.written(step(pairs.where(share == at)), label) for at in range(PAIR_ROUNDS)])


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """The pairs (a, b) that the bitmaps leave."""

    def keep(cols, _):
        out = {"a": [], "b": []}
        for i, j, n, m, x, y in zip(*(cols[c] for c in ("a", "b", "na", "nb", "bits_a", "bits_b"))):
            size = min(len(x), len(y))
            if may_link(folded(x, size), n, folded(y, size)[None, :], np.array([m]), percent)[0]:
                out["a"].append(i)
                out["b"].append(j)
        return out

    return _by_rounds(pairs, lambda some: map_batches(_met_sets(some, sets, "bits"), keep, "a long, b long"), "bounded", tmp)


def _exact(pairs: DataFrame, drawn, percent: int, tmp: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by intersecting sorted arrays. Few pairs are left by then: only their
    documents' arrays are made, by ``drawn(ids, column)``."""
    ids = tmp.written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "asked")
    sets = tmp.written(drawn(ids, "h"), "arrays")

    def keep(cols, _):
        out = {"a": [], "b": []}
        for i, j, x, y in zip(*(cols[c] for c in ("a", "b", "h_a", "h_b"))):
            if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent):
                out["a"].append(i)
                out["b"].append(j)
        return out

    return _by_rounds(pairs, lambda some: map_batches(_met_sets(some, sets, "h"), keep, "a long, b long"), "exact", tmp)


def _met_sets(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``pairs`` with na, nb and ``column`` of both sides. Only b's is shuffled once a pair; a's comes once to its pairs."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col(column).alias(f"{column}_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", f"{column}_a", f"{column}_b")


def _popular(tiles, source: DataFrame, classes: DataFrame) -> np.ndarray:
    """Sorted keys of tiles that hold OFTEN of a sample of SAMPLE sets or so: SALTED keys at most."""
    total = classes.count()
    share = int((1 << 30) * min(1.0, SAMPLE / max(1, total)))
    ids = classes.where(F.pmod(F.xxhash64(F.lit(29), "d1", "d2"), F.lit(1 << 30)) < share).select(F.col("rep").alias("id"))
    often = tiles(source.join(F.broadcast(ids), "id"), None).distinct().groupBy("key").count().where(F.col("count") >= OFTEN)
    with freeing(source.sparkSession):
        return np.sort(np.array([r["key"] for r in often.orderBy(F.desc("count"), "key").limit(SALTED).collect()], np.int64))


def rounds_of(percent: int) -> int:
    """Rounds in which tiles are dealt: the less alike similar sets may be, the more tiles a set has, and the more rounds
    share them, so that a round's shuffle is about as large as the texts. Each round makes the shingles anew."""
    return max(1, -(-(100 - percent) // 10))


def _tiles(docs: DataFrame, width: int, percent: int, popular, rounds: int = 1, at: int = 0) -> DataFrame:
    """(key, d1): the tiles of every set of ``docs(id, text)``; a task deals a set once. ``popular``: a broadcast of
    the keys to salt. With ``rounds``, only every so many of all keys, the ``at``-th ones."""
    bands = Bands(percent)

    def dealt(cols, state):
        out = {"key": [], "d1": []}
        for t in cols["text"]:
            h = shingles(t, width, state["words"])
            d = digest(h)
            if len(h) and d not in state["seen"]:
                keys = tile_keys(h, bands)
                keys = (keys[(keys >> _S[3]) % np.uint64(rounds) == at] if rounds > 1 else keys).view(np.int64)
                if popular is not None and len(hot := popular.value):
                    known = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
                    keys = np.where(known, keys | (1 + d[0] % 15) << 2, keys)
                out["key"].append(keys)
                out["d1"].append(np.full(len(keys), d[0], np.int64))
                state["seen"].add(d)
        if len(state["seen"]) > 100_000:
            state["seen"].clear()
        return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}

    return map_batches(docs.select("text"), dealt, "key long, d1 long", lambda: {"words": WordHashes(), "seen": set()})


def _shared(tiles: DataFrame) -> DataFrame:
    """(key, d1, often): the tiles of ``tiles`` that several sets have, all rows of a key among them."""
    w = Window.partitionBy("key")
    shared = tiles.withColumns({"lo": F.min("d1").over(w), "hi": F.max("d1").over(w), "often": F.count("*").over(w), "salted": F.col("key").bitwiseAND(F.lit(SALT_BITS)) != 0})
    # A salted tile counts as the most popular for all its members: the order of tiles is the same for every set.
    return shared.where("lo < hi OR salted").select(F.col("key").bitwiseAND(F.lit(~SALT_BITS)).alias("key"), "d1", F.when(F.col("salted"), F.lit(1 << 60)).otherwise(F.col("often")).alias("often"))


def _met(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, rep, few): the tiles that a set keeps of those it shares; few: at most SMALL rows of the tile came."""
    place = F.dense_rank().over(Window.partitionBy("d1", F.pmod("key", F.lit(4))).orderBy(F.desc("often"), "key"))
    left = shared.repartition("d1").withColumn("place", place).where((F.col("key") % 2 != 0) | (F.col("place") > DROP))
    # Sets of one digest but different keys would all come along; the exact step tells them apart.
    return left.join(classes.select("d1", "rep"), "d1").select("key", "rep", (F.col("often") <= SMALL).alias("few")).distinct()


def _small_pairs(met: DataFrame) -> DataFrame:
    """(a, b) that meet in AGREE - DROP small tiles of parts or in a small tile of a prefix."""
    weight = F.when(F.col("key") % 2 != 0, AGREE - DROP).otherwise(1).cast("long")
    members = met.where("few").groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("r")).where(F.size("r") > 1)
    members = members.groupBy("r").agg(F.sum(weight).alias("w"))
    pairs = F.flatten(F.transform("r", lambda x: F.transform(F.filter("r", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return members.select("w", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("w").alias("w")).where(F.col("w") >= AGREE - DROP).select("a", "b")


def _centred(tiles: DataFrame, tmp: Scratch) -> DataFrame:
    """``tiles`` with the centre of each tile, the member that meets most others. Every join is of two plain tables, so
    that Spark may split a large tile."""
    tiles = tmp.written(tiles, "members")
    score = tiles.groupBy("rep").agg(F.sum(F.col("m") * F.col("times")).alias("score"))
    centre = tiles.join(score, "rep").groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("r"))).alias("c"))
    return tmp.written(tiles.join(tmp.written(centre.select("key", (-F.col("c.r")).alias("centre")), "centres"), "key"), "tiles")


def _block_pairs(members: DataFrame, sets: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """(a, b) between a group's members that are in different components and that the bitmaps leave.

    ``members(key, rep, component)``. Members outside a group's largest component meet all members, both
    in blocks: a task holds 2 * BLOCK members on average, whatever the group's size.
    """
    by = members.groupBy("key", "component").agg(F.count("*").alias("m"))
    per = by.groupBy("key").agg(F.sum("m").alias("m"), F.max(F.struct("m", "component")).alias("top"))
    # A table of its own: the join below then has two plain sides, and Spark may split a large group.
    per = tmp.written(per.select("key", "m", F.col("top.component").alias("top"), (F.col("m") - F.col("top.m")).alias("outside")).where("outside > 0"), "groups")
    rows = members.join(per, "key").withColumns({"mbs": F.ceil(F.col("m") / BLOCK).cast("int"), "obs": F.ceil(F.col("outside") / BLOCK).cast("int")})
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inner = rows.select("key", block("mbs").alias("mb"), all_of("obs").alias("ob"), "rep", "component", F.lit(False).alias("out"))
    outer = rows.where("component <> top").select("key", all_of("mbs").alias("mb"), block("obs").alias("ob"), "rep", "component", F.lit(True).alias("out"))

    def compare(pdf):
        import pandas as pd

        size = min(map(len, pdf["bits"]))
        bits, n = np.stack([folded(b, size) for b in pdf["bits"]]), pdf["n"].to_numpy()
        rep, comp, out = (pdf[c].to_numpy() for c in ("rep", "component", "out"))
        here, found = np.flatnonzero(~out), []
        for i in np.flatnonzero(out):
            other = here[comp[here] != comp[i]]
            hit = other[may_link(bits[i], n[i], bits[other], n[other], percent)]
            found.append(np.stack([np.minimum(rep[hit], rep[i]), np.maximum(rep[hit], rep[i])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    dealt = inner.union(outer).join(sets.select("rep", "n", "bits"), "rep")
    return dealt.groupBy("key", "mb", "ob").applyInPandas(compare, "a long, b long").distinct()


def _picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``id`` is in ``ids``: the ids are broadcast while they are few, else both sides shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _shared_ids(sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that a document belongs to by several rows with its key, each with the first of them."""
    several = sizes.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.min("d2").alias("lo2"), F.max("d2").alias("hi2")).where("lo < hi OR lo2 < hi2").select("id")
    own = sizes.where("n > 0").join(several, "id").join(classes, ["n", "d1", "d2"]).select("id", "rep").distinct()
    return own.join(own.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b")).where("a <> b")


def similarity_classes(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_shingles, class_id (smallest key with the same set), component_id.

    Two documents link when 100 * |A & B| >= percent * |A | B| over sets of distinct shingles of ``width``
    words; component_id is the smallest key that links reach. Null and blank texts have an empty set and
    are linked with nothing. Repeated rows come back repeated. Rows that share a key are one document, which
    every link of each of their texts reaches. A row with a null key links with nothing. An empty table gives
    an empty result; texts of any length are taken whole; other columns are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    with Scratch(docs.sparkSession, "jaccard") as tmp:
        return _similarity_classes(docs, width, percent, key, text, tmp, keep=True)


def _similarity_classes(docs: DataFrame, width: int, percent: int, key: str, text: str, tmp: Scratch, keep: bool) -> DataFrame:
    """``similarity_classes`` over tables in ``tmp``; with ``keep``, those that the result reads stay when it is closed."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession

    def measured(cols, words):
        found = [shingles(t, width, words) for t in cols["text"]]
        d = [digest(h) for h in found]
        return {"id": cols["id"], "n": [len(h) for h in found], "d1": [x[0] for x in d], "d2": [x[1] for x in d]}

    def drawn(ids: DataFrame, column: str) -> DataFrame:
        """(rep, n, d1, d2, ``column``) of the documents in ``ids``: their bitmaps (bits) or their sorted arrays (h)."""

        def run(cols, state):
            out = {"rep": [], "n": [], "d1": [], "d2": [], column: []}
            for i, t in zip(cols["id"], cols["text"]):
                h = shingles(t, width, state["words"])
                d = digest(h)
                if len(h) and (i, *d) not in state["seen"]:
                    state["seen"].add((i, *d))
                    for name, value in zip(out, (i, len(h), *d, bitmap(h) if column == "bits" else h.tobytes())):
                        out[name].append(value)
            if len(state["seen"]) > 100_000:
                state["seen"].clear()
            return out

        sets = map_batches(_picked(source, ids), run, f"rep long, n long, d1 long, d2 long, {column} binary", lambda: {"words": WordHashes(), "seen": set()})
        return sets.dropDuplicates(["rep", "d1", "d2"]) if repeated else sets

    sizes = tmp.written(map_batches(source, measured, "id long, n long, d1 long, d2 long", WordHashes), "sizes", keep=keep)
    classes = tmp.written(sizes.where("n > 0 AND id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")), "classes", keep=keep)
    source = source.where("id IS NOT NULL")
    repeated = sizes.where("id IS NOT NULL").groupBy("id").count().where("count > 1").limit(1).count() > 0
    popular = spark.sparkContext.broadcast(_popular(lambda rows, hot: _tiles(rows, width, percent, hot), source, classes))
    rounds = rounds_of(percent)  # a round's shuffle goes before the next one's is made
    shared = [_shared(_tiles(source, width, percent, popular, rounds, at)) for at in range(rounds)]
    shared = reduce(DataFrame.union, [tmp.written(s, "shared") for s in shared]) if rounds > 1 else shared[0]
    met = tmp.written(_met(shared, classes), "met")
    tmp.drop("shared")

    # Large tiles with the same members are one tile.
    large = met.where("NOT few")
    mark = large.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("m > 1")
    one = tmp.written(mark.groupBy((F.col("key") % 2 != 0).alias("prefix"), "m", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("times")).select("key", "m", "times"), "one")
    tiles = _centred(large.join(one, "key"), tmp)
    centre = tiles.where("rep <> centre").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b"))
    first = tmp.written(_small_pairs(met).union(centre).distinct(), "pairs")
    tmp.drop("met", "one", "members", "centres")

    wanted = tmp.written(first.select(F.col("a").alias("id")).union(first.select("b")).union(tiles.select("rep")).distinct(), "wanted")
    sets = tmp.written(drawn(wanted, "bits"), "sets")
    near = _bounded(first, sets, percent, tmp)
    links = tmp.written(_exact(near, drawn, percent, tmp).union(_shared_ids(sizes, classes)).distinct(), "links")
    labels = tmp.written(components(links, tmp), "near")
    tmp.drop("pairs", "bounded", "exact", "links", "arrays", "asked")
    # The centre has met every member of its tiles; what is left are the others, where they differ in component.
    # A centre's tiles overlap, so their members are compared together, each once.
    rest = tiles.where("rep <> centre").select(F.col("centre").alias("key"), "rep").distinct()
    rest = tmp.written(rest.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), "rest")
    left = tmp.written(_block_pairs(rest, sets, percent, tmp), "left")
    more = _exact(left, drawn, percent, tmp)
    labels = tmp.written(components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), tmp), "labels", keep=keep)

    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("n", "d1", "d2", "rep", F.coalesce("component", "rep").alias("component"))
    out = sizes.join(named, ["n", "d1", "d2"], "left")
    own = lambda c: F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce(c, "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own("rep").alias("class_id"), own("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component of similar ones, the one with the smallest key.

    Every row of a document that stays comes back as it was, documents without words and rows without a key
    among them; an empty table stays empty. Columns keep their names, whatever these are.
    """
    with Scratch(docs.sparkSession, "jaccard") as tmp:
        groups = _similarity_classes(docs, width, percent, key, text, tmp, keep=False)
        gone = written(groups.where(f"component_id <> `{key}`").select(key).distinct(), "copies")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, coalesce((SELECT min(a) FROM l WHERE l.b = n.doc_id AND same), n.doc_id) AS class_id
FROM n JOIN r USING (doc_id) GROUP BY 1, 2
"""

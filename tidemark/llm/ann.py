"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced halving of a bounded sample, level by level, so lists start even. Every vector
goes to its nearest list and, near a boundary, to further lists whose centroid is almost as near. Centroids are
searched by best-first search in a neighbour graph held in memory (LISTS centroids at most, broadcast).
A query scans its nearest lists, a number that grows more slowly than the lists do, and of these only lists whose
distance is within a ratio of the first ones'. Equal vectors are searched once: only the smallest keys among
them can be anyone's neighbours. Lists are searched region by region; regions of many rows and crowds of queries
are cut into blocks, so a task holds a block of each whatever the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.scratch import Scratch

#: Bounds of the fit: rows of the sample, lists, and vectors aimed at in a list.
SAMPLE, LISTS, LIST_SIZE = 131_072, 32_768, 6
#: A vector is in its nearest list and in up to REPLICAS in all that are within a ratio of its distance. The ratio is that
#: which a share of BOUNDARY of the sample's vectors has for the last of them: the others are no boundary vectors there.
REPLICAS, BOUNDARY = 3, 0.75
#: A query scans its nearest lists within a ratio of the fourth one's distance, LEAST at least. The ratio is the one at which a
#: middling vector of the sample scans SCAN * lists ** POWER of them; MOST times as many are a bound alone.
SCAN, POWER, LEAST, MOST = 1.45, 0.64, 20, 1.5
#: Vectors of the sample that the two ratios are read off.
PROBES = 1_024
#: Neighbouring lists that are searched together; rows and queries of them in a task.
REGION, VECTOR_BLOCK, QUERY_BLOCK = 32, 4_096, 1_024
DEGREE = 32


def halved(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Unit centroids of ``lists`` (a power of two) equal parts of unit vectors ``x``: each part is cut at the
    median of the difference of distances to two means."""
    rng, parts = np.random.default_rng(seed), [np.arange(len(x))]
    while len(parts) < lists:
        cut = []
        for part in parts:
            own = x[part]
            pair = own[rng.choice(len(own), 2, replace=len(own) < 2)]
            for _ in range(4):
                order = np.argsort(own @ (pair[0] - pair[1]), kind="stable")
                low, high = order[: len(order) // 2], order[len(order) // 2 :]
                pair = np.stack([own[high].mean(axis=0), own[low if len(low) else high].mean(axis=0)])
            cut += [part[low if len(low) else high], part[high]]
        parts = cut
    means = np.stack([x[p].mean(axis=0) for p in parts])
    norm = np.linalg.norm(means, axis=1, keepdims=True)
    return np.where(norm > 0, means / np.maximum(norm, 1e-30), x[[p[0] for p in parts]])


class CentroidGraph:
    """Unit centroids, each linked to its nearest others and to some far ones; built once, then broadcast."""

    def __init__(self, centroids: np.ndarray, seed: int = 5):
        self.centroids = centroids.astype(np.float32)
        n = len(centroids)
        most = min(DEGREE, n - 1)
        near = np.zeros((n, most), np.int32)
        for at in range(0, n, 1024):
            close = -(self.centroids[at : at + 1024] @ self.centroids.T)
            close[np.arange(len(close)), np.arange(at, at + len(close))] = np.inf
            near[at : at + 1024] = np.argpartition(close, min(most, n - 1), axis=1)[:, :most]
        far = np.random.default_rng(seed).integers(0, n, (n, min(4, n)))
        ring = (np.arange(n)[:, None] + 1) % n  # keeps the graph connected
        self.links = np.concatenate([near, far, ring], axis=1).astype(np.int32)
        self.near = self.far = np.inf  # the two ratios less one; all lists up to their bounds until they are measured

    def measure(self, x: np.ndarray) -> CentroidGraph:
        """Read the ratios off unit vectors of the sample."""
        far = np.concatenate([self.nearest(x[at : at + 64], self.scanned())[1] for at in range(0, len(x), 64)])  # a search holds much for each vector
        ratio = lambda base, at: far[:, min(at, far.shape[1] - 1)] / np.maximum(far[:, min(base, far.shape[1] - 1)], 1e-12) - 1
        self.near = float(np.quantile(ratio(0, REPLICAS - 1), BOUNDARY))
        self.far = float(np.median(ratio(3, self.scanned() - 1)))
        return self

    def scanned(self) -> int:
        """How many lists a middling query scans."""
        return max(LEAST, int(np.ceil(SCAN * len(self.centroids) ** POWER)))

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the ``k`` nearest centroids of unit vectors, nearest first.

        Best-first search from the best of some evenly spaced centroids (their order follows the halving, so these
        are spread over the space), a few open centroids of each vector at a time: the search of a vector ends when
        its best ones have all been opened.
        """
        n, rows = len(self.centroids), np.arange(len(x))[:, None]
        k = min(k, n)
        width = min(n, k + max(48, k // 8))
        wide = min(width, max(3, k // 12))  # centroids opened in one step
        seen = np.zeros((len(x), n + 1), bool)
        seen[:, n] = True
        ids, far, opened = np.zeros((len(x), 0), np.int32), np.zeros((len(x), 0), np.float32), np.zeros((len(x), 0), bool)
        spread = np.unique(np.linspace(0, n - 1, min(n, max(16, n // 16))).astype(np.int32))
        start = -(x @ self.centroids[spread].T)
        new = spread[np.argpartition(start, min(16, len(spread)) - 1, axis=1)[:, :16]]
        while True:
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n  # a centroid that comes twice counts once
            known = seen[rows, new]
            seen[rows, new] = True
            d = np.einsum("ij,ikj->ik", x, self.centroids[np.minimum(new, n - 1)])
            d = np.where(known, np.inf, np.sqrt(np.maximum(0, 2 - 2 * d))).astype(np.float32)
            ids, far, opened = np.concatenate([ids, new], axis=1), np.concatenate([far, d], axis=1), np.concatenate([opened, known], axis=1)
            if far.shape[1] > width:
                best = np.argpartition(far, width - 1, axis=1)[:, :width]
                ids, far, opened = (np.take_along_axis(a, best, 1) for a in (ids, far, opened))
            waiting = np.where(opened, np.inf, far)
            at = np.argpartition(waiting, min(wide, waiting.shape[1]) - 1, axis=1)[:, :wide]
            go = np.isfinite(np.take_along_axis(waiting, at, 1))
            if not go.any():
                break
            np.put_along_axis(opened, at, True, axis=1)
            new = np.where(go[:, :, None], self.links[np.minimum(np.take_along_axis(ids, at, 1), n - 1)], n).reshape(len(x), -1).astype(np.int32)
        order = np.argsort(far, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def lists_of(graph: CentroidGraph, x: np.ndarray, k: int, ratio: float, least: int, base: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(lists, kept) of unit vectors: of the ``k`` nearest lists, the ``least`` first ones and those within (1 + ratio)
    of the distance of the one at place ``base`` are kept."""
    ids, far = graph.nearest(x, k)
    limit = (1 + ratio) * far[:, min(base, far.shape[1]) - 1][:, None]
    return ids, np.isfinite(far) & ((far <= limit) | (np.arange(far.shape[1]) < least))


def lists_holding(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return lists_of(graph, x, REPLICAS, graph.near, 1)


def lists_scanned(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return lists_of(graph, x, int(np.ceil(MOST * graph.scanned())), graph.far, LEAST, 4)


def _dealt(rows: DataFrame, graph, lists) -> DataFrame:
    """(region, vec_id, v, lists): each vector once for each region of neighbouring lists that it is in.

    ``lists`` is lists_holding or lists_scanned.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, kept = lists(graph.value, _unit(_matrix(part.column("v"))))
                row, column = np.nonzero(kept)
                own = ids[row, column]
                order = np.lexsort((own, row))
                row, own = row[order], own[order]
                begins = np.flatnonzero(_begins(row, own // REGION))
                vectors = pa.array(row[begins])
                held = pa.ListArray.from_arrays(pa.array(np.append(begins, len(own)), pa.int32()), pa.array(own, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(own[begins] // REGION, pa.int32()), part.column("vec_id").take(vectors), part.column("v").take(vectors), held], ["region", "vec_id", "v", "lists"])

    return rows.mapInArrow(run, "region int, vec_id long, v array<double>, lists array<int>")


def _blocks(rows: DataFrame, own: str, others: str, sizes: DataFrame) -> DataFrame:
    """Rows with ``own`` block number, once for each block of the other side."""
    return rows.join(sizes, "region").select("region", "vec_id", "v", "lists", F.xxhash64("v").alias("mark"), F.pmod(F.xxhash64("vec_id", "v"), F.col(f"n_{own}")).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(f"n_{others}") - 1)).alias(others))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): rows whose vector has components, all finite and none null, and is not zero; equal rows once."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).distinct().select("vec_id", F.col("v").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def fitted(rows: DataFrame, total: int) -> CentroidGraph:
    """Centroids of a sample of SAMPLE keys or so of ``total``, picked by hash, each by one of its vectors."""
    picked = rows if total <= SAMPLE else rows.where(F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * SAMPLE / total)))
    sample = picked.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").toArrow()
    x = _unit(_matrix(sample.column("v")))
    lists = 1 << max(0, round(np.log2(max(1.0, min(LISTS, total / LIST_SIZE, len(x) / 2)))))
    probes = x[:: max(1, len(x) // PROBES)]
    return CentroidGraph(halved(x, lists)).measure(probes)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of every row whose key is divisible by ``every``, by largest cosine.

    query_id, rank (from 1), vec_id, score (the cosine in double precision on the vectors as given), nearest
    first, ties to the smaller vec_id. Vectors that are null, empty or zero, or hold a null or non-finite
    component, take no part; nor do those whose length is not the most frequent one (the smaller on a tie).
    Rows with one key are one vector's repeats: none is its own query's candidate, each of their vectors is
    asked, and each pair comes once, with its best score. Equal rows are one before anything is counted, fitted or
    indexed. The centroids are fitted on SAMPLE of these rows or so; all others are indexed by them. An empty table
    gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    with Scratch(spark, "neighbours") as tmp:
        rows = tmp.written(usable(vectors, key, vector), "vectors")
        lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if lengths is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        rows = rows.where(F.size("v") == lengths["d"])
        # Of equal vectors only the k + 1 smallest keys can be among the k nearest of anything.
        place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        few = tmp.written(rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "few")
        total = few.select("vec_id").distinct().count()
        graph = spark.sparkContext.broadcast(fitted(few, total))  # LISTS centroids at most
        posting = tmp.written(_dealt(few, graph, lists_holding), "posting")
        # Queries by their vector, which is named by the smallest key that asks for it and the vector's hash.
        asking = rows.where(F.col("vec_id") % every == 0)
        named = tmp.written(asking.groupBy("v").agg(F.min("vec_id").alias("vec_id")), "named")
        members = tmp.written(asking.join(named.withColumnRenamed("vec_id", "first"), "v").select(F.col("vec_id").alias("query_id"), "first", F.xxhash64("v").alias("mark")), "members", keep=True)
        asked = tmp.written(_dealt(named, graph, lists_scanned), "asked")
        found = _ranked(_compared(posting, asked, k + 1, tmp), ["first", "mark"], k + 1).drop("rank")
        found = tmp.written(found, "found", keep=True)

        # Queries whose lists hold too few keys are held against all vectors.
        full = found.groupBy("first", "mark").count().where(F.col("count") >= min(k + 1, total))
        short = tmp.written(named.withColumnRenamed("vec_id", "first").withColumn("mark", F.xxhash64("v")).join(full, ["first", "mark"], "left_anti"), "short")
        if short.limit(1).count():
            whole = lambda df: df.select(F.lit(0).alias("region"), "vec_id", "v", F.array(F.lit(0)).alias("lists"))
            rest = _ranked(_compared(whole(few), whole(short.withColumnRenamed("first", "vec_id")), k + 1, tmp), ["first", "mark"], k + 1).drop("rank")
            found = tmp.written(found.join(short, ["first", "mark"], "left_anti").unionByName(rest), "all", keep=True)

    # Every key that asks for a vector takes its best keys but itself.
    pairs = found.join(members, ["first", "mark"]).where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _ranked(pairs, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _compared(posting: DataFrame, asked: DataFrame, k: int, tmp: Scratch) -> DataFrame:
    """(first, mark, vec_id, score): the ``k`` best keys of each query in each block of its regions, keys once."""
    count = lambda df, size, name: df.groupBy("region").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = tmp.written(count(posting, VECTOR_BLOCK, "n_vb").join(count(asked, QUERY_BLOCK, "n_qb"), "region"), "sizes")
    at = ["region", "vb", "qb"]
    sides = [_blocks(df, own, other, F.broadcast(sizes)).groupBy(*at) for df, own, other in ((posting, "vb", "qb"), (asked, "qb", "vb"))]  # LISTS / REGION rows
    near = sides[0].cogroup(sides[1]).applyInArrow(_searched(k), "first long, mark long, vec_id long, score double")
    return near.groupBy("first", "mark", "vec_id").agg(F.max("score").alias("score"))


def _ranked(pairs: DataFrame, query: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _searched(k: int):
    """A block of a region's vectors against a block of its queries, list by list: each query's ``k`` best keys."""

    def search(left, right):
        import pyarrow as pa

        ids, asks, marks = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy(), right.column("mark").to_numpy()
        row = at = np.zeros(0, np.int64)
        score = np.zeros(0)
        if len(ids) and len(asks):
            v, q = _matrix(left.column("v")), _matrix(right.column("v"))
            vn, qn = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            unit, ask = v / vn[:, None], q / qn[:, None]
            in_list, of_query = _members(left.column("lists")), _members(right.column("lists"))
            hits = [row]
            for x in in_list.keys() & of_query.keys():
                here, there = in_list[x], of_query[x]
                # The product ranks roughly; all that reach the k best rows but for rounding are scored one way.
                rough = ask[there] @ unit[here].T
                r, c = np.nonzero(rough >= _reach(rough, ids[here], k)[:, None] - 1e-9)
                hits.append(there[r] * len(ids) + here[c])
            pairs = np.unique(np.concatenate(hits))
            row, at = pairs // len(ids), pairs % len(ids)
            score = np.concatenate([score, *((v[at[i : i + 65536]] * q[row[i : i + 65536]]).sum(axis=1) / (vn[at[i : i + 65536]] * qn[row[i : i + 65536]]) for i in range(0, len(row), 65536))])
            order = np.lexsort((-score, ids[at], row))  # a key once, by its best score
            order = order[_begins(row[order], ids[at[order]])]
            order = order[np.lexsort((ids[at[order]], -score[order], row[order]))]
            begins = np.flatnonzero(_begins(row[order]))
            place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            order = order[place < k]
            row, at, score = row[order], at[order], score[order]
        return pa.table({"first": pa.array(asks[row], pa.int64()), "mark": pa.array(marks[row], pa.int64()), "vec_id": pa.array(ids[at], pa.int64()), "score": pa.array(score, pa.float64())})

    return search


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.any([np.diff(c) != 0 for c in columns], axis=0)
    return out


def _members(lists) -> dict[int, np.ndarray]:
    """Row numbers by list, of a column of arrays of lists."""
    column = lists.combine_chunks() if hasattr(lists, "combine_chunks") else lists
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    order = np.argsort(flat, kind="stable")
    names, begins = np.unique(flat[order], return_index=True)
    return dict(zip(names.tolist(), np.split(rows[order], begins[1:])))


def _reach(rough: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each row, counting each of ``ids`` once, by its best."""
    by_id = np.argsort(ids, kind="stable")
    firsts = np.flatnonzero(np.r_[True, np.diff(ids[by_id]) != 0])
    best = rough if len(firsts) == len(ids) else np.maximum.reduceat(rough[:, by_id], firsts, axis=1)
    k = min(k, best.shape[1])
    return np.partition(best, -k, axis=1)[:, -k]


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))

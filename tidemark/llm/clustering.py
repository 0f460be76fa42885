"""Centroid clustering with zone maps along a Hilbert curve.

Vectors are put in the order of a space-filling curve over all their components and cut into blocks of
BLOCK neighbours; a block is one row with its vectors and the least and largest of each component, its box.
For every block the boxes' bounds say which centroids can be nearest to any of its vectors: a centroid is out
if another one is nearer everywhere in the box. The difference of two squared distances is linear in the
vector, so its largest value over a box is at a corner and is found without visiting one. Only the
candidates are compared with the block's vectors, exactly and all at once.

The blocks are written once; every round reads them and passes on one row of sums a cluster and task.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, small_batches, table
from tidemark.scratch import Scratch

#: Vectors of a block, bits a component of the curve, and the largest size of a component: squared distances fit a long.
BLOCK, BITS, LARGEST = 64, 4, 2**27


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on a Hilbert curve of cells [n, dimensions] of ``bits`` bits each, as rows of bytes in big-endian order.

    Cell axes are turned into the curve's axes from the highest bit plane down: where an axis has the bit, the lower bits
    of the first axis are inverted, elsewhere they are exchanged with that axis; a Gray code over the axes follows.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for i in range(len(axes)):
            has = (axes[i] >> plane & 1).astype(bool)
            swap = np.where(has, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(has, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for plane in range(bits - 1, 0, -1):
        flip = np.where(axes[-1] >> plane & 1, flip ^ ((1 << plane) - 1), flip)
    planes = [(a ^ flip) >> plane & 1 for plane in range(bits - 1, -1, -1) for a in axes]
    return np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector within a box: all but those that the centroid nearest to
    the box's middle beats everywhere in it. Ties keep a centroid, so the smallest number wins among the candidates."""
    low, high, c = low.astype(float), high.astype(float), centroids.astype(float)
    best = int((((low + high) / 2 - c) ** 2).sum(axis=1).argmin())
    slope = -2 * (c[best] - c)
    norms = (c**2).sum(axis=1)
    most = np.maximum(slope * low, slope * high).sum(axis=1) + norms[best] - norms  # of the distance to best less that to each
    slack = 1e-9 * (1 + np.abs(slope).sum() * max(np.abs(low).max(), np.abs(high).max()) + norms.max())  # more than rounding makes
    keep = most >= -slack
    keep[best] = True
    return np.flatnonzero(keep)


def nearest(vectors: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of ``among`` to every vector, exactly; ties to the smaller number."""
    own = centroids[among]
    size = max(int(np.abs(vectors).max()), int(np.abs(own).max()))
    if vectors.shape[1] * 4 * size * size < 2**53:  # whole numbers that doubles hold: the product is a matrix product
        x, c = vectors.astype(float), own.astype(float)
        d = (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)
    else:
        d = np.stack([((vectors - c) ** 2).sum(axis=1) for c in own], axis=1)
    at = d.argmin(axis=1)
    return among[at], d[np.arange(len(d)), at].astype(np.int64)


def whole_numbers(vector: Column) -> Column:
    """floor(64 * x) of each component, within LARGEST."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * 64))).cast("int"))


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has that many components, none of them null or non-finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & ~odd, F.lit(False))


def _lists(batch, name: str) -> np.ndarray:
    """A batch's list column whose lists are equally long, as rows of a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def blocks(vectors: DataFrame, dimensions: int, block: int = BLOCK) -> DataFrame:
    """``vectors(id, x)`` of whole numbers as rows (ids, x, low, high): neighbours on the curve, ``block`` of them at most.

    Partitions are ranges of the curve; equal places are told apart by id and by row, so that repeated vectors spread over
    partitions too.
    """
    ends = vectors.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    lowest, width = (ends[0] or 0), max(1, (ends[1] or 0) - (ends[0] or 0))

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                keys = hilbert_keys((_lists(batch, "x") - lowest) * (2**BITS - 1) // width)
                key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(keys.shape[1]), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))])
                yield pa.RecordBatch.from_arrays([key.cast(pa.binary()), *batch.columns], ["key", *batch.schema.names])
        give_back()

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, first = _lists(batch, "x"), np.arange(0, batch.num_rows, block)
            at = pa.array(np.append(first, batch.num_rows), pa.int32())
            lists = lambda values, starts: pa.ListArray.from_arrays(starts, pa.array(values.astype(np.int32).ravel()))
            boxes = pa.array(np.arange(len(first) + 1) * dimensions, pa.int32())
            columns = [pa.ListArray.from_arrays(at, batch.column("id")), lists(x, pa.array(np.append(first, batch.num_rows) * dimensions, pa.int32())), lists(np.minimum.reduceat(x, first), boxes), lists(np.maximum.reduceat(x, first), boxes)]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "x", "low", "high"])
        give_back()

    small_batches(vectors.sparkSession)
    keyed = vectors.withColumn("row", F.monotonically_increasing_id()).mapInArrow(placed, "key binary, id long, x array<int>, row long")
    order = ("key", "id", "row")
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "ids array<long>, x array<int>, low array<int>, high array<int>")


def _assigned(batch, centroids: np.ndarray):
    """(ids, vectors, number, squared distance) of each block of a batch."""
    low, high = _lists(batch, "low"), _lists(batch, "high")
    ids, x = batch.column("ids"), batch.column("x")
    for i in range(batch.num_rows):
        vectors = x[i].values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, centroids.shape[1])
        yield ids[i].values, vectors, *nearest(vectors, centroids, candidates(low[i], high[i], centroids))


def totals(zones: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Of each cluster with vectors: how many, their summed distance, and the sums of their components. A task passes on a
    row a cluster, and so many rows in all reach the driver once Spark has added them up."""
    k, dimensions = centroids.shape

    def summed(batches):
        import pyarrow as pa

        count, distance, sums = np.zeros(k, np.int64), [0] * k, np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for _, vectors, number, d in _assigned(batch, centroids):
                count += np.bincount(number, minlength=k)
                np.add.at(sums, number, vectors)
                for c in np.unique(number):
                    distance[c] += sum(d[number == c].tolist())
        own = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * dimensions, pa.int32()), pa.array(sums[own].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), pa.array([str(distance[c]) for c in own], pa.string()), lists], ["cluster", "n", "distance", "sums"])
        give_back()

    rows = zones.mapInArrow(summed, "cluster int, n long, distance string, sums array<long>")
    added = rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dimensions)]).alias("sums"))
    return {r["cluster"]: (r["n"], int(r["d"]), r["sums"]) for r in added.collect()}


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, dimensions: int = 64, rounds: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per usable vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become floor(64 * x). Centroids start as the ``k`` vectors with the smallest SHA-256 of ``1:<key>`` (ties by
    components; fewer if there are fewer), and ``rounds`` times become the floor of the mean of the vectors nearest to
    them; empty ones stay. Distances are squared and exact; ties go to the smaller number. Vectors that are null, of another
    length, or hold a null or non-finite component have no row; components beyond LARGEST / 64 count as that much. A null
    key is a vector like others, its hash that of ``1:``. Repeated rows come back repeated, an empty table gives an empty
    result, and other columns are not read, whatever their names. A sum of distances that no long holds is null.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col(vector), dimensions)).select(F.col(key).cast("long").alias("id"), whole_numbers(F.col(vector)).alias("x"))
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(name, "x").limit(k).collect()  # k vectors
    centroids = np.array([r["x"] for r in start], np.int64).reshape(-1, dimensions)
    tmp = Scratch(spark, "clustering")
    zones = tmp.written(blocks(kept, dimensions, block), "zones", keep=True)
    for _ in range(rounds if len(centroids) else 0):
        for number, (n, _, sums) in totals(zones, centroids).items():
            centroids[number] = [s // n for s in sums]
    last = totals(zones, centroids) if len(centroids) else {}
    long = lambda n: n if n < 2**63 else None
    inertia, whole = [long(last[c][1]) if c in last else None for c in range(len(centroids))], long(sum(d for _, d, _ in last.values()))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def shown(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, _, number, d in _assigned(batch, centroids):
                of = lambda values, kind: pa.array(values, kind).take(pa.array(number))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(d), of(inertia, pa.int64()), pa.array([whole] * len(d), pa.int64()), of(digests, pa.string())], ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
        give_back()

    return zones.mapInArrow(shown, "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").withColumnRenamed("id", key)


def compared(vectors: DataFrame, vector: str = "embedding", k: int = 16, dimensions: int = 64, block: int = BLOCK) -> float:
    """Which share of all pairs of a vector and a starting centroid the boxes leave to be compared."""
    kept = vectors.where(usable(F.col(vector), dimensions)).select(F.lit(0).cast("long").alias("id"), whole_numbers(F.col(vector)).alias("x"))
    centroids = np.array([r["x"] for r in kept.orderBy(F.xxhash64("x")).limit(k).collect()], np.int64)

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            low, high = _lists(batch, "low"), _lists(batch, "high")
            sizes = [len(v) for v in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(candidates(*box, centroids)) * n for *box, n in zip(low, high, sizes)], pa.int64()), "all": pa.array([len(centroids) * n for n in sizes], pa.int64())})

    r = blocks(kept, dimensions, block).mapInArrow(counted, "n long, all long").agg(F.sum("n"), F.sum("all")).first()
    return r[0] / r[1]


def _sql(k: int = 16, dimensions: int = 64, rounds: int = 3) -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS cluster, x AS c FROM v ORDER BY sha256('1:' || vec_id), x LIMIT {k})",
    ]
    for r in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        parts.append(f"a{r} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': {distance}, 'n': cluster}}) AS m FROM v, c{r} GROUP BY row)")
        mean = "(s - ((s % n) + n) % n) // n"
        parts.append(f"s{r} AS (SELECT m.n AS cluster, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dimensions + 1}) t(i) GROUP BY 1, 2)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(any_value(f), any_value(c)) AS c FROM c{r} LEFT JOIN (SELECT cluster, list({mean} ORDER BY i) AS f FROM s{r} GROUP BY 1) USING (cluster) GROUP BY 1)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, m.n::INTEGER AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.n)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON cluster = m.n"""


OP12_SQL = _sql()


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))

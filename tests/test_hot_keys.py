"""Keys and tokens that very many items share: no task gets them all, and results are as before."""

from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from tests.test_dedup import SCHEMA, model, similar
from tidemark.operators import dedup

PARTITIONS = 32


@pytest.fixture
def parts(spark):
    """Shuffles of PARTITIONS partitions that stay as they are."""
    own = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_no_task_gets_a_key(spark, parts):
    """One key of 100,000 rows beside 20,000 others: no task over five times the median."""
    rows = spark.range(120_000).select(F.col("id").alias("pos"), F.when(F.col("id") < 100_000, -1).otherwise(F.col("id")).alias("key"))
    found = rows.groupBy("key").agg(F.count("*").alias("n"))
    out = dedup.beside(rows, found, ["key"])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 120_000 and max(sizes) <= 5 * median(sizes)
    assert out.where(F.col("n") != F.when(F.col("key") == -1, 100_000).otherwise(1)).isEmpty()
    assert out.columns == ["key", "pos", "n"]


def test_a_token_on_all_titles(spark):
    """A token that every title has, as often as any other: pairs are those of brute force."""
    titles = [f"{a}x {b}y {c}z hot" for a in "abcd" for b in "efgh" for c in "ij"] + [f"hot {a}x {b}y {c}z 7" for a in "ab" for b in "ef" for c in "ij"] * 2
    items = spark.createDataFrame([(i, "d0", t) for i, t in enumerate(titles)], "pos long, bucket string, title string")
    got = {tuple(r) for r in dedup.similar_pairs(items).collect()}
    assert got == {(i, j) for i in range(len(titles)) for j in range(i) if similar(titles[i], titles[j])}


def test_a_hash_on_most_items(spark):
    rows = [(i, "same" if i % 3 else f"c{i}", f"l{i}", f"u{i % 40}", "d0", f"w{i}q v{i * 7}r") for i in range(200)]
    got = {r.pos: (r.canonical, r.matched) for r in dedup.greedy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == model(rows)
    assert Counter(m for _, m in got.values())["content"] > 100

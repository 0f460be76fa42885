"""Greedy entity resolution against a sequential model of the rule."""

import random
import re
from difflib import SequenceMatcher

import pytest

from tidemark.operators import dedup

SCHEMA = "pos long, content_hash string, legacy_hash string, url_key string, bucket string, title string"


def similar(left, right):
    if left == right:
        return True
    a, b = set(left.split()), set(right.split())
    if {t for t in a if re.fullmatch(r"\d+", t)} != {t for t in b if re.fullmatch(r"\d+", t)}:
        return False
    overlap = len(a & b) / len(a | b) if a | b else 0
    return overlap >= 0.92 or overlap >= 0.75 and SequenceMatcher(None, left, right, autojunk=False).ratio() >= 0.92


def model(rows):
    keys, named, titles, out = {}, {}, {}, {}
    for pos, content, legacy, url, bucket, title in rows:
        owner = keys.get(content)
        matched = "content" if owner is not None else None
        if owner is None and (owner := keys.get(legacy)) is not None:
            matched = "legacy"
        if owner is None and (owner := named.get(url)) is not None:
            matched = "url"
        if owner is None and title:
            owner = next((p for t, p in titles.get(bucket, []) if similar(title, t)), None)
            matched = "title" if owner is not None else None
        if owner is None:
            owner = pos
            keys[content] = keys[legacy] = pos
            if url:
                named[url] = pos
            if title:
                titles.setdefault(bucket, []).append((title, pos))
        out[pos] = (owner, matched)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy(spark, seed):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(4, 14))] + [str(rng.randrange(3))] for _ in range(12)]
    rows = []
    for pos in range(160):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        title = " ".join(words) if rng.random() < 0.95 else ""
        rows.append((pos, f"c{rng.randrange(120)}", f"l{rng.randrange(120)}", f"u{rng.randrange(150)}" if rng.random() < 0.9 else "", f"d{rng.randrange(2)}", title))
    got = {r.pos: (r.canonical, r.matched) for r in dedup.greedy(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == model(rows)


def test_empty(spark):
    assert dedup.greedy(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages(spark):
    from tidemark.plans.catalogue import QUERIES, _pages
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    pages = _pages(spark, d)
    rows = sorted(tuple(r) for r in dedup.keyed(pages, F.col("page_id"), F.col("title"), F.col("url"), F.lit(None).cast("string")).collect())
    got = {r.page_id: (r.canonical, r.matched) for r in QUERIES["greedy_dedup"](spark, d).collect()}
    assert got == model(rows)

"""Source mixing: the method against a step-by-step version, targets, tolerance, repeats."""

import random
import zlib
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from tidemark.llm import mixing


def test_highest_quotients_step_by_step():
    for seed in range(200):
        r = random.Random(seed)
        weights = {i: r.choice([r.randint(0, 50), r.randint(1, 5000), 10]) for i in range(r.randint(1, 9))}
        seats, most = r.randint(0, 200), {i: r.randint(0, 60) for i in weights} if seed % 2 else None
        own = dict.fromkeys(weights, 0)
        for _ in range(seats):
            open_ = [k for k in weights if weights[k] > 0 and (most is None or own[k] < most[k])]
            if not open_:
                break
            own[max(open_, key=lambda k: (Fraction(weights[k], 2 * own[k] + 1), -k))] += 1
        assert mixing.highest_quotients(seats, weights, most) == own


def test_targets_stop_and_are_reshared():
    sizes = {"a": 10, "b": 1000, "c": 1000}
    got = mixing.targets(sizes, {"a": 5, "b": 2, "c": 1})
    assert got["a"] == 30 and got["b"] == Fraction(1980 * 2, 3) and sum(got.values()) == 2010
    assert mixing.targets({"a": 0}, {"a": 5}) == {"a": 0}


def _docs(spark, seed=1, n=600):
    r = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 3, 40, 400]))), r.choice(["s1", "s2", "S3", "é", None, "hot", "hot", "hot"]), "clash", i) for i in range(n)]
    rows += [(n, None, "s1", "", 0), (n, None, "s1", "", 0), (n + 1, "w " * 500, "s1", "", 0), (n + 1, "w " * 500, "s1", "", 0), (None, "w w", "s2", "", 0), (n + 2, "w " * 200_000, "long", "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string, size long")


def test_mix(spark):
    docs = _docs(spark)
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))  # reruns agree
    assert len(rows) == docs.count()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size is not None
    order = sorted(s for s in size if s is not None) + [None]
    expected = mixing.targets(dict(size), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for s in size:
        assert target[s] == float(expected[s]) and all(r.source_size == size[s] for r in rows if r.source == s)
        assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK + 0.01 * target[s]


def test_documents_are_taken_whole(spark):
    docs = _docs(spark)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    before, after = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        before[tuple(r)] += 1
    for r in out.collect():
        after[tuple(r)] += 1
    assert set(after) <= set(before) and all(n <= 3 * before[k] for k, n in after.items())
    assert mixing.mix_documents(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def model_taken(rows, source, quota, seed=17):
    """Words that each of a shard's rows gives: the shard's words laid out one by one, whole passes and a run of blocks."""
    words = [i for i, n in enumerate(rows) for _ in range(n)]
    blocks = -(-len(words) // mixing.BLOCK)
    out = [0] * len(rows)
    if not words:
        return out
    begin = zlib.crc32(f"{seed}:{source}:0".encode()) % blocks
    for block in range(quota):
        at = block % blocks if block < quota // blocks * blocks else (begin + block - quota // blocks * blocks) % blocks
        for i in words[at * mixing.BLOCK : (at + 1) * mixing.BLOCK]:
            out[i] += 1
    return out


def test_taken_words_by_a_list_model(spark):
    """One shard a source: every document's taken words, word by word, from the quotas of the method."""
    rng = random.Random(12)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 30, 150, 700]))), rng.choice(["a", "b", "c", None])) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(18), "doc_id").alias("h")).collect()}
    by = {s: sorted([(order[i], i, len(t.split())) for i, t, of in rows if of == s]) for s in ("a", "b", "c", None)}
    sizes = {s: sum(n for _, _, n in r) for s, r in by.items()}
    goal = mixing.targets(sizes, dict(zip(by, (5, 2, 1, 5))))
    most = {s: 3 * -(-n // mixing.BLOCK) for s, n in sizes.items()}
    quotas = mixing.highest_quotients(round(Fraction(sum(sizes.values()), mixing.BLOCK)), {s: goal[s] for s in by}, most)
    for s, own in by.items():
        assert [got[i] for _, i, _ in own] == model_taken([n for _, _, n in own], s, quotas[s])


def test_rows_that_tie_in_key_and_size(spark):
    rows = [(7, f"{c} " * 40, "a", None) for c in "pqrstuvw"] * 2 + [(8, "z " * 900, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `_size` long")
    out = [sorted(map(str, mixing.mix_documents(docs.repartition(n)).collect())) for n in (1, 5)]
    assert out[0] == out[1]


def test_documents_by_a_list_model(spark):
    """One shard a source: how often each document comes, from the words that the list model takes of it."""
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 2, 60, 300, 900]))), rng.choice(["a", "b", None]), {"k": i}) for i in range(90)]
    rows += [(500, "v " * 33, "b", {"k": 1})] * 25 + [(501, None, "a", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,int>")
    got = defaultdict(int)
    for r in mixing.mix_documents(docs).collect():
        got[r.doc_id, r.text, r.source, str(r.more)] += 1
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(18), "doc_id").alias("h")).collect()}
    by = {s: sorted([(order[i], i, len((t or "").split()), t, str(m)) for i, t, of, m in rows if of == s], key=lambda r: r[:3]) for s in ("a", "b", None)}
    sizes = {s: sum(r[2] for r in own) for s, own in by.items()}
    goal = mixing.targets(sizes, dict(zip(by, (5, 2, 1))))
    quotas = mixing.highest_quotients(round(Fraction(sum(sizes.values()), mixing.BLOCK)), goal, {s: 3 * -(-n // mixing.BLOCK) for s, n in sizes.items()})
    expected = defaultdict(int)
    for s, own in by.items():
        whole = quotas[s] // -(-sizes[s] // mixing.BLOCK)
        for (_, i, n, t, m), words in zip(own, model_taken([r[2] for r in own], s, quotas[s])):
            times = whole + (2 * (words - whole * n) >= n) if n else 1
            if times:
                expected[i, t, s, m] += times
    assert dict(got) == dict(expected)


def test_shards_are_apportioned_down_a_tree(spark, monkeypatch):
    """Three levels of three children: every quota is what the method gives a node's children, from the source down."""
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(8)
    lengths = {(s, k): rng.choice([0, 10, 700, 5000]) for s in range(3) for k in range((27, 5, 1)[s])}
    blocks = {k: -(-n // mixing.BLOCK) for k, n in lengths.items()}
    own = {s: min(n, 3 * sum(b for (of, _), b in blocks.items() if of == s)) for s, n in enumerate((1500, 77, 9))}
    counts = spark.createDataFrame(list(own.items()), "_s long, _own long")
    table = spark.createDataFrame([(s, k, n) for (s, k), n in lengths.items()], "_s long, _shard long, _length long")
    got = {(r._s, r._shard): r._quota for r in mixing.shares(table, counts, 27).collect()}

    def down(s, node, width, seats):
        if not width:
            return {(s, node): seats}
        inside = {c: [k for k in lengths if k[0] == s and k[1] // width == c] for c in range(3 * node, 3 * node + 3)}
        inside = {c: ks for c, ks in inside.items() if ks}
        given = mixing.highest_quotients(seats, {c: sum(lengths[k] for k in ks) for c, ks in inside.items()}, {c: sum(3 * blocks[k] for k in ks) for c, ks in inside.items()})
        return {k: n for c in inside for k, n in down(s, c, width // 3, given[c]).items()}

    assert got == {k: n for s in own for k, n in down(s, 0, 9, own[s]).items()}
    for s in own:
        assert sum(n for (of, _), n in got.items() if of == s) == own[s]
    assert all(n <= 3 * blocks[k] for k, n in got.items())


def test_a_row_that_makes_up_much_of_the_table(spark, monkeypatch):
    """Equal rows, and one key of many texts, are spread over shards and tasks; nothing is lost and reruns agree."""
    monkeypatch.setattr(mixing, "COPIES", 16)
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 600)
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = [(1, "hot " * 20, "a")] * 300 + [(None, f"{'t ' * (i % 50)}", "b") for i in range(300)] + [(i, "c " * 90, "c") for i in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    narrow = docs.select(F.col("source").alias("_of"), F.col("doc_id").alias("_key"), mixing.token_count(F.col("text")).alias("_size"), F.xxhash64("text").alias("_mark"), F.lit(0).alias("_also"))
    pieces = mixing.laid(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("_n"))).collect()
    assert max(p._copies for p in pieces) == 16 and len({p._shard for p in pieces if p._key == 1}) > 3 and len({p._shard for p in pieces if p._key is None}) > 3
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    taken, copies = defaultdict(int), mixing.mix_documents(docs)
    for r in out:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    for r in {r.source: r for r in out}.values():
        assert abs(taken[r.source] - r.target) <= 0.1 * r.target
    kept = defaultdict(int)
    for r in copies.collect():
        kept[r.source] += len(r.text.split())
    assert all(abs(kept[s] - taken[s]) <= 0.1 * taken[s] for s in taken)
    assert sorted(map(str, copies.collect())) == sorted(map(str, mixing.mix_documents(docs.repartition(5)).collect()))

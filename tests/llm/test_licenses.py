"""License scans against plain sets over all blocks and notices, odd rows, and a plan without Python."""

import random
import re
from collections import Counter

from tidemark.llm import licenses as li

SCHEMA = "doc_id long, text string, words int, `a.b` string, N_WORDS int, start int"


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for p, label in li.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    met = set()
    for i, n in enumerate(li.notices()):
        for start in range(0, max(len(w) - n["span"], 1), n["span"]):
            shared = set(w[start : start + 2 * n["span"]]) & set(n["words"])
            if 100 * len(shared) >= 90 * len(n["words"]):
                met.add((start, i, n["label"], len(shared) / len(n["words"])))
    labels = sorted({x for _, x in places})
    ats = [i for i, _ in places]
    score = 1.0 if places else max((m[3] for m in met), default=0.0)
    return len(w), len(ats), min(ats, default=None), max(ats, default=None), ",".join(labels), ",".join(sorted({*labels, *(m[2] for m in met)})), len(met), score


def texts(n, seed=3):
    rng = random.Random(seed)
    notices = [t for _, t in li.NOTICES]
    common = sorted({w for t in notices for w in li.notice_words(t)})
    made = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                ws = rng.choice(notices).split()
                for _ in range(rng.randint(0, 5)):  # edits on either side of the threshold
                    ws[rng.randrange(len(ws))] = rng.choice(["X", "é", "the", rng.choice(common)])
                parts.append(" ".join(ws))
            elif kind < 0.6:
                parts.append(rng.choice(["Under the MIT License", "under,the\nMIT-license!", "CC BY-NC cc by nc", "apache license version 2", "underthe mit license", "CC BY NC", "apache license version 20"]))
            else:
                parts.append(" ".join(rng.choice(common) for _ in range(rng.randint(1, 90))))
        made.append(rng.choice([" ", "\n", ". "]).join(parts))
    return made


ODD = [None, "", " \t\n", "!!!", "x", "K cc by Knc", "İ cc by nc İ", "CC BY-NC" * 3, "cc by nc " * 3, "\x00cc\x7fby\x00nc\x00", "中文 under the mit license 中文", "word " * 60_000 + "Released under the MIT License.", "a" * 200_000, "MIT License, the under released."]


def test_against_plain(spark):
    rows = texts(300) + ODD
    rows += rows[:40] + ["Licensed under CC BY-NC 4.0."] * 60
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1, "x", 2, 3) for i, t in enumerate(rows)] + [(77, rows[5], 1, "x", 2, 3)] * 30, SCHEMA).repartition(5)
    got = Counter(tuple(r) for r in li.license_scan(docs).collect())
    assert got == Counter([(i if i % 9 else None, *plain(t)) for i, t in enumerate(rows)] + [(77, *plain(rows[5]))] * 30)
    assert li.license_scan(docs.where("false")).collect() == []


def test_each_notice_is_found(spark):
    docs = spark.createDataFrame([(i, "lorem ipsum " * 40 + t.upper() + " dolor sit" * 40) for i, (_, t) in enumerate(li.NOTICES)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in li.license_scan(docs).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(li.NOTICES))


def test_order_is_of_the_whole_corpus(spark):
    docs = spark.createDataFrame([("license the the",), ("the",), ("mit the",), ("mit",)], "text string")
    assert li.frequency_order(docs, "text", ["the", "mit", "license", "absent"]) == ["absent", "license", "mit", "the"]


def test_no_python_in_the_plan(spark):
    docs = spark.range(10).selectExpr("id AS doc_id", "'Released under the MIT License.' AS text")
    plan = li.license_scan(docs)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan) and "BroadcastHashJoin" in plan

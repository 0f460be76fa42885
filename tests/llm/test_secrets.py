"""Secret scans: base spans by hand, models by held-out samples, rows on odd inputs."""

import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import regex

from tidemark.llm import secrets

HEX40 = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def test_base_spans():
    kinds = lambda t: [(secrets.KINDS[k], t[s:e]) for s, k, e in secrets.base_spans(t)]
    assert kinds(f'é token = "{HEX40}" x') == [("assign", f'token = "{HEX40}'), ("hex", HEX40)]
    assert kinds("PassWord:abcdefg1 api-key=12345678 apikey=12345678 api_key='1234567'") == [("assign", "PassWord:abcdefg1"), ("assign", "apikey=12345678")]
    assert kinds('token: "secret" = "abcdefgh1234"') == []  # the dropped match still hides the second key
    assert kinds("AKIAABCDEFGHIJKL AKIAABCDEFGHIJK") == [("access", "AKIAABCDEFGHIJKL")]
    assert kinds("toKen=12345678 ſecret=12345678") == []  # only ASCII letters fold
    assert secrets.base_spans("") == []


def test_models_tell_held_out_samples_apart():
    ratios = secrets.log_ratio(np.zeros((2, secrets.K * secrets.K), np.int64))
    score = lambda t: (lambda c: ratios[c[:-1] * secrets.K + c[1:]].mean())(secrets.classes(t))
    held = secrets.made_up_samples(1000, seed=99)
    right = sum((score(t) > secrets.THRESHOLD) == bool(label) for t, label in held)
    assert right / len(held) > 0.98


def test_random_strings_are_added_and_identifiers_left(spark):
    rng = random.Random(5)
    token = "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(36))
    texts = [None, "", f"see {token} here", "the get_user_name_by_index_2024 and http_server_response_timeout_30 call", f"token = {HEX40}", f"token = {HEX40}", "plain words only " * 5000]
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in enumerate(texts)], "doc_id long, text string, n_hex int, spans string")
    rows = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert len(rows) == len(texts)
    assert rows[0].spans == rows[1].spans == rows[3].spans == rows[6].spans == ""
    assert rows[2].spans == f"random:4:{4 + len(token)}" and rows[2].base == ""
    assert rows[4].spans == rows[4].base == f"assign:0:48,hex:8:48" and (rows[4].n_assign, rows[4].n_access, rows[4].n_hex) == (1, 0, 1)
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert clean[2] == "see [SECRET] here" and clean[4] == "[SECRET]" and clean[0] is None and clean[3] == texts[3]
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_query(spark):
    rows = secrets.op2_secret_scan(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = secrets.base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert set(secrets.joined(base).split(",")) <= set(r.spans.split(","))


RULES = ((r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), (r"AKIA[A-Z0-9]+", 0, 16), (r"[0-9a-f]+", 0, 32))


def plain_base(text):
    """The base rules read afresh by another engine: leftmost matches of each kind, then their lengths."""
    found = []
    for kind, (pattern, group, least) in enumerate(RULES):
        found += [(m.start(), kind, m.end()) for m in regex.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


def plain_random(texts):
    """Spans of the models by plain counting: two tables of character pairs, their smoothed ratio, its mean over a candidate."""
    kind = lambda c: c if c in secrets.ALPHABET else ""
    made, corpus = (Counter(), Counter()), (Counter(), Counter())
    for sample, label in secrets.made_up_samples():
        made[label].update(zip(["", *map(kind, sample)], [*map(kind, sample), ""]))
    for text in texts:
        left = list(map(kind, text))
        for start, _, end in plain_base(text):
            own = list(map(kind, text))[start:end] if "".join(left[start:end]) == "".join(map(kind, text[start:end])) else left[start:end]
            corpus[1].update(zip(["", *own], [*own, ""]))
            left[start:end] = [""] * (end - start)
        corpus[0].update(zip(left, left[1:]))
    chars = ["", *secrets.ALPHABET]
    probability = []
    for label in (0, 1):
        total, weight = sum(corpus[label].values()), sum(made[label].values()) * (10 if label == 0 else 1)
        scale = min(1.0, weight / total) if total else 0.0
        count = {(a, b): made[label][a, b] + scale * corpus[label][a, b] if a else 0.0 for a in chars for b in chars}
        row = {a: sum(count[a, b] for b in chars) for a in chars}
        probability.append({(a, b): (n + 0.5) / (row[a] + 0.5 * len(chars)) for (a, b), n in count.items()})
    out = []
    for text in texts:
        base, spans = plain_base(text), []
        for m in regex.finditer(r"[A-Za-z0-9+/_=.-]{20,}", text):
            token = m[0].rstrip(".=-_/")
            start, end = m.start(), m.start() + len(token)
            if len(token) < 20 or not any(c in "0123456789" for c in token) or not any(c.isalpha() for c in token) or len(set(token)) < secrets.MIN_DISTINCT or any(s < end and start < e for s, _, e in base):
                continue
            ratios = [math.log(probability[1][p] / probability[0][p]) for p in zip(token, token[1:])]
            if sum(ratios) / len(ratios) > secrets.THRESHOLD:
                spans.append((start, 3, end))
        out.append(sorted(base + spans))
    return out


def test_all_spans_by_plain_counting(spark):
    rng = random.Random(3)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(120).collect()
    texts = [r.text or "" for r in rows] + [f"key {''.join(rng.choice(secrets.ALPHABET) for _ in range(rng.randint(18, 50)))} end" for _ in range(150)] + [f"run_{rng.choice(['get', 'set'])}_user_name_{i}_and_value_2024" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.base, r.spans) for r in secrets.find_secrets(docs).collect()}
    want = plain_random(texts)
    assert [got[i][1] for i in range(len(texts))] == [secrets.joined(w) for w in want]
    assert [got[i][0] for i in range(len(texts))] == [secrets.joined(plain_base(t)) for t in texts]
    assert sum("random" in spans for _, spans in got.values()) > 50


def test_many_secrets_in_linear_time():
    text = " ".join(f"token = {HEX40} and u{i}Ab3kQ9zLm2xWv7TpRs4" for i in range(20_000))
    ratios = secrets.log_ratio(np.zeros((2, secrets.K * secrets.K), np.int64))
    began = time.process_time()
    base, spans = secrets.scan(text, ratios)
    assert time.process_time() - began < 5 and len(base) == 40_000 and len(spans) > 50_000
    assert secrets.redact(text, spans).count("[SECRET]") >= 40_000

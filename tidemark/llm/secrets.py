"""Secret scans: base patterns plus character Markov models compared by log-likelihood ratio.

Two first-order character models, one of random strings and one of ordinary identifiers and words,
are trained from labelled samples: what the base patterns find in the corpus is labelled random, all
other text ordinary, and a small seeded set of made-up strings of both kinds keeps either model
defined on corpora that lack one. Training counts every document; only the two count tables, whose
size is the alphabet squared, reach the driver.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
K = len(ALPHABET) + 1  # class 0: any other character
CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(ALPHABET):
    CLASS[ord(_c)] = _i + 1
#: Mean log-likelihood ratio a character above which a candidate counts as random.
THRESHOLD = 0.6
MIN_DISTINCT = 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in code points; per kind leftmost and non-overlapping.

    A match that fails its length is dropped after matching, so it still hides what it covers.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def classes(text: str) -> np.ndarray:
    return CLASS[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def bigrams(codes: np.ndarray) -> np.ndarray:
    return np.bincount(codes[:-1] * K + codes[1:], minlength=K * K) if len(codes) > 1 else np.zeros(K * K, np.int64)


def made_up_samples(n: int = 2000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled strings: 1 for random ones over hex, alphanumeric and base64 alphabets, 0 for identifiers."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], "0123456789ABCDEF", ALPHABET[26:62])
    parts = "user name get set value index count list file path data read write load save open close table column row key item node tree map time date type class string number error log test main run job stage model train batch page query result client server request response http config option default version release build update delete insert select order group filter join window stream event source target".split()
    out = [("".join(rng.choice(a) for _ in range(rng.randint(20, 48))), 1) for a in alphabets for _ in range(n // len(alphabets))]
    for _ in range(n):
        words = [rng.choice(parts) for _ in range(rng.randint(2, 5))] + ([str(rng.randint(0, 2030))] if rng.random() < 0.4 else [])
        style = rng.randrange(5)
        out.append(("".join(w.capitalize() for w in words) if style == 0 else "_-/."[style - 1].join(words), 0))
    return out


def sample_counts(samples) -> np.ndarray:
    """Bigram counts [label, K * K] of (string, label) pairs, each string between two class-0 characters."""
    counts = np.zeros((2, K * K), np.int64)
    for text, label in samples:
        counts[label] += bigrams(np.concatenate(([0], classes(text), [0])))
    return counts


def corpus_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Bigram counts [label, K * K] over every whole text; Spark sums the partial tables of the tasks."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros((2, K * K), np.int64)
        for batch in batches:
            for value in batch.column(0):
                body = value.as_py()
                if not body:
                    continue
                codes = classes(body)
                for start, _, end in base_spans(body):
                    total[1] += bigrams(np.concatenate(([0], codes[start:end], [0])))
                    codes[start:end] = 0
                total[0] += bigrams(codes)
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int32()), "pair": pa.array(pair, pa.int32()), "n": pa.array(total[label, pair], pa.int64())})

    rows = docs.select(text).mapInArrow(count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, K * K), np.int64)
    for label, pair, n in rows.collect():  # at most 2 * K * K rows
        counts[label, pair] = n
    return counts


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log P(next | char, random) - log P(next | char, ordinary), each with add-half smoothing.

    Corpus counts of a label are scaled down to the weight of its made-up samples times ten, so that
    a corpus full of one kind of secret does not define randomness alone.
    """
    own = sample_counts(made_up_samples()).astype(float)
    for label in (0, 1):
        if total := counts[label].sum():
            own[label] += counts[label] * min(1.0, (10 if label == 0 else 1) * own[label].sum() / total)
    own[:, 0] = 0  # from one other character to the next says nothing
    p = (own.reshape(2, K, K) + 0.5) / (own.reshape(2, K, K).sum(axis=2, keepdims=True) + 0.5 * K)
    out = np.log(p[1]) - np.log(p[0])
    out[0, :] = out[:, 0] = 0.0
    return out.ravel()


def random_spans(text: str, ratios: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates with letters and digits that the random model explains better, outside the base spans.

    ``taken`` is sorted by start, and so are the candidates: one walk over both tells what overlaps.
    """
    found, at, reach = [], 0, 0  # reach: the furthest end of the spans that start before the candidate's end
    for m in CANDIDATE.finditer(text):
        start, end = m.start(), m.end()
        while end > start and text[end - 1] in ".=-_/":
            end -= 1
        token = text[start:end]
        if end - start < 20 or not re.search("[0-9]", token) or not re.search("[A-Za-z]", token) or len(set(token)) < MIN_DISTINCT:
            continue
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][2])
            at += 1
        if reach > start:
            continue
        codes = classes(token)
        if ratios[codes[:-1] * K + codes[1:]].mean() > THRESHOLD:
            found.append((start, 3, end))
    return found


def scan(text: str | None, ratios: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text; a null text is empty."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, ratios, base))


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, n_assign, n_access, n_hex, base (joined base spans), spans, redacted text.

    Null and empty texts have no spans; repeated rows give repeated rows; other columns are not read. A text of any length
    is scanned whole, in time linear in it; an empty table gives an empty result. Spans that start together come in the
    order of KINDS. The models see all rows, so what counts as random depends on the whole table.
    """
    ratios = log_ratio(corpus_counts(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # K * K doubles

    def found(cols, state):
        out = {c: [] for c in ("key", "n_assign", "n_access", "n_hex", "base", "spans")}
        for k, body in zip(cols["key"], cols["text"]):
            base, spans = scan(body, state)
            kinds = [x[1] for x in base]
            for name, value in zip(out, (k, kinds.count(0), kinds.count(1), kinds.count(2), joined(base), joined(spans))):
                out[name].append(value)
        return out

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_batches(rows, found, "key long, n_assign long, n_access long, n_hex long, base string, spans string", lambda: shared.value).withColumnRenamed("key", key)


def redact(text: str | None, spans, mark: str = "[SECRET]") -> str | None:
    """``text`` with every span, overlapping ones merged, replaced by ``mark``."""
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced by a mark; every row, column and its order stay.

    Null and empty texts stay as they are, repeated rows stay repeated, an empty table stays empty; overlapping spans are
    one mark; a text of any length is cleaned whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(log_ratio(corpus_counts(docs, text)))

    @F.pandas_udf("string")
    def cleaned(texts):
        return texts.map(lambda body: redact(body, scan(body, shared.value)[1]) if body else body)

    return docs.withColumn(text, cleaned(F.col(text)))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")

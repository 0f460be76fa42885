"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over them, each filter's largest response in a
fixed-length window is kept, and a softmax over these gives the window's languages. A text's languages
are the mean over all its windows, end to end. Training sees a bounded sample of labelled texts, SAMPLE
slices in all, evenly over the languages; applying the network covers every whole text in batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table

#: Bounds of the fit: labelled slices over all languages, and characters a slice.
SAMPLE, SLICE = 6_000, 400
WINDOW = 128
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
STEPS, BATCH, RATE = 500, 64, 0.01


class ByteConvNet:
    """Embedding, filters of WIDTHS with max pooling, softmax over ``languages``."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embed": rng.normal(0, 0.3, (256, EMBED)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), "bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"], self.p[f"b{w}"] = rng.normal(0, 0.3, (w, EMBED, FILTERS)), np.zeros(FILTERS)

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 4) -> ByteConvNet:
        """Adam on the cross entropy of windows [n, WINDOW] (uint8), drawn evenly by label."""
        rng, mean, square = np.random.default_rng(seed), {}, {}
        by_label = [np.flatnonzero(labels == i) for i in range(len(self.languages))]
        for step in range(1, STEPS + 1):
            pick = np.array([rng.choice(by_label[i]) for i in rng.integers(0, len(by_label), BATCH)])
            for name, g in self._gradient(windows[pick], labels[pick]).items():
                mean[name] = 0.9 * mean.get(name, 0) + 0.1 * g
                square[name] = 0.999 * square.get(name, 0) + 0.001 * g * g
                self.p[name] -= RATE * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, g, rows = self.p, {}, np.arange(len(x))
        e = p["embed"][x]
        pooled, at = [], []
        for w in WIDTHS:
            r = sum(e[:, j : WINDOW - w + 1 + j] @ p[f"w{w}"][j] for j in range(w)) + p[f"b{w}"]
            at.append(r.argmax(axis=1))
            pooled.append(np.take_along_axis(r, at[-1][:, None], 1)[:, 0])
        h = np.concatenate(pooled, axis=1)
        a = np.maximum(h, 0)
        q = self._softmax(a @ p["out"] + p["bias"])
        q[rows, y] -= 1
        q /= len(x)
        g["out"], g["bias"] = a.T @ q, q.sum(axis=0)
        dh = (q @ p["out"].T) * (h > 0)
        g["embed"] = np.zeros_like(p["embed"])
        for n, w in enumerate(WIDTHS):
            d = dh[:, n * FILTERS : (n + 1) * FILTERS]
            g[f"b{w}"], g[f"w{w}"] = d.sum(axis=0), np.zeros_like(p[f"w{w}"])
            for j in range(w):
                own = x[rows[:, None], at[n] + j]  # the byte under each filter's largest response
                g[f"w{w}"][j] = np.einsum("bf,bfe->ef", d, p["embed"][own])
                np.add.at(g["embed"], own, d[:, :, None] * p[f"w{w}"][j].T[None])
        return g

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def compiled(self) -> dict:
        """For applying: each filter column times the embedding is one table over bytes."""
        tables = {w: [(self.p["embed"] @ self.p[f"w{w}"][j]).astype(np.float32) for j in range(w)] for w in WIDTHS}
        return {"languages": self.languages, "tables": tables, "out": self.p["out"].astype(np.float32), "bias": self.p["bias"], "shift": {w: self.p[f"b{w}"].astype(np.float32) for w in WIDTHS}}


def windows_of(body: bytes) -> bytes:
    """``body`` padded with zero bytes to whole windows, one at least."""
    return body.ljust(max(1, -(-len(body) // WINDOW)) * WINDOW, b"\0")


def predict(net: dict, bodies: list[bytes]) -> np.ndarray:
    """Mean probability of each language over all windows of each text."""
    padded = [windows_of(b) for b in bodies]
    x = np.frombuffer(b"".join(padded), np.uint8)
    pooled = []
    for w in WIDTHS:
        parts = []
        for at in range(0, len(x), WINDOW * 512):  # 64 KB of bytes at a time
            own = x[at : at + WINDOW * 512]
            r = net["tables"][w][0][own]
            for j in range(1, w):
                r[:-j] += net["tables"][w][j][own[j:]]
            parts.append(r.reshape(-1, WINDOW, FILTERS)[:, : WINDOW - w + 1].max(axis=1))
        pooled.append(np.concatenate(parts) + net["shift"][w])
    p = ByteConvNet._softmax((np.maximum(np.concatenate(pooled, axis=1), 0) @ net["out"]).astype(np.float64) + net["bias"])
    first = np.cumsum([0] + [len(b) // WINDOW for b in padded[:-1]])
    return np.add.reduceat(p, first, axis=0) / np.diff(np.append(first, len(p)))[:, None]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteConvNet | None:
    """A network trained on slices of labelled rows; None if no row has a label and a letter.

    As many rows of each language, SAMPLE in all and one of a language at least, are those with the smallest hashes of
    key and text; equal rows count once. A slice starts anywhere in its text.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(23), key, text).alias("h"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # the labels that can be learned
    if not languages:
        return None
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # tasks pass on no more than these ranks
    picked = rows.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= max(1, SAMPLE // len(languages))).select("lang", "h")
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - SLICE + 1)) + 1
    slices = rows.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.expr("text").substr(start.cast("int"), F.lit(SLICE))).alias("slice"))  # SAMPLE rows
    sample = sorted(slices.collect(), key=lambda r: (r["lang"], r["h"]))
    parts = [(windows_of(r["slice"].encode()), languages.index(r["lang"])) for r in sample]
    x = np.frombuffer(b"".join(b for b, _ in parts), np.uint8).reshape(-1, WINDOW)
    y = np.repeat([i for _, i in parts], [len(b) // WINDOW for b, _ in parts])
    return ByteConvNet(languages).train(x, y)


def identify(docs: DataFrame, net: ByteConvNet | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, lang_pred, score (mean probability of lang_pred over the text's windows).

    ``und`` with score 0 for null texts, texts without a letter, and where nothing was learned. Only ``text`` is
    looked at. Texts are read whole, whatever their length; of languages that tie, the first by code point is named.
    Repeated rows come back repeated; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net.compiled() if net else None)

    def named(cols, model):
        out = {"key": cols["key"], "lang_pred": ["und"] * len(cols["key"]), "score": [0.0] * len(cols["key"])}
        known = [i for i, t in enumerate(cols["text"]) if model and t and any(map(str.isalpha, t))]
        for at in range(0, len(known), 64):
            own = known[at : at + 64]
            for i, p in zip(own, predict(model, [cols["text"][i].encode() for i in own])):
                best = int(p.argmax())
                out["lang_pred"][i], out["score"][i] = model["languages"][best], float(min(1.0, p[best]))
        return out

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_batches(rows, named, "key long, lang_pred string, score double", lambda: shared.value).withColumnRenamed("key", key)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(0)) % 4 == 2


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit(docs.where(~held_out()))
    return identify(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

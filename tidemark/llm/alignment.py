"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes of a text.

A tokenization is a sparse matrix of tokens by bytes, held in compressed rows. The product of one
tokenizer's matrix with the other's transpose, row by row as Gustavson does it, has an entry for every pair
of tokens that overlap, and its value is how many bytes they share. Byte offsets at which tokens of both
end cut a text into groups; the product of the two token-by-group matrices has an entry for every pair in
the same group. Texts of a batch are put one behind the other: the matrices are block diagonal, so links
never leave their text.

How many documents hold a pair of ids linked is counted over the whole corpus. The most frequent pairs, HOT
of them, are broadcast; all others meet the documents by a shuffle, and none of these is a hot key.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table
from tidemark.scratch import Scratch

#: Pairs of ids that are broadcast with their counts, and products that are formed at a time.
HOT, FLOPS = 100_000, 1_000_000
#: White space in one run from which the faster library's splitter would overflow its stack.
WIDE = re.compile(r"\s{4096}")


class Csr:
    """A sparse matrix in compressed rows: row i has columns[starts[i]:starts[i + 1]] with their values."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.starts, self.columns, self.values, self.width = starts, columns, values, width

    def __len__(self) -> int:
        return len(self.starts) - 1

    @classmethod
    def of_spans(cls, ends: np.ndarray) -> Csr:
        """Tokens by bytes: token i has the bytes from the end before it up to ``ends[i]``."""
        n = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate(([0], ends)).astype(np.int64), np.arange(n, dtype=np.int64), np.ones(n, np.int32), n)

    @classmethod
    def of_labels(cls, labels: np.ndarray, width: int) -> Csr:
        """Tokens by groups: token i is in group ``labels[i]``."""
        return cls(np.arange(len(labels) + 1, dtype=np.int64), labels.astype(np.int64), np.ones(len(labels), np.int32), width)

    def transposed(self) -> Csr:
        counts = np.bincount(self.columns, minlength=self.width)
        rows = np.repeat(np.arange(len(self), dtype=np.int64), np.diff(self.starts))
        order = slice(None) if (self.columns[1:] >= self.columns[:-1]).all() else np.argsort(self.columns, kind="stable")
        return Csr(np.concatenate(([0], np.cumsum(counts))), rows[order], self.values[order], len(self))


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Products that each row of ``a`` times ``b`` needs: the symbolic half of Gustavson's algorithm."""
    before = np.concatenate(([0], np.cumsum(np.diff(b.starts)[a.columns])))
    return before[a.starts[1:]] - before[a.starts[:-1]]


def product(a: Csr, b: Csr, flops: int = FLOPS):
    """Entries (rows, columns, values) of ``a`` times ``b`` by row, then column, in blocks of about ``flops`` products.

    A row of the product is the sum of the rows of ``b`` that the row of ``a`` names, each times its value there; equal
    columns of a row are added up. Memory holds one block, whose rows are whole.
    """
    total = np.cumsum(product_sizes(a, b))
    row = 0
    while row < len(a):
        until = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + flops, "right")))
        own = slice(a.starts[row], a.starts[until])
        k, sizes = a.columns[own], np.diff(b.starts)[a.columns[own]]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - b.starts[k], sizes)
        key = np.repeat(np.repeat(np.arange(row, until), np.diff(a.starts[row : until + 1])), sizes) * b.width + b.columns[at]
        values = np.repeat(a.values[own], sizes) * b.values[at]
        if not (key[1:] >= key[:-1]).all():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        if len(first):
            yield key[first] // b.width, key[first] % b.width, np.add.reduceat(values, first)
        row = until


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """Tokens of a byte-level BPE file (.json) of texts behind a space; special tokens' strings are plain text.

    Merges in the order of their ids are all that the faster of the two installed libraries needs, so it encodes, except
    texts with a run of white space that its splitter cannot take.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_alphabet()
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.bytes = [b""] * self.slow.get_vocab_size()
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.slow.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = self.bytes[i] or token.encode()  # added ones are stored as they are
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ordered = [model["vocab"][m] for m in merges] == list(range(256, 256 + len(merges)))
        ranks = {self.bytes[i]: i for i in model["vocab"].values()}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        fast = lambda t: self.fast is not None and not WIDE.search(t)
        return [self.fast.encode_ordinary(t) if fast(t) else self.slow.encode(t, add_special_tokens=False).ids for t in (" " + t for t in texts)]


class PieceTokens:
    """Tokens of a SentencePiece file (.model), which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Two tokenizers side by side. ``pair`` of ids (a, b) is a * (ids of B) + b."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        self.base = len(self.b.bytes)
        # Decimal ids with what follows them, seven bytes each; zero bytes are taken out after gathering.
        self.texts = [[np.array([f"{i}{end}".encode() for i in range(len(side.bytes))], "S7") for end in ends] for side, ends in ((self.a, ",|"), (self.b, ",;"))]

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both tokenizers of each text; none where the text is null or empty, or where either tokenizer's bytes
        are not the text's."""
        asked = [i for i, t in enumerate(texts) if t]
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        for i, a, b in zip(asked, self.a.encode([texts[i] for i in asked]), self.b.encode([texts[i] for i in asked])):
            body = b" " + texts[i].encode()
            if b"".join(map(self.a.bytes.__getitem__, a)) == body == b"".join(map(self.b.bytes.__getitem__, b)):
                out[i] = (a, b)
        return out

    def aligned(self, texts: list[str | None]) -> dict:
        """Per text: n_a, n_b, n_groups, n_links, n_shared (pairs in the same group), groups_sha256, and the distinct linked
        ``pairs`` with how often each ``uses`` its place; per link: ``links`` (text, token of A, token of B, shared bytes)."""
        tokens = self.tokens(texts)
        n = [np.array([len(t[side]) for t in tokens], np.int64) for side in (0, 1)]
        ids = [np.fromiter((x for t in tokens for x in t[side]), np.int64, int(n[side].sum())) for side in (0, 1)]
        text_of = [np.repeat(np.arange(len(texts)), m) for m in n]
        ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids)]
        common = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(common, e) for e in ends]
        first_group = np.searchsorted(common, np.concatenate(([0], ends[0]))[np.cumsum(n[0]) - n[0]], "right")  # groups before each text
        n_groups = np.diff(np.append(first_group, len(common)))

        overlaps = list(product(Csr.of_spans(ends[0]), Csr.of_spans(ends[1]).transposed()))
        row, column, shared = (np.concatenate([o[i] for o in overlaps]) if overlaps else np.zeros(0, np.int64) for i in range(3))
        where = text_of[0][row]
        in_group = product_sizes(*(lambda a, b: (a, b.transposed()))(*(Csr.of_labels(g, len(common)) for g in group)))

        pair = ids[0][row] * self.base + ids[1][column]
        span = len(self.a.bytes) * self.base
        distinct, uses = np.unique(where * span + pair, return_counts=True)
        return {
            "n_a": n[0], "n_b": n[1], "n_groups": n_groups, "n_links": np.bincount(where, minlength=len(texts)), "n_shared": np.bincount(text_of[0], in_group, len(texts)).astype(np.int64),
            "groups_sha256": self._digests(ids, group, text_of, n), "pairs": distinct % span, "uses": uses, "pairs_of": np.bincount(distinct // span, minlength=len(texts)),
            "links": (where, row - (np.cumsum(n[0]) - n[0])[where], column - (np.cumsum(n[1]) - n[1])[where], shared), "ids": ids,
        }

    def _digests(self, ids, group, text_of, n) -> list[str]:
        """Digest of each text's groups ``a1,a2|b1;a3|b2``; empty without tokens."""
        last = [np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in group]  # of its group
        final = n[1].cumsum()[n[1] > 0] - 1  # tokens of B that end a text have nothing behind them
        shown = [np.where(last[side], self.texts[side][1][ids[side]], self.texts[side][0][ids[side]]) for side in (0, 1)]
        order = np.argsort(np.concatenate((group[0] * 2, group[1] * 2 + 1)), kind="stable")
        letters = np.concatenate(shown)[order].view(np.uint8).reshape(-1, 7)
        ended = np.concatenate((np.zeros(len(ids[0]), bool), np.isin(np.arange(len(ids[1])), final)))[order]
        used = letters != 0
        sizes = used.sum(axis=1)
        out, at, body, ends = [""] * int(len(n[0])), 0, letters[used].tobytes(), np.cumsum(sizes)
        for i, end in zip(np.flatnonzero(n[1]), ends[ended]):
            out[i] = hashlib.sha256(body[at : end - 1]).hexdigest()
            at = int(end)
        return out


SCHEMA = "key long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs array<long>, uses array<int>"


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, and the distinct linked pairs of
    ids with how often each is linked. See ``alignment`` for odd rows."""

    def run(cols, aligner):
        import pyarrow as pa

        out = aligner.aligned(cols["text"])
        starts = pa.array(np.concatenate(([0], np.cumsum(out["pairs_of"]))), pa.int32())
        lists = {name: pa.ListArray.from_arrays(starts, pa.array(out[name], kind)) for name, kind in (("pairs", pa.int64()), ("uses", pa.int32()))}
        return {"key": cols["key"], **{c: out[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256")}, **lists}

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_batches(rows, run, SCHEMA, lambda: Aligner(path_a, path_b)).withColumnRenamed("key", key)


def links(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per overlap link: key, at_a, at_b (places of the tokens in their text, from 0), a, b (their ids), n_bytes
    (bytes they share). Texts without tokens have no rows; see ``alignment``."""

    def run(cols, aligner):
        out = aligner.aligned(cols["text"])
        where, at_a, at_b, shared = out["links"]
        first = [(np.cumsum(out[c]) - out[c])[where] for c in ("n_a", "n_b")]
        return {"key": [cols["key"][i] for i in where], "at_a": at_a, "at_b": at_b, "a": out["ids"][0][first[0] + at_a], "b": out["ids"][1][first[1] + at_b], "n_bytes": shared}

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_batches(rows, run, "key long, at_a long, at_b long, a long, b long, n_bytes long", lambda: Aligner(path_a, path_b)).withColumnRenamed("key", key)


def pair_counts(pairs: DataFrame, base: int) -> DataFrame:
    """(pair, n, best): in how many rows of ``pairs`` each id pair is linked, and whether no other pair of its id of A is
    linked in more. The highest count of each id of A is broadcast: a row an id, as many as the vocabulary has."""
    counts = pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of_a = F.expr(f"pair div {base}")
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), of_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: key, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256.

    ``n_best`` are the links whose pair is linked in as many documents as any pair of the same id of A (ties all count),
    ``count_sum`` the sum over the links of how many documents hold their pair. Null and empty texts, and texts that a
    tokenizer does not give back byte by byte, have no tokens: zeros and an empty digest. A text of any length is aligned
    whole; one that a single group spans costs no more than another. Repeated rows are documents each; an empty
    table gives an empty result; other columns are not read, whatever their names.
    """
    tmp = Scratch(docs.sparkSession, "alignment")
    base = PieceTokens(path_b).model.get_piece_size()
    rows = tmp.written(aligned(docs, path_a, path_b, key, text).withColumn("_row", F.monotonically_increasing_id()), "aligned", keep=True)
    counts = tmp.written(pair_counts(rows, base), "counts", keep=True)
    known = F.broadcast(tmp.written(counts.orderBy(F.desc("n"), "pair").limit(hot), "hot", keep=True))  # hot rows of three numbers
    used = rows.select("_row", F.explode(F.arrays_zip("pairs", "uses")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), F.col("p.uses").alias("uses"))
    rare = counts.join(known.select("pair"), "pair", "left_anti")
    met = used.join(known, "pair").unionByName(used.join(known.select("pair"), "pair", "left_anti").join(rare, "pair"))
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("uses")).otherwise(0)).alias("n_best"), F.sum(F.col("uses") * F.col("n")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "uses").join(sums, "_row", "left").select(key, "n_a", "n_b", "n_groups", "n_links", "n_shared", *zero, "groups_sha256")


def op11_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment(table(spark, sf_dir, "documents"), *paths)

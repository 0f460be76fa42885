"""SentencePiece encoding and decoding over a lattice of pieces.

Texts are cut into words between characters that no piece holds side by side, where nothing can merge.
Each distinct word opens a lattice: its bounded-length substrings that are in the piece table are edges,
grouped by word, and a fold over end positions keeps the one path that the merges of a BPE model leave.
Two pieces may follow each other only if no merge across their boundary comes before one of them is
taken up by a larger piece; that is read off the pieces' right and left spines. Under this rule every
prefix has exactly one last piece, so the fold is Viterbi with a state of one piece a position and needs
no scores. Characters outside the table are spelled in byte pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table
from tidemark.llm.jaccard import mix

SPACE = "▁"
#: Distinct words whose pieces a task keeps.
CACHE = 120_000
#: Pairs of pieces that a table keeps.
KNOWN = 1_000_000
#: Ids from here on are characters that are no piece.
UNKNOWN = 1 << 20


class Hashes:
    """64-bit hashes of the substrings of an array of code points, from prefix sums."""

    _BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self, points: np.ndarray):
        powers = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(len(points), base, np.uint64)])
        self.back = powers(self._BACK)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * powers(self._BASE)[:-1])))

    def __call__(self, start: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[start + n] - self.sums[start]) * self.back[start]


def merged(word: str, rank: Callable[[str, str], int | None]) -> tuple[list[str], tuple[str, str] | None]:
    """Pieces of ``word`` by merging its best pair, the leftmost of equals, again and again, and the last pair merged.

    ``rank(a, b)`` is the place of that merge, None if there is none. Pairs wait in a heap; one whose parts have changed meanwhile is passed over. n characters take n log n steps.
    """
    parts: list[str | None] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a, b)) is not None]
    heapify(heap)
    last = None
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        last = a, b
        parts[i], parts[j] = a + b, None
        after[i] = k = after[j]
        if k < len(parts):
            before[k] = i
            if (r := rank(a + b, parts[k])) is not None:
                heappush(heap, (r, i, a + b, parts[k]))
        if (h := before[i]) >= 0 and (r := rank(parts[h], a + b)) is not None:
            heappush(heap, (r, h, parts[h], a + b))
    return [x for x in parts if x is not None], last


class Lattice:
    """The pieces of a BPE vocabulary that their own merges reach, which may follow each other, and the fold over words.

    ``names``: pieces by id; ``ids``: those that take part in merging; ``rank``: see merged.
    """

    def __init__(self, names: list[str], ids: dict[str, int], rank: Callable[[str, str], int | None]):
        self.pieces, self.ids, self.rank = names, ids, rank
        self.split: dict[str, tuple[str, str] | None] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        #: Pieces of two or more characters that their own merges reach, by length: sorted hashes and ids.
        alone = [p for p in self.ids if len(p) > 1 and self.halves(p)]
        self.longest = max(map(len, alone), default=1)
        self.joins = {n: self._sorted({p: self.ids[p] for p in alone if len(p) == n}) for n in range(2, self.longest + 1)}
        heads: dict[str, int] = {}
        for piece in alone:
            heads[piece[:2]] = max(len(piece), heads.get(piece[:2], 0))
        self.heads = self._sorted(heads)
        self.chars = np.arange(UNKNOWN, UNKNOWN + 0x110000, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        #: Pairs of ids that were asked for, sorted, and whether the second may follow the first; those not yet sorted in.
        self.known, self.fresh = (np.zeros(1, np.int64), np.zeros(1, bool)), []

    @staticmethod
    def _sorted(values: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes, values) of strings of equal length; one that no hash reaches stands for none."""
        if not values:
            return np.zeros(1, np.uint64), np.zeros(1, np.int64)
        n = len(next(iter(values)))
        at = np.arange(len(values)) * n
        h = Hashes(np.frombuffer("".join(values).encode("utf-32-le"), np.uint32))(at, n)
        order = np.argsort(h)
        return h[order], np.array(list(values.values()), np.int64)[order]

    @staticmethod
    def _found(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        """The value of each hash in the table, or -1: an equi-join."""
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return np.where(table[0][at] == h, table[1][at], -1)

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The pair that ``piece`` is merged from; () if its own merges do not lead to it."""
        if piece not in self.split:
            parts, last = merged(piece, self.rank)
            self.split[piece] = None if len(piece) == 1 else last if len(parts) == 1 else ()
        return self.split[piece]

    def spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """(part, rank of the merge that takes it up) along one side of a piece's merge tree, the piece first."""
        if piece in self.spines[side]:
            return self.spines[side][piece]
        out, limit, part = [], float("inf"), piece
        while True:
            out.append((part, limit))
            halves = self.halves(part)
            if not halves:
                break
            limit = self.rank(*halves)
            part = halves[side]
        if len(piece) > 1:
            self.spines[side][piece] = out
        return out

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging left + right from its characters ends in exactly these two pieces.

        Neighbouring parts a, b on the two spines merge if their rank comes before both are taken up; of equal
        ranks the leftmost pair goes first, so a's own merge wins a tie and b's loses it.
        """
        rank = self.rank
        for b, bt in self.spine(right, 0):
            for a, at in self.spine(left, 1):
                r = rank(a, b)
                if r is not None and r < at and r <= bt:
                    return False
        return True

    def name(self, i: int) -> str:
        return self.pieces[i] if i < UNKNOWN else chr(i - UNKNOWN)

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """may_follow by id, for arrays; pairs are worked out once."""
        pairs = left << 22 | right
        keys, values = self.known
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        out, found = values[at], keys[at] == pairs
        if not found.all():
            missing = np.flatnonzero(~found)
            new, back = np.unique(pairs[missing], return_inverse=True)
            fits = np.array([self.may_follow(self.name(k >> 22), self.name(k & (1 << 22) - 1)) for k in new.tolist()])
            out[missing] = fits[back]
            self.fresh.append((new, fits))
            if sum(len(x) for x, _ in self.fresh) > len(keys) // 4:  # merged now and then, so that this stays linear
                self._settle()
        return out

    def _settle(self) -> None:
        """Take the new pairs in; a million pairs are kept at most, then it starts anew."""
        keys, values = (np.concatenate(c) for c in zip(self.known, *self.fresh))
        keys, first = np.unique(keys, return_index=True)
        self.known, self.fresh = (keys, values[first]), []
        if len(keys) > KNOWN:
            self.known = np.zeros(1, np.int64), np.zeros(1, bool)

    def edges(self, points: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lattice of words laid end to end: (start, end, id) of every substring that is a piece.

        ``end`` is the end of the word at each position. Substrings of each length are joined with the pieces of
        that length by hash; no start is tried beyond the longest piece with its first two characters. Every
        single character is an edge.
        """
        hashes, at = Hashes(points), np.arange(len(points))
        out = [(at, at + 1, self.chars[points])]
        start = at[at + 2 <= end]
        longest = self._found(self.heads, hashes(start, 2))
        for n in range(2, self.longest + 1):
            keep = (longest >= n) & (start + n <= end[start])
            start, longest = start[keep], longest[keep]
            ids = self._found(self.joins[n], hashes(start, n))
            hit = ids >= 0
            out.append((start[hit], start[hit] + n, ids[hit]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def fold(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Fold the lattices of many words at once over end positions, words laid end to end: the first position of
        each word, its length, and at each position the last piece of what ends there, its start and the number of pieces."""
        sizes = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        first = np.cumsum(sizes) - sizes
        of = np.repeat(first, sizes)
        start, stop, ids = self.edges(points, np.repeat(first + sizes, sizes))
        depth = stop - of[start]
        order = np.argsort(depth, kind="stable")
        start, stop, ids, depth = start[order], stop[order], ids[order], depth[order]
        last, begun, count = (np.zeros(len(points), np.int64) for _ in range(3))
        cuts = np.searchsorted(depth, np.arange(1, sizes.max() + 2))
        for a, b in zip(cuts, cuts[1:]):
            s, e, i = start[a:b], stop[a:b], ids[a:b]
            fits = s == of[s]
            inner = np.flatnonzero(~fits)
            fits[inner] = self.fit(last[s[inner] - 1], i[inner])
            s, e = s[fits], e[fits] - 1
            last[e], begun[e] = i[fits], s
            count[e] = 1 + np.where(s == of[s], 0, count[s - 1])
        return first, sizes, last, begun, count

    def paths(self, words: list[str]) -> list[list[int]]:
        """The pieces of each word, read back from its end."""
        first, sizes, last, begun, _ = self.fold(words)
        own, cur, steps = np.arange(len(words)), first + sizes, []
        while len(own):
            steps.append((own, last[cur - 1]))
            cur = begun[cur - 1]
            more = cur > first[own]
            own, cur = own[more], cur[more]
        word = np.concatenate([x for x, _ in steps])
        rank = np.repeat(np.arange(len(steps)), [len(x) for x, _ in steps])
        order = np.lexsort((-rank, word))
        flat = np.concatenate([x for _, x in steps])[order].tolist()
        cut = [0, *np.cumsum(np.bincount(word, minlength=len(words))).tolist()]
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def counts(self, words: list[str]) -> list[int]:
        """The number of pieces of each word."""
        first, sizes, _, _, count = self.fold(words)
        return count[first + sizes - 1].tolist()


class PieceTable(Lattice):
    """The lattice of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        scores = sorted({model.get_score(i) for i in kept}, reverse=True)
        place = {s: n for n, s in enumerate(scores)}
        ranks = {names[i]: place[model.get_score(i)] for i in kept}
        self.byte_ids = {int(names[i][1:-1], 16): i for i in range(model.vocab_size()) if model.is_byte(i)}
        super().__init__(names, {names[i]: i for i in kept}, lambda a, b: ranks.get(a + b))
        letters = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.bridged = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in {(a, b) for p in self.ids for a, b in zip(p, p[1:])}:
            self.bridged[self.letter[ord(a)], self.letter[ord(b)]] = True

    def words(self, texts: list[str]) -> list[list[str]]:
        """The words of nonempty texts: cut between characters that no piece holds side by side."""
        body = "".join(texts)
        if not body:
            return []
        kinds = self.letter[np.frombuffer(body.encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(kinds) + 1, bool)
        cut[1:-1] = ~self.bridged[kinds[:-1], kinds[1:]]
        ends = np.cumsum([len(t) for t in texts])
        cut[ends] = True
        at = np.flatnonzero(cut)
        split = [body[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
        upto = np.searchsorted(at, ends).tolist()
        return [split[a:b] for a, b in zip([0, *upto], upto)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out: dict[str, list[int]] = {}
        # A run of marks has pieces of equal rank only, which the spines cannot order; it is merged directly.
        for word in words:
            if word.startswith(SPACE * 2):
                out[word] = [self.ids.get(p, ord(p[0]) + UNKNOWN) for p in merged(word, self.rank)[0]]
        plain = [w for w in words if w not in out]
        for at in range(0, len(plain), 20_000):
            out |= zip(plain[at : at + 20_000], self.paths(plain[at : at + 20_000]))
        spelt = lambda ids: [b for i in ids for b in ([i] if i < UNKNOWN else [self.byte_ids[x] for x in chr(i - UNKNOWN).encode()])]
        return [spelt(out[w]) if max(out[w]) >= UNKNOWN else out[w] for w in words]


class Spelling:
    """The bytes of every piece, laid end to end: all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def spelt(i: int) -> bytes:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                return bytes((int(piece[1:-1], 16),))
            return b"" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else piece.replace(SPACE, " ").encode()

        every = [spelt(i) for i in range(model.vocab_size())]
        self.spelt = np.frombuffer(b"".join(every), np.uint8)
        self.size = np.array([len(b) for b in every])
        self.at = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of arrays of ids laid end to end: pieces joined, byte pieces as UTF-8, marks as spaces,
        without the first one."""
        length = self.size[ids]
        ends = np.cumsum(length)
        first = self.at[ids] - (ends - length)
        body = self.spelt[np.repeat(first, length) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        stops = np.concatenate((np.zeros(1, np.int64), ends))[np.cumsum(sizes)]
        texts = [body[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops.tolist()], stops.tolist())]
        return [t[1:] if t[:1] == " " else t for t in texts]


class WordPieces(dict):
    """Piece ids of words, as int32 bytes, encoded on first sight; the first CACHE words are kept."""

    def __init__(self, path: str):
        self.table = PieceTable(path)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as int32 bytes; texts are taken in groups of about a million characters."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(SPACE + text.replace(" ", SPACE) if text else "")
            size += len(group[-1])
            if size > 1 << 20:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = iter(self.table.words([t for t in texts if t]))
        split = [next(split) if t else [] for t in texts]
        new = list({w for words in split for w in words} - self.keys())
        if new:
            self.update(zip(new, map(bytes, map(np.array, self.table.encode_words(new), repeat(np.int32)))))
        out = [b"".join(map(self.__getitem__, words)) for words in split]
        if len(self) > CACHE:
            for word in new:
                del self[word]
        return out


def _public(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def word_pieces(path: str | None) -> WordPieces:
    """Table and caches of one task: workers stay alive between tasks, and so would what they keep."""
    return WordPieces(_public(path))


def spelling(path: str | None) -> Spelling:
    return Spelling(_public(path))


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, pieces (array of ids). Null and empty texts have none; texts are taken whole. Rows do not
    depend on each other: repeated rows come back repeated, nothing can tie, an empty table gives an empty result, and other
    columns are not read.

    ``path``: a SentencePiece BPE model with byte fallback, identity normalization and a leading mark, by
    default the public 32k one, found on each executor.
    """

    def run(cols, words):
        import pyarrow as pa

        ids = words.encode(cols["text"])
        ends = np.cumsum([0, *(len(b) // 4 for b in ids)], dtype=np.int32)
        return {"key": cols["key"], "pieces": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32))).cast(pa.list_(pa.int32()))}

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_batches(rows, run, "key long, pieces array<int>", lambda: word_pieces(path)).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """``encoded(key, pieces)`` with ``text``, the decoded pieces. A null or empty array decodes to an empty text; repeated rows
    come back repeated, an empty table gives an empty result, and other columns are not read."""

    def run(batches):
        import pyarrow as pa

        table = spelling(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pieces = part.column("pieces")
                sizes = pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = table.decode(pieces.flatten().to_numpy(zero_copy_only=False), sizes)
                yield pa.RecordBatch.from_arrays([part.column("key"), pieces, pa.array(texts, pa.string())], ["key", "pieces", "text"])

    rows = encoded.select(F.col(key).cast("long").alias("key"), "pieces")
    return rows.mapInArrow(run, "key long, pieces array<int>, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """encode and decode in one step, so that a task needs one Python worker: key, pieces, text as decoded.

    Null and empty texts have no pieces and decode to an empty text. Repeated rows come back repeated, an empty
    table gives an empty result, and other columns are not read.
    """

    def run(cols, state):
        import pyarrow as pa

        words, table = state
        ids = words.encode(cols["text"])
        ends = np.cumsum([0, *(len(b) // 4 for b in ids)], dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), np.int32)
        pieces = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int32()))
        return {"key": cols["key"], "pieces": pieces, "text": table.decode(flat, np.diff(ends).astype(np.int64))}

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_batches(rows, run, "key long, pieces array<int>, text string", lambda: (word_pieces(path), spelling(path))).withColumnRenamed("key", key)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    read = round_trip(table(spark, sf_dir, "documents"))
    return read.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.sha2(F.array_join("pieces", ","), 256).alias("pieces_sha256"), F.sha2("text", 256).alias("decoded_sha256"))

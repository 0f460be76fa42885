"""Token counts by a compiled finite-state tokenizer.

Two transducers read a text one after the other. The first is the tokenizer's splitting rule, compiled to a
deterministic transducer over character classes whose transitions are annotated with the word pieces they open.
Texts are cut in chunks; every chunk's state map (end state for each start state) is computed for all chunks at
once, the maps are composed by a parallel prefix scan, and a second pass with known start states reads the
annotations. The second reads the bytes of a piece; it starts anew with each piece, so the scan settles its start
states too. Its state is the last token of what was read, which every prefix has exactly one of, and its
transitions are annotated with the tokens emitted so far: a token that ends here adds one to the tokens of the
prefix that it follows, if the two may stand side by side, which is read off their merge trees. It runs over all new
pieces of a batch in step, and a worker keeps the counts of CACHE pieces that it has met.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table
from tidemark.llm.pieces import Lattice, merged

CHUNK = 64
#: Distinct pieces whose counts a worker keeps.
CACHE = 400_000
#: Bytes from which a piece is merged alone: steps of the transducer are shared by all pieces that are as long.
LONG = 4_096

# Character classes: letters that contractions use are classes of their own.
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, END1, R_OR_V, L_, E_ = range(10)
# States. *2: two or more white space characters; Q: a quote that may open a contraction.
START, WORD, NUM, PUNCT, SP1, WS1, SP2, WS2, Q, Q_RV, Q_L, DONE = range(12)
HERE, BEFORE = 1, 2  # a piece opens at this character; at the one before


@lru_cache(2)
def class_table(path: str) -> np.ndarray:
    """Class of every code point to the tokenizer in ``path``.

    Libraries know different versions of Unicode. Where Python's table has no category for a point that the
    pattern library has one for, the tokenizer itself is asked what the point joins with.
    """
    import unicodedata

    import regex
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{White_Space}+", WHITE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    out[0xD800:0xE000] = OTHER
    for point in np.flatnonzero((out == LETTER) | (out == NUMBER)).tolist():
        if unicodedata.category(char := chr(point)) == "Cn":
            out[point] = next((k for k, near in ((LETTER, "a"), (NUMBER, "1")) if len(split(near + char)) == 1), OTHER)
    for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", END1), ("rv", R_OR_V), ("l", L_), ("e", E_)):
        out[[ord(c) for c in chars]] = kind
    return out


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, annotation) by state and class for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space that no other character follows|white space.
    """
    step, note = np.zeros((12, 10), np.int64), np.zeros((12, 10), np.int64)
    fresh = {LETTER: WORD, END1: WORD, R_OR_V: WORD, L_: WORD, E_: WORD, NUMBER: NUM, OTHER: PUNCT, QUOTE: Q, SPACE: SP1, WHITE: WS1}
    for state in range(12):
        for kind, to in fresh.items():
            run = {WORD: WORD, NUM: NUM, PUNCT: PUNCT}.get(state)
            go, mark = to, HERE
            if run == to and kind != QUOTE or state == PUNCT and kind == QUOTE:
                go, mark = state, 0
            elif state == Q and kind in (OTHER, QUOTE):
                go, mark = PUNCT, 0
            elif state == Q and kind == END1:
                go, mark = DONE, 0
            elif state == Q and kind in (R_OR_V, L_):
                go, mark = Q_RV if kind == R_OR_V else Q_L, 0
            elif (state, kind) in ((Q_RV, E_), (Q_L, L_)):
                go, mark = DONE, 0
            elif state in (Q_RV, Q_L):  # no contraction after all: the letter opened a word
                go, mark = (WORD, BEFORE) if to == WORD else (to, BEFORE | HERE)
            elif state in (SP1, WS1, SP2, WS2) and kind in (SPACE, WHITE):
                go, mark = SP2 if kind == SPACE else WS2, 0
            elif state in (SP1, SP2):  # the last space belongs to what follows
                go, mark = PUNCT if kind == QUOTE else to, 0 if state == SP1 else BEFORE
            elif state == WS2:
                mark = BEFORE | HERE
            step[state, kind], note[state, kind] = go, mark
    return step, note


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps [chunk, state] by doubling: out[i] = maps[0] then ... then maps[i]."""
    maps, by = maps.copy(), 1
    while by < len(maps):
        maps[by:] = np.take_along_axis(maps[by:], maps[:-by], axis=1)
        by *= 2
    return maps


def transduce(codes: np.ndarray, first: np.ndarray, step: np.ndarray, note: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(annotation of each character, state after it); texts lie end to end and start anew at the offsets ``first``."""
    states, kinds = step.shape
    sizes = np.diff(np.append(first, len(codes)))
    chunks = -(-sizes // CHUNK)
    of = np.repeat(np.arange(len(first)), chunks)
    place = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = first[of] + place * CHUNK
    length = np.minimum(CHUNK, first[of] + sizes[of] - begin)
    flat, notes = step.ravel(), note.ravel()
    order = np.argsort(-length, kind="stable")
    begin, length, place = begin[order], length[order], place[order]
    alive = [int(np.searchsorted(-length, -j, side="left")) for j in range(CHUNK)]  # chunks longer than j come first
    maps = np.tile(np.arange(states), (len(order), 1))
    for j, n in enumerate(alive):
        if n:
            maps[:n] = flat[maps[:n] * kinds + codes[begin[:n] + j, None]]
    maps[place == 0] = maps[place == 0][:, :1]  # a text's first chunk starts in state 0 whatever came before
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    ends = scan(maps[back])[:, 0]
    start = np.where(place == 0, 0, ends[np.maximum(order - 1, 0)])
    marks, after = np.zeros(len(codes), np.uint8), np.zeros(len(codes), np.uint8)
    for j, n in enumerate(alive):
        if n:
            at = begin[:n] + j
            key = start[:n] * kinds + codes[at]
            marks[at], start[:n] = notes[key], flat[key]
            after[at] = start[:n]
    return marks, after


def piece_starts(texts: list[str], classes: np.ndarray) -> list[np.ndarray]:
    """Offsets at which the pieces of each text start (nonempty texts); ``classes``: see class_table."""
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points])
    codes = classes[np.concatenate(points)].astype(np.int64)
    first = np.cumsum(sizes) - sizes
    marks, after = transduce(codes, first, *splitter())
    opens = (marks & HERE).astype(bool)
    opens[:-1] |= (marks[1:] & BEFORE).astype(bool)
    last = first + sizes - 1
    opens[last] |= np.isin(after[last], (Q_RV, Q_L))
    opens[first] = True
    at = np.flatnonzero(opens)
    return [part - f for part, f in zip(np.split(at, np.searchsorted(at, first[1:])), first)]


class PieceCounts(dict):
    """Token counts of pieces, emitted by the transducer over their bytes."""

    def __init__(self, path: str):
        import json

        self.classes = class_table(path)
        with open(path) as f:
            spec = json.load(f)
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and model["type"] == "BPE" and not spec["normalizer"] and not model.get("dropout") and not model.get("ignore_merges")
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("the compiled splitter is that of byte-level BPE tokenizers without normalizer")
        self.added = [t["content"] for t in spec["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        names = [""] * (max(model["vocab"].values()) + 1)
        for piece, i in model["vocab"].items():
            names[i] = piece
        ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        own = {p: i for p, i in model["vocab"].items() if p not in self.added}
        self.rank = lambda a, b: ranks.get((a, b))
        self.tokens = Lattice(names, own, self.rank)

    def add(self, pieces: set[str]) -> set[str]:
        """Count the new ones among ``pieces``; those to forget after use are returned, as CACHE holds no more."""
        new = {p: p.encode().decode("latin-1").translate(self.letters) for p in pieces.difference(self)}
        short = [p for p, spelt in new.items() if len(spelt) < LONG]
        for at in range(0, len(short), 20_000):
            own = short[at : at + 20_000]
            self.update(zip(own, self.tokens.counts([new[p] for p in own])))
        for p, spelt in new.items():
            if len(spelt) >= LONG:
                self[p] = len(merged(spelt, self.rank)[0])
        return set(new) if len(self) > CACHE else set()


@lru_cache(1)
def piece_counts(path: str) -> PieceCounts:
    """One for all tasks of a worker."""
    return PieceCounts(path)


def count_texts(texts: list[str | None], counts: PieceCounts) -> list[int]:
    """Tokens of each whole text; strings of added tokens inside a text are one token each."""
    import re

    total, parts, owner = [0] * len(texts), [], []
    added = re.compile("|".join(map(re.escape, counts.added))) if counts.added else None
    for i, text in enumerate(texts):
        if not text:
            continue
        pieces = added.split(text) if added else [text]
        total[i] += len(pieces) - 1
        for part in pieces:
            if part:
                parts.append(part)
                owner.append(i)
    if parts:
        starts = [at.tolist() for at in piece_starts(parts, counts.classes)]
        split = [[text[a:b] for a, b in zip(at, [*at[1:], len(text)])] for text, at in zip(parts, starts)]
        passing = counts.add({piece for pieces in split for piece in pieces})
        for i, pieces in zip(owner, split):
            total[i] += sum(map(counts.__getitem__, pieces))
        for piece in passing:
            del counts[piece]
    return total


def token_counts(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per input row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path``: a tokenizers JSON of a byte-level BPE, by default the public 50k one, found on each executor.
    Null and empty texts have no bytes and no tokens. Texts are counted whole, whatever their length. Rows do not depend on
    each other: repeated rows come back repeated, nothing can tie, and an empty table gives an empty result. Other columns
    are not read, whatever their names.
    """

    def start():
        if path:
            return piece_counts(path)
        import public_tokenizers

        return piece_counts(public_tokenizers.path("byte_bpe_50k.json"))

    def counted(cols, counts):
        texts, out = cols["text"], []
        group, size = [], 0
        for t in [*texts, None]:  # groups of about a million characters bound the memory
            group.append(t)
            size += len(t or "")
            if size > 1 << 20:
                out += count_texts(group, counts)
                group, size = [], 0
        out += count_texts(group, counts)
        n = out[: len(texts)]
        return {"key": cols["key"], "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_batches(rows, counted, "key long, n_bytes long, n_tokens long, over_limit boolean", start).withColumnRenamed("key", key)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

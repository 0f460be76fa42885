"""Token counts and pieces against the tokenizers' own libraries, on random mixtures and odd rows."""

import random
import time

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import pieces, tokencount

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["'", "s", "t", "re", "ve", "l", "e", "r", "v", "m", "d", "a", "B", "é", "é", "1", "²", "٣", " ", "  ", "    ", "\n", "\t", " ", "　", "!", "?", "_", "中", "😀", "🧿", "<|endoftext|>", "<|", "<s>", "'ll", "’", "\x00", "\x1c", "\x85", "▁", "⁂", "the", "ing", "tion", " wor", "ld"]
ODD = [None, "", " ", "x" * 3000, "word " * 60_000, "'" * 500, " " * 700 + "a", "a" + " " * 700]


def mixtures(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14) if i % 40 else 400)) for i in range(n)]


def test_counts_equal_the_library():
    library, counts = Tokenizer.from_file(BPE), tokencount.PieceCounts(BPE)
    texts = mixtures(6000) + [t or "" for t in ODD]
    assert tokencount.count_texts(texts, counts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_emissions_by_prefix():
    """The transducer's emission after every byte is the library's count of that prefix, runs and odd bytes among them."""
    library, counts = Tokenizer.from_file(BPE).model, tokencount.PieceCounts(BPE)
    rng = random.Random(9)
    words = ["".join(rng.choice("aabe\u0120tin-=") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    words += ["".join(rng.choice(list(counts.letters.values())) for _ in range(12)) for _ in range(200)] + ["a" * 300, "-" * 300, "\u0120" * 300, "ab" * 150]
    first, sizes, _, _, emitted = counts.tokens.fold(words)
    for word, at, n in zip(words, first.tolist(), sizes.tolist()):
        assert emitted[at : at + n].tolist() == [len(library.tokenize(word[: i + 1])) for i in range(n)]


def test_full_caches(monkeypatch):
    """Pieces and pairs beyond what is kept count all the same."""
    monkeypatch.setattr(tokencount, "CACHE", 50)
    monkeypatch.setattr(tokencount, "LONG", 40)
    monkeypatch.setattr(pieces, "KNOWN", 100)
    library, counts = Tokenizer.from_file(BPE), tokencount.PieceCounts(BPE)
    for seed in (1, 2, 3):
        texts = mixtures(300, seed) + ["x" * 200, "word " * 30]
        assert tokencount.count_texts(texts, counts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(counts) <= 400


def test_classes_are_the_library_s():
    rng, split = random.Random(3), Tokenizer.from_file(BPE).pre_tokenizer
    kinds = tokencount.class_table(BPE)
    for point in rng.sample([*range(0xD800), *range(0xE000, 0x110000)], 60_000):
        char = chr(point)
        joins = next((k for k, a in ((tokencount.LETTER, "a"), (tokencount.NUMBER, "1"), (tokencount.OTHER, "!")) if len(split.pre_tokenize_str(a + char)) == 1), tokencount.WHITE)
        own = {tokencount.SPACE: tokencount.WHITE, tokencount.QUOTE: tokencount.OTHER, tokencount.END1: tokencount.LETTER, tokencount.R_OR_V: tokencount.LETTER, tokencount.L_: tokencount.LETTER, tokencount.E_: tokencount.LETTER}.get(kinds[point], kinds[point])
        assert own == joins, hex(point)


def test_prefix_scan_composes_maps():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        maps = rng.integers(0, 12, (n, 12))
        expected, now = [], np.arange(12)
        for m in maps:
            now = m[now]
            expected.append(now)
        assert np.array_equal(tokencount.scan(maps), np.array(expected))


def test_count_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], 1, "x")], "doc_id long, text string, n_tokens int, key string")
    library = Tokenizer.from_file(BPE)
    rows = tokencount.token_counts(docs).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        n = len(library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((ODD[r.doc_id] or "").encode()), n > 512)
    assert tokencount.token_counts(docs.limit(0)).count() == 0


def test_long_runs_of_spaces():
    """100,000 spaces in a second: merging is not quadratic in a run."""
    words, library = pieces.WordPieces(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["a" + " " * 100_000 + tail for tail in ("", "hello world", "\u3000x")]
    began = time.process_time()
    got = [np.frombuffer(b, np.int32).tolist() for b in words.encode(texts)]
    assert time.process_time() - began < 3
    assert got == [library.encode(t) for t in texts]


def test_round_trip_is_encode_and_decode(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] * 2, "doc_id long, text string, pieces int")
    one = sorted((r.doc_id, r.pieces, r.text) for r in pieces.round_trip(docs).collect())
    two = sorted((r.doc_id, r.pieces, r.text) for r in pieces.decode(pieces.encode(docs)).collect())
    assert one == two and pieces.round_trip(docs.limit(0)).count() == 0


def _ids(encoded):
    return [np.frombuffer(b, np.int32).tolist() for b in encoded]


def test_pieces_equal_the_library():
    library, words = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.word_pieces(PIECES)
    rng = random.Random(2)
    vocabulary = list(words.table.ids)
    texts = mixtures(4000, 5) + ["".join(rng.choice(vocabulary).replace("▁", " " if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 9))) for _ in range(4000)] + ["".join(rng.choice("etaoinshrdlu ") for _ in range(20)) for _ in range(2000)]
    got = _ids(words.encode(texts))
    assert got == library.encode(texts)
    flat = np.array([i for ids in got for i in ids], np.int64)
    assert pieces.spelling(PIECES).decode(flat, np.array([len(ids) for ids in got])) == [t.replace("▁", " ") for t in texts]


def test_a_small_cache_changes_nothing(monkeypatch):
    texts = mixtures(300, 9)
    words = pieces.WordPieces(PIECES)
    whole = words.encode(texts)
    monkeypatch.setattr(pieces, "CACHE", 10)
    small = pieces.WordPieces(PIECES)
    assert [b for i in range(0, 300, 50) for b in small.encode(texts[i : i + 50])] == whole


def test_piece_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "x")], "doc_id long, text string, pieces string")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = pieces.decode(pieces.encode(docs)).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        assert r.pieces == library.encode(ODD[r.doc_id] or "") and r.text == (ODD[r.doc_id] or "")
    assert pieces.decode(pieces.encode(docs.limit(0))).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, pieces array<int>")).first().text == ""

"""The pipeline's stages on planted documents, and the registry."""

import random

import corpus_pipeline
import sentencepiece
import public_tokenizers
from tidemark import scratch
from tidemark.llm import registry


def planted():
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "in"] + [f"word{rng.randrange(3000)}"] * 3) for _ in range(n)) + "."
    rows = [(i, prose(90), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, "short text", "en", "s0"), (101, None, None, None), (102, "spam " * 100, "en", "s1"), (103, "w### " * 80, "en", "s1")]
    rows += [(200, rows[0][1], "en", "s0"), (201, rows[1][1] + " tail", "en", "s0"), (202, rows[2][1] + " token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff " + prose(60), "en", "s2")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages(spark, tmp_path):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources", "SentencePiece"]
    kept = stages["quality rules"](spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {*range(40), 200, 201, 202} and kept.columns == docs.columns
    unique = stages["n-gram Jaccard join"](spark, kept, "")
    assert {r.doc_id for r in unique.collect()} == {*range(40), 202} and unique.columns == docs.columns
    clean = stages["secret scans"](spark, unique, "")
    texts = {r.doc_id: r for r in clean.collect()}
    assert "24be" not in texts[202].text and texts[202].n_chars == len(texts[202].text) and texts[3].text == rows[3][1]
    mixed = stages["mixing sources"](spark, clean, "").collect()
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in texts.values()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in stages["SentencePiece"](spark, clean, "").collect():
        assert r.pieces == library.encode(texts[r.doc_id].text) and r.n_pieces == len(r.pieces)


def test_run_writes_every_stage(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50


def test_run_keeps_one_stage(spark, tmp_path, monkeypatch):
    """Of the stages' tables only the one that the result reads is left, and none of the join's."""
    monkeypatch.setattr(scratch, "root", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [p.name.split("-", 1)[1] for p in tmp_path.glob("pipeline-*/*")] == ["stage 4"] and not list(tmp_path.glob("jaccard-*"))
    assert out.count() > 50


ODD = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "", "", 0), (3, " \n ", "en", "s", 3), (None, "words without a key " * 30, "en", "s", 600), (4, "the of and in " + "long text, with many words. " * 40_000, "en", "s", 1_120_000)]


def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty and very long texts, repeated rows, an extra column, an empty table: no stage fails."""
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "in"] + [f"word{rng.randrange(3000)}"] * 3) for _ in range(n)) + "."
    rows = [(*r, "x") for r in ODD] + [(i, prose(80), None, None if i % 2 else "s", None, None) for i in range(10, 20)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            before, now = now.count(), spark.createDataFrame((out := stage(spark, now, "")).collect(), out.schema)
            if name != "SentencePiece":
                assert now.columns == docs.columns
            if name == "secret scans":
                assert now.count() == before
    assert now.count() == 0


def test_every_operator_is_registered():
    names = [n for i in range(1, 14) for n in registry.QUERIES if n.startswith(f"op{i}_")]
    assert len(names) == 13 and set(registry.ORACLES) <= set(registry.QUERIES)

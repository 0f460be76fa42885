"""Column names with dots, in other case, and like names used inside, through every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import alignment, ann, chat, clustering, extraction, jaccard, langid, licenses, mixing, pieces, quality, secrets, tokencount

NAMES = ("a.b", "N_Words", "_row", "KEPT", "Component_Id", "Size", "_hash", "part.x y", "_text", "word", "Spans")
WORDS = "the river of stone went along and the people of that town, who have it with them, saw the light. "
ROWS = [(i, f"{WORDS * 4} Number {i} of many things.\nLicensed under CC BY-NC 4.0. password = abcdefgh{i}", "en" if i % 2 else "fr", "s", 5) for i in range(12)] + [(None, None, None, None, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.lit("x") for n in NAMES})


A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
OPERATORS = {
    "mix": mixing.mix, "find_secrets": secrets.find_secrets, "quality_metrics": quality.quality_metrics, "judged": lambda d: quality.judged(quality.quality_metrics(d)),
    "identify": lambda d: langid.identify(d, langid.fit(d)), "encode": pieces.encode, "classes": lambda d: jaccard.similarity_classes(d, 3, 90), "tokens": tokencount.token_counts,
    "alignment": lambda d: alignment.alignment(d, A, B), "licenses": licenses.license_scan, "blocks": licenses.license_blocks,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(docs, name):
    out = OPERATORS[name](docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and out.select(*[F.col(f"`{c}`") for c in out.columns]).collect()


def test_stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.select(*[F.col(f"`{c}`") for c in out.columns]).count() <= 2 * len(ROWS)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(ROWS)


def test_other_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some text, it is.</p></article>", "x", "y", "z")], "page_id long, url string, html string, TEXT string, `a.b` string, N_chars string")
    out = extraction.extract(pages)
    assert out.columns == ["page_id", "url", "a.b", "text", "n_chars"] and out.select("text").first().text == "Some text, it is."
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x", "y"), (1, 1, "assistant", "ho", "x", "y")], "conv_id long, turn long, role string, text string, `a.b` string, N_Turns string")
    assert chat.read_back(chat.format_windows(turns)).first().n_turns == 2
    vectors = spark.createDataFrame([(i, [float(i), 1.0] * 32, "x", "y") for i in range(4)], "vec_id long, embedding array<float>, `a.b` string, CLUSTER string")
    assert clustering.cluster(vectors).count() == 4 and ann.nearest(vectors).count() == 3

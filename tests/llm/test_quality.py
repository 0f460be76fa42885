"""Quality rules against a brute-force version, on odd inputs and on whole tables by SQL."""

import re

import duckdb

from tidemark.llm import quality

DATA = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\f\r"
PROSE = "the cat sat on the mat and it was not in a hurry to go out of the house, "
TEXTS = [
    None, "", "   \n\t ", "word", "a b", "a b c a b c", "a b c d a b c d x", "a a a a a", PROSE * 4, PROSE * 1 + "unique words follow here one two three four five six seven eight nine ten " * 1,
    " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i} the" for i in range(40)), "#$% | | | the and of " * 20, "line one\nline one\n\n \nline two\nline one", "x y z", "é ß the\x0bof\x0cand\rto", "- the one\n- of two\n* and three\n• to four",
    "the of and..." + "\nthe end of it…" * 3, "long " * 30_000 + " ".join(f"t{i}" for i in range(50)),
]


def brute(text):
    text = text or ""
    words = [w for w in re.split(f"[{SPACES}]+", text) if w]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p for starts in at.values() if len(starts) > 1 for i in starts for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    base_failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base_failed


def test_metrics_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string, n_words int")
    got = {r.doc_id: r for r in quality.judged(quality.quality_metrics(docs)).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), repr(text)[:80]
        assert not (r.base_failed and r.kept)


def test_filter_keeps_rows_and_columns(spark):
    good = " ".join(f"word{i} the of" for i in range(40)) + "."
    docs = spark.createDataFrame([(1, good, "a"), (1, good, "a"), (2, None, "b"), (3, "", "c"), (None, good, None)], "doc_id long, text string, one string")
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where(docs.text == good).collect()))
    assert quality.quality_filter(docs.limit(0)).count() == 0


def test_whole_table_by_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    found = con.sql(quality.OP3_SQL)
    df = quality.op3_quality_rules(spark, DATA).select(*found.columns)
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def test_runs_on_built_in_expressions_alone(spark):
    plan = quality.op3_quality_rules(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_columns_with_clashing_names(spark):
    """No column of the user's is lost or in the way, whatever its name; those named like results are replaced."""
    body = "the of and in " + " ".join(f"word{i}" for i in range(60)) + "."
    names = ["one", "_words", "_lines", "_keys", "_row", "_text", "own", "body", "a.b", "n_words", "kept"]
    docs = spark.createDataFrame([(1, body, *names)] * 2, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = quality.judged(quality.quality_metrics(docs))
    for r in out.collect():
        assert all(r[n] == n for n in names[:-2]) and r.n_words == 64 and r.kept
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [tuple(r) for r in docs.collect()]
    assert quality.quality_filter(docs.limit(0)).count() == 0 and quality.judged(quality.quality_metrics(docs.limit(0))).count() == 0
    alone = quality.quality_metrics(docs.select("text", "doc_id").limit(1), "text").first()
    assert alone.n_words == 64

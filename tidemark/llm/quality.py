"""Quality rules: a threshold table compiled into one projection of built-in Spark expressions.

Every metric is a column expression over the whole text, every rule compares two metrics in
integer percent, and the verdict is their conjunction; nothing leaves the JVM and nothing shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, words_of

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "als auf das dem den der die ein eine im in ist mit nicht sich und von zu "
    "al como con del el es las lo los no para por su y"
)
SYMBOLS = "#*$%&|<>"


#: As the whole of a rule: the metric itself is bounded.
ONE = "one"


@dataclass(frozen=True)
class Rule:
    """``at_least`` <= 100 * part / whole <= ``at_most``; a bound of None is open. ``whole`` may be ONE."""

    name: str
    part: str
    whole: str
    at_least: int | None = None
    at_most: int | None = None

    def holds(self) -> Column:
        share, whole = F.col(self.part) * 100, F.lit(1) if self.whole == ONE else F.col(self.whole)
        bounds = [share >= whole * self.at_least] if self.at_least is not None else []
        bounds += [share <= whole * self.at_most] if self.at_most is not None else []
        return reduce(and_, bounds)


#: Base rules: their failure rejects a document whatever the others say.
BASE_RULES = (
    Rule("length", "n_words", ONE, at_least=5000),
    Rule("repetition", "n_repeat_words", "n_words", at_most=50),
)
RULES = (
    Rule("word_length_low", "word_chars", "n_words", at_least=200),
    Rule("word_length_high", "word_chars", "n_words", at_most=2000),
    Rule("symbols", "n_symbols", "n_words", at_most=15),
    Rule("stop_words", "n_stop_words", "n_words", at_least=5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", at_most=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", at_most=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", at_most=60),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def stop_word_pattern(stop_words: str = STOP_WORDS) -> str:
    """A pattern for one stop word between white space, a final dot or comma allowed; tried letter by letter."""
    words = sorted(set(stop_words.split()))
    heads = [f"{head}(?:{'|'.join(w[1:] for w in words if w[0] == head)})" for head in sorted({w[0] for w in words})]
    return f"(?:^|{SPACE_CLASS})(?:{'|'.join(heads)})(?=[.,]?(?:{SPACE_CLASS}|$))"


def repeated_words(words: Column, keys: Column) -> Column:
    """Positions covered by a window whose key occurs twice or more; ``keys`` holds one key per window.

    Keys with their positions are sorted, neighbours with equal keys are kept, and the windows
    they start are laid over each other so that no position counts twice.
    """
    at = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(a: Column) -> Column:
        return F.filter(a, lambda x, k: (F.get(a, k - 1)["h"] == x["h"]) | (F.get(a, k + 1)["h"] == x["h"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    # A one-element array keeps each sorted array a bound variable, so that it is computed once.
    pairs = F.transform(F.array(at), lambda a: F.when(F.size(a) > 0, twice(a)).otherwise(a))
    starts = F.transform(pairs, lambda a: F.sort_array(F.transform(a, lambda x: x["i"])))
    return F.get(F.transform(starts, covered), F.lit(0))


def quality_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of METRICS (long); columns of these names are replaced, all others stay as they are.

    A null, empty or blank text has zero for every metric; a text of any length is taken whole. Lines are split at
    \\n and count only if they hold a word. Windows of three words are told apart by a 64-bit hash of their words.
    Rows do not depend on each other: repeated rows stay repeated, an empty table stays empty, nothing can tie.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in METRICS]  # as Spark compares names
    # The user's columns travel as one, so that no name of theirs meets a name used here.
    docs = docs.select(F.struct(*own).alias("_row") if own else F.lit(None).alias("_row"), F.col(f"`{text}`").alias("_text"))
    body = F.coalesce("_text", F.lit(""))
    step = docs.select(
        "*",
        words_of(F.col("_text")).alias("_words"),
        F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0).alias("_lines"),
    )
    step = step.withColumn(
        "_keys",
        F.when(
            F.size("_words") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    repeats = F.size(F.array_distinct("_keys")) < F.size("_keys")
    count = lambda keep: F.size(F.filter("_lines", keep)).cast("long")
    return step.select(
        *(["_row.*"] if own else []),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, repeated_words(F.col("_words"), F.col("_keys"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.regexp_count(F.lower(body), F.lit(stop_word_pattern())).cast("long").alias("n_stop_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        count(lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")).substr(1, 1).isin("-", "*", "•")).alias("n_bullet_lines"),
        count(lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…"))).alias("n_ellipsis_lines"),
    )


def judged(metrics: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``metrics`` with ``base_failed`` and ``kept``, the compiled verdicts of both rule tables, in place of columns of
    these names."""
    base_ok, ok = (reduce(and_, [r.holds() for r in table]) for table in (base, rules))
    return metrics.withColumns({"base_failed": ~base_ok, "kept": base_ok & ok})


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their own columns alone.

    An id-free filter: repeated rows stay repeated, null and empty texts go (no words), columns that
    happen to be named like a metric come back untouched.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{text}`").alias("body"))
    verdicts = judged(quality_metrics(whole, "body"))
    # Not where(): the optimizer would move it below the projection and evaluate every metric again in place.
    return verdicts.select(F.explode(F.when(F.col("kept"), F.array("own"))).alias("own")).select("own.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(quality_metrics(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WS = r"[\x20\x09-\x0D]"
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{_WS}+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(t, '{_WS}', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: list_contains(string_split('{" ".join(sorted(set(STOP_WORDS.split())))}', ' '), regexp_replace(lower(x), '[.,]$', ''))))::BIGINT AS n_stop_words,
             len(lines)::BIGINT AS n_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
             len(list_filter(lines, lambda x: x LIKE '%...' OR x LIKE '%…'))::BIGINT AS n_ellipsis_lines
      FROM w LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND 100 * word_chars BETWEEN 200 * n_words AND 2000 * n_words
        AND 100 * n_symbols <= 15 * n_words AND 100 * n_stop_words >= 5 * n_words AND 100 * n_dup_lines <= 50 * n_lines
        AND 100 * n_bullet_lines <= 90 * n_lines AND 100 * n_ellipsis_lines <= 60 * n_lines) AS kept
FROM m
"""

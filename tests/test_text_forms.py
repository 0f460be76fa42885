"""Character references, sequence ratios and URL forms against the standard library."""

import html
import random
from difflib import SequenceMatcher
from html.entities import html5
from urllib.parse import urlsplit, urlunsplit

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import text


def test_references(spark):
    rng = random.Random(4)
    values = [f"a&{n}b" for n in html5] + [f"&{n}" for n in html5] + [f"x&{n[:-1]}1;" for n in html5 if n[-1] == ";"]
    values += [f"&#{n}{end}" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 10**7, 10**20] for end in (";", "", "x", "a;")]
    values += [f"&#{x}{n:x};" for n in (0, 9, 13, 128, 150, 255, 0x1F600, 0x10FFFF, 0x110000, 10**15) for x in ("x", "X", "x000", "x00000000")]
    values += ["&", "&&", "&;", "&#", "&#;", "&#x;", "& amp;", "&amp;lt;", "&amp;amp;", "&am", "&notit;", "&notin;", "a" * 40 + "&" + "a" * 40 + ";", "&\n", "", "plain", "&é;", "&lt&gt"]
    values += ["".join(rng.choice(["&", "amp", "lt", ";", "#", "x", "41", "not", "in", " ", "é", "&#", "&#x"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    rows = df.select("v", text.unescaped(F.col("v")).alias("got")).collect()
    assert [(r.v, r.got) for r in rows if r.v is not None and r.got != html.unescape(r.v)] == [] and rows[-1].got is None
    assert "Python" not in df.select(text.clean_text(F.col("v")))._jdf.queryExecution().toString()


def pairs(n, seed=6):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(["ab", "abc ", "etaoin shrdlu", "é中😀a"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
        b = list(a if rng.random() < 0.6 else (rng.choice(letters) for _ in range(rng.randint(0, 24))))
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 3)] = [rng.choice(letters) for _ in range(rng.randint(0, 3))]
        yield a, "".join(b)


def test_ratios():
    """Equal to the standard library on 100,000 random pairs, in steps of any size."""
    both = list(pairs(100_000))
    left, right = map(list, zip(*both))
    want = np.array([SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in both])
    assert (text.ratios(left, right) == want).all()
    text.CELLS, cells = 50, text.CELLS
    assert (text.ratios(left[:2000], right[:2000]) == want[:2000]).all()
    text.CELLS = cells
    long = ["word " * 60 + "x" * 300, "wodr " * 50]
    assert text.ratios(long, long[::-1]).tolist() == [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in zip(long, long[::-1])]


def test_bound(spark):
    both = list(pairs(3000, 9))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(both)], "i int, a string, b string")
    rows = df.select("i", text.ratio_bound(F.col("a"), F.col("b")).alias("bound"), text.sequence_ratio("a", "b").alias("ratio")).collect()
    assert len(rows) == 3000
    for r in rows:
        quick = SequenceMatcher(None, *both[r.i], autojunk=False).quick_ratio()
        assert abs(r.bound - quick) < 1e-12 and r.bound >= r.ratio - 1e-12
    close = [r for r in rows if r.bound >= 0.92]
    assert len(close) < 0.5 * len(rows)  # what is left to be matched


def plain_url(value):
    try:
        parts = urlsplit(value)
    except ValueError:
        return "<invalid-url>"
    if not parts.scheme or not parts.netloc:
        return parts.path or "<unknown-endpoint>"
    try:
        name, port = parts.hostname or "", parts.port
    except ValueError:
        return urlunsplit((parts.scheme, "<invalid-host>", parts.path, "", ""))
    return urlunsplit((parts.scheme, (f"[{name}]" if ":" in name else name) + (f":{port}" if port else ""), parts.path, "", ""))


def test_urls(spark):
    values = ["https://User:p@Host.Example:443/P?q=1#f", "HTTP://H", "https://h:0/x", "https://h:99999/x", "https://h:abc/x", "https://h:/x", "http://[::1]:80/a", "http://[::1/a", "http://::1]/a", "http://[zz]/", "http://[v1.a]/", "http://[fe80::1%Eth0]/x", "//host/p", "/only/path?x", "?q", "", "mailto:me@x.y", "http:///p", "http://h?x", "  https://h/\tp", "https://u@v@h/p", "ftp://H:021/é", "x y z", "1http://h/p", "https://h:65535", "https://h:65536"]
    rng = random.Random(2)
    values += ["".join(rng.choice(["http", "://", ":", "/", "@", "?", "#", "h", "80", "A", ".", "//", "x"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    wrong = [(r.v, r.got, plain_url(r.v)) for r in df.select("v", text.safe_url(F.col("v")).alias("got")).collect() if r.got != plain_url(r.v)]
    assert not wrong, wrong


def test_titles_cut_inside_a_reference(spark, tmp_path):
    """A title that ends inside `&amp;` is decoded as html.unescape has it, in title_clean and in each feed."""
    from tidemark.plans.catalogue import QUERIES

    titles = [f"Ham &amp; eggs&amp;{'&amp;'[:n]}" for n in range(5)] + ["a&lt", "b&quot", "c&am"]
    rows = [(7 * i + 2 * (i % 2 == 0) + 1, "https://a.example/", f"<html><title>{t}</title></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = {r[0]: " ".join(html.unescape(t).split()) for r, t in zip(rows, titles, strict=True)}
    for name, column in {"title_clean": "clean", "feed_finnhub": "title", "feed_gnews": "title", "feed_massive": "title", "feed_newsapi": "title", "feed_seekingalpha": "title", "feed_google": "title"}.items():
        got = {r["page_id"]: r[column].removesuffix(" - The Paper") for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == want, name

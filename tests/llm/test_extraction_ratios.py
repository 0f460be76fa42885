"""Tag-path ratios: what they decide, against a plain computation, on pages that tell nothing by names, in linear time."""

import html
import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq

from tests.llm.test_extraction import P1, P2, T1, T2
from tidemark.llm import extraction

PAGES = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]


def article(page):
    """The article of a page of the table, read by its tags alone."""
    body = re.split("</article>|<footer", page.split("<article>", 1)[1])[0]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_neutral_ratios_break_every_page(monkeypatch):
    assert all(extraction.main_text(p) == article(p) for p in PAGES)
    monkeypatch.setattr(extraction, "path_scores", lambda blocks, _: {b[0]: 1.0 for b in blocks})
    assert not any(extraction.main_text(p) == article(p) for p in PAGES)


def test_ratios_alone_settle_most_pages(monkeypatch):
    """Without any list of names most pages come out right, above all those with an article of some length."""
    for name in ("ASIDE", "MARKED", "HEADER", "WHOLE"):
        monkeypatch.setattr(extraction, name, set())
    monkeypatch.setattr(extraction, "CONTAINER", extraction.CONTAINER | {"article"})
    right = [extraction.main_text(p) == article(p) for p in PAGES]
    assert sum(right) > 0.6 * len(PAGES)
    long = [ok for p, ok in zip(PAGES, right) if len(article(p)) > 1000]
    assert len(long) > 50 and sum(long) > 0.8 * len(long)


def test_pages_without_telling_names():
    links = "".join(f"<li><a href=/{i}>Topic {i}</a></li>" for i in range(9))
    body = f"<p>{P1}</p><p>{P2}</p>" * 4
    text = "\n".join([T1, T2] * 4)
    for page, want in {
        f"<body><div class=x1><ul>{links}</ul></div><div class=x2><h1>Head</h1>{body}</div><div class=x3>Terms. Us.</div></body>": f"Head\n{text}",
        f"<table><tr><td><ul>{links}</ul></td><td><h2>Head</h2>{body}</td><td>Buy it.</td></tr></table>": f"Head\n{text}",
        f"<body><div><div><ul>{links}</ul></div><div><h1>Head</h1><div>{body}</div></div></div><div><p>Made by us.</p></div></body>": f"Head\n{text}",
        f"<body><section>{body}</section><section><p>{P1}</p></section><div>{links}</div></body>": f"{text}\n{T1}",
    }.items():
        assert extraction.main_text(page) == want


class Plain(HTMLParser):
    """(path of block elements, text outside links) of simple pages, with every element closed and no spaces around tags."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.blocks, self.fresh = [], [], True
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)
        self.fresh |= tag not in extraction.INLINE

    def handle_endtag(self, tag):
        self.stack.pop()
        self.fresh |= tag not in extraction.INLINE

    def handle_data(self, data):
        if self.fresh:
            self.blocks.append(["/".join(t for t in self.stack if t not in extraction.INLINE), ""])
            self.fresh = False
        if "a" not in self.stack:
            self.blocks[-1][1] += data


def test_scores_by_plain_computation():
    page = f"<body><div><ul><li><a>One</a></li><li><a>Two</a>,x</li></ul></div><div><h1>Head, and more</h1><p>{P1}</p><p>Short<b>bold</b>.</p><p>z</p></div></body>"
    own = extraction.Page(page)
    scores = extraction.path_scores(own.blocks, extraction.marks_around(own.marks, 0))
    plain, sums = Plain(page).blocks, {}
    for path, text in plain:
        sums.setdefault(path, []).append(text)
    want = {}
    for path, texts in sums.items():
        n, marks = len(texts), sum(sum(t.count(c) for c in extraction.PUNCTUATION) for t in texts)
        want[path] = sum(map(len, texts)) / n * (1 + marks / n)
    assert [scores[b[0]] for b in own.blocks] == [want[path] for path, _ in plain]
    near = extraction.smoothed([1.0, 0.0, 0.0, 8.0], ["a", "a", "b", "b"])
    assert near == [4 / 6, 2 / 6, 16 / 6, 32 / 6]


def test_linear_time():
    n = 40_000
    odd = {
        "paragraphs": "<article>" + "<p>A paragraph, with words. " * n, "unclosed quotes": "<p>x</p>" + '<a "' * n + ">", "unclosed tags": "<a " * n, "open inline": "<b>" * n + "text",
        "open divs": "<div class=ad>" * n + "text, it is.", "lone ends": "<p>a</b>" * n, "mixed": "<b>" * n + "<div>x</b>" * n, "rows": "<table>" + "<tr><td>x" * n, "lists": "<ul>" * n + "<li>x" * n, "nested lists": "<ul><li>" * n + "x", "crossed": "<i><div>" + "<b>" * n + "</i>" * n, "crossed texts": "<i><div>" + "<b>x" * n + "</i>y" * n, "comments": "<!-- " * n, "raw": "<script>" * n,
    }
    for name, page in odd.items():
        began = time.process_time()
        extraction.main_text(page)
        assert time.process_time() - began < 6, name


def test_odd_markup():
    assert extraction.main_text("<p>1 < 2 and 3 > 2, so it is.</p>") == "1 < 2 and 3 > 2, so it is."
    assert extraction.main_text('<p title="a > b">Text, here.</p>') == "Text, here."
    assert extraction.main_text('<p>First, one.</p><p title="never closed>Second, one.</p><p>Third, one.</p>') == "First, one.\nSecond, one.\nThird, one."
    assert extraction.main_text("<p>Text, here.</p><!-- open") == "Text, here."


def test_columns_with_clashing_names(spark):
    rows = [(1, "<p>a, b.</p>", "old", 5, 9)] * 2
    out = extraction.extract(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int, `a.b` int"))
    assert out.columns == ["page_id", "a.b", "text", "n_chars"] and [tuple(r) for r in out.collect()] == [(1, 9, "a, b.", 5)] * 2
    assert extraction.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0

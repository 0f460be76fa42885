"""Main text: hand-made pages of several layouts, odd pages, and the whole table against a plain reading of it."""

import html
import re

import pytest

from tidemark.llm import extraction

P1 = "The first paragraph, which is long enough, has commas, stops. And it goes on; for a while, at least."
P2 = "A second one follows it, with an entity &amp; a <b>bold</b>\n   word, and <a href='/x'>a link</a>, too."
T1, T2 = P1, "A second one follows it, with an entity & a bold word, and a link, too."
NAV = "<nav><ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(12)) + "</ul></nav>"
PAGES = {
    "article": (f"<html><body>{NAV}<div class='ad'>Buy now, really, do it. Now, please.</div><article><h1>Title</h1><p>{P1}<p>{P2}</article><footer>&copy; us, all of it.</footer></body></html>", f"Title\n{T1}\n{T2}"),
    "divs": (f"<body><div id=menu><a>Home</a><a>News</a></div><div id=content><h2>Head</h2><p>{P1}</p><p>{P2}</p><p>Short.</p></div><div class='sidebar-box'><p>Other news, more news, and even more news, all of it.</p></div></body>", f"Head\n{T1}\n{T2}\nShort."),
    "comments": (f"<main><article><header><h1>T</h1></header><p>{P1}</p><div class=comments><article class=comment><p>{P2}</p></article></div><form><label>Name, please.</label></form></article></main>", f"T\n{T1}"),
    "notice": (f"<body><div class='cookie-notice'>{P1}</div><div role=dialog>{P1}</div><section><p>{P1}</p><p>{P2}</p></section><div style='display: none'>{P1}</div></body>", f"{T1}\n{T2}"),
    "script": (f"<head><title>x</title><script>var t='</p><p>no';</script><style>p{{}}</style></head><body><article><p>{P1}</p><script>if (a<b) document.write('<p>x</p>')</script><!-- <p>no</p> --><p>a < b, c &lt; d &#233;&nbsp;x</p></article>", f"{T1}\na < b, c < d é x"),
    "list": (f"<article><h1>L</h1><ul><li>one, two<li>three</ul><p>{P1}<br>after a break</p></article>", f"L\none, two\nthree\n{T1} after a break"),
    "plain": ("just   text\nwithout tags", "just text without tags"),
    "unclosed": (f"<body><article><p>{P1}<p><b>Bold start, and then<p>the next, one", f"{T1}\nBold start, and then\nthe next, one"),
    "empty": ("", ""), "null": (None, ""), "blank": ("<html><body> <p> </p>\n</body></html>", ""), "only nav": (f"<body>{NAV}</body>", ""),
}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, name, page, "x") for i, (name, (page, _)) in enumerate(PAGES.items())] + [(0, "article", PAGES["article"][0], "x")]
    df = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    out = df.collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    return {r.url: r.text for r in out}


@pytest.mark.parametrize("name", PAGES)
def test_page(texts, name):
    assert texts[name] == PAGES[name][1]


def test_long_page(spark):
    body = "".join(f"<p>Paragraph {i}, with words, and more. " + "word " * 40 for i in range(3000))
    page = f"<body>{NAV}<article>{body}</article></body>"
    row = extraction.extract(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert row.text.count("\n") == 2999 and "Item" not in row.text


def test_whole_table(spark):
    data = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = extraction.op10_html_text(spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id].split("<article>", 1)[1]
        body = re.split("</article>|<footer", body)[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(b for b in blocks if b)

"""Main text in marked wrappers."""

import pytest

from tests.llm.test_extraction import NAV, P1, P2, T1, T2
from tidemark.llm import extraction

ARTICLE = f"<article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article>"
SIDE = "<div class=sidebar><p>Other news, more news, and even more.</p></div>"
WRAPPED = {
    **{name: f"<body>{NAV}<div class='{name}'>{ARTICLE}{SIDE}</div></body>" for name in ("content has-sidebar", "layout no-sidebar", "page-with-menu", "post-search-results", "search")},
    "form": f"<body><form id=aspnetForm>{NAV}<div>{ARTICLE}</div>{SIDE}</form></body>",
    "main": f"<body>{NAV}<main><div class='content has-sidebar'>{ARTICLE}{SIDE}</div></main></body>",
    "nested": f"<body><form><div class='page-with-menu'>{NAV}{ARTICLE}{SIDE}</div></form></body>",
    "no article": f"<body>{NAV}<form><div class='layout no-sidebar'><h1>Title</h1><p>{P1}</p><p>{P2}</p></div>{SIDE}</form></body>",
    "title outside": f"<body>{NAV}<main><h1>Title</h1><div class='content has-sidebar'><p>{P1}</p><p>{P2}</p></div></main></body>",
    "teasers": f"<body>{ARTICLE}<div class='related-posts'><article><p>{P1}</p></article></div><div class=comments><p>{P1}</p><p>{P1}</p><p>{P1}</p></div></body>",
    "hidden": f"<body>{ARTICLE}<div style='display:none'><article><p>{P1}</p><p>{P1}</p><p>{P1}</p></article></div></body>",
}


def test_wrappers(spark):
    df = extraction.extract(spark.createDataFrame(list(WRAPPED.items()), "url string, html string"))
    assert {r.url: r.text for r in df.collect()} == {name: f"Title\n{T1}\n{T2}" for name in WRAPPED}

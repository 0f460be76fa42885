"""Main text whose parts lie in several containers."""

from tests.llm.test_extraction import NAV, P1, P2, T1, T2
from tidemark.llm import extraction

BODY, TEXT = f"<p>{P1}</p><p>{P2}</p>" * 3, "\n".join([T1, T2] * 3)
SPLIT = {
    "lead": (f"<body>{NAV}<div id=content><div class=lead><h2>Head</h2><p>{P1}</p></div><div class=body>{BODY}</div></div></body>", f"Head\n{T1}\n{TEXT}"),
    "articles": (f"<body>{NAV}<article>{BODY}</article><article><p>{P1}</p></article></body>", f"{TEXT}\n{T1}"),
    "section": (f"<body>{NAV}<div><section>{BODY}</section><section><h2>End</h2><p>{P2}</p></section></div></body>", f"{TEXT}\nEnd\n{T2}"),
    "loose": (f"<body>{NAV}<p>{P1}</p><div>{BODY}</div><div><a href=/a>Home</a></div></body>", f"{T1}\n{TEXT}"),
}


def test_split_pages(spark):
    df = extraction.extract(spark.createDataFrame([(name, page) for name, (page, _) in SPLIT.items()], "url string, html string"))
    assert {r.url: r.text for r in df.collect()} == {name: text for name, (_, text) in SPLIT.items()}

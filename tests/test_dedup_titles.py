"""Equal titles are one key in entity resolution, not all pairs of their items."""

from tests.test_dedup import SCHEMA, model
from tidemark.operators import dedup


def test_one_title_on_most_items(spark, monkeypatch):
    pairs = []

    def counted(self, df, label, keep=False, written=dedup.Scratch.written):
        out = written(self, df, label, keep)
        if label == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(dedup.Scratch, "written", counted)
    rows = [(i, f"c{i}", f"l{i}", f"u{i}", "d0", "one title that very many of the items share" if i % 10 else f"one title that very many of the items shared {i % 3}") for i in range(300)]
    got = {r.pos: (r.canonical, r.matched) for r in dedup.greedy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == model(rows)
    assert pairs and sum(pairs) <= len(rows)

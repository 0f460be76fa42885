"""Similar titles by the whole rule against brute force."""

import os

from tests.test_dedup import similar
from tidemark.plans.catalogue import QUERIES

TITLES = ["alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta thetas", "theta alpha beta gamma delta epsilon zeta eta", "alpha beta gamma delta", "Alpha, beta gamma delta!", "alpha beta gamma delta 7", "other words of no kin"]


def test_pairs_by_ratio(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<title>{t}</title>") for i, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(os.path.join(tmp_path, "pages.parquet"))
    plain = [t.lower().replace(",", "").replace("!", "") for t in TITLES]
    expected = {(i, j) for i in range(len(plain)) for j in range(i) if similar(plain[i], plain[j])}
    assert {tuple(r) for r in QUERIES["near_dup_pairs_ratio"](spark, str(tmp_path)).collect()} == expected
    assert (1, 0) in expected and (1, 0) not in {tuple(r) for r in QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect()}

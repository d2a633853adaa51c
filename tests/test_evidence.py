"""Evidence queries beside their SQL where words are numbers."""

import pytest

from spanloom.plans import catalog, mining  # noqa: F401
from tests.parity import compare, connection


@pytest.mark.parametrize("name", ["u_evidence_units", "u_evidence_frequencies", "n_evidence_pairs", "n_evidence_edges"])
def test_numbers_among_the_words(spark, tmp_path, name):
    texts = ["a 1 b c 137 d", "is it 7 or 8 then", None, "x 3 y z 60 60", "p q r s t", "one", "0 1 2 3 4 5"]
    docs = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(0, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "l"))
    for short, long in (("d", "documents"), ("l", "labels")):
        next((tmp_path / short).glob("*.parquet")).rename(tmp_path / f"{long}.parquet")
    compare(spark, connection(str(tmp_path)), str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name])

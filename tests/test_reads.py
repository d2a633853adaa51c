"""How often rows are made and moved, beside what results are."""

import math
import random
import re
from collections import Counter

import pytest

from spanloom.operators import diagnostics, models, paired


def test_paired_tfidf_moves_a_term_of_a_pair_twice(spark):
    data = [(1, "one two two", "one two"), (2, "three", None), (3, "", "x"), (4, "the same text", "the same text")]
    got = models.paired_tfidf(spark.createDataFrame(data, "k long, a string, b string"), "k", "a", "b")
    moved = got._jdf.queryExecution().optimizedPlan().toString()
    assert moved.count("Generate explode(") <= 4 and moved.count("Join ") == 2
    cosines = {r["k"]: r["cosine"] for r in got.collect()}
    idf = lambda df: math.log(9 / (1 + df)) + 1
    one, other = {"one": idf(2), "two": 2 * idf(2), "one two": idf(2), "two two": idf(1)}, {"one": idf(2), "two": idf(2), "one two": idf(2)}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    assert math.isclose(cosines[1], sum(one[t] * other[t] for t in other) / size(one) / size(other))
    assert cosines[2] == cosines[3] == 0.0 and math.isclose(cosines[4], 1.0)


@pytest.mark.parametrize("chunk,bucket", [(1 << 20, 1 << 20), (90, 400)])
def test_paired_tfidf_asks_a_term_once_a_chunk(spark, monkeypatch, chunk, bucket):
    """Rows between stages are blocks, not terms of pairs; texts of equal keys are one, and no pair of words spans two of them."""
    monkeypatch.setattr(paired, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(paired, "BUCKET_BYTES", bucket)
    written, stored = [], paired.stored
    monkeypatch.setattr(paired, "stored", lambda df, name, *a: written.append(stored(df, name, *a)) or written[-1])
    rng = random.Random(4)
    said = lambda: " ".join(rng.choice(["Über", "x", "été", "two", "three", "4th", "a_b"]) for _ in range(rng.randrange(12)))
    data = [(i % 30, said(), said() if i % 7 else None) for i in range(40)]
    got = models.paired_tfidf(spark.createDataFrame([*data, (None, "one two", "one two")], "k long, a string, b string").repartition(2), "k", "a", "b")
    sides = {}
    for k, *texts in [*data, (None, "one two", "one two")]:
        for side, t in enumerate(texts):
            w = re.findall(r"\w{2,}", (t or "").lower())
            sides.setdefault((k, side), Counter()).update([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])
    df = Counter(t for c in sides.values() for t in c)
    vector = lambda c: {t: n * (math.log(83 / (1 + df[t])) + 1) for t, n in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for r in (rows := got.collect()):
        one, other = (vector(sides[r["k"], i]) for i in (0, 1))
        dot = sum(x * other.get(t, 0) for t, x in one.items())
        assert math.isclose(r["cosine"], dot / size(one) / size(other) if dot and r["k"] is not None else 0.0, abs_tol=1e-12)
    assert len(rows) == 41
    asked = sum(w.count() for w in written)
    assert written and (chunk == 90 or asked <= 8), asked


def test_granularity_is_made_once_for_its_summary(spark):
    rows = spark.createDataFrame([("m", "a b c d", ["a b", "d"], ["A", "B"]), ("m", "a", ["zz"], [""]), ("n", None, [], [])], "llm string, t string, sp array<string>, lb array<string>")
    got = diagnostics.granularity_summary(diagnostics.granularity(rows, "t", "sp", "lb"), ["llm"], ["annotation_density"])
    assert got.inputFiles() and all("granularity-" in f for f in got.inputFiles())
    assert {r["llm"]: (r["n_rows"], r["median_annotation_density"]) for r in got.collect()} == {"m": (2, 0.75), "n": (1, 0.0)}

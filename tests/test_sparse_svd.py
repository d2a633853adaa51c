"""Truncated SVD of TF-IDF rows against numpy on the dense matrix."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from spanloom.operators import sparse_svd


def dense(texts, most):
    """Rows and terms of the whole TF-IDF matrix, by the usual rules."""
    grams = []
    for t in texts:
        w = re.findall(r"\w{2,}", t.lower())
        grams.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    total, df = Counter(), Counter()
    for g in grams:
        total.update(g)
        df.update(g.keys())
    names = sorted(sorted(total, key=lambda t: (-total[t], t))[:most])
    x = np.array([[g[t] * (np.log((1 + len(texts)) / (1 + df[t])) + 1) for t in names] for g in grams])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), names


def prose(n, seed=1):
    rng = random.Random(seed)
    words = ["word%d" % i for i in range(60)]
    return [" ".join(rng.choice(words[a : a + 25]) for _ in range(rng.randrange(8, 40))) for a in (rng.choice([0, 15, 35]) for _ in range(n))]


@pytest.mark.parametrize("most,k", [(10_000, 8), (90, 40)])
def test_values_vectors_and_cosines(spark, most, k):
    texts = prose(150)
    df = spark.createDataFrame(list(enumerate(texts)) + [(900, ""), (901, None), (902, "!")], "id long, text string").repartition(3)
    got, model = sparse_svd.text_vectors(df, "id", "text", k, most, 1e-9)
    x, names = dense([*texts, "", "", "!"], most)
    x = x[:150]
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert model.terms == names and np.abs(model.values - s[:k]).max() < 1e-7
    assert np.abs(np.abs((model.right * vt[:k].T).sum(0)) - 1).max() < 1e-5  # same directions, either sign
    rows = {r["id"]: np.array(r["vector"]) for r in got.collect()}
    assert sorted(rows) == list(range(150))
    y = np.array([rows[i] for i in range(150)])
    z = u[:, :k] * s[:k]
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    assert np.abs(np.linalg.norm(y, axis=1) - 1).max() < 1e-9 and np.abs(y @ y.T - z @ z.T).max() < 1e-5


def test_few_texts_and_low_rank(spark):
    two = spark.createDataFrame([(1, "red fish"), (2, "blue fish")], "id long, text string")
    x, _ = dense(["red fish", "blue fish"], 100)
    got = np.array([r["vector"] for r in sorted(sparse_svd.text_vectors(two, "id", "text")[0].collect())])
    assert np.allclose(got, x)
    same = spark.createDataFrame([(i, "one and the same text") for i in range(9)] + [(9, "something else")], "id long, text string")
    got, model = sparse_svd.text_vectors(same, "id", "text", 5)
    y = np.array([r["vector"] for r in sorted(got.collect())])
    assert np.allclose(y @ y.T, np.block([[np.ones((9, 9)), np.zeros((9, 1))], [np.zeros((1, 9)), 1]]), atol=1e-6) and np.allclose(model.values[:2], [3, 1]) and np.abs(model.values[2:]).max() < 1e-6
    assert sparse_svd.text_vectors(same.limit(0), "id", "text")[0].count() == 0


def test_grams_are_not_written(spark, monkeypatch):
    """What is written has at most a row a text, and equal keys are one text wherever their rows are."""
    written, stored = [], sparse_svd.stored
    monkeypatch.setattr(sparse_svd, "stored", lambda df, name, *a: written.append(stored(df, name, *a)) or written[-1])
    texts = prose(30, 2)
    df = spark.createDataFrame([(i % 15, t) for i, t in enumerate(texts)], "id long, text string").repartition(4)
    got, model = sparse_svd.text_vectors(df, "id", "text", 4)
    assert got.count() == 15 and max(w.count() for w in written) <= 15
    term = next(t for t in model.terms if " " not in t)
    have = len({i % 15 for i, t in enumerate(texts) if term in t.split()})
    assert abs(model.idf[model.terms.index(term)] - np.log(16 / (1 + have)) - 1) < 1e-12


def test_terms_named_by_few_blocks(spark, monkeypatch):
    """Blocks that leave out their rare terms give the same vocabulary, and no row a term is moved but for those; where bounds are too wide all are named."""
    texts = prose(400, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    asked, counting = [], sparse_svd._counting
    monkeypatch.setattr(sparse_svd, "_counting", lambda least: asked.append(least) or counting(least))
    monkeypatch.setattr(sparse_svd, "LARGE_BYTES", 1)
    for words, most, wanted in ((2000, 40, [6]), (300, 40, [6, 1]), (300, 3000, [6, 1])):
        asked.clear()
        monkeypatch.setattr(sparse_svd, "BLOCK_WORDS", words)
        model = sparse_svd.text_vectors(df, "id", "text", 4, most)[1]
        assert model.terms == dense(texts, most)[1] and asked == wanted, (words, most, asked)

"""Whitening and nearest neighbours against plain NumPy."""

import math
from collections import defaultdict

import numpy as np
import pytest

from spanloom.llm import additive_quantisation, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, score double, key string, x string, uid string, part string"
REST = (1, 7, 0.5, "k", "x", "u", "p")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *REST) for i, v in rows], SCHEMA)


def vectors(n=400, d=24, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) @ np.diag(np.linspace(1, 0.2, d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def odd_rows(x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = x[0].tolist()
    rows += [(1000, None), (1001, [None, *bad[1:]]), (1002, [math.nan, *bad[1:]]), (1003, [math.inf, *bad[1:]]), (1004, []), (1005, bad[:5])]
    return rows + [rows[3], rows[3], (None, x[5].tolist())]


def expected_whitening(x):
    """By exact integers and numpy's eigh of the whole covariance."""
    c = np.floor(x.astype(np.float64) * 1024).astype(np.int64) + 100000
    n, s = len(c), c.sum(0)
    dev = [[n * int(v) - int(t) for v, t in zip(row, s, strict=True)] for row in c]
    mid = np.array([[v / n for v in row] for row in dev])
    cov = mid.T @ mid / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    return [sum(v * v for v in row) for row in dev], mid @ q / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(cov), n


def check_whitening(df, ids, x, components=8):
    dev, white, explained, n = expected_whitening(x)
    got = defaultdict(list)
    for r in df.collect():
        got[r["component"]].append((repr(r["vec_id"]), float(r["deviation"]), r["whitened"], r["n"], r["explained"], r["identity_error"]))
    assert sorted(got) == list(range(1, components + 1))
    for k, rows in got.items():
        assert len(rows) == len(ids) and {r[3] for r in rows} == {n} and len({r[5] for r in rows}) == 1
        assert abs(rows[0][4] / explained[k - 1] - 1) < 1e-9 and rows[0][5] < 1e-9
        wanted = sorted((repr(i), float(d), w) for i, d, w in zip(ids, dev, white[:, k - 1], strict=True))
        rows.sort(key=lambda r: r[:2])
        assert [r[:2] for r in rows] == [w[:2] for w in wanted]
        a, b = np.array([r[2] for r in rows]), np.array([w[2] for w in wanted])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9, k


def test_whitening_of_odd_rows(spark):
    x = vectors()
    rows = odd_rows(x)
    kept = [*range(400), 3, 3, None]
    check_whitening(whitening.whiten(frame(spark, rows).repartition(3)), kept, np.concatenate([x, x[[3, 3, 5]]]))


def test_whitening_of_few_equal_and_no_rows(spark):
    x = vectors(5, 6)
    two = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0]], np.float32)
    check_whitening(whitening.whiten(frame(spark, [(i, v.tolist()) for i, v in enumerate(two)])), range(3), two, 2)  # rank two
    for rows in ([], [(1, None)], [(1, x[0].tolist())], [(i, x[0].tolist()) for i in range(4)]):
        assert whitening.whiten(frame(spark, rows)).count() == 0


def test_deviations_beyond_64_bits():
    import decimal

    dev = np.array([[3 * 10**9, -(4 * 10**9)], [1, 2]])
    assert whitening.squares(dev).to_pylist() == [decimal.Decimal(25 * 10**18), decimal.Decimal(5)]


@pytest.mark.parametrize("most", [512, 40])
def test_lanczos_with_breakdown_restarts_and_equal_values(most):
    rng = np.random.default_rng(1)
    d = 150
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for values in (np.linspace(1, 0, d) ** 4, np.r_[np.full(6, 2.0), np.full(d - 6, 1.0)], np.r_[np.ones(4), np.zeros(d - 4)], np.r_[5, 4.999999, 3, np.linspace(1, 0.5, d - 3)]):
        a = q * values @ q.T
        a = (a + a.T) / 2
        e, v, passes = whitening.lanczos(lambda b, a=a: a @ b, d, 8, block=8, most=most)
        wanted = np.sort(values)[::-1][:8]
        assert np.abs(e - wanted).max() < 1e-12 * wanted[0] and np.abs(v.T @ v - np.eye(8)).max() < 1e-12
        assert np.linalg.norm(a @ v - v * e, axis=0).max() < 1e-11 * wanted[0]


def test_whitening_query_on_given_table(spark):
    import pyarrow.parquet as pq

    from spanloom.llm.queries import QUERIES

    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    x = np.array(t["embedding"].to_pylist(), np.float32)
    check_whitening(QUERIES["op11_block_lanczos"](spark, "/root/testdata/sf0.001"), t["vec_id"].to_pylist(), x)


def expected_neighbours(rows, k=20, every=20, inner=True):
    """Each query row's neighbours, by all pairs."""
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], np.float64)
    out = []
    for a, i in enumerate(ids):
        if i is not None and i % every == 0:
            score = (v * v[a]).sum(1) if inner else -((v - v[a]) ** 2).sum(1)
            best = sorted((-s, math.inf if j is None else j) for b, (s, j) in enumerate(zip(score, ids, strict=True)) if b != a)[:k]
            out.append((i, [(j, -s) for s, j in best]))
    return out


def lists(df):
    got = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], math.inf if r["vec_id"] is None else r["vec_id"], r["score"]))
    return got


def recall(got, wanted, k=20):
    hits = total = 0
    for i, best in wanted:
        assert [r for r, _, _ in got[i]] == list(range(1, len(best) + 1))
        exact = dict(best)
        for _, j, s in got[i]:
            assert j not in exact or abs(exact[j] - s) < 1e-12
            hits += s >= best[-1][1] - 1e-12
        total += len(best)
    return hits / total


@pytest.mark.parametrize("measure", ["inner", "euclidean"])
def test_neighbours_reach_recall(spark, measure):
    x = vectors(3000, 32, 4) * (1 if measure == "inner" else 3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = additive_quantisation.neighbours(frame(spark, rows), measure=measure, words=64, sample=1500, part_bytes=200_000)
    found = recall(lists(got), expected_neighbours(rows, inner=measure == "inner"))
    assert found > 0.95, found


def test_neighbours_of_odd_rows(spark):
    x = vectors(60, 24)
    rows = [r for r in odd_rows(x) if r[0] != 3] + [(2000, [0.0] * 24), (-20, x[7].tolist()), (41, x[40].tolist()), (42, x[40].tolist())]
    live = [r for r in rows if r[1] and len(r[1]) == 24 and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])]
    got = lists(additive_quantisation.neighbours(frame(spark, rows).repartition(3)))
    wanted = expected_neighbours(live)
    assert sorted(got) == sorted(i for i, _ in wanted) == [-20, 0, 20, 40]
    for i, best in wanted:
        assert [j for _, j, _ in got[i]] == [j for j, _ in best]  # few rows: all within the margin
        assert np.allclose([s for _, _, s in got[i]], [s for _, s in best], atol=1e-12)
    few = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (5, [0.5, 0.5])]
    rows = additive_quantisation.neighbours(frame(spark, few)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows) == [(20, 1, 20, 1.0), (20, 1, 20, 1.0), (20, 2, 5, 0.5), (20, 2, 5, 0.5)]
    for none in ([], [(20, None)], [(20, [0.0, 0.0])], [(20, [1.0, 2.0])]):
        assert additive_quantisation.neighbours(frame(spark, none)).count() == 0


def test_many_equal_vectors_tie_by_id(spark):
    x = vectors(200, 16)
    rows = [(i, (x[0] if i % 3 == 0 else x[i]).tolist()) for i in range(200)]
    got = lists(additive_quantisation.neighbours(frame(spark, rows), part_bytes=2000))
    for i, best in expected_neighbours(rows):
        if i % 3 == 0:
            assert [j for _, j, _ in got[i]] == [j for j, _ in best]


def test_encoding_leaves_what_it_says():
    x = vectors(500, 24)
    books = additive_quantisation.fit(x, 6, 32)
    codes, left = additive_quantisation.encode(books, x, 4)
    assert np.allclose(sum(books[m][codes[:, m]] for m in range(6)) + left, x, atol=1e-5)
    greedy = additive_quantisation.encode(books, x, 1)[1]
    assert (left**2).sum() < (greedy**2).sum()


def test_neighbour_query_on_given_table(spark):
    import pyarrow.parquet as pq

    from spanloom.llm.queries import QUERIES

    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True))
    found = recall(lists(QUERIES["op12_additive_quantisation"](spark, "/root/testdata/sf0.01")), expected_neighbours(rows))
    assert found >= 0.97, found

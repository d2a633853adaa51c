"""Cross-fold groups, order statistics and splits against plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import evaluation, graph, order, stability


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(g, float(v), rng.randrange(9)) for g in ("a", "b", None) for v in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(3)
    for by, down in ((["g"], False), (["g"], True)):
        got = {(r["g"], r["v"]): r["s"] for r in order.running(df, by, "v", {"s": "n"}, down, rows=50).collect()}
        for g, v, _ in rows:
            assert got[g, v] == sum(n for h, w, n in rows if h == g and (w >= v if down else w <= v))
    one = df.filter("g = 'a'")
    got = {r["v"]: r["s"] for r in order.running(one, [], "v", {"s": "n"}, rows=40).collect()}
    mine = [(v, n) for g, v, n in rows if g == "a"]
    assert got == {v: sum(n for w, n in mine if w <= v) for v, _ in mine}


@pytest.mark.parametrize("rows", [20, 1000])
def test_exact_quantiles(spark, rows):
    rng = random.Random(2)
    data = [(g, rng.choice([None, float("nan"), rng.random(), 3.0]), rng.randrange(40)) for g in ("a", "b", None) for _ in range(200)] + [("none", None, 1)]
    df = spark.createDataFrame(data, "g string, x double, n int")
    got = order.quantiles(df, ["g"], ["x", "n"], {"median": 0.5, "p10": 0.1}, rows=rows).collect()
    assert len(got) == 4
    for r in got:
        x = [v for g, v, _ in data if g == r["g"] and v is not None and v == v]
        n = [v for g, _, v in data if g == r["g"]]
        wanted = [np.quantile(v, q) if v else None for v in (x, n) for q in (0.5, 0.1)]
        assert [r[c] for c in ("median_x", "p10_x", "median_n", "p10_n")] == pytest.approx(wanted)
    whole = order.quantiles(df, [], ["n"], {"median": 0.5}, rows=rows).collect()
    assert [r["median_n"] for r in whole] == [np.median([v for _, _, v in data])]


def test_metrics_of_all_rows_over_ranges(spark, monkeypatch):
    rng = random.Random(3)
    data = [(rng.randrange(2), round(rng.random(), 2)) for _ in range(500)]
    df = spark.createDataFrame(data, "y int, score double")
    plain = evaluation.metrics(df, []).collect()
    monkeypatch.setattr(order.running, "__defaults__", (False, 10))
    assert evaluation.metrics(df, []).collect()[0].asDict() == pytest.approx(plain[0].asDict())
    pos, neg = ([s for y, s in data if y == k] for k in (1, 0))
    area = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    steps = sorted({s for _, s in data}, reverse=True)
    ap = sum(sum(p == s for p in pos) * sum(p >= s for p in pos) / sum(v >= s for _, v in data) for s in steps) / len(pos)
    assert plain[0]["auroc"] == pytest.approx(area) and plain[0]["average_precision"] == pytest.approx(ap)


def test_fill_order_deals_like_the_greedy_rule():
    rng = random.Random(4)
    for _ in range(200):
        k = rng.randrange(1, 7)
        sizes = sorted({rng.randrange(1, rng.choice([6, 60])) for _ in range(rng.randrange(1, 9))}, reverse=True)
        histogram = [(s, rng.randrange(1, 40)) for s in sizes]
        load, wanted = [0] * k, []
        for s, n in histogram:
            for r in range(n):
                f = min(range(k), key=lambda f: (load[f], f))  # noqa: B023
                load[f] += s
                wanted.append((s, r, f))
        got = [(s, r, folds[(r - a) % len(folds)]) for s, a, b, folds in evaluation.fill_order(histogram, k) for r in range(a, b)]
        assert got == wanted


def test_folds_of_groups(spark):
    rng = random.Random(5)
    rows = [("g%03d" % i,) for i in range(60) for _ in range(rng.choice([1, 1, 2, 2, 5, 30]))] + [(None,)] * 4
    got = {r["g"]: (r["n_rows"], r["fold"]) for r in evaluation.balanced_folds(spark.createDataFrame(rows, "g string"), "g", 4).collect()}
    size = Counter(g for (g,) in rows if g is not None)
    load, wanted = [0] * 4, {}
    for g in sorted(size, key=lambda g: (-size[g], g)):
        f = load.index(min(load))
        load[f] += size[g]
        wanted[g] = (size[g], f + 1)
    assert got == wanted
    few = evaluation.balanced_folds(spark.createDataFrame([("x",), ("y",)], "g string"), "g", 5).collect()
    assert sorted(r["fold"] for r in few) == [1, 2]
    assert evaluation.balanced_folds(spark.createDataFrame([], "g string"), "g", 5).count() == 0


def test_stratified_quotas(spark):
    rows = [(i, "abc"[min(i % 7, 2)] if i % 11 else None) for i in range(203)]
    got = evaluation.stratified(spark.createDataFrame(rows, "k long, y string").repartition(4), "k", "y", 0.2).collect()
    count, test = Counter(y for _, y in rows if y), Counter(r["y"] for r in got if r["test"])
    n = sum(count.values())
    assert len(got) == n and sum(test.values()) == -(-n // 5)
    assert all(abs(test[y] - n // 5 * c / n) < 1.5 for y, c in count.items())
    again = evaluation.stratified(spark.createDataFrame(rows[::-1], "k long, y string").repartition(2), "k", "y", 0.2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert evaluation.stratified(spark.createDataFrame([], "k long, y string"), "k", "y").count() == 0


def test_splits_that_models_can_be_trained_on(spark):
    rows = [(i, i % 2, "llm %d" % (i % 3), "m1" if i % 2 else "m0", "s%d" % (i % 5)) for i in range(60)] + [(60, 1, None, None, None)]
    df = spark.createDataFrame(rows, "id long, y int, llm string, model string, sentence string")
    members, schemes = evaluation.experiment_splits(df, "id", "y", "sentence", {"leave_llm": "llm", "leave_info_model": "model"}, n_folds=3)
    frames = evaluation.split_frames(members, "y", schemes)
    assert sorted(frames) == ["leave_group_fold_1", "leave_group_fold_2", "leave_group_fold_3", "leave_llm_llm_0", "leave_llm_llm_1", "leave_llm_llm_2", "random_1"]  # each model has one class
    for name, (train, test) in frames.items():
        a, b = ({r["id"] for r in x.collect()} for x in (train, test))
        assert a | b == set(range(61)) and not a & b, name
        if name.startswith("leave_group"):
            assert not {r[4] for r in rows if r[0] in a} & {r[4] for r in rows if r[0] in b}
    many = spark.createDataFrame([(i, i % 2, str(i // 2)) for i in range(2 * evaluation.MOST_SPLITS + 4)], "id long, y int, g string")
    with pytest.raises(ValueError, match="splits"):
        evaluation.split_frames(many, "y", {"leave": F.col("g")})


def plain_groups(rows, threshold, least):
    """Union-find over all pairs, as the rule is stated."""
    parent = {f"{f}::{c}": f"{f}::{c}" for f, c, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            s, t = set(a[2]), set(b[2])
            if a[0] != b[0] and min(a[3], b[3]) >= least and s and t and len(s & t) / len(s | t) >= threshold:
                x, y = find(f"{a[0]}::{a[1]}"), find(f"{b[0]}::{b[1]}")
                parent[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for r in rows:
        members[find(f"{r[0]}::{r[1]}")].append(r)
    return members


@pytest.mark.parametrize("threshold", [0.45, 0.6, 1.0])
def test_stability_groups(spark, threshold):
    rng = random.Random(6)
    kinds = [rng.sample("abcdefghijkl", 5) for _ in range(6)]
    rows = []
    for i in range(120):
        terms = list(rng.choice(kinds))
        if rng.random() < 0.5:
            terms[rng.randrange(5)] = rng.choice("mnopq")
        rows.append(("fold_%d" % rng.randrange(4), "c%03d" % i, [] if i % 17 == 0 else terms, rng.choice([3, 25, 60]), rng.randrange(4)))
    rows += [("fold_0", "same%d" % i, ["u", "v"], 50, 2) for i in range(5)]  # one fold: they stay apart
    df = spark.createDataFrame(rows, "fold string, candidate_field_id string, terms array<string>, n_positive_mentions long, n_source_models int").repartition(3)
    long, summary = stability.stability(df, threshold=threshold)
    wanted = plain_groups(rows, threshold, 20)
    order_ = sorted(wanted, key=lambda g: (-len({r[0] for r in wanted[g]}), -sum(r[3] for r in wanted[g]), g))
    expected = {}
    for i, g in enumerate(order_, 1):
        m = wanted[g]
        folds, total, models = len({r[0] for r in m}), sum(r[3] for r in m), max(r[4] for r in m)
        tier = "core_candidate" if folds >= 3 and total >= 80 and models >= 2 else "extension_candidate" if folds >= 2 and total >= 40 and models >= 2 else "audit_only"
        often = Counter(t for r in m for t in set(r[2]))
        top = sorted(often, key=lambda t: (-often[t], t))[:12]
        for r in m:
            expected[r[0], r[1]] = ("SG%03d" % i, tier, folds, total, models, top)
    got = {(r["fold"], r["candidate_field_id"]): (r["stability_group_id"], r["selection_tier"], r["stability_n_folds"], r["stability_total_support"], r["stability_max_models"], r["stability_top_terms"]) for r in long.collect()}
    assert got == expected
    assert {r["stability_group_id"]: r["n_fields"] for r in summary.collect()} == Counter(v[0] for v in expected.values())
    kept = {(r["fold"], r["candidate_field_id"]) for r in stability.selected(long).collect()}
    assert kept == {k for k, v in expected.items() if v[1] != "audit_only" and next(r[3] for r in rows if (r[0], r[1]) == k) >= 20}


def test_similar_sets_find_every_pair(spark):
    rng = random.Random(7)
    rows = [(i, rng.sample(range(30), rng.randrange(0, 12)), i % 3) for i in range(150)]
    df = spark.createDataFrame([(i, [str(t) for t in ts], k) for i, ts, k in rows], "id long, ts array<string>, k int")
    for threshold in (0.2, 0.55, 0.8, 1.0):
        pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and b[1] and len(set(a[1]) & set(b[1])) / len(set(a[1]) | set(b[1])) >= threshold}
        assert {(r["a"], r["b"]) for r in graph.similar_sets(df, "id", "ts", threshold).collect()} == pairs
        got = graph.similar_sets(df, "id", "ts", threshold, carry=["k"], meets=F.col("k_a") != F.col("k_b"))
        assert {(r["a"], r["b"]) for r in got.collect()} == {(a, b) for a, b in pairs if a % 3 != b % 3}

"""Near copies against brute force: similarity of all pairs of texts, components of the links."""

import random

import pytest

from spanloom.llm import near_copies

SCHEMA = "doc_id long, text string, source string, tid string, keys string"


def varied(rng, words, text, changes):
    out = text.split()
    for _ in range(changes):
        out[rng.randrange(len(out))] = rng.choice(words)
    return " ".join(out)


def rows():
    rng = random.Random(9)
    words = ["v%d" % i for i in range(900)]
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for n in (40, 120, 300, 2500):
        base = " ".join(rng.choice(words) for _ in range(n))
        texts += [base, base.upper(), base + " tail", *(varied(rng, words, base, c) for c in (1, max(1, n // 60), n // 12, n // 3))]
    out = [(i * 3, t, "s", "x", None) for i, t in enumerate(texts)]
    return [*out, out[8], (None, texts[8], None, None, None)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def components(data):
    data = [r for r in data if r[0] is not None]
    sets = [shingles(r[1]) for r in data]
    label = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return {r[0]: min(q[0] for q, y in zip(data, label) if y == x) for r, x in zip(data, label)}


@pytest.mark.parametrize("group", [near_copies.GROUP, 2])
def test_near_copies(spark, group):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, group=group).collect()}
    expected = components(data)
    assert len(set(expected.values())) > 6 and got == expected


def test_keep_one(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    left = near_copies.keep_one(docs)
    assert left.columns == docs.columns
    stays = components(data)
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted(r[0] for r in data if r[0] is not None and stays[r[0]] == r[0])
    assert left.filter("doc_id is null").count() == 1
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def family(n, low, high):
    """Copies of one text with so many words replaced: similarities lie on both sides of 0.8."""
    rng = random.Random(4)
    words = ["v%d" % i for i in range(5000)]
    base = " ".join(rng.choice(words) for _ in range(300))
    return [(i, varied(rng, words, base, rng.randint(low, high)), "s", "x", None) for i in range(n)]


def test_family_is_joined_by_all_its_pairs(spark):
    data = family(200, 3, 6)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()}
    assert got == components(data)


def test_large_keys_lose_no_pair(spark):
    data = family(200, 3, 6)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(data, SCHEMA).repartition(4), group=30).collect()}
    assert got == components(data)


def test_mask_groups_link_copies_without_a_common_key(spark, monkeypatch):
    none = lambda *a, **k: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_copies, "candidates", none)
    monkeypatch.setattr(near_copies, "remaining", none)
    rng = random.Random(3)
    base = " ".join("v%d" % rng.randrange(900) for _ in range(3000))
    data = [(1, base, "s", "x", None), (2, base + " tail", "s", "x", None), (3, "another text of its own words", "s", "x", None)]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == components(data) == {1: 1, 2: 1, 3: 3}

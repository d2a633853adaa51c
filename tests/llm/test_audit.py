"""The filter audit against plain Python and its SQL."""

import random
import re
from itertools import permutations

import pytest

from spanloom.llm import filter_audit
from spanloom.llm.queries import ORACLE_SQL, QUERIES
from tests.parity import compare, connection

DOCS = "doc_id long, text string, lang string, quality int, part string, flags int, digest string, copy int, bits long, n_chars long"
LABELS = "doc_id long, quality int, toxic int, part string, marks int"


def rows():
    rng = random.Random(2)
    words = ["w%d" % i for i in range(300)]
    prose = lambda n, k=300: " ".join(rng.choice(words[:k]) for _ in range(n))
    texts = [prose(250), prose(250, 20), prose(20), "ABC " + prose(199), "a # b", None, "", "é" * 40 + "AB", prose(200), prose(220) + " 50%", "UP" * 200_000 + prose(400), "x " * 300_000]
    texts += [texts[0]] * 5 + [texts[3]] * 3 + ["", None]
    out = [(i if i % 7 else 90 - i, t, (None, "en", "fr", "")[rng.randrange(4)], 1, "p", 3, "d", 0, 9, 5) for i, t in enumerate(texts)]
    return out + [out[2], out[12], (None, texts[0], "en", *out[0][3:]), (None, texts[0], "en", *out[0][3:]), (None, "alone", None, *out[0][3:])]


LABEL_ROWS = [(i, i % 2, (i % 3 == 0) * 1, "q", 1) for i in range(0, 20, 2)] + [(2, None, 1, "q", 1), (4, 1, None, "q", 1), (4, 0, 0, "q", 1), (None, 1, 1, "q", 1), (9999, 1, 1, "q", 1), (13, None, None, "q", 1)]


def expected(docs, labels):
    facts = []
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        mark = lambda at, i=i: i is not None and any(r[0] == i and r[at] == 1 for r in labels)
        facts.append((lang or "", {f for f, bad in fails.items() if bad}, mark(1), mark(2)))
    out = {}
    for part in {f[0] for f in facts}:
        mine = [f[1:] for f in facts if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone, alive = [x for x in alive if f in x[0]], [x for x in alive if f not in x[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def found(df):
    got = {}
    for r in df.collect():
        assert (r["part"], r["filter_order"], r["step"]) not in got
        got[r["part"], r["filter_order"], r["step"]] = [r[c] for c in (*filter_audit.COUNTS, "shapley")]
    return got


def test_every_order(spark):
    docs = spark.createDataFrame(rows(), DOCS).repartition(4)
    labels = spark.createDataFrame(LABEL_ROWS, LABELS)
    assert found(filter_audit.audit(docs, labels)) == expected(rows(), LABEL_ROWS)


def test_without_labels_or_documents(spark):
    docs, labels = spark.createDataFrame(rows(), DOCS), spark.createDataFrame(LABEL_ROWS, LABELS)
    assert found(filter_audit.audit(docs, labels.limit(0))) == expected(rows(), [])
    assert filter_audit.audit(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables_beside_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    compare(spark, connection(path), path, QUERIES["op13_bitmap_audit"], ORACLE_SQL["op13_bitmap_audit"])

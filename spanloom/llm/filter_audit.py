"""Filter interaction audit: what each filter removes in every order of five filters.

A pass over the texts judges four filters by themselves and takes a digest of the text; the fifth
(a copy of an earlier document) is settled by the least doc_id of each digest. Then every task packs
its rows into bitsets, one for each filter, label and part. For each set of filters that may stand
before a step, the survivors are the part's bits AND-NOT the failures of that set, and popcounts of
these with a filter's failures and the labels are that step's counts. Counts add up over tasks; an order's
steps are looked up by the set before them, so 120 orders need 80 counts a part.

Joins are on doc_id, or on (digest, doc_id), so a text that a third of the rows share is no hot
key; rows without a doc_id pass the joins by.

Defined cases: null text is empty; null lang is the part ''; a null doc_id is no smaller id
of any and has no smaller one, and no labels; rows that repeat a doc_id are documents of their own, and the text of
the smallest doc_id is no copy in any of them; of repeated labels one that is 1 counts; parts exist
as far as documents do: an empty table gives no rows; other columns are ignored. Texts are the
same if their 128-bit digests are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm._words import Words, distinct, mix, texts_of, trimmed
from spanloom.session import discard, stored

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FEWEST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
_GOOD, _TOXIC = len(FILTERS), len(FILTERS) + 1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_BATCH = 1 << 16


def failures(w: Words) -> np.ndarray:
    """Bits 0 to 3 of the filters A to D that each text fails."""

    def inside(mask):
        total = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[w.bounds[1:]] - total[w.bounds[:-1]]

    doc = w.doc
    first = distinct(mix(w.hashes() + mix(doc.astype(np.uint64) + np.uint64(1))))[1]
    different = np.bincount(doc[first], minlength=len(w.count))
    points = inside((w.data & 0xC0) != 0x80)
    failed = (w.count < FEWEST_WORDS, 100 * different < LEAST_DISTINCT * w.count, 100 * inside(_UPPER[w.data]) > MOST_UPPER * points, inside(_SYMBOL[w.data]) > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and the failures of A to D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in texts_of(batch):
                raw, at = data.tobytes(), bounds.tolist()
                digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(digests, pa.binary()), pa.array(failures(Words(data, bounds)), pa.int32())], ["doc_id", "part", "digest", "flags"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(trimmed(run), "doc_id long, part string, digest binary, flags int")


def flagged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part and all bits: failures of A to E, then the labels."""
    named, nameless = rows.filter("doc_id IS NOT NULL"), rows.filter("doc_id IS NULL")
    least = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(0).alias("copy"))
    one = lambda c, bit: F.max((F.col(c) == 1).cast("int")) * (1 << bit)
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.coalesce(one("quality", _GOOD), F.lit(0)) + F.coalesce(one("toxic", _TOXIC), F.lit(0))).alias("marks"))
    bits = F.col("flags") + F.coalesce("copy", F.lit(1 << FILTERS.index("E"))) + F.coalesce("marks", F.lit(0))
    known = named.join(least, ["doc_id", "digest"], "left").join(marks, "doc_id", "left").select("part", bits.alias("bits"))
    return known.union(nameless.select("part", F.col("flags").alias("bits")))


def _count(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def steps(part: np.ndarray, fails: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each set of filters before and each filter not in it: the counts, from packed bits."""
    k = len(fails)
    alive = [part]
    for before in range(1, 1 << k):
        low = (before & -before).bit_length() - 1
        alive.append(alive[before & (before - 1)] & ~fails[low])
    out = np.zeros((1 << k, k, len(COUNTS)), np.int64)
    for f in range(k):
        failing = part & fails[f]
        alone = _count(alive[(1 << k) - 1 - (1 << f)] & fails[f])
        for before in range(1 << k):
            if not before >> f & 1:
                gone = alive[before] & fails[f]
                out[before, f] = _count(alive[before | 1 << f]), _count(gone), _count(failing & ~alive[before]), alone, _count(gone & good), _count(gone & toxic)
    return out


def packed(mask: np.ndarray) -> np.ndarray:
    """A bitset in 64-bit words."""
    return np.packbits(np.pad(mask, (0, -len(mask) % 64))).view(np.uint64)


def counted(rows: DataFrame) -> DataFrame:
    """part, before (set of filters as bits), filter and counts, added up over all tasks."""
    k = len(FILTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH):
                some = batch.slice(lo, _BATCH)
                bits = some.column(1).to_numpy()
                fails = [packed(bits >> i & 1 == 1) for i in range(k)]
                good, toxic = (packed(bits >> i & 1 == 1) for i in (_GOOD, _TOXIC))
                names = some.column(0).dictionary_encode()
                which = names.indices.to_numpy()
                for i, name in enumerate(names.dictionary.to_pylist()):
                    found = steps(packed(which == i), fails, good, toxic)
                    total[name] = total[name] + found if name in total else found
        cells = [(b, f) for b in range(1 << k) for f in range(k) if not b >> f & 1]
        before, f = (np.array(x, np.int32) for x in zip(*cells, strict=True))
        for name, found in total.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([name] * len(cells)), "before": before, "filter": f} | {c: found[before, f, i] for i, c in enumerate(COUNTS)})

    found = rows.select("part", "bits").mapInArrow(trimmed(run), "part string, before int, filter int, " + ", ".join(f"{c} long" for c in COUNTS))
    return found.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in COUNTS))


def orders(spark) -> DataFrame:
    """filter_order, step, and the filter and the set before it; 600 rows."""
    rows = [("".join(FILTERS[f] for f in order), i + 1, f, sum(1 << g for g in order[:i])) for order in permutations(range(len(FILTERS))) for i, f in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, the counts and shapley for every part, order and step."""
    rows = stored(judged(docs), "audit-rows")
    counts = counted(flagged(rows, labels))
    k = len(FILTERS)
    # How many orders have a set of so many filters before a given one.
    weight = F.element_at(F.array(*(F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k))), F.bit_count("before") + 1)
    shapley = F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "filter"))
    done = counts.withColumn("shapley", shapley).join(F.broadcast(orders(docs.sparkSession)), ["before", "filter"])
    done = stored(done.select("part", "filter_order", "step", *COUNTS, "shapley"), "audit")
    discard(rows)
    return done


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
  (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > least, false)::INT AS bits FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, bits, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT i, substr('ABCDE', i + 1, 1) AS name, 1 << i AS bit FROM range(5) r(i)),
o AS (SELECT [a.bit, b.bit, p.bit, q.bit, e.bit] AS bits, a.name || b.name || p.name || q.name || e.name AS filter_order FROM x a, x b, x p, x q, x e WHERE a.bit + b.bit + p.bit + q.bit + e.bit = 31 AND a.bit | b.bit | p.bit | q.bit | e.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS f, list_sum(bits[1:step]) - bits[step] AS before FROM o, range(1, 6) g(step)),
r AS (SELECT part, filter_order, step, f,
  sum(n) FILTER (c.bits & (before | f) = 0) AS kept, sum(n) FILTER (c.bits & before = 0 AND c.bits & f <> 0) AS removed, sum(n) FILTER (c.bits & before <> 0 AND c.bits & f <> 0) AS redundant,
  sum(n) FILTER (c.bits = f) AS unique_fails, sum(n) FILTER (c.bits & before = 0 AND c.bits & f <> 0 AND good = 1) AS good_lost, sum(n) FILTER (c.bits & before = 0 AND c.bits & f <> 0 AND toxic = 1) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM r
"""

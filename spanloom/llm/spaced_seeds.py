"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

Fixed masks over ``SPAN`` tokens ignore some positions, so a substituted token at an ignored
place leaves the seed as it was. Seeds of documents meet seeds of the benchmark by hash; each
hit is verified on its diagonal: tokens around the hit are compared place by place, and enough
of them must be equal. Hash collisions therefore never decide. Items of ``SHORT`` tokens or more
but under ``MIN_ALIGNED`` are too short for that: their first ``SHORT`` tokens are their seed, and
the whole item must occur as it is.

A document's tokens stay one array beside the rows of its seeds, and are cut only where a seed
hits; nothing of a document is shuffled but its hits. The benchmark's seeds are broadcast as
(seed, item, place); there are up to ``BROADCAST_SEEDS`` of them, counted first. A larger
benchmark is dealt into so many parts by seed, and documents are read once for each.

Defined cases: null and empty texts and items have no tokens and never match; nor do items under
``SHORT`` tokens; repeated rows match each; several items that match give a row each; an empty
table gives no rows; other columns are ignored by :func:`overlaps` and kept by :func:`keep_clean`,
whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places that each mask compares, of SPAN tokens.
MASKS = ((0, 1, 3, 4, 6, 8, 10, 11), (0, 2, 3, 5, 7, 8, 9, 11), (0, 1, 2, 5, 6, 9, 10, 11))
SPAN, SHORT = 12, 5
#: Tokens compared on each side of a hit, the least number compared, and the least equal share.
MARGIN, MIN_ALIGNED, MIN_EQUAL = 6, 13, 0.75
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda t: F.xxhash64(t))


def _seed(number: int, places) -> Column:
    return F.xxhash64(F.lit(number), *(F.get("h", F.col("place") + o) for o in places))


def seeds(rows: DataFrame, spaced: bool, short: bool) -> DataFrame:
    """rows with h to one row per place and mask, place and seed added."""
    if not (spaced or short):
        return rows.limit(0).select("*", F.lit(0).alias("place"), F.lit(0).cast("long").alias("seed"))
    least = SHORT if short else SPAN
    placed = rows.filter(F.size("h") >= least).select("*", F.explode(F.sequence(F.lit(0), F.size("h") - least)).alias("place"))
    chosen = []
    if spaced:
        inside = F.col("place") <= F.size("h") - SPAN
        chosen += [F.when(inside, _seed(m, mask)) if short else _seed(m, mask) for m, mask in enumerate(MASKS)]
    if short:
        chosen.append(_seed(len(MASKS), range(SHORT)))
    return placed.select("*", F.explode(F.array(*chosen)).alias("seed"))


def _parts(items: DataFrame) -> list[DataFrame]:
    """The benchmark's seeds in parts of a size that may be broadcast."""
    long = items.filter(F.size("h") >= MIN_ALIGNED)
    short = items.filter((F.size("h") >= SHORT) & (F.size("h") < MIN_ALIGNED))
    asked = seeds(long, True, False).unionByName(seeds(short, False, True).filter("place = 0")).select("seed", F.col("item_key"), F.col("place").alias("item_place"))
    parts = max(1, -(-asked.count() // BROADCAST_SEEDS))
    part = F.pmod(F.xxhash64("seed", F.lit("part")), F.lit(parts))
    return [F.broadcast(asked.filter(part == i) if parts > 1 else asked) for i in range(parts)]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_hits, best_equal, best_aligned for each document and item that overlap."""
    items = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item_key"), _hashed(tokens(F.col("text"))).alias("h")).filter(F.size("h") >= SHORT)
    short = not items.filter(F.size("h") < MIN_ALIGNED).isEmpty()
    texts = docs.select("doc_id", _hashed(tokens(F.col("text"))).alias("h"))
    # the seeds are the same for equal rows of the benchmark: the item's tokens and its repeats follow the hits
    known = items.groupBy("item_key").agg(F.first("item_id").alias("item_id"), F.first("h").alias("item"), F.count("*").alias("repeats"))
    keys = items.dropDuplicates(["item_key"])
    met = reduce(DataFrame.unionByName, [seeds(texts, True, short).join(part, "seed").select("doc_id", "item_key", *_around()) for part in _parts(keys)])
    met = met.join(known, "item_key")
    # the aligned stretch: from back tokens before the hit to ahead tokens after its start
    back = F.least(F.col("lead"), F.col("item_place"))
    ahead = F.least(F.size("x") - F.col("lead"), F.size("item") - F.col("item_place"), F.lit(SPAN + MARGIN))
    cut = met.select("doc_id", "item_id", "repeats", F.size("item").alias("n"), F.slice("x", F.col("lead") - back + 1, back + ahead).alias("x"), F.slice("item", F.col("item_place") - back + 1, back + ahead).alias("y"))
    equal = F.aggregate(F.zip_with("x", "y", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, e: n + e)
    judged = cut.select("doc_id", "item_id", "repeats", "n", equal.alias("equal"), F.size("x").alias("aligned"))
    enough = (F.col("aligned") >= MIN_ALIGNED) & (F.col("equal") >= MIN_EQUAL * F.col("aligned"))
    whole = (F.col("n") < MIN_ALIGNED) & (F.col("equal") == F.col("n"))
    return judged.filter(F.when(F.col("n") < MIN_ALIGNED, whole).otherwise(enough)).groupBy("doc_id", "item_id").agg(F.sum("repeats").alias("n_hits"), F.max("equal").alias("best_equal"), F.max("aligned").alias("best_aligned"))


def _around() -> list[Column]:
    """Of a hit: the document's tokens that may be compared, how many of them lie before the hit,
    and the place in the item."""
    lead = F.least(F.lit(MARGIN), F.col("place"))
    return [F.slice("h", F.col("place") - lead + 1, lead + SPAN + MARGIN).alias("x"), lead.alias("lead"), F.col("item_place")]


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item, all columns."""
    name = f"bad_{uuid.uuid4().hex}"
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(name).eqNullSafe(docs["doc_id"]), "left_anti")


def oracle() -> str:
    """The same result in DuckDB SQL; seeds are compared as tokens rather than by hash."""
    seed = lambda mask: "concat_ws(' ', " + ", ".join(f"h[place + {o + 1}]" for o in mask) + ")"
    union = lambda source, keys: " UNION ALL ".join(f"SELECT {keys}, h, place, {m} AS mask, {seed(mask)} AS seed FROM {source}" for m, mask in enumerate(MASKS))
    words = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
    return f"""
WITH i AS (SELECT item_id, h FROM (SELECT item_id, {words} AS h FROM benchmark) WHERE len(h) >= {MIN_ALIGNED}),
ip AS (SELECT item_id, h, unnest(range(0, len(h) - {SPAN - 1})) AS place FROM i),
s AS ({union("ip", "item_id")}),
d AS (SELECT doc_id, {words} AS h FROM documents),
dp AS (SELECT doc_id, h, unnest(range(0, len(h) - {SPAN - 1})) AS place FROM d WHERE len(h) >= {SPAN}),
t AS ({union("dp", "doc_id")}),
met AS (
  SELECT t.doc_id, s.item_id, t.h AS x, s.h AS y, t.place AS p, s.place AS q,
    least({MARGIN}, t.place, s.place) AS back, least({SPAN + MARGIN}, len(t.h) - t.place, len(s.h) - s.place) AS ahead
  FROM t JOIN s ON t.mask = s.mask AND t.seed = s.seed),
judged AS (
  SELECT doc_id, item_id, back + ahead AS aligned,
    len(list_filter(range(0, back + ahead), lambda k: x[p - back + 1 + k] = y[q - back + 1 + k])) AS equal FROM met),
short AS (
  SELECT item_id, h FROM (SELECT item_id, {words} AS h FROM benchmark) WHERE len(h) >= {SHORT} AND len(h) < {MIN_ALIGNED}),
whole AS (
  SELECT doc_id, item_id, len(short.h) AS aligned FROM (
    SELECT doc_id, h, unnest(range(0, len(h) - {SHORT - 1})) AS place FROM d WHERE len(h) >= {SHORT}) dq
  JOIN short ON list_slice(dq.h, place + 1, place + {SHORT}) = list_slice(short.h, 1, {SHORT})
  WHERE list_slice(dq.h, place + 1, place + len(short.h)) = short.h),
hits AS (
  SELECT doc_id, item_id, equal, aligned FROM judged WHERE aligned >= {MIN_ALIGNED} AND equal >= {MIN_EQUAL} * aligned
  UNION ALL SELECT doc_id, item_id, aligned, aligned FROM whole)
SELECT doc_id, item_id, count(*) AS n_hits, CAST(max(equal) AS INTEGER) AS best_equal, CAST(max(aligned) AS INTEGER) AS best_aligned
FROM hits GROUP BY doc_id, item_id"""

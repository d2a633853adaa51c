"""Near copies by shingle similarity: SimHash fingerprints, pivot distance tables, exact check.

Texts whose sets of ``shingle`` words have a Jaccard similarity of at least ``similarity`` are
linked. Texts whose fingerprints differ in at most ``RADIUS`` bits are found as in
:mod:`simhash_pivots`, by mask groups, pivot tables and Hamming distance (:func:`by_masks`). At 0.8
fingerprints differ in about ten bits of 64 and in up to ``WIDE``, which is too many for keys made
of fingerprint bits, so further candidates share one of ``BANDS`` keys, each of ``ROWS`` min-hashes. A pair of similarity s has none in common with probability
(1 - s**ROWS)**BANDS, 4e-5 at 0.8.

In a key's group the fingerprints' distances to the pivots are computed; a pair is discarded once
some coordinate differs by more than ``WIDE``. Survivors get their own Hamming distance, and are
discarded too if more than ``LOST`` of 48 min-hashes (four bits of each are kept) differ. By the
sum of both the group hands on its minimum spanning forest: fewer links than texts, not all pairs.
Each link is then checked against the exact similarity of the two sets of shingles. Distance only
follows similarity roughly, so a forest can leave similar texts apart: where a key's texts lie in
different components after that, every pair of different components that is not discarded is
checked by its exact sets within the key (:func:`remaining`), unless links have joined it by then.

A key with more than ``GROUP`` different texts is dealt over finer keys, with one more min-hash
each, twice if need be, and in what is still too large each text is checked against the least of
them. That only saves work: what it leaves apart is checked like the rest, in blocks of the first
key's texts, block against block (:func:`_tasks`).

Defined cases: texts of under ``shingle`` words have their whole sequence as the only shingle, so
only copies of them are linked; null and empty texts are copies of each other; rows without a
doc_id are never linked; repeated rows have one component; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm._exchange import text_bytes
from spanloom.llm._words import Words, buffers, mix, slices, window_hash, trimmed
from spanloom.llm.simhash_pivots import _PIVOTS, RADIUS, fingerprint
from spanloom.llm.simhash_pivots import links as fingerprint_links
from spanloom.operators.components import connected_components
from spanloom.session import discard, parts_of, stored

SHINGLE, SIMILARITY, WIDE, LOST, GROUP = 5, 0.8, 24, 19, 2000
BANDS, ROWS, FINER, LEVELS = 14, 3, 4, 2
_MINS = BANDS * ROWS + FINER * LEVELS
#: Min-hashes of which four bits are kept, 16 in a long.
_BRIEF = 48
#: Bytes of text read by a task, and rows in a written part.
READ, PART = 16 << 20, 500_000
MARKS = ("tid", "fp", "brief0", "brief1", "brief2")
_SALT = np.random.default_rng(5).integers(0, 2**63, _MINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles and where each text's begin; every text has one at least."""
    w = Words(data, bounds, lower=True)
    hashes, first = w.hashes(), w.first
    windows = window_hash(hashes, shingle)
    count = np.maximum(w.count - shingle + 1, 1)
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(begin[-1], np.uint64)
    whole = w.count >= shingle
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    long = np.repeat(whole, count)
    out[long] = windows[at[long]]
    for i in np.flatnonzero(~whole):
        part = hashes[first[i] : first[i + 1]]
        out[begin[i]] = window_hash(part, len(part))[0] if len(part) else 0
    return out, begin


def _minima(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of min-hashes for each text."""
    out = np.empty((len(begin) - 1, _MINS), np.uint64)
    for k, salt in enumerate(_SALT):
        x = (hashes ^ salt) * salt
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = np.minimum.reduceat(x, begin[:-1])
    return out


def _brief(mins: np.ndarray) -> np.ndarray:
    """Four bits of each of the first min-hashes, 16 in a long."""
    part = (mins[:, :_BRIEF] & np.uint64(15)).reshape(len(mins), -1, 16)
    return np.bitwise_or.reduce(part << (np.uint64(4) * np.arange(16, dtype=np.uint64)), axis=2)


def _lost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the four-bit values differ."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int16)


def _text_id(text: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 11)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tid (hash of the words), fp, brief, keys (one for each band), finer (min-hashes)."""

    def longs(x: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in slices(*buffers(batch.column(1))):
                raw, ends = data.data, bounds.tolist()
                texts = [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]
                mins = _minima(*shingle_sets(data, bounds, shingle))
                keys = np.zeros((len(texts), BANDS), np.uint64)
                for b in range(BANDS):
                    keys[:, b] = np.uint64(b)
                    for r in range(ROWS):
                        keys[:, b] = mix(keys[:, b] * np.uint64(0x9E3779B97F4A7C15) + mins[:, b * ROWS + r])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(lo, hi - lo),
                    "tid": pa.array(np.array([_text_id(t) for t in texts], np.uint64).view(np.int64)),
                    "fp": pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)),
                    "brief": longs(_brief(mins)),
                    "keys": longs(keys),
                    "finer": longs(np.ascontiguousarray(mins[:, BANDS * ROWS :])),
                })

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, tid long, fp long, brief array<long>, keys array<long>, finer array<long>")


def forest(fp: np.ndarray, brief: np.ndarray, wide: int = WIDE, lost: int = LOST) -> list[tuple[int, int]]:
    """Minimum spanning forest of the pairs that are not discarded, as pairs of places (Prim)."""
    n = len(fp)
    table = _table(fp)
    far = wide + lost + 1
    best, via, out = np.full(n, far, np.int16), np.zeros(n, np.int64), []
    left = np.ones(n, bool)
    v = 0
    while True:
        left[v] = False
        rest = np.flatnonzero(left)
        if len(rest) == 0:
            return out
        near = rest[np.abs(table[rest] - table[v]).max(1) <= wide]
        gap, other = np.bitwise_count(fp[near] ^ fp[v]).astype(np.int16), _lost(brief[near], brief[v])
        gap = np.where((gap <= wide) & (other <= lost), gap + other, far)
        closer = gap < best[near]
        best[near[closer]], via[near[closer]] = gap[closer], v
        v = int(rest[np.argmin(best[rest])])
        if best[v] < far:
            out.append((int(via[v]), v))


def _forests(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(6)) for b in batches]
        if not got:
            return
        key, tid, *marks = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((tid, key))
        key, tid = key[order], tid[order]
        fp, *brief = (m[order].view(np.uint64) for m in marks)
        brief = np.column_stack(brief)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        a, b = [], []
        for g in np.flatnonzero(np.diff(edge) > 1):
            lo = int(edge[g])
            for i, j in forest(fp[lo : edge[g + 1]], brief[lo : edge[g + 1]]):
                a.append(lo + i)
                b.append(lo + j)
        x, y = tid[np.array(a, np.int64)], tid[np.array(b, np.int64)]
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    return rows.select("key", *MARKS).mapInArrow(trimmed(run), "a long, b long")


def by_masks(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of texts (a, b) that join all whose fingerprints differ in at most radius bits, from
    the pivot tables of mask groups; texts of one fingerprint meet the least of them."""
    texts = marked.select("tid", "fp").distinct()
    nodes = stored(texts.groupBy("fp").agg(F.min("tid").alias("rep")), "copies-nodes")
    near = fingerprint_links(nodes, radius)
    same = texts.join(nodes, "fp").filter("tid != rep").select(F.col("rep").alias("a"), F.col("tid").alias("b"))
    out = stored(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same), "copies-masked")
    discard(nodes, near)
    return out


def candidates(marked: DataFrame, group: int = GROUP) -> DataFrame:
    """Pairs of texts (a, b) from every key's forest; marked as from :func:`sketches`."""
    spark = marked.sparkSession
    rows = marked.select("tid", "fp", *(F.col("brief")[k].alias(f"brief{k}") for k in range(3)), F.explode("keys").alias("key")).distinct()
    found, made, total = None, [], BANDS * marked.count()
    for level in range(LEVELS + 1):
        rows = stored(rows, "copies-keys", parts_of(spark, total, PART))
        counts = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("tid").alias("least")).filter("n > 1"), "copies-groups", parts_of(spark, total, PART))
        made += [rows, counts]
        total, top = counts.agg(F.sum("n"), F.max("n")).first()
        if total is None:
            total = 0
            break
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 2_000_000))
        new = _forests(rows.join(counts.filter(F.col("n") <= group).select("key"), "key", "left_semi").repartition(parts, "key"))
        found = new if found is None else found.unionByName(new)
        if top <= group:
            break
        hot = rows.join(counts.filter(F.col("n") > group).select("key", "least"), "key")
        if level == LEVELS:
            star = hot.filter("tid != least").select(F.least("tid", "least").alias("a"), F.greatest("tid", "least").alias("b"))
            found = found.unionByName(star)
            break
        places = range(level * FINER, (level + 1) * FINER)
        extra = marked.select("tid", *(F.col("finer")[p].alias(f"f{p}") for p in places)).groupBy("tid").agg(*(F.min(f"f{p}").alias(f"f{p}") for p in places))
        finer = F.explode(F.array(*(F.xxhash64("key", F.lit(p), f"f{p}") for p in places)))
        rows = hot.join(extra, "tid").select(*MARKS, finer.alias("key"))
    out = found.distinct() if found is not None else spark.createDataFrame([], "a long, b long")
    out = stored(out, "copies-candidates", parts_of(spark, total, PART))
    discard(*made)
    return out


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """tid and the distinct hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in slices(*buffers(batch.column(0))):
                raw, ends = data.data, bounds.tolist()
                hashes, begin = shingle_sets(data, bounds, shingle)
                parts = [np.unique(hashes[a:b]) for a, b in zip(begin, begin[1:])]
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                tids = np.array([_text_id(bytes(raw[a:b])) for a, b in zip(ends, ends[1:])], np.uint64)
                yield pa.RecordBatch.from_pydict({"tid": pa.array(tids.view(np.int64)), "s": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64)))})

    return docs.select("text").mapInArrow(trimmed(run), "tid long, s array<long>")


def _sets_of(docs: DataFrame, marked: DataFrame, ends: DataFrame, shingle: int) -> DataFrame:
    """_sets, of the texts in ends (tid) only, one row each."""
    holders = marked.groupBy("tid").agg(F.min("doc_id").alias("doc_id")).join(ends, "tid", "left_semi").select("doc_id").distinct()
    found = _sets(docs.select("doc_id", "text").join(holders, "doc_id", "left_semi"), shingle).join(ends, "tid", "left_semi")
    return stored(found.dropDuplicates(["tid"]), "copies-sets")


def checked(docs: DataFrame, marked: DataFrame, pairs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least the similarity."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct()
    sets = _sets_of(docs, marked, ends, shingle)
    of = lambda x: sets.select(F.col("tid").alias(x), F.col("s").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = pairs.join(of("a"), "a").join(of("b"), "b").filter(both >= similarity * (F.size("sa") + F.size("sb") - both))
    out = stored(alike.select("a", "b").distinct(), "copies-links")
    discard(sets)
    return out


def _survivors(v: int, label: np.ndarray, fp: np.ndarray, brief: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Later places than v of another label whose pair with v is not discarded."""
    rest = v + 1 + np.flatnonzero(label[v + 1 :] != label[v])
    rest = rest[np.abs(table[rest] - table[v]).max(1, initial=0) <= WIDE]
    rest = rest[np.bitwise_count(fp[rest] ^ fp[v]) <= WIDE]
    return rest[_lost(brief[rest], brief[v]) <= LOST]


def _table(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ _PIVOTS[None, :]).astype(np.int16)


def exact_links(label: np.ndarray, fp: np.ndarray, brief: np.ndarray, offsets: np.ndarray, shingles: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places that join all labels between which a similar pair is not discarded; the
    distinct shingles of place i are shingles[offsets[i]:offsets[i + 1]]."""
    table, out = _table(fp), []
    label = np.unique(label, return_inverse=True)[1]
    names, rank = np.unique(shingles, return_inverse=True)
    mine, size = np.zeros(len(names), np.int32), np.diff(offsets)
    for v in range(len(fp) - 1):
        rest = _survivors(v, label, fp, brief, table)
        rest = rest[np.minimum(size[rest], size[v]) >= similarity * np.maximum(size[rest], size[v])]
        if len(rest) == 0:
            continue
        own = rank[offsets[v] : offsets[v + 1]]
        mine[own] = 1
        if 4 * len(rest) > len(fp) - v:
            both = np.add.reduceat(mine[rank[offsets[v + 1] :]], offsets[v + 1 : -1] - offsets[v + 1])[rest - v - 1]
        else:
            both = np.array([mine[rank[offsets[j] : offsets[j + 1]]].sum() for j in rest.tolist()])
        mine[own] = 0
        for j in rest[both >= similarity * (size[rest] + size[v] - both)].tolist():
            if label[j] != label[v]:
                out.append((v, j))
                label[label == label[j]] = label[v]
    return out


def _undecided(rows: DataFrame) -> DataFrame:
    """The rows of each task that are in a pair of different labels which is not discarded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        whole = pa.Table.from_batches(held).sort_by("task")
        task, label, *marks = (whole[c].to_numpy() for c in ("task", "label", *MARKS[1:]))
        fp, brief = marks[0].view(np.uint64), np.column_stack(marks[1:]).view(np.uint64)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
        hit = np.zeros(len(task), bool)
        for lo, hi in zip(edge.tolist(), edge[1:].tolist()):
            at = slice(lo, hi)
            table = _table(fp[at])
            for v in range(hi - lo - 1):
                rest = _survivors(v, label[at], fp[at], brief[at], table)
                if len(rest):
                    hit[lo + v] = hit[lo + rest] = True
        yield from whole.filter(pa.array(hit)).to_batches()

    columns = rows.select("task", "label", *MARKS)
    return columns.mapInArrow(trimmed(run), columns.schema)


def remaining(docs: DataFrame, marked: DataFrame, links: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """Links (a, b) that join what given links leave apart, from all pairs in a key's group."""
    spark = marked.sparkSession
    grown = stored(connected_components(links), "copies-grown", parts_of(spark, BANDS * marked.count(), PART))
    n = BANDS * marked.count()
    texts = marked.select("tid", "fp", *(F.col("brief")[k].alias(f"brief{k}") for k in range(3)), "keys").dropDuplicates(["tid"])
    texts = texts.join(grown, texts["tid"] == grown["node"], "left").select(*MARKS, F.coalesce("component", "tid").alias("label"), F.explode("keys").alias("key"))
    rows = stored(texts, "copies-labels", parts_of(spark, n, PART))
    per = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = stored(per.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main")).filter("n > main.n").select("key", "n", "main"), "copies-mixed", parts_of(spark, n, PART))
    total = mixed.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 1_000_000))
    open_ = stored(_undecided(_tasks(rows, mixed, group).repartition(parts, "task")), "copies-undecided", parts_of(spark, total, PART))
    sets = _sets_of(docs, marked, open_.select("tid").distinct(), shingle)

    def check(got: pa.Table) -> pa.Table:
        got = got.combine_chunks().sort_by("tid")
        tid, label, *marks = (got[c].to_numpy() for c in ("tid", "label", *MARKS[1:]))
        s = got["s"].combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(s.value_lengths().to_numpy())])
        pairs = exact_links(label, marks[0].view(np.uint64), np.column_stack(marks[1:]).view(np.uint64), offsets, s.flatten().to_numpy(), similarity)
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"a": tid[at[:, 0]], "b": tid[at[:, 1]]})

    out = stored(open_.join(sets, "tid").groupBy("task").applyInArrow(check, "a long, b long").distinct(), "copies-remaining", parts_of(spark, total, PART))
    discard(grown, rows, mixed, open_, sets)
    return out


def _tasks(rows: DataFrame, mixed: DataFrame, group: int) -> DataFrame:
    """Rows of the keys with several labels, with the tasks that together hold all pairs of
    different labels of a key: a larger key's main label and its other texts are dealt into
    blocks, and every other block meets each main and each other block."""
    few = rows.join(mixed.filter(F.col("n") <= group).select("key"), "key").select("label", *MARKS, F.col("key").alias("task"))
    block = max(1, group // 2)
    sizes = mixed.filter(F.col("n") > group).select("key", F.col("main.label").alias("most"), F.ceil(F.col("main.n") / block).alias("mains"), F.ceil((F.col("n") - F.col("main.n")) / block).alias("others"))
    hot = rows.join(sizes, "key").withColumn("in_main", F.col("label") == F.col("most"))
    hot = hot.withColumn("own", F.pmod(F.xxhash64("tid", F.lit(1)), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))))
    name = lambda kind, x, y: F.xxhash64("key", F.lit(kind), x, y)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_others = F.transform(upto(F.col("others")), lambda j: name(1, F.col("own"), j))
    with_all = F.concat(
        F.transform(upto(F.col("mains")), lambda i: name(1, i, F.col("own"))),
        F.transform(upto(F.col("others")), lambda j: name(0, F.least(F.col("own"), j), F.greatest(F.col("own"), j))),
    )
    many = hot.select("label", *MARKS, F.explode(F.when(F.col("in_main"), with_others).otherwise(with_all)).alias("task"))
    return few.unionByName(many)


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of its group) for every row with a doc_id."""
    known = docs.filter(F.col("doc_id").isNotNull())
    spark = docs.sparkSession
    marked = stored(sketches(known, shingle), "copies-sketches", parts_of(spark, text_bytes(known), READ))
    parts = parts_of(spark, marked.count(), PART)
    masked, keyed = by_masks(marked), candidates(marked, group=group)
    pairs = stored(masked.unionByName(keyed).distinct(), "copies-pairs", parts)
    links = checked(known, marked, pairs, shingle, similarity)
    more = remaining(known, marked, links, shingle, similarity, group)
    rep = marked.groupBy("tid").agg(F.min("doc_id").alias("rep"))
    joined = rep.join(connected_components(links.unionByName(more)), rep["tid"] == F.col("node"), "left").select("tid", "rep", F.coalesce("component", "tid").alias("component"))
    joined = stored(joined, "copies-named", parts)
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = stored(joined.join(least, "component").select("tid", "component_id"), "copies-named", parts)
    out = stored(marked.select("doc_id", "tid").join(named, "tid").select("doc_id", "component_id"), "copies-components", parts)
    discard(marked, masked, keyed, pairs, links, more, joined, named)
    return out


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Of each group, the document with the smallest doc_id, all columns; rows without a doc_id
    stay, and so do all rows of a doc_id of which one stays."""
    gone, stays = (f"{x}_{uuid.uuid4().hex}" for x in ("gone", "stays"))
    named = near_copies(docs, shingle, similarity).groupBy(F.col("doc_id").alias(gone)).agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias(stays))
    return docs.join(named.filter(F.col(stays) == 0).select(gone), F.col(gone) == docs["doc_id"], "left_anti")

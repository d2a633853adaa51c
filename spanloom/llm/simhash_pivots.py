"""SimHash near-duplicates with pivot distance tables.

Fingerprints that differ in at most ``radius`` bits are linked. Candidates share all bits of one
of several masks: 64 bits in ``blocks`` blocks, of which ``radius`` may differ, so each choice of
blocks - radius equal blocks is a mask. A mask's value with too many fingerprints is refined:
what it leaves open is cut into radius + 1 parts, one of which must be equal too; so no group
grows with the corpus, and no link is lost.

In a group a table of distances to fixed reference fingerprints (pivots) is computed. Rows are
ordered by the first distance; a pair is discarded once some distance differs by more than
``radius`` (triangle inequality), survivors are verified by their own Hamming distance. Each
task hands on one link a row, to the least row it is joined to, not all pairs.

Defined cases: null and empty texts have fingerprint zero and are linked like others; repeated
doc_ids get a row each; null doc_ids have no component unless their group has an id; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm._words import buffers, mix, trimmed
from spanloom.operators.components import connected_components
from spanloom.session import discard, stored

SHINGLE, SEED, RADIUS, PIVOTS, GROUP = 3, 42, 3, 16, 2000
_PIVOTS = np.random.default_rng(64).integers(0, 2**64, PIVOTS, dtype=np.uint64)
_ALL = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingles' XXH64, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(batch.column(1))
            raw, at = data.data, bounds.tolist()
            fps = [fingerprint(bytes(raw[a:b]), shingle, seed) for a, b in itertools.pairwise(at)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, fp long")


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(x) for x in itertools.combinations(block, blocks - radius)]


def finer(mask: int, radius: int = RADIUS) -> list[int]:
    """The masks that refine a mask: its open bits dealt into radius + 1 parts."""
    free = [i for i in range(64) if not mask >> i & 1]
    if len(free) <= radius:
        return []
    return [mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]


def _keyed(nodes: DataFrame, chosen: list[int]) -> DataFrame:
    """fp, rep, mask, key for each of the masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for m in chosen:
                key = mix((fp & np.uint64(m)) + mix(np.array([m], np.uint64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(fp), np.uint64(m)).view(np.int64)), pa.array(key.view(np.int64))], ["fp", "rep", "mask", "key"])

    return nodes.select("fp", "rep").mapInArrow(run, "fp long, rep long, mask long, key long")


def _refined(rows: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            old = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for m in np.unique(old):
                at = np.flatnonzero(old == m)
                for new in finer(int(m), radius) or [int(m)]:
                    key = mix((fp[at] & np.uint64(new)) + mix(np.array([new], np.uint64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), np.uint64(new)).view(np.int64)), pa.array(key.view(np.int64))], ["fp", "rep", "mask", "key"])

    return rows.select("fp", "rep", "mask").mapInArrow(run, "fp long, rep long, mask long, key long")


def linked(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row, the least row that it is joined to by links within its key's group."""
    table = np.bitwise_count(fp[:, None] ^ _PIVOTS[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], key))
    k, f, t = key[order], fp[order], table[order]
    label = np.arange(len(k))
    at, lag = np.arange(len(k)), 1
    while True:
        at = at[at + lag < len(k)]
        at = at[(k[at] == k[at + lag]) & (t[at + lag, 0] - t[at, 0] <= radius)]
        if len(at) == 0:
            break
        other = at + lag
        near = np.abs(t[at] - t[other]).max(1) <= radius
        i, j = at[near], other[near]
        same = np.bitwise_count(f[i] ^ f[j]) <= radius
        i, j = i[same], j[same]
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        lag += 1
    out = np.empty(len(k), np.int64)
    out[order] = order[label]
    return out


def _links(rows: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)) for b in batches]
        if got:
            fp, rep, key = (np.concatenate(x) for x in zip(*got, strict=True))
            to = linked(key.view(np.uint64), fp.view(np.uint64), radius)
            moved = np.flatnonzero(rep != rep[to])
            yield pa.RecordBatch.from_pydict({"a": pa.array(rep[moved]), "b": pa.array(rep[to][moved])})

    return rows.select("fp", "rep", "key").mapInArrow(trimmed(run), "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Links between nodes (fp distinct, rep) that connect all within radius of each other."""
    n = nodes.count()
    blocks = radius + 1 if n < 2_000_000 else radius + 2 if n < 500_000_000 else radius + 3
    rows, found, made = _keyed(nodes, masks(blocks, radius)), None, []
    while True:
        rows = stored(rows, "simhash-keys")
        made.append(rows)
        hot = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("mask").alias("mask")).filter((F.col("n") > group) & (F.bit_count("mask") < 64 - radius))
        hot = stored(hot.select("key"), "simhash-hot")
        made.append(hot)
        some = not hot.isEmpty()
        calm = rows.join(hot, "key", "left_anti") if some else rows
        parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * 20 // 2_000_000))
        new = _links(calm.repartition(parts, "key"), radius)
        found = new if found is None else found.unionByName(new)
        if not some:
            break
        rows = _refined(rows.join(hot, "key", "left_semi"), radius)
    out = stored(found.distinct(), "simhash-links")
    discard(*made)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id for every document."""
    marked = stored(fingerprints(docs, shingle, seed), "simhash-docs")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    components = connected_components(links(nodes.filter("rep is not null"), radius))
    named = nodes.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Of each group, the document with the smallest doc_id, all columns; rows without a doc_id stay."""
    name = f"gone_{uuid.uuid4().hex}"
    gone = near_duplicates(docs, radius, shingle, seed).filter("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(name) == docs["doc_id"], "left_anti")

"""TF-IDF cosines of the two texts of a row, weighed over all texts, without moving a row for each term of a pair.

Pairs are packed into chunks, which are written once. A chunk asks for the frequency of each distinct term that it holds,
by hash, in a compressed block for each bucket of terms (:mod:`spanloom.llm._exchange`); with the answers it has all that
its cosines need. So what moves are a chunk's distinct terms, not a pair's, at some seven bytes each, and no vocabulary is
held anywhere in whole. Terms are told apart by 64-bit hashes, as words are in the corpus operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm._exchange import ASK, BUCKET_BYTES, answered, ask, merge, pack, release, rows_table, unpack
from spanloom.llm._words import distinct, run_hash, trim, trimmed, window_hash
from spanloom.operators import retrieval
from spanloom.session import parts_of, stored

#: Words of both texts in a chunk, in bytes: what a task holds at once follows from it.
CHUNK_BYTES = 8 << 20


def _said(text: str):
    """A text's words with a blank between them."""
    return F.array_join(retrieval.words(F.col(text)), " ")


def _packer(kind: str):
    """For mapInArrow: from rows of a key and a text to chunks of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        keys, sizes, bodies, held = [], [], [], 0

        def out():
            nonlocal made, held
            body = pack(np.concatenate(sizes), np.concatenate(bodies))
            all_keys = pa.concat_arrays(keys)
            lists = pa.ListArray.from_arrays(pa.array([0, len(all_keys)], pa.int32()), all_keys)
            row = pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), lists, pa.array([body], pa.binary())], ["chunk", "keys", "payload"])
            made, held = made + 1, 0
            for x in (keys, sizes, bodies):
                x.clear()
            return row

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            lo = 0
            while lo < len(texts):
                hi = min(len(texts), max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_BYTES - held, "right")) - 1))
                keys.append(batch.column(0).slice(lo, hi - lo))
                sizes.append(np.diff(at[lo : hi + 1]))
                bodies.append(data[at[lo] : at[hi]].copy())
                held += int(at[hi] - at[lo])
                lo = hi
                if held >= CHUNK_BYTES or lo < len(texts):
                    yield out()
        if keys:
            yield out()

    return run, f"chunk long, keys array<{kind}>, payload binary"


def _terms(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of a chunk: hashes of its distinct terms, rising; for each side of a row and term met there, rising, twice the row's number
    plus the side times the number of terms, plus the term's; how often; and the number of rows."""
    sizes, data = unpack(payload)
    gap = (data == 32) | (data == 10) | (data == 0)  # between words, texts of a side, sides
    edge = np.diff(np.concatenate([[True], gap, [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    row = np.searchsorted(np.cumsum(sizes), starts, "right")
    group = 2 * row + (starts > np.flatnonzero(data == 0)[row])
    del gap, edge, row
    word = run_hash(data, starts, ends)
    near = np.flatnonzero((starts[1:] == ends[:-1] + 1) & (data[ends[:-1]] == 32)) if len(word) else np.zeros(0, np.int64)
    terms = np.concatenate([word, window_hash(word, 2)[near]])
    del data, starts, ends, word
    names, which = distinct(terms)[::2]
    del terms
    which += np.concatenate([group, group[near]]) * len(names)
    which.sort()
    first = np.flatnonzero(np.diff(which, prepend=-1))
    return names, which[first], np.diff(np.append(first, len(which))), len(sizes)


def _asking(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                names, met, _, _ = _terms(payload.as_py())
                if len(names):
                    yield from rows_table(ask(chunk, 0, names, [np.bincount(met % len(names), minlength=len(names)).astype(np.uint32)], buckets)).to_batches()

    return run


def _frequency(kind, n, group, sent, source):
    return [np.bincount(group, sent[0], n).astype(np.uint32)[group]], (0, 0)


def _cosines(key: str, texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, met, count, rows = _terms(batch.column("payload")[i].as_py())
                df = answered(pa.Table.from_struct_array(batch.column("answers")[i].values), 0)[0] if len(names) else np.zeros(0)
                term, group = met % max(1, len(names)), met // max(1, len(names))
                w = count * (np.log((1 + texts) / (1 + df)) + 1)[term]
                square = np.bincount(group, w * w, 2 * rows)
                other = group % 2 == 1
                one, two = (group[~other] // 2) * len(names) + term[~other], (group[other] // 2) * len(names) + term[other]
                at = np.searchsorted(one, two)
                both = np.flatnonzero(at < len(one))
                both = both[one[at[both]] == two[both]]
                product = np.bincount(group[other][both] // 2, w[other][both] * w[~other][at[both]], rows)
                size = np.sqrt(square[::2]) * np.sqrt(square[1::2])
                yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, pa.array(np.divide(product, size, out=np.zeros(rows), where=size > 0))], [key, "cosine"])
                trim()

    return run


def paired_tfidf(pairs: DataFrame, key: str, one: str, other: str) -> DataFrame:
    """key, cosine of the TF-IDF vectors of each row's two texts, weighed over all texts of both columns."""
    spark, kind = pairs.sparkSession, pairs.schema[key].dataType.simpleString()
    # texts of equal keys are one; words do not meet across them
    said = pairs.select(key, _said(one).alias("a"), _said(other).alias("b"))
    n, keys, size = pairs.agg(F.count("*"), F.count_distinct(key) + F.max(F.col(key).isNull().cast("int")), F.sum(F.coalesce(F.octet_length(one), F.lit(0)) + F.coalesce(F.octet_length(other), F.lit(0)))).first()
    if n != (keys or 0):
        said = said.groupBy(key).agg(F.array_join(F.collect_list("a"), "\n").alias("a"), F.array_join(F.collect_list("b"), "\n").alias("b"))
    packer, schema = _packer(kind)
    text = said.select(key, F.concat("a", F.lit("\0"), "b", F.lit("\n")).alias("t")).coalesce(parts_of(spark, size or 0, CHUNK_BYTES))
    chunks = stored(text.mapInArrow(trimmed(packer), schema), "paired-chunks")
    release(spark)
    buckets = max(1, -(-(size or 0) // BUCKET_BYTES))
    asked = chunks.select("chunk", "payload").mapInArrow(trimmed(_asking(buckets)), ASK)
    answers = stored(merge(asked, _frequency, buckets).select("chunk", "kind", "bucket", "body"), "paired-answers")
    release(spark)
    each = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "body")).alias("answers"))
    met = chunks.join(each, "chunk", "left").select("keys", "payload", "answers").mapInArrow(trimmed(_cosines(key, 2 * n)), f"{key} {kind}, cosine double")
    return pairs.select(key).join(met, key, "left").select(key, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))

"""Ask-and-answer rounds between chunks of a corpus and buckets of a hash space.

A chunk is a bounded run of documents. In each round every chunk sends the distinct keys that it
needs, with its own partial values, to the buckets that own them; a bucket merges what all
chunks sent and answers each chunk in the order it asked. Keys are uniform hashes and each chunk
sends a key once however often it holds it, so no key, however frequent, makes a bucket large.
Keys travel sorted, as deltas, in one compressed block per chunk and bucket rather than as rows.

Chunks and answers are two tables bucketed by chunk, with as many buckets as the corpus has
``TASK_BYTES``. A round moves its questions once and its answers once; later rounds read both
tables side by side and move neither again. Tables lie in the shared folder, so a lost executor
costs at most the running round; they are dropped at the end or when a round fails.

Blocks number chunks times buckets, so the keys that one holds become fewer as the corpus grows;
for very large ones both sizes have to be raised.
"""

from __future__ import annotations

import gc
import struct
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm._words import distinct, trim, trimmed
from spanloom.session import fresh_path, remove, stored

BUCKET_BYTES, TASK_BYTES, MOST_TASKS = 12 << 20, 24 << 20, 50_000
ASK = "chunk long, kind int, bucket int, body binary"
PACKED = "chunk long, size long, payload binary"
_COMPRESS, _DECOMPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block, their bytes grouped by significance."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head = a.dtype.str.encode().ljust(4)
        body = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        out.append(head + struct.pack("<q", len(a)) + body)
    return _COMPRESS.compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = _DECOMPRESS.decompress(blob), 0, []
    while at < len(raw):
        kind = np.dtype(raw[at : at + 4].decode().strip())
        (n,) = struct.unpack_from("<q", raw, at + 4)
        at += 12
        body = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        out.append(np.ascontiguousarray(body.reshape(kind.itemsize, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in sorted keys, and the end."""
    width = (1 << 64) // buckets + 1
    edges = np.array([i * width for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


class Ragged:
    """A run of bytes for each key: lengths, and all bytes."""

    def __init__(self, lengths: np.ndarray, data: np.ndarray):
        self.lengths, self.data = lengths.astype(np.uint32), data
        self.at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])

    def take(self, which: np.ndarray) -> Ragged:
        n = self.lengths[which].astype(np.int64)
        begin = np.cumsum(n) - n
        return Ragged(n, self.data[np.arange(int(n.sum())) + np.repeat(self.at[which] - begin, n)])

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def _cut(values: list, lo: int, hi: int) -> list[np.ndarray]:
    out = []
    for v in values:
        out += [v.lengths[lo:hi], v.data[v.at[lo] : v.at[hi]]] if isinstance(v, Ragged) else [v[lo:hi]]
    return out


def ask(chunk: int, kind: int, keys: np.ndarray, values: list, buckets: int) -> list[tuple]:
    """Rows that send sorted distinct keys with their values (arrays or Ragged) to the buckets."""
    at = cut(keys, buckets)
    rows = []
    for b in np.flatnonzero(np.diff(at)).tolist():
        lo, hi = at[b], at[b + 1]
        k = keys[lo:hi]
        rows.append((chunk, kind, b, pack(np.diff(k, prepend=k.dtype.type(0)), *_cut(values, lo, hi))))
    return rows


def release(spark) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished rounds: it acts on frames that
    the driver's collectors have found unreachable."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rows_table(rows: list[tuple], chunk_first: bool = True) -> pa.Table:
    c, k, b, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"chunk": pa.array(c, pa.int64()), "kind": pa.array(k, pa.int32()), "bucket": pa.array(b, pa.int32()), "body": pa.array(body, pa.binary())})


def answered(table: pa.Table, kind: int) -> list[np.ndarray]:
    """The answer to a chunk's keys of a kind, in the keys' order."""
    found = sorted((b, i) for i, (k, b) in enumerate(zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), strict=True)) if k == kind)
    body = table["body"]
    parts = [unpack(body[i].as_py()) for _, i in found]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def kinds(table: pa.Table) -> set[int]:
    return set(table["kind"].to_pylist())


def merge(asked: DataFrame, reply: Callable, buckets: int) -> DataFrame:
    """reply(kind, n, group, sent, source), called once for a bucket and kind with all that chunks
    sent: n distinct keys, group: which of them each sent key is, sent: the values, source: the
    sending chunk, rising. It returns what to send back, one entry per sent key, and two sums.
    A Ragged value is sent and answered as its lengths and its bytes."""

    def bucket(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("chunk")
        chunks, body = table["chunk"].to_pylist(), table["body"]
        kind, number = table["kind"][0].as_py(), table["bucket"][0].as_py()
        parts = [unpack(body[i].as_py()) for i in range(len(chunks))]
        sizes = [len(p[0]) for p in parts]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        sent = [np.concatenate(x) for x in zip(*(p[1:] for p in parts), strict=True)]
        del parts
        names, _, group = distinct(keys)
        del keys
        back, stats = reply(kind, len(names), group, sent, np.repeat(np.array(chunks, np.int64), sizes))
        at = np.concatenate([[0], np.cumsum(sizes)])
        rows = [(c, kind, number, pack(*_cut(back, at[i], at[i + 1]))) for i, c in enumerate(chunks)]
        out = rows_table(rows)
        for name, value in zip(("s0", "s1"), stats, strict=True):
            out = out.append_column(name, pa.array([float(value)] + [0.0] * (len(rows) - 1), pa.float64()))
        del back, sent, group, rows
        trim()
        return out

    return asked.repartition(buckets, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(bucket, ASK + ", s0 double, s1 double")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


class Corpus:
    """Documents packed into chunks, written once; rounds run against them."""

    def __init__(self, docs: DataFrame, packer: Callable, name: str, chunk_bytes: int):
        """packer: for mapInArrow, from docs to PACKED; one row is a chunk. Many small partitions
        are read together, so that chunks fill up."""
        self.spark = spark = docs.sparkSession
        self.name, self.rounds = name, 0
        size = text_bytes(docs)
        self.buckets = max(1, -(-size // BUCKET_BYTES))
        self.tasks = max(1, min(MOST_TASKS, -(-size // TASK_BYTES)))
        readers = max(-(-size // chunk_bytes), spark.sparkContext.defaultParallelism)
        mark = uuid.uuid4().hex
        self.tables = [f"spanloom_{mark}_{x}" for x in ("chunks", "answers")]
        self.paths = [fresh_path(spark, f"{name}-{x}") for x in ("chunks", "answers")]
        self._guarded(lambda: self._write(docs.coalesce(readers).mapInArrow(trimmed(packer), PACKED), 0))

    def _guarded(self, step: Callable):
        try:
            return step()
        except BaseException:
            self.close()
            raise

    def _write(self, rows: DataFrame, which: int) -> None:
        # dealt out as the buckets are: a task writes one file
        rows.repartition(self.tasks, "chunk").write.mode("append").option("path", self.paths[which]).bucketBy(self.tasks, "chunk").saveAsTable(self.tables[which])

    def asking(self, make: Callable) -> DataFrame:
        """make(chunk, payload, answers table) -> rows of ask()."""
        return self.each(lambda c, p, t: rows_table(make(c, p, t)), ASK)

    def each(self, make: Callable, schema: str) -> DataFrame:
        chunks = self.spark.table(self.tables[0]).select("chunk", "payload")
        if not self.rounds:
            def alone(batches):
                for batch in batches:
                    for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                        yield from make(chunk, payload.as_py(), None).to_batches()

            return chunks.mapInArrow(trimmed(alone), schema)

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            out = make(left["chunk"][0].as_py(), left["payload"][0].as_py(), right)
            trim()
            return out

        # a chunk without a key has no answer, and no answer is without its chunk
        answers = self.spark.table(self.tables[1]).select("chunk", "kind", "bucket", "body")
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, schema)

    def round(self, make: Callable, reply: Callable) -> tuple[float, float]:
        """One round; the sums of what reply gave as stats."""

        def step():
            number = self.rounds
            self._write(merge(self.asking(make), reply, self.buckets).withColumn("round", F.lit(number)), 1)
            self.rounds += 1
            s = self.spark.table(self.tables[1]).filter(F.col("round") == number).agg(F.coalesce(F.sum("s0"), F.lit(0.0)), F.coalesce(F.sum("s1"), F.lit(0.0))).first()
            release(self.spark)
            return s[0], s[1]

        return self._guarded(step)

    def finish(self, make: Callable, schema: str) -> DataFrame:
        """The last pass; its rows are written, then the chunks and answers go."""
        out = self._guarded(lambda: stored(self.each(make, schema), f"{self.name}-result"))
        self.close()
        release(self.spark)
        return out

    def close(self) -> None:
        for name, path in zip(self.tables, self.paths, strict=True):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)

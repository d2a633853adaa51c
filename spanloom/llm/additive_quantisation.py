"""Approximate nearest neighbours: additive quantisation with exact reranking.

Codebooks of full dimension are fitted one after another on the residuals of a bounded sample
(k-means each). Every row is encoded by beam search: at each codebook the BEAM best sums so far
are extended by every codeword and the best are kept. The index keeps a row's codes, the norm of
its sum of codewords, the length of what the codes leave, and its vector.

A search deals the index into parts of a bounded number of bytes and sends each block of queries to every
part (queries against all rows, in blocks; nothing is broadcast). A task reads its part first,
then the queries that follow it in sort order. For a query it adds up look-up tables of products
of the query with all codewords; the best rows by that give an exact bound for the k-th neighbour, and all rows
whose approximate score plus MARGIN standard deviations of its error reaches the bound
are scored exactly, however many they are. The best k of each part meet by query.

So the only loss is a neighbour whose error exceeds the margin; recall does not fall as the
table grows. Work is queries times rows, as the question is; moved bytes are a part's queries and results.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite entries take no part; rows with equal ids are rows of their own, and a query leaves
out its own row only; null ids are no queries by id, as neighbours they come last in ties; with fewer
rows than k all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm._vectors import dimension, matrix, usable
from spanloom.llm._words import trimmed
from spanloom.session import discard, stored

#: Codebooks, codewords of each, sums kept in encoding, rows to fit on at most, k-means rounds.
BOOKS, WORDS, BEAM, SAMPLE, ROUNDS = 16, 256, 4, 16_384, 6
#: Standard deviations of the approximation's error within which a row is scored exactly.
MARGIN = 2.5
NEAREST, PART_BYTES = 20, 16 << 20
INNER, EUCLIDEAN = "inner", "euclidean"
_TOGETHER, _PAIRS, _NO_ID = 64, 1 << 15, np.iinfo(np.int64).max


def assigned(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The nearest codeword of each row."""
    return (np.einsum("kd,kd->k", words, words) - 2 * (x @ words.T)).argmin(1)


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Codebooks (books, words, dimension) by k-means on what earlier ones leave of the sample."""
    rng = np.random.default_rng(seed)
    left = sample.astype(np.float32)
    words = min(words, len(left))
    out = []
    for _ in range(books):
        book = left[rng.choice(len(left), words, replace=False)]
        for _ in range(rounds):
            near = assigned(left, book)
            order = np.argsort(near, kind="stable")
            used, begin, count = np.unique(near[order], return_index=True, return_counts=True)
            book[used] = np.add.reduceat(left[order], begin, axis=0, dtype=np.float64) / count[:, None]
        left = left - book[assigned(left, book)]
        out.append(book)
    return np.stack(out)


def encode(books: np.ndarray, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row (rows, books), and what they leave of it."""
    n = len(x)
    left = x.astype(np.float32)[:, None, :]
    error = np.einsum("nbd,nbd->nb", left, left)
    codes = np.zeros((n, 1, 0), np.uint8)
    rows = np.arange(n)[:, None]
    for book in books:
        kept, size = left.shape[1], len(book)
        reached = (left.reshape(n * kept, -1) @ (-2 * book.T) + np.einsum("kd,kd->k", book, book)).reshape(n, kept, size) + error[:, :, None]
        reached = reached.reshape(n, kept * size)
        best = np.empty((n, min(beam, kept * size)), np.int64)
        error = np.empty(best.shape, np.float32)
        for j in range(best.shape[1]):
            best[:, j] = reached.argmin(1)
            error[:, j] = reached[rows[:, 0], best[:, j]]
            reached[rows[:, 0], best[:, j]] = np.inf
        parent, word = best // size, best % size
        left = left[rows, parent] - book[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
    return codes[:, 0], left[:, 0]


def vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """key and v array<double> of the rows that take part, and their dimension."""
    d = dimension(df, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column(1), d)
            at = pa.array(at[(x != 0).any(1)])
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["key", "v"])

    kind = "float" if dict(df.dtypes)[vector] == "array<float>" else "double"
    return df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(f"array<{kind}>").alias("v")).mapInArrow(trimmed(run), f"key long, v array<{kind}>"), d


def sampled(rows: DataFrame, total: int, size: int) -> np.ndarray:
    """About size rows at random; at most a quarter more."""
    found = rows.select("v").sample(fraction=min(1.0, size / max(total, 1)), seed=11).limit(size + size // 4).toArrow()["v"].combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1).astype(np.float64) if len(found) else np.zeros((0, 0))


def index(rows: DataFrame, d: int, books: np.ndarray, scale: float, beam: int = BEAM) -> DataFrame:
    """Adds uid (one for each row), codes, norm (of the sum of codewords) and rest (length of what they leave)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                x = (matrix(some.column(1), d) / scale).astype(np.float32)
                codes, left = encode(books, x, beam)
                norm = lambda a: pa.array(np.sqrt(np.einsum("nd,nd->n", a, a)).astype(np.float64) * scale)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), packed, norm(x - left), norm(left)], ["key", "v", "codes", "norm", "rest"])

    kind = dict(rows.dtypes)["v"]
    return rows.mapInArrow(trimmed(run), f"key long, v {kind}, codes binary, norm double, rest double").withColumn("uid", F.monotonically_increasing_id())


class Part:
    """A part of the index in a task."""

    def __init__(self, batches: list[pa.RecordBatch], d: int, books: np.ndarray, scale: float, k: int, measure: str, margin: float):
        column = lambda name: pa.chunked_array([b.column(name) for b in batches])
        number = lambda name: column(name).to_numpy()
        self.v = np.concatenate([matrix(b.column("v"), d) for b in batches])
        self.key = column("key").fill_null(_NO_ID).to_numpy()
        self.uid, self.norm, self.rest = number("uid"), number("norm"), number("rest")
        self.codes = np.frombuffer(b"".join(column("codes").to_pylist()), np.uint8).reshape(len(self.v), -1).T.astype(np.intp)
        self.d, self.books, self.scale, self.k, self.inner, self.margin = d, books, scale, k, measure == INNER, margin

    def approximate(self, q: np.ndarray) -> np.ndarray:
        """Products of queries and sums of codewords, by look-up tables."""
        m, size, _ = self.books.shape
        tables = (q.astype(np.float32) @ self.books.reshape(m * size, -1).T).reshape(len(q), m, size)
        out = np.zeros((len(q), len(self.v)), np.float32)
        for lo in range(0, len(self.v), 8192):
            part = out[:, lo : lo + 8192]
            for j in range(m):
                part += tables[:, j].take(self.codes[j, lo : lo + 8192], axis=1)
        return out * np.float32(self.scale)

    def exact(self, q: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a row, in double precision."""
        out = np.empty(len(which))
        for lo in range(0, len(which), _PAIRS):
            a, b = q[which[lo : lo + _PAIRS]], self.v[at[lo : lo + _PAIRS]].astype(np.float64)
            out[lo : lo + _PAIRS] = np.einsum("nd,nd->n", a, b) if self.inner else -np.einsum("nd,nd->n", a - b, a - b)
        return out

    def nearest(self, q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best rows of each query but its own: query, row and score."""
        n, k = len(self.v), self.k
        length = np.sqrt(np.einsum("qd,qd->q", q, q))[:, None]
        score = self.approximate(q)
        slack = 1e-5 * length * self.norm
        if self.inner:
            reach = score + self.margin / np.sqrt(self.d) * length * self.rest + slack
        else:
            apart = np.maximum(length**2 - 2.0 * score + self.norm**2, 0)
            score = -apart
            reach = score - self.rest**2 + 2 * self.margin / np.sqrt(self.d) * np.sqrt(apart) * self.rest + slack + 1e-5 * (length**2 + self.norm**2)
        if n > k + 1:
            first = np.argpartition(-score, k, axis=1)[:, : k + 1]
            sure = self.exact(q, np.repeat(np.arange(len(q)), k + 1), first.ravel()).reshape(first.shape)
            sure[self.uid[first] == own[:, None]] = -np.inf
            bound = np.partition(sure, 1, axis=1)[:, 1:2]  # the k-th best of k + 1
            which, at = np.nonzero(~(reach < bound))
        else:
            which, at = np.divmod(np.arange(len(q) * n), max(n, 1))
        other = self.uid[at] != own[which]
        which, at = which[other], at[other]
        score = self.exact(q, which, at)
        order = np.lexsort((self.key[at], -score, which))
        which, at, score = which[order], at[order], score[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        return which[rank < k], at[rank < k], score[rank < k]


_FOUND = "uid long, query_id long, vec_id long, score double"


def search(found: DataFrame, queries: Column, d: int, books: np.ndarray, scale: float, k: int = NEAREST, measure: str = INNER, margin: float = MARGIN, part_bytes: int = PART_BYTES) -> DataFrame:
    """The k nearest rows of an index for those of its rows that queries holds for: query_id, rank, vec_id, score."""
    spark = found.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-found.count() * d * 8 // part_bytes))
    rows = found.select(F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("role"), "uid", "key", "v", "codes", "norm", "rest")
    asked = found.filter(queries).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("role"), "uid", "key", "v", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("norm"), F.lit(None).cast("double").alias("rest"))

    def answers(part: Part, some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q, own = matrix(some.column("v"), d).astype(np.float64), some.column("uid").to_numpy()
        for lo in range(0, len(q), _TOGETHER):
            which, at, score = part.nearest(q[lo : lo + _TOGETHER], own[lo : lo + _TOGETHER])
            each = pa.array(which + lo)
            yield pa.RecordBatch.from_arrays([some.column("uid").take(each), some.column("key").take(each), pa.array(part.key[at], mask=part.key[at] == _NO_ID), pa.array(score)], ["uid", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, part = None, [], None
        for batch in batches:
            where, role = batch.column("part").to_numpy(), batch.column("role").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(where) != 0) | (np.diff(role) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                some = batch.slice(lo, hi - lo)
                if where[lo] != current:
                    current, held, part = where[lo], [], None
                if role[lo] == 0:
                    held.append(some)
                elif held or part:
                    if part is None:
                        part, held = Part(held, d, books, scale, k, measure, margin), []
                    yield from answers(part, some)

    dealt = rows.union(asked).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "role")
    best = dealt.mapInArrow(trimmed(run), _FOUND)
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = NEAREST, measure: str = INNER, margin: float = MARGIN, books: int = BOOKS, words: int = WORDS, sample: int = SAMPLE, part_bytes: int = PART_BYTES) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by every. measure: the largest inner product, or the
    least Euclidean distance (score: minus its square)."""
    rows, d = vectors(df, key, vector)
    some = sampled(rows, df.count(), sample)
    if len(some) == 0:  # few rows take part
        some = sampled(rows, 1, sample)
    if len(some) == 0:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scale = float(np.sqrt((some**2).sum(1).mean()))
    model = fit(some / scale, books, words)
    found = stored(index(rows, d, model, scale), "quantised")
    done = stored(search(found, F.col("key") % every == 0, d, model, scale, k, measure, margin, part_bytes), "neighbours")
    discard(found)
    return done

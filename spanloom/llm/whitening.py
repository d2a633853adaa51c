"""Embedding whitening: principal components by a matrix-free block Lanczos method.

Vectors become integers, x = floor(1024 * c) + 100000, so that sums and deviations are exact and
centring, (n * x - S) / n, loses nothing before anything is multiplied. The covariance V is never
formed: each step is one distributed pass, the sum of (x - S/n) ((x - S/n)' Q) over all rows for a
block Q of a few columns. Each block is orthogonalised twice against the whole basis, a column
that vanishes in doing so (breakdown) is replaced by a random one orthogonal to all, and the
method ends when the residuals of the wanted components are at rounding level or the basis spans
the space. A long basis is cut back to its best Ritz vectors (thick restart), so the driver
holds two matrices of the dimension times MOST_COLUMNS. Explained shares use the trace, which is the sum of
exact deviations.

Tasks fold their rows into one matrix; Spark adds the matrices up by row.

Defined cases: rows whose vector is null, empty, of another length than most, or holds null or
non-finite entries take no part; entries beyond 2**40 count as that; repeated rows count each
time; null ids are kept; a component whose variance is under 1e-13 of the trace has no whitened
values and is not returned (so a single row, or equal rows, give none); an empty table gives no
rows; other columns are ignored. Equal variances leave their components free within their
span, as for any method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm._vectors import as_lists, dimension, matrix, usable
from spanloom.llm._words import trimmed
from spanloom.session import stored

COMPONENTS, BLOCK, MOST_COLUMNS, PASSES = 8, 16, 512, 1000
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 40)
#: Residuals relative to the largest variance: at once enough; enough if they no longer fall.
AT_ONCE, SETTLED = 4e-15, 1e-12
NO_VARIANCE = 1e-13


@dataclass
class Whitener:
    """Components (columns), their variances, and what centring needs; trace and identity_error after :func:`fit`."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    passes: int
    trace: float = 0.0
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.components / np.sqrt(self.variances)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S in exact integers."""
    return x * np.int64(n) - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


def squares(dev: np.ndarray) -> pa.Array:
    """The sum of squares of each row of integers, exact, as decimal(38, 0)."""
    most = int(np.abs(dev).max(initial=0))
    if most * most * dev.shape[1] < 1 << 63:
        return pa.array(np.einsum("ij,ij->i", dev, dev)).cast(pa.decimal128(38, 0))
    wide = dev.astype(object)
    return pa.array([int(v) for v in (wide * wide).sum(1)], pa.decimal128(38, 0))


def integers(df: DataFrame, key: str, vector: str, d: int) -> DataFrame:
    """key and x array<long> of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, c = usable(batch.column(1), d)
            if len(at):
                x = np.floor(np.clip(c, -LARGEST, LARGEST) * SCALE).astype(np.int64) + SHIFT
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), as_lists(x)], ["key", "x"])

    return df.select(F.col(key).cast("long").alias("key"), vector).mapInArrow(trimmed(run), "key long, x array<long>")


def folded(rows: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], height: int, width: int, kind: str = "double") -> np.ndarray:
    """The sum of part(x) over all blocks x of rows: added up by a task first, then by Spark for each of the
    height rows of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                done = part(matrix(batch.column(0).slice(lo, 4096), d))
                total = done if total is None else total + done
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), as_lists(total)], ["i", "v"])

    tasks = rows.select("x").mapInArrow(trimmed(run), f"i int, v array<{kind}>")
    found = tasks.groupBy("i").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(width))).alias("v")).collect()
    out = np.zeros((height, width), np.int64 if kind == "long" else np.float64)
    for r in found:
        out[r["i"]] = r["v"]
    return out


def orthonormal(block: np.ndarray, basis: np.ndarray, vanished: float, rng: np.random.Generator) -> np.ndarray:
    """Columns orthogonal to the basis and each other, as many as the block has or the space leaves. What is
    left of a column under the bound counts as nothing: a random column takes its place."""
    d, have = basis.shape
    done = basis
    for column in block.T[: d - have]:
        bound = vanished
        while True:
            v = column.copy()
            for _ in range(2):
                v -= done @ (done.T @ v)
            norm = np.linalg.norm(v)
            if norm > bound:
                break
            column, bound = rng.standard_normal(d), 1e-6
        v /= norm
        v -= done @ (done.T @ v)
        done = np.column_stack([done, v / np.linalg.norm(v)])
    return done[:, have:]


def lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, most: int = MOST_COLUMNS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest eigenvalues, falling, their unit eigenvectors, and the number of passes, of the symmetric
    matrix that apply multiplies blocks of columns by."""
    rng = np.random.default_rng(seed)
    wanted, block = min(wanted, d), min(block, d)
    most = max(most, wanted + 3 * block)
    basis = image = np.zeros((d, 0))
    new = orthonormal(rng.standard_normal((d, block)), basis, 1e-6, rng)
    best, still = np.inf, 0
    for passes in range(1, PASSES + 1):
        product = apply(new)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product])
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz = basis @ turns[:, :wanted]
        left = np.linalg.norm(image @ turns[:, :wanted] - ritz * values[:wanted], axis=0).max(initial=0)
        top = max(abs(values[0]), abs(values[-1]))
        still = 0 if left < best / 2 else still + 1
        best = min(best, left)
        whole = basis.shape[1] == d
        if whole or top == 0 and passes > 1 or len(values) >= wanted and (left <= AT_ONCE * top or left <= SETTLED * top and still >= 3):
            return np.maximum(values[:wanted], 0), ritz / np.linalg.norm(ritz, axis=0), passes
        new = orthonormal(product, basis, 1e-13 * top, rng)
        if basis.shape[1] + block > most:
            keep = turns[:, : wanted + block]
            basis, image = basis @ keep, image @ keep
    raise RuntimeError(f"components did not settle in {PASSES} passes: residual {best:g} of {top:g}")


def fit(rows: DataFrame, d: int, components: int = COMPONENTS, block: int = BLOCK) -> Whitener | None:
    """The components of a table of integer vectors (:func:`integers`), every row counted; None without rows."""
    sums = folded(rows, d, lambda x: np.column_stack([x.sum(0), np.full(d, len(x))]), d, 2, "long")
    n, s = int(sums[0, 1]), sums[:, 0]
    if not n:
        return None

    def apply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, s)
            return c.T @ (c @ q)

        return folded(rows, d, part, d, q.shape[1]) / n

    variances, vectors, passes = lanczos(apply, d, components, block)
    found = Whitener(n, s, vectors, np.where(variances > 0, variances, 1), passes)
    k = len(variances)

    def checks(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x)
        spread = float((centred(x, n, s) ** 2).sum())
        return np.column_stack([w.T @ w, w.sum(0), np.full(k, spread)])

    total = folded(rows, d, checks, k, k + 2) / n
    found.trace = float(total[0, k + 1])
    live = variances > NO_VARIANCE * found.trace
    mean = total[live, k]
    cov = total[:, :k][np.ix_(live, live)] - np.outer(mean, mean)
    found.identity_error = float(np.abs(cov - np.eye(live.sum())).max(initial=0))
    found.components, found.variances = vectors[:, live], variances[live]
    return found


def transform(rows: DataFrame, d: int, model: Whitener) -> DataFrame:
    """A row for each vector and component: key, component, n, deviation (exact), whitened, explained, identity_error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for batch in batches:
            for lo in range(0, batch.num_rows if k else 0, 2048):
                some = batch.slice(lo, 2048)
                x = matrix(some.column(1), d)
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                fixed = lambda v: pa.array(np.full(m * k, v))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), fixed(np.int64(model.n)), squares(deviations(x, model.n, model.sums)).take(each),
                     pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.variances / model.trace, m)), fixed(model.identity_error)],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("key", "x").mapInArrow(trimmed(run), "key long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """Fits on all rows that take part and returns :func:`transform` of them, the key under its own name. The
    integer vectors are a table in the shared folder, read once a pass and by the result."""
    d = dimension(df, vector)
    rows = stored(integers(df, key, vector, d), "whitening-x")
    nothing = Whitener(0, np.zeros(d, np.int64), np.zeros((d, 0)), np.zeros(0), 0)
    return transform(rows, d, fit(rows, d, components, block) or nothing).withColumnRenamed("key", key)

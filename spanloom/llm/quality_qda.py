"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian over transformed statistics of the whole text; its covariance is shrunk
towards the pooled one and a ridge. A score is the logistic of the Mahalanobis log-density
difference plus the log prior ratio, from Cholesky factors computed once. Fitting needs only
per-class moment sums, added up over every labelled training row; nothing is sampled.

Defined cases: null and empty texts have all statistics zero and are scored like others; labels
without quality, or for unknown documents, are ignored; repeated labels count each time; if a
class has fewer than two rows all scores are 0.5; an empty table gives no rows; other columns
are ignored by :func:`score` and kept by :func:`keep`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm._stats import base_statistics, lines_of
from spanloom.llm._words import Words, mix, per_doc, texts_of, trimmed
from spanloom.session import stored

SHRINKAGE, RIDGE, THRESHOLD = 0.1, 1e-3, 0.3
HELD_OUT = (5, 0)
FEATURES = ("log_words", "word_chars", "symbols", "dup_lines", "repeat_words", "upper", "digits", "marks", "other", "distinct", "line_words", "word_spread")

_CLASS = np.zeros((4, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, list(b"!?")] = True
_CLASS[3, list(b".,;:'\"()-/@_=+[]{}~^`\\")] = True


def transformed(w: Words) -> np.ndarray:
    """A row of features for each text."""
    base = base_statistics(w)
    n = np.maximum(base["n_words"], 1).astype(float)
    chars = np.maximum(base["word_chars"], 1).astype(float)

    def share(mask):
        total = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.sqrt((total[w.bounds[1:]] - total[w.bounds[:-1]]) / chars)

    doc = w.doc
    hashes = w.hashes()
    distinct = np.bincount(doc[np.unique(mix(hashes + mix(doc.astype(np.uint64))), return_index=True)[1]], minlength=len(w.count)) if len(doc) else np.zeros(len(w.count))
    starts, ends, line_doc = lines_of(w)
    lines = np.bincount(line_doc[np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)], minlength=len(w.count))
    length = (w.end - w.start).astype(float)
    mean = per_doc(length, w.first) / n
    spread = np.sqrt(np.maximum(per_doc(length**2, w.first) / n - mean**2, 0))
    return np.column_stack([
        np.log1p(base["n_words"]), np.log1p(base["word_chars"] / n), np.sqrt(base["n_symbols"] / n), np.sqrt(base["n_dup_lines"] / np.maximum(lines, 1)),
        np.sqrt(base["n_repeat_words"] / n), *(share(_CLASS[i][w.data]) for i in range(4)), np.log((distinct + 1) / (n + 1)) / np.log(n + 2),
        np.log1p(n / np.maximum(lines, 1)), np.log1p(spread),
    ])


def features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in texts_of(batch):
                x = transformed(Words(data, bounds))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))})

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, x array<double>")


def held_out_column(modulus: int, left_out: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == left_out


def fit(stats: DataFrame, labels: DataFrame, held_out=HELD_OUT, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> dict | None:
    """Class means, Cholesky factors and priors from moment sums over all labelled training rows."""
    d = len(FEATURES)
    rows = stats.filter(~held_out_column(*held_out)).join(labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)"), "doc_id")
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    x = F.col("x")
    sums = rows.groupBy("quality").agg(F.count("*").alias("n"), *(F.sum(x[i]).alias(f"m{i}") for i in range(d)), *(F.sum(x[i] * x[j]).alias(f"c{i}_{j}") for i, j in cells)).collect()
    found = {}
    for r in sums:
        n, mean = r["n"], np.array([r[f"m{i}"] for i in range(d)]) / r["n"]
        second = np.zeros((d, d))
        for i, j in cells:
            second[i, j] = second[j, i] = r[f"c{i}_{j}"] / n
        found[r["quality"]] = (n, mean, second - np.outer(mean, mean))
    if len(found) < 2 or min(n for n, _, _ in found.values()) < 2:
        return None
    total = sum(n for n, _, _ in found.values())
    pooled = sum(n * cov for n, _, cov in found.values()) / total
    model = {}
    for k, (n, mean, cov) in found.items():
        shrunk = (1 - shrinkage) * cov + shrinkage * pooled + ridge * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        model[k] = (mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n / total))
    return model


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-density difference of class 1 and class 0, priors included."""
    side = {}
    for k, (mean, whiten, logdet, prior) in model.items():
        z = (x - mean) @ whiten.T
        side[k] = prior - 0.5 * (np.einsum("ij,ij->i", z, z) + logdet)
    return side[1] - side[0]


def score(docs: DataFrame, labels: DataFrame, held_out=HELD_OUT, threshold: float = THRESHOLD, **regular) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    stats = stored(features(docs), "quality-stats")
    model = fit(stats, labels, held_out, **regular)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = 1 / (1 + np.exp(-np.clip(log_odds(model, x), -500, 500))) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    scored = stats.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out_column(*held_out).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are predicted good, all columns; repeated doc_ids are kept only if every
    such row is predicted good."""
    name = f"bad_{uuid.uuid4().hex}"
    bad = score(docs, labels, **options).filter("predicted = 0").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(name).eqNullSafe(docs["doc_id"]), "left_anti")

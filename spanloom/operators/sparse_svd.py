"""Truncated SVD of sparse TF-IDF rows, without a dense matrix of rows and terms.

The vocabulary is bounded (the MOST_TERMS most frequent terms), so a block of vectors over it is too, and is sent
to every task. A pass multiplies: each task takes its rows' weights, some hundred rows at a time, forms rows times block and the rows' transpose
times that, and adds up; Spark adds the tasks' sums by term. The driver keeps a Krylov basis over the vocabulary
and stops when the wanted singular vectors' residuals are small or the basis spans all there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import retrieval
from spanloom.session import spread, stored

# Terms of the vocabulary and components.
MOST_TERMS, COMPONENTS = 10_000, 128
BLOCK, TOLERANCE, PASSES = 32, 1e-6, 200
#: Of rows that are multiplied at once: entries, and rows.
_ENTRIES, _ROWS = 1 << 16, 256
#: Words of a block that counts its terms; from how much text on a block leaves out terms that it has fewer than LEAST times.
BLOCK_WORDS, LARGE_BYTES, LEAST = 2 << 20, 256 << 20, 6
#: Terms whose bounds reach the driver, for each wanted one.
WIDER = 4


@dataclass
class Vectors:
    """terms, their inverse document frequencies, right singular vectors (terms x k) and singular values."""

    terms: list[str]
    idf: np.ndarray
    right: np.ndarray
    values: np.ndarray
    passes: int


def _coded(words: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of words: the distinct ones, which of them each is, the list that it is in, and the places whose next word makes a term with it.
    An empty word parts texts that belong to one key."""
    flat = words.flatten().dictionary_encode()
    ids, names = flat.indices.to_numpy(), flat.dictionary
    row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
    gap = pc.equal(names, "").to_numpy(zero_copy_only=False)
    if gap.any():
        near = np.flatnonzero((row[1:] == row[:-1]) & ~gap[ids[1:]] & ~gap[ids[:-1]])
    else:
        near = np.flatnonzero(row[1:] == row[:-1])
    return names, ids, row, near


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, rising, and how often; sorts x where it is."""
    x.sort()
    first = np.flatnonzero(np.diff(x, prepend=-1))
    return x[first], np.diff(np.append(first, len(x)))


def _counting(least: int):
    """For mapInArrow: terms that a block of texts has least times or more; a row without a term for each block."""

    def counted(block: list[pa.Array]) -> pa.RecordBatch:
        names, ids, _, near = _coded(pa.concat_arrays(block))
        n = np.bincount(ids, minlength=len(names)) * (pc.utf8_length(names).to_numpy(zero_copy_only=False) > 0)
        codes, m = _runs(ids[near].astype(np.int64) * len(names) + ids[near + 1])
        one, two = np.flatnonzero(n >= least), np.flatnonzero(m >= least)
        pairs = pc.binary_join_element_wise(names.take(pa.array(codes[two] // len(names))), names.take(pa.array(codes[two] % len(names))), " ") if len(two) else pa.array([], pa.string())
        terms = pa.concat_arrays([names.take(pa.array(one)), pairs, pa.array([None], pa.string())])
        return pa.RecordBatch.from_arrays([terms, pa.array(np.concatenate([n[one], m[two], [0]]).astype(np.int64))], ["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for batch in batches:
            words = batch.column(0)
            ends = np.cumsum(words.value_lengths().to_numpy())
            lo = 0
            while lo < len(words):
                begin = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, begin + BLOCK_WORDS - held, "right")))
                block.append(words.slice(lo, hi - lo))
                held += int(ends[hi - 1] - begin)
                lo = hi
                if held >= BLOCK_WORDS or lo < len(words):
                    yield counted(block)
                    block, held = [], 0
        if block:
            yield counted(block)

    return run


def candidates(words: DataFrame, most: int, least: int) -> list[str]:
    """Terms among which are the most frequent ones (then by name), in order of name: few more than wanted.

    A block of texts names the terms that it has least times, so others are in it less often than that. What is named adds up
    to a lower bound of a term's count, and with all that may not have been named to an upper one; a term is out if that is under
    the last wanted lower bound. Those with the highest upper bounds reach the driver; if more could be in, everything is named."""
    said = words.mapInArrow(_counting(least), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))
    if least == 1:
        return sorted(r["term"] for r in said.filter("term IS NOT NULL").orderBy(F.desc("n"), F.asc("term")).limit(most).collect())
    upper = F.col("n") - (least - 1) * F.col("blocks")  # and as much for all blocks
    rows = said.withColumn("upper", upper).orderBy(F.desc(F.col("term").isNull()), F.desc("upper")).limit(WIDER * most + 1).collect()
    rest = (least - 1) * (rows[0]["blocks"] if rows else 0)
    bound = sorted((r["n"] for r in rows[1:]), reverse=True)[most - 1 : most]
    least_upper = rows[-1]["upper"] + rest if len(rows) > WIDER * most else rest
    if not bound or max(least_upper, rest) >= bound[0]:
        return candidates(words, most, 1)
    return sorted(r["term"] for r in rows[1:] if r["upper"] + rest >= bound[0])


def counted_rows(words: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, at array<int> (which of the names, rising), n array<int> (how often); rows without one of them are left out."""
    sent = words.sparkSession.sparkContext.broadcast(names)
    kind = words.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = [i for i, t in enumerate(sent.value) if " " not in t]
        double = np.array([i for i, t in enumerate(sent.value) if " " in t], np.int64)
        alone, many = pa.array([sent.value[i] for i in single], pa.string()), len(sent.value)
        firsts, seconds = (pa.array([sent.value[i].split(" ")[j] for i in double], pa.string()) for j in (0, 1))
        single = np.array(single, np.int64)
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_WORDS, "right")))
                found, ids, row, near = _coded(batch.column(1).slice(lo, hi - lo))
                place = pc.fill_null(pc.index_in(found, value_set=alone), -1).to_numpy(zero_copy_only=False)[ids]
                met = np.flatnonzero(place >= 0)
                all_met = [row[met] * many + single[place[met]]]
                f, g = (pc.fill_null(pc.index_in(x, value_set=found), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (firsts, seconds))
                here = np.flatnonzero((f >= 0) & (g >= 0))
                if len(here):
                    begins, goes = np.zeros(len(found), bool), np.zeros(len(found), bool)
                    begins[f[here]], goes[g[here]] = True, True
                    near = near[begins[ids[near]] & goes[ids[near + 1]]]
                    codes = f[here] * len(found) + g[here]
                    order = np.argsort(codes)
                    codes, which = codes[order], double[here[order]]
                    said = ids[near].astype(np.int64) * len(found) + ids[near + 1]
                    at = np.minimum(np.searchsorted(codes, said), len(codes) - 1)
                    hit = codes[at] == said
                    all_met.append(row[near[hit]] * many + which[at[hit]])
                terms, n = _runs(np.concatenate(all_met))
                rows, begin = np.unique(terms // many, return_index=True)
                offsets = pa.array(np.append(begin, len(terms)).astype(np.int32))
                if len(rows):
                    lists = (pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (terms % many, n))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), *lists], [key, "at", "n"])
                lo = hi

    return words.mapInArrow(run, f"{key} {kind}, at array<int>, n array<int>")


def totals(counted: DataFrame, names: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each term: how often it occurs, and in how many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = np.zeros(names, np.int64), np.zeros(names, np.int64)
        for batch in batches:
            at = batch.column(0).flatten().to_numpy()
            n += np.bincount(at, batch.column(1).flatten().to_numpy(), names).astype(np.int64)
            df += np.bincount(at, minlength=names)
        i = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(n[i]), pa.array(df[i])], ["i", "n", "df"])

    found = counted.select("at", "n").mapInArrow(run, "i int, n long, df long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).toArrow()
    out = np.zeros((2, names), np.int64)
    out[:, found["i"].to_numpy()] = found["n"].to_numpy(), found["df"].to_numpy()
    return out[0], out[1]


def weighed(counted: DataFrame, key: str, chosen: np.ndarray, idf: np.ndarray, names: int) -> DataFrame:
    """key, at array<int> (places among the chosen terms, rising), w array<double> (TF-IDF of unit length); rows without one are left out."""
    place, kind = np.full(names, -1, np.int32), counted.schema[key].dataType.simpleString()
    place[chosen] = np.arange(len(chosen))
    sent = counted.sparkSession.sparkContext.broadcast((place, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idf = sent.value
        for batch in batches:
            at = place[batch.column(1).flatten().to_numpy()]
            row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
            keep = at >= 0
            at, row = at[keep], row[keep]
            w = batch.column(2).flatten().to_numpy()[keep] * idf[at]
            w /= np.sqrt(np.bincount(row, w * w, batch.num_rows))[row]
            rows, begin = np.unique(row, return_index=True)
            if len(rows):
                lists = (pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)).astype(np.int32)), pa.array(x)) for x in (at, w))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *lists], [key, "at", "w"])

    return counted.select(key, "at", "n").mapInArrow(run, f"{key} {kind}, at array<int>, w array<double>")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows (first, end) of a bounded number of entries: places, weights, and where each row begins."""
    at, w = batch.column(batch.schema.get_field_index("at")), batch.column(batch.schema.get_field_index("w"))
    ends = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
    flat, weight = at.flatten().to_numpy(), w.flatten().to_numpy()
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + _ROWS, max(lo + 1, int(np.searchsorted(ends, ends[lo] + _ENTRIES, "right")) - 1))
        a, b = ends[lo], ends[hi]
        yield lo, hi, flat[a:b], weight[a:b], ends[lo:hi] - a
        lo = hi


def _filled(at: np.ndarray, w: np.ndarray, begin: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """A few rows as a dense matrix over the terms that they have, and these: products of that take a fraction of the time of sums over entries."""
    met = np.zeros(terms, bool)
    met[at] = True
    used = np.flatnonzero(met)
    place = np.cumsum(met) - 1
    x = np.zeros((len(begin), len(used)))
    x[np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(at)))), place[at]] = w
    return x, used


def squared(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The rows' transpose times the rows times a block of vectors over the vocabulary: one pass."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(block)  # vocabulary times block: bounded by MOST_TERMS * BLOCK
    width = block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = sent.value
        total, met = np.zeros_like(z), np.zeros(len(z), bool)
        for batch in batches:
            for lo, hi, at, w, begin in _blocks(batch):
                x, used = _filled(at, w, begin, len(z))
                total[used] += x.T @ (x @ z[used])
                met[used] = True
        i = np.flatnonzero(met)
        if len(i):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(i) * width + 1, width, dtype=np.int32)), pa.array(total[i].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), lists], ["i", "v"])

    tasks = rows.select("at", "w").mapInArrow(run, "i int, v array<double>")
    found = tasks.groupBy("i").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(width))).alias("v")).toArrow()
    out = np.zeros_like(block)
    if found.num_rows:
        out[found["i"].to_numpy()] = found["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    sent.unpersist()
    return out


def fit(rows: DataFrame, terms: int, k: int, tolerance: float = TOLERANCE, seed: int = 42) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest singular values (falling) and right singular vectors of the rows, each with its largest entry positive."""
    rng = np.random.default_rng(seed)
    k = min(k, terms)
    basis = image = np.zeros((terms, 0))
    new = np.linalg.qr(rng.standard_normal((terms, min(terms, max(BLOCK, -(-k // 2))))))[0]
    for passes in range(1, PASSES + 1):
        product = squared(rows, new)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        right = basis @ turn
        left = np.linalg.norm(image @ turn - right * values, axis=0).max(initial=0)
        if basis.shape[1] >= terms or basis.shape[1] >= k and left <= tolerance * max(values[0], 1e-300):
            break
        for _ in range(2):
            product = product - basis @ (basis.T @ product)
        q, r = np.linalg.qr(product)
        gone = np.abs(np.diag(r)) <= 1e-12 * max(values[0], 1e-300)  # the rows have nothing more that way
        q[:, gone] = rng.standard_normal((terms, gone.sum()))
        q = q[:, : terms - basis.shape[1]]
        for _ in range(2):
            q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        new = q
    else:
        raise RuntimeError(f"singular vectors did not settle in {PASSES} passes")
    sign = np.sign(right[np.abs(right).argmax(0), np.arange(right.shape[1])])
    return np.sqrt(np.maximum(values, 0)), right * np.where(sign == 0, 1, sign), passes


def reduced_rows(rows: DataFrame, key: str, right: np.ndarray) -> DataFrame:
    """key, vector: each row times the singular vectors, of unit length (a row that they do not reach is zero)."""
    sent = rows.sparkSession.sparkContext.broadcast(right)  # bounded by MOST_TERMS * COMPONENTS
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, at, w, begin in _blocks(batch):
                x, used = _filled(at, w, begin, len(sent.value))
                y = x @ sent.value[used]
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], [key, "vector"])

    return rows.select(key, "at", "w").mapInArrow(run, f"{key} {kind}, vector array<double>")


def text_vectors(df: DataFrame, key: str, text: str, k: int = COMPONENTS, most: int = MOST_TERMS, tolerance: float = TOLERANCE) -> tuple[DataFrame, Vectors]:
    """key, vector of each text (unit length; k components at most, fewer if there are fewer texts or terms), and the model.
    Texts without a term of the vocabulary get no row. With two texts or terms at most the weights themselves are the vector."""
    # words are read twice, to find the vocabulary and to count it in each text: no row a term is made, and texts of distinct keys do not move
    n = df.select(key).distinct().count()
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    words = spread(df.select(key, text)).select(key, retrieval.words(F.col(text)).alias("words"))
    if rows != n:
        words = words.groupBy(key).agg(F.flatten(F.collect_list(F.concat("words", F.array(F.lit(""))))).alias("words"))
    near = candidates(words.select("words"), most, LEAST if size >= LARGE_BYTES else 1)
    counted = stored(counted_rows(words, key, near), "counted-rows")
    total, df_of = totals(counted, len(near))
    chosen = np.sort(np.lexsort((np.arange(len(near)), -total))[:most])
    names, idf = [near[i] for i in chosen], np.log((1 + n) / (1 + df_of[chosen])) + 1
    rows = stored(weighed(counted, key, chosen, idf, len(near)), "sparse-rows")
    least = min(n, len(names))
    if least <= 2:
        values, right, passes = np.ones(len(names)), np.eye(len(names)), 0
    else:
        values, right, passes = fit(rows, len(names), min(k, least - 1), tolerance)
    return reduced_rows(rows, key, right), Vectors(names, idf, right, values, passes)

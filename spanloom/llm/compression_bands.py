"""Quality rule by compression: zstandard ratios inside bands that depend on length.

ratio = compressed bytes / bytes. A text passes if its whole ratio lies in the band of its byte
length, and so does each fixed chunk's ratio in the chunks' band. Repetitive text falls below,
random or encoded text above. Short texts get wide bands, as the frame's own bytes weigh there;
under 400 bytes random text is not told from prose.

Defined cases: null and empty texts have no words, no ratio, and fail the word minimum; repeated
rows are each judged; other columns are ignored by :func:`judge` and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from spanloom.llm._stats import base_statistics
from spanloom.llm._words import Words, texts_of, trimmed

#: Up to so many bytes: least and greatest ratio of the whole text. The greatest stand a little
#: above what texts of sf0.1 reach (0.86 up to 400 bytes, 0.54 up to 3200, 0.44 up to 25600).
BANDS = (
    (100, 0.50, 2.50), (200, 0.45, 1.15), (400, 0.45, 0.92), (800, 0.46, 0.78), (1600, 0.44, 0.68),
    (3200, 0.42, 0.60), (6400, 0.41, 0.58), (12800, 0.39, 0.56), (25600, 0.37, 0.54), (1 << 62, 0.30, 0.53),
)
#: Bytes of a chunk, and its band; a shorter rest belongs to the whole text's ratio only.
CHUNK, CHUNK_BAND = 4096, (0.25, 0.58)
LEVEL = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunk_low double, chunk_high double, kept boolean"


def ratios(raw: memoryview, compressor: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float, float, float]:
    """Of the whole text, and the least and greatest of its full chunks (the whole, if none)."""
    n = len(raw)
    if n == 0:
        return float("nan"), float("nan"), float("nan")
    whole = len(compressor.compress(raw)) / n
    parts = [len(compressor.compress(raw[i : i + chunk])) / chunk for i in range(0, n - chunk + 1, chunk)] or [whole]
    return whole, min(parts), max(parts)


def judge(docs: DataFrame, bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, level: int = LEVEL) -> DataFrame:
    """One row per document: base statistics, ratios and the verdict."""
    tops, lows, highs = (np.array(x) for x in zip(*bands, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, bounds in texts_of(batch):
                w = Words(data, bounds)
                stats = base_statistics(w)
                raw = memoryview(np.ascontiguousarray(data))
                r = np.array([ratios(raw[bounds[i] : bounds[i + 1]], compressor, chunk) for i in range(hi - lo)]).reshape(-1, 3)
                band = np.searchsorted(tops, np.diff(bounds))
                long_enough = np.diff(bounds) >= chunk
                fine = (r[:, 0] >= lows[band]) & (r[:, 0] <= highs[band])
                fine &= ~long_enough | ((r[:, 1] >= chunk_band[0]) & (r[:, 2] <= chunk_band[1]))
                failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])
                empty = np.diff(bounds) == 0
                number = lambda i, r=r, empty=empty: pa.array(r[:, i], mask=empty)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(lo, hi - lo), **{k: pa.array(v) for k, v in stats.items()}, "base_failed": pa.array(failed), "ratio": number(0), "chunk_low": number(1), "chunk_high": number(2), "kept": pa.array(~failed & fine)})

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)

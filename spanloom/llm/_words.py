"""Vectorised words of many texts: positions, 64-bit hashes and rolling window hashes.

Texts stay one UTF-8 buffer. A word is a run of bytes outside ASCII white space, so words never
need a Python object each. A run's hash takes in eight bytes at a time, each step a full mix of
what came before (long runs: XXH64); windows are joined pair by pair, mixed at each join. So two
of n different words or windows meet with probability about n**2 / 2**65, repetitive ones too.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 19
#: Bytes of a run from which on it is hashed by itself.
LONG_RUN = 256

_u64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = _u64(0x9E3779B97F4A7C15)
_UNBASE = _u64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> _u64(30))
    x = x * _u64(0xBF58476D1CE4E5B9)
    x ^= x >> _u64(27)
    x *= _u64(0x94D049BB133111EB)
    x ^= x >> _u64(31)
    return x


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=_u64)
        have[0] = 1
        have = np.cumprod(have, dtype=_u64)
        if size <= 4 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def run_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes data[start:end]."""
    length = ends - starts
    out = mix(length.astype(_u64) * _BASE + _u64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((length > 0) & (length <= LONG_RUN))
    begin, left = starts[live], length[live]
    while len(live):
        part = lanes[begin]
        short = left < 8
        part[short] &= (_u64(1) << (left[short] * 8).astype(_u64)) - _u64(1)
        out[live] = mix(out[live] ^ part)
        more = left > 8
        live, begin, left = live[more], begin[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG_RUN).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return out


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = x * _BASE
    out += (y ^ (y >> _u64(31))) * _u64(0xBF58476D1CE4E5B9)
    out ^= out >> _u64(32)
    out *= _u64(0x94D049BB133111EB)
    out ^= out >> _u64(29)
    return out


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; len(words) - k + 1 of them, none if there are fewer."""
    if len(words) < k:
        return np.zeros(0, dtype=_u64)
    out, size = words, 1
    while size < k:
        step = min(size, k - size)
        out = _join(out[: len(out) - step], out[step:])
        size += step
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the first place of each, and which of them each place holds.

    Values are hashes: they are sorted with their places in the low bits, several times faster
    than by an index; where hashes differ in the low bits only, by index after all."""
    n = len(x)
    if n == 0:
        return x, np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = _u64(max(1, int(n - 1).bit_length()))
    low = (_u64(1) << bits) - _u64(1)
    k = (x & ~low) | np.arange(n, dtype=_u64)
    k.sort()
    order = (k & low).astype(np.int64)
    values = x[order]
    new = np.ones(n, bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    k >>= bits
    if (new[1:] & (k[1:] == k[:-1])).any():
        return np.unique(x, return_index=True, return_inverse=True)
    del k
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(new) - 1
    return values[new], order[new], which


class Words:
    """The words of some texts. data: all bytes; bounds: where each text begins, and the end;
    start, end: of each word; doc: the text it is in; first: index of each text's first word,
    and the number of words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data = data = _LOWER[data] if lower else data
        self.bounds = bounds
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        here, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(here & (~before | edge))
        self.end = np.flatnonzero(before & (~here | edge))
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return run_hash(self.data, self.start, self.end)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    lo, hi = int(bounds[0]), int(bounds[-1])
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, np.uint8)
    return data, bounds - lo


def slices(data: np.ndarray, bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts texts into runs of about size bytes: (first text, end text, bytes, bounds)."""
    n, at = len(bounds) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    yield from slices(*buffers(batch.column(batch.schema.get_field_index(column))))


def remainder(ids: list, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo modulus; a null id counts as empty text."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % modulus for x in ids], dtype=np.int64)


def trim() -> None:
    """Gives freed memory back to the system, Arrow's too: a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def trimmed(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back at the end of a task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values over each text's words."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]

"""Best-fit packing of token sequences by minimum bin slack.

Documents become token pieces of at most ``capacity``. All that packing depends on is how many
pieces there are of each length, at most ``capacity`` numbers, at any corpus size. On these the
driver plans: a bin takes the longest length left, and the fullest feasible combination of the
lengths that remain, found by subset sums in a bitset; that combination is then removed as
often as its lengths last. Pieces find their place from their rank among those of their length,
which is a count within their task plus a prefix sum over tasks.

Defined cases: null and empty texts are the closing id alone, one piece of length 1; repeated
rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm._words import _LOWER, Words, buffers, distinct, run_hash, slices, trimmed
from spanloom.session import stored

CAPACITY, CLOSING = 4096, 1
#: Words, and parts of words, whose ids a worker remembers, and bytes of text encoded at a time.
CACHE, SLICE = 800_000, 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, rank long"
_tokenizers: dict = {}
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[list(_SIGNS.encode())] = True


def _gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[at[i]:at[i + 1]] for i in which, one after another, and where each ends."""
    n = at[which + 1] - at[which]
    ends = np.cumsum(n)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at[which] - (ends - n), n)], ends


class Runs:
    """Runs of ids, each under the 64-bit hash of its word, in one growing array."""

    def __init__(self):
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The run of each hash, -1 where there is none."""
        if len(self.hashes) == 0:
            return np.full(len(hashes), -1, np.int64)
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[i] == hashes, self.place[i], -1)

    def add(self, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Runs of n ids each under new, distinct hashes."""
        have = len(self.hashes)
        begin = int(self.at[have])
        while begin + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while have + len(hashes) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[begin : begin + len(ids)] = ids
        self.at[have + 1 : have + 1 + len(hashes)] = begin + np.cumsum(n)
        order = np.argsort(hashes)
        to = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.place = np.insert(self.hashes, to, hashes[order]), np.insert(self.place, to, have + order)


class WordEncoder:
    """Token ids of texts, word by word: the vocabulary drops white space and never merges across
    it. A word of plain letters (of ASCII and Latin-1), maybe with signs after them, is encoded as
    those two parts, the letters in lower case. Only parts that are new are looked at one by one;
    ids of words and parts are remembered under their hashes, up to a bound."""

    MARK, GROUP = "\x01", 200

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._each([self.MARK])[0]
        samples = ("Ab.", "ÉÀ)", "x<|", "It...", "Zz\\", "a,")
        self.parted = all(sum(self._each([w.rstrip(_SIGNS).lower(), w[len(w.rstrip(_SIGNS)) :]]), []) == self._each([w])[0] for w in samples)
        self.words, self.parts = Runs(), Runs()

    def _each(self, parts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(parts, add_special_tokens=False)]

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts and how many each has; many parts go to the tokenizer as one text, with
        a mark between them that no other text has the id of."""
        if len(self.mark) == 1 and not any(self.MARK in p for p in parts):
            texts = [f" {self.MARK} ".join(parts[i : i + self.GROUP]) + f" {self.MARK}" for i in range(0, len(parts), self.GROUP)]
            ids = np.array([i for e in self._each(texts) for i in e], np.uint32)
            mark = ids == self.mark[0]
            if mark.sum() == len(parts):
                return ids[~mark], np.diff(np.flatnonzero(mark), prepend=-1) - 1
        each = self._each(parts)
        return np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Remembers the words data[start:end], all new."""
        if len(self.parts.hashes) > CACHE:
            self.parts = Runs()
        middle, lower = end, data
        if self.parted:
            first = np.append(data[1:], np.uint8(0))
            two = (data == 0xC3) & (first >= 0x80) & (first <= 0xBF) & (first != 0x97) & (first != 0xB7)
            second = np.concatenate([[False], two[:-1]])
            stop = np.append(np.flatnonzero(~(_LETTER[data] | two | second)), len(data))
            middle = np.minimum(stop[np.searchsorted(stop, start)], end)
            stop = np.append(np.flatnonzero(~_SIGN[data]), len(data))
            plain = (middle > start) & (stop[np.searchsorted(stop, middle)] >= end)
            middle = np.where(plain, middle, end)
            lower = np.where(second & (data >= 0x80) & (data <= 0x9E), data + np.uint8(32), _LOWER[data])
        # each word is two parts, the second maybe empty
        flags = np.column_stack([plain if self.parted else np.zeros(len(start), bool), np.zeros(len(start), bool)]).ravel()
        begins, ends = np.column_stack([start, middle]).ravel(), np.column_stack([middle, end]).ravel()
        key = run_hash(data, begins, ends)
        key[flags] = run_hash(lower, begins[flags], ends[flags])
        keys, at, which = distinct(key)
        new = np.flatnonzero(self.parts.numbers(keys) < 0)
        raw = (data.tobytes(), lower.tobytes())
        for i in range(0, len(new), 50_000):
            k = new[i : i + 50_000]
            names = [raw[f][a:b].decode() for f, a, b in zip(flags[at[k]].tolist(), begins[at[k]].tolist(), ends[at[k]].tolist(), strict=True)]
            self.parts.add(keys[k], *self._encoded(names))
        flat, ends = _gather(self.parts.flat, self.parts.at, self.parts.numbers(keys)[which])
        self.words.add(hashes, flat, np.diff(ends[1::2], prepend=0))

    def ids(self, data: np.ndarray, bounds: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the closing id, and where each text's ids begin."""
        if len(self.words.hashes) > CACHE:
            self.words = Runs()
        w = Words(data, bounds)
        keys, first, which = distinct(w.hashes())
        new = np.flatnonzero(self.words.numbers(keys) < 0)
        if len(new):
            self._learn(data, w.start[first[new]], w.end[first[new]], keys[new])
        flat, ends = _gather(self.words.flat, self.words.at, self.words.numbers(keys))
        at = np.concatenate([[0], ends, ends[-1:] + 1 if len(ends) else [1]])
        flat = np.append(flat, np.uint32(closing))
        units = np.full(len(which) + len(bounds) - 1, len(keys), np.int64)
        last = np.cumsum(w.count + 1) - 1
        inner = np.ones(len(units), bool)
        inner[last] = False
        units[inner] = which
        out, ends = _gather(flat, at, units)
        return out, np.concatenate([[0], ends[last]])


def encoder(path: str) -> WordEncoder:
    if path not in _tokenizers:
        _tokenizers[path] = WordEncoder(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = CLOSING, with_ids: bool = False) -> DataFrame:
    """One row per piece. part, rank: its number among the pieces of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, words = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer)
        for batch in batches:
            for lo, _, data, bounds in slices(*buffers(batch.column(1)), SLICE):
                ids, at = words.ids(data, bounds, closing)
                n = np.diff(at)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                begin = at[doc] + start
                order = np.argsort(length, kind="stable")
                sizes, first, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(first - seen[sizes], many)
                seen[sizes] += many
                raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
                cuts = [raw[a:b] for a, b in zip((4 * begin).tolist(), (4 * (begin + length)).tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).take(pa.array(lo + doc)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64()), "ids": pa.array([bytes(c) for c in cuts] if with_ids else [None] * len(cuts), pa.binary()),
                    "part": pa.array(np.full(len(doc), part, np.int32)), "rank": pa.array(rank),
                })

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), PIECES)


def fullest(target: int, stock: list[tuple[int, int]]) -> Counter:
    """The combination of stock (length, number; longest first) with the largest sum up to target."""
    reach, steps, mask = 1, [], (1 << (target + 1)) - 1
    for length, number in stock:
        if length > target:
            continue
        left, batch = min(number, target // length), 1
        while left:
            take = min(batch, left)
            after = (reach | reach << (take * length)) & mask
            if after != reach:
                steps.append((length, take, reach))
                reach = after
            left -= take
            batch *= 2
        if reach >> target & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= take * length
            chosen[length] += take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Combinations of lengths, and how many bins get each."""
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    order = sorted(left, reverse=True)
    while order:
        longest = order[0]
        stock = [(k, left[k] - (k == longest)) for k in order if left[k] - (k == longest) > 0]
        chosen = fullest(capacity - longest, stock) + Counter({longest: 1})
        times = min(left[k] // n for k, n in chosen.items())
        out.append((chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
        order = [k for k in order if left[k] > 0]
    return out


def places(combinations: list[tuple[Counter, int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first bin, pieces a bin, offset of the first)."""
    table: dict[int, list] = {}
    used: Counter = Counter()
    first_bin = 0
    for chosen, times in combinations:
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            table.setdefault(length, []).append((used[length], first_bin, n, offset))
            used[length] += n * times
            offset += n * length
        first_bin += times
    return {k: np.array(v, np.int64) for k, v in table.items()}


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces."""
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("part", "length", before.alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    where = places(plan(histogram, capacity))
    columns = [c for c in cut.columns if c not in ("part", "rank")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields if f.name in columns) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            bins, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            lengths, begin = np.unique(length[order], return_index=True)
            for k, rows in zip(lengths.tolist(), np.split(order, begin[1:]), strict=True):
                t = where[k]
                e = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
                over = rank[rows] - e[:, 0]
                bins[rows] = e[:, 1] + over // e[:, 2]
                offsets[rows] = e[:, 3] + over % e[:, 2] * k
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(bins), pa.array(offsets)], [*columns, "sequence_id", "offset"])

    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select(*columns, "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = CLOSING, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (null unless with_ids), sequence_id, offset."""
    return place(stored(pieces(docs, tokenizer, capacity, closing, with_ids), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from pieces packed with their ids; a sequence is at most
    capacity ids long, so each group is small."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))

"""Substring dedup by a relative Lempel-Ziv parse of the corpus against itself.

Reference. The whole corpus is the reference, indexed in blocks, each a hash range. Anchors of the
index are sampled word sequences (``seed`` words): the least hash among a window's sequences
depends on the window's words alone, so equal windows choose the same anchor at the same offset,
and neighbouring anchors of a text overlap. A block gives an anchor's reference place: the first
place in the corpus that holds it, or, to the chunk that has that place, the next chunk's.

Parse. Each document goes through its anchors from left to right; a factor begins at an anchor
that has a reference place and is extended greedily while the next anchor lies at the same distance
in the text and in the reference; words between factors are literals. Anchors of a factor
overlap, so its words equal the reference's all along. A factor of ``width`` words or more is a
duplicate span.

Boundaries. A repeated window of ``width`` words may straddle a factor's end, or follow another
place than the factor's. Blocks therefore index the windows with a repeated anchor too, and every
such window that is not inside a long factor is looked up there; those that start at two places or
more are spans as well. So the spans are all repeated windows, exactly, up to collisions of
64-bit hashes.

Both rounds go through ``_exchange``: a passage that half of all documents share is sent once by
each chunk of documents, and pairs of documents never meet.

Defined cases: null and empty texts have no words and keep an empty text; repeated rows are
separate texts, so each duplicates the other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm._exchange import Corpus, answered, ask, pack, unpack
from spanloom.llm._stats import covered, windows_inside
from spanloom.llm._words import Words, buffers, distinct, slices, window_hash

WIDTH, SEED = 35, 20
CHUNK_BYTES = 8 << 20
SCHEMA = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, factors array<struct<start:int,end:int,block:long,place:long>>, kept_text string"
_ONCE, _HERE = -2, -1


def packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to chunks of whole texts."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    held: list = []
    size = 0

    def row():
        ids = [x for h in held for x in h[0]]
        lengths = np.concatenate([h[1] for h in held])
        data = np.concatenate([h[2] for h in held])
        payload = pack(np.array([0 if x is None else x for x in ids], np.int64), np.array([x is None for x in ids], np.uint8), lengths.astype(np.int64), data)
        return pa.RecordBatch.from_pydict({"chunk": pa.array([(part << 24) + number], pa.int64()), "size": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for lo, hi, data, bounds in slices(*buffers(batch.column(1))):
            held.append((ids[lo:hi], np.diff(bounds), data))
            size += len(data) + 8 * (hi - lo)
            if size >= CHUNK_BYTES:
                yield row()
                held, size, number = [], 0, number + 1
    if held:
        yield row()


class Chunk:
    def __init__(self, payload: bytes, width: int, seed: int):
        self.ids, none, lengths, data = unpack(payload)
        self.none = none.astype(bool)
        self.words = w = Words(data, np.concatenate([[0], np.cumsum(lengths)]))
        self.at = windows_inside(w, width)  # first words of windows
        hashes = w.hashes() if len(self.at) else np.zeros(0, np.uint64)
        self.windows = window_hash(hashes, width)[self.at] if len(self.at) else hashes
        if len(self.at):
            seeds = window_hash(hashes, seed)
            span = width - seed + 1
            least = _sliding(seeds, span, np.minimum)
            self.choice = least[self.at]
            # a place is a seed if some window around it in its text chose its hash
            inside = np.zeros(len(least), np.uint64)
            inside[self.at] = self.choice
            most = _sliding(np.concatenate([np.zeros(span - 1, np.uint64), inside, np.zeros(len(seeds) - len(inside), np.uint64)]), span, np.maximum)
            self.spots = np.flatnonzero(most[: len(seeds)] == seeds)
            self.keys, first, self.which = distinct(seeds[self.spots])
            self.first = self.spots[first]
            again = np.ones(len(self.spots), bool)
            again[first] = False
            again = np.flatnonzero(again)[::-1]
            self.second = self.first.copy()
            self.second[self.which[again]] = self.spots[again]
        else:
            self.choice = self.keys = np.zeros(0, np.uint64)

    def candidates(self, table: pa.Table) -> np.ndarray:
        """Which windows have an anchor that occurs twice or more."""
        if len(self.keys) == 0:
            return np.zeros(0, bool)
        block = answered(table, 0)[0]
        return (block != _ONCE)[np.searchsorted(self.keys, self.choice)]

    def factors(self, chunk: int, table: pa.Table, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, reference block (a chunk) and place in it of each factor, in words."""
        if len(self.keys) == 0:
            return (np.zeros(0, np.int64),) * 4
        block, place = (x.astype(np.int64)[self.which] for x in answered(table, 0))
        some = block != _ONCE
        at, block, place, which = self.spots[some], block[some], place[some], self.which[some]
        here = block == _HERE
        place[here] = np.where(at[here] == self.first[which[here]], self.second[which[here]], self.first[which[here]])
        block[here] = chunk
        begin = np.ones(len(at), bool)
        begin[1:] = (np.diff(at) >= seed) | (np.diff(block) != 0) | (np.diff(place) != np.diff(at))
        head = np.flatnonzero(begin)
        tail = np.append(head[1:], len(at))[: len(head)] - 1
        return at[head], at[tail] + seed, block[head], place[head]


def _sliding(x: np.ndarray, span: int, least) -> np.ndarray:
    """least over each span consecutive values."""
    done, out = 1, x
    while done < span:
        step = min(done, span - done)
        out = least(out[: len(out) - step], out[step:])
        done += step
    return out


def _reply(kind, n, group, sent, source):
    if kind == 1:
        return [(np.bincount(group, sent[0], n) > 1)[group].astype(np.uint8)], (0, 0)
    here = np.arange(len(group))
    first = np.empty(n, np.int64)
    first[group[::-1]] = here[::-1]
    rest = here[first[group] != here][::-1]
    second = np.full(n, -1, np.int64)
    second[group[rest]] = rest
    total = np.bincount(group, sent[0], n)
    mine = first[group] == here
    other = np.where(mine, second[group], first[group])
    block = np.where(other >= 0, source[other], np.where(total[group] > 1, _HERE, _ONCE))
    return [block, np.where(other >= 0, sent[1][other], 0).astype(np.uint32)], (0, 0)


def _inside(at: np.ndarray, width: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which windows lie in one of the factors (begin, end), which are in order."""
    if len(begin) == 0:
        return np.zeros(len(at), bool)
    f = np.searchsorted(begin, at, "right") - 1
    return (f >= 0) & (at + width <= end[np.maximum(f, 0)])


def _finish(chunk, payload, table, width, seed):
    c = Chunk(payload, width, seed)
    w = c.words
    n = len(w.start)
    begin, end, block, place = (x for x in c.factors(chunk, table, seed))
    long = end - begin >= width
    factors = [x[long] for x in (begin, end, block, place)]
    starts = c.at[:0]
    if len(c.at):
        some = c.candidates(table)
        if some.any():
            keys = distinct(c.windows[some])[0]
            (twice,) = answered(table, 1)
            edge = ~_inside(c.at[some], width, *factors[:2])
            starts = c.at[some][edge][twice[np.searchsorted(keys, c.windows[some][edge])].astype(bool)]
    gone = covered(starts, width, n) if len(starts) else np.zeros(n, bool)
    if len(factors[0]):
        depth = np.zeros(n + 1, np.int32)
        np.add.at(depth, factors[0], 1)
        np.add.at(depth, factors[1], -1)
        gone |= np.cumsum(depth[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    begin, end = edge[0::2], edge[1::2]
    # factors of neighbouring texts may touch
    breaks = w.first[1:-1]
    inner = np.searchsorted(begin, breaks, "right") > np.searchsorted(end, breaks, "right")
    inner &= np.isin(breaks, begin, invert=True)
    cuts = np.unique(breaks[inner])
    begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))

    def lists(begin, end, **more):
        doc = np.searchsorted(w.first, begin, "right") - 1
        base = w.first[doc]
        columns = {"start": pa.array(begin - base, pa.int32()), "end": pa.array(end - base, pa.int32())} | {k: pa.array(v, pa.int64()) for k, v in more.items()}
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(w.count) + 1)), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    spans = lists(begin, end)
    parsed = lists(factors[0], factors[1], block=factors[2], place=factors[3])
    raw = w.data.tobytes()
    texts, s, e, first = [], w.start, w.end, w.first
    kept = ~gone
    for i in range(len(w.count)):
        at = np.flatnonzero(kept[first[i] : first[i + 1]]) + first[i]
        texts.append(b" ".join([raw[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)]).decode())
    return pa.table({"doc_id": pa.array(c.ids, pa.int64(), mask=c.none), "n_words": pa.array(w.count.astype(np.int64)), "spans": spans, "factors": parsed, "kept_text": pa.array(texts, pa.string())})


def remove_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, the duplicate spans (words, end exclusive), the long factors (words, and
    the reference block and the place in it that they were copied from) and the words that are left."""
    corpus = Corpus(docs.select("doc_id", "text"), packer, "relative-lz", CHUNK_BYTES)
    buckets = corpus.buckets

    def anchors(chunk, payload, table):
        c = Chunk(payload, width, seed)
        if len(c.keys) == 0:
            return []
        return ask(chunk, 0, c.keys, [np.bincount(c.which, minlength=len(c.keys)).astype(np.uint32), c.first.astype(np.uint32)], buckets)

    def windows(chunk, payload, table):
        c = Chunk(payload, width, seed)
        keys, _, which = distinct(c.windows[c.candidates(table)])
        return ask(chunk, 1, keys, [np.bincount(which, minlength=len(keys)).astype(np.uint32)], buckets)

    corpus.round(anchors, _reply)
    corpus.round(windows, _reply)
    return corpus.finish(lambda c, p, t: _finish(c, p, t, width, seed), SCHEMA)

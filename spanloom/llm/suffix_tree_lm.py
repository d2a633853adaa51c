"""Probabilistic suffix tree over words: training and scoring of whole corpora.

Tree. The root holds the words' smoothed unigram distribution. A context of up to ``depth``
words is a candidate if it occurs ``min_count`` times in training, and is retained as a state if
its next-word distribution diverges from that of its longest retained suffix: count times
Kullback-Leibler divergence must exceed ``penalty`` times the description length of its own
parameters (half of log count for each distinct successor). A state's distribution is smoothed
into its parent's (Witten-Bell): (c(s,w) + t(s) P(w|parent)) / (c(s) + t(s)), t: distinct
successors, so every distribution sums to 1. A word is scored by the longest suffix of what
precedes it in the document that is a state.

Scale. Counts live in hash buckets that chunks of the corpus ask (``_exchange``). Level by level
a chunk sends only n-grams whose context occurs often enough; each n-gram is sent once per chunk
however frequent it is. For the divergence sums every n-gram is owned by the first chunk that
counted it, which adds its term to its context's bucket; the bucket decides on the state. No table
of the model is ever broadcast or collected; the model grows with the corpus.

A passage that occurs twice in training forms states at every place: contexts of up to ``depth``
words need two occurrences only.

Defined cases: null and empty texts are the end token alone; repeated rows each count; a null
doc_id counts as empty text for the held-out rule; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm._exchange import Corpus, answered, ask, kinds, pack, unpack
from spanloom.llm._words import Words, distinct, mix, remainder, texts_of

DEPTH, MIN_COUNT, PENALTY = 3, 2, 1.0
CHUNK_BYTES = 5 << 20
HELD_OUT = (5, 1)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_deep long"

_END = np.uint64(0xE1D0E1D0E1D0E1D1)
_LEVEL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def packer(modulus: int, left_out: int):
    """Documents to chunks: ids, training flags, token counts, the distinct words' hashes, and
    each token as an index into them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def row():
            docs, counts, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            words, _, index = distinct(tokens)
            train = remainder([None if m else int(d) for d, m in zip(docs["id"], docs["none"], strict=True)], modulus) != left_out
            payload = pack(docs["id"], docs["none"].astype(np.uint8), train.astype(np.uint8), counts, words, index.astype(np.uint32))
            return pa.RecordBatch.from_pydict({"chunk": pa.array([(part << 24) + number], pa.int64()), "size": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, bounds in texts_of(batch):
                w = Words(data, bounds, lower=True)
                counts = w.count + 1
                tokens = np.full(int(counts.sum()), _END)
                inner = np.ones(len(tokens), bool)
                inner[np.cumsum(counts) - 1] = False
                tokens[inner] = w.hashes()
                docs = np.zeros(hi - lo, dtype=[("id", "<i8"), ("none", "?")])
                docs["id"] = [0 if x is None else x for x in ids[lo:hi]]
                docs["none"] = [x is None for x in ids[lo:hi]]
                held.append((docs, counts.astype(np.int32), tokens))
                size += len(data) + 8 * len(counts)
                if size >= CHUNK_BYTES:
                    yield row()
                    held, size, number = [], 0, number + 1
        if held:
            yield row()

    return run


class Level:
    """The n-grams of one context length in a chunk. at: the tokens whose context of that length
    is a candidate; key: distinct n-grams; which: of each such token; first: a place in at of each
    key; contexts: distinct contexts; context_of: of each token in at."""

    def __init__(self, at: np.ndarray, grams: np.ndarray, context_keys: np.ndarray, context_ids: np.ndarray):
        self.at = at
        self.key, first, which = distinct(grams)
        self.first, self.which = first.astype(np.int32), which.astype(np.int32)
        used = np.zeros(len(context_keys), bool)
        used[context_ids] = True
        self.contexts = context_keys[used]
        self.context_of = (np.cumsum(used, dtype=np.int32) - 1)[context_ids]


class State:
    """What a chunk knows: filled level by level from the answers.

    For each token: count, the training count of the n-gram that ends there at the last level
    (0: none); gram, that n-gram's hash; number, its place among the level's keys. A context of k
    words is the n-gram of the level before that ends one token earlier."""

    def __init__(self, payload: bytes, table: pa.Table, model: dict):
        self.ids, self.none, train, self.counts, self.words, index = unpack(payload)
        self.index = index.astype(np.int32)
        self.train_doc = train.astype(bool)
        self.train = np.repeat(self.train_doc, self.counts)
        ends = np.cumsum(self.counts)
        # words before a token in its document
        self.place = np.arange(len(index), dtype=np.int32) - np.repeat((ends - self.counts).astype(np.int32), self.counts)
        self.model, self.depth = model, 0
        if table is None:
            return
        (c1,) = answered(table, 0)
        self.c1 = np.abs(c1.astype(np.int64))
        self.base = ((self.c1 + 0.5) / (model["n"] + 0.5 * (model["v"] + 1)))[self.index]
        self.whole = np.int32 if model["n"] < 2**31 else np.int64
        self.p, self.count, self.deep = self.base, self.c1.astype(self.whole)[self.index], np.zeros(len(index), np.int8)
        self.key, self.number, self.gram = self.words, self.index, self.words[self.index]

    def unigrams(self) -> np.ndarray:
        return np.bincount(self.index[self.train], minlength=len(self.words)).astype(np.uint32)

    def open(self) -> Level:
        """The next level."""
        self.depth = k = self.depth + 1
        usable = np.zeros(len(self.index), bool)
        usable[1:] = self.count[:-1] >= self.model["min_count"]
        usable &= self.place >= k
        at = np.flatnonzero(usable).astype(np.int32)
        grams = mix(self.gram[at] * _LEVEL[0] + self.words[self.index[at - k]] * _LEVEL[1])
        self.level = level = Level(at, grams, self.key, self.number[at - 1])
        self.before = self.count
        self.gram = np.zeros(len(self.index), np.uint64)
        self.gram[at] = grams
        self.number = np.zeros(len(self.index), np.int32)
        self.number[at] = level.which
        self.key = level.key
        return level

    def counted(self, table: pa.Table) -> None:
        """Takes the training counts of the open level's n-grams."""
        level = self.level
        self.count = np.zeros(len(self.index), self.whole)
        self.signed = np.zeros(0, np.int64)
        if len(level.at):
            self.signed = answered(table, 2 * self.depth)[0].astype(np.int64)
            self.count[level.at] = np.abs(self.signed)[level.which]

    def smoothed(self, table: pa.Table) -> None:
        """Takes the open level's retained states: successors of each context, 0 if it is none."""
        level = self.level
        if len(level.at) == 0:
            return
        t = answered(table, 2 * self.depth + 1)[0].astype(np.int64)[level.context_of]
        use = t > 0
        at, t = level.at[use], t[use]
        self.p = self.p.copy()
        self.p[at] = (self.count[at] + t * self.p[at]) / (self.before[at - 1] + t)
        self.deep[at] = self.depth


def _grams_reply(n, group, local):
    """Training counts; the sign marks the first chunk that counted the n-gram, its owner."""
    total = np.bincount(group, local, n).astype(np.int64)
    has = np.flatnonzero(local > 0)[::-1]
    owner = np.full(n, -1, np.int64)
    owner[group[has]] = has
    owner = owner[owner >= 0]
    t = total[group]
    t[owner] = -t[owner]
    return [t.astype(np.int64 if len(t) and total.max() > 2**31 - 1 else np.int32)], (float(total.sum()), float((total > 0).sum()))


def _replying(penalty: float):
    def reply(kind, n, group, sent, source):
        if kind % 2 == 0:
            return _grams_reply(n, group, sent[0].astype(np.int64))
        terms, distinct_, count = (np.bincount(group, x, n) for x in sent)
        divergence = terms - count * np.log(np.maximum(count, 1))
        kept = (distinct_ > 0) & (divergence > penalty * 0.5 * distinct_ * np.log(np.maximum(count, 2)))
        return [np.where(kept, distinct_, 0).astype(np.uint32)[group]], (0, 0)

    return reply


def _rebuilt(payload: bytes, table: pa.Table, model: dict, upto: int) -> State:
    """Runs a chunk through the levels up to upto, of which the last may lack its states yet."""
    s = State(payload, table, model)
    there = kinds(table)
    for k in range(1, upto + 1):
        s.open()
        s.counted(table)
        if 2 * k + 1 in there:
            s.smoothed(table)
    return s


def _ask_words(chunk, payload, buckets):
    s = State(payload, None, {})
    return ask(chunk, 0, s.words, [s.unigrams()], buckets)


def _ask_level(chunk, payload, table, model, k, buckets):
    """Divergence terms of level k - 1, n-grams of level k (none beyond the depth)."""
    s = _rebuilt(payload, table, model, k - 1)
    rows = []
    if k > 1 and len(s.level.at):
        level, own = s.level, s.signed < 0
        total, first = -s.signed[own].astype(float), level.first[own]
        of, m = level.context_of[first], len(level.contexts)
        terms = np.bincount(of, total * (np.log(total) - np.log(s.p[level.at[first]])), m)
        rows += ask(chunk, 2 * k - 1, level.contexts, [terms, np.bincount(of, minlength=m).astype(np.uint32), np.bincount(of, total, m).astype(np.uint32)], buckets)
    if k <= model["depth"]:
        level = s.open()
        if len(level.at):
            train = s.train[level.at]
            rows += ask(chunk, 2 * k, level.key, [np.bincount(level.which[train], minlength=len(level.key)).astype(np.uint32)], buckets)
    return rows


def _score(payload, table, model):
    s = _rebuilt(payload, table, model, model["depth"])
    starts = np.cumsum(s.counts) - s.counts
    total = lambda a: np.add.reduceat(a, starts) if len(starts) else a
    return pa.table({
        "doc_id": pa.array(s.ids, pa.int64(), mask=s.none.astype(bool)),
        "held_out": pa.array(~s.train_doc),
        "n_tokens": pa.array(s.counts.astype(np.int64)),
        "n_known": pa.array(total((s.c1 > 0)[s.index].astype(np.int64))),
        "train_tokens": pa.array(np.full(len(starts), int(model["n"]), dtype=np.int64)),
        "base_score": pa.array(total(np.log10(s.base))),
        "score": pa.array(total(np.log10(s.p))),
        "n_deep": pa.array(total((s.deep > 0).astype(np.int64))),
    })


def score_corpus(docs: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, penalty: float = PENALTY, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """Trains on the documents whose crc32(doc_id) mod held_out[0] is not held_out[1] and scores
    all. n_deep: tokens scored by a state below the root."""
    corpus = Corpus(docs.select("doc_id", "text"), packer(*held_out), "lm", CHUNK_BYTES)
    buckets, reply = corpus.buckets, _replying(penalty)
    n, v = corpus.round(lambda c, p, t: _ask_words(c, p, buckets), reply)
    model = {"n": n, "v": v, "min_count": min_count, "depth": depth}
    for k in range(1, depth + 2):
        corpus.round(lambda c, p, t, k=k: _ask_level(c, p, t, model, k, buckets), reply)
    return corpus.finish(lambda c, p, t: _score(p, t, model), SCHEMA)

"""Line dedup by deletion-neighbourhood join: near-equal lines, edit distance counted in words.

Two lines are within one edit (a word substituted, inserted or deleted) exactly if they agree
after deleting the same word place of both, or one word of one of them. Every line emits its
variants as hashed keys; equal keys join; each line of a key is compared with the key's earliest
line (doc_id, then line number), and is dropped if the words of both, spelt out, are within one
edit. A key names the place that was deleted, so the lines of a key are all within one edit of
each other and no pair is formed in a key's group.

Four rounds (``_exchange``), each on what the last left: equal lines; halves of lines, as one
edit leaves one half as it was, so that only lines which share a half emit variants; variants;
the words of the lines that others are compared with, sent once to each chunk that needs them.

Defined cases: words are runs outside ASCII white space, A-Z lower-cased; a line with any word is
dropped if an equal line is earlier; lines under ``MIN_WORDS`` words (also long ones without blanks)
are no near copies of others, as one word is too much of them; lines without a word stay; null and empty texts have no lines and stay as they are;
repeated rows: the first that is met is the earlier; null doc_ids come first; an empty table
gives no rows; columns named like the results are replaced, all others are kept. Lines that are
equal or share a variant are compared by 64-bit hashes; of equal lines the hash decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from spanloom.llm._exchange import Corpus, Ragged, answered, ask, kinds, pack, unpack
from spanloom.llm._stats import lines_of
from spanloom.llm._words import _BASE, _UNBASE, Words, _power, buffers, distinct, mix, slices

MIN_WORDS = 6
CHUNK_BYTES = 4 << 20
_NO_DOC = np.iinfo(np.int64).min
_LENGTH, _SIDE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_u64 = np.uint64


def packer(text_at: int, id_at: int):
    """Rows with all their columns to chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def row():
            rest = pa.Table.from_batches([h[4] for h in held])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rest)
            body = pack(*(np.concatenate([h[i] for h in held]) for i in range(4)))
            payload = len(body).to_bytes(8, "little") + body + sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_pydict({"chunk": pa.array([(part << 24) + number], pa.int64()), "size": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            ids = np.array([_NO_DOC if x is None else x for x in batch.column(id_at).to_pylist()], np.int64)
            null = np.array(batch.column(text_at).is_null(), np.uint8)
            rest = batch.remove_column(text_at)
            for lo, hi, data, bounds in slices(*buffers(batch.column(text_at))):
                held.append((ids[lo:hi], np.diff(bounds), null[lo:hi], data.copy(), rest.slice(lo, hi - lo)))
                size += len(data) + 8 * (hi - lo)
                if size >= CHUNK_BYTES:
                    yield row()
                    held, size, number = [], 0, number + 1
        if held:
            yield row()

    return run


class Lines:
    """The lines of a chunk that have words; first, n: their words."""

    def __init__(self, payload: bytes, min_words: int):
        self.min_words = min_words
        at = int.from_bytes(payload[:8], "little")
        self.ids, lengths, self.null, self.raw = unpack(payload[8 : 8 + at])
        self.rest = payload[8 + at :]
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        # slice by slice, as hashing takes many times a text's size
        parts, words = [], 0
        for lo, _, data, bounds in slices(self.raw, self.bounds):
            w = Words(data, bounds, lower=True)
            start, end, doc = lines_of(w)
            first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
            parts.append((start + self.bounds[lo], end + self.bounds[lo], doc + lo, first + words, last - first, w.hashes()))
            words += len(w.start)
        if not parts:
            parts = [(np.zeros(0, np.int64),) * 5 + (np.zeros(0, _u64),)]
        self.start, self.end, self.doc, first, n, self.h = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.number = np.arange(len(self.doc)) - np.searchsorted(self.doc, self.doc)
        self.worded = np.flatnonzero(n > 0)
        self.first, self.n = first[self.worded], n[self.worded]
        self.prefix = self._prefix(self.h)
        self.key = mix(self._whole(self.prefix, self.first, self.n) + self.n.astype(_u64) * _LENGTH)
        self.line_doc = self.ids[self.doc[self.worded]]
        self.line_no = self.number[self.worded].astype(np.int32)

    @staticmethod
    def _prefix(h):
        out = np.zeros(len(h) + 1, _u64)
        np.cumsum(h * _power(_BASE, len(h)), out=out[1:])
        return out

    def _whole(self, prefix, first, n):
        return (prefix[first + n] - prefix[first]) * _power(_UNBASE, len(prefix))[first]

    def earliest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct line keys among rows, and each one's earliest row."""
        order = rows[np.lexsort((self.line_no[rows], self.line_doc[rows]))]
        keys, at, _ = distinct(self.key[order])
        return keys, order[at]

    def owners(self, table: pa.Table) -> np.ndarray:
        """Rows of lines whose earliest place in the corpus is here."""
        rows = np.arange(len(self.worded))
        keys, at = self.earliest(rows)
        if len(keys) == 0:
            return rows
        (mine,) = answered(table, 0)
        return np.sort(at[mine.astype(bool)])

    def near(self, table: pa.Table) -> np.ndarray:
        """Those of the owners that have enough words to be compared by edits."""
        rows = self.owners(table)
        return rows[self.n[rows] >= self.min_words]

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the halves of rows: key, row, and 1 where the row is a word longer than the
        line that the key stands for."""
        out = []
        f, n = self.first[rows], self.n[rows]
        for longer in (0, 1):
            m = n - longer
            head = m // 2
            tail = m - head
            tag = mix(m.astype(_u64) * _LENGTH)
            out.append((mix(self._whole(self.prefix, f, head) + tag), rows, np.full(len(rows), longer, np.uint8)))
            out.append((mix(self._whole(self.prefix, f + n - tail, tail) + tag + _SIDE), rows, np.full(len(rows), longer, np.uint8)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def words(self, row: int) -> list[bytes]:
        line = self.worded[row]
        return self.raw[self.start[line] : self.end[line]].tobytes().lower().split()

    def variants(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Deletion variants of rows: hash, row, place of the deleted word."""
        n = self.n[rows]
        row = np.repeat(rows, n)
        begin = np.repeat(self.first[rows], n)
        length = np.repeat(n, n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)

        p, prefix = begin + place, self.prefix
        raw = prefix[p] - prefix[begin] + (prefix[begin + length] - prefix[p + 1]) * _UNBASE
        raw *= _power(_UNBASE, len(prefix))[begin]
        return mix(raw + (length - 1).astype(_u64) * _LENGTH), row, place


def within_one(x: list[bytes], y: list[bytes]) -> bool:
    """Whether one word substituted, inserted or deleted, or none, makes x into y."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def _least(n: int, group: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """For each group the entry that is least in order of by; every group has one."""
    order = np.lexsort((*by[::-1], group))
    return order[np.searchsorted(group[order], np.arange(n))]


def _reply(kind, n, group, sent, source):
    if kind == 0:
        best = _least(n, group, sent[0], sent[1], source)
        return [(best[group] == np.arange(len(group))).astype(np.uint8)], (0, 0)
    if kind == 1:
        same, longer = np.bincount(group, sent[0], n), np.bincount(group, sent[1], n)
        flags = (same > 1).astype(np.uint8) | (((same > 0) & (longer > 0)).astype(np.uint8) << 1)
        return [flags[group]], (0, 0)
    if kind == 4:
        words = Ragged(sent[0], sent[1])
        owner = np.zeros(n, np.int64)
        has = np.flatnonzero(sent[0] > 0)
        owner[group[has]] = has
        return [words.take(owner[group])], (0, 0)
    # the earliest line of each key; kind 3: the earliest whole line and the earliest longer one
    out, many = [], (np.bincount(group, minlength=n) > 1)[group].astype(np.uint8)
    for whole in (None,) if kind == 2 else (1, 0):
        doc = sent[0] if whole is None else np.where(sent[3] == whole, sent[0], np.iinfo(np.int64).max)
        best = _least(n, group, doc, sent[1])[group]
        out += [doc[best], sent[1][best], sent[2][best]]
    return [many, *out], (0, 0)


def _ask_lines(payload, chunk, buckets, min_words):
    x = Lines(payload, min_words)
    keys, at = x.earliest(np.arange(len(x.worded)))
    return ask(chunk, 0, keys, [x.line_doc[at], x.line_no[at]], buckets)


def _ask_halves(payload, table, chunk, buckets, min_words):
    x = Lines(payload, min_words)
    key, _, longer = x.halves(x.near(table))
    keys, _, which = distinct(key)
    n = len(keys)
    return ask(chunk, 1, keys, [np.bincount(which[longer == 0], minlength=n).astype(np.uint32), np.bincount(which[longer == 1], minlength=n).astype(np.uint32)], buckets)


class Variants:
    """What a chunk emits in the last round. Keys of kind 2 name variant and place, those of kind
    3 the variant, or the whole line that a longer one may shrink to."""

    def __init__(self, x: Lines, table: pa.Table):
        rows = x.near(table)
        self.ready = len(rows) > 0
        if not self.ready:
            return
        key, row, longer = x.halves(rows)
        which = distinct(key)[2]
        (flags,) = answered(table, 1)
        flags = flags[which]
        equal = np.unique(row[(flags & 1).astype(bool) & (longer == 0)])
        grow = (flags & 2).astype(bool)
        short, long = np.unique(row[grow & (longer == 0)]), np.unique(row[grow & (longer == 1)])
        v, r, place = x.variants(equal)
        self.two = self._distinct(x, mix(v + mix(place.astype(_u64) + _u64(1))), r, None)
        v, r, _ = x.variants(long)
        whole = np.concatenate([np.ones(len(short), np.uint8), np.zeros(len(r), np.uint8)])
        self.three = self._distinct(x, np.concatenate([x.key[short], v]), np.concatenate([short, r]), whole)

    @staticmethod
    def _distinct(x, key, row, whole):
        """One entry a key (and kind of line): its earliest line in this chunk."""
        side = np.zeros(len(key), np.uint8) if whole is None else whole
        which = distinct(key)[2]
        # rows are numbered in the order of their documents, which need not be that of doc_ids
        rank = np.empty(len(x.line_no), np.int64)
        rank[np.lexsort((x.line_no, x.line_doc))] = np.arange(len(x.line_no))
        entry = which * 2 + side
        order = np.argsort((entry << 32) | rank[row])
        e = entry[order]
        new = np.ones(len(e), bool)
        new[1:] = e[1:] != e[:-1]
        of = np.empty(len(key), np.int64)
        of[order] = np.cumsum(new) - 1
        return {"key": key, "side": side, "row": row, "at": order[new], "of": of}

    def partners(self, x: Lines, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and the line key of an earlier line that shares a variant; rows whose words
        others may ask for."""
        rows, keys, asked = [], [], []
        for kind, e in ((2, self.two), (3, self.three)):
            if len(e["at"]) == 0:
                continue
            many, *got = (g[e["of"]] for g in answered(table, kind))
            own_doc, own_line = x.line_doc[e["row"]], x.line_no[e["row"]]
            side = e["side"].astype(bool)  # a whole line looks for a longer one, and the other way round
            doc, line, key = got if kind == 2 else (np.where(side, got[i + 3], got[i]) for i in range(3))
            first_doc, first_line = got[:2] if kind == 2 else (np.where(side, got[i], got[i + 3]) for i in range(2))
            first = (first_doc == own_doc) & (first_line == own_line)
            before = (doc < own_doc) | ((doc == own_doc) & (line < own_line))
            rows.append(e["row"][before])
            keys.append(key[before])
            asked.append(e["row"][first & many.astype(bool)])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, _u64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(keys), np.unique(np.concatenate(asked))


def _ask_variants(payload, table, chunk, buckets, min_words):
    x = Lines(payload, min_words)
    v = Variants(x, table)
    rows = []
    if v.ready:
        for kind, e in ((2, v.two), (3, v.three)):
            at = e["at"]
            values = [x.line_doc[e["row"][at]], x.line_no[e["row"][at]], x.key[e["row"][at]]]
            rows += ask(chunk, kind, e["key"][at], values + ([e["side"][at]] if kind == 3 else []), buckets)
    return rows


def _wanted(x: Lines, v: Variants, table: pa.Table) -> tuple:
    """What the last round asks: sorted line keys, the words of those that are here, and the
    (row, place among the keys) pairs to compare."""
    rows, partner, asked = v.partners(x, table)
    near = x.near(table)
    asked = np.union1d(asked, near[np.isin(x.key[near], partner)])  # lines that only this chunk compares with
    pairs = np.unique(np.column_stack([rows.astype(np.uint64), partner]), axis=0) if len(rows) else np.zeros((0, 2), np.uint64)
    keys, _, which = distinct(np.concatenate([pairs[:, 1], x.key[asked]]))
    lines = [b""] * len(keys)
    for row, k in zip(asked.tolist(), which[len(pairs) :].tolist(), strict=True):
        lines[k] = b" ".join(x.words(row))
    words = Ragged(np.array([len(t) for t in lines], np.int64), np.frombuffer(b"".join(lines), np.uint8))
    return keys, words, pairs[:, 0].astype(np.int64), which[: len(pairs)]


def _ask_words(payload, table, chunk, buckets, min_words):
    x = Lines(payload, min_words)
    v = Variants(x, table)
    if not v.ready:
        return []
    keys, words, _, _ = _wanted(x, v, table)
    return ask(chunk, 4, keys, [words], buckets)


def _finish(payload, table, min_words, schema, counted: str, removed_as: str):
    x = Lines(payload, min_words)
    rows = np.arange(len(x.worded))
    gone = np.ones(len(rows), bool)
    owners = x.owners(table)
    gone[owners] = False
    v = Variants(x, table)
    if v.ready and 4 in kinds(table):
        _, _, row, which = _wanted(x, v, table)
        words = Ragged(*answered(table, 4))
        for r, k in zip(row.tolist(), which.tolist(), strict=True):
            if not gone[r] and within_one(words[k].split(), x.words(r)):
                gone[r] = True
    lost = x.worded[gone]
    raw = x.raw.tobytes()
    n = len(x.ids)
    texts: list = []
    removed = np.zeros(len(x.start), bool)
    removed[lost] = True
    first = np.searchsorted(x.doc, np.arange(n + 1))
    touched = np.zeros(n, bool)
    touched[x.doc[lost]] = True
    report = []
    for i in range(n):
        lo, hi = first[i], first[i + 1]
        if touched[i]:
            keep = np.flatnonzero(~removed[lo:hi]) + lo
            texts.append(b"\n".join([raw[a:b] for a, b in zip(x.start[keep].tolist(), x.end[keep].tolist(), strict=True)]).decode())
            report.append(x.number[lo:hi][removed[lo:hi]].tolist())
        else:
            texts.append(raw[x.bounds[i] : x.bounds[i + 1]].decode())
            report.append([])
    rest = pa.ipc.open_stream(x.rest).read_all()
    null = x.null.tolist()
    made = {"text": pa.array([None if z else t for t, z in zip(texts, null, strict=True)], pa.string()), counted: pa.array(np.diff(first).astype(np.int64)), removed_as: pa.array(report, pa.list_(pa.int64()))}
    return pa.table({name: made[name] if name in made else rest[name] for name in schema})


def drop_near_lines(docs: DataFrame, min_words: int = MIN_WORDS, counted: str = "n_lines", removed: str = "removed_lines") -> DataFrame:
    """docs with each later near-equal line taken out of its text; the number of lines before and the
    numbers of those taken out (from 0) are added under the names counted and removed, in place of
    columns of docs that have these names."""
    docs = docs.drop(counted, removed)
    schema = StructType(list(docs.schema.fields)).add(counted, LongType()).add(removed, ArrayType(LongType()))
    names = schema.names
    corpus = Corpus(docs, packer(docs.columns.index("text"), docs.columns.index("doc_id")), "lines", CHUNK_BYTES)
    buckets = corpus.buckets
    corpus.round(lambda c, p, t: _ask_lines(p, c, buckets, min_words), _reply)
    corpus.round(lambda c, p, t: _ask_halves(p, t, c, buckets, min_words), _reply)
    corpus.round(lambda c, p, t: _ask_variants(p, t, c, buckets, min_words), _reply)
    corpus.round(lambda c, p, t: _ask_words(p, t, c, buckets, min_words), _reply)
    return corpus.finish(lambda c, p, t: _finish(p, t, min_words, names, counted, removed), schema)


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def without_near_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with each later near-equal line taken out of its text; all other columns as they are."""
    counted, removed = (f"{name}_{uuid.uuid4().hex}" for name in ("lines", "removed"))
    return drop_near_lines(docs, min_words, counted, removed).drop(counted, removed)

"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of slots holds every language's Bloom filter: bit l of a slot belongs to language l.
An n-gram's slots, ANDed, give the set of languages whose filter contains it. A text's votes for
a language are the count of its n-grams with that bit, corrected for the filter's false
positives; the largest share of votes decides.

An n-gram enters a language's filter if it makes up at least ``floor`` of the language's training
n-grams and at least ``relative`` of its share in the language where it is most frequent, so
filters hold at most 1 / floor n-grams a language, at any corpus size, and the table, whose size is
fixed, may be broadcast. Counts cover every training document.

Defined cases: null texts and texts without a letter give ``und`` with score 0, as does
everything if nothing can be learned; ties go to the first language by name, and so do texts
without an n-gram, which have one letter; repeated rows each count; an empty table gives no rows.
Every 64 languages take another table of masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm._words import mix, per_doc, remainder, texts_of, trimmed

GRAM, FLOOR, RELATIVE = 4, 1e-6, 0.15
SLOT_BITS, HASHES = 22, 2
SLICE_BITS, WORD = 16, 64
HELD_OUT = (4, 2)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_fold: list = []


def _folding() -> np.ndarray:
    """Code point to its lower-case letter, 0 if it is no letter."""
    if not _fold:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _fold.append(table)
    return _fold[0]


def grams(data: np.ndarray, bounds: np.ndarray, width: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n-grams of folded letters, a gap between words being one blank, as are a text's two
    ends; the first n-gram of each text, and the end; the letters in each text."""
    data = np.insert(data, np.sort(np.concatenate([bounds[:-1], bounds[1:]])), 32)
    bounds = bounds + 2 * np.arange(len(bounds))
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    at = starts[bounds]
    letters = _folding()[points]
    blank = letters == 0
    doc_start = np.zeros(len(points) + 1, bool)
    doc_start[at] = True
    take = ~blank | ~np.concatenate([[True], blank[:-1]])[: len(blank)] | doc_start[:-1]
    place = np.zeros(len(points) + 1, np.int64)
    np.cumsum(take, out=place[1:])
    first = place[at]
    kept = letters[take].astype(np.uint64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    n_letters = np.bincount(doc[kept > 0], minlength=len(bounds) - 1)
    n = len(kept) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), n_letters
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * _MULTIPLIER + kept[i : i + n] + np.uint64(1)
    inside = doc[:n] == doc[width - 1 :]
    return mix(h[inside]), np.searchsorted(doc[:n][inside], np.arange(len(bounds))), n_letters


def slots(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> np.uint64(i * SLOT_BITS % 42)) & np.uint64((1 << SLOT_BITS) - 1) for i in range(HASHES)]


def counts(docs: DataFrame, held_out=HELD_OUT) -> DataFrame:
    """lang, gram, n over all training documents; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts):
            keys = np.concatenate([p[0] for p in parts])
            k, which = np.unique(keys, return_inverse=True)
            return [(k, np.bincount(which, np.concatenate([p[1] for p in parts])).astype(np.int64))]

        for batch in batches:
            train = remainder(batch.column(0).to_pylist(), held_out[0]) != held_out[1]
            langs = np.array(batch.column(2).to_pylist(), dtype=object)
            for lo, hi, data, bounds in texts_of(batch):
                h, first, _ = grams(data, bounds)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                for lang in sorted({x for x in langs[lo:hi] if x is not None}):
                    mine = h[((langs[lo:hi] == lang) & train[lo:hi])[doc]]
                    if len(mine):
                        parts = held.setdefault(lang, [])
                        parts.append(np.unique(mine, return_counts=True))
                        if sum(len(p[0]) for p in parts) > 1_000_000 and len(parts) > 1:
                            held[lang] = merged(parts)
        for lang, parts in held.items():
            ((k, n),) = merged(parts)
            for i in range(0, len(k), 50_000):
                part = k[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(part)), "gram": pa.array(part.view(np.int64)), "n": pa.array(n[i : i + 50_000])})

    return docs.select("doc_id", "text", "lang").mapInArrow(trimmed(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, held_out=HELD_OUT, floor: float = FLOOR, relative: float = RELATIVE) -> tuple[list[str], np.ndarray]:
    """The languages, and the slots' bit masks."""
    from spanloom.session import discard, stored

    found = stored(counts(docs, held_out), "language-grams")
    totals = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    table = np.zeros((max(1, -(-len(langs) // WORD)), 1 << SLOT_BITS), kind)
    if langs:
        total = F.create_map(*(F.lit(x) for pair in totals.items() for x in pair))
        bit = F.create_map(*(F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)))
        shares = found.select("gram", bit[F.col("lang")].alias("bit"), (F.col("n") / total[F.col("lang")]).alias("share")).filter(F.col("share") >= floor)
        members = shares.groupBy("gram").agg(F.collect_list(F.struct("bit", "share")).alias("in"), F.max("share").alias("most")).select("gram", F.filter("in", lambda x: x["share"] >= relative * F.col("most"))["bit"].alias("bits"))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                all_bits = batch.column(1).to_pylist()
                for word in range(len(table)):
                    masks = np.array([sum(1 << b % WORD for b in bits if b // WORD == word) for bits in all_bits], dtype=np.uint64)
                    for s in slots(h[masks > 0]):
                        yield pa.RecordBatch.from_pydict({"word": pa.array(np.full(len(s), word, np.int32)), "slot": pa.array(s.astype(np.int64)), "mask": pa.array(masks[masks > 0].view(np.int64))})

        def piece(t: pa.Table) -> pa.Table:
            s = t["slot"].to_numpy()
            out = np.zeros(1 << SLICE_BITS, np.uint64)
            np.bitwise_or.at(out, s & ((1 << SLICE_BITS) - 1), t["mask"].to_numpy().view(np.uint64))
            return pa.table({"word": t["word"].slice(0, 1), "piece": pa.array([int(s[0]) >> SLICE_BITS], pa.int64()), "body": pa.array([out.astype(kind).tobytes()], pa.binary())})

        # one piece of a table a row: its size is that of the table, fixed, whatever the corpus
        pieces = members.mapInArrow(part, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).groupBy("word", F.shiftright("slot", SLICE_BITS).alias("piece")).applyInArrow(piece, "word int, piece long, body binary")
        for r in pieces.collect():
            table[r["word"], r["piece"] << SLICE_BITS : (r["piece"] + 1) << SLICE_BITS] = np.frombuffer(bytes(r["body"]), kind)
    discard(found)
    return langs, table


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, held_out=HELD_OUT) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    bit = lambda x, i: x >> x.dtype.type(i % WORD) & x.dtype.type(1)
    false = [float(bit(table[i // WORD], i).mean()) ** HASHES for i in range(len(langs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_masks = shared.value
        for batch in batches:
            out = remainder(batch.column(0).to_pylist(), held_out[0]) == held_out[1]
            for lo, hi, data, bounds in texts_of(batch):
                h, first, letters = grams(data, bounds)
                places = slots(h)
                masks = [reduce(np.bitwise_and, (words[s] for s in places)) for words in slot_masks]
                n = np.diff(first)
                votes = np.zeros((hi - lo, max(len(langs), 1)))
                for i, f in enumerate(false):
                    hits = per_doc(bit(masks[i // WORD], i).astype(np.int64), first)
                    votes[:, i] = np.maximum(hits - n * f, 0) / (1 - f if f < 1 else 1)
                total = votes.sum(1)
                best = votes.argmax(1)
                some = (letters > 0) & bool(langs)
                share = np.where(total > 0, votes[np.arange(hi - lo), best] / np.where(total > 0, total, 1), 1 / max(len(langs), 1))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(lo, hi - lo), "held_out": pa.array(out[lo:hi]),
                    "lang_pred": pa.array([langs[b] if ok else "und" for b, ok in zip(best, some, strict=True)], pa.string()), "score": pa.array(np.where(some, share, 0.0)),
                })

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, held_out=HELD_OUT) -> DataFrame:
    return predict(docs, *fit(docs, held_out), held_out)

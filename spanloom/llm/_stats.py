"""Plain statistics of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np

from spanloom.llm._words import Words, distinct, mix, per_doc, run_hash, window_hash

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_REPEAT = 3


def lines_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each line; what follows a text's last line feed is no line if empty."""
    data, bounds = w.data, w.bounds
    starts = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10))
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def repeats(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each entry: how many of its document's entries have its key."""
    both = mix(keys + mix(doc.astype(np.uint64) + np.uint64(1)))
    keys, _, which = distinct(both)
    return np.bincount(which, minlength=len(keys))[which]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of the width that begins at one of starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def windows_inside(w: Words, width: int) -> np.ndarray:
    """First words of the windows that stay in one text."""
    doc = w.doc
    n = len(doc) - width + 1
    return np.flatnonzero(doc[:n] == doc[width - 1 :]) if n > 0 else np.zeros(0, np.int64)


def base_statistics(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, bounds, docs = w.data, w.bounds, len(w.count)

    def bytes_where(mask):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total

    points = bytes_where((data & 0xC0) != 0x80)
    symbols = bytes_where(_SYMBOL[data])
    starts, ends, line_doc = lines_of(w)
    worded = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_doc = starts[worded], ends[worded], line_doc[worded]
    if len(starts):
        keys = mix(run_hash(data, starts, ends) + mix(line_doc.astype(np.uint64) + np.uint64(1)))
        _, first, _ = distinct(keys)
        again = np.ones(len(keys), bool)
        again[first] = False
        dup = np.bincount(line_doc[again], minlength=docs)
    else:
        dup = np.zeros(docs, np.int64)
    at = windows_inside(w, _REPEAT)
    if len(at):
        hashes = w.hashes()
        doc = w.doc
        twice = at[repeats(doc[at], window_hash(hashes, _REPEAT)[at]) > 1]
        repeated = per_doc(covered(twice, _REPEAT, len(doc)).astype(np.int64), w.first)
    else:
        repeated = np.zeros(docs, np.int64)
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": per_doc(points[w.end] - points[w.start], w.first),
        "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]],
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": repeated.astype(np.int64),
    }

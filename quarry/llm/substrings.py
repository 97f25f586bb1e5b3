"""Removal of repeated word sequences by recompression.

A document's words become symbols, and rounds rewrite the symbol sequence: a run of one symbol becomes a symbol of its
own, then each symbol draws a side (left or right) from its name, and every left symbol followed by a right one fuses
with it. A name is a 64-bit hash of what it is made of, so runs and pairs are named alike in all documents without a
dictionary to exchange. Whether and how a symbol forms depends only on its neighbours, so each symbol knows the
stretch of words that decides it (its context), and a window of 50 words that holds the whole context holds that
symbol wherever the window stands. Of the highest-level symbols inside a window by this rule the one with the least
name (the leftmost on ties) stands for the window; where none fits, symbols one level lower do, down to single words.

Shared symbols reveal the repeats: Spark compares their contexts, then the words that their windows cover, then single
windows where those differ (see windows.py), which verifies every repeat.

Defined results: null, empty and blank texts have no words; texts with fewer than 50 words lose nothing; long texts
are scanned whole; only a smaller doc_id makes a window a repeat, so rows of one doc_id are never removed for each
other; a document with a null doc_id comes after all others; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quarry.llm.windows import Arrays, Method, content_hashes, grouped_runs, without_repeats

WINDOW, ROUNDS = 50, 3


def split_text(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_units(text: str) -> np.ndarray:
    parts = split_text(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))


def fused(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The name of a pair of names."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    x ^= x >> np.uint64(29)
    x = (x + b) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def rewritten(name: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray, starts: np.ndarray, new: np.ndarray, end: int) -> tuple:
    """The sequence after a step: symbols begin at `starts` with names `new`; contexts grow by a neighbour each way."""
    stops = np.append(starts[1:], len(name)) - 1
    low = np.where(starts > 0, left[np.maximum(starts - 1, 0)], -1)
    high = np.where(stops + 1 < len(name), right[np.minimum(stops + 1, len(name) - 1)], end + 1)
    return new, low, high, at[starts]


def levels(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level the symbols' names, context bounds [left, right) in words, and first words.

    A context that would need words beyond the text's ends reaches outside, where no window holds it.
    """
    n = len(words)
    places = np.arange(n)
    out = [(words, places, places + 1, places)]
    for turn in range(ROUNDS):
        name, left, right, at = out[-1]
        starts, counts = grouped_runs(name)
        new = name[starts]
        many = counts > 1
        if many.any():
            new = np.where(many, fused(new, counts.astype(np.uint64), 3 * turn + 1), new)
        name, left, right, at = rewritten(name, left, right, at, starts, new, n)
        side = fused(name, name, 3 * turn + 2) >> np.uint64(63)
        pair = (side[:-1] == 1) & (side[1:] == 0)
        second = np.concatenate([[False], pair])
        starts = np.flatnonzero(~second)
        ahead = np.append(pair, False)[starts]
        new = name[starts]
        new = np.where(ahead, fused(new, name[np.minimum(starts + 1, len(name) - 1)], 3 * turn + 3), new)
        out.append(rewritten(name, left, right, at, starts, new, n))
    return out


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the least value in each [low, high] (low <= high), the leftmost on ties, by a sparse table."""
    table, length = [np.arange(len(values))], 1
    while 2 * length <= int((high - low).max()) + 1:
        a, b = table[-1][:-length], table[-1][length:]
        table.append(np.where(values[b] < values[a], b, a))
        length *= 2
    depth = np.frexp((high - low + 1).astype(float))[1] - 1
    out = np.empty(len(low), np.int64)
    for k in np.unique(depth):
        mine = depth == k
        a, b = table[k][low[mine]], table[k][high[mine] - (1 << k) + 1]
        out[mine] = np.where(values[b] < values[a], b, a)
    return out


def word_runs(words: np.ndarray) -> Arrays:
    windows = np.arange(len(words) - WINDOW + 1)
    all_levels = levels(words)
    anchor = np.full(len(windows), -1)
    bounds = np.zeros((len(windows), 3), np.int64)
    todo = windows
    for level in reversed(range(ROUNDS + 1)):
        name, left, right, at = all_levels[level]
        low = np.searchsorted(left, todo, "left")
        high = np.searchsorted(right, todo + WINDOW, "right") - 1
        inside = low <= high
        if inside.any():
            mine = todo[inside]
            best = least_between(name, low[inside], high[inside])
            anchor[mine] = best * (ROUNDS + 1) + level
            bounds[mine] = np.stack([left[best], right[best], at[best]], axis=1)
            todo = todo[~inside]
        if not len(todo):
            break
    start, n = grouped_runs(anchor)
    left, right, at = bounds[start].T
    level = anchor[start] % (ROUNDS + 1)
    names = content_hashes(words, left, right, level)
    return start, n, at - start, names, content_hashes(words, start, start + n - 1 + WINDOW, at - start)


def word_result(text: str, cuts: list[tuple[int, int]]) -> tuple:
    parts = split_text(text)
    kept, at = [], 0
    for a, b in cuts:
        kept += parts[at:a]
        at = b
    kept += parts[at:]
    return len(parts), sum(b - a for a, b in cuts), hashlib.sha256(b" ".join(kept)).hexdigest()


WORDS = Method(
    window=WINDOW,
    within=False,
    units=word_units,
    runs=word_runs,
    result=word_result,
    fields=(("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())),
    schema="n_words long, n_removed long, kept_sha256 string",
)


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of (doc_id, text)."""
    return without_repeats(docs, WORDS)

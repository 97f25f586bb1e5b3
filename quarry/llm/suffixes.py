"""Removal of repeated byte strings, after the suffix array's prefix doubling.

A position's name at length 2m is made of the names at length m of the position and of the position m further on.
Doubling from single bytes to 32 bytes happens inside each document, with 64-bit hashes as names (equal strings get
equal names in all documents without any exchange). Ranking every byte position by global sorts would shuffle each
byte many times over, so the positions that Spark ranks are sampled by content: of the 69 positions in a 100-byte
window at which 32 bytes fit, the one with the least name (the leftmost on ties) stands for the window. Spark reranks
these positions at growing lengths, and unique ones drop out each time: by their 32 bytes, then by all bytes that the
position's windows cover, past the threshold of 100, and where those differ by 88 bytes and by single windows.

Defined results: null and empty texts have no bytes; texts shorter than 100 bytes lose nothing; long texts are
scanned whole; rows of one doc_id with different texts are documents of their own, ordered by a hash of the text,
fully equal rows count as one document (each keeps what the first keeps); documents with a null doc_id come last;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.windows import Arrays, Method, content_hashes, grouped_runs, without_repeats

WINDOW, GRAM = 100, 32
WIDE = WINDOW - GRAM + 1
_BYTE_NAMES = np.random.default_rng(17).integers(0, 2**64, 256, np.uint64)


def byte_units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def gram_names(data: np.ndarray) -> np.ndarray:
    """The name of the 32 bytes at each position, doubled up from single bytes."""
    names = _BYTE_NAMES[data]
    length = 1
    while length < GRAM:
        pair = names[:-length] * np.uint64(0x9E3779B97F4A7C15)
        pair ^= pair >> np.uint64(29)
        names = (pair + names[length:]) * np.uint64(0xBF58476D1CE4E5B9)
        names ^= names >> np.uint64(32)
        length *= 2
    return names


def least_places(values: np.ndarray, wide: int) -> np.ndarray:
    """For each stretch of `wide` values the place of the least one, the leftmost on ties, by doubling."""
    best, places, length = values, np.arange(len(values), dtype=np.int32), 1
    while length < wide:
        step = min(length, wide - length)
        right = best[step:] < best[:-step]
        places = np.where(right, places[step:], places[:-step])
        best = np.minimum(best[step:], best[:-step])
        length += step
    return places


def byte_runs(data: np.ndarray) -> Arrays:
    names = gram_names(data)
    anchors = least_places(names, WIDE)
    start, n = grouped_runs(anchors)
    anchor = anchors[start].astype(np.int64)
    return start, n, anchor - start, names[anchor], content_hashes(data, start, start + n - 1 + WINDOW, anchor - start)


def byte_result(text: str, cuts: list[tuple[int, int]]) -> tuple:
    data = text.encode("utf-8", "surrogatepass")
    kept, at = hashlib.sha256(), 0
    for a, b in cuts:
        kept.update(data[at:a])
        at = b
    kept.update(data[at:])
    return len(data), sum(b - a for a, b in cuts), len(cuts), kept.hexdigest()


BYTES = Method(
    window=WINDOW,
    within=True,
    units=byte_units,
    runs=byte_runs,
    result=byte_result,
    fields=(("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())),
    schema="n_bytes long, n_removed long, n_spans long, kept_sha256 string",
)


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of (doc_id, text)."""
    return without_repeats(docs, BYTES)

"""Quality rules by repetition coverage.

For every n-gram length of a set, a rolling hash over a document's word numbers finds the n-grams that repeat an
earlier one; the rule measures the characters of all words inside such n-grams, each once, and the characters
inside lines that repeat an earlier line. A document is kept when every coverage stays within its limit.

Defined results: null, empty and blank texts have no words and fail the base rule; a very long text is measured
whole; repeated rows are judged one by one; extra columns of the input are ignored; an empty table gives an empty
result. doc_id is passed through unchanged, null included.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Largest share of word characters, in percent, inside duplicated n-grams, by n-gram length.
COVERAGE_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Fixed value: largest share of line characters, in percent, in lines that repeat an earlier line.
LINE_LIMIT = 20
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Odd multiplier of the rolling polynomial hash (modulo 2^64).
BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, line_chars long, "
    + ", ".join(f"dup_chars_{n} long" for n in sorted(COVERAGE_LIMITS))
)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of n mixed word numbers, by Horner's rule."""
    span = len(ids) - n + 1
    out = np.zeros(span, np.uint64)
    for k in range(n):
        out = out * BASE + ids[k : k + span]
    return out


def repeated(keys: np.ndarray, first_too: bool) -> np.ndarray:
    """The places of keys that occur twice or more, with or without each key's first place."""
    plain = np.sort(keys)
    if not (plain[1:] == plain[:-1]).any():
        return np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later = order[1:][same]
    return np.union1d(order[:-1][same], later) if first_too else later


def inside(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie in a window of n words at one of `starts` (distinct)."""
    steps = np.zeros(size + 1, np.int32)
    steps[starts] += 1
    steps[starts + n] -= 1
    return np.cumsum(steps[:size]) > 0


def measure(text: str | None, limits: dict[int, int], line_limit: int) -> tuple:
    text = text or ""
    parts = text.encode("utf-8", "surrogatepass").split()
    n_words = len(parts)
    word_chars = len(text) - sum(text.count(c) for c in BLANKS)
    n_symbols = sum(text.count(c) for c in SYMBOLS)

    seen: set[str] = set()
    dup_lines = dup_line_chars = line_chars = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line)
            seen.add(line)

    numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, parts), np.uint64, n_words)
    repeat_words, dup_chars = 0, dict.fromkeys(limits, 0)
    if n_words >= 3 and len(numbers) < n_words:
        size = np.uint64(len(numbers))
        pairs = ids[:-2] * size + ids[1:-1]
        if len(numbers) >= 1 << 21:  # three numbers would not fit in 64 bits; ranks of pairs do
            pairs = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
        starts = repeated(pairs * size + ids[2:], first_too=True)
        repeat_words = int(inside(starts, 3, n_words).sum())
    if repeat_words:
        lengths = np.fromiter(map(_chars, numbers), np.int64, len(numbers))[ids.astype(np.int64)]
        mixed = (ids + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        for n in sorted(limits):
            starts = repeated(rolling(mixed, n), first_too=False) if n_words >= n else ()
            if not len(starts) and n >= 3:
                break  # a longer n-gram repeats only where a shorter one does
            dup_chars[n] = int(lengths[inside(starts, n, n_words)].sum()) if len(starts) else 0

    failed = n_words < 50 or 100 * repeat_words > 50 * n_words
    kept = (
        not failed
        and all(100 * dup_chars[n] <= limit * word_chars for n, limit in limits.items())
        and 100 * dup_line_chars <= line_limit * line_chars
    )
    tail = [dup_chars[n] for n in sorted(limits)]
    return n_words, word_chars, n_symbols, dup_lines, repeat_words, failed, kept, dup_line_chars, line_chars, *tail


def _chars(word: bytes) -> int:
    """Code points of a UTF-8 word: bytes that don't continue another."""
    return len(word) if word.isascii() else len(word.decode("utf-8", "surrogatepass"))


def repetition_quality(
    docs: DataFrame, limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT
) -> DataFrame:
    """Measure repetition coverage of every document of (doc_id, text) and judge it; one row for each input row."""
    limits = dict(limits or COVERAGE_LIMITS)
    schema = SCHEMA[: SCHEMA.index("dup_chars_")] + ", ".join(f"dup_chars_{n} long" for n in sorted(limits))
    names = [x.split()[0] for x in schema.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py(), limits, line_limit) for t in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.bool_() if n in ("base_failed", "kept") else pa.int64() for n in names[1:]]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays], names)

    return docs.select("doc_id", "text").mapInArrow(judge, schema)

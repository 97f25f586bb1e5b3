"""Strict word similarity: how well a run of whole words anywhere in a text matches a query, by trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import fold
from quarry.plans.registry import Tables, query


def trigrams(word: str) -> frozenset[str]:
    padded = f"  {word} "
    return frozenset(padded[i : i + 3] for i in range(len(padded) - 2))


def best_extent(asked: list[str], words: list[str], known: dict[str, frozenset[str]] | None = None) -> tuple[float, int, int]:
    """The greatest similarity of the query's trigrams and those of a run of words; the first such run's start and end.

    A run that begins or ends with a word without any of the query's trigrams, or whose first word comes again in it, is
    never better than a shorter one; and a run with n trigrams reaches the query's number divided by n at most. So runs stop
    early, and a text of any length takes little more than one look at each of its words.
    """
    known = {} if known is None else known

    def of(word: str) -> frozenset[str]:
        if word not in known:
            known[word] = trigrams(word)
        return known[word]

    wanted = frozenset().union(*map(of, asked)) if asked else frozenset()
    hits = {w for w in set(words) if of(w) & wanted}
    best = (0.0, -1, -1)
    for i, first in enumerate(words):
        if first not in hits:
            continue
        extent: set[str] = set()
        for j in range(i, len(words)):
            word = words[j]
            if j > i and word == first:
                break
            extent |= of(word)
            if len(extent) * best[0] > len(wanted):
                break
            if word in hits:
                common = len(wanted & extent)
                score = common / (len(wanted) + len(extent) - common)
                if score > best[0]:
                    best = (score, i, j + 1)
    return best


def strict_word_similarity(rows: DataFrame) -> DataFrame:
    """id, score, first_word and last_word of rows (id, asked, text): the best run of words (from 0, the end excluded)."""
    folded = lambda c: F.filter(F.split(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_extent(a.as_py(), w.as_py()) for a, w in zip(batch.column("a"), batch.column("w"), strict=True)]
            score, first, last = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([round(s, 6) for s in score], pa.float64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                ["id", "score", "first_word", "last_word"],
            )

    words = rows.select(F.col("id").cast("long").alias("id"), folded(F.col("asked")).alias("a"), folded(F.col("text")).alias("w"))
    return words.mapInArrow(run, "id long, score double, first_word int, last_word int")


@query("str_strict_word_sim")
def str_strict_word_sim(t: Tables) -> DataFrame:
    """Two words from the middle of every document's first line, two letters swapped, against its whole text."""
    line = F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " ")
    middle = F.greatest(F.lit(0), F.floor(F.size(line) / 2)).cast("int")
    two = F.concat_ws(" ", F.get(line, middle), F.get(line, middle + 1))
    asked = F.regexp_replace(two, "([a-z])([a-z])([a-z]*)$", "$2$1$3")
    return strict_word_similarity(t.documents.select(F.col("doc_id").alias("id"), asked.alias("asked"), "text"))

"""Long repeats across a corpus: which windows of fixed length also occur earlier.

Both substring operators reduce to the same question. A document's windows are cut into runs: neighbouring windows
that choose the same anchor, a place inside the window picked by the window's own content alone, so equal windows
choose alike wherever they stand. A run's `name` stands for content around the anchor that all its windows hold; its
`span` stands for all the content that its windows cover, and for where the anchor lies in it.

Rounds over Spark tables then narrow the candidates:

1. names that occur once cannot hold a repeat, and their runs drop out;
2. runs with equal (name, span) have equal windows, one by one: all but the first occurrence are settled at once;
3. where runs of one name differ (at the edges of a repeat), the first run of each span is cut into pieces by the
   anchor's place in the window; a piece's name stands for the content that all its windows hold, nearly a window
   long, and pieces whose name occurs once drop out;
4. the windows of the remaining pieces are named one by one, and equal ones settled by their first occurrence.

Fully equal rows bring equal runs, which sets collapse before rows are joined with texts, so n copies cost n times one.
Equality rests on pairs of 64-bit hashes of content. Hot names and spans are pre-aggregated before each shuffle, and
joins back to the rows are plain equi-joins, which Spark splits where a key is hot. Nothing is sampled or capped.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, saved, saved_at

Arrays = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Slices of the names that meet one after the other, so that little disk is used at once.
SLICES = 2
#: Pieces that a window's places for its anchor are cut into.
PIECES = 8


@dataclass(frozen=True)
class Method:
    """What an operator brings: its units, its window length and its runs.

    `units(text)` gives an array of a text's units; `runs(units)` gives starts, numbers of windows, the anchor's place
    counted from the start, names and spans;
    `result(text, intervals)` gives the operator's output columns from the merged intervals of removed units.
    `within` says whether an earlier start in the same document counts as earlier.
    """

    window: int
    within: bool
    units: Callable[[str], np.ndarray]
    runs: Callable[[np.ndarray], Arrays]
    result: Callable[[str, list[tuple[int, int]]], tuple]
    fields: tuple[tuple[str, pa.DataType], ...]
    schema: str


def content_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of units, seeded."""
    data, width = memoryview(np.ascontiguousarray(units)).cast("B"), units.itemsize
    cuts = zip((starts * width).tolist(), (ends * width).tolist(), seeds.tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(data[a:b], s) for a, b, s in cuts), np.uint64, len(starts))


def grouped_runs(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    return starts, np.diff(np.append(starts, len(anchors)))


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching half-open intervals made one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash that tells rows of one doc_id apart) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def all_runs(docs: DataFrame, method: Method) -> DataFrame:
    names = ["doc_id", "text_key", "start", "n", "anchor", "name", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for text in batch.column("text"):
                units = method.units(text.as_py() or "")
                one = method.runs(units) if len(units) >= method.window else None
                counts.append(len(one[0]) if one else 0)
                if one:
                    found.append(one)
            if not found:
                continue
            rows = np.repeat(np.arange(len(counts)), counts)
            start, n, anchor, name, span = (np.concatenate(x) for x in zip(*found, strict=True))
            columns = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "text_key")]
            columns += [pa.array(x.astype(np.int32)) for x in (start, n, anchor)]
            columns += [pa.array(name.view(np.int64)), pa.array(span.view(np.int64))]
            yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=1 << 17)

    return docs.mapInArrow(run, "doc_id long, text_key long, start int, n int, anchor int, name long, span long")


def pieces(start: np.ndarray, n: np.ndarray, anchor: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs cut by the anchor's place in the window: run number, first window, windows, and bounds of shared content."""
    rows, starts, counts, low, high = [], [], [], [], []
    for k in range(PIECES):
        # Windows that start between `near` and `far` before the anchor, both included.
        near, far = -(-k * window // PIECES), -(-(k + 1) * window // PIECES) - 1
        at = start + anchor
        first, last = np.maximum(start, at - far), np.minimum(start + n - 1, at - near)
        some = np.flatnonzero(first <= last)
        rows.append(some)
        starts.append(first[some])
        counts.append((last - first + 1)[some])
        low.append(at[some] - near)
        high.append(at[some] - far + window)
    return tuple(np.concatenate(x).astype(np.int64) for x in (rows, starts, counts, low, high))


def named(runs: DataFrame, docs: DataFrame, method: Method, single: bool) -> DataFrame:
    """(doc_id, text_key, name, start, n, whole): the runs' pieces, or single windows; `whole` hashes their content."""
    lists = runs.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n", "anchor", "name")).alias("runs"))
    lists = lists.toDF("_id", "_key", "runs")
    at = docs["doc_id"].eqNullSafe(lists["_id"]) & (docs["text_key"] == lists["_key"])
    texts = docs.join(lists, at).select("doc_id", "text_key", "text", "runs")
    names = ["doc_id", "text_key", "name", "start", "n", "anchor", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                units = method.units(batch.column("text")[i].as_py())
                part = batch.column("runs")[i].values
                first, n, anchor, name = (part.field(k).to_numpy() for k in range(4))
                if single:
                    row = np.repeat(np.arange(len(n)), n)
                    start = (first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int64)
                    count, low, high = np.ones(len(row), np.int64), start, start + method.window
                else:
                    row, start, count, low, high = pieces(first, n, anchor, method.window)
                place = (first + anchor)[row] - start
                whole = content_hashes(units, low, high, (first + anchor)[row].astype(np.int64) - low)
                columns = [batch.column(c).take(pa.array(np.full(len(row), i))) for c in ("doc_id", "text_key")]
                columns += [pa.array(name[row]), *(pa.array(x.astype(np.int32)) for x in (start, count, place))]
                columns += [pa.array(whole.view(np.int64))]
                yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=1 << 17)

    return texts.mapInArrow(run, "doc_id long, text_key long, name long, start int, n int, anchor int, whole long")


def _place(within: bool) -> list:
    """The columns that order occurrences; rows of one doc_id are one document unless their places count."""
    none = F.col("doc_id").isNull().alias("none")
    return [none, F.col("doc_id").alias("doc_id"), *([F.col("text_key").alias("text_key"), F.col("start").alias("start")] if within else [])]


def repeats(docs: DataFrame, method: Method) -> DataFrame:
    """(doc_id, text_key, start, end): stretches of units covered by windows that also occur earlier."""
    spark = docs.sparkSession
    runs, path = saved_at(all_runs(docs, method), "runs")
    # For a repeat a name must occur twice, and in two documents unless places inside one count.
    other = "uses > 1" if method.within else "low < high"
    uses = [F.count("*").alias("uses")] if method.within else [F.min("doc_id").alias("low"), F.max("doc_id").alias("high")]
    if not method.within:
        other += " OR (nulls > 0 AND low IS NOT NULL)"
        uses.append(F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    # Written first, so the join below has plain shuffles on both sides, which Spark splits where a name is hot.
    parts = []
    for k in range(SLICES):
        mine = runs.where(F.pmod("name", F.lit(SLICES)) == k)
        shared, shared_path = saved_at(mine.groupBy("name").agg(*uses).where(other).select("name"), "shared-names")
        parts.append(saved(mine.join(shared, "name"), "shared-runs"))
        discard(spark, shared_path)
    some = functools.reduce(DataFrame.unionByName, parts)
    discard(spark, path)

    place = F.struct(*_place(method.within))
    firsts = some.groupBy("name", "span").agg(F.min(place).alias("first"))
    split = firsts.groupBy("name").agg(F.count("*").alias("spans")).where("spans > 1").select("name", F.lit(True).alias("split"))
    told = saved(firsts.join(split, "name", "left"), "spans")
    marked = saved(
        some.join(told, ["name", "span"]).select("*", place.eqNullSafe(F.col("first")).alias("own")).drop("first", "span"),
        "told-runs",
    )
    whole = marked.where(~F.col("own")).select(
        "doc_id", "text_key", "start", (F.col("start") + F.col("n") - 1 + method.window).alias("end")
    )

    cut = saved(named(marked.where("own AND split"), docs, method, single=False), "pieces")
    again = cut.groupBy("name", "whole").agg(F.count("*").alias("uses")).where("uses > 1").select("name", "whole")
    windows = saved(named(cut.join(again, ["name", "whole"]), docs, method, single=True), "windows")
    least = windows.groupBy("name", "whole").agg(F.min(place).alias("first"), F.count("*").alias("uses")).where("uses > 1")
    single = windows.join(least, ["name", "whole"]).where(~place.eqNullSafe(F.col("first")))
    single = single.select("doc_id", "text_key", "start", (F.col("start") + method.window).alias("end"))
    return whole.unionByName(single)


def without_repeats(docs: DataFrame, method: Method) -> DataFrame:
    """One row for each row of (doc_id, text): doc_id and the method's result columns."""
    rows = keyed(docs)
    found = repeats(rows, method)
    lists = saved(found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("cuts")), "cuts")
    lists = lists.toDF("_id", "_key", "cuts")
    at = rows["doc_id"].eqNullSafe(lists["_id"]) & (rows["text_key"] == lists["_key"])
    names = ["doc_id", *(n for n, _ in method.fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, cuts in zip(batch.column("text"), batch.column("cuts"), strict=True):
                spans = list(zip(*(x.to_pylist() for x in cuts.values.flatten()), strict=True)) if cuts.is_valid else []
                made.append(method.result(text.as_py() or "", merged(spans)))
            columns = list(zip(*made, strict=True)) or [()] * len(method.fields)
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, method.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    joined = rows.join(lists, at, "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(run, f"doc_id long, {method.schema}")

"""SimHash near-duplicates through vantage-point trees.

A fingerprint has 64 bits. Two fingerprints that differ in at most three bits differ in at most one bit in one of
their 32-bit halves, so two vantage-point trees, one over each half, see every link at radius one; for seven bits four
trees over quarters do. A tree node holds a vantage point and a radius; distances at most the radius go below, the
others above. By the triangle bound a fingerprint can only have neighbours on both sides if its distance is within one
of the radius; only then it visits the other side too. Each fingerprint has one home leaf in each tree, and the leaf's shard compares homes with
homes and visitors, exactly, on all 64 bits.

The trees are fitted on a sample of at most `sample` distinct fingerprints (the tree's depth follows the number of
all fingerprints); every fingerprint is routed and compared, so the sample decides the speed and not the result.
Shards above a fair share of all rows are cut into chunks, and pairs of chunks are compared in separate tasks.
Inside a shard a group's members are reached from each other breadth first against what is not reached yet, so a
tight group costs no all-pairs work, and the shard returns one link for each member.

Defined results: null and blank texts have fingerprint zero, linked like any other; texts with fewer words than a
shingle hash their whole word sequence; long texts are hashed whole; equal fingerprints, repeated rows included,
share a component; a null doc_id keeps its row and is no component's id unless it stands alone; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import packed, partitions, saved
from quarry.llm.graph import connected_components

RADIUS = 3
#: For documents of five-word shingles: seven bits. Pairs of similarity 0.8 differ in 9.7 bits on average, of 0.9 in 6.6.
WIDE_RADIUS, WIDE_SHINGLE = 7, 5


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a whole text, as a signed 64-bit integer."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= shingle:
        grams: Iterator[bytes] = iter([b" ".join(parts)])
    else:
        grams = map(b" ".join, zip(*(parts[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) for every row; text_key is a hash of the text that tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_key long, fp long")


class Tree:
    """A vantage-point tree over pieces of fingerprints, for neighbours at distance one; leaves have negative numbers."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves = 0
        self._rng = np.random.default_rng(seed)
        self.root = self._grow(sample, leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        if len(points) > leaf:
            best = None
            for vantage in self._rng.choice(points, min(8, len(points))):
                distance = np.bitwise_count(points ^ vantage).astype(int)
                radius = int(np.median(distance))
                radius -= int((distance <= radius).sum() > 0.6 * len(points) and (distance < radius).any())
                below = (distance <= radius).sum()
                crossing = ((distance >= radius) & (distance <= radius + 1)).sum()
                worth = crossing + abs(len(points) - 2 * below)
                if best is None or worth < best[0]:
                    best = worth, int(vantage), radius, distance
            worth, vantage, radius, distance = best
            if worth < 0.8 * len(points):  # else most rows would visit both sides
                at = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                below = self._grow(points[distance <= radius], leaf)
                above = self._grow(points[distance > radius], leaf)
                self.nodes[at] = vantage, radius, below, above
                return at
        self.leaves += 1
        return -self.leaves

    def route(self, halves: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows at home there, rows that visit it) for each leaf that is reached."""
        todo = [(self.root, np.arange(len(halves)), np.zeros(0, np.int64))]
        while todo:
            node, home, visit = todo.pop()
            if not len(home) and not len(visit):
                continue
            if node < 0:
                yield -node - 1, home, visit
                continue
            vantage, radius, below, above = self.nodes[node]
            at_home = np.bitwise_count(halves[home] ^ np.uint64(vantage))
            on_visit = np.bitwise_count(halves[visit] ^ np.uint64(vantage))
            near = at_home == radius + 1  # at home above, with possible neighbours below
            todo.append((below, home[at_home <= radius], np.concatenate([visit[on_visit <= radius + 1], home[near]])))
            todo.append((above, home[at_home > radius], visit[on_visit >= radius]))


def linked(prints: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the least fingerprint that it is linked with, through links that have a home end."""
    group = np.full(len(prints), -1)
    homes, visitors = np.flatnonzero(home), np.flatnonzero(~home)
    for start in homes:
        if group[start] >= 0:
            continue
        group[start] = start
        front = [start]
        homes = homes[group[homes] < 0]
        while front:
            at = front.pop()
            found = homes[np.bitwise_count(prints[homes] ^ prints[at]) <= radius]
            if home[at] and len(visitors):
                more = visitors[np.bitwise_count(prints[visitors] ^ prints[at]) <= radius]
                if len(more):
                    group[more] = start
                    visitors = visitors[group[visitors] < 0]
                    front.extend(more.tolist())
            if len(found):
                group[found] = start
                homes = homes[group[homes] < 0]
                front.extend(found.tolist())
    alone = group < 0
    group[alone] = np.flatnonzero(alone)
    least = np.full(len(prints), np.iinfo(np.int64).max)
    signed = prints.view(np.int64)
    np.minimum.at(least, group, signed)
    return least[group]


def pieces_of(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """The pieces of fingerprints, so many that two within the radius differ in at most one bit of some piece."""
    pieces = (radius + 1) // 2
    width = 64 // pieces
    return [prints >> np.uint64(width * i) & np.uint64((1 << width) - 1) for i in reversed(range(pieces))]


def links_between(prints: DataFrame, sample: int = 65536, leaf: int = 256, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) within `radius` bits (3 or 7) of each other."""
    spark = prints.sparkSession
    total = prints.count()
    step = max(1, -(-total // sample))
    drawn = prints.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).limit(2 * sample).toPandas()["fp"]
    points = drawn.to_numpy(np.int64).view(np.uint64)
    size = max(4, leaf * len(points) // max(total, 1))
    trees = [Tree(piece, size, i + 1) for i, piece in enumerate(pieces_of(points, radius))]
    shared = spark.sparkContext.broadcast(trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column("fp").to_numpy() for b in batches]
        if not parts:
            return
        signed = np.concatenate(parts)
        whole, first = signed.view(np.uint64), 0
        for tree, halves in zip(shared.value, pieces_of(whole, radius), strict=True):
            pieces = [
                (np.full(len(rows), first + at), rows, np.full(len(rows), kind))
                for at, home, visit in tree.route(halves)
                for rows, kind in ((home, True), (visit, False))
            ]
            first += tree.leaves
            leaves, rows, kinds = (np.concatenate(x) for x in zip(*pieces, strict=True))
            for i in range(0, len(rows), 1 << 16):
                cut = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves[cut], pa.int32()), pa.array(signed[rows[cut]]), pa.array(kinds[cut])],
                    ["leaf", "fp", "home"],
                )

    placed = saved(prints.select("fp").mapInArrow(route, "leaf int, fp long, home boolean"), "simhash-leaves")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"))
    rows = placed.count()
    share = min(16384, max(1024, rows // max(1, partitions(spark))))
    # One row for each large leaf; the trees' size, set by the sample, bounds their number.
    large = F.broadcast(sizes.where(F.col("n") > share).select("leaf", F.ceil(F.col("n") * 2 / share).alias("chunks")))
    chunk = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1))
    dealt = placed.join(large, "leaf", "left").select("leaf", "fp", "home", chunk.alias("chunk"), other.alias("other"))
    dealt = dealt.select("leaf", "fp", "home", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        signed = table["fp"].to_numpy()
        least = linked(signed.view(np.uint64), table["home"].to_numpy(), radius)
        apart = least != signed
        return pa.table({"a": pa.array(signed[apart]), "b": pa.array(least[apart])})

    return dealt.groupBy("leaf", "i", "j").applyInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, text_key and first (is this row kept?) for every row of (doc_id, text).

    The kept row of a component is the one with the smallest doc_id (null last), then text_key.
    """
    prints = saved(fingerprints(docs, shingle), "simhash-prints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    distinct = saved(prints.groupBy("fp").agg(F.min(row).alias("least")), "simhash-distinct")
    roots = saved(connected_components(links_between(distinct, leaf=256 if radius == RADIUS else 2048, radius=radius)), "simhash-roots")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("least"))
    of_print = saved(named.select("fp", "root").join(least, "root").select("fp", "least"), "simhash-components")
    return prints.join(of_print, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.id").alias("component_id"),
        "text_key",
        (F.col("doc_id").eqNullSafe(F.col("least.id")) & (F.col("text_key") == F.col("least.key"))).alias("first"),
    )


def simhash_dedup(docs: DataFrame, shingle: int = WIDE_SHINGLE, radius: int = WIDE_RADIUS) -> DataFrame:
    """The rows of `docs` with one row of each component; equal rows (same doc_id, same text) count as one."""
    firsts = simhash_components(docs, shingle, radius).where("first").select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"))
    keyed = docs.select(packed(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    on = keyed["id"].eqNullSafe(firsts["first_id"]) & (keyed["key"] == firsts["first_key"])
    return keyed.join(firsts, on, "left_semi").dropDuplicates(["id", "key"]).select("row.*")

"""Each operator over documents against a brute-force version on all rows, edge cases included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quarry.llm import lines, packing, repetition, shards, simhash
from quarry.llm.lines import line_dedup
from quarry.llm.substrings import remove_repeated_words
from quarry.llm.suffixes import remove_repeated_bytes

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in BLANK.split(text or "") if w]


def as_rows(df):
    return Counter(map(tuple, df.collect()))


def test_repetition_coverage(docs, rows, empty):
    def expected(i, text):
        text = text or ""
        w = split(text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {p + k for p in range(len(w) - 2) if grams[tuple(w[p : p + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if split(x)]
        seen, dup_chars = set(), 0
        for x in lines:
            dup_chars += len(x) * (x in seen)
            seen.add(x)
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        chars, kept, found = sum(map(len, w)), not failed, []
        for n, limit in repetition.COVERAGE_LIMITS.items():
            before, later = set(), set()
            for p in range(len(w) - n + 1):
                g = tuple(w[p : p + n])
                later |= set(range(p, p + n)) if g in before else set()
                before.add(g)
            found.append(sum(len(w[p]) for p in later))
            kept = kept and 100 * found[-1] <= limit * chars
        kept = kept and 100 * dup_chars <= 20 * sum(map(len, lines))
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        return (i, len(w), chars, symbols, len(lines) - len(seen), len(inside), failed, kept, dup_chars, sum(map(len, lines)), *found)

    assert as_rows(repetition.repetition_quality(docs)) == Counter(expected(i, t) for i, t, *_ in rows)
    assert repetition.repetition_quality(empty).count() == 0


def test_repeated_bytes(docs, rows, empty):
    # Documents in order; rows of one doc_id are told apart by text, equal rows are one document.
    from pyspark.sql import functions as F

    key = {(r.doc_id, r.text): r.k for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k")).distinct().collect()}
    order = sorted(key, key=lambda x: (x[0] is None, x[0] or 0, key[x]))
    seen, result = set(), {}
    for i, text in order:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        result[i, text] = (i, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())
    found = as_rows(remove_repeated_bytes(docs))
    assert found == Counter(result[i, t] for i, t, *_ in rows)
    assert sum(r[2] for r in found) > 1000
    assert remove_repeated_bytes(empty).count() == 0


def test_repeated_words(docs, rows, empty):
    least = {}
    big = lambda i: float("inf") if i is None else i
    for i, t, *_ in rows:
        w = split(t)
        for p in range(len(w) - 49):
            g = tuple(w[p : p + 50])
            least[g] = min(least.get(g, float("inf")), big(i))

    def expected(i, t):
        w = split(t)
        gone = {p + k for p in range(len(w) - 49) if least[tuple(w[p : p + 50])] < big(i) for k in range(50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        return i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()

    found = as_rows(remove_repeated_words(docs))
    assert found == Counter(expected(i, t) for i, t, *_ in rows)
    assert sum(r[2] for r in found) > 300
    assert remove_repeated_words(empty).count() == 0


def test_line_dedup(docs, rows, empty):
    from pyspark.sql import functions as F

    key = {(r.doc_id, r.text): r.k for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k")).distinct().collect()}
    order = sorted((x for x in key if x[1] is not None), key=lambda x: (x[0] is None, x[0] or 0, key[x]))
    earlier, result = [], {}
    for i, text in order:
        kept, lines = [], text.split("\n")
        for x in lines:
            s = set(split(x))
            if s and any(5 * len(s & e) >= 4 * len(s | e) for e in earlier):
                pass
            else:
                kept.append(x)
            if s:
                earlier.append(s)
        result[i, text] = (i, "\n".join(kept), len(lines), len(lines) - len(kept))
    found = as_rows(line_dedup(docs).select("row.doc_id", "text", "n_lines", "n_removed"))
    assert found == Counter(result.get((i, t), (i, None, 0, 0)) for i, t, *_ in rows)
    assert line_dedup(empty).count() == 0


def test_simhash(docs, rows, empty, spark):
    def print_of(text):
        w = [x for x in split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
        g = [" ".join(w[p : p + 3]) for p in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, print_of(t)) for i, t, *_ in rows]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                group = [group[b] if g == group[a] else g for g in group]
    least = defaultdict(list)
    for g, (i, _) in zip(group, prints, strict=True):
        least[g] += [i] * (i is not None)
    expected = Counter((i, f"{p:016x}", min(least[g], default=None)) for g, (i, p) in zip(group, prints, strict=True))
    found = simhash.simhash_components(docs)
    assert as_rows(found.select("doc_id", "fingerprint", "component_id")) == expected
    kept = simhash.simhash_dedup(docs, 3, 3)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.simhash_components(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


@pytest.mark.parametrize("radius", [3, 7])
def test_vantage_point_trees_lose_no_link(spark, radius):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 900, np.uint64)
    near = [p ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, radius).astype(np.uint64)) for p in base[:300]]
    tight = [base[0] ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (1500, 2))]
    points = np.unique(np.concatenate([base, near, tight]))
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    from quarry.llm.graph import connected_components

    found = {r.node: r.root for r in connected_components(simhash.links_between(df, leaf=16, radius=radius)).collect()}
    parent = list(range(len(points)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= radius):
            parent[root(i)] = root(int(j))
    groups = defaultdict(set)
    for i, p in enumerate(points.view(np.int64)):
        groups[root(i)].add(found.get(int(p), int(p)))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_shards(docs, rows, empty):
    found = shards.feistel_shards(docs, 16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        place = int(shards.permute(np.array([r.row_no]), len(rows), 7)[0])
        assert (r.shard, r.slot) == (place % 16, place // 16)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for total in (1, 2, 3, 17, 1000, 70001):
        places = shards.permute(np.arange(total), total, 9)
        assert sorted(places) == list(range(total))
        assert (shards.unpermute(places, total, 9) == np.arange(total)).all()
    assert shards.feistel_shards(empty).count() == 0


def test_packing(docs, rows, empty):
    lengths = sorted(len(split(t)) for _, t, *_ in rows)
    counts = Counter(lengths)
    edges = sorted(counts)
    ends = packing.optimal_boundaries(edges, [counts[e] for e in edges], 3)

    def cost(chosen):
        total, start = 0, 0
        for e in chosen:
            total += edges[e] * sum(counts[x] for x in edges[start : e + 1])
            start = e + 1
        return total

    last = len(edges) - 1
    assert cost(ends) == min(cost([a, b, last]) for a in range(last) for b in range(a + 1, last))

    found = packing.pack_buckets(docs, buckets=4, token_budget=400).collect()
    assert sorted(r.n_tokens for r in found) == lengths
    batches = defaultdict(list)
    for r in found:
        batches[r.batch_id].append(r)
        assert r.n_tokens <= r.padded_len
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].padded_len <= 400
    assert packing.pack_buckets(empty).count() == 0


def test_lines_whose_words_share_a_hash_still_match(spark):
    """w254943 and w267111 have one 32-bit hash; the two lines' similarity is exactly 0.8."""
    shared = "w254943 w267111 a b c d e f"
    pairs = spark.createDataFrame([(1, f"{shared} one"), (2, f"{shared} two")], "doc_id long, text string")
    assert pairs.sparkSession.sql("SELECT hash('w254943') = hash('w267111')").first()[0]
    assert {r.row.doc_id: r.n_removed for r in line_dedup(pairs).collect()} == {1: 0, 2: 1}


def test_a_thousand_equal_and_a_thousand_near_equal_lines(spark):
    """All but the first of a large group go, whether its lines are equal or differ in one word of twenty."""
    words = " ".join(f"word{i}" for i in range(20))
    rows = [(i, words if i < 1000 else f"{words} own{i}") for i in range(2000)]
    found = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.row.doc_id: r.n_removed for r in found} == {i: int(i > 0) for i in range(2000)}


def test_long_lines_below_the_threshold_are_not_paired_for_words(spark, monkeypatch):
    """Lines of 100 words that share about 81 pairwise (similarity 0.68) are told apart before their words are compared."""
    rng, judged, similar = random.Random(5), [], lines.similar
    base = [f"base{i}" for i in range(100)]
    own = [{p: f"own{i}x{p}" for p in rng.sample(range(100), 10)} for i in range(80)]
    rows = [(i, " ".join(o.get(p, w) for p, w in enumerate(base))) for i, o in enumerate(own)]

    def counted(pairs, *rest):
        judged.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(lines, "similar", counted)
    found = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_removed for r in found) == 0
    assert sum(judged) < 500  # of 3,160 pairs


def test_lines_near_the_threshold_with_full_and_other_counters(spark, monkeypatch):
    """Every posting list is met, whether its counter is full or not, and a line's first pair that fails is not its last."""
    rng = random.Random(9)
    base = [[f"w{g}x{k}" for k in range(14)] for g in range(12)]
    vary = lambda w: [rng.choice(base[0]) if rng.random() < 0.1 else x for x in w if rng.random() > 0.08]
    rows = [(i, " ".join(vary(base[min(i % 40, 11)]))) for i in range(400)]
    sets = [set(t.split()) for _, t in rows]
    expected = {i: int(any(5 * len(s & e) >= 4 * len(s | e) for e in sets[:i])) for i, s in enumerate(sets)}
    for hot in (1, 20, 10**9):
        monkeypatch.setattr(lines, "HOT", hot)
        found = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.row.doc_id: r.n_removed for r in found} == expected
    assert 20 < sum(expected.values()) < 390

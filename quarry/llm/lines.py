"""Line de-duplication by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its distinct words. Two lines match when the Jaccard similarity of their token sets reaches the
threshold; a line is removed if it matches an earlier line of the corpus (smaller doc_id, or the same document and
a smaller line number), whether that line stays or not.

Equal lines become one candidate, numbered by its first place. Tokens are ordered by rarity: the words of all
candidates are counted in `BUCKETS` counters chosen by hash (a frequent word has a full counter, a rare one a nearly
empty one, so the table of counters is of fixed size whatever the corpus), and a token's sort key is its counter's
logarithm, then its hash. Any fixed order is exact; this one puts the rarest tokens first. A line's prefix holds as
many of its first tokens as a match must share two of (a set so small that it needs fewer, all of those). Prefix tokens that two
candidates share meet under the length filter, the positional filter and a bound by parities on the sets' difference;
pairs that meet often enough are compared, and the words of both lines then decide.

Hot groups: tokens whose counters hold many postings go apart. There each line first meets only the first line of its
posting lists, which settles nearly all members of a large group of near-copies; only those still undecided meet all
earlier lines of these lists. Spark splits the joins where a token is hot.

Candidates come from 63-bit token keys and equal lines from 128 bits of hash; similarity is decided on words.

Defined results: blank lines have no tokens and always stay; null and empty texts stay as they are; a document whose
lines all go keeps its row, with an empty text; rows of one doc_id are told apart by their text, and fully equal
rows count as one (their lines are not removed for each other); lines of a null doc_id come last in the order; extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, numbered, packed, saved, saved_at, split_words

#: Counters of words; a fixed size of what the driver gets and what each task holds.
BUCKETS = 1 << 18
#: How many prefix tokens two candidates must share to be compared.
SHARED = 2
#: A token's key: the class of its counter (7 bits), then this much of its hash.
LOW = (1 << 56) - 1
#: Slices of the tokens whose postings meet one after the other, so that little disk is used at once.
SLICES = 2
#: A line of more words than this has a tag.
LONG = 64
#: A counter is full when its tokens have more postings than this, and than eight times the mean of all counters.
HOT = 256
#: The numbers of the lines in up to so many pairs go to all tasks; more are joined by a shuffle.
NUMBERS = 1_000_000
#: What a posting tells of its line, beside the token.
POSTING = ["mark", "n", "sig", "tag"]
#: What tells rows of `docs` apart, null-safe.
KEY = ["none", "id", "text_key"]


def rarity(candidates: DataFrame) -> Column:
    """A constant array of bytes: for each counter its class, from 0 (rare) to 127, a quarter of a doubling wide."""
    words = candidates.select(F.explode(split_words(F.col("content"), line=True, blanks=True)).alias("w"))
    counter = F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")
    figures = words.select(counter).groupBy("b").agg(F.count("*").alias("n"))
    figures = figures.select("b", F.least(F.floor(4 * F.log2("n")), F.lit(127)).cast("tinyint").alias("c")).toArrow()
    classes = np.zeros(BUCKETS, np.int8)
    classes[figures["b"].to_numpy()] = figures["c"].to_numpy()
    return F.split(F.lit(",".join(map(str, classes.tolist()))), ",").cast("array<tinyint>")  # folded to a literal when planned


def line_tokens(line: Column, classes: Column) -> Column:
    """The distinct words of a line as sort keys, rarest first."""
    hashes = F.transform(split_words(line, line=True), lambda w: F.xxhash64(w))
    place = lambda h: F.get(classes, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    # The coalesce only tells Spark that no key is null, which lets it sort plain longs.
    key = lambda h: F.coalesce(F.shiftleft(place(h).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit(LOW))), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(hashes, key)))


def parities(tokens: Column) -> list[Column]:
    """64 parity bits of a token set (sig), each of one class of its tokens, and of long ones those of half of the tokens (tag).

    Two sets differ in at least as many tokens as in bits. A tag splits each class of sig in two, so two long lines are
    compared in 128 bits. Parities don't fill up as plain bitmaps do.
    """
    # A shift of a long takes the lowest six bits of the distance.
    one = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, 32).cast("int"))
    half = lambda t: F.call_function("shiftleft", F.shiftright(t, 40).bitwiseAND(F.lit(1)), F.shiftright(t, 32).cast("int"))
    flipped = lambda bit: F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(bit(t)))
    return [flipped(one).alias("sig"), F.when(F.size(tokens) > LONG, flipped(half)).otherwise(F.lit(0).cast("long")).alias("tag")]


def needed(percent: int, x: str, y: str) -> str:
    """SQL: the least number of common tokens of sets of sizes x and y that reaches the threshold."""
    return f"({percent} * ({x} + {y}) + {99 + percent}) div {100 + percent}"




def with_earlier(postings: DataFrame, earlier: DataFrame, percent: int) -> DataFrame:
    """(no, other, need): a row for each token that a posting shares with an earlier one that it could match.

    Length filter, positional filter (which holds for the first tokens that two sets share, up to SHARED) and parity
    bound decide. The names of both sides are the same, so Spark shuffles equal ones once.
    """
    least = needed(percent, "a.n", "b.n")
    bits = "bit_count(a.tag ^ b.tag) + bit_count(a.sig ^ a.tag ^ b.sig ^ b.tag)"
    could_match = F.expr(
        f"a.token = b.token AND a.mark > b.mark AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) "
        f"AND least(a.n - (a.mark & 65535), b.n - (b.mark & 65535)) + {SHARED - 1} >= {least} "
        f"AND bit_count(a.sig ^ b.sig) <= a.n + b.n - 2 * ({least}) "
        f"AND (least(a.n, b.n) <= {LONG} OR {bits} <= a.n + b.n - 2 * ({least}))"
    )
    numbers = [F.shiftright("a.mark", 16).alias("no"), F.shiftright("b.mark", 16).alias("other")]
    need = F.least(F.lit(SHARED), F.expr(least)).alias("need")
    return postings.alias("a").join(earlier.alias("b"), could_match).select(*numbers, need)


def similar(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The numbers `no` of the pairs (no, other) whose words match.

    Given `shared` as well, of each line the pair that shares most is judged first, the others only if that one fails.
    32-bit hashes rule out most pairs before words do. Words of one line that share a hash count as one there, so the
    smaller number of words lost that way is added to the hashes in common: the sum is never less than the words in common.
    """
    spark = pairs.sparkSession
    wanted = pairs.select("no").unionByName(pairs.select(F.col("other").alias("no"))).distinct()
    wanted = F.broadcast(wanted) if pairs.count() <= NUMBERS else wanted
    words = split_words(F.col("content"), line=True)
    hashes = F.array_distinct(F.transform(words, lambda w: F.hash(w)))
    texts = candidates.select("no", "content").join(wanted, "no", "left_semi")
    texts, path = saved_at(texts.select("no", "content", F.size(F.array_distinct(words)).alias("n"), hashes.alias("h")), "line-texts", "zstd")

    def reached(pairs: DataFrame, column: str, common: Column) -> DataFrame:
        one = texts.select("no", "n", F.col(column).alias("x"))
        both = pairs.join(one, "no").join(one.toDF("other", "n2", "y"), "other")
        return both.where(common * (100 + percent) >= percent * (F.col("n") + F.col("n2"))).select("no", "other")

    lost = F.least(F.col("n") - F.size("x"), F.col("n2") - F.size("y"))
    sides = [split_words(F.col(c), line=True) for c in ("x", "y")]

    def found(pairs: DataFrame) -> DataFrame:
        near = saved(reached(pairs, "h", F.size(F.array_intersect("x", "y")) + lost), "line-near")
        return saved(reached(near, "content", F.size(F.array_intersect(*sides))).select("no").distinct(), "line-similar")

    if "shared" in pairs.columns:
        best = saved(pairs.groupBy("no").agg(F.max_by("other", "shared").alias("other")), "line-best")
        out = found(best)
        rest = pairs.select("no", "other").join(best, ["no", "other"], "left_anti").join(out, "no", "left_anti")
        out = out.unionByName(found(rest))
    else:
        out = found(pairs)
    discard(spark, path)
    return out


def settled_by_hubs(hot: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The numbers `no` of lines found similar to an earlier one that is the first in one of their posting lists."""
    if hot.isEmpty():
        return hot.select(F.col("mark").alias("no")).limit(0)
    firsts = hot.groupBy("token").agg(F.min_by(F.struct(*POSTING), "mark").alias("hub")).select("token", "hub.*")
    met = with_earlier(hot, firsts, percent).groupBy("no", "other").agg(F.count("*").alias("shared"))
    best = saved(met.groupBy("no").agg(F.max_by("other", "shared").alias("other")), "line-hubs")
    return similar(best, candidates, percent)


def line_candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Every line with a word (KEY, line, and two hashes k1 and k2), and the distinct ones of them, with content.

    The distinct ones are numbered (`no`) by their first place. Grouping moves hashes only; texts move once. The third
    result holds the paths of both tables.
    """
    rows = docs.select(*KEY, F.posexplode(F.split("text", "\n")).alias("line", "content"))
    hashes = [F.xxhash64("content").alias("k1"), F.xxhash64(F.lit("2"), "content").alias("k2")]
    lines, path = saved_at(rows.where(F.col("content").rlike(r"[^\x20\x09-\x0D]")).select(*KEY, "line", *hashes), "lines")
    firsts = lines.groupBy("k1", "k2").agg(F.min(F.struct(*KEY, "line")).alias("at")).select("k1", "k2", "at.*")
    numbers, _ = numbered(firsts, [*KEY, "line"], "line-numbers", "no")
    lists = numbers.groupBy(*KEY).agg(F.collect_list(F.struct("line", "no", "k1", "k2")).alias("found"))
    # The explode of one array keeps Spark from splitting the text again for each of its lines.
    texts = docs.dropDuplicates(KEY).join(lists, KEY).select("found", *KEY, F.explode(F.array(F.split("text", "\n"))).alias("all"))
    texts = texts.select("all", *KEY, F.explode("found").alias("l"))
    content = F.element_at("all", F.col("l.line") + 1).alias("content")
    candidates, texts_path = saved_at(texts.select("l.no", *KEY, "l.line", "l.k1", "l.k2", content), "line-candidates", "zstd")
    return lines, candidates, [path, texts_path]


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(none, id, text_key) and `gone`, the lines of it that match earlier ones; `docs` has none, id, text_key and text."""
    spark = docs.sparkSession
    lines, candidates, paths = line_candidates(docs)
    tokens = candidates.select("no", line_tokens(F.col("content"), rarity(candidates)).alias("tokens"))
    n = F.size("tokens")
    # A match leaves at most n - ceil(percent n / 100) of a set's tokens unmatched, so this prefix holds SHARED common ones.
    prefix = F.slice("tokens", 1, n - F.expr(f"({percent} * size(tokens) + 99) div 100").cast("int") + SHARED)
    sets, sets_path = saved_at(tokens.select("no", n.alias("n"), *parities(F.col("tokens")), prefix.alias("prefix")), "line-sets")
    figures = ["n", "sig", "tag"]
    counter = F.col("token").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")
    load = sets.select(F.explode("prefix").alias("token")).groupBy(counter).agg(F.count("*").alias("k"))
    load, load_path = saved_at(load, "line-load")
    limit = max(HOT, 8 * (load.agg(F.sum("k")).first()[0] or 0) // BUCKETS)
    full = F.broadcast(load.where(F.col("k") > limit).select("b"))

    def postings(which: str, part: Column) -> DataFrame:
        """token and POSTING of the tokens of `part` in full counters (left_semi) or in others (left_anti).

        A mark is the number and, in 16 bits, the token's position; a capped position filters less.
        """
        rows = sets.select("no", *figures, F.posexplode("prefix").alias("pos", "token")).where(part)
        mark = F.shiftleft("no", 16).bitwiseOR(F.least("pos", F.lit(65535)).cast("long")).alias("mark")
        return rows.withColumn("b", counter).join(full, "b", which).select("token", mark, *figures)

    hot, hot_path = saved_at(postings("left_semi", F.lit(True)), "line-hot")
    settled = settled_by_hubs(hot, candidates, percent)
    number = F.shiftright("mark", 16).alias("no")
    left = hot.withColumn("no", number).join(settled, "no", "left_anti").drop("no")
    count = lambda pairs, n: pairs.groupBy("no", "other", "need").agg(n.alias("shared"))
    parts = [saved(count(with_earlier(left, hot, percent), F.count("*")), "line-pairs")]
    for k in range(SLICES):  # a slice's shuffle is gone before the next one's
        part = F.pmod(F.col("token"), F.lit(SLICES)) == k
        met = with_earlier(postings("left_anti", part), postings("left_anti", part), percent)
        parts.append(saved(count(met, F.count("*")), "line-pairs"))
    for path in (sets_path, hot_path, load_path):
        discard(spark, path)
    pairs = count(functools.reduce(DataFrame.unionByName, parts), F.sum("shared")).where("shared >= need")
    pairs = saved(pairs.select("no", "other", "shared").join(settled, "no", "left_anti"), "line-pairs")
    decided = settled.unionByName(similar(pairs, candidates, percent)).withColumn("gone", F.lit(True))

    first = F.struct(*KEY, "line")
    known = candidates.join(decided, "no", "left").select("k1", "k2", first.alias("first"), F.coalesce("gone", F.lit(False)).alias("gone"))
    gone = lines.join(known, ["k1", "k2"]).where(F.col("gone") | (first != F.col("first")))
    gone = saved(gone.groupBy(*KEY).agg(F.collect_set("line").alias("gone")), "lines-gone")
    for path in paths:
        discard(spark, path)
    return gone


def line_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Every row of `docs` as the struct `row`, with text (the kept lines), n_lines and n_removed."""
    doc_id = F.col("doc_id").cast("long")
    key = [doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64("text").alias("text_key")]
    keyed = docs.select(packed(docs), *key)
    texts = docs.where("text IS NOT NULL").select(*key, "text")
    gone = removed_lines(texts, percent)
    lines = F.col("lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    split = keyed.join(gone, KEY, "left").select("row", "gone", F.explode(F.array(F.split("row.text", "\n"))).alias("lines"))
    return split.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept).alias("text"),
        F.coalesce(F.size(F.when(F.col("row.text").isNotNull(), lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.when(F.col("gone").isNotNull(), F.col("gone"))), F.lit(0)).cast("long").alias("n_removed"),
    )


LINE_DEDUP_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line
  FROM documents WHERE text IS NOT NULL),
t AS (
  SELECT doc_id, line, content, list_sort(list_distinct(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+'))) AS tokens FROM l),
s AS (
  SELECT tokens, len(tokens) AS n, min((doc_id, line)) AS at, row_number() OVER (ORDER BY min((doc_id, line))) AS no
  FROM t WHERE len(tokens) > 0 GROUP BY tokens),
w AS (SELECT no, n, unnest(tokens) AS w FROM s WHERE n >= 4),
f AS (SELECT w, count(*) AS f FROM w GROUP BY w),
r AS (SELECT no, n, w, row_number() OVER (PARTITION BY no ORDER BY f, w) AS i FROM w JOIN f USING (w)),
c AS (
  SELECT DISTINCT a.no AS later, b.no AS earlier FROM r a JOIN r b ON a.w = b.w AND b.no < a.no
    AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  WHERE a.i <= a.n - (4 * a.n + 4) // 5 + 1 AND b.i <= b.n - (4 * b.n + 4) // 5 + 1),
m AS (
  SELECT DISTINCT later FROM c JOIN s a ON a.no = later JOIN s b ON b.no = earlier
  WHERE len(list_intersect(a.tokens, b.tokens)) * 100 >= 80 * (a.n + b.n - len(list_intersect(a.tokens, b.tokens)))),
k AS (
  SELECT t.doc_id, t.line, t.content, s.no IS NOT NULL AND (s.at <> (t.doc_id, t.line) OR m.later IS NOT NULL) AS gone
  FROM t LEFT JOIN s ON s.tokens = t.tokens LEFT JOIN m ON m.later = s.no)
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(x.kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_removed,
    string_agg(content, chr(10) ORDER BY line) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id) x USING (doc_id)"""

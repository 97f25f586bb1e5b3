"""SQL forms, for DuckDB, of operators whose results hold no hash that SQL lacks."""

from quarry.llm.repetition import COVERAGE_LIMITS, LINE_LIMIT

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _grams(n: int) -> str:
    """Every n-gram of every document with its place."""
    frame = f"(PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"(SELECT doc_id, i, md5_number(string_agg(w, ' ') OVER {frame}) AS g FROM p QUALIFY count(*) OVER {frame} = {n})"


def _coverage(n: int) -> str:
    """The characters of words inside n-grams that repeat an earlier one, by document."""
    inside = f"max(nth) OVER (PARTITION BY doc_id ORDER BY i RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""g{n} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS nth FROM {_grams(n)}),
c{n} AS (
  SELECT doc_id, sum(length(w)) FILTER (nth > 1)::BIGINT AS chars FROM (
    SELECT p.doc_id, p.w, {inside.replace("nth", "coalesce(nth, 0)").replace("doc_id", "p.doc_id").replace("BY i", "BY p.i")} AS nth
    FROM p LEFT JOIN g{n} g ON g.doc_id = p.doc_id AND g.i = p.i) GROUP BY doc_id)"""


def repetition_sql() -> str:
    sizes = sorted(COVERAGE_LIMITS)
    dup = {n: f"coalesce(c{n}.chars, 0)" for n in sizes}
    fine = " AND ".join(f"100 * {dup[n]} <= {COVERAGE_LIMITS[n]} * word_chars" for n in sizes)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS uses FROM {_grams(3)}),
r AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM t WHERE uses > 1)
  GROUP BY doc_id),
l AS (
  SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id, x ORDER BY no) AS nth FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS no FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
s AS (
  SELECT doc_id, count_if(nth > 1)::BIGINT AS n_dup, coalesce(sum(length(x)) FILTER (nth > 1), 0)::BIGINT AS dup_chars,
    sum(length(x))::BIGINT AS chars FROM l GROUP BY doc_id),
{", ".join(_coverage(n) for n in sizes)},
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols FROM d)
SELECT m.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words) AND {fine}
    AND 100 * coalesce(s.dup_chars, 0) <= {LINE_LIMIT} * coalesce(s.chars, 0) AS kept,
  coalesce(s.dup_chars, 0) AS dup_line_chars, coalesce(s.chars, 0) AS line_chars,
  {", ".join(f"{dup[n]} AS dup_chars_{n}" for n in sizes)}
FROM m LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in sizes)}"""


REPEATED_WORDS_SQL = f"""
WITH p AS MATERIALIZED (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS later FROM {_grams(50)}),
k AS (
  SELECT doc_id, count(*)::BIGINT AS n_words, count_if(gone)::BIGINT AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM (
    SELECT p.doc_id, p.i, p.w, coalesce(bool_or(later) OVER (PARTITION BY p.doc_id ORDER BY p.i RANGE BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
    FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)"""


# Bytes as hex; texts are cut into blocks of 4,096 bytes that overlap by 99, so a window is a slice of one block.
REPEATED_BYTES_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, s, substr(h, 2 * s + 1, 2 * 4195) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 4096)) AS s FROM d)),
q AS (SELECT doc_id, s + o AS i, substr(x, 2 * o + 1, 200) AS g FROM (
  SELECT doc_id, s, x, unnest(range(least(4096, len(x) // 2))) AS o FROM b)),
w AS (SELECT doc_id, i, md5_number(g) AS g FROM q WHERE len(g) = 200),
e AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1),
f AS (
  SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 100 AS fresh FROM e),
r AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM r GROUP BY doc_id, run),
v AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM u),
k AS (
  SELECT v.doc_id, count(*)::BIGINT AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM v JOIN d USING (doc_id) GROUP BY v.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

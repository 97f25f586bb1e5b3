"""Text, identifier and vector functions as column expressions, and a query for each over the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query

#: Letters that fold to ASCII, before lower-casing.
FOLD_FROM = "ıİIŞşÇçĞğÖöÜüÂâÎîÛû"
FOLD_TO = "iiissccggoouuaaiiuu"


def fold(c: Column) -> Column:
    """Turkish letters and vowels with a circumflex become ASCII, then lower case."""
    return F.lower(F.translate(c, FOLD_FROM, FOLD_TO))


def match_tokens(c: Column) -> Column:
    """Folded words of two characters or more, first occurrences in order, the last eight."""
    parts = F.array_distinct(F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2))
    return F.when(F.size(parts) > 8, F.slice(parts, -8, 8)).otherwise(parts)


def stem(c: Column) -> Column:
    """Words of over four letters lose up to two, but keep four."""
    return F.when(F.length(c) <= 4, c).otherwise(F.substr(c, F.lit(1), F.greatest(F.lit(4), F.length(c) - 2)))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; zero if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def trigrams(c: Column) -> Column:
    """The distinct three-letter pieces of the folded words, each word padded by two blanks before and one after."""
    padded = F.transform(F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(padded, cut)))


def slug(c: Column, key: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("-"), key.cast("string"))


def gtin_valid(code: Column) -> Column:
    """The check digit of 8, 12, 13 or 14 digits: weights 3 and 1 from the right."""
    digits = F.transform(F.split(F.lpad(code, 14, "0"), ""), lambda d: d.cast("int"))
    total = F.aggregate(
        F.transform(digits, lambda d, i: d * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda acc, x: acc + x
    )
    return code.rlike("^([0-9]{8}|[0-9]{12}|[0-9]{13}|[0-9]{14})$") & (total % 10 == 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero for a zero norm or unequal lengths, never below zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), dot(a, b) / norm))


_FOLD_SQL = f"lower(translate({{}}, '{FOLD_FROM}', '{FOLD_TO}'))"


def _fold_sql(c: str) -> str:
    return _FOLD_SQL.format(c)


@query("str_fold_tr", f"SELECT doc_id, md5({_fold_sql('text')}) AS folded FROM documents")
def str_fold_tr(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


@query(
    "str_match_tokens",
    f"""SELECT doc_id, array_to_string(w[greatest(1, len(w) - 7):len(w)], ' ') AS tokens FROM (SELECT doc_id, list_filter(u, lambda x, i: list_position(u, x) = i) AS w FROM
    (SELECT doc_id, list_filter(regexp_split_to_array({_fold_sql("text")}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: len(x) >= 2) AS u FROM documents))""",
)
def str_match_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(match_tokens(F.col("text")), " ").alias("tokens"))


@query(
    "str_stem",
    """SELECT DISTINCT w AS word, CASE WHEN len(w) <= 4 THEN w ELSE left(w, greatest(4, len(w) - 2)) END AS stem FROM (SELECT unnest(string_split(title, ' ')) AS w FROM products)""",
)
def str_stem(t: Tables) -> DataFrame:
    return t.products.select(F.explode(F.split("title", " ")).alias("word")).distinct().withColumn("stem", stem(F.col("word")))


@query(
    "str_jaccard",
    """SELECT doc_id, round(len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))), 6) AS score FROM
    (SELECT doc_id, string_split(text, ' ') AS a, string_split(lag(text) OVER (PARTITION BY source ORDER BY doc_id), ' ') AS b FROM documents) WHERE b IS NOT NULL""",
)
def str_jaccard(t: Tables) -> DataFrame:
    """Each document against the one before it in its source."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("source").orderBy("doc_id"))
    rows = t.documents.select("doc_id", "text", before.alias("b")).where("b IS NOT NULL")
    sets = [F.array_distinct(F.split(c, " ")) for c in ("text", "b")]
    return rows.select("doc_id", F.round(jaccard(*sets), 6).alias("score"))


@query(
    "str_trigram_sim",
    """WITH g AS (SELECT title, list_distinct(flatten(list_transform(list_filter(string_split(title, ' '), lambda w: w <> ''),
      lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM (SELECT DISTINCT title FROM products))
    SELECT a.title, b.title AS other, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS score
    FROM g a JOIN g b ON a.title < b.title WHERE split_part(a.title, ' ', 1) = split_part(b.title, ' ', 1)""",
)
def str_trigram_sim(t: Tables) -> DataFrame:
    """Trigram similarity of titles that share their first word."""
    rows = t.products.select("title").distinct().select("title", F.split_part("title", F.lit(" "), F.lit(1)).alias("w"), trigrams(F.col("title")).alias("g"))
    pairs = rows.join(rows.toDF("other", "w", "h"), "w").where("title < other")
    return pairs.select("title", "other", F.round(jaccard(F.col("g"), F.col("h")), 6).alias("score"))


@query("str_slug", f"SELECT product_id, trim(regexp_replace({_fold_sql('title')}, '[^a-z0-9]+', '-', 'g'), '-') || '-' || product_id AS slug FROM products")
def str_slug(t: Tables) -> DataFrame:
    return t.products.select("product_id", slug(F.col("title"), F.col("product_id")).alias("slug"))


@query(
    "str_title_problem",
    """SELECT doc_id, CASE WHEN len(s) < 5 THEN 'short' WHEN contains(s, '://') THEN 'link' WHEN len(regexp_replace(s, '[^a-zA-Z]', '', 'g')) * 2 < len(s) THEN 'letters'
    WHEN len(w) >= 6 AND len(list_distinct(w)) * 10 < len(w) * 3 THEN 'repetitive' WHEN len(s) > 300 THEN 'long' ELSE 'none' END AS problem FROM
    (SELECT doc_id, text AS s, string_split(lower(text), ' ') AS w FROM documents)""",
)
def str_title_problem(t: Tables) -> DataFrame:
    s, w = F.col("text"), F.split(F.lower("text"), " ")
    letters = F.length(F.regexp_replace(s, "[^a-zA-Z]", ""))
    problem = (
        F.when(F.length(s) < 5, "short")
        .when(s.contains("://"), "link")
        .when(letters * 2 < F.length(s), "letters")
        .when((F.size(w) >= 6) & (F.size(F.array_distinct(w)) * 10 < F.size(w) * 3), "repetitive")
        .when(F.length(s) > 300, "long")
        .otherwise("none")
    )
    return t.documents.select("doc_id", problem.alias("problem"))


@query(
    "id_gtin_check",
    """SELECT product_id, list_sum(list_transform(range(1, 15), lambda i: substr(c, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10 = 0 AS valid FROM
    (SELECT product_id, lpad((product_id * 7919 + 4000000000000)::VARCHAR, 14, '0') AS c FROM products)""",
)
def id_gtin_check(t: Tables) -> DataFrame:
    code = (F.col("product_id") * 7919 + F.lit(4000000000000)).cast("string")
    return t.products.select("product_id", gtin_valid(code).alias("valid"))


@query("hash_fingerprint", "SELECT product_id, sha256(concat_ws(chr(31), title, brand, path, size, catalog_price)) AS fingerprint FROM products")
def hash_fingerprint(t: Tables) -> DataFrame:
    fields = F.concat_ws("\x1f", "title", "brand", "path", F.col("size").cast("string"), F.col("catalog_price").cast("string"))
    return t.products.select("product_id", F.sha2(fields, 256).alias("fingerprint"))


@query("json_get", "SELECT event_id, CASE WHEN regexp_full_match(json_extract_string(props, '$.k'), '[0-9]{1,3}') THEN json_extract_string(props, '$.k')::INT ELSE -1 END AS k FROM events")
def json_get(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", F.coalesce(F.when(k.rlike("^[0-9]{1,3}$"), k.cast("int")), F.lit(-1)).alias("k"))


@query("date_local_day", "SELECT event_id, (ts + INTERVAL 3 HOUR)::DATE AS day FROM events", dates="day")
def date_local_day(t: Tables) -> DataFrame:
    """The Istanbul calendar day of a UTC instant."""
    return t.events.select("event_id", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Istanbul")).alias("day"))


@query("date_iso_week_bucket", "SELECT isoyear(ts) AS year, week(ts) AS week, count(*) AS n FROM events GROUP BY ALL")
def date_iso_week_bucket(t: Tables) -> DataFrame:
    return t.events.groupBy(F.expr("extract(YEAROFWEEK FROM ts)").alias("year"), F.weekofyear("ts").alias("week")).agg(F.count("*").alias("n"))


@query("vec_normalize", "SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))), 6) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def vec_normalize(t: Tables) -> DataFrame:
    """Vectors divided by their norm; the sum of components stands for the vector."""
    norm = F.greatest(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), F.lit(1e-12))
    scaled = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double")) / norm
    return t.embeddings.select("vec_id", F.round(scaled, 6).alias("total"))


@query("vec_cosine", "SELECT a.vec_id, round(greatest(0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_cosine(t: Tables) -> DataFrame:
    """Each vector against the next one."""
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return t.embeddings.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("b")), 6).alias("score"))

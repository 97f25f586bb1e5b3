"""Offline evaluation: precision and recall, multi-class scores, nDCG, AUC, run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query

#: A deterministic stand-in for a model: texts of over 1,500 characters are called good.
_JUDGED = "j AS (SELECT l.doc_id, quality = 1 AS truth, n_chars > 1500 AS guess, n_chars, lang FROM labels l JOIN documents d USING (doc_id))"


def judged(t: Tables) -> DataFrame:
    return t.labels.join(t.documents, "doc_id").select("doc_id", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1500).alias("guess"), "n_chars", "lang")


def prf(rows: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and F1 by group; 0/0 is 0."""
    ratio = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 6)
    both, guess, truth = F.count_if(F.expr("truth AND guess")), F.count_if("guess"), F.count_if("truth")
    return rows.groupBy(*keys).agg(ratio(both, guess).alias("precision"), ratio(both, truth).alias("recall"), ratio(2 * both, guess + truth).alias("f1"))


_PRF = """round(CASE WHEN count(*) FILTER (guess) = 0 THEN 0 ELSE count(*) FILTER (truth AND guess) / count(*) FILTER (guess) END, 6) AS precision,
    round(CASE WHEN count(*) FILTER (truth) = 0 THEN 0 ELSE count(*) FILTER (truth AND guess) / count(*) FILTER (truth) END, 6) AS recall,
    round(CASE WHEN count(*) FILTER (guess) + count(*) FILTER (truth) = 0 THEN 0 ELSE 2 * count(*) FILTER (truth AND guess) / (count(*) FILTER (guess) + count(*) FILTER (truth)) END, 6) AS f1"""


@query("ev_prf", f"WITH {_JUDGED} SELECT {_PRF}, round(CASE WHEN count(*) FILTER (guess) = 0 THEN 0 ELSE count(*) FILTER (guess AND NOT truth) / count(*) FILTER (guess) END, 6) AS false_match_rate FROM j")
def ev_prf(t: Tables) -> DataFrame:
    rows = judged(t)
    rate = F.count_if(F.expr("guess AND NOT truth")) / F.nullif(F.count_if("guess"), F.lit(0))
    return prf(rows).join(rows.agg(F.round(F.coalesce(rate, F.lit(0.0)), 6).alias("false_match_rate")))


@query(
    "ev_macro_f1_binary",
    f"""WITH {_JUDGED}, k AS (SELECT c, truth = (c = 1) AS truth, guess = (c = 1) AS guess FROM j, (SELECT unnest([0, 1]) AS c)),
    f AS (SELECT CASE WHEN count(*) FILTER (guess) + count(*) FILTER (truth) = 0 THEN 0 ELSE 2 * count(*) FILTER (truth AND guess) / (count(*) FILTER (guess) + count(*) FILTER (truth)) END AS f1 FROM k GROUP BY c)
    SELECT round(avg(f1), 6) AS macro_f1 FROM f""",
)
def ev_macro_f1_binary(t: Tables) -> DataFrame:
    """The mean F1 of both classes."""
    f1 = lambda x: F.coalesce(2 * F.count_if(F.expr(f"truth = {x} AND guess = {x}")) / F.nullif(F.count_if(F.expr(f"truth = {x}")) + F.count_if(F.expr(f"guess = {x}")), F.lit(0)), F.lit(0.0))
    return judged(t).agg(F.round((f1("true") + f1("false")) / 2, 6).alias("macro_f1"))


@query("ev_attribute_prf", f"WITH {_JUDGED} SELECT lang, {_PRF} FROM j GROUP BY lang")
def ev_attribute_prf(t: Tables) -> DataFrame:
    return prf(judged(t), "lang")


@query(
    "ev_multiclass",
    f"""WITH {_JUDGED}, k AS (SELECT c, truth = (c = 1) AS truth, guess = (c = 1) AS guess FROM j, (SELECT unnest([0, 1]) AS c)) SELECT c AS class, {_PRF}, count(*) FILTER (truth) AS support FROM k GROUP BY c""",
)
def ev_multiclass(t: Tables) -> DataFrame:
    rows = judged(t).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "truth", "guess")
    own = F.col("class") == 1
    rows = rows.select("class", (F.col("truth") == own).alias("truth"), (F.col("guess") == own).alias("guess"))
    return prf(rows, "class").join(rows.groupBy("class").agg(F.count_if("truth").alias("support")), "class")


_GAINS = """r AS (SELECT label AS q, vec_id, abs(embedding[1]::DOUBLE) AS s, (vec_id * 7) % 3 AS rel FROM embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS a, row_number() OVER (PARTITION BY q ORDER BY rel DESC, vec_id) AS b FROM r)"""


def gains(t: Tables) -> DataFrame:
    """A ranked list for each label with graded relevance, and its ideal order."""
    rows = t.embeddings.select(F.col("label").alias("q"), "vec_id", F.abs(F.col("embedding")[0].cast("double")).alias("s"), ((F.col("vec_id") * 7) % 3).alias("rel"))
    group = Window.partitionBy("q")
    return rows.withColumns({"a": F.row_number().over(group.orderBy(F.desc("s"), "vec_id")), "b": F.row_number().over(group.orderBy(F.desc("rel"), "vec_id"))})


@query("ev_ndcg", f"WITH {_GAINS} SELECT q, round(sum((2 ** rel - 1) / log2(a + 1)) FILTER (a <= 10) / sum((2 ** rel - 1) / log2(b + 1)) FILTER (b <= 10), 6) AS ndcg FROM k GROUP BY q")
def ev_ndcg(t: Tables) -> DataFrame:
    gain = lambda c: F.sum(F.when(F.col(c) <= 10, (F.pow(F.lit(2), "rel") - 1) / F.log2(F.col(c) + 1)))
    return gains(t).groupBy("q").agg(F.round(gain("a") / gain("b"), 6).alias("ndcg"))


@query("ev_precision_at_k", f"WITH {_GAINS} SELECT q, count(*) FILTER (a <= 10 AND rel > 0) / 10 AS precision FROM k GROUP BY q")
def ev_precision_at_k(t: Tables) -> DataFrame:
    return gains(t).groupBy("q").agg((F.count_if(F.expr("a <= 10 AND rel > 0")) / 10).alias("precision"))


@query("ev_overlap", f"WITH {_GAINS} SELECT q, count(*) FILTER (a <= 10 AND b <= 10) AS shared, count(*) FILTER (a <= 10 AND b > 10) AS fresh FROM k GROUP BY q")
def ev_overlap(t: Tables) -> DataFrame:
    return gains(t).groupBy("q").agg(F.count_if(F.expr("a <= 10 AND b <= 10")).alias("shared"), F.count_if(F.expr("a <= 10 AND b > 10")).alias("fresh"))


@query("ev_zero_rate", "SELECT event_type, round(avg(CASE WHEN value < 10 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate FROM events GROUP BY 1")
def ev_zero_rate(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") < 10, 1.0).otherwise(0.0)), 6).alias("zero_rate"))


@query(
    "ev_auc",
    f"""WITH {_JUDGED}, r AS (SELECT truth, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM j)
    SELECT round((sum(r) FILTER (truth) - count(*) FILTER (truth) * (count(*) FILTER (truth) + 1) / 2.0) / (count(*) FILTER (truth) * count(*) FILTER (NOT truth)), 6)::DOUBLE AS auc FROM r""",
)
def ev_auc(t: Tables) -> DataFrame:
    """Rank-sum area with average ranks for ties; ranks come from counts by score, so no row-level global sort is needed."""
    by_score = judged(t).groupBy("n_chars").agg(F.count("*").alias("n"), F.count_if("truth").alias("pos"))
    before = F.sum("n").over(Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1))
    ranked = by_score.withColumn("r", F.coalesce(before, F.lit(0)) + (F.col("n") + 1) / 2)
    pos, total = F.sum("pos"), F.sum("n")
    return ranked.agg(F.round((F.sum(F.col("pos") * F.col("r")) - pos * (pos + 1) / 2) / (pos * (total - pos)), 6).alias("auc"))


@query(
    "ev_compare",
    """WITH m AS (SELECT lang, avg(n_chars) FILTER (doc_id % 2 = 0) AS a, avg(n_chars) FILTER (doc_id % 2 = 1) AS b FROM documents GROUP BY 1)
    SELECT lang, round(b - a, 4) AS change, b < a * 0.98 AS regression FROM m""",
)
def ev_compare(t: Tables) -> DataFrame:
    """Two runs of a metric side by side; a fall beyond two percent is a regression."""
    run = lambda k: F.avg(F.when(F.col("doc_id") % 2 == k, F.col("n_chars")))
    m = t.documents.groupBy("lang").agg(run(0).alias("a"), run(1).alias("b"))
    return m.select("lang", F.round(F.col("b") - F.col("a"), 4).alias("change"), (F.col("b") < F.col("a") * 0.98).alias("regression"))


@query("ev_fingerprint", "SELECT sha256(string_agg(item_id || '|' || md5(text), ',' ORDER BY item_id)) AS digest FROM benchmark")
def ev_fingerprint(t: Tables) -> DataFrame:
    """A digest of the (small, fixed) evaluation set."""
    item = F.struct("item_id", F.concat_ws("|", F.col("item_id").cast("string"), F.md5("text")).alias("s"))
    rows = F.transform(F.array_sort(F.collect_list(item)), lambda r: r["s"])
    return t.benchmark.agg(F.sha2(F.array_join(rows, ","), 256).alias("digest"))

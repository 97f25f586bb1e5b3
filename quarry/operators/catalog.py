"""Catalog decisions and audits: scores, link policy, source maps, verdicts, visibility and near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import cosine, jaccard
from quarry.plans.registry import Tables, query


@query(
    "er_link_policy",
    """SELECT brand, title, CASE WHEN count(*) = 1 THEN 'unmatched' WHEN count(DISTINCT size) = 1 THEN 'link' ELSE 'hold' END AS decision FROM products GROUP BY ALL""",
)
def er_link_policy(t: Tables) -> DataFrame:
    decision = F.when(F.count("*") == 1, "unmatched").when(F.countDistinct("size") == 1, "link").otherwise("hold")
    return t.products.groupBy("brand", "title").agg(decision.alias("decision"))


@query(
    "er_merged_audit",
    """SELECT CASE WHEN a.price > b.price * 5 OR b.price > a.price * 5 THEN 'price' WHEN a.in_stock <> b.in_stock THEN 'stock' ELSE 'none' END AS reason, count(*) AS n
    FROM offers a JOIN offers b ON a.product_id = b.product_id AND a.merchant_id < b.merchant_id GROUP BY 1""",
)
def er_merged_audit(t: Tables) -> DataFrame:
    """All offer pairs inside a product, by their first conflict."""
    two = t.offers.selectExpr("product_id", "merchant_id AS m", "price AS p", "in_stock AS s")
    pairs = t.offers.join(two, "product_id").where("merchant_id < m")
    reason = F.expr("CASE WHEN price > p * 5 OR p > price * 5 THEN 'price' WHEN in_stock <> s THEN 'stock' ELSE 'none' END")
    return pairs.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "clf_source_map",
    "SELECT path, lower(split_part(path, '/', 2)) AS folded, count(*) AS n FROM products JOIN offers USING (product_id) GROUP BY ALL",
)
def clf_source_map(t: Tables) -> DataFrame:
    rows = t.offers.join(t.products, "product_id")
    return rows.groupBy("path", F.lower(F.split_part("path", F.lit("/"), F.lit(2))).alias("folded")).agg(F.count("*").alias("n"))


@query(
    "clf_external_usage",
    """SELECT n_nationkey AS id, CASE WHEN n_regionkey = 4 THEN 'rejected' WHEN s.k IS NOT NULL THEN 'in_use' ELSE 'mapped_empty' END AS state FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 0) s ON k = n_nationkey""",
)
def clf_external_usage(t: Tables) -> DataFrame:
    used = t.supplier.where("s_acctbal > 0").select(F.col("s_nationkey").alias("k")).distinct()
    state = F.expr("CASE WHEN n_regionkey = 4 THEN 'rejected' WHEN k IS NOT NULL THEN 'in_use' ELSE 'mapped_empty' END")
    return t.nation.join(used, F.expr("k = n_nationkey"), "left").select(F.col("n_nationkey").alias("id"), state.alias("state"))


@query(
    "clf_compare",
    """SELECT CASE WHEN a = b THEN 'same' WHEN a = 'none' THEN 'gain' WHEN b = 'none' THEN 'lost' ELSE 'refine' END AS change, count(*) AS n FROM
    (SELECT CASE WHEN size > 10 THEN split_part(path, '/', 1) ELSE 'none' END AS a, CASE WHEN size > 8 THEN CASE WHEN size > 40 THEN path ELSE split_part(path, '/', 1) END ELSE 'none' END AS b FROM products) GROUP BY 1""",
)
def clf_compare(t: Tables) -> DataFrame:
    """Two deciders over the same rows: gained, refined, same, lost."""
    rows = t.products.selectExpr(
        "CASE WHEN size > 10 THEN split_part(path, '/', 1) ELSE 'none' END AS a",
        "CASE WHEN size > 8 THEN CASE WHEN size > 40 THEN path ELSE split_part(path, '/', 1) END ELSE 'none' END AS b",
    )
    change = F.expr("CASE WHEN a = b THEN 'same' WHEN a = 'none' THEN 'gain' WHEN b = 'none' THEN 'lost' ELSE 'refine' END")
    return rows.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query(
    "cur_score",
    """SELECT product_id, 3 * least(regexp_matches(title, 'red')::INT + regexp_matches(title, 'g')::INT, 2) + 0.5 * (n > 20)::INT AS score FROM products JOIN (SELECT product_id, count(*) AS n FROM offers GROUP BY 1) USING (product_id)""",
)
def cur_score(t: Tables) -> DataFrame:
    """Core terms count three, many offers half a point."""
    n = t.offers.groupBy("product_id").agg(F.count("*").alias("n"))
    hits = F.col("title").rlike("red").cast("int") + F.col("title").rlike("g").cast("int")
    return t.products.join(n, "product_id").select("product_id", (3 * F.least(hits, F.lit(2)) + 0.5 * (F.col("n") > 20).cast("int")).alias("score"))


@query(
    "cat_build_verdict",
    "SELECT product_id, CASE WHEN title IS NULL THEN 'no_title' WHEN brand IS NULL THEN 'no_brand' WHEN catalog_price <= 0 THEN 'no_price' WHEN size < 3 THEN 'small' ELSE 'draft' END AS verdict FROM products",
)
def cat_build_verdict(t: Tables) -> DataFrame:
    verdict = F.expr("CASE WHEN title IS NULL THEN 'no_title' WHEN brand IS NULL THEN 'no_brand' WHEN catalog_price <= 0 THEN 'no_price' WHEN size < 3 THEN 'small' ELSE 'draft' END")
    return t.products.select("product_id", verdict.alias("verdict"))


@query("cat_color_siblings", "SELECT a.product_id, count(*) AS siblings FROM products a JOIN products b ON split_part(a.title, ' ', 2) = split_part(b.title, ' ', 2) AND a.brand = b.brand AND a.size = b.size AND a.product_id <> b.product_id GROUP BY 1")
def cat_color_siblings(t: Tables) -> DataFrame:
    """Products with the same model key, self excluded: a count a key less one."""
    key = [F.split_part("title", F.lit(" "), F.lit(2)).alias("model"), F.col("brand"), F.col("size")]
    rows = t.products.select("product_id", *key)
    sizes = rows.groupBy("model", "brand", "size").agg((F.count("*") - 1).alias("siblings")).where("siblings > 0")
    return rows.join(sizes, ["model", "brand", "size"]).select("product_id", "siblings")


@query("flt_visible", "SELECT p.product_id FROM products p ANTI JOIN (SELECT product_id FROM offers GROUP BY 1 HAVING NOT bool_or(in_stock)) o USING (product_id)")
def flt_visible(t: Tables) -> DataFrame:
    hidden = t.offers.groupBy("product_id").agg(F.bool_or("in_stock").alias("any")).where("NOT any")
    return t.products.join(hidden, "product_id", "left_anti").select("product_id")


@query(
    "flt_offer_verified",
    """SELECT product_id, merchant_id, coalesce(bool_or(day >= DATE '1998-01-01' OR price < 100000), true) AS verified FROM prices WHERE list_price > price GROUP BY ALL""",
)
def flt_offer_verified(t: Tables) -> DataFrame:
    """An offer is verified if any of its memberships is not stale."""
    fresh = F.expr("day >= DATE '1998-01-01' OR price < 100000")
    return t.prices.where("list_price > price").groupBy("product_id", "merchant_id").agg(F.coalesce(F.bool_or(fresh), F.lit(True)).alias("verified"))


@query(
    "flt_query_private",
    r"SELECT conv_id, turn, regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+') OR regexp_matches(text, '[0-9]{7,}') OR regexp_matches(text, '(?i)(password|secret|token)') AS blocked FROM conversations",
)
def flt_query_private(t: Tables) -> DataFrame:
    text = F.col("text")
    blocked = text.rlike("[A-Za-z0-9._-]+@[A-Za-z0-9.-]+") | text.rlike("[0-9]{7,}") | text.rlike("(?i)(password|secret|token)")
    return t.conversations.select("conv_id", "turn", blocked.alias("blocked"))


@query(
    "ev_near_dup",
    """WITH w AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents) SELECT a.doc_id AS a, b.doc_id AS b FROM w a JOIN w b ON a.doc_id < b.doc_id AND len(a.w) * 10 >= len(b.w) * 9 AND len(b.w) * 10 >= len(a.w) * 9
    WHERE len(list_intersect(a.w, b.w)) * 10 >= 9 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""",
)
def ev_near_dup(t: Tables) -> DataFrame:
    """Pairs of evaluation texts with token-set similarity of 0.9 or more: prefixes of the rarest tokens meet, exact check after.

    Equal token sets meet through the same prefix; the prefix of a set of n tokens has n - ceil(0.9 n) + 1 of them.
    """
    sets = t.documents.select("doc_id", F.array_distinct(F.split("text", " ")).alias("w"))
    words = sets.select("doc_id", F.size("w").alias("n"), F.explode("w").alias("t"))
    rare = words.groupBy("t").agg(F.count("*").alias("f"))
    order = Window.partitionBy("doc_id").orderBy("f", "t")
    prefix = words.join(rare, "t").withColumn("i", F.row_number().over(order)).where("i <= n - (9 * n + 9) div 10 + 1").select("doc_id", "n", "t")
    two = prefix.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), "t")
    pairs = prefix.join(two, "t").where("doc_id < b AND n * 10 >= m * 9 AND m * 10 >= n * 9").select(F.col("doc_id").alias("a"), "b").distinct()
    near = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return near.where(common * 10 >= 9 * (F.size("x") + F.size("y") - common)).select("a", "b")


@query(
    "ev_classify",
    """SELECT CASE WHEN guess = truth THEN 'exact' WHEN guess = 'none' THEN 'missed' WHEN split_part(guess, '/', 1) = split_part(truth, '/', 1) THEN 'coarse' ELSE 'wrong' END AS outcome, count(*) AS n FROM
    (SELECT path AS truth, CASE size % 4 WHEN 0 THEN 'none' WHEN 1 THEN split_part(path, '/', 1) WHEN 2 THEN 'other/x' ELSE path END AS guess FROM products) GROUP BY 1""",
)
def ev_classify(t: Tables) -> DataFrame:
    rows = t.products.selectExpr("path AS truth", "CASE size % 4 WHEN 0 THEN 'none' WHEN 1 THEN split_part(path, '/', 1) WHEN 2 THEN 'other/x' ELSE path END AS guess")
    outcome = F.expr("CASE WHEN guess = truth THEN 'exact' WHEN guess = 'none' THEN 'missed' WHEN split_part(guess, '/', 1) = split_part(truth, '/', 1) THEN 'coarse' ELSE 'wrong' END")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("ev_comparison_rates", "SELECT event_type, round(avg(CASE WHEN value > 20 THEN (value > 60)::INT END), 6) AS rate FROM events GROUP BY 1")
def ev_comparison_rates(t: Tables) -> DataFrame:
    """A rate over the rows where the outcome is defined."""
    return t.events.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") > 20, (F.col("value") > 60).cast("double"))), 6).alias("rate"))


@query(
    "ev_ab_summary",
    """SELECT count(*) AS n, count(*) FILTER (a = 0) AS zero_a, count(*) FILTER (b = 0) AS zero_b, count(*) FILTER (a = b) AS same FROM
    (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1)""",
)
def ev_ab_summary(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    own = t.events.groupBy("user_id").agg(F.count_if(kind == "click").alias("a"), F.count_if(kind == "purchase").alias("b"))
    n = lambda e: F.count_if(F.expr(e))
    return own.agg(F.count("*").alias("n"), n("a = 0").alias("zero_a"), n("b = 0").alias("zero_b"), n("a = b").alias("same"))


@query("agg_size_options", "SELECT path, size, min(title) AS label, bool_or(in_stock) AS stock FROM products JOIN offers USING (product_id) GROUP BY ALL")
def agg_size_options(t: Tables) -> DataFrame:
    return t.offers.join(t.products, "product_id").groupBy("path", "size").agg(F.min("title").alias("label"), F.bool_or("in_stock").alias("stock"))


@query("agg_store_count", "SELECT product_id, count(DISTINCT lower(trim(merchant))) AS stores FROM offers JOIN merchants USING (merchant_id) WHERE active GROUP BY 1")
def agg_store_count(t: Tables) -> DataFrame:
    live = t.offers.join(t.merchants.where("active"), "merchant_id")
    return live.groupBy("product_id").agg(F.countDistinct(F.lower(F.trim("merchant"))).alias("stores"))


@query("agg_library_roots", "SELECT DISTINCT user_id, split_part(path, '/', 1) AS root FROM events JOIN products ON product_id = event_id % 2000 + 1 WHERE event_type = 'view'")
def agg_library_roots(t: Tables) -> DataFrame:
    seen = t.events.where("event_type = 'view'").select("user_id", (F.col("event_id") % 2000 + 1).alias("product_id"))
    return seen.join(t.products, "product_id").select("user_id", F.split_part("path", F.lit("/"), F.lit(1)).alias("root")).distinct()


@query(
    "cdc_enqueue_stale",
    """SELECT product_id, merchant_id FROM offers ANTI JOIN (SELECT DISTINCT product_id FROM prices WHERE day >= DATE '2001-06-01') USING (product_id) ORDER BY day DESC, product_id, merchant_id LIMIT 100""",
)
def cdc_enqueue_stale(t: Tables) -> DataFrame:
    """Offers of products without a recent check, newest first, at most a batch."""
    recent = t.prices.where("day >= DATE '2001-06-01'").select("product_id")
    return t.offers.join(recent, "product_id", "left_anti").orderBy(F.desc("day"), "product_id", "merchant_id").limit(100).select("product_id", "merchant_id")


@query("cdc_polymorphic_cascade", "SELECT l_orderkey, count(*) AS orphans FROM lineitem ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey GROUP BY 1")
def cdc_polymorphic_cascade(t: Tables) -> DataFrame:
    """Dependents whose parent is gone."""
    parents = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(parents, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("orphans"))


@query("st_alerts", "SELECT user_id, min(event_id) AS fired_by FROM events WHERE event_type = 'view' AND value < 5 GROUP BY 1")
def st_alerts(t: Tables) -> DataFrame:
    """The first event that meets a user's condition; an alert fires once."""
    return t.events.where("event_type = 'view' AND value < 5").groupBy("user_id").agg(F.min("event_id").alias("fired_by"))

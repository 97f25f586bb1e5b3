"""The product catalog as views over the provided tables, in Spark and in SQL.

Money becomes integer minor units once, here; everything derived is a pure function of the tables' columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The instant that stands for now: no query reads the clock.
AS_OF = "1998-12-01"


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def price_points(lineitem: DataFrame) -> DataFrame:
    """One observed price of one offer: product, merchant, day, price, list price, stock."""
    price = half_up(F.col("l_extendedprice") / F.col("l_quantity") * 100)
    return lineitem.select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("merchant_id"),
        F.to_date("l_shipdate").alias("day"),
        price.alias("price"),
        half_up(price / (1 - 3 * F.col("l_discount"))).alias("list_price"),
        (F.col("l_returnflag") != "R").alias("in_stock"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"),
    )


def latest_offers(points: DataFrame) -> DataFrame:
    """The newest observation of every (product, merchant)."""
    newest = F.max(F.struct("day", "point_id", "price", "list_price", "in_stock")).alias("v")
    return points.groupBy("product_id", "merchant_id").agg(newest).select("product_id", "merchant_id", "v.*")


def products(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lower("p_type"), F.lit("/"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("path"),
        F.col("p_size").alias("size"),
        half_up(F.col("p_retailprice") * 100).alias("catalog_price"),
    )


def merchants(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Merchants with a trust of 40 to 100; nations of the first two regions count as local."""
    return supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("merchant_id"),
        F.col("s_name").alias("merchant"),
        F.col("n_name").alias("country"),
        (F.col("n_regionkey") <= 1).alias("local"),
        (F.col("s_suppkey") * 7 % 61 + 40).alias("trust"),
        (F.col("s_acctbal") > 0).alias("active"),
    )


def listings(offers: DataFrame, part: DataFrame) -> DataFrame:
    """What merchants write about the products they offer: titles in several spellings, raw codes, some fields missing.

    A derived table with the faults that normalisation and matching must meet: units and decimals written in two
    ways, words left out, brands, colours and codes missing, placeholder codes, wrong check digits.
    """
    p, m, size = F.col("product_id"), F.col("merchant_id"), F.col("p_size")
    tail = (
        F.when(p % 6 == 0, F.concat(size * 10, F.lit(" ml")))
        .when(p % 6 == 1, F.concat(size, F.when(m % 2 == 0, " LT").otherwise(",0 litre")))
        .when(p % 6 == 2, F.concat(size * 8, F.lit(" GB v"), size % 3 + 1))
        .when(p % 6 == 3, F.concat(size % 40 + 30, F.lit(" numara")))
        .when(p % 6 == 4, F.concat(F.lit("Pro %"), size, F.lit(" indirim 199 TL")))
        .otherwise(F.concat(F.lit("2 x "), size, F.lit(" g")))
    )
    name = F.when(m % 4 == 1, F.regexp_replace("p_name", "^[^ ]+ ", "")).otherwise(F.col("p_name"))
    title = F.concat_ws(" ", name, tail, F.when(m % 7 == 0, F.lit("Max")))
    body = F.lpad(((p * 7919 + 100000) * 1000 + 869).cast("string"), 12, "8")
    digit = lambda i: F.substring(body, i, 1).cast("int")
    total = sum((digit(i) * (3 if i % 2 == 0 else 1) for i in range(2, 13)), digit(1))
    check = (10 - total % 10) % 10
    gtin = F.concat(body, F.when(m % 11 == 0, (check + 1) % 10).otherwise(check).cast("string"))
    code = (
        F.when(m % 3 == 0, F.lit(None).cast("string"))
        .when(m % 13 == 1, F.lit("0000000000000"))
        .when(m % 13 == 2, F.lit("2112345678900"))
        .when(m % 13 == 3, F.concat(F.lit(" "), gtin))
        .otherwise(gtin)
    )
    mpn = F.when(m % 5 == 0, "N/A").when(m % 5 == 1, F.concat(F.lit("ab-"), p + 1000, F.lit("/x"))).otherwise(F.concat(F.lit("AB"), p + 1000, F.lit("X")))
    joined = offers.join(part.select(F.col("p_partkey").alias("product_id"), "p_name", "p_brand", "p_size"), "product_id")
    return joined.select(
        (p * 100000 + m).alias("listing_id"),
        p,
        m,
        title.alias("title"),
        F.when(m % 5 != 3, F.col("p_brand")).alias("brand"),
        F.when(m % 4 != 1, F.regexp_extract("p_name", "^[^ ]+", 0)).alias("color"),
        code.alias("gtin"),
        mpn.alias("mpn"),
    )


SQL = {
    "prices": """SELECT l_partkey AS product_id, l_suppkey AS merchant_id, l_shipdate::DATE AS day, price,
  floor(price / (1 - 3 * l_discount) + 0.5)::BIGINT AS list_price, l_returnflag <> 'R' AS in_stock,
  l_orderkey * 10 + l_linenumber AS point_id
  FROM (SELECT *, floor(l_extendedprice / l_quantity * 100 + 0.5)::BIGINT AS price FROM lineitem)""",
    "offers": """SELECT product_id, merchant_id, day, point_id, price, list_price, in_stock FROM prices
  QUALIFY row_number() OVER (PARTITION BY product_id, merchant_id ORDER BY day DESC, point_id DESC) = 1""",
    "products": """SELECT p_partkey AS product_id, p_name AS title, p_brand AS brand,
  lower(p_type) || '/' || split_part(p_name, ' ', 2) AS path, p_size AS size, floor(p_retailprice * 100 + 0.5)::BIGINT AS catalog_price FROM part""",
    "merchants": """SELECT s_suppkey AS merchant_id, s_name AS merchant, n_name AS country, n_regionkey <= 1 AS local,
  s_suppkey * 7 % 61 + 40 AS trust, s_acctbal > 0 AS active FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "listings": """SELECT p * 100000 + m AS listing_id, p AS product_id, m AS merchant_id,
  concat_ws(' ', CASE WHEN m % 4 = 1 THEN regexp_replace(p_name, '^[^ ]+ ', '') ELSE p_name END,
    CASE p % 6 WHEN 0 THEN p_size * 10 || ' ml' WHEN 1 THEN p_size || CASE WHEN m % 2 = 0 THEN ' LT' ELSE ',0 litre' END
      WHEN 2 THEN p_size * 8 || ' GB v' || (p_size % 3 + 1) WHEN 3 THEN p_size % 40 + 30 || ' numara'
      WHEN 4 THEN 'Pro %' || p_size || ' indirim 199 TL' ELSE '2 x ' || p_size || ' g' END,
    CASE WHEN m % 7 = 0 THEN 'Max' END) AS title,
  CASE WHEN m % 5 <> 3 THEN p_brand END AS brand,
  CASE WHEN m % 4 <> 1 THEN regexp_extract(p_name, '^[^ ]+') END AS color,
  CASE WHEN m % 3 = 0 THEN NULL WHEN m % 13 = 1 THEN '0000000000000' WHEN m % 13 = 2 THEN '2112345678900'
    WHEN m % 13 = 3 THEN ' ' || g ELSE g END AS gtin,
  CASE m % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'ab-' || (p + 1000) || '/x' ELSE 'AB' || (p + 1000) || 'X' END AS mpn
  FROM (SELECT *, b || CASE WHEN m % 11 = 0 THEN (c + 1) % 10 ELSE c END AS g FROM (
    SELECT *, (10 - list_sum(list_transform(range(1, 13), lambda i: substr(b, i, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS c
    FROM (SELECT o.product_id AS p, merchant_id AS m, p_name, p_brand, p_size,
      lpad(((o.product_id * 7919 + 100000) * 1000 + 869)::VARCHAR, 12, '8') AS b FROM offers o JOIN part ON p_partkey = o.product_id)))""",
}


def with_views(sql: str) -> str:
    head = ", ".join(f"{name} AS ({body})" for name, body in SQL.items())
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {text[15:]}"
    if text[:5].upper() == "WITH ":
        return f"WITH {head}, {text[5:]}"
    return f"WITH {head} {text}"

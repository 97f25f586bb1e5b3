"""Feed files as DataFrames: CSV, JSON lines, JSON arrays, XML records and exchange rates; CSV out with safe cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Headered CSV; blank cells are absent."""
    rows = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, escape='"')
    return rows.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns])


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; lines that are no object are kept in `malformed`."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select(parsed.alias("r")).select("r.*").withColumnRenamed("_bad", "malformed")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A top-level array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def xml(spark: SparkSession, path: str, record: str, schema: str) -> DataFrame:
    """Records by tag, each parsed on its own; attributes as `@name`, namespaces ignored, bad records in `malformed`."""
    options = {"rowTag": record, "attributePrefix": "@", "ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}
    return spark.read.format("xml").options(**options).schema(f"{schema}, malformed STRING").load(path)


def complete(spark: SparkSession, path: str, closing: str) -> DataFrame:
    """Per file: does its text hold the closing tag?"""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.contains("value", F.lit(closing)).alias("closed"))
    return rows.groupBy("file").agg(F.bool_or("closed").alias("complete"))


def exchange_rates(spark: SparkSession, path: str) -> DataFrame:
    """Central-bank XML: rate per unit with eight digits; non-positive rates and special drawing rights are left out."""
    schema = "`@CurrencyCode` STRING, Unit INT, ForexSelling DECIMAL(20, 8)"
    rows = xml(spark, path, "Currency", schema).where("ForexSelling > 0 AND Unit > 0 AND `@CurrencyCode` <> 'XDR'")
    return rows.select(F.col("@CurrencyCode").alias("currency"), (F.col("ForexSelling") / F.col("Unit")).cast("decimal(20,8)").alias("rate"))


def money(text: Column) -> Column:
    """Locale text to minor units: the last separator with one or two digits after it is the decimal one; else NULL or whole."""
    plain = F.regexp_replace(text, r"[^0-9.,-]", "")
    decimal = F.regexp_extract(plain, r"[.,]([0-9]{1,2})$", 1)
    whole = F.regexp_replace(F.regexp_replace(plain, r"[.,][0-9]{1,2}$", ""), "[.,]", "")
    cents = whole.try_cast("long") * 100 + F.rpad(decimal, 2, "0").try_cast("long")
    return F.when(cents > 0, cents)


def safe_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*[safe_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]).write.csv(path, header=True)

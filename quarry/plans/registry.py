"""All registered queries of the engine, each with the SQL that DuckDB runs to check it."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
MODULES = (
    "quarry.operators.aggregates",
    "quarry.operators.joins",
    "quarry.operators.windows",
    "quarry.operators.prices",
    "quarry.operators.feeds",
    "quarry.operators.analytics",
    "quarry.operators.evaluation",
    "quarry.operators.matching",
    "quarry.operators.catalog",
    "quarry.functions.text",
    "quarry.functions.identifiers",
    "quarry.functions.identity",
    "quarry.functions.titles",
    "quarry.functions.extents",
    "quarry.operators.resolution",
    "quarry.operators.nearest",
    "quarry.operators.requests",
    "quarry.operators.search",
    "quarry.operators.series",
    "quarry.operators.classify",
    "quarry.operators.brands",
    "quarry.operators.spelling",
    "quarry.operators.dynamic",
    "quarry.operators.queries",
    "quarry.operators.sources",
    "quarry.operators.pages",
    "quarry.operators.merge",
    "quarry.operators.diverse",
    "quarry.operators.suggest",
)


class Tables:
    """The tables of one folder, and the catalog views that are built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def prices(self) -> DataFrame:
        return views.price_points(self.lineitem)

    @cached_property
    def offers(self) -> DataFrame:
        return views.latest_offers(self.prices)

    @cached_property
    def listings(self) -> DataFrame:
        return views.listings(self.offers, self.part)

    @cached_property
    def products(self) -> DataFrame:
        return views.products(self.part)

    @cached_property
    def merchants(self) -> DataFrame:
        return views.merchants(self.supplier, self.nation)


def query(name: str, sql: str | None = None, dates: str = "") -> Callable:
    """Register a function of Tables under `name`; `sql` may use the views of quarry.plans.views by name.

    Columns listed in `dates` are returned as ISO text by both.
    """

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(Tables(spark, sf_dir))
            return found.withColumns({c: found[c].cast("string") for c in dates.split()}) if dates else found

        _QUERIES[name] = run
        if sql is not None:
            text = views.with_views(sql)
            casts = ", ".join(f"{c}::VARCHAR AS {c}" for c in dates.split())
            _ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({text})" if dates else text
        return f

    return add


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    for module in MODULES:
        importlib.import_module(module)

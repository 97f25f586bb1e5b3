"""Equal queries, titles and listings are compared once; results are those of the SQL."""

from collections import Counter

import duckdb
import pytest

from quarry.functions import titles
from quarry.operators import search
from quarry.plans import registry

ROOT = "/root/testdata/sf0.001"
COPIES = 5


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The smallest tables with every product five times under other keys, and DuckDB over them."""
    base = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    shifted = {"part": "p_partkey", "lineitem": "l_partkey"}
    for name in ("part", "lineitem", "supplier", "nation", "region", "embeddings"):
        source = f"SELECT * FROM '{ROOT}/{name}.parquet'"
        if name in shifted:
            key = shifted[name]
            source = f"SELECT * REPLACE (({key} + 200 * i)::BIGINT AS {key}) FROM ({source}), (SELECT unnest(range({COPIES})) AS i) c".replace("SELECT * REPLACE", "SELECT * EXCLUDE (i) REPLACE")
        con.execute(f"COPY ({source}) TO '{base}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{base}/{name}.parquet'")
    return str(base), con


def rows_of(rows, columns):
    return Counter(tuple(round(x, 5) if isinstance(x, float) else x for x in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", ["flt_gate", "q_candidates", "q_score", "q_search", "q_slot_similarity", "str_fts_prefix"])
def test_repeated_products_give_what_sql_gives(spark, repeated, name):
    base, con = repeated
    found = registry.queries()[name](spark, base)
    columns = found.columns
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rows_of(found.collect(), columns) == rows_of((dict(zip(columns, r, strict=True)) for r in expected), columns)


@pytest.mark.parametrize("name", ["flt_gate", "q_candidates", "q_score", "q_search", "q_slot_similarity"])
def test_equal_words_are_compared_once(spark, repeated, name, monkeypatch):
    """The word pairs that are judged are no more with five copies of each product than with one."""
    seen = []
    judge = search.rated
    monkeypatch.setattr(search, "rated", lambda met: (seen.append(met.count()), judge(met))[1])
    for folder in (ROOT, repeated[0]):
        registry.queries()[name](spark, folder)
    assert seen[1] <= seen[0] * 1.3


def test_equal_titles_meet_prefixes_once(spark):
    asks = spark.createDataFrame([(q, ["red", "bol"]) for q in range(4)], "query_id long, asked array<string>")
    products = spark.createDataFrame([(p, "red bolt") for p in range(9)], "product_id long, title string")
    found = titles.prefix_hits(asks, products)
    assert found.count() == 36

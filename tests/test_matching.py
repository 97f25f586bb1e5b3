"""Listings of equal forms are compared once; title pairs are those of brute force, whatever titles' lengths."""

import random

import pytest
from test_search import repeated, rows_of  # noqa: F401

from quarry.operators import resolution
from quarry.plans import registry

MATCHING = ["er_auto", "er_best_match", "er_candidates", "er_calibrate", "er_color_review", "er_exact", "er_hybrid", "er_resolve_offers", "er_text_score", "er_veto"]


def first_thirty(left, right):
    out = set()
    for listing, brand, words in left:
        near = []
        for product, other, known in right:
            both = set(words) & set(known)
            if brand == other and any(len(w) >= 3 and w.isalpha() for w in both):
                near.append((-len(both) / len(set(words) | set(known)), product))
        out |= {(listing, product) for _, product in sorted(near)[: resolution.PER_CHANNEL]}
    return out


@pytest.mark.parametrize("limit", [8, 4, 0])
def test_title_pairs_are_those_of_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(resolution, "SUBSETS_OF", limit)
    draw = random.Random(5)
    vocabulary = ["red", "blue", "bolt", "ring", "gear", "5l", "64gb", "v2", "x", "30", "pro"]
    title = lambda: sorted(draw.sample(vocabulary, draw.randint(0, 7)))
    left = [(i, draw.choice(["a", "b"]), title()) for i in range(150)]
    right = [(1000 + draw.randrange(10**6) * 500 + i, draw.choice(["a", "b"]), title()) for i in range(400)]
    one = spark.createDataFrame(left, "listing_id long, brand_norm string, tokens array<string>")
    two = spark.createDataFrame(right, "r_product_id long, r_brand_norm string, r_tokens array<string>")
    found = [tuple(r) for r in resolution.title_pairs(one, two).select("listing_id", "r_product_id").collect()]
    assert len(found) == len(set(found)) and set(found) == first_thirty(left, right)


def test_forms_come_back(spark):
    rows = [(["a", "b"], ["1"], "x", None, None, "40", "pro+v2"), ([], [], None, "", "5l", None, None)]
    types = ", ".join(f"{c} array<string>" if c in resolution.LISTS else f"{c} string" for c in resolution.FORM)
    forms = spark.createDataFrame(rows, types).select(resolution.form_of().alias("form"))
    back = forms.select(*[x.alias(c) for c, x in resolution.unpacked("form").items()]).collect()
    assert sorted(map(str, back)) == sorted(str(r) for r in spark.createDataFrame(rows, types).collect())


def test_forms_are_compared_once(spark, repeated, monkeypatch):  # noqa: F811
    """Copies of a product on other keys add no titles to compare (their tails differ, so three times the forms at most)."""
    seen = []
    judge = resolution.title_pairs
    monkeypatch.setattr(resolution, "title_pairs", lambda left, right: (seen.append((left.count(), right.count())), judge(left, right))[1])
    registry.queries()["er_veto"](spark, repeated[0])
    assert seen[0][0] < 3 * seen[0][1]


def test_repeated_listings_match_as_sql_has_them(spark, repeated):  # noqa: F811
    base, con = repeated
    for name in MATCHING:
        found = registry.queries()[name](spark, base)
        columns = found.columns
        expected = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert rows_of(found.collect(), columns) == rows_of((dict(zip(columns, r, strict=True)) for r in expected), columns), name

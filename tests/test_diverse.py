"""The diverse choice against one sequential loop over each group, with small and large blocks."""

import random
from collections import Counter

import pytest

from quarry.operators import diverse


def loop(rows, target):
    out = {}
    merchant_cap, category_cap = diverse.caps(target)
    for root in {r[0] for r in rows}:
        taken, brands, merchants, categories = [], Counter(), Counter(), Counter()
        for r in sorted((r for r in rows if r[0] == root), key=lambda r: (-r[2], -r[3], r[1])):
            _, pid, _, _, brand, merchant, category, sig, family = r
            if len(taken) == target:
                break
            if (brand and brands[brand] >= 3) or merchants[merchant] >= merchant_cap or (category and categories[category] >= category_cap):
                continue
            if any(len(set(sig) & set(s)) / len(set(sig) | set(s)) >= 0.75 or (len(family) >= 3 and family == f) for _, s, f in taken if sig and s):
                continue
            taken.append((pid, sig, family))
            brands[brand] += 1
            merchants[merchant] += 1
            categories[category] += 1
        out[root] = [t[0] for t in taken]
    return out


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_choice_equals_a_loop(spark, block, monkeypatch):
    monkeypatch.setattr(diverse, "BLOCK", block)
    rng = random.Random(11)
    rows = []
    for i in range(300):
        words = sorted(rng.sample("abcdefghij", rng.randint(2, 5)))
        rows.append((rng.choice("xxy"), i, float(rng.randint(0, 9)), rng.randint(1, 3), rng.choice(["p", "q", "r", "s", None]), rng.randint(1, 4), rng.choice(["x/a", "x/b", None]), words, words[:3]))
    found = {}
    for r in sorted(diverse.chosen(spark.createDataFrame(rows, diverse.COLUMNS), target=12).collect(), key=lambda r: r.place):
        found.setdefault(r.root, []).append(r.product_id)
    assert found == loop(rows, 12)


def test_nothing_to_choose_from(spark):
    assert diverse.chosen(spark.createDataFrame([], diverse.COLUMNS)).count() == 0

"""Strict word similarity against every run of words."""

import random

from quarry.functions import extents
from quarry.plans import registry

ROOT = "/root/testdata/sf0.001"


def brute(asked, words):
    wanted = frozenset().union(*map(extents.trigrams, asked)) if asked else frozenset()
    best = 0.0
    for i in range(len(words)):
        got = set()
        for j in range(i, len(words)):
            got |= extents.trigrams(words[j])
            best = max(best, len(wanted & got) / len(wanted | got))
    return best


def test_best_run_equals_brute_force():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    for _ in range(400):
        vocabulary = [word() for _ in range(rng.randint(1, 12))]
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        asked = [rng.choice([*vocabulary, word()]) for _ in range(rng.randint(0, 3))]
        score, first, last = extents.best_extent(asked, words)
        assert abs(score - brute(asked, words)) < 1e-12
        if score:
            assert abs(brute(asked, words[first:last]) - score) < 1e-12


def test_repeated_words_take_no_longer():
    assert extents.best_extent(["same"], ["same"] * 200000) == (1.0, 0, 1)
    assert extents.best_extent(["samf"], ["same", "other"] * 100000)[0] > 0.4


def test_every_document_finds_its_own_words(spark):
    found = registry.queries()["str_strict_word_sim"](spark, ROOT).collect()
    assert len(found) == spark.read.parquet(f"{ROOT}/documents.parquet").count()
    assert sum(r.score >= 0.4 for r in found) > 0.8 * len(found)

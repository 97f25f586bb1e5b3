"""Small documents with every defined edge case."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, mark string"


def make_docs():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["Ünï", "ß", "é#", "naïve"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = line(70)
    docs = ["\n".join(line(rng.randint(3, 60)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    docs += docs[:4]  # exact copies
    docs += [docs[5].replace(" w1", " x1", 1), docs[6] + " tail", docs[7].upper()]
    docs += [f"{line(9)} {passage} {line(9)}" for _ in range(3)] + [passage, passage + "\n" + passage]
    docs += ["same " * 130, "same " * 90 + "end", "ab" * 400, "\n".join(["short line here now"] * 5)]
    docs += ["", "   \n\t ", "word", "two words", None, None, line(3000), "a\x0bb\x0cc\rd\te"]
    rows = [(i, t) for i, t in enumerate(docs)]
    rows += [(3, docs[3]), (5, "another text under a used id " * 8), (None, docs[1]), (None, None)]
    return [(i, t, "en", "s", len(t or ""), "r", 1, "m") for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

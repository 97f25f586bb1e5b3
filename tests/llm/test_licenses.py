"""Licence scans against a backtracking matcher over the templates' parts, with every defined edge case."""

import random
import re
from collections import Counter

import pytest

from quarry.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ends(parts, ws, i):
    """All places where a match of the parts that starts at i may end."""
    found = {i}
    for part in parts:
        if isinstance(part, bytes):
            found = {j + 1 for j in found if j < len(ws) and ws[j] == part.decode()}
        elif part[0] == "opt":
            found |= {e for j in found for e in ends(part[1], ws, j)}
        elif part[0] == "one":
            found = {e for j in found for option in part[1] for e in ends(option, ws, j)}
        else:
            found = {j + k for j in found for k in range(part[1] + 1) if j + k <= len(ws)}
    return found


def brute(doc_id, text, templates):
    ws = words(text)
    places = [
        (i, label)
        for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items()
        for i in range(len(ws))
        if ws[i : i + len(phrase.split())] == phrase.split()
    ]
    base = {label for _, label in places}
    found = {name for name, markup in templates.items() if any(ends(licenses.parsed(markup), ws, i) for i in range(len(ws)))}
    at = [i for i, _ in places]
    score = 1.0 if found else 0.5 if base else 0.0
    return doc_id, len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score


def written(parts, rng):
    """A text that a template accepts."""
    out = []
    for part in parts:
        if isinstance(part, bytes):
            out.append(part.decode().upper() if rng.random() < 0.2 else part.decode())
        elif part[0] == "opt":
            out += written(part[1], rng) if rng.random() < 0.5 else []
        elif part[0] == "one":
            out += written(rng.choice(part[1]), rng)
        else:
            out += [rng.choice(["acme", "the", "licensed", "neither"]) for _ in range(rng.randint(0, part[1]))]
    return out


def license_texts():
    rng = random.Random(9)
    texts = ["MIT License, the mit\tlicense; Mit license", "general public licence", "apache license apache license"]
    for markup in licenses.TEMPLATES.values():
        for _ in range(6):
            ws = written(licenses.parsed(markup), rng)
            texts.append("before (c) 2020 " + rng.choice([" ", "\n", ", "]).join(ws) + ". after")
            k = rng.randrange(len(ws))
            texts.append(" ".join(ws[:k] + ws[k + 1 :]))  # a word is missing
            texts.append(" ".join(ws[:k] + ["other"] + ws[k:]))  # a word too many
    texts.append(texts[3] + " licensed under " * 2000 + texts[3])
    return texts


def test_scan_equals_brute_force(spark, docs, rows):
    more = [(1000 + i, t) for i, t in enumerate(license_texts())]
    extra = spark.createDataFrame([(i, t, "en", "s", 0, "r", 1, "m") for i, t in more], docs.schema)
    found = Counter(tuple(r) for r in licenses.license_scan(docs.union(extra)).collect())
    assert found == Counter(brute(i, t, licenses.TEMPLATES) for i, t in [r[:2] for r in rows] + more)
    assert sum("-" in r[6] for r in found) >= 40


def test_regions_nest_and_overlap():
    templates = {
        "nested": "a <<opt>>b <<opt>>c <<end>>d <<end>>e",
        "any": "x <<any:2>> y <<any:1>>",
        "one": "p <<one:q r|q|>> s",
        "restart": "a a <<opt>>b<<end>> c",
    }
    rng = random.Random(2)
    automaton = licenses.Automaton(templates)
    for _ in range(3000):
        text = " ".join(rng.choice("abcdexypqrs") for _ in range(rng.randint(0, 9)))
        expected = [n for n, m in templates.items() if any(ends(licenses.parsed(m), words(text), i) for i in range(len(words(text))))]
        assert automaton.accepted(licenses.terms(text.encode())) == expected, text


def test_bad_markup():
    for markup in ("a <<end>>", "a <<opt>> b", "<<any:3>> a", "<<opt>>a<<end>>"):
        with pytest.raises(ValueError):
            licenses.Automaton({"t": markup})


def test_empty_table(empty):
    assert licenses.license_scan(empty).count() == 0

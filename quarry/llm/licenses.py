"""Licence scans by template markup.

A licence template is its wording with marked regions: optional ones, which a text may leave out, and replaceable ones,
where a text may hold other words: any of a number, or one of a list. All templates are compiled to one position automaton
over words: a position for each word of the wording, and for each position the set of those that may follow it, as the
bits of an integer. A text is accepted by a template if a run of its words passes the automaton from start to end, so that
all mandatory wording stands there exactly, in order, with nothing in between but marked regions. Runs start at every
place where a template's first word stands and go on together, as one set of positions, so a text is read once; the sets
met are remembered with their successors. Texts without any template's first word are not run at all.

Beside the templates, base phrases give labels of their own wherever their words stand next to each other.

Defined results: case (of A-Z), punctuation and line breaks don't matter; null, empty and wordless texts have no labels,
empty label strings and score 0; whole texts are read, however long; every row is judged alone, so repeated rows are
judged alike; doc_id is passed through, null included; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.terms import LOWER_SQL, TERM, terms

#: Phrases and the labels that they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Markup: <<opt>>...<<end>> may be left out; <<any:n>> stands for 0 to n words; <<one:a|b c>> for one of the wordings.
TEMPLATES = {
    "apache-2.0-notice": "<<one:Licensed|Released|Distributed>> under the <<opt>>terms of the <<end>>Apache License, Version 2.0",
    "mit-notice": "<<one:Licensed|Released|Distributed>> under the <<opt>>terms of the <<end>>MIT License",
    "gpl-notice": "licensed under the <<opt>>terms of the <<end>>GNU General Public License<<opt>> as published by the Free "
    "Software Foundation<<end>><<opt>>, either<<end>>, version <<one:2|3>>",
    "cc-notice": "Licensed under <<opt>>the <<end>><<opt>>Creative Commons <<end>>CC <<one:BY-NC-SA|BY-NC-ND|BY-NC|BY-SA|BY-ND|BY>> "
    "<<one:1.0|2.0|2.5|3.0|4.0>>",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice <<opt>>(including the next paragraph) <<end>>shall be included in all copies or substantial "
    'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: <<one:1.||*>> Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. <<one:2.||*>> Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.<<opt>> <<one:3.||*>> Neither the name of <<any:12>> nor the names of its "
    "contributors may be used to endorse or promote products derived from this software without specific prior written "
    "permission.<<end>> THIS SOFTWARE IS PROVIDED BY <<any:12>> AS IS",
    "isc-text": "Permission to use, copy, modify, and<<one:/or|>> distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
}

_MARK = re.compile(r"<<(opt|end|any:\d+|one:[^>]*)>>")
#: Sets of positions that a task remembers.
KNOWN_SETS = 1 << 17


def parsed(markup: str) -> list:
    """A template as nested parts: words (bytes), ("any", n), ("one", wordings), ("opt", parts)."""
    stack: list[list] = [[]]
    for i, piece in enumerate(_MARK.split(markup)):
        if i % 2 == 0:
            stack[-1] += terms(piece.encode())
        elif piece == "opt":
            stack.append([])
        elif piece == "end":
            if len(stack) == 1:
                raise ValueError(f"a region ends that never began: {markup[:60]}")
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        else:
            kind, value = piece.split(":", 1)
            stack[-1].append((kind, int(value) if kind == "any" else [terms(x.encode()) for x in value.split("|")]))
    if len(stack) > 1:
        raise ValueError(f"a region never ends: {markup[:60]}")
    return stack[0]


class Automaton:
    """The templates' positions: which word each takes, which may follow, which start and end a template."""

    def __init__(self, templates: dict[str, str]):
        self.follow: list[int] = []
        self.at: dict[bytes, int] = {}
        self.wild = self.first = self.last = 0
        self.ends: dict[str, int] = {}
        for name, markup in templates.items():
            nullable, first, last = self._sequence(parsed(markup))
            if nullable or first & self.wild:
                raise ValueError(f"template {name} has no wording to start with")
            self.first |= first
            self.last |= last
            self.ends[name] = last
        self.starts = [w for w, bits in self.at.items() if bits & self.first]
        self.next: dict[tuple[int, bytes], int] = {}

    def _position(self, word: bytes | None) -> tuple[bool, int, int]:
        bit = 1 << len(self.follow)
        self.follow.append(0)
        if word is None:
            self.wild |= bit
        else:
            self.at[word] = self.at.get(word, 0) | bit
        return False, bit, bit

    def _sequence(self, parts: list) -> tuple[bool, int, int]:
        nullable, first, last = True, 0, 0
        for part in parts:
            if isinstance(part, bytes):
                empty, starts, ends = self._position(part)
            elif part[0] == "opt":
                _, starts, ends = self._sequence(part[1])
                empty = True
            elif part[0] == "one":
                found = [self._sequence(wording) for wording in part[1]]
                empty = any(x[0] for x in found)
                starts, ends = (self._either(x[i] for x in found) for i in (1, 2))
            else:
                empty, starts, ends = True, 0, 0
                for _ in range(part[1]):  # a chain that may be left after any of its words
                    _, bit, _ = self._position(None)
                    self._link(ends, bit)
                    starts, ends = starts or bit, ends | bit
            self._link(last, starts)
            first |= starts if nullable else 0
            last = ends | (last if empty else 0)
            nullable = nullable and empty
        return nullable, first, last

    @staticmethod
    def _either(sets) -> int:
        out = 0
        for bits in sets:
            out |= bits
        return out

    def _link(self, ends: int, starts: int) -> None:
        for i in self._bits(ends):
            self.follow[i] |= starts

    @staticmethod
    def _bits(bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low

    def step(self, state: int, word: bytes) -> int:
        """The positions reached by a word from those of `state` or from a template's start."""
        takes = self.at.get(word, 0)
        key = state, word if takes else b""
        if key not in self.next:
            if len(self.next) >= KNOWN_SETS:
                self.next.clear()
            after = self.first
            for i in self._bits(state):
                after |= self.follow[i]
            self.next[key] = after & (takes | self.wild)
        return self.next[key]

    def accepted(self, words: list[bytes]) -> list[str]:
        """The templates that some run of the words passes whole."""
        ends, i, n = 0, 0, len(words)
        known = set(words)
        starts = [w for w in self.starts if w in known]
        places = sorted(p for w in starts for p in _places(words, w))
        for place in places:
            if place < i:
                continue
            i, state = place, 0
            while i < n:
                state = self.step(state, words[i])
                i += 1
                if not state:
                    break
                ends |= state & self.last
        return [name for name, last in self.ends.items() if last & ends]


def _places(words: list[bytes], word: bytes) -> Iterator[int]:
    at = -1
    try:
        while True:
            at = words.index(word, at + 1)
            yield at
    except ValueError:
        return


def phrase_places(words: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """Where each phrase's words stand next to each other, with its label."""
    return [
        (place, label)
        for phrase, label in phrases.items()
        for place in _places(words, phrase[0])
        if tuple(words[place : place + len(phrase)]) == phrase
    ]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of (doc_id, text): base phrases, labels, and score 1 (a template accepts), 0.5 (phrases only) or 0."""
    templates = dict(TEMPLATES if templates is None else templates)
    split = {tuple(terms(p.encode())): label for p, label in (PHRASES if phrases is None else phrases).items()}
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = terms(text.as_py())
                places = phrase_places(words, split)
                found = automaton.accepted(words)
                base = {label for _, label in places}
                at = [place for place, _ in places]
                score = 1.0 if found else 0.5 if base else 0.0
                labels = ",".join(sorted(base | set(found)))
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), labels, score))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scan, SCHEMA)


def template_regex(markup: str) -> str:
    """A template as a regular expression over words that each have one space before them."""

    def regex(parts: list) -> str:
        out = ""
        for part in parts:
            if isinstance(part, bytes):
                out += " " + part.decode()
            elif part[0] == "opt":
                out += f"(?:{regex(part[1])})?"
            elif part[0] == "one":
                out += f"(?:{'|'.join(regex(x) for x in part[1])})"
            else:
                out += f"(?: [^ ]+){{0,{part[1]}}}"
        return out

    return regex(parsed(markup)) + " "


def license_sql() -> str:
    """The same in SQL: phrases by positions in the list of words, templates by regular expressions over it."""
    at = " AND ".join
    places = "\nUNION ALL ".join(
        f"SELECT r, i - 1 AS pos, '{label}' AS label FROM (SELECT r, ws, unnest(list_filter(range(1, len(ws) + 1), lambda j: ws[j] = '{phrase.split()[0]}')) AS i FROM d) "
        f"WHERE {at(f'''ws[i + {k}] = '{w}' ''' for k, w in enumerate(phrase.split()))}"
        for phrase, label in PHRASES.items()
    )
    accepted = "\nUNION ALL ".join(
        f"SELECT r, '{name}' AS label FROM d WHERE regexp_matches(line, '{template_regex(markup)}')" for name, markup in TEMPLATES.items()
    )
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWER_SQL}, '{TERM}'), []) AS ws FROM documents),
d AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM w),
p AS ({places}),
a AS ({accepted}),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY r),
x AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION ALL SELECT r, label FROM a) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(b.labels, '') AS base_labels,
  coalesce(x.labels, '') AS labels,
  CASE WHEN r IN (SELECT r FROM a) THEN 1.0::DOUBLE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN x USING (r)"""

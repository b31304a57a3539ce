"""License scans: template-markup matching.

Templates are license texts and notices in the markup of license templates: `<<beginOptional>>` to `<<endOptional>>` may be left
out, and `<<var;name="...";original="...";match="...">>` stands for other words: `.+`, `.*` or `.{a,b}` for so many words, or
alternatives parted by `|`. All other wording is mandatory. The templates are compiled into one automaton over words. It is
run from every word that a template begins with; what it accepts has all mandatory words, exactly and in order, and
nothing between them but what an optional or replaceable region allows. States are determined as they are met and kept
in a cache of bounded size.

The phrases of the base are templates without regions, in the same automaton. Each text is scanned where it is read:
no shuffle. Replaceable regions are bounded, so a match is at most `reach` words long, and texts of any length are scanned
in parts that overlap by as much.

Defined results: a null text is empty and has no words, places or labels; repeated rows get equal rows; an empty table gives an empty
table; a template that begins with a replaceable region is refused. Columns other than doc_id and text are not read.
The score is 1 where the wording of a template was accepted, 0.5 where only a phrase stands, else 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import slices

#: The phrases of the base and their labels.
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

#: Wording of public licenses and of the notices that name them.
TEMPLATES = {
    "gpl-2.0": """GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>
        <<beginOptional>>either<<endOptional>> version 2 <<beginOptional>>of the License<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>""",
    "gpl-3.0": """GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>
        <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the License<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>""",
    "lgpl": """GNU <<var;name="title";original="Lesser";match="Lesser|Library">> General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>""",
    "apache-2.0": """Apache License <<beginOptional>>Version<<endOptional>> 2.0 <<beginOptional>>(the "License") you may not use this file except in compliance with the License<<endOptional>>""",
    "mpl-2.0": """<<var;name="place";original="the";match="the|the terms of the">> Mozilla Public License <<beginOptional>>v.<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0""",
    "cc-by-4.0": """CC BY 4.0""",
    "cc-by-sa-4.0": """CC BY-SA 4.0""",
    "cc-by-nc-4.0": """CC BY-NC 4.0""",
    "cc-by-nd-4.0": """CC BY-ND 4.0""",
    "cc-by-nc-sa-4.0": """CC BY-NC-SA 4.0""",
    "creative-commons": """Creative Commons Attribution <<var;name="kind";original="";match="NonCommercial|ShareAlike|NoDerivatives|NonCommercial ShareAlike|NonCommercial NoDerivatives|">>
        <<var;name="version";original="4.0";match="1.0|2.0|2.5|3.0|4.0">> <<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>>""",
    "spdx-tag": """SPDX-License-Identifier <<var;name="id";original="";match=".+">>""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="what";original="this software and associated documentation files";match=".{1,12}">>
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions
        <<beginOptional>>The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software<<endOptional>>
        <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND<<endOptional>>""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
        <<var;name="bullet1";original="1.";match=".{0,1}">> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
        <<var;name="bullet2";original="2.";match=".{0,1}">> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution
        <<beginOptional>><<var;name="bullet3";original="3.";match=".{0,1}">> Neither the name of <<var;name="owner";original="the copyright holder";match=".{1,20}">> nor the names of its contributors
        may be used to endorse or promote products derived from this software without specific prior written permission<<endOptional>>""",
    "unlicense": """This is free and unencumbered software released into the public domain""",
}

#: Words that `.+` and `.*` stand for at most, bytes of a part of a text, and steps that a worker keeps.
MOST_REPLACED, STEP, CACHED_STEPS = 20, 1 << 20, 200_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_in(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def parse(markup: str) -> list:
    """The markup as a list: words, ("optional", list) and ("any", least, most) or ("one of", lists)."""
    stack: list[list] = [[]]
    for i, piece in enumerate(re.split(r"<<(.*?)>>", markup, flags=re.DOTALL)):
        if not i % 2:
            stack[-1] += words_in(piece)
        elif piece == "beginOptional":
            stack.append([])
        elif piece == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without a begin")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif piece.startswith("var;"):
            match = dict(re.findall(r'(\w+)="([^"]*)"', piece))["match"]
            if count := re.fullmatch(r"\.(\+|\*|\{(\d+),(\d+)\})", match):
                least, most = (int(count[2]), int(count[3])) if count[2] else (1 if count[1] == "+" else 0, MOST_REPLACED)
                stack[-1].append(("any", least, most))
            else:
                stack[-1].append(("one of", [words_in(x) for x in match.split("|")]))
        else:
            raise ValueError(f"unknown markup: {piece[:40]}")
    if len(stack) > 1:
        raise ValueError("beginOptional without an end")
    return stack[0]


class TokenAutomaton:
    """Accepts the wording of templates, from a given word on."""

    def __init__(self, templates: dict[str, str]):
        #: By state: the states that a word leads to (None: any word), and those reached without one.
        self.edges: list[dict[bytes | None, set[int]]] = []
        self.free: list[set[int]] = []
        self.ends: dict[int, str] = {}
        root = self._state()
        for label, markup in templates.items():
            begin = self._state()
            self.free[root].add(begin)
            self.ends[self._add(parse(markup), begin)] = label
        self.root = self._closed({root})
        self.known = {w for e in self.edges for w in e if w is not None}
        self.first = frozenset(w for s in self.root for w in self.edges[s] if w is not None)
        if any(None in self.edges[s] or s in self.ends for s in self.root):
            raise ValueError("a template must begin with a word of its own")
        self.reach = self._reach()
        self.steps: dict = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "steps": {}}

    def _state(self) -> int:
        self.edges.append({})
        self.free.append(set())
        return len(self.edges) - 1

    def _word(self, at: int, word: bytes | None) -> int:
        to = self._state()
        self.edges[at].setdefault(word, set()).add(to)
        return to

    def _add(self, nodes: list, at: int) -> int:
        """Adds nodes after a state; the state at their end. States are numbered onwards, so edges never lead back."""
        for node in nodes:
            if isinstance(node, bytes):
                at = self._word(at, node)
                continue
            ends = []
            if node[0] == "any":
                for n in range(node[2] + 1):
                    ends += [at] if n >= node[1] else []
                    at = self._word(at, None) if n < node[2] else at
            else:
                for branch in [node[1], []] if node[0] == "optional" else node[1]:
                    ends.append(self._add(branch, at))
            at = self._state()
            for e in ends:
                self.free[e].add(at)
        return at

    def _reach(self) -> int:
        """Words of the longest match."""
        longest = [0] * len(self.edges)
        for s in reversed(range(len(self.edges))):
            longest[s] = max([longest[t] for t in self.free[s]] + [longest[t] + 1 for to in self.edges[s].values() for t in to], default=0)
        return longest[0]

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()] - states:
                states.add(t)
                todo.append(t)
        return frozenset(states)

    def step(self, states: frozenset[int], word: bytes) -> tuple[frozenset[int], tuple[str, ...]]:
        """The states after a word, and the labels accepted with it."""
        key = (states, word if word in self.known else None)
        if key not in self.steps:
            if len(self.steps) >= CACHED_STEPS:
                self.steps.clear()
            to = self._closed({t for s in states for w in {key[1], None} for t in self.edges[s].get(w, ())})
            self.steps[key] = to, tuple(sorted({self.ends[s] for s in to if s in self.ends}))
        return self.steps[key]

    def accepted(self, words: list[bytes], upto: int) -> Iterator[tuple[str, int, int]]:
        """(label, first word, last word) of every start before `upto`, each label at its longest."""
        first, step = self.first, self.step
        for i, word in enumerate(words[:upto]):
            if word not in first:
                continue
            states, j, found = self.root, i, {}
            while states and j < len(words):
                states, labels = step(states, words[j])
                for label in labels:
                    found[label] = j
                j += 1
            for label, last in found.items():
                yield label, i, last

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int, int]]]:
        """The number of words of a lower-cased text, and what is accepted in it."""
        places, words, at, passed = [], [], 0, 0
        while at < len(text):
            end = min(at + STEP, len(text))
            while end < len(text) and WORD.match(text, end, end + 1):  # not inside a word
                end += 1
            words += WORD.findall(text, at, end)
            at = end
            upto = len(words) if at == len(text) else max(0, len(words) - self.reach)
            places += [(label, passed + i, passed + j) for label, i, j in self.accepted(words, upto)]
            del words[:upto]
            passed += upto
        return passed, places


def license_places(documents: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words and places (label, base, first, last: words from 0) of every document.

    Templates and phrases: label to markup; a label of a template may not be one of a phrase.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    if templates.keys() & phrases.keys():
        raise ValueError("a template has the label of a phrase")
    automaton = TokenAutomaton({**phrases, **templates})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64())])
        for batch in slices(batches):
            found = [automaton.scan((t or b"").lower()) for t in batch.column(1).to_pylist()]
            places = [[{"label": label, "base": label in phrases, "first": i, "last": j} for label, i, j in p] for _, p in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(places, pa.list_(place))], ["doc_id", "n_words", "places"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, places array<struct<label string, base boolean, first long, last long>>")


def license_labels(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["first"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    score = F.when(F.exists("places", lambda p: ~p["base"]), 1.0).when(F.size("places") > 0, 0.5).otherwise(0.0)
    return license_places(documents).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"), score.alias("score"),
    )


def as_pattern(nodes: list) -> str:
    """A regular expression for the same wording, over words that are each followed by a space."""
    out = ""
    for node in nodes:
        if isinstance(node, bytes):
            out += re.escape(node.decode()) + " "
        elif node[0] == "optional":
            out += f"(?:{as_pattern(node[1])})?"
        elif node[0] == "any":
            out += f"(?:[^ ]+ ){{{node[1]},{node[2]}}}"
        else:
            out += f"(?:{'|'.join(as_pattern(x) for x in node[1])})"
    return out


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), p AS (
  @PHRASES@
), b AS (
  SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM p GROUP BY row
), t AS (SELECT row, ' ' || array_to_string(ws, ' ') || ' ' AS said FROM d),
m AS (SELECT row, list(DISTINCT label) AS found FROM (@TEMPLATES@) GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_concat(coalesce(base, []), coalesce(found, []))), ','), '') AS labels,
       CASE WHEN found IS NOT NULL THEN 1.0 WHEN base IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM d LEFT JOIN b ON b.row = d.row LEFT JOIN m ON m.row = d.row
""".replace(
    "@PHRASES@",
    " UNION ALL ".join(
        f"SELECT row, '{label}' AS label, i - 1 AS i FROM (SELECT row, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE list_contains(ws, '{words[0]}')) WHERE ws[i:i + {len(words) - 1}] = {words}"
        for label, words in ((k, v.split()) for k, v in PHRASES.items())
    ),
).replace("@TEMPLATES@", " UNION ALL ".join(f"SELECT row, '{label}' AS label FROM t WHERE regexp_matches(said, ' {as_pattern(parse(markup))}')" for label, markup in TEMPLATES.items()))

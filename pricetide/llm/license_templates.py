"""License notices by templates: mandatory wording word for word, optional and replaceable regions.

A template is a line of words in which ``[[ ... ]]`` marks an optional region (they may nest) and
``{{lo-hi}}`` a region where any ``lo`` to ``hi`` words may stand. Templates are compiled into token
automata; a text is accepted at a word if some path through the automaton reads all mandatory words
there, exactly and in order. Texts are read as words of ASCII letters, digits and non-ASCII
characters, A-Z as a-z.

Every text is scanned by one Python worker call; automata start only at words a template can begin
with, and a text's memory is its list of words.

Defined results: a null or empty text has no words, no labels and score 0; rows are judged each for
itself; a column of the result's name is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.words import Remembered, in_small_batches

# Fixed phrases and the labels they stand for.
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
# Notices by template, one label each.
NOTICES = {
    "apache-2.0": "licensed under [[ the terms of ]] the apache license [[ version ]] 2 [[ 0 ]]",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc-4.0": "[[ this work is ]] licensed under [[ a ]] cc by nc 4 0 [[ international ]] [[ license ]]",
    "copyright": "copyright [[ c ]] {{1-3}} [[ by ]] {{0-4}} all rights reserved",
    "gpl-3.0": "licensed under [[ the terms of ]] the gnu general public license [[ as published by the free "
               "software foundation ]] [[ either ]] version 3 [[ or [[ at your option ]] any later version ]]",
    "mit-notice": "[[ this {{1-3}} is ]] released under the [[ terms of the ]] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of {{1-6}} to deal in "
                "{{1-4}} without restriction",
}
TEMPLATES = PHRASES | NOTICES
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "found array<struct<label:string,start:long,end:long>>")


def parsed(template: str) -> list:
    """Words, (lo, hi) pairs and lists (optional regions)."""
    stack: list[list] = [[]]
    for part in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", template):
        if part == "[[":
            stack.append([])
        elif part == "]]":
            region = stack.pop()
            if not stack:
                raise ValueError(f"unopened region: {template}")
            stack[-1].append(region)
        elif part.startswith("{{"):
            lo, hi = map(int, part.strip("{}").split("-"))
            stack[-1].append((lo, hi))
        else:
            stack[-1].append(part)
    if len(stack) > 1:
        raise ValueError(f"unclosed region: {template}")
    return stack[0]


class Automaton:
    """States are numbers; an edge reads a given word, or any word, or nothing."""

    def __init__(self, template: str):
        self.by_word: list[dict[bytes, list[int]]] = []
        self.by_any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.start = self.state()
        self.end = self.build(parsed(template), self.start)
        self.reach = [self.closure(s) for s in range(len(self.free))]
        self.first = {w for s in self.reach[self.start] for w in self.by_word[s]}
        if self.end in self.reach[self.start] or any(self.by_any[s] for s in self.reach[self.start]):
            raise ValueError(f"a template must begin with a word: {template}")

    def state(self) -> int:
        self.by_word.append({})
        self.by_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def build(self, parts: list, at: int) -> int:
        for part in parts:
            after = self.state()
            if isinstance(part, str):
                self.by_word[at].setdefault(part.encode(), []).append(after)
            elif isinstance(part, list):
                self.free[self.build(part, at)].append(after)
                self.free[at].append(after)
            else:
                lo, hi = part
                for n in range(hi):
                    if n >= lo:
                        self.free[at].append(after)
                    step = self.state()
                    self.by_any[at].append(step)
                    at = step
                self.free[at].append(after)
            at = after
        return at

    def closure(self, state: int) -> list[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return sorted(seen)

    def accept(self, words: list[bytes], at: int) -> tuple[int, int] | None:
        """(most fixed words read, farthest end) over the accepting paths from word ``at``."""
        now = dict.fromkeys(self.reach[self.start], 0)
        best = None
        for i in range(at, len(words)):
            then: dict[int, int] = {}
            for s, n in now.items():
                for to, more in [*((t, 1) for t in self.by_word[s].get(words[i], ())), *((t, 0) for t in self.by_any[s])]:
                    for t in self.reach[to]:
                        if then.get(t, -1) < n + more:
                            then[t] = n + more
            if not then:
                break
            if self.end in then:
                best = (max(then[self.end], best[0] if best else 0), i + 1)
            now = then
        return best


@Remembered
def compiled(templates: tuple[tuple[str, str], ...]) -> dict[bytes, list[tuple[str, Automaton]]]:
    """Automata by the words they can begin with."""
    out: dict[bytes, list[tuple[str, Automaton]]] = {}
    for label, template in templates:
        automaton = Automaton(template)
        for word in automaton.first:
            out.setdefault(word, []).append((label, automaton))
    return out


def match(text: str | None, templates: tuple[tuple[str, str], ...]) -> tuple:
    """The fields of ``RESULT``; score is n / (n + 1) for the most fixed words n of an accepted template."""
    words = WORD.findall((text or "").encode().lower())
    starts = compiled(templates)
    found, most = [], 0
    for i, word in enumerate(words):
        if word in starts:
            for label, automaton in starts[word]:
                if hit := automaton.accept(words, i):
                    found.append({"label": label, "start": i, "end": hit[1]})
                    most = max(most, hit[0])
    base = [f for f in found if f["label"] in PHRASES]
    return (len(words), len(base), base[0]["start"] if base else None, base[-1]["start"] if base else None,
            ",".join(sorted({f["label"] for f in base})), ",".join(sorted({f["label"] for f in found})),
            most / (most + 1), found)


def license_column(text: Column, templates: dict[str, str] = TEMPLATES) -> Column:
    chosen = tuple(templates.items())
    compiled(chosen)  # a faulty template fails here, not in a task
    names = [f.split()[0] for f in RESULT.split(", ")]

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([match(t, chosen) for t in texts], columns=names)
        return out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64"})

    return run(text)


def licensed(docs: DataFrame, templates: dict[str, str] = TEMPLATES, into: str = "license") -> DataFrame:
    """The input's rows with a struct of ``RESULT``."""
    return in_small_batches(docs).withColumn(into, license_column(docs["text"], templates))


def query(spark, sf_dir: str) -> DataFrame:
    """op6 over the whole ``documents`` table."""
    rows = licensed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", *[f"license.{c}" for c in (
        "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def variants(parts: list) -> list[tuple[str, int]]:
    """Every way to write a template, as a pattern over words that each follow a space, with its fixed words."""
    out = [("", 0)]
    for part in parts:
        if isinstance(part, str):
            ways = [(f" {part}", 1)]
        elif isinstance(part, list):
            ways = [("", 0), *variants(part)]
        else:
            ways = [(f"( [^ ]+){{{part[0]},{part[1]}}}", 0)]
        out = [(a + b, n + m) for a, n in out for b, m in ways]
    return out


def oracle() -> str:
    rows = ", ".join(f"('{label}', '{pattern} ', {n}, {str(label in PHRASES).lower()})"
                     for label, t in TEMPLATES.items() for pattern, n in variants(parsed(t)))
    places = ", ".join(f"('{label}', {[w for w in phrase.split()]})" for label, phrase in PHRASES.items())
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
t(label, pattern, n, base) AS (VALUES {rows}),
p(label, phrase) AS (VALUES {places}),
m AS (SELECT r, list_sort(list(DISTINCT label)) AS labels, max(n) AS n
      FROM d JOIN t ON regexp_matches(' ' || array_to_string(w, ' ') || ' ', pattern) GROUP BY r),
b AS (SELECT r, label, i - 1 AS spot FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN p
        ON w[i:i + len(phrase) - 1] = phrase),
c AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_sort(list(DISTINCT label)) AS labels
      FROM b GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(c.labels, ','), '') AS base_labels, coalesce(array_to_string(m.labels, ','), '') AS labels,
       coalesce(n, 0)::DOUBLE / (coalesce(n, 0) + 1) AS score
FROM d LEFT JOIN m USING (r) LEFT JOIN c USING (r)
"""


ORACLE = oracle()

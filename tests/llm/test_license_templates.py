import random
import re

import pytest
from pyspark.sql import functions as F

from pricetide.llm import license_templates as lt


def test_sql(same_as_sql):
    same_as_sql(lt.query, lt.ORACLE)


def as_pattern(parts):
    """The same template as a regular expression."""
    out = ""
    for p in parts:
        if isinstance(p, str):
            out += f" {p}(?= )"
        elif isinstance(p, list):
            out += f"(?:{as_pattern(p)})?"
        else:
            out += f"(?: [^ ]+){{{p[0]},{p[1]}}}"
    return out


def test_automata_against_patterns():
    rng = random.Random(8)
    templates = ["a b", "a [[ b ]] c", "a {{0-2}} b [[ c [[ a ]] ]] c", "[[ b ]] a {{1-3}} c", "a [[ b c ]] [[ b ]] c"]
    for template in templates:
        automaton, pattern = lt.Automaton(template), re.compile(as_pattern(lt.parsed(template)))
        for _ in range(400):
            words = [rng.choice("abcx").encode() for _ in range(rng.randint(0, 9))]
            line = " " + b" ".join(words).decode() + " "
            for at in range(len(words)):
                assert (automaton.accept(words, at) is not None) == bool(pattern.match(line, 2 * at)), (template, words, at)


def test_mandatory_words_are_exact(documents):
    rows = [(1, "Released under the MIT License."), (2, "released under the terms of the mit-license"), (3, "released under mit license"),
            (4, "Copyright (c) 2020 by Jane Doe. All rights reserved"), (5, "Copyright 2020 All rights"), (6, "CC BY cc by-nc"),
            (7, None), (8, ""), (None, "É MIT licensé"), (1, "Released under the MIT License."), (9, "mit " * 50000 + "license")]
    df = documents(rows).withColumn("license", F.lit("clash"))
    out = lt.licensed(df).select("doc_id", "license.*").collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["labels"] == by[2]["labels"] == "mit,mit-notice" and by[3]["labels"] == "mit"
    assert by[4]["labels"] == "copyright" and by[5]["labels"] == "" and by[5]["score"] == 0
    assert (by[6]["n_base"], by[6]["first_word"], by[6]["last_word"]) == (2, 0, 2)
    assert by[7]["n_words"] == by[8]["n_words"] == 0 and by[7]["first_word"] is None
    assert by[None]["n_words"] == 3 and by[None]["base_labels"] == ""
    assert (by[9]["n_base"], by[9]["first_word"]) == (1, 49999)
    assert [(f["label"], f["start"], f["end"]) for f in by[1]["found"]] == [("mit-notice", 0, 5), ("mit", 3, 5)]
    assert lt.licensed(documents([])).count() == 0


@pytest.mark.parametrize("bad", ["{{0-1}} a", "[[ a", "a ]]", "[[ a ]]"])
def test_faulty_templates(bad):
    with pytest.raises(ValueError):
        lt.license_column(F.col("text"), {"x": bad})

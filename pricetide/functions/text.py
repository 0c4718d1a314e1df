"""Text normalisation as JVM-side column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks that NFKC leaves in place but that still count as white space.
BLANK_LETTERS = " \t\n\x0b\f\r\u1680\u2028\u2029\ufeff"

# Symbols that separate words when two spellings are compared.
FOLD_SYMBOLS = "・･,、。／/|｜:：;；()（）[]【】{}\"'`~^*_＋+"

# Fixed patterns: letters and digits that carry content, and Japanese letters.
NOT_MEANINGFUL = r"[^\p{Alnum}\u3040-\u30FF\u4E00-\u9FFF]+"
JAPANESE = r"[\u3040-\u30FF\u3400-\u9FFFー々]"

# Word boundaries over ASCII letters; Java's own boundary also counts kana as word letters.
WORD_START = r"(?=[A-Za-z0-9_])(?<![A-Za-z0-9_])"
WORD_END = r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
ASCII_BOUNDARY = f"(?:{WORD_START}|{WORD_END})"


def ascii_words(pattern: str) -> str:
    """A pattern whose word boundaries are ASCII ones.

    A boundary that opens or closes the pattern next to a letter or digit is written as the one
    side it can be, which the matcher rejects at most places by looking at one letter.
    """
    body = pattern
    opens, closes = body.startswith(r"\b"), body.endswith(r"\b")
    body = body.removeprefix(r"\b").removesuffix(r"\b").replace(r"\b", ASCII_BOUNDARY)
    return (WORD_START if opens else "") + body + (WORD_END if closes else "")


def nfkc(text: Column) -> Column:
    """Unicode NFKC; null becomes ''.

    Spark has no function for it, so this calls the ICU library that ships with Spark through
    ``java_method``: no Python worker, no Arrow transfer. Text of one byte per character is ASCII
    and already normal, and skips the call. Spark treats ``java_method`` as non-deterministic, so
    select the result into a column before using it more than once.
    """
    value = F.coalesce(text, F.lit(""))
    normal = F.call_function(
        "java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), value, F.lit(True)
    )
    return F.when(F.octet_length(value) == F.char_length(value), value).otherwise(normal)


def strip(text: Column) -> Column:
    """Trim every kind of blank from NFKC text (Spark's ``trim`` alone removes spaces only)."""
    return F.btrim(text, F.lit(BLANK_LETTERS))


def strip_raw(text: Column) -> Column:
    """Trim text that has not been normalised: all Unicode separators count as blanks."""
    return F.regexp_replace(text, r"^[\s\p{Z}\uFEFF]+|[\s\p{Z}\uFEFF]+$", "")


def squeeze(text: Column) -> Column:
    """Runs of blanks become one space; ends are trimmed. Tidy text passes by byte tests alone."""
    untidy = contains_any(text, ["  ", *BLANK_LETTERS[1:]])
    return F.trim(F.when(untidy, F.regexp_replace(text, f"[{BLANK_LETTERS}]+", " ")).otherwise(text))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the measure the length thresholds are stated in."""
    beyond = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]+", ""))
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(F.length(text) + beyond)


def fold_normal(text: Column) -> Column:
    """Comparison key of text that is already NFKC: upper case, symbols to spaces, squeezed.

    Symbols are replaced letter by letter; a pattern runs only where two blanks meet.
    """
    blanked = FOLD_SYMBOLS + BLANK_LETTERS[1:]
    spaced = F.translate(F.upper(text), blanked, " " * len(blanked))
    return F.trim(F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced))


def fold(text: Column) -> Column:
    return fold_normal(nfkc(text))


def compact(folded: Column) -> Column:
    """A folded key without hyphens and spaces: ND-91841 and ND 91841 become one."""
    return F.replace(F.replace(folded, F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))


def fold_literal(text: str) -> str:
    """The same key for a constant known while the plan is being written."""
    spaced = unicodedata.normalize("NFKC", text).upper().translate({ord(c): " " for c in FOLD_SYMBOLS})
    return " ".join(spaced.split())


def contains_any(text: Column, words: list[str]) -> Column:
    """Byte-level substring tests, joined with OR; stays in generated code, no regex."""
    return reduce(or_, [F.contains(text, F.lit(word)) for word in words])


def meaningful_count(text: Column) -> Column:
    """How many letters carry content; counted as what is left when all runs of others are cut out."""
    return F.length(F.regexp_replace(text, NOT_MEANINGFUL, ""))


def non_empty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A column used inside a lambda may be inlined by the optimizer and then recomputed for every
    element; a lambda variable cannot.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))

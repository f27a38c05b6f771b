"""Column expressions for cleaning texts and splitting them into words."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import cache

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters and patterns the cleaning steps remove.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
QUOTES = "[‘’“”…]"
BRACKETS = r"\[.*?\]"
WORDS_WITH_DIGITS = r"[\p{L}\p{N}_]*\p{Nd}[\p{L}\p{N}_]*"
MENTION = r"@[\p{L}\p{N}_]+ "
LINK = r"https?://\S+"
EXTRA_STOP_WORDS = ("amp",)


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, " +", " "))


def clean_tweet(col: Column) -> Column:
    """Drop line breaks, mentions, hash signs and links, in this order; squeeze blanks."""
    out = F.replace(col, F.lit("\n"), F.lit(""))
    out = F.regexp_replace(out, MENTION, " ")
    out = F.replace(out, F.lit("#"), F.lit(""))
    return squeeze(F.regexp_replace(out, LINK, ""))


def clean_words(col: Column, order: str = "brackets_first") -> Column:
    """Lower-case text without brackets, punctuation, words with digits and curly quotes.

    With ``order="punctuation_first"`` the bracket rule comes last and finds nothing.
    """
    steps = {
        "brackets_first": (BRACKETS, PUNCTUATION, WORDS_WITH_DIGITS, QUOTES),
        "punctuation_first": (PUNCTUATION, QUOTES, WORDS_WITH_DIGITS, BRACKETS),
    }[order]
    out = F.lower(col)
    for pattern in steps:
        out = F.regexp_replace(out, pattern, "")
    return F.replace(out, F.lit("\n"), F.lit(" "))


def stop_words(language: str = "english", more: Sequence[str] = ()) -> list[str]:
    """Spark's stop words joined with a second list, all forms without apostrophe, and a few of our own."""
    words = [*StopWordsRemover.loadDefaultStopWords(language), *more]
    return sorted({*words, *(w.replace("'", "") for w in words), *EXTRA_STOP_WORDS})


def tokens(col: Column, stop: Sequence[str], order: str = "brackets_first") -> Column:
    """Words of the cleaned text: no stop words, letters only, two letters or more."""
    words = F.split(clean_words(col, order), r"\s+")
    banned = list(stop)
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*banned) if banned else F.length(w) > 1)
    letters = F.transform(kept, lambda w: F.regexp_replace(w, "[^a-z]+", ""))
    return F.filter(letters, lambda w: F.length(w) > 1)


# --- accents ------------------------------------------------------------------------

@cache
def _accent_map() -> tuple[str, str]:
    """Every letter that decomposes to one base letter plus marks, from the Unicode tables."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        char = chr(code)
        bare = "".join(c for c in unicodedata.normalize("NFKD", char) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != char:
            source.append(char)
            target.append(bare)
    return "".join(source), "".join(target)


def strip_accents(col: Column) -> Column:
    """Base letters for accented ones, loose marks dropped; stays inside the JVM."""
    source, target = _accent_map()
    return F.regexp_replace(F.translate(col, source, target), r"\p{Mn}", "")


@cache
def _marks() -> dict[int, None]:
    return dict.fromkeys(c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Mn")


@F.pandas_udf(T.StringType())
def strip_accents_exact(texts: pd.Series) -> pd.Series:
    """Full compatibility decomposition, also of ligatures and other scripts."""
    marks = _marks()
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).translate(marks))

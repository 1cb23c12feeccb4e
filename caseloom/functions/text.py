"""Column functions over texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def document_kind(chars_per_page: Column) -> Column:
    """More than 300 characters a page: born digital; fewer than 50: a scan; else in part."""
    return F.when(chars_per_page < 50, "scan").when(chars_per_page > 300, "born digital").otherwise("partial")


# Curly quotes and the straight ones that they are read as.
CURLY, STRAIGHT = "‘’‚‛“”„‟", "''''\"\"\"\""


def fold(text: Column) -> Column:
    """Straight quotes, single spaces, lower case (ASCII letters), no spaces at the ends."""
    # One pass over the characters for quotes and letters.
    straight = F.translate(text, CURLY + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", STRAIGHT + "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(straight, r"[ \t\n\x0b\x0c\r]+", " "))


def folded_text(text: str) -> str:
    """Compatibility forms and curly quotes folded, white space collapsed, lower case: what fold_forms gives."""
    return " ".join(unicodedata.normalize("NFKC", text).translate(str.maketrans(CURLY, STRAIGHT)).split()).lower()


def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(folded_text, na_action="ignore")


def fold_forms(text: Column) -> Column:
    """fold, and compatibility forms (ligatures, full-width letters, no-break spaces) and letters of any script as well.

    Texts of ASCII characters, for which the JVM can say all this, don't reach Python: it sees nulls in their place."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    spaces = F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0b\x0c\r\x1c-\x1f]+", " "))
    return F.when(plain, spaces).otherwise(F.pandas_udf(_folded, "string")(F.when(~plain, text)))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


# Marks, brackets and quotes that may stand before or after a sentence.
EDGES = r"""^[ "'(\[{]+|[ .!?;:,'")\]}]+$"""


def trim_marks(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


# Where a sentence of a folded text ends, and the notice that is no sentence of its own.
SENTENCE_END = r"(?<=[.!?;]) |(?<=[.!?])(?=[a-z])"
NOTICE = r"(?U)^\W*this report was modified on (?:[a-z]+ \d{1,2}, \d{4}|\d{1,2}/\d{1,2}/\d{4})\W*$"


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences of at least ``least`` characters after folding and trimming of marks. A sentence also ends at
    a semicolon, and at a mark that a letter follows without a space."""
    return sentences_of(fold(text), least)


def sentences_of(folded: Column, least: int = 20, without: str | None = None) -> Column:
    """sentences of a text that is folded already; those that match ``without`` go."""
    bare = F.transform(F.split(folded, SENTENCE_END), trim_marks)
    fine = lambda s: (F.length(s) >= least) & ~s.rlike(without) if without else F.length(s) >= least
    return F.array_distinct(F.filter(bare, fine))


def estimated_tokens(chars: Column) -> Column:
    return F.floor(chars / 4).cast("long")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row, however often it is read."""
    return F.transform(F.array(value), body)[0]


def word_runs(text: Column, n: int) -> Column:
    """The distinct runs of n words of a folded text; a shorter text is one run."""
    def runs(w):
        last = F.greatest(F.size(w) - n + 1, F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, n), " ")))

    return bound(F.split(text, " "), runs)


def char_runs(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text; a shorter text is one run."""
    def runs(c):
        last = F.greatest(F.size(c) - n + 1, F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(c, i, n), "")))

    return bound(F.split(text, ""), runs)

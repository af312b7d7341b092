"""Column functions on text: trimming, tokenising, number-to-text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import STOPWORDS, WHITESPACE

# A line from its first to its last visible character.
_LINE = rf"[^{WHITESPACE}](?:[^\n]*[^{WHITESPACE}])?"
# A whole run of letters, numbers and apostrophes of more than two UTF-16 units (characters beyond
# the basic plane count as two) that is not made of numbers alone.
_CHAR = r"[\p{L}\p{N}']"
_ASTRAL = r"[\x{10000}-\x{10FFFF}&&[\p{L}\p{N}]]"
_TERM = (
    rf"(?<!{_CHAR})(?!\p{{N}}++(?!{_CHAR}))(?:{_CHAR}{{3,}}|{_ASTRAL}{_CHAR}|{_CHAR}{_ASTRAL})"
)


def trim_ws(text: Column) -> Column:
    """Trim every kind of Unicode white space, not only U+0020."""
    return F.trim(text, F.lit(WHITESPACE))


def split_lines(text: Column) -> Column:
    """Trimmed non-blank lines in order; NULL gives no lines. Only a line feed separates lines."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_LINE), F.lit(0))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TERM), F.lit(0))


def tokenize(text: Column) -> Column:
    """Lower-cased label terms of a text, in order, duplicates kept.

    Letters, numbers and the apostrophe stay, everything else separates; tokens of up to two
    UTF-16 units, stopwords and pure numbers are dropped.
    """
    return F.filter(_words(text), lambda t: ~t.isin(STOPWORDS))


def distinct_terms(text: Column) -> Column:
    """The label terms of a text, each once."""
    return F.array_except(_words(text), F.array(*[F.lit(w) for w in STOPWORDS]))


def round4(value: Column) -> Column:
    """Round to 4 decimals, halves towards plus infinity.

    Numbers from 9e11 on have no more than 4 decimals; they stay, like values that are not finite.
    """
    rounded = F.floor(value * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)
    return F.when(F.abs(value) < 9e11, rounded).otherwise(value)


def number_text(value: Column) -> Column:
    """A number of at most 4 decimals as its shortest plain text: 1, -0.2, 0.0001."""
    fixed = value.cast("decimal(38,4)").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")

"""Column functions that encode one CSV cell and guard it against spreadsheet formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws

_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_RADIX = r"^0([xX]0*[0-9a-fA-F]{1,256}|[oO]0*[0-7]{1,341}|[bB]0*[01]{1,1024})$"
_RISKY_START = r"^[=+\-@\t\r]"
_NEEDS_QUOTES = r"[\",\r\n]"


def is_plain_number(text: Column) -> Column:
    """True when the text, trimmed, is a finite decimal, hexadecimal, octal or binary number."""
    body = trim_ws(text)
    size = F.abs(body.try_cast("double"))
    decimal = body.rlike(_DECIMAL) & F.coalesce(size < F.lit(float("inf")), F.lit(False))
    return decimal | body.rlike(_RADIX)


def csv_cell(text: Column) -> Column:
    """Quote where needed; prefix an apostrophe where a spreadsheet would run a formula."""
    text = F.coalesce(text, F.lit(""))
    guarded = F.when(
        text.rlike(_RISKY_START) & ~is_plain_number(text), F.concat(F.lit("'"), text)
    ).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(guarded.rlike(_NEEDS_QUOTES), quoted).otherwise(guarded)

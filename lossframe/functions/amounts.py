"""Money parsing and money helpers.

Amounts are DECIMAL(28,6): sums are exact and independent of the order in
which partial aggregates are merged, which floating point would not be.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossframe.constants import MONEY

SCIENTIFIC_SHAPE = "^[+-]?(\\d+\\.?\\d*|\\.\\d+)[eE][+-]?\\d+$"
PAREN_SHAPE = "^\\s*\\(.*\\)\\s*$"


def amount_text_parts(c: Column) -> tuple[Column, Column]:
    """(raw text, text reduced to [0-9.-])."""
    raw = c.cast("string")
    # U+2212 -> '-' (translate only when present: a byte search is cheaper),
    # then keep only [0-9.-]; this also drops the thousands mark, '$',
    # whitespace and parentheses, so one regex does all of it
    minus = F.when(raw.contains("−"), F.translate(raw, "−", "-")).otherwise(raw)
    return raw, F.regexp_replace(minus, "[^0-9.\\-]", "")


def parse_amount_parts(raw: Column, stripped: Column) -> Column:
    """F3 from precomputed parts: scientific text as a number, else the
    stripped text; parentheses make the value negative. Cheap character
    tests guard the regexes (And short-circuits), and the text is trimmed
    only for the rare values that contain an exponent mark."""
    sci = (raw.contains("e") | raw.contains("E")) & F.trim(raw).rlike(SCIENTIFIC_SHAPE)
    parsed = F.when(sci, F.trim(raw)).otherwise(stripped).try_cast(MONEY)
    paren = raw.contains("(") & raw.rlike(PAREN_SHAPE)
    return F.when(paren, -F.abs(parsed)).otherwise(parsed).cast(MONEY)


def clean_amount_text(c: Column) -> Column:
    """F3 on text: unicode minus -> '-', drop thousands marks, keep [0-9.-],
    wrap in parentheses -> negative; scientific notation is read as a number."""
    return parse_amount_parts(*amount_text_parts(c))


def clean_amount(c: Column, dtype: T.DataType | None = None) -> Column:
    """Typed numbers are cast directly (no text round trip); text goes through F3."""
    if isinstance(dtype, T.NumericType):
        return c.try_cast(MONEY)
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast(MONEY)
    return clean_amount_text(c)


def fill_incurred(incurred: Column, paid: Column, outstanding: Column) -> Column:
    """incurred = paid + outstanding when only incurred is missing."""
    return F.when(
        incurred.isNull() & paid.isNotNull() & outstanding.isNotNull(), (paid + outstanding).cast(MONEY)
    ).otherwise(incurred)


def round_money(c: Column, places: int = 2) -> Column:
    """HALF_UP rounding on decimals, fixed result scale."""
    return F.round(c, places).cast(T.DecimalType(28, places))


def format_num(c: Column) -> Column:
    """2 places with comma groups, trailing zeros dropped, NULL -> 'NA'."""
    s = F.format_number(c, 2)
    s = F.regexp_replace(s, "\\.00$", "")
    s = F.regexp_replace(s, "(\\.\\d)0$", "$1")
    return F.coalesce(s, F.lit("NA"))


def two_decimals_ok(c: Column) -> Column:
    """F14 aggregate: every non-null value has at most two decimals (empty -> true)."""
    return F.coalesce(F.bool_and(F.when(c.isNotNull(), c == F.round(c, 2))), F.lit(True))

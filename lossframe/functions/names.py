"""Header and identifier normalisation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace trimmed by the reference's trimws(): space, tab, CR, LF.
WS_CLASS = "[ \\t\\r\\n]"
_TRIM_RE = f"^{WS_CLASS}+|{WS_CLASS}+$"


def normalize_name(name: str) -> str:
    """Driver-side header normalisation: alphanumeric runs, lower-cased, joined by '_'."""
    return "_".join(re.findall("[A-Za-z0-9]+", name)).lower()


def normalize_name_col(c: Column) -> Column:
    """Same normalisation as a column expression (for header rows read as data)."""
    return F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def trim_ws(c: Column) -> Column:
    """trimws(): strip spaces, tabs, CR and LF at both ends (plain trim() strips spaces only).

    ``trim(BOTH chars FROM x)`` is a character scan, far cheaper than a regex."""
    return F.trim(c, F.lit(" \t\r\n"))


def norm_id(c: Column) -> Column:
    """Identifier key: trimmed and lower-cased text."""
    return F.lower(trim_ws(c.cast("string")))


def is_blank(c: Column) -> Column:
    """NULL or empty string (the reference's ``is.na(x) | x == ""``)."""
    return c.isNull() | (c == F.lit(""))

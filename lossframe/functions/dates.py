"""Date parsing and date arithmetic.

Text dates are parsed with a fixed, per-locale list of patterns tried in
order. Separators (space, comma, dot, slash, dash) are first collapsed to
``-`` so one pattern covers ``05/01/2023``, ``05.01.2023`` and ``05-01-2023``.
Each pattern is guarded by a shape regex, so a value is only offered to the
pattern it can match; the parse itself then validates the calendar date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossframe.constants import EXCEL_ORIGIN, EXCEL_SERIAL_MAX, EXCEL_SERIAL_MIN
from lossframe.functions.names import trim_ws

SEPARATORS = "[\\s,./-]+"
ISO_TS_SHAPE = "^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})?$"
NUMERIC_SHAPE = "^\\d+(\\.\\d+)?$"

# (shape regex on the collapsed text, field order, pattern name)
# Field order codes: d day, m month number, b month abbreviation, Y four-digit
# year, y two-digit year. Shapes are regexes (the DuckDB oracle uses them
# verbatim); the Spark side checks the equivalent digit/letter signatures.
_D_M_Y4 = ("^\\d{1,2}-\\d{1,2}-\\d{4}$", "dmY", "d-M-yyyy")
_Y4_M_D = ("^\\d{4}-\\d{1,2}-\\d{1,2}$", "Ymd", "yyyy-M-d")
_D_B_Y4 = ("^\\d{1,2}-[A-Za-z]{3,9}-\\d{4}$", "dbY", "d-MMM-yyyy")
_D_M_Y2 = ("^\\d{1,2}-\\d{1,2}-\\d{2}$", "dmy", "d-M-yy")
_M_D_Y4 = ("^\\d{1,2}-\\d{1,2}-\\d{4}$", "mdY", "M-d-yyyy")
_B_D_Y4 = ("^[A-Za-z]{3,9}-\\d{1,2}-\\d{4}$", "bdY", "MMM-d-yyyy")
_M_D_Y2 = ("^\\d{1,2}-\\d{1,2}-\\d{2}$", "mdy", "M-d-yy")

# Locale -> ordered patterns (after separator collapse, AU d/m/Y == d.m.Y etc.).
LOCALE_PATTERNS = {
    "AU": [_D_M_Y4, _Y4_M_D, _D_B_Y4, _D_M_Y2],
    "US": [_M_D_Y4, _Y4_M_D, _B_D_Y4, _M_D_Y2],
}

# English month names, January first. A month is written in full or by its first three letters.
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
               "november", "december"]
# Two-digit years: 69-99 are 1900s, 00-68 are 2000s.
TWO_DIGIT_PIVOT = 69

_DIGITS = "0123456789"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Java regex \s without UNICODE_CHARACTER_CLASS: space, \t, \n, \x0B, \f, \r
_SEP_CHARS = " \t\n\x0b\f\r,./"


def _signatures(shape: str) -> list[str]:
    """Expand a shape regex of the forms above into its digit ('9') / letter
    ('a') signatures, e.g. ^\\d{1,2}-\\d{4}$ -> ['9-9999', '99-9999']."""
    import itertools
    import re
    parts = []
    for tok in re.findall(r"\\d\{(\d)(?:,(\d))?\}|\[A-Za-z\]\{(\d),(\d)\}|(-)", shape):
        lo, hi, letters, most, dash = tok
        if dash:
            parts.append(["-"])
        elif letters:
            parts.append(["a" * k for k in range(int(letters), int(most) + 1)])
        else:
            parts.append(["9" * k for k in range(int(lo), int(hi or lo) + 1)])
    return ["".join(p) for p in itertools.product(*parts)]

#: Every name and abbreviation between bars, padded to one width, so that the place of a name gives its month.
_MONTH_WIDTH = 16
_MONTHS_TEXT = "".join(f"|{m[:3]}|{m}|".ljust(_MONTH_WIDTH) for m in MONTH_NAMES)


def _month_number(name: Column) -> Column:
    """1..12 for an English month, in full or as three letters (any case), else NULL."""
    pos = F.instr(F.lit(_MONTHS_TEXT), F.concat(F.lit("|"), F.lower(name), F.lit("|")))
    return F.when(pos > 0, (F.floor((pos - 1) / _MONTH_WIDTH) + 1).cast("int"))


def _valid_date(year: Column, month: Column, day: Column) -> Column:
    """make_date only for a real calendar date, else NULL (And short-circuits,
    so make_date never sees an invalid year or month)."""
    ok_ym = (year >= 1) & (year <= 9999) & (month >= 1) & (month <= 12) & (day >= 1)
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.when(ok_ym, F.when(day <= last, F.make_date(year, month, day)))


def excel_serial_to_date(n: Column) -> Column:
    """Excel serial day number -> date, only for 20000 < n < 60000 (exclusive)."""
    x = n.cast("double")
    return F.when(
        (x > EXCEL_SERIAL_MIN) & (x < EXCEL_SERIAL_MAX),
        F.date_add(F.lit(EXCEL_ORIGIN).cast("date"), F.floor(x).cast("int")),
    )


def date_text_parts(c: Column) -> tuple[Column, Column]:
    """(trimmed text, text with separator runs collapsed to '-').

    Equivalent to ``regexp_replace(s, '[\\s,./-]+', '-')``: separators are
    mapped to '-' by ``translate`` and the (rare) runs are collapsed only
    when one is present."""
    s = trim_ws(c.cast("string"))
    t = F.translate(s, _SEP_CHARS, "-" * len(_SEP_CHARS))
    return s, F.when(t.contains("--"), F.regexp_replace(t, "-+", "-")).otherwise(t)


def _signature(collapsed: Column) -> Column:
    return F.translate(collapsed, _DIGITS + _LETTERS, "9" * len(_DIGITS) + "a" * len(_LETTERS))


def date_place_parts(collapsed: Column, locale: str = "AU") -> tuple[Column, Column]:
    """Place (from 1; 0: none) of the value's signature among those of the locale's patterns, and its '-'-separated parts."""
    if locale not in LOCALE_PATTERNS:
        raise ValueError(f"unknown locale profile {locale!r}")
    known = ",".join(s for p in LOCALE_PATTERNS[locale] for s in _signatures(p[0]))  # signatures hold no comma
    return F.find_in_set(_signature(collapsed), F.lit(known)), F.split(collapsed, "-", -1)


def date_kind_fields(collapsed: Column, locale: str = "AU", placed: tuple[Column, Column] | None = None
                     ) -> tuple[Column, Column, Column, Column]:
    """Stage 2: which locale pattern the value has (by signature; NULL: none), and its year, month and day fields as text. The
    locale's patterns have disjoint signatures, so at most one applies. ``placed``: its ``date_place_parts``, where columns have them."""
    place, parts = placed or date_place_parts(collapsed, locale)
    pats = LOCALE_PATTERNS[locale]
    of = [k for k, p in enumerate(pats) for _ in _signatures(p[0])]
    at = [[next(p[1].index(x) for x in codes if x in p[1]) for codes in ("Yy", "mb", "d")] for p in pats]
    kind = F.get(F.array(F.lit(None).cast("int"), *[F.lit(k) for k in of]), place)
    spots = F.get(F.array(F.lit(None).cast("array<int>"), *[F.array(*[F.lit(i) for i in at[k]]) for k in of]), place)
    # a lambda ends the stage's generated method here; with both dates and all amounts in one, it is beyond what the JIT compiles
    fields = F.transform(spots, lambda i: F.get(parts, i))
    return kind, *[F.get(fields, F.lit(i)) for i in range(3)]


def date_ymd(kind: Column, p: list[Column], locale: str = "AU") -> tuple[Column, Column, Column]:
    """Stage 3: year (four digits), month and day as number texts, of the fields of stage 2."""
    year, month, day = p
    short = [k for k, pat in enumerate(LOCALE_PATTERNS[locale]) if "y" in pat[1]]
    if short:
        year = F.concat(F.when(~kind.isin(*short), F.lit("")).when(year >= f"{TWO_DIGIT_PIVOT:02d}", F.lit("19")).otherwise(F.lit("20")), year)
    names = [k for k, pat in enumerate(LOCALE_PATTERNS[locale]) if "b" in pat[1]]
    if names:
        month = F.when(kind.isin(*names), _month_number(month).cast("string")).otherwise(month)
    return year, month, day


def serial_number(s: Column) -> Column:
    """The number that purely numeric text is, else NULL."""
    return F.when(s.rlike(NUMERIC_SHAPE), s.cast("double"))


def date_from_ymd(s: Column, year: Column, month: Column, day: Column, number: Column | None = None) -> Column:
    """Stage 4: ISO timestamp text first, then the pattern's date, then an
    Excel serial for purely numeric text (``number``: its ``serial_number``, where a column has it)."""
    iso = F.when((F.length(s) > 15) & s.rlike(ISO_TS_SHAPE), F.to_date(F.try_to_timestamp(s)))
    # the cast gives NULL for what is no calendar date; year 0000 is none
    named = F.when(year != "0000", F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date"))
    return F.coalesce(iso, named, excel_serial_to_date(serial_number(s) if number is None else number))


def date_signature_parts(collapsed: Column) -> tuple[Column, Column]:
    """(digit / letter signature, fields between dashes) of collapsed text, for ``order_date``."""
    return _signature(collapsed), F.split(collapsed, "-", -1)


def order_date(signature: Column, parts: Column, pattern: tuple) -> Column:
    """The date that one pattern (shape, field order, name) reads, else NULL."""
    shape, order, _ = pattern
    part = {o: F.get(parts, F.lit(i)) for i, o in enumerate(order)}
    if "Y" in part:
        year = part["Y"].try_cast("int")
    else:
        yy = part["y"].try_cast("int")
        year = yy + F.when(yy >= TWO_DIGIT_PIVOT, F.lit(1900)).otherwise(F.lit(2000))
    month = _month_number(part["b"]) if "b" in part else part["m"].try_cast("int")
    return F.when(signature.isin(*_signatures(shape)), _valid_date(year, month, part["d"].try_cast("int")))


def parse_date_text(c: Column, locale: str = "AU") -> Column:
    """Parse free-text dates for a locale profile; NULL when nothing matches.

    Compact single-expression form for ad-hoc use (each pattern guarded by
    its signature and parsed by the formatter). ``standardize`` runs the
    staged form (``date_text_parts`` -> ``date_kind_fields`` -> ``date_ymd``
    -> ``date_from_ymd``), which is several times faster per value; tests
    check both give the same dates."""
    if locale not in LOCALE_PATTERNS:
        raise ValueError(f"unknown locale profile {locale!r}")
    s, collapsed = date_text_parts(c)
    sig = _signature(collapsed)
    tries = [F.when((F.length(s) > 15) & s.rlike(ISO_TS_SHAPE), F.to_date(F.try_to_timestamp(s)))]
    for shape, order, fmt in LOCALE_PATTERNS[locale]:
        text = collapsed
        if "b" in order:  # a full month name becomes its abbreviation; other words do not
            word = F.split(collapsed, "-")[order.index("b")]
            text = F.when(_month_number(word).isNotNull(), F.regexp_replace(collapsed, "([A-Za-z]{3})[A-Za-z]*", "$1"))
        d = F.to_date(F.try_to_timestamp(text, F.lit(fmt)))
        d = F.when(F.year(d) >= 1, d)  # year 0000 is not a calendar year
        if "y" in order:  # the formatter maps yy into 2000-2099; 69-99 belong to the 1900s
            d = F.when(F.year(d) >= 2000 + TWO_DIGIT_PIVOT, F.add_months(d, -1200)).otherwise(d)
        tries.append(F.when(sig.isin(*_signatures(shape)), d))
    tries.append(F.when(s.rlike(NUMERIC_SHAPE), excel_serial_to_date(s)))
    return F.coalesce(*tries)


def parse_date(c: Column, dtype: T.DataType | None = None, locale: str = "AU") -> Column:
    """typed dates pass through, numbers are Excel serials, text is parsed."""
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    if isinstance(dtype, T.NumericType):
        return excel_serial_to_date(c)
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("date")
    return parse_date_text(c, locale)


def format_date(c: Column, style: str = "iso") -> Column:
    """ISO ``yyyy-MM-dd`` or AU ``dd/MM/yyyy`` text."""
    if style == "iso":
        return F.date_format(c, "yyyy-MM-dd")
    if style == "au":
        return F.date_format(c, "dd/MM/yyyy")
    raise ValueError(f"unknown date style {style!r}")


def accident_year(loss_date: Column) -> Column:
    return F.year(loss_date).cast("long")


def dev_months(loss_date: Column, report_date: Column) -> Column:
    """F16: whole months between the month floors, floored at 0."""
    m = F.months_between(F.trunc(report_date, "MM"), F.trunc(loss_date, "MM"))
    return F.greatest(F.lit(0), m.cast("int")).cast("long")

"""Column types and date orders learnt from the values of each file (F1, F2).

A reader that guesses types looks at a column as a whole: a column of numbers
is numeric, and only then is 45000 an Excel day. A date parser that trains
does the same with the order of day and month. Both need counts only:

* ``profile`` counts, per file and column, the values, the numbers among them,
  the ISO dates, and for every date order the values that it reads. It is one
  aggregate, summed up before the shuffle, with a row for each file and column.
* Profiles add up (``merge_profiles``): of the parts of a file, of the files of
  a delivery, of today's rows and the stored ones. No value is read again.
* ``column_rules`` makes of a profile the column's type and its order list:
  orders that read more values come first.
* ``trained_dates`` joins the rules back to the rows and parses.

Defined cases: blank and null values count as none; a column without values is
``empty``; a null file is a file of its own; a value that no order reads is
null; rows keep all their columns, and only the parsed ones change type.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossframe.functions.dates import (ISO_TS_SHAPE, LOCALE_PATTERNS, date_signature_parts, date_text_parts,
                                       excel_serial_to_date, order_date)
from lossframe.session import persist_table

EMPTY, NUMBER, DATE, TEXT = "empty", "number", "date", "text"
#: Numbers as a guessing reader knows them: a sign, digits with or without grouping commas, a fraction, an exponent.
NUMBER_SHAPE = "^[+-]?(\\d{1,3}(,\\d{3})+(\\.\\d*)?|\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$"
#: Files and columns whose rules are broadcast; beyond it the rows are joined to them in ``SALTS`` parts of each file.
BROADCAST_RULES, SALTS = 500_000, 64


def date_orders(locale: str = "AU", across: bool = True) -> list[tuple]:
    """The locale's patterns in its order, then, ``across`` locales, those that only others have."""
    if locale not in LOCALE_PATTERNS:
        raise ValueError(f"unknown locale profile {locale!r}")
    out = list(LOCALE_PATTERNS[locale])
    if across:
        for other in LOCALE_PATTERNS.values():
            out += [p for p in other if p not in out]
    return out


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_SHAPE), F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


def _iso_timestamp(text: Column) -> Column:
    return F.when((F.length(text) > 15) & text.rlike(ISO_TS_SHAPE), F.to_date(F.try_to_timestamp(text)))


def profile(df: DataFrame, fields: list[str], file_col: str, locale: str = "AU", across: bool = True) -> DataFrame:
    """file, field, n, n_number, n_date, n_order (values read by each of ``date_orders``): a row for each file and field."""
    orders = date_orders(locale, across)
    iso = next(i for i, (_, order, _) in enumerate(orders) if order == "Ymd")
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])
    values = df.select(F.col(f"`{file_col}`").cast("string").alias("file"), F.inline(texts))  # one code for all fields
    text, collapsed = date_text_parts(F.col("value"))
    values = values.select("file", "field", F.when(text != "", text).alias("text"), collapsed.alias("collapsed"))
    signature, parts = date_signature_parts(F.col("collapsed"))
    values = values.select("file", "field", "text", signature.alias("signature"), parts.alias("parts"))
    values = values.select("file", "field", "text", F.array(*[order_date(F.col("signature"), F.col("parts"), o)
                                                              for o in orders]).alias("read"))
    text, read = F.col("text"), [F.get("read", F.lit(i)).isNotNull() for i in range(len(orders))]
    counted = values.groupBy("file", "field").agg(
        F.count(text).alias("n"), F.count_if(text.rlike(NUMBER_SHAPE)).alias("n_number"),
        F.count_if(_iso_timestamp(text).isNotNull() | (text.rlike("^\\d{4}[-/]") & read[iso])).alias("n_date"),
        *[F.count_if(r).alias(f"n_{i}") for i, r in enumerate(read)])
    return counted.select("file", "field", "n", "n_number", "n_date", F.array(*[f"n_{i}" for i in range(len(orders))]).alias("n_order"))


def merge_profiles(*profiles: DataFrame, orders: int) -> DataFrame:
    """The profile of all rows that the given ones were made of; all with the same list of ``orders`` orders."""
    every = reduce(DataFrame.unionByName, profiles)
    return every.groupBy("file", "field").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_number", "n_date")],
        F.array(*[F.sum(F.get("n_order", F.lit(i))) for i in range(orders)]).alias("n_order"))


def column_type() -> Column:
    """The type of a profile's row: the least one that holds every value."""
    return (F.when(F.col("n") == 0, EMPTY).when(F.col("n_number") == F.col("n"), NUMBER)
            .when(F.col("n_date") == F.col("n"), DATE).otherwise(TEXT))


def column_rules(profiles: DataFrame, locale: str = "AU", across: bool = True) -> DataFrame:
    """file, field, type, order_list (places in ``date_orders``, best first).

    An order that reads more values comes first; ties go to the order whose kind (day first, or month first, whether the
    year has two digits or four) reads more values of the column, then to the locale's own list.
    """
    orders = [order for _, order, _ in date_orders(locale, across)]
    read = [F.get("n_order", F.lit(i)) for i in range(len(orders))]
    kind = [order.lower() for order in orders]
    alike = [reduce(add, [r for r, k in zip(read, kind) if k == own]) for own in kind]
    ranked = F.array_sort(F.array(*[F.struct((-r).alias("less"), (-a).alias("less_alike"), F.lit(i).alias("i"))
                                    for i, (r, a) in enumerate(zip(read, alike))]))
    return profiles.select("file", "field", column_type().alias("type"), ranked["i"].alias("order_list"))


def trained_dates(df: DataFrame, fields: list[str], file_col: str, locale: str = "AU", across: bool = True,
                  rules: DataFrame | None = None) -> DataFrame:
    """``df`` with each text column of ``fields`` as dates, read by what its file's column shows.

    In a numeric column a number is an Excel day; in any other a value is an ISO timestamp or what the first order in
    the column's list reads, and a number nothing. ``rules`` (of ``column_rules``) spares the pass over the values.
    """
    orders = date_orders(locale, across)
    if rules is None:
        rules = column_rules(profile(df, fields, file_col, locale, across), locale, across)
    by_field = rules.where(reduce(or_, [F.col("field") == f for f in fields], F.lit(False)))
    wide = by_field.groupBy("file").agg(*[F.max(F.when(F.col("field") == f, F.struct("type", "order_list"))).alias(f"_rule{i}")
                                          for i, f in enumerate(fields)]).withColumnRenamed("file", "_rule_file")
    wide = persist_table(wide.select("_rule_file", *[F.col(f"_rule{i}.{p}").alias(f"_{p}{i}") for i in range(len(fields))
                                                     for p in ("type", "order_list")]), "date_rules")  # counted, then joined
    key = F.col(f"`{file_col}`").cast("string").eqNullSafe(F.col("_rule_file"))
    if wide.count() * max(1, len(fields)) <= BROADCAST_RULES:
        met = df.join(F.broadcast(wide), key, "left")
    else:  # a file may hold most rows: its rules meet them in parts
        parts = wide.withColumn("_rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = (df.withColumn("_row_salt", F.spark_partition_id() % SALTS)
               .join(parts, key & (F.col("_row_salt") == F.col("_rule_salt")), "left").drop("_row_salt", "_rule_salt"))
    every = range(len(fields))
    stage = met.select("*", *[c.alias(f"_{n}{i}") for i, f in enumerate(fields)
                              for n, c in zip(("text", "collapsed"), date_text_parts(F.col(f"`{f}`")))])
    stage = stage.select("*", *[c.alias(f"_{n}{i}") for i in every
                                for n, c in zip(("signature", "parts"), date_signature_parts(F.col(f"_collapsed{i}")))])
    stage = stage.select("*", *[F.array(*[order_date(F.col(f"_signature{i}"), F.col(f"_parts{i}"), o) for o in orders]).alias(f"_read{i}")
                                for i in every])

    def parsed(i: int) -> Column:
        text, read, ranks = F.col(f"_text{i}"), F.col(f"_read{i}"), F.col(f"_order_list{i}")
        ordered = F.coalesce(_iso_timestamp(text), *[F.get(read, F.get(ranks, F.lit(k))) for k in range(len(orders))])
        return F.when(F.col(f"_type{i}") == NUMBER, excel_serial_to_date(_number(text))).otherwise(ordered)

    place = {f: i for i, f in enumerate(fields)}
    return stage.select(*[parsed(place[c]).alias(c) if c in place else F.col(f"`{c}`") for c in df.columns])

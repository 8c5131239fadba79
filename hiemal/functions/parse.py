"""Tolerant parsing of raw text cells; each parser keeps a status beside the value."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: missing-value codes in raw station files
MISSING_CODES = ("", "****", "**", "na", "n/a", "nan", "none", "null")

# fixed values: accepted flag words
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n", "")


def _text(raw: Column) -> Column:
    return F.trim(raw.cast("string"))


def _number(raw: Column) -> Column:
    num = _text(raw).try_cast("double")
    finite = ~F.isnan(num) & (F.abs(num) < F.lit(float("inf")))
    return F.when(finite, num)


def parse_measurement(raw: Column) -> Column:
    """struct(value double, status) with missing_cell / missing_code / non_numeric / numeric."""
    text, num = _text(raw), _number(raw)
    status = (
        F.when(text.isNull() | (text == ""), "missing_cell")
        .when(F.lower(text).isin(*MISSING_CODES), "missing_code")
        .when(num.isNull(), "non_numeric")
        .otherwise("numeric")
    )
    value = F.when(status == "numeric", num)
    return F.struct(value.alias("value"), status.alias("status"))


def parse_whole_number(raw: Column) -> Column:
    """struct(value int, status) with missing / non_numeric / non_integer / valid_integer."""
    text, num = _text(raw), _number(raw)
    status = (
        F.when(text.isNull() | F.lower(text).isin(*MISSING_CODES), "missing")
        .when(num.isNull(), "non_numeric")
        .when(num != F.floor(num), "non_integer")
        .otherwise("valid_integer")
    )
    value = F.when(status == "valid_integer", num).try_cast("int")
    return F.struct(value.alias("value"), status.alias("status"))


def with_date(df: DataFrame, year: Column, month: Column, day: Column, out: str = "date",
              status: str = "date_status") -> DataFrame:
    """Add a date and its status from raw year, month and day cells.

    The parsed parts are kept in a column of their own so that each cell is parsed once.
    """
    df = df.withColumn("_parts", F.array(*[parse_whole_number(c) for c in (year, month, day)]))
    parts = F.col("_parts")
    iso = F.format_string("%04d-%02d-%02d", *[F.get(parts, i)["value"] for i in range(3)])
    whole = F.forall(parts, lambda p: p["status"] == "valid_integer")
    df = df.withColumn(out, F.when(whole, F.try_to_date(iso, "yyyy-MM-dd")))
    return df.withColumn(
        status,
        F.when(F.exists(parts, lambda p: p["status"] == "missing"), "missing_date_component")
        .when(~whole, "invalid_date_component").when(F.col(out).isNull(), "invalid_calendar_date")
        .otherwise("valid")).drop("_parts")


def parse_flag(raw: Column) -> Column:
    """true / false from booleans, 0/1 and yes/no words; blank is false, an unknown word is null."""
    word = F.coalesce(F.lower(_text(raw)), F.lit(""))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def clean_identifier(raw: Column) -> Column:
    """Identifier text without the '.0' a float reader leaves; missing becomes ''."""
    return F.coalesce(F.regexp_replace(_text(raw), r"\.0$", ""), F.lit(""))

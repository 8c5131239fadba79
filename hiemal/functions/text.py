"""Name keys, code packing and text joins."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(
        lambda v: None if v is None
        else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii")
    )


def name_key(raw: Column, ascii_only: bool = False) -> Column:
    """Match key: compatibility fold, lower case, letters and digits only.

    ``ascii_only=True`` stays inside the JVM; otherwise the Arrow fold is applied first.
    """
    text = raw if ascii_only else _fold(raw)
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def pack_codes(flags: dict[str, Column]) -> tuple[Column, Column]:
    """(codes joined by ';' in definition order, number of codes) from named boolean columns."""
    codes = F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in flags.items()])
    )
    return F.concat_ws(";", codes), F.size(codes)


def scenario_token(raw: Column) -> Column:
    """Upper-case token of a scenario id for use inside event ids."""
    return F.upper(F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def event_id(prefix: Column | str, season: Column, sequence: Column) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.format_string("%s_%d_%02d", head, season.cast("int"), sequence.cast("int"))

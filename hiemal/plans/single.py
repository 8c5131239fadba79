"""Numbers of a one-row table beside every row, without a join."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def literal(value, kind: T.DataType) -> Column:
    if value is not None and isinstance(kind, T.ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    if value is not None and isinstance(kind, T.StructType):
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def attach(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of ``one``, a table of exactly one row such as a total or a short list of names.

    The row is read first and becomes constants of the plan: a join would have no key, and Spark would plan it as a product.
    """
    row = one.first()
    return df.select("*", *[literal(row[f.name], f.dataType).alias(f.name) for f in one.schema.fields])

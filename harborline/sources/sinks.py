"""Rows as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def iso(c: Column, kind: T.DataType) -> Column:
    """ISO text of a date or timestamp, with a fraction only when there is one."""
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(c == F.date_trunc("second", c), whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row; NULL is kept."""
    timed = (T.DateType, T.TimestampType, T.TimestampNTZType)
    columns = [
        iso(F.col(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, timed) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))

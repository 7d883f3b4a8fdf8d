"""Bring variant inputs to the table contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from harborline.functions.scalars import flag

# Other spellings of canonical columns.
ALIASES: dict[str, list[str]] = {
    "shipment_id": ["id"],
    "origin_port": ["origin"],
    "destination_port": ["destination"],
    "transport_mode": ["mode"],
    "eta_date": ["eta"],
    "port_congestion": ["congestion"],
    "weather_severity": ["weather_risk"],
    "num_stops": ["stops"],
}
KG_PER_TON = 1000
# Names written with a space in some inputs and with an underscore in the tables.
TOKENS = ["status", "origin_port", "destination_port"]


def _value(df: DataFrame, field: T.StructField, names: Sequence[str]) -> Column:
    kind = field.dataType
    values = [_converted(F.col(f"`{n}`"), df.schema[n].dataType, kind) for n in names if n in df.columns]
    if field.name == "weight_kg" and "weight_tons" in df.columns:
        values.append((F.col("weight_tons").try_cast("decimal(18,6)") * KG_PER_TON).try_cast(kind))
    return F.coalesce(*values) if values else F.lit(None).cast(kind)


def _converted(c: Column, kind: T.DataType, wanted: T.DataType) -> Column:
    """The value in the wanted type; only text has to be trimmed and read."""
    if isinstance(wanted, T.BooleanType):
        return c if kind == wanted else F.when(c.isNotNull(), flag(c))
    if kind == wanted and not isinstance(kind, T.StringType):
        return c
    if not isinstance(kind, T.StringType):
        return c.try_cast(wanted)
    text = F.nullif(F.trim(c), F.lit(""))
    return text if isinstance(wanted, T.StringType) else text.try_cast(wanted)


def unreadable(df: DataFrame, contract: T.StructType, aliases: Mapping[str, Sequence[str]] = ALIASES) -> Column:
    """Whether a row has text that its column's type cannot hold."""
    wrong = [F.lit(False)]
    for field in contract.fields:
        for name in [field.name, *aliases.get(field.name, [])]:
            if name in df.columns and isinstance(df.schema[name].dataType, T.StringType):
                text = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
                if not isinstance(field.dataType, (T.StringType, T.BooleanType)):
                    wrong.append(text.isNotNull() & text.try_cast(field.dataType).isNull())
    if "weight_tons" in df.columns and isinstance(df.schema["weight_tons"].dataType, T.StringType):
        text = F.nullif(F.trim("weight_tons"), F.lit(""))
        wrong.append(text.isNotNull() & text.try_cast("decimal(18,6)").isNull())
    return reduce(Column.__or__, wrong)


def conform(
    df: DataFrame,
    contract: T.StructType,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Contract columns in contract order; absent ones are NULL, unreadable values too."""
    out = []
    for field in contract.fields:
        value = _value(df, field, [field.name, *aliases.get(field.name, [])])
        if field.name in TOKENS:
            value = F.replace(value, F.lit(" "), F.lit("_"))
        if field.name == "ingested_at":
            value = F.coalesce(value, F.current_timestamp())
        out.append(value.alias(field.name))
    return df.select(*out, *keep)

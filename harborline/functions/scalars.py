"""Scalar expressions: parsing, bands, defaults, distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from harborline import schema

EARTH_RADIUS_KM = 6371.0


def num(c: Column, default: float | None = None, dtype: str = "double") -> Column:
    """Number from text: blank or unreadable is NULL, NULL becomes the default."""
    parsed = F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast(dtype)
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast(dtype))


def flag(c: Column) -> Column:
    """True for the accepted words in any case, false for all else and NULL."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(schema.TRUE_WORDS), F.lit(False))


def banded(c: Column, bands: Sequence[tuple[float, str]], top: str) -> Column:
    """First band whose exclusive upper limit is above the value; NULL stays NULL."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for limit, name in bands:
        out = out.when(c < F.lit(limit), F.lit(name))
    return out.otherwise(F.lit(top))


def level(c: Column) -> Column:
    return banded(c, schema.LEVEL_BANDS, schema.TOP_LEVEL)


def advice(c: Column) -> Column:
    return banded(c, schema.ADVICE_BANDS, schema.TOP_ADVICE)


def short_id(c: Column) -> Column:
    """``BN-nnnn`` from a text, the same in every process."""
    number = F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint") % F.lit(9999)
    return F.concat(F.lit("BN-"), F.lpad(number.cast("string"), 4, "0"))


def clamp(c: Column, lo: float | Column = 0.0, hi: float | Column = 1.0) -> Column:
    """Limit to [lo, hi]; NULL stays NULL."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def port_token(port: Column) -> Column:
    """The part of a port name that is looked for in location names."""
    return F.lower(F.split_part(port, F.lit("_"), F.lit(1)))


def location_match(location: Column, port: Column) -> Column:
    """True when the location name holds the port's first word, in any case."""
    return F.lower(location).contains(port_token(port))


def or_default(c: Column, default: float) -> Column:
    """Default for zero as well as for NULL."""
    number = c.cast("double")
    return F.coalesce(F.nullif(number, F.lit(0.0)), F.lit(float(default)))


def is_late(status: Column) -> Column:
    return F.coalesce(status.isin(schema.LATE_STATUSES), F.lit(False))

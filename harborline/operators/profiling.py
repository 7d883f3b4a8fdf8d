"""Profiles of uploaded tables and texts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from harborline import schema
from harborline.functions.exact import rounded, wide_mean
from harborline.operators.ranking import weight_before
from harborline.session import spool
from harborline.sources.views import small_table

QUARTILES = [0.25, 0.5, 0.75]
ENOUGH_ROWS = 100
PREVIEW_CHARS = 600
MAX_INSIGHTS = 6
SLICES = 10_000
#: Of the quantile sketch: a rank is off by at most rows / ACCURACY.
ACCURACY = 1_000


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _missing(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _present(name: str) -> Column:
    """The value as double, with NaN as missing."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def profile_shape(df: DataFrame) -> DataFrame:
    """Columns, their types and the number of rows."""
    names = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    columns = F.array(
        *(F.struct(F.lit(i).alias("position"), F.lit(n).alias("column_name"), F.lit(t).alias("type")) for i, n, t in names)
    )
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(columns))


def profile_missing(df: DataFrame) -> DataFrame:
    """Missing values per column, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *(F.count_if(_missing(f)).alias(f.name) for f in df.schema.fields)
    )
    columns = F.array(
        *(F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("missing")) for n in df.columns)
    )
    return counts.select(F.col("_rows").alias("rows"), F.inline(columns))


def quantiles(df: DataFrame, limits: dict[str, tuple[int, float, float]], points: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, for any number of rows.

    ``limits`` holds count, minimum and maximum of each column. A first pass counts
    values per slice of the column's range, which tells in which slices the wanted
    ranks lie. Only the values of those slices are then counted one by one and put
    in order across the cluster, so no task holds the values of a column.
    """
    spark = df.sparkSession
    known = {c: v for c, v in limits.items() if v[0]}
    if not known:
        return small_table(spark, ["column_name"], [("",)]).where(F.lit(False)).select(
            "column_name", *(F.lit(None).cast("double").alias(f"q{i}") for i in range(len(points)))
        )

    def sliced(name: str) -> Column:
        _, low, high = known[name]
        width = high - low
        if not math.isfinite(width):
            # Infinite values, or a range beyond a double: slices by the order of magnitude.
            size = F.least(F.log2(F.abs(_present(name)) + 1), F.lit(1100.0))
            place = F.floor(F.signum(_present(name)) * size) + 1100
            return F.coalesce(place, F.lit(0)).cast("int")
        place = F.floor((_present(name) - F.lit(low)) / F.lit(width) * SLICES) if width > 0 else F.lit(0)
        return F.least(place, F.lit(SLICES - 1)).cast("int")

    pairs = F.array(
        *(F.struct(F.lit(n).alias("column_name"), sliced(n).alias("slice"), _present(n).alias("v")) for n in known)
    )
    values = df.select(F.inline(pairs)).where(F.col("v").isNotNull())
    below = Window.partitionBy("column_name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        values.groupBy("column_name", "slice").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    )
    spots = [
        (name, f"q{i}", p * (rows - 1), math.floor(p * (rows - 1)), math.ceil(p * (rows - 1)))
        for name, (rows, _, _) in known.items()
        for i, p in enumerate(points)
    ]
    wanted = small_table(spark, ["column_name", "point", "spot", "lo", "hi"], spots)
    ranks = wanted.select(
        "column_name", "point", "spot", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("rank"), "lo", "hi"
    )
    inside = (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n"))
    targets = spool(ranks.join(slices, "column_name").where(inside), "ranks")
    chosen = targets.select("column_name", "slice", "below").distinct()
    counts = (
        values.join(chosen, ["column_name", "slice"])
        .groupBy("column_name", "slice", "below", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    ordered = weight_before(counts, ["column_name", "slice", "v"], "n", "before")
    starts = ordered.groupBy("column_name", "slice").agg(F.min("before").alias("start"))
    placed = ordered.join(starts, ["column_name", "slice"]).select(
        "column_name",
        "slice",
        "v",
        (F.col("below") + F.col("before") - F.col("start")).alias("first"),
        "n",
    )
    hit = (F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("first") + F.col("n"))
    found = placed.join(targets.drop("n", "below"), ["column_name", "slice"]).where(hit)
    ends = found.groupBy("column_name", "point").agg(
        F.max("spot").alias("spot"),
        F.max("lo").alias("lo"),
        F.max(F.when(F.col("rank") == F.col("lo"), F.col("v"))).alias("v_lo"),
        F.max(F.when(F.col("rank") == F.col("hi"), F.col("v"))).alias("v_hi"),
    )
    between = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("spot") - F.col("lo"))
    value = F.when((F.col("v_lo") == F.col("v_hi")) | (F.col("spot") == F.col("lo")), F.col("v_lo")).otherwise(between)
    return ends.groupBy("column_name").agg(
        *(F.max(F.when(F.col("point") == f"q{i}", value)).alias(f"q{i}") for i in range(len(points)))
    )


def bracketed_quantiles(df: DataFrame, counts: dict[str, int], brackets: dict[str, list[tuple[float, float]]], points: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, of columns whose brackets hold the wanted ranks.

    One pass counts what lies below each bracket, another sends on only what lies inside:
    a few thousandths of the values, counted by value before they move and put in order
    across the cluster. A column with a rank outside its bracket is left out.
    """
    spark = df.sparkSession
    known = [n for n in brackets if counts[n]]
    below = df.agg(
        *(F.count_if(_present(n) < F.lit(lo)).alias(f"{i}.{k}") for i, n in enumerate(known) for k, (lo, _) in enumerate(brackets[n]))
    ).first()
    inside = F.filter(
        F.array(
            *(
                F.struct(F.lit(n).alias("column_name"), F.lit(f"q{k}").alias("point"), F.when(_present(n).between(F.lit(lo), F.lit(hi)), _present(n)).alias("v"))
                for n in known for k, (lo, hi) in enumerate(brackets[n])
            )
        ),
        lambda x: x["v"].isNotNull(),
    )
    held = spool(df.select(F.inline(inside)).groupBy("column_name", "point", "v").agg(F.count(F.lit(1)).alias("n")), "bracketed")
    ordered = spool(weight_before(held, ["column_name", "point", "v"], "n", "before"), "bracket-order")
    starts = ordered.groupBy("column_name", "point").agg(F.min("before").alias("start"), F.sum("n").alias("held"))
    spots = []
    for i, n in enumerate(known):
        for k, p in enumerate(points):
            spot = p * (counts[n] - 1)
            spots.append((n, f"q{k}", spot, math.floor(spot) - below[f"{i}.{k}"], math.ceil(spot) - below[f"{i}.{k}"]))
    wanted = small_table(spark, ["column_name", "point", "spot", "lo", "hi"], spots)
    # Ranks count from the start of the bracket.
    placed = ordered.join(wanted, ["column_name", "point"]).join(starts, ["column_name", "point"])
    first = F.col("before") - F.col("start")
    at = {c: F.max(F.when((first <= F.col(c)) & (F.col(c) < first + F.col("n")), F.col("v"))).alias(f"v_{c}") for c in ("lo", "hi")}
    ends = placed.groupBy("column_name", "point").agg(F.max("spot").alias("spot"), *at.values())
    part = F.col("spot") - F.floor("spot")
    between = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * part
    value = F.when((F.col("v_lo") == F.col("v_hi")) | (part == 0), F.col("v_lo")).otherwise(between)
    sure = F.col("v_lo").isNotNull() & F.col("v_hi").isNotNull()
    return (
        ends.groupBy("column_name")
        .agg(F.count_if(sure).alias("sure"), *(F.max(F.when(F.col("point") == f"q{i}", value)).alias(f"q{i}") for i in range(len(points))))
        .where(F.col("sure") == len(points)).drop("sure")
    )


def profile_numeric(df: DataFrame, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of the numeric columns.

    The pass for the other figures also keeps a mergeable quantile sketch of each column,
    whose error is bound; it brackets the exact quartiles. Only values inside a bracket are
    looked at once more.
    """
    names = _numeric(df)
    if exact and names:
        df = spool(df.select(*(F.col(f"`{n}`") for n in names)), "numbers")
    measures = {
        "count": lambda c: F.count(c),
        "mean": wide_mean,
        "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
    }
    if exact:
        ends = [min(1.0, max(0.0, p + side * 2 / ACCURACY)) for p in QUARTILES for side in (-1, 1)]
        measures["ends"] = lambda c: F.percentile_approx(c, ends, ACCURACY)
    else:
        measures |= {f"q{i}": lambda c, p=p: F.percentile_approx(c, p) for i, p in enumerate(QUARTILES)}
    one = df.agg(*(fn(_present(n)).alias(f"{n}.{m}") for n in names for m, fn in measures.items()))
    columns = F.array(
        *(
            F.struct(F.lit(n).alias("column_name"), *(F.col(f"`{n}.{m}`").alias(m) for m in measures))
            for n in names
        )
    )
    summary = one.select(F.inline(columns))
    if exact:
        summary = spool(summary, "summary")
        told = {r["column_name"]: r for r in summary.collect()}
        counts = {n: r["count"] for n, r in told.items()}
        brackets = {n: list(zip(r["ends"][::2], r["ends"][1::2], strict=True)) for n, r in told.items() if r["count"]}
        found = bracketed_quantiles(df, counts, brackets, QUARTILES) if brackets else None
        limits = {n: (r["count"], r["min"], r["max"]) for n, r in told.items()}
        if found is None:
            found = quantiles(df, limits, QUARTILES)
        else:
            found = spool(found, "quartiles")
            rest = set(brackets) - {r[0] for r in found.select("column_name").collect()}
            if rest:
                # A sketch that missed its bound costs these columns the slower way.
                found = found.unionByName(quantiles(df, {n: limits[n] for n in rest}, QUARTILES))
        summary = summary.join(found, "column_name", "left")

    def shown(c: str) -> Column:
        return rounded(F.col(c), 3)

    return summary.select(
        "column_name",
        "count",
        shown("mean").alias("mean"),
        shown("std").alias("std"),
        shown("min").alias("min"),
        shown("q0").alias("p25"),
        shown("q1").alias("p50"),
        shown("q2").alias("p75"),
        shown("max").alias("max"),
    )


def profile_sample(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First rows as text, a missing value as empty text."""
    first = df.orderBy(*order).limit(n)
    return first.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))


def profile_ready(df: DataFrame) -> DataFrame:
    """Is the table complete and long enough to predict from?"""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    share = F.try_divide(F.sum("missing"), F.sum("rows"))
    return profile_missing(df).agg(
        F.max("rows").alias("rows"),
        rounded(1 - F.coalesce(share, F.lit(0.0)), 3).alias("completeness"),
        F.lit(len(_numeric(df))).cast("bigint").alias("numeric_features"),
        F.lit(len(text)).cast("bigint").alias("categorical_features"),
        (F.max("rows") > ENOUGH_ROWS).alias("suitable_for_prediction"),
    )


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """Top-level keys of JSON objects and how often they occur."""
    return (
        df.select(F.explode(F.json_object_keys(column)).alias("key"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("occurrences"))
    )


def text_insights(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Length, preview and the first keywords found, as parts of words too."""
    words = F.array(*(F.lit(w) for w in schema.INSIGHT_WORDS))
    found = F.filter(words, lambda w: F.contains(F.lower(F.col(text)), w))
    return docs.select(
        key,
        F.length(text).alias("characters"),
        F.substring(text, 1, PREVIEW_CHARS).alias("preview"),
        F.array_join(
            F.transform(F.slice(found, 1, MAX_INSIGHTS), lambda w: F.concat(F.lit("Keyword found: '"), w, F.lit("'"))),
            "; ",
        ).alias("insights"),
    )


def profile(df: DataFrame, fmt: str) -> dict[str, DataFrame]:
    """All parts of a profile by name; a column-less table has only a shape."""
    order = df.columns[:1]
    return {
        "format": small_table(df.sparkSession, ["format", "status"], [(fmt, "parsed")]),
        "shape": profile_shape(df),
        "missing": profile_missing(df),
        "numeric": profile_numeric(df),
        "sample": profile_sample(df, order),
        "ready": profile_ready(df),
    }

"""Global row order without a one-task sort: numbering, running totals, latest N, pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborline.session import spool

# Up to this many rows a per-task top-k with one small merge is the best plan.
SMALL_TOP = 100
# Aim of rows per block when a long ordered table is cut into blocks.
MAX_BLOCKS = 4096


@dataclass(frozen=True)
class Numbered:
    """Rows with their zero-based position in a total order, and how many there are."""

    rows: DataFrame
    total: int


def _order(keys: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(k).desc_nulls_first() if descending else F.col(k).asc_nulls_last() for k in keys]


def _ordered_parts(df: DataFrame, keys: Sequence[str], descending: bool) -> DataFrame:
    """Rows in range-partitioned order, written once, with part number and slot in the part.

    Range partitioning spreads even a hot timestamp, as the keys are unique together.
    Writing the cut keeps part sizes and rows consistent when a task is run again.
    """
    order = _order(keys, descending)
    slot = F.monotonically_increasing_id()
    return spool(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.shiftright(slot, 33).cast("int"))
        .withColumn("_slot", slot.bitwiseAND(F.lit((1 << 33) - 1))),
        "ordered",
    )


def _part_starts(parts: DataFrame, size: Column) -> DataFrame:
    """What lies before each part; one row per part is added up in one task."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(size.cast("bigint").alias("_size"))
    return spool(
        sizes.select("_part", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")),
        "part-starts",
    )


def number_rows(df: DataFrame, keys: Sequence[str], *, descending: bool = False, name: str = "row_index") -> Numbered:
    """Number rows 0, 1, ... by the keys, which must be unique together."""
    parts = _ordered_parts(df, keys, descending)
    starts = _part_starts(parts, F.count(F.lit(1)))
    total = starts.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    rows = parts.join(starts.drop("_size"), "_part").withColumn(name, F.col("_start") + F.col("_slot"))
    return Numbered(rows.drop("_part", "_slot", "_start"), int(total))


def weight_before(df: DataFrame, keys: Sequence[str], weight: str, name: str) -> DataFrame:
    """Add the sum of the weights of all rows before a row in key order."""
    parts = _ordered_parts(df, keys, False)
    starts = _part_starts(parts, F.sum(weight))
    inside = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.join(starts.drop("_size"), "_part").withColumn(
        name, F.col("_start") + F.coalesce(F.sum(weight).over(inside), F.lit(0))
    )
    return rows.drop("_part", "_slot", "_start")


def running_total(df: DataFrame, index: str, total_rows: int, columns: dict[str, str]) -> DataFrame:
    """Running sums along a dense integer index, in blocks instead of one window.

    ``columns`` maps each summed column to the name of its running total.
    """
    width = max(1000, -(-total_rows // MAX_BLOCKS))
    blocks = df.withColumn("_block", F.floor(F.col(index) / F.lit(width)))
    sums = blocks.groupBy("_block").agg(*(F.sum(c).alias(f"_sum_{c}") for c in columns))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_block", *(F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in columns)
    )
    inside = Window.partitionBy("_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.join(starts, "_block")
    for c, name in columns.items():
        out = out.withColumn(name, F.col(f"_start_{c}") + F.sum(c).over(inside))
    return out.drop("_block", *(f"_start_{c}" for c in columns))


def bucket_of(df: DataFrame, column: str) -> Column:
    """A coarse value that keeps the order of the column: the hour, or a text prefix."""
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp":
        # Hours since 1970, so that a repeated local hour is two buckets.
        return F.floor(F.unix_seconds(column) / 3600).cast("bigint")
    if kind == "timestamp_ntz":
        return F.date_trunc("hour", column)
    if kind == "string":
        return F.substring(column, 1, 10)
    return F.col(column)


def latest(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The newest n rows by (by, key) descending; NULL counts as newest.

    A count per coarse bucket, over one column, tells which buckets can hold the
    newest n. The wide rows are then read behind a literal filter that prunes
    partitions and row groups, and only what passes is ordered.
    """
    order = [by] if by == key else [by, key]
    if n <= SMALL_TOP:
        return df.orderBy(*_order(order, True)).limit(n)
    bucket = bucket_of(df, by)
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    # Every bucket holds a row, so the newest n buckets are always enough.
    newest = counts.orderBy(F.col("_bucket").desc_nulls_first()).limit(n)
    before = Window.orderBy(F.col("_bucket").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    needed = newest.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).where(
        F.col("_before") < n
    )
    cut, available, undated = needed.agg(
        F.min("_bucket").cast("string"), F.sum("_rows"), F.count_if(F.col("_bucket").isNull())
    ).first()
    if available is None:
        return df.limit(0)
    recent = F.lit(False)
    if cut is not None:
        kind = df.schema[by].dataType
        least = F.timestamp_seconds(F.lit(int(cut)) * 3600) if kind.typeName() == "timestamp" else F.lit(cut).cast(kind)
        recent = F.col(by) >= least
    if undated:
        recent = recent | F.col(by).isNull()
    candidates = df.where(recent)
    if available <= n:
        return candidates
    numbered = number_rows(candidates, order, descending=True, name="_rank")
    return numbered.rows.where(F.col("_rank") < n).drop("_rank")


def rank_directory(df: DataFrame, by: str) -> DataFrame:
    """(bucket, rows): how many rows each coarse bucket of a column holds, from that column alone.

    Kept beside a table, it tells where a rank lies; a new load adds its own counts
    (``merged_directory``), old rows are not read again.
    """
    return df.groupBy(bucket_of(df, by).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def merged_directory(*parts: DataFrame) -> DataFrame:
    """One directory for all rows that the parts count."""
    return reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.sum("rows").cast("bigint").alias("rows"))


def _between(df: DataFrame, by: str, low: str | None, high: str | None, undated: bool) -> Column:
    """Rows of the buckets low .. high, as a filter on the column itself that a scan can push down."""
    kind = df.schema[by].dataType
    inside = F.lit(False)
    if low is not None:
        if kind.typeName() == "timestamp":
            first, last = (F.timestamp_seconds(F.lit(int(x)) * 3600) for x in (low, int(high) + 1))
            inside = (F.col(by) >= first) & (F.col(by) < last)
        elif kind.typeName() == "timestamp_ntz":
            last = F.lit(high).cast(kind) + F.expr("interval 1 hour")
            inside = (F.col(by) >= F.lit(low).cast(kind)) & (F.col(by) < last)
        elif kind.typeName() == "string":
            inside = (F.col(by) >= F.lit(low)) & (bucket_of(df, by) <= F.lit(high))
        else:
            inside = F.col(by).between(F.lit(low).cast(kind), F.lit(high).cast(kind))
    return inside | F.col(by).isNull() if undated else inside


def page(df: DataFrame, keys: Sequence[str], size: int, offset: int, directory: DataFrame | None = None) -> DataFrame:
    """Rows offset .. offset+size-1 in ascending key order (NULL last).

    A directory of counts per bucket of the first key, the kept one or one counted now,
    tells which buckets hold the page. Only their rows are read, behind a literal filter,
    and only they are put in order; nothing else of the table is written or sorted.
    """
    counts = rank_directory(df, keys[0]) if directory is None else directory
    placed = weight_before(counts, ["bucket"], "rows", "before")
    held = placed.where((F.col("before") < offset + size) & (F.col("before") + F.col("rows") > offset))
    low, high, undated, before = held.agg(
        F.min("bucket").cast("string"), F.max("bucket").cast("string"), F.count_if(F.col("bucket").isNull()), F.min("before")
    ).first()
    if before is None:
        return df.limit(0)
    rows = df.where(_between(df, keys[0], low, high, undated > 0))
    skip = offset - before
    if skip + size <= SMALL_TOP:
        return rows.orderBy(*_order(keys, False)).offset(skip).limit(size)
    # A bucket may hold very many rows: they are put in order across the cluster.
    numbered = number_rows(rows, keys, name="_rank")
    return numbered.rows.where(F.col("_rank").between(skip, skip + size - 1)).drop("_rank")

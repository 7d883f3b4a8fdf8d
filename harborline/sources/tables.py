"""The two stored tables: creation, insert-if-absent and the load report."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from harborline import schema
from harborline.session import release, shuffles_dropped, slice_of, spool, spool_parts
from harborline.sources.conform import conform, unreadable
from harborline.sources.csv_load import ARRIVAL, FILE_BYTES, load_csv, split_good_bad
from harborline.sources.views import small_table

REJECTED = "rejected_rows"
#: Buckets of a key table that is made anew; an existing one keeps its own number.
KEY_BUCKETS = 32
#: Slices of the keys that a load takes one after the other: a shuffle holds one of them.
LOAD_SLICES = 2
REPORT = [
    "table_name", "status", "method", "rows_read", "rows_inserted", "rows_duplicate", "rows_errored",
    "long_texts", "duration_sec", "file_bytes",
]


def partition_value(table: str) -> Column:
    _, source, pattern = schema.PARTITIONS[table]
    return F.date_format(source, pattern)


def ensure_tables(spark: SparkSession, root: str, key_buckets: int = KEY_BUCKETS) -> list[str]:
    """Create the tables under the root where they are absent; their names.

    Beside each table stands one of its keys alone, in buckets of the key.
    """
    for name, contract in schema.CONTRACTS.items():
        part = schema.PARTITIONS[name][0]
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in contract.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {part} string) USING parquet "
            f"PARTITIONED BY ({part}) LOCATION '{root}/{name}'"
        )
        key = schema.KEYS[name]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {key_table(name)} ({key} string) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {key_buckets} BUCKETS LOCATION '{root}/{key_table(name)}'"
        )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {REJECTED} (table_name string, file string, reason string, record string, "
        f"rejected_at timestamp) USING parquet LOCATION '{root}/{REJECTED}'"
    )
    return list(schema.CONTRACTS)


def tables_exist(spark: SparkSession) -> dict[str, bool]:
    return {name: spark.catalog.tableExists(name) for name in schema.CONTRACTS}


def key_table(table: str) -> str:
    return f"{table}_keys"


def _buckets(spark: SparkSession, table: str) -> int:
    told = spark.sql(f"DESCRIBE EXTENDED {key_table(table)}").where("col_name = 'Num Buckets'").first()
    return int(told["data_type"])


def stored_keys(spark: SparkSession, table: str) -> DataFrame:
    """The keys of a stored table, in buckets of the key.

    They are written after the rows. Where a run ended between the two, or rows came another
    way, the numbers of rows in the file footers differ, and the keys are written anew.
    """
    name, key = key_table(table), schema.KEYS[table]
    if spark.table(name).count() != spark.table(table).count():
        _write_keys(spark.table(table).select(key), table, overwrite=True)
    return spark.table(name)


def _write_keys(keys: DataFrame, table: str, overwrite: bool = False) -> None:
    """One file a bucket."""
    dealt = keys.repartition(_buckets(keys.sparkSession, table), schema.KEYS[table])
    dealt.write.insertInto(key_table(table), overwrite=overwrite)


def append_unstored(rows: DataFrame, table: str, order: Sequence[str], nth: int | None = None) -> DataFrame:
    """Rows to insert into a stored table: the first of each key that the table lacks.

    The new rows are dealt like the key table's buckets, so that a load moves its own rows
    and reads the stored keys where they lie; the stored table is not read. With ``nth``,
    those of one slice of the keys.
    """
    spark, key = rows.sparkSession, schema.KEYS[table]
    held = stored_keys(spark, table)
    if nth is not None:
        rows, held = (df.where(slice_of(key, LOAD_SLICES) == nth) for df in (rows, held))
    first = _first_of_keys(rows, [key], order)
    return first.repartition(_buckets(spark, table), key).join(held, key, "left_anti")


def append_new(target: DataFrame, incoming: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """Incoming rows to insert: the first of each key, unless the target has the key.

    A row without a whole key is never inserted.

    The rank filter is applied before the shuffle too, so a key that fills a third
    of the input sends one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    fresh = _first_of_keys(incoming, keys, order)
    return fresh.join(target.select(*keys), keys, "left_anti")


def _first_of_keys(incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(*order)
    whole = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    return incoming.where(whole).withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") == 1).drop("_nth")


def insert(rows: DataFrame, table: str) -> int:
    """Append rows to a stored table; how many there were, counted in the staged files."""
    return _insert_spooled(spool(rows, "insert"), table)


def _insert_spooled(rows: DataFrame, table: str) -> int:
    spark, part = rows.sparkSession, schema.PARTITIONS[table][0]
    named = rows.withColumn(part, partition_value(table)).select(*spark.table(table).columns)
    # Rebalance keeps files large and splits a hot month over many tasks.
    named.hint("rebalance", part).write.insertInto(table)
    _write_keys(rows.select(schema.KEYS[table]), table)
    inserted = rows.count()
    release(rows)
    return inserted


def reject(bad: DataFrame, table: str) -> int:
    """Keep rows that cannot be loaded, with their reason and file; how many."""
    spark = bad.sparkSession
    rows = spool(bad.select(F.lit(table).alias("table_name"), "_file", "reason", "record"), "rejected")
    rows.select(*(F.col(c).cast("string") for c in rows.columns), F.current_timestamp()).write.insertInto(REJECTED)
    rejected = rows.count()
    release(rows)
    return rejected


def load_table(spark: SparkSession, path: str, table: str, multi_line: bool = False) -> tuple:
    """Read, stage, conform and append one CSV input; a report row."""
    with shuffles_dropped(spark):
        return _load_table(spark, path, table, multi_line)


def _load_table(spark: SparkSession, path: str, table: str, multi_line: bool) -> tuple:
    begun = time.monotonic()
    contract, key = schema.CONTRACTS[table], schema.KEYS[table]
    read, bad = split_good_bad(load_csv(spark, path, contract, multi_line))
    # Judged on conformed values: a key may come under another name, a number as text.
    checked = conform(read.withColumn("_wrong", unreadable(read, contract)), contract, keep=["_wrong", *ARRIVAL, FILE_BYTES])
    no_key = F.col(key).isNull()
    rows = checked.where(~F.col("_wrong") & ~no_key).drop("_wrong")
    left_out = checked.where(F.col("_wrong") | no_key).select(
        F.when(F.col("_wrong"), "unreadable").otherwise("no_key").alias("reason"),
        F.to_json(F.struct(*contract.names)).alias("record"),
        "_file",
    )
    too_long = [F.length(c) > n for c, n in schema.TEXT_LIMITS[table].items()]
    files = rows.groupBy("_file").agg(
        F.count(F.lit(1)).alias("good"),
        F.count_if(F.greatest(*(F.coalesce(c, F.lit(False)) for c in too_long))).alias("long_texts"),
        F.max(FILE_BYTES).alias("bytes"),
    )
    zero = F.lit(0)
    counts = files.agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("good", "long_texts", "bytes"))).first()
    errored = reject(bad.unionByName(left_out), table)
    fresh = (append_unstored(rows.drop(FILE_BYTES), table, ARRIVAL, nth).drop(*ARRIVAL) for nth in range(LOAD_SLICES))
    staged = spool_parts(fresh, "insert")
    release(read)
    inserted = _insert_spooled(staged, table)
    status = "success" if errored == 0 else "partial"
    return (
        table, status, "csv", counts["good"] + errored, inserted, counts["good"] - inserted, errored,
        counts["long_texts"], round(time.monotonic() - begun, 1), counts["bytes"],
    )


def load_report(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return small_table(spark, REPORT, list(rows))

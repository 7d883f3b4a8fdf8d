"""Load runs: all sources, one source, or an uploaded file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from harborline import schema
from harborline.operators.monitoring import table_stats
from harborline.sources.tables import REPORT, ensure_tables, load_report, load_table


def _note(table: str | None, status: str, reason: str) -> tuple:
    return (table, status, reason, *([0] * (len(REPORT) - 5)), 0.0, 0)


def run_pipeline(spark: SparkSession, csv_dir: str, root: str, source: str = "all") -> DataFrame:
    """Schema, loads and their report; a source other than ``all`` loads its own table.

    A missing file is skipped. When the tables cannot be made, nothing is loaded.
    """
    known = {name: table for name, _, _, table in schema.SOURCE_REGISTRY}
    if source != "all" and known.get(source) is None:
        state = "no_table" if source in known else "unknown_source"
        return load_report(spark, [_note(source, state, "nothing to load")])
    try:
        tables = ensure_tables(spark, root)
    except AnalysisException as failure:
        return load_report(spark, [_note("schema", "failed", failure.getCondition() or "analysis")])
    rows = []
    for table in tables if source == "all" else [known[source]]:
        path = f"{csv_dir}/{table}.csv"
        try:
            rows.append(load_table(spark, path, table))
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            rows.append(_note(table, "skipped", "file not found"))
    return load_report(spark, rows)


def validate(spark: SparkSession) -> DataFrame:
    """Rows and bytes of the stored tables after a run."""
    return table_stats(spark, list(schema.CONTRACTS))


def load_upload(spark: SparkSession, path: str, root: str, multi_line: bool = False) -> DataFrame:
    """Append an uploaded CSV, in any known spelling, to the shipments."""
    ensure_tables(spark, root)
    return load_report(spark, [load_table(spark, path, "shipments_master", multi_line)])

"""Shared helpers of the corpus operators: reading, row-wise Arrow maps, union-find, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from harborline.session import release, spool

#: Rows turned into Python objects at once, so that very long texts never pile up.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list[Any]]]:
    """Columns of small slices of Arrow batches, as Python lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield [c.to_pylist() for c in part.columns]


def map_rows(df: DataFrame, rows: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Apply a generator of output tuples to small slices of the columns of ``df``.

    ``rows`` gets one list per column. Output is sent on slice by slice.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in sliced(batches):
            out = list(zip(*rows(*columns), strict=True))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow
                )

    return df.mapInArrow(run, schema)


def groups_of(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each run of equal values in the first column of sorted batches.

    Runs of one row are passed over; a run may span batches.
    """
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key = columns[0]
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        if held and held[-1][0][-1] != key[0]:
            yield from _joined(held)
            held = []
        if len(cuts) == 2:
            held.append(columns)
            continue
        held.append([c[: cuts[1]] for c in columns])
        yield from _joined(held)
        sizes = np.diff(cuts)
        for i in np.flatnonzero(sizes[1:-1] > 1) + 1:
            yield [c[cuts[i] : cuts[i + 1]] for c in columns]
        held = [[c[cuts[-2] :] for c in columns]]
    yield from _joined(held)


def _joined(held: list[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    if held:
        whole = held[0] if len(held) == 1 else [np.concatenate(c) for c in zip(*held, strict=True)]
        if len(whole[0]) > 1:
            yield whole


class Union:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        up = self.up
        root = a
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(a, a)) != root:
            up[a] = root
            a = above
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> Iterator[tuple[int, int]]:
        for a in list(self.up):
            yield a, self.find(a)


def components(edges: DataFrame, label: str, block: int = 400_000) -> DataFrame:
    """Connected components of edges (a, b) of long ids: rows (id, root), roots left out.

    Each task first shrinks its edges to stars by union-find, in blocks of bounded
    size. Large-star and small-star rounds then lead every id to the smallest one it
    can reach. Every round is a written table, so a lost executor costs no more than
    the round at work. Only two sums come to the driver in a round. No neighbour
    list is gathered: minima are aggregated and joined back, so a hub is split by
    the skew join.
    """
    pairs = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    arrow = to_arrow_schema(pairs.schema)

    def forest(union: Union) -> pa.RecordBatch:
        links = list(union.links())
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=arrow
        )

    def shrink(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = Union()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                union.join(a, b)
            if len(union.up) > block:
                yield forest(union)
                union = Union()
        yield forest(union)

    # Stars: child a, smaller centre b.
    stars = spool(pairs.where("a <> b").mapInArrow(shrink, "a bigint, b bigint").distinct(), label)
    seen = None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Ids that are the least of their neighbours keep the link to nothing above.
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        linked = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
        old, stars = stars, spool(linked.where("a <> b").distinct(), label)
        release(old)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return stars.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = now

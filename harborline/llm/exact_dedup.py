"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborline.session import spool

#: Runs that one merge of a round takes in.
FAN_IN = 8


def digest_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id, digest, bytes, second digest) of whole texts, written once; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return spool(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(key).cast("bigint").alias("id"),
            F.sha2(whole, 256).alias("digest"),
            F.octet_length(whole).alias("bytes"),
            F.xxhash64(whole).alias("second"),
        ),
        "digests",
    )


def _same(name: str) -> Column:
    """The one value of a group; two values under one digest stop the job."""
    low, high = F.min(name), F.max(name)
    clash = F.raise_error(F.lit(f"texts with one digest differ in {name}")).cast("bigint")
    return F.when(low == high, high).otherwise(clash).cast("bigint").alias(name)


def tree_merge(runs: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """One row per digest: (digest, keep_id, keep_row, group_size).

    Partition p starts with its own run. In round r the runs whose numbers differ
    only in digit r (base ``fan_in``) exchange digest ranges, as in a binomial tree
    with ``fan_in`` branches: the row moves to the run whose digit r is that of the
    digest. Each round sorts a run, combines equal digests before and after the
    exchange, verifies byte length and second digest, and retains the smallest (or
    largest) identifier. After the last round every run holds its own digest range,
    so no task ever holds the whole, and a digest that fills a third of the input
    arrives as at most one row per run.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.max if keep == "largest" else F.min
    rounds = max(1, math.ceil(math.log(max(2, runs.rdd.getNumPartitions()), fan_in) - 1e-9))
    home = F.conv(F.substring("digest", 1, 12), 16, 10).cast("bigint") % fan_in**rounds
    level = runs.select(
        F.spark_partition_id().cast("bigint").alias("run"),
        "digest",
        # A null id stays only where no other row has the text.
        F.when(F.col("id").isNotNull(), F.struct("id", "row")).alias("best"),
        F.col("row").alias("any_row"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.col("bytes").cast("bigint").alias("bytes"),
        "second",
    )
    for r in range(rounds):
        step = fan_in**r
        run = F.col("run")
        moved = run + (F.floor(home / step) % fan_in - F.floor(run / step) % fan_in) * step
        level = (
            level.withColumn("run", moved)
            .sortWithinPartitions("run", "digest")
            .groupBy("run", "digest")
            .agg(
                best("best").alias("best"),
                F.min("any_row").alias("any_row"),
                F.sum("group_size").alias("group_size"),
                _same("bytes"),
                _same("second"),
            )
        )
    # The verified values are asked for here, or the planner would leave them out.
    verified = level.where(F.col("bytes").isNotNull() & F.col("second").isNotNull())
    return verified.select(
        "digest",
        F.col("best.id").alias("keep_id"),
        F.coalesce("best.row", "any_row").alias("keep_row"),
        "group_size",
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text. Rows that repeat
    both id and text are copies too: exactly one row of a group is kept. A null id
    loses to any other; a group of null ids keeps one of its rows with a null
    keep_id. An empty table gives no rows; further columns are not looked at.
    """
    runs = digest_runs(docs, key, text)
    groups = tree_merge(runs, keep)
    return runs.join(groups, "digest").select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with the columns of ``docs``.

    Of rows that repeat id and text one stays; a text that only null ids have keeps one
    row. The texts that stay are a narrow list of (id, digest), one for each text, which grows
    with the documents, so it is never broadcast: whole texts are shuffled once, repeats of a
    row leave before that, and the copies of a text meet nowhere. An empty table gives no
    rows; columns of any name are carried.
    """

    def place(id: Column, digest: Column) -> Column:
        return F.concat_ws(":", digest, id.cast("string"))

    stays = tree_merge(digest_runs(docs, key, text), keep).select(place(F.col("keep_id"), F.col("digest")).alias("place"))
    # One struct holds the row, so that no column of it can clash with those of the join. One
    # place of id and digest leads both the ranking and the join, so they share the shuffle.
    digest = F.sha2(F.coalesce(docs[text], F.lit("")), 256)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), place(docs[key].cast("bigint"), digest).alias("place"))
    once = Window.partitionBy("place").orderBy(F.lit(1))
    single = rows.withColumn("nth", F.row_number().over(once)).where("nth = 1")
    return single.join(stays.hint("merge"), "place", "left_semi").select("row.*")

"""Fixity of WARC replicas: Merkle trees over records, audited from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborline.session import spool

#: Children of a tree node.
FAN_OUT = 16
#: Records of one archive file; more go to the next.
FILE_RECORDS = 4_096
CRLF = "\r\n"


def record_text(uri: Column, record_id: Column, body: Column) -> Column:
    """A WARC/1.1 response record as text; null parts count as empty."""
    text = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:record:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(f">{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(text).cast("string"),
        F.lit(CRLF * 2),
        text,
        F.lit(CRLF * 2),
    )


def archive(pages: DataFrame, key: str = "page_id", uri: str = "url", body: str = "html", per_file: int = FILE_RECORDS) -> DataFrame:
    """(file, position, key, bytes, digest): WARC records dealt to files by blocks of the key.

    ``digest`` is the SHA-256 of the whole record. Records of a file are ordered by
    key, then digest, so rows that repeat a key have a stable place; null keys come
    first, in files of their own by digest.
    """
    record = record_text(F.col(uri), F.col(key), F.col(body))
    made = pages.select(
        F.col(key).cast("bigint").alias("key"), F.octet_length(record).cast("bigint").alias("bytes"), F.sha2(record, 256).alias("digest")
    )
    # A key that many rows repeat, or null, is spread over further files by digest.
    file = F.coalesce(F.floor(F.col("key") / per_file), F.lit(-1) - F.conv(F.substring("digest", 1, 3), 16, 10).cast("bigint"))
    return made.withColumn("file", file.cast("bigint"))


def with_offsets(records: DataFrame) -> DataFrame:
    """Add position and byte offset of every record in its file."""
    order = Window.partitionBy("file").orderBy(F.asc_nulls_first("key"), "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("position", (F.row_number().over(order) - 1).cast("bigint")).withColumn(
        "offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("bigint")
    )


def placed(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records of a replica at the places that the manifest, an inventory, gives them.

    The n-th record of a key in a file takes the place of the n-th there; records
    without a place follow after the end of their file.
    """
    nth = F.row_number().over(Window.partitionBy("file", "key").orderBy("digest"))
    known = manifest.select("file", "key", "position", "offset", nth.alias("nth")).alias("m")
    own = records.withColumn("nth", nth).alias("r")
    same = (
        (F.col("r.file") == F.col("m.file")) & F.col("r.key").eqNullSafe(F.col("m.key")) & (F.col("r.nth") == F.col("m.nth"))
    )
    all_rows = own.join(known, same, "left").select("r.file", "r.key", "bytes", "digest", "position", "offset")
    ends = manifest.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    late = (
        with_offsets(all_rows.where("position is null").drop("position", "offset"))
        .join(ends, "file", "left")
        .select(
            "file",
            "key",
            "bytes",
            "digest",
            (F.col("position") + F.coalesce("n", F.lit(0))).alias("position"),
            (F.col("offset") + F.coalesce("size", F.lit(0))).alias("offset"),
        )
    )
    return spool(all_rows.where("position is not null").unionByName(late), "replica")


def _parents(nodes: DataFrame, level: int, fan_out: int, within: list[str]) -> DataFrame:
    """Nodes of the next level: the hash of the ordered hashes of up to ``fan_out`` children."""
    children = F.array_sort(F.collect_list(F.struct("position", "hash")))
    return (
        nodes.groupBy(*within, F.floor(F.col("position") / fan_out).alias("position"))
        .agg(children.alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))
        .select(
            *within,
            F.lit(level).alias("level"),
            "position",
            "low",
            "high",
            F.sha2(F.concat_ws("", "c.hash"), 256).alias("hash"),
        )
    )


def merkle_tree(records: DataFrame, fan_out: int = FAN_OUT, places: int = FILE_RECORDS) -> DataFrame:
    """(file, level, position, low, high, hash): a tree for every file, leaves at level 0.

    A leaf hashes the record's offset range with its digest, so moved bytes count as
    well as changed ones; a node covers the bytes from ``low`` to ``high``. All trees
    have the height that ``places`` records need, or the largest file. A group is never larger than ``fan_out``.
    """
    end = F.col("offset") + F.col("bytes")
    leaf = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), end.cast("string"), "digest"), 256)
    level = records.select("file", F.lit(0).alias("level"), "position", F.col("offset").alias("low"), end.alias("high"), leaf.alias("hash"))
    largest = records.agg(F.max("position")).first()[0] or 0
    levels, height, places = [level], 0, max(places, largest + 1)
    while places > 1:
        height += 1
        places = -(-places // fan_out)
        level = _parents(level, height, fan_out, ["file"])
        levels.append(level)
    tree = levels[0]
    for more in levels[1:]:
        tree = tree.unionByName(more)
    return spool(tree, "merkle")


def file_roots(tree: DataFrame) -> DataFrame:
    height = tree.agg(F.max("level")).first()[0] or 0
    return tree.where(F.col("level") == height).select("file", F.col("high").alias("bytes"), F.col("hash").alias("root"))


def mismatches(left: DataFrame, right: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Leaves (file, position, low, high) where two replicas' trees differ.

    Only children of differing nodes are compared on the next level, from the roots
    down; a node that one side lacks differs. Both trees have one height.
    """
    height = max((t.agg(F.max("level")).first()[0] or 0) for t in (left, right))
    suspects = None
    for level in range(height, -1, -1):
        a, b = (t.where(F.col("level") == level).select("file", "position", "low", "high", "hash") for t in (left, right))
        if suspects is not None:
            # Only files and branches under suspicion take part.
            parent = (F.col("file") == F.col("s_file")) & (F.floor(F.col("position") / fan_out) == F.col("s_position"))
            a, b = a.join(suspects, parent, "left_semi"), b.join(suspects, parent, "left_semi")
        both = a.alias("a").join(
            b.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.position") == F.col("b.position")), "full_outer"
        )
        found = both.where(~F.col("a.hash").eqNullSafe(F.col("b.hash"))).select(
            F.coalesce("a.file", "b.file").alias("s_file"),
            F.coalesce("a.position", "b.position").alias("s_position"),
            F.coalesce("a.low", "b.low").alias("low"),
            F.coalesce("a.high", "b.high").alias("high"),
        )
        found = spool(found, "suspects")
        suspects = found.select("s_file", "s_position")
    return found.select(F.col("s_file").alias("file"), F.col("s_position").alias("position"), "low", "high")


def audit(original: DataFrame, replica: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per record place of either replica: what it holds and whether it is sound.

    Inputs have file, key, bytes, digest, position and offset. Status: ``ok``,
    ``changed`` (other bytes or another place), ``missing`` (not in the replica) or
    ``extra``. ``root`` and ``replica_root`` are those of the file. Empty inputs give
    no rows.
    """
    most = [r.agg(F.max("position")).first()[0] or 0 for r in (original, replica)]
    places = max(FILE_RECORDS, *(m + 1 for m in most))
    left, right = merkle_tree(original, fan_out, places), merkle_tree(replica, fan_out, places)
    bad = mismatches(left, right, fan_out).select("file", "position", F.lit(True).alias("bad"))
    roots = file_roots(left).alias("x").join(
        file_roots(right).alias("y"), F.col("x.file") == F.col("y.file"), "full_outer"
    ).select(F.coalesce("x.file", "y.file").alias("file"), F.col("x.root").alias("root"), F.col("y.root").alias("replica_root"))
    here = original.select("file", "position", "key", "offset", "bytes", "digest")
    # What the replica holds is looked up only at the places that differ.
    there = replica.join(bad, ["file", "position"], "left_semi").select(
        "file", "position", F.col("key").alias("r_key"), F.col("offset").alias("r_offset"), F.col("bytes").alias("r_bytes"), F.col("digest").alias("r_digest")
    )
    marked = bad.join(there, ["file", "position"], "left")
    rows = here.join(marked, ["file", "position"], "full_outer").join(roots, "file")
    status = (
        F.when(F.col("bad").isNull(), "ok")
        .when(F.col("r_digest").isNull(), "missing")
        .when(F.col("digest").isNull(), "extra")
        .otherwise("changed")
    )
    return rows.select(
        "file",
        "position",
        F.coalesce("key", "r_key").alias("key"),
        "offset",
        "bytes",
        "digest",
        F.when(F.col("bad").isNull(), F.col("digest")).otherwise(F.col("r_digest")).alias("replica_digest"),
        "root",
        "replica_root",
        status.alias("status"),
    )


def inventory(pages: DataFrame, **columns) -> DataFrame:
    """Records of an archive with their offsets, written once."""
    return spool(with_offsets(archive(pages, **columns)), "archive")

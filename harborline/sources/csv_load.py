"""CSV input with its bad rows kept apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from harborline.session import spool

CORRUPT = "_corrupt_record"
# Where a row stood in its input: the order in which the first row of a key wins.
ARRIVAL = ["_file", "_block", "_line"]
FILE_BYTES = "_file_bytes"


def _first_lines(spark: SparkSession, files, path) -> tuple[str, ...]:
    """The text of a file, packed or not, up to the first line that is not blank."""
    jvm, raw, lines = spark._jvm, files.open(path), []
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(path)
        text = jvm.java.io.InputStreamReader(codec.createInputStream(raw) if codec else raw, "UTF-8")
        reader = jvm.java.io.BufferedReader(text)
        while (line := reader.readLine()) is not None:
            lines.append(line)
            if line.strip():
                break
    finally:
        raw.close()
    return tuple(lines)


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files under a path by their header; Spark reads it once for files that begin alike."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        spark.read.csv(path)  # raises as Spark does for a missing path
    listed, found, known = files.listFiles(folder, True), {}, {}
    while listed.hasNext():
        file = listed.next()
        name = file.getPath().getName()
        if file.getLen() and not name.startswith(("_", ".")):
            begins = _first_lines(spark, files, file.getPath())
            if begins not in known:
                known[begins] = spark.read.option("header", True).option("escape", '"').csv(file.getPath().toString()).columns
            found.setdefault(tuple(known[begins]), []).append(file.getPath().toString())
    return found


def load_csv(spark: SparkSession, path: str, contract: T.StructType, multi_line: bool = False) -> DataFrame:
    """Rows of headed CSV files, typed by the contract through each file's own header.

    Quotes inside quoted values are doubled. With ``multi_line`` a quoted value may
    hold line breaks; such files are read by one task each. Columns the contract
    lacks are read as text. Unreadable rows come with their text in
    ``_corrupt_record``; every row comes with its place in the input.
    """
    known = {f.name: f.dataType for f in contract.fields}
    parts = []
    for header, files in _headers(spark, path).items():
        # Boolean words are wider than the CSV parser's; they are read when conformed.
        kinds = [known.get(name, T.StringType()) for name in header]
        fields = [
            T.StructField(name, T.StringType() if isinstance(kind, T.BooleanType) else kind)
            for name, kind in zip(header, kinds, strict=True)
        ]
        fields.append(T.StructField(CORRUPT, T.StringType()))
        parts.append(
            spark.read.schema(T.StructType(fields))
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .option("nullValue", "")
            .option("escape", '"')
            .option("multiLine", multi_line)
            .option("columnNameOfCorruptRecord", CORRUPT)
            .csv(files)
            .select(
                *(F.col(f"`{f.name}`") for f in fields),
                F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_line"),
                F.col("_metadata.file_size").alias(FILE_BYTES),
            )
        )
    if not parts:
        empty = T.StructType([*contract.fields, T.StructField(CORRUPT, T.StringType())])
        place = [F.lit(None).cast(k).alias(n) for n, k in (("_file", "string"), ("_block", "bigint"), ("_line", "bigint"), (FILE_BYTES, "bigint"))]
        return spark.createDataFrame([], empty).select("*", *place)
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def split_good_bad(df: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with a reason. The input is parsed once and staged."""
    staged = spool(df, "staged")
    missing = F.col(key).isNull() if key and key in df.columns else F.lit(False)
    broken = F.col(CORRUPT).isNotNull()
    good = staged.where(~broken & ~missing).drop(CORRUPT)
    bad = staged.where(broken | missing).select(
        F.when(broken, "malformed").otherwise("no_key").alias("reason"), F.col(CORRUPT).alias("record"), "_file"
    )
    return good, bad

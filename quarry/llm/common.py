"""Helpers that the training-data operators share: shared scratch tables and global row numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

#: Settings for the time of one statement: its shuffle files go when it ends, and the driver keeps no long plan texts.
STATEMENT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "100000"}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir).

    Where that setting is absent a local session, as in tests, gets a folder of its own; on a cluster it is an error,
    as executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back, so a lost executor never costs a recomputation."""
    return saved_at(df, name, codec)[0]


def saved_at(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in STATEMENT}
    for k, v in STATEMENT.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path, compression=codec)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step reads."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def packed(docs: DataFrame) -> Column:
    """All columns of `docs` as one struct `row`, so that no name of theirs meets a helper column's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_words(text: Column, line: bool = False, blanks: bool = False) -> Column:
    """The words of a text (or of one line of it), cut at ASCII white space.

    A split at one plain character needs no regular expression, and texts without rare blanks skip their replacement.
    With `blanks` the empty strings between neighbouring blanks stay.
    """
    rare = [F.contains(text, F.lit(blank)) for blank in "\t\x0b\x0c\r"]
    plain = text if line else F.replace(text, F.lit("\n"), F.lit(" "))
    folded = plain
    for blank in "\t\x0b\x0c\r":
        folded = F.replace(folded, F.lit(blank), F.lit(" "))
    some = rare[0] | rare[1] | rare[2] | rare[3]
    parts = F.split(F.when(some, folded).otherwise(plain), " ")
    return parts if blanks else F.array_remove(parts, "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def numbered(df: DataFrame, order: list[str], name: str, column: str = "row_no") -> tuple[DataFrame, int]:
    """`df` with a gapless global row number (from 0) in the order of `order`, and the number of rows.

    A range partitioning sorts the rows; only one count for each partition reaches the driver. Rows that tie
    on all of `order` must be interchangeable for the caller. Nulls come first.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *[F.col(c).asc_nulls_first() for c in order])
    ranged = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    placed = saved(
        ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mono")), name
    )
    counts = sorted(tuple(r) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    within = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.join(F.broadcast(offsets), "_part").withColumn(column, F.col("_start") + within)
    return out.drop("_part", "_mono", "_start"), total

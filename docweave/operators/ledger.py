"""The ledger of arrived files: what is pending, in which slices, and what is done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import object_uri
from docweave.operators.skew import null_safe
from docweave.sources.notifications import PROCESSED
from docweave.workspace import shared_folder


PLACE_BITS = 33

# What makes a file one: a later file of the same name has another sequencer or tag.
IDENTITY = ("bucketName", "fileName", "sequencer", "fileeTag")


def with_file_path(bookmarks: DataFrame, scheme: str = "s3") -> DataFrame:
    """Bookmarks with the address of the raw file they point to."""
    return bookmarks.withColumn("filePath", object_uri(F.col("bucketName"), F.col("fileName"), scheme))


# Parts among which done files are kept, and the column of the part.
PARTS, PART = 256, "part"


def part_of_file() -> Column:
    """The part in which a file is kept when it is done, by its bucket and folder.

    New files mostly come into few folders, and so the files that they have to be compared with are in few parts.
    """
    folder = F.regexp_replace(F.coalesce("fileName", F.lit("")), "/?[^/]*$", "")
    return F.pmod(F.xxhash64(F.coalesce("bucketName", F.lit("")), folder), F.lit(PARTS)).cast("int")


def pending(arrived: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``arrived`` whose key is not in ``done``."""
    processed = done.select(*keys)
    return arrived.join(processed, null_safe(arrived, processed, keys), "left_anti")


def processed(bookmarks: DataFrame) -> DataFrame:
    """The same bookmarks after their files were written."""
    return bookmarks.withColumn("status", F.lit(PROCESSED))


def first_n_files(files: DataFrame, path: str, n: int | None) -> DataFrame:
    """The first ``n`` files in path order, or all."""
    return files if n is None else files.orderBy(path).limit(n)


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Rows numbered from 1 over the whole table, without bringing it into one task.

    Rows are range-partitioned and written once, so that the partition of a row is a fact
    and not a sample that may differ on a retry.  Each partition then counts on from the
    rows before it; the offsets are one row per partition.  ``order`` must be unique.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "numbered")
    # Spark's id has the partition above these bits, and below them the place in the partition.
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged.write.parquet(folder)
    stored = spark.read.schema(ranged.schema).parquet(folder)
    part, place = F.shiftright("__id", PLACE_BITS), F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    ranged = stored.withColumns({"__part": part, "__row": place + 1}).drop("__id")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("__part")
        .agg(F.count("*").alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        ranged.join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__row") + F.col("__offset")).cast("bigint"))
        .drop("__part", "__row", "__offset")
    )


def batch_slices(files: DataFrame, order: Sequence[str], size: int, name: str = "slice_id") -> DataFrame:
    """Files with the number (from 0) of the slice of ``size`` files they fall into."""
    rows = numbered(files, order, "__number")
    return rows.withColumn(name, F.floor((F.col("__number") - 1) / size).cast("bigint")).drop("__number")


def slice_paths(slices: DataFrame, path: Column, slice_id: str = "slice_id") -> DataFrame:
    """The sorted paths of each slice as one list, which is no longer than a slice."""
    return slices.groupBy(slice_id).agg(F.sort_array(F.collect_list(path)).alias("paths"))

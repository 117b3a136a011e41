"""File-arrival notifications and the bookmarks made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import text
from docweave.schemas import BOOKMARK, CORRUPT, NOTIFICATION, with_corrupt

# How bookmark files are written, and the constant columns of a bookmark.
BOOKMARK_CSV = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
REALTIME_LAYER = "RTDataHub"
CURATED_LAYER = "Curated"
UNPROCESSED = "Unprocessed"
PROCESSED = "Processed"

# The state of what could not be routed.
REJECTED = "Rejected"


def scan_notifications(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Notifications; text that is none is kept in a column of its own."""
    return spark.read.schema(with_corrupt(NOTIFICATION)).option("multiLine", multiline).json(path)


def notification_records(notifications: DataFrame) -> DataFrame:
    """One row per notified file, with the ten flat bookmark fields and the source system of its own key.

    Text that is no notification, or that parses in part only, gives one row without a file, and
    itself as ``raw``.
    """
    record = F.col("record")
    key = record["s3"]["object"]["key"]
    raw = F.col(CORRUPT) if CORRUPT in notifications.columns else F.lit(None).cast("string")
    whole = notifications.withColumn("Records", F.when(raw.isNull(), F.col("Records")))
    records = whole.select("Records", raw.alias("raw"), F.explode_outer("Records").alias("record"))
    return records.where(F.col("Records").isNull() | record.isNotNull()).select(
        record["eventTime"].alias("eventTime"),
        record["eventName"].alias("eventName"),
        record["userIdentity"]["principalId"].alias("userIdentity"),
        record["requestParameters"]["sourceIPAddress"].alias("sourceIPAddress"),
        record["s3"]["bucket"]["name"].alias("bucketName"),
        record["s3"]["bucket"]["arn"].alias("bucketArn"),
        key.alias("fileName"),
        record["s3"]["object"]["size"].alias("fileSize"),
        record["s3"]["object"]["eTag"].alias("fileeTag"),
        record["s3"]["object"]["sequencer"].alias("sequencer"),
        text.segment(key, 1).alias("sourceSystem"),
        "raw",
    )


def bookmarks(records: DataFrame, layer: str = REALTIME_LAYER) -> DataFrame:
    """The 13 bookmark columns for one data layer."""
    return records.withColumns({"dataLayer": F.lit(layer), "status": F.lit(UNPROCESSED)}).select(*BOOKMARK.names)


def _bookmark_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The bookmark columns of every line by the names in its file's own header, the file, and the line if it does not fit.

    Headers are read as lines. Only those in another order than usual are joined with their files' lines.
    """
    names = BOOKMARK.names
    places = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    options = BOOKMARK_CSV | {"header": "false", "columnNameOfCorruptRecord": CORRUPT, "recursiveFileLookup": "true"}
    lines = spark.read.schema(with_corrupt(places)).options(**options).csv(paths)
    lines = lines.select(F.array(*places.names).alias("values"), CORRUPT, F.col("_metadata.file_path").alias("bookmarkPath"))
    usual = F.array(*[F.lit(n) for n in names])
    is_header = F.col(CORRUPT).isNull() & (F.sort_array("values") == F.sort_array(usual))
    headers = lines.where(is_header & (F.col("values") != usual)).select("bookmarkPath", F.col("values").alias("header"))
    by_name = F.map_from_arrays(F.coalesce("header", usual), F.col("values"))
    rows = lines.where(~is_header).join(headers.distinct(), "bookmarkPath", "left").withColumn("by_name", by_name)
    fields = {f.name: F.col("by_name")[f.name] for f in BOOKMARK.fields}
    odd_size = fields["fileSize"].isNotNull() & fields["fileSize"].try_cast("bigint").isNull()
    line = F.coalesce(CORRUPT, F.when(odd_size, F.array_join("values", ",", "")))
    return rows.select(
        *[fields[f.name].try_cast(f.dataType).alias(f.name) for f in BOOKMARK.fields], "bookmarkPath", line.alias(CORRUPT)
    )


def scan_bookmarks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bookmark CSV files as one table, each row with the file it came from.

    Columns are found by name, whatever their order in a file. Types are fixed: guessing would read an eTag such
    as 1234e5 as a number. Lines that do not fit are left to :func:`bad_bookmarks`.
    """
    return _bookmark_lines(spark, paths).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_bookmarks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Quarantine rows for lines with too few or too many values, or a size that is no number."""
    bad = _bookmark_lines(spark, paths).where(F.col(CORRUPT).isNotNull())
    return bad.select(F.lit("bad_line").alias("reason"), F.col(CORRUPT).alias("raw"), F.col("bookmarkPath").alias("source_file"))

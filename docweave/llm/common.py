"""What the operators of this subpackage share: tables, text batches, materialised steps."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.workspace import shared_folder

#: Bytes of Arrow data that a Python task is handed at once; texts may be long.
BATCH_BYTES = 16 << 20
#: The setting under which Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: First bits of a hash by which ids are counted.
BUCKET_BITS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a step into the shared folder and read it back.

    This cuts the lineage, so a lost executor costs at most the running step, and gives
    every later use the same rows.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mounted_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that every worker can map files of: the shared one, which has to be mounted."""
    path = urlparse(shared_folder(spark, purpose))
    if path.scheme not in ("", "file"):
        raise ValueError("workers map files into memory, so spark.checkpoint.dir has to be a mounted folder")
    os.makedirs(path.path)
    return path.path


def is_remainder(column: str, divisor: int, remainder: int):
    """crc32 of an id as text, modulo a divisor, equals a remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor == remainder, F.lit(False))


def as_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a text column as UTF-8, one at a time, without decoding them."""
    data = column.cast(pa.large_binary())
    for value in data:
        yield value.as_py()


def chunks(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes of text, one row at least."""
    start = size = 0
    for row, value in enumerate(as_bytes(column)):
        length = 0 if value is None else len(value)
        if size and size + length > limit:
            yield start, row
            start, size = row, 0
        size += length
    if start < len(column):
        yield start, len(column)


def pieces(text: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """A UTF-8 text in pieces of about ``limit`` bytes, cut at white space or, failing that, between characters."""
    start, end = 0, len(text)
    while end - start > limit:
        cut = max(text.rfind(space, start + 1, start + limit) for space in (b" ", b"\n", b"\t", b"\r"))
        if cut <= start:
            cut = start + limit
            while text[cut] & 0xC0 == 0x80:
                cut -= 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def labelled(labels: DataFrame, column: str, value: int, limit: int, id_column: str = "doc_id") -> DataFrame:
    """doc_id, label: at most ``limit`` distinct ids that carry a label value, first in the order of a hash of the id.

    The order does not depend on how the table is stored, and the result is small by construction. Ids are counted by
    the first bits of their hash, and only those up to the bits that are needed are put in order.
    """
    ids = labels.where((F.col(column) == value) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc_id")).distinct()
    ids = ids.withColumn("hash", F.xxhash64("doc_id"))
    bucket = F.shiftright("hash", 64 - BUCKET_BITS)
    last = before = 0
    for last, n in sorted(map(tuple, ids.groupBy(bucket.alias("bucket")).count().collect())):  # at most 2 ** BUCKET_BITS rows
        before += n
        if before >= limit:
            break
    return ids.where(bucket <= last).orderBy("hash", "doc_id").limit(limit).select("doc_id", F.lit(value).alias("label"))


def one_text_each(texts: DataFrame) -> DataFrame:
    """doc_id, label, text: one row for each (doc_id, label), with the text of least hash, so that a sample of ids bounds its texts."""
    first = F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text"))
    return texts.groupBy("doc_id", "label").agg(first.alias("first")).select("doc_id", "label", "first.text")

"""Tables on shared storage.

Partitioned writes use Spark's REBALANCE: rows of one partition value go together, and a
value that holds a large part of the rows is split over several tasks and files.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Mapping, Sequence
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.names import is_case_sensitive, quoted
from docweave.operators.upsert import latest_per_key, latest_versions, live_rows
from docweave.schemas import AUDIT, AUDIT_KEYS, BOOKMARK, LEDGER, QUARANTINE
from docweave.sources.documents import setting
from docweave.sources.files import (
    BASE,
    BASE_FOLDER,
    BATCH,
    COLUMNS_FOLDER,
    VERSION,
    Noted,
    current_root,
    entries,
    exists,
    noted_columns,
    numbers,
    stored_names,
)
from docweave.sources.notifications import BOOKMARK_CSV, REJECTED
from docweave.workspace import CLEANUP

# The states of a job.
STARTED, COMPLETED, FAILED = "Started", "Completed", "Failed"

# Partition columns of quarantined rows.
QUARANTINE_PARTITIONS = ["source_system", "table_name", "year", "month", "day"]
LEDGER_PARTITIONS = ["status", "data_layer", "source"]

#: The folder inside a compacted batch in which it is noted of which keys it holds one version each.
COMPACTED_FOLDER = "_compacted"

#: Shuffled bytes that a task which sorts its rows is given. In memory rows are about twenty times as large.
SORTED_BYTES = "16MB"


def write_table(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "append",
    options: Mapping[str, str] | None = None,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
) -> None:
    """``sort_by`` puts rows that are asked for together side by side in their files; a task then has about
    ``SORTED_BYTES``, however many rows there are of one partition value, as it holds them in memory."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.format(format).options(**(options or {})).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with setting(df.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", SORTED_BYTES) if sort_by else nullcontext():
        writer.save(path)


def write_quarantine(
    df: DataFrame, path: str, source_system: str, table_name: str, at: str, batch_id: int | None = None
) -> None:
    """Append rejected rows, partitioned by source, table and the date of column ``at``.

    With a ``batch_id`` they go below a folder of that batch, in place of what it held before.
    """
    rows = df.withColumns(
        {
            "source_system": F.lit(source_system),
            "table_name": F.lit(table_name),
            "year": F.date_format(at, "yyyy"),
            "month": F.date_format(at, "MM"),
            "day": F.date_format(at, "dd"),
        }
    )
    folder, mode = (path, "append") if batch_id is None else (f"{path}/batch_id={batch_id}", "overwrite")
    write_table(rows, folder, mode=mode, partition_by=QUARANTINE_PARTITIONS)


def clear_quarantine(spark: SparkSession, path: str, batch_id: int) -> None:
    """Empty the quarantine of a batch that has nothing to reject any more."""
    folder = f"{path}/batch_id={batch_id}"
    if exists(spark, folder):
        write_table(spark.createDataFrame([], QUARANTINE), folder, mode="overwrite", partition_by=QUARANTINE_PARTITIONS)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Rejected rows of all batches; no rows if there was never anything to reject."""
    if not exists(spark, path):
        return spark.createDataFrame([], QUARANTINE)
    return spark.read.schema(QUARANTINE).parquet(path)


def write_ledger(routed: DataFrame, path: str, batch_id: int) -> None:
    """Add routed notifications to the ledger table, one partition per state and queue.

    What could not be routed is in the same table, in the partition of rejected rows, so
    that everything is written in one pass; a stray key must not open a partition of its
    own, so these rows name no queue.  Writing the same batch again replaces it.
    """
    good = F.col("reason").isNull()
    queue = {name: F.when(good, F.col(name)) for name in ("source", "table")}
    rows = routed.withColumns({"status": F.when(good, F.col("status")).otherwise(REJECTED), **queue})
    write_table(rows, f"{path}/batch_id={batch_id}", mode="overwrite", partition_by=LEDGER_PARTITIONS, sort_by=["table"])


def compact_ledger(spark: SparkSession, path: str, new_path: str) -> None:
    """Write all batches of a ledger as batch 0 of a new one, in few files.

    Micro-batches leave a file per state, layer and source each; this is what keeps their number down.
    """
    rows = spark.read.schema(LEDGER).parquet(path)
    write_table(rows, f"{new_path}/batch_id=0", mode="overwrite", partition_by=LEDGER_PARTITIONS, sort_by=["table"])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger table without rejected rows; filters on state, layer and source prune partitions, and one on
    the table skips parts of the files, which are sorted by it.

    Its schema is fixed: guessing would read a table named 007 as a number.
    """
    return spark.read.schema(LEDGER).parquet(path).where(F.col("status") != REJECTED).drop("reason", "raw")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """What could not be routed, with the reason."""
    return spark.read.schema(LEDGER).parquet(path).where(F.col("status") == REJECTED)


def write_bookmark_files(bookmarks: DataFrame, path: str) -> None:
    """The 13 bookmark columns as CSV with a header, one folder per queue."""
    queue = F.regexp_replace("destKey", "/[^/]*$", "").alias("queue")
    write_table(bookmarks.select(*BOOKMARK.names, queue), path, "csv", options=BOOKMARK_CSV, partition_by=["queue"])


def _note_columns(df: DataFrame, root: str, stored: Mapping[str, str], batch_id: int) -> None:
    columns = [(i, f.name, f.dataType.simpleString(), stored[f.name]) for i, f in enumerate(df.schema.fields)]
    noted = df.sparkSession.createDataFrame(columns, "position int, name string, type string, stored string").coalesce(1)
    noted.write.mode("overwrite").parquet(f"{root}/{COLUMNS_FOLDER}/{BATCH}={batch_id}")


def _stored(df: DataFrame, root: str, noted: Sequence[Noted] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under the names that its columns have in files."""
    own = {VERSION: VERSION} if VERSION in df.columns else {}
    names = [name for name in df.columns if name not in own]
    if noted is None and len({name.lower() for name in names}) == len(names) and names == list(stored_names(names).values()):
        return df, {name: name for name in df.columns}
    noted = (noted_columns(df.sparkSession, root) or []) if noted is None else noted
    stored = own | stored_names(names, noted)
    return df.toDF(*[stored[name] for name in df.columns]), stored


def append_batch(
    df: DataFrame,
    path: str,
    batch_id: int,
    format: str = "parquet",
    options: Mapping[str, str] | None = None,
    known: Sequence[str] | None = None,
) -> None:
    """Add the rows of one batch to a change table, above its last full load; the same batch written again replaces itself.

    Its columns are noted beside the table, unless they are the ``known`` ones, which are noted already. Attributes
    whose names differ only in case, or that are called like a column of the table itself, get a column of another name, which
    is noted with them.
    """
    root = current_root(df.sparkSession, path)
    is_new = known is None or set(df.columns) - {VERSION} != set(known) - {VERSION}
    rows, stored = _stored(df, root)
    if is_new or rows is not df:
        noted = noted_columns(df.sparkSession, root)
        if noted:  # what is noted keeps its column
            rows, stored = _stored(df, root, noted)
        if is_new:
            _note_columns(df, root, stored, batch_id)
    # What was shuffled for a batch goes when it is written, not when the driver happens to collect its garbage.
    with setting(df.sparkSession, CLEANUP, "true"):
        rows.write.format(format).options(**(options or {})).mode("overwrite").save(f"{root}/{BATCH}={batch_id}")


def write_base(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "overwrite",
    options: Mapping[str, str] | None = None,
) -> str:
    """Write a full load; returns the folder that holds it.

    With mode="overwrite" it takes the place of all the table held. Over a table of batches it is written into a folder of its
    own and noted when it is complete, so readers see the old table or the new one; batches that come later go above
    it. Where there are no batches the table is a plain folder of files, and other modes add to what is current.
    """
    spark = df.sparkSession
    root = current_root(spark, path)
    if mode == "ignore" and exists(spark, root):
        return root
    over_batches = mode == "overwrite" and bool(numbers(entries(spark, root)))
    if over_batches:
        bases = numbers(entries(spark, f"{path}/{BASE_FOLDER}"), BASE)
        number = (bases[-1] if bases else 0) + 1
        root = f"{path}/{BASE}={number}"
    noted = [] if mode == "overwrite" else noted_columns(spark, root) or []
    rows, stored = _stored(df, root, noted)
    rows.write.format(format).options(**(options or {})).mode(mode).save(root)
    loads = numbers(entries(spark, f"{root}/{COLUMNS_FOLDER}"))  # those of full loads are below zero
    _note_columns(df, root, stored, min([0, *loads]) - 1)
    if over_batches:
        done = spark.range(1).select(F.current_timestamp().alias("loaded_at")).coalesce(1)
        done.write.mode("overwrite").parquet(f"{path}/{BASE_FOLDER}/{BASE}={number}")
    return root


def _read(spark: SparkSession, path: str, schema: T.StructType | None, format: str) -> tuple[DataFrame, list[Noted]]:
    """All rows of a table that is current, under their stored names, and with their batch, NULL for a full load."""
    root = current_root(spark, path)
    there = entries(spark, root)
    batches = numbers(there)
    plain = any(not name.startswith(("_", ".")) and "=" not in name for name in there)
    noted = noted_columns(spark, root) or []
    if schema is not None:
        schema, noted = T.StructType([*schema.fields, T.StructField(VERSION, T.StringType())]), []
    elif noted:
        fields = [T.StructField(c.stored, T.DataType.fromDDL(c.type)) for c in noted]
        if VERSION not in [c.stored for c in noted]:
            fields.append(T.StructField(VERSION, T.StringType()))
        schema = T.StructType(fields)

    def load(place: str) -> DataFrame:
        reader = spark.read.format(format).option("basePath", root)
        if schema is None:
            return reader.option("mergeSchema", "true").load(place)
        fields = [*schema.fields, *([] if place.endswith("part-*") else [T.StructField(BATCH, T.LongType())])]
        return reader.schema(T.StructType(fields)).load(place)

    parts = []
    if batches or not plain:
        parts.append(load(f"{root}/{BATCH}=*" if plain else root))
    if plain:
        parts.append(load(f"{root}/part-*" if batches else root))
        if BATCH not in parts[-1].columns:
            parts[-1] = parts[-1].withColumn(BATCH, F.lit(None).cast("bigint"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows, noted


def _attributes(rows: DataFrame, noted: Sequence[Noted]) -> DataFrame:
    """Columns under the names of their attributes, but for those that this session could not tell apart."""
    names = {c.stored: c.name for c in noted}

    def fold(name: str) -> str:
        return name if is_case_sensitive(rows) else name.lower()

    wanted = [names.get(column, column) for column in rows.columns]
    uses = Counter(map(fold, wanted))
    return rows.select(
        *[F.col(quoted(c)).alias(name if uses[fold(name)] == 1 else c) for c, name in zip(rows.columns, wanted)]
    )


def stored_columns(spark: SparkSession, path: str) -> dict[str, str]:
    """Each attribute of a table, and the column that holds it."""
    noted = noted_columns(spark, current_root(spark, path)) or []
    return {c.name: c.stored for c in noted if c.stored != VERSION}


def read_changes(
    spark: SparkSession, path: str, schema: T.StructType | None = None, format: str = "parquet"
) -> DataFrame:
    """All rows of a table since its last full load, with the number of their batch (NULL for the full load).

    Without a schema the columns are those noted for any batch. Where the session cannot tell two attributes
    apart, such as ``v`` and ``V``, or one and the number of the batch, the later is under its stored name: :func:`stored_columns`.
    """
    rows, noted = _read(spark, path, schema, format)
    return _attributes(rows.drop(VERSION), noted)


def read_current(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    seq: str,
    order: str = "numeric",
    deletes: str | None = None,
    schema: T.StructType | None = None,
    format: str = "parquet",
) -> DataFrame:
    """The table that a full load and the batches above it add up to: all rows of the latest version of each key.

    A version that came in several batches is taken from the last of them, and one that was delivered several times in
    a batch from one delivery. ``keys`` and ``seq`` are attributes; names of columns are those of :func:`read_changes`.
    A compacted table without batches above is read as it stands, with no shuffle.
    """
    compacted = _is_compacted(spark, current_root(spark, path), keys, seq, order)
    rows, noted = _read(spark, path, schema, format)
    if compacted:
        latest = _attributes(rows.where(F.col(BATCH) == 0).drop(BATCH, VERSION), noted)
        return latest if deletes is None else live_rows(latest, deletes)
    stored = {c.name: c.stored for c in noted}
    prefer = [F.col(BATCH).desc_nulls_last()]
    if VERSION in rows.columns:
        prefer.append(F.col(VERSION).desc_nulls_last())
    latest = latest_versions(rows, [stored.get(k, k) for k in keys], stored.get(seq, seq), order, prefer=prefer)
    latest = _attributes(latest.drop(BATCH, VERSION), noted)
    return latest if deletes is None else live_rows(latest, deletes)


def _versions_of(keys: Sequence[str], seq: str, order: str) -> str:
    return json.dumps([list(keys), seq, order])


def _is_compacted(spark: SparkSession, root: str, keys: Sequence[str], seq: str, order: str) -> bool:
    """Whether a table is one compacted batch, which holds the latest version of each key by the same order."""
    there = entries(spark, root)
    data = [name for name in there if not name.startswith(("_", "."))]
    note = f"{root}/{BATCH}=0/{COMPACTED_FOLDER}"
    if data != [f"{BATCH}=0"] or not exists(spark, f"{note}/_SUCCESS"):
        return False
    return spark.read.schema("by string").parquet(note).first()[0] == _versions_of(keys, seq, order)


def compact(
    spark: SparkSession,
    path: str,
    new_path: str,
    keys: Sequence[str],
    seq: str,
    order: str = "numeric",
    format: str = "parquet",
) -> None:
    """Write the current rows (tombstones included) of a change table as batch 0 of a new one.

    The batch is noted as compacted when it is complete; the note is inside it, so writing the batch again removes it.
    """
    current = read_current(spark, path, keys, seq, order, format=format)
    stored = {column: name for name, column in stored_columns(spark, path).items()}
    append_batch(current.toDF(*[stored.get(c, c) for c in current.columns]), new_path, 0, format)
    note = spark.range(1).select(F.lit(_versions_of(keys, seq, order)).alias("by")).coalesce(1)
    note.write.mode("overwrite").parquet(f"{current_root(spark, new_path)}/{BATCH}=0/{COMPACTED_FOLDER}")


def audit_path(root: str, source_system: str, table_name: str) -> str:
    return f"{root}/{source_system.lower()}/{table_name.lower()}"


def append_audit(entry: DataFrame, path: str) -> None:
    """Add the entry of one state of one job, in a folder of its own; the same state written again replaces itself."""
    writer = entry.select(*AUDIT.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*AUDIT_KEYS, "status").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """One row per job: the entry with the greatest end sequence, an end before a start."""
    entries = spark.read.schema(AUDIT).parquet(path)
    ended = (F.col("status") != STARTED).desc()
    return latest_per_key(entries, AUDIT_KEYS, "record_end_sequence", prefer=[ended]).select(*AUDIT.names)


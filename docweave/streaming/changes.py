"""Change-feed files to a change table, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docweave.operators.upsert import latest_per_key
from docweave.plans.jobs import SLICE_SIZE, AuditLog, Counts, Loaded, load_slice, store_changes
from docweave.sinks.tables import COMPLETED, FAILED, STARTED, append_batch
from docweave.sources.documents import case_sensitive, stream_feed, stream_paths
from docweave.sources.files import current_root, target_columns


def change_stream(
    spark: SparkSession,
    files: str,
    schema: T.StructType,
    transform: Callable[[DataFrame], DataFrame],
    table: str,
    checkpoint: str,
    keys: Sequence[str],
    seq: str,
    order: str = "numeric",
    max_files: int | None = None,
    multiline: bool = False,
) -> StreamingQuery:
    """Bring all pending JSON files into the change table, then stop.

    ``transform`` turns parsed files into table rows.  Each micro-batch is reduced to its
    latest row per key and added below its own batch_id: what a batch costs depends on
    the batch alone and not on the size of the table, and a repeated batch replaces itself.
    """
    reader = spark.readStream.schema(schema).option("multiLine", multiline)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    noted: list[str] | None = None

    def store(batch: DataFrame, batch_id: int) -> None:
        nonlocal noted
        rows = latest_per_key(transform(batch), keys, seq, order)
        append_batch(rows, table, batch_id, known=noted)
        noted = rows.columns

    return _run(reader.json(files), store, checkpoint)


def feed_stream(
    spark: SparkSession,
    files: str,
    table: str,
    quarantine: str,
    checkpoint: str,
    schema: T.StructType | None = None,
    max_files: int = SLICE_SIZE,
    multiline: bool = True,
    audit: AuditLog | None = None,
    **options,
) -> StreamingQuery:
    """Bring all pending feed files of typed JSON into the change table, flat, then stop.

    Every micro-batch gets the columns that the table has by then.  Without a schema the one that is kept beside the table
    is taken and widened, as by :func:`load_changes`, and files that cannot be read go to the quarantine.  Under a given one
    documents with attributes or type tags that it lacks go there.  Attributes that
    differ only in case stay apart.  Only the paths of one micro-batch, ``max_files`` at most, come to the driver.

    ``audit`` notes the start of a run that has work, and after each micro-batch what the run has loaded; a micro-batch
    that is repeated is counted once.
    """
    columns: list[str] = []
    known_root = None
    if audit:
        options = {"source_system": audit.source_system, "table_name": audit.table_name} | options

    def stored(load: Callable[[list[str]], Loaded], batch_id: int) -> None:
        nonlocal columns, known_root
        root = current_root(spark, table)
        if root != known_root:  # at first, and after a full load
            columns, known_root = target_columns(spark, table), root
            if audit:
                audit.note(spark, STARTED, Counts())
        try:
            loaded = load(columns)
            columns = loaded.columns
            if audit:
                audit.note(spark, COMPLETED, audit.note_batch(spark, checkpoint, batch_id, loaded.counts))
        except Exception:
            if audit:
                audit.note(spark, FAILED, Counts())
            raise

    def store_parsed(batch: DataFrame, batch_id: int) -> None:
        with case_sensitive(batch.sparkSession):
            stored(lambda known: store_changes(batch, table, quarantine, batch_id, known, schema=schema, **options), batch_id)

    def store_files(batch: DataFrame, batch_id: int) -> None:
        paths = [row.path for row in batch.collect()]
        stored(
            lambda known: load_slice(spark, paths, table, quarantine, batch_id, columns=known, multiline=multiline, **options), batch_id
        )

    if schema is None:
        return _run(stream_paths(spark, files, max_files), store_files, checkpoint)
    with case_sensitive(spark):  # a stream keeps the settings it was started with
        return _run(stream_feed(spark, files, schema, multiline, max_files), store_parsed, checkpoint)


def _run(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()

"""Notifications to ledger, as files arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docweave.operators.routing import Rule, route
from docweave.schemas import NOTIFICATION, with_corrupt
from docweave.sinks.tables import write_ledger
from docweave.sources.notifications import notification_records


def arrival_stream(
    spark: SparkSession,
    notifications: str,
    rules: Sequence[Rule],
    ledger: str,
    checkpoint: str,
    max_files: int | None = None,
) -> StreamingQuery:
    """Route all notifications there are, then stop.  Start it again to go on from there.

    A micro-batch is written below its own batch_id, so one that is repeated after a
    failure replaces what it wrote before.
    """
    reader = spark.readStream.schema(with_corrupt(NOTIFICATION))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    routed = route(notification_records(reader.json(notifications)), rules)

    def store(batch: DataFrame, batch_id: int) -> None:
        write_ledger(batch, ledger, batch_id)

    return (
        routed.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

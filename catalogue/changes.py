"""Upserts, counts, audit and the change stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.registry import query, table
from docweave.operators.conform import union_files
from docweave.operators.counts import audit_entry, record_counts
from docweave.operators.upsert import latest_per_key, live_rows, upsert_latest
from docweave.sinks.tables import append_audit, append_batch, compact, read_audit, read_current, write_quarantine, write_table
from docweave.streaming.changes import change_stream
from docweave.workspace import shared_folder

CUT = "2024-01-15"


def _event_rows(events: DataFrame) -> DataFrame:
    return events.select(
        "user_id", F.col("event_id").cast("string").alias("event_id"), "event_type", "value", "props", "ts"
    )


def _target_and_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The latest event of each user before the cut, and as changes all later events
    together with the older views, which come in late and must not win."""
    events = _event_rows(table(spark, sf_dir, "events"))
    old = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
    target = latest_per_key(events.where(old), ["user_id"], "event_id")
    return target, events.where(~old | (F.col("event_type") == "view"))


_LATEST = """
SELECT user_id, event_id, event_type, value, props FROM (
  SELECT user_id, CAST(event_id AS VARCHAR) AS event_id, event_type, value, props,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n
  FROM events) WHERE n = 1
"""
_COLUMNS = ["user_id", "event_id", "event_type", "value", "props"]


@query("upsert_latest", _LATEST)
def upsert_latest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, changes = _target_and_changes(spark, sf_dir)
    return upsert_latest(target, changes, ["user_id"], "event_id").select(_COLUMNS)


@query("upsert_small_changes", _LATEST)
def upsert_small_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, changes = _target_and_changes(spark, sf_dir)
    return upsert_latest(target, changes, ["user_id"], "event_id", small_changes=True).select(_COLUMNS)


@query("upsert_with_deletes", _LATEST + " AND event_type <> 'error'")
def upsert_with_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, changes = _target_and_changes(spark, sf_dir)
    gone = F.col("event_type") == "error"
    merged = upsert_latest(
        target.withColumn("gone", gone), changes.withColumn("gone", gone), ["user_id"], "event_id", deletes="gone"
    )
    return live_rows(merged, "gone").select(_COLUMNS)


@query(
    "latest_per_key",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY strftime(l_shipdate, '%Y-%m-%d') || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey DESC) AS n
  FROM lineitem) WHERE n = 1
""",
)
def latest_per_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    shipped = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", day.alias("l_shipdate"),
        F.concat_ws("/", day, "l_linenumber", "l_partkey", "l_suppkey").alias("shipped"),
    )
    return latest_per_key(shipped, ["l_orderkey"], "shipped", order="lexical").drop("shipped")


@query(
    "change_table",
    """
SELECT user_id, event_type, event_id, value FROM (
  SELECT user_id, event_type, CAST(event_id AS VARCHAR) AS event_id, value,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n
  FROM events) WHERE n = 1
""",
)
def change_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches added out of order, one of them twice, compacted, and read as a table."""
    events = _event_rows(table(spark, sf_dir, "events"))
    old = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
    path, compacted = shared_folder(spark, "changes"), shared_folder(spark, "changes")
    keys = ["user_id", "event_type"]
    append_batch(latest_per_key(events.where(~old), keys, "event_id"), path, 1)
    for _ in range(2):
        append_batch(latest_per_key(events.where(old), keys, "event_id"), path, 2)
    compact(spark, path, compacted, keys, "event_id")
    return read_current(spark, compacted, keys, "event_id", schema=events.schema).select(*keys, "event_id", "value")


def _kind() -> Column:
    return F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")


_COUNTS = """
SELECT count(*) FILTER (event_type = 'signup') AS "I",
       count(*) FILTER (event_type NOT IN ('signup', 'error')) AS "U",
       count(*) FILTER (event_type = 'error') AS "D",
       CAST(min(event_id) AS VARCHAR) AS "SQ", CAST(max(event_id) AS VARCHAR) AS "EQ"
FROM events
"""


@query("record_counts", _COUNTS)
def record_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_counts(table(spark, sf_dir, "events").withColumn("kind", _kind()), "event_id", "kind")


@query(
    "record_counts_plain",
    """
SELECT count(*) AS "I", CAST(0 AS BIGINT) AS "U", CAST(0 AS BIGINT) AS "D", min(CAST(l_orderkey AS VARCHAR)) AS "SQ",
       max(CAST(l_orderkey AS VARCHAR)) AS "EQ"
FROM lineitem
""",
)
def record_counts_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row an insert, sequences compared as text."""
    return record_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", order="lexical")


_AUDIT_SQL = """
SELECT CAST(epoch AS BIGINT) AS epoch_timestamp, 'Events' AS source_system, kind AS table_name, status,
       count(*) FILTER (event_type = 'signup') AS insert_count,
       count(*) FILTER (event_type NOT IN ('signup', 'error')) AS update_count,
       count(*) FILTER (event_type = 'error') AS delete_count,
       CAST(min(event_id) AS VARCHAR) AS record_start_sequence, CAST(max(event_id) AS VARCHAR) AS record_end_sequence,
       'job.log' AS log_file_name
FROM (SELECT *, event_type AS kind, CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Completed' END AS status FROM events),
     (VALUES (1700000000), (1700000001)) jobs(epoch)
GROUP BY epoch, kind, status
"""


@query("audit_entry", _AUDIT_SQL)
def audit_entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two jobs for each type of event, each with an entry at its start and one at its end, of which none is lost."""
    path = shared_folder(spark, "audit")
    events = table(spark, sf_dir, "events").withColumn("kind", _kind())
    kinds = [r.event_type for r in events.select("event_type").distinct().orderBy("event_type").collect()]
    for epoch in (1_700_000_000, 1_700_000_001):
        for status in ("Started", "Ended"):
            entries = []
            for kind in kinds:
                rows = events.where((F.col("event_type") == kind) & F.lit(status == "Ended"))
                ended = "Failed" if kind == "error" else "Completed"
                job = (epoch, "Events", kind, ended if status == "Ended" else "Started", "job.log")
                entries.append(audit_entry(record_counts(rows, "event_id", "kind"), *job))
            append_audit(union_files(entries), path)
    if spark.read.parquet(path).count() != 4 * len(kinds):
        raise AssertionError("an entry was lost")
    return read_audit(spark, path)


@query(
    "write_table_roundtrip",
    """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_orderpriority FROM orders
""",
)
def write_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "table")
    write_table(table(spark, sf_dir, "orders"), path, "orc", "overwrite", {"compression": "zstd"})
    return spark.read.orc(path).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query(
    "quarantine_partitions",
    """
SELECT 'web' AS source_system, 'events' AS table_name, strftime(ts, '%Y') AS "year", strftime(ts, '%m') AS "month",
       strftime(ts, '%d') AS "day", event_type AS reason, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
FROM events GROUP BY ALL
""",
)
def quarantine_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "quarantine")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("reason"))
    write_quarantine(rows, path, "web", "events", "ts")
    schema = "event_id bigint, reason string, source_system string, table_name string, year string, month string, day string"
    keys = ["source_system", "table_name", "year", "month", "day", "reason"]
    return (
        spark.read.schema(schema).parquet(path).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    )


@query("stream_change_feed", _LATEST)
def stream_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as JSON files, read by a stream in several micro-batches."""
    files, out, checkpoint = (shared_folder(spark, name) for name in ("feed", "changes", "checkpoint"))
    parts = spark.sparkContext.defaultParallelism
    events = _event_rows(table(spark, sf_dir, "events"))
    events.repartition(parts, "event_id").write.json(files)
    change_stream(
        spark,
        files,
        events.schema,
        lambda batch: batch,
        out,
        checkpoint,
        ["user_id"],
        "event_id",
        max_files=max(1, parts // 2),
    ).awaitTermination()
    return read_current(spark, out, ["user_id"], "event_id", schema=events.schema).select(_COLUMNS)

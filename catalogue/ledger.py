"""Notifications, routing and the file ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.registry import query, table
from docweave.operators.ledger import batch_slices, first_n_files, numbered, pending, processed, slice_paths, with_file_path
from docweave.operators.routing import Condition, Destination, Rule, destinations, quarantined, route
from docweave.plans.jobs import DONE, AuditLog, bookmark_notifications, ingest_pending, read_or_empty
from catalogue.standard_rules import standard_rules
from docweave.schemas import BOOKMARK
from docweave.sinks.tables import read_audit, read_current, read_ledger, read_quarantine, write_bookmark_files, write_table
from docweave.sources.files import list_input_files
from docweave.sources.notifications import (
    BOOKMARK_CSV,
    bookmarks,
    notification_records,
    scan_bookmarks,
    scan_notifications,
)
from docweave.streaming.arrivals import arrival_stream
from docweave.workspace import shared_folder

CURATED_ARN = "arn:aws:s3:::curated-bucket"
RULES = standard_rules(CURATED_ARN)

# One form of key per rule and per way to fall short; {d} is the document's id.
_KEYS = (
    "data/control/{d}",
    "data/s/t/u/v{d}",
    "data/Zeus/t/a/b/c/e/f{d}",
    "data/TeleMER/t/u/a/b/c/e/f{d}",
    "RDS_src_data_1/s/t/u/v{d}",
    "data/msales/a/MLI_Schema.T/f{d}",
    "data/s/t/SCOPP.TAB__ct/a/f{d}",
    "data/s/t/u/KCAPUAT3.TAB/a/f{d}/g/h",
    "data/s/t/u/dbo.TAB/a/f{d}/g/h",
    "data/s/t/u/RENOVAPRODIND__TAB/a/f{d}/g/h",
    "data/dakshX/t/u/v/f{d}/g/h/i",
    "data/daksh/t/u/KCAPUAT3.T/f{d}/g/h/i",
    "data/s/t/u/v/w/x/y/z{d}",
    "data/s/t/u/dbo.TAB/a/f{d}",
    "data/zeus/t/a/b/c/e/f/g{d}",
    "data/s{d}",
)
# Keys of form 1 arrive from the curated bucket.
_CURATED_FORM = 1


def _form() -> Column:
    return F.pmod(F.col("doc_id"), F.lit(len(_KEYS))).cast("int")


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a notification of two files: its own, and one of its source."""
    forms = F.array(*[F.lit(k) for k in _KEYS])
    key = F.replace(F.get(forms, _form()), F.lit("{d}"), F.col("doc_id").cast("string"))
    bucket = F.when(_form() == _CURATED_FORM, F.lit("curated-bucket")).otherwise(F.lit("raw-bucket"))
    tag = F.concat(F.col("n_chars").cast("string"), F.lit("e5"))

    def record(key: Column, event: str) -> Column:
        return F.struct(
            F.lit("2024-01-01T00:00:00.000Z").alias("eventTime"),
            F.lit(event).alias("eventName"),
            F.struct(F.col("lang").alias("principalId")).alias("userIdentity"),
            F.struct(F.lit("10.0.0.1").alias("sourceIPAddress")).alias("requestParameters"),
            F.struct(
                F.struct(bucket.alias("name"), F.concat(F.lit("arn:aws:s3:::"), bucket).alias("arn")).alias("bucket"),
                F.struct(
                    key.alias("key"),
                    F.col("n_chars").alias("size"),
                    tag.alias("eTag"),
                    F.col("doc_id").cast("string").alias("sequencer"),
                ).alias("object"),
            ).alias("s3"),
        )

    second = F.concat(F.lit("data/Posv/"), "source", F.lit("/b/c/d/e/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(
        F.array(record(key, "Put"), record(second, "Copy")).alias("Records")
    )


def _written_notifications(spark: SparkSession, sf_dir: str) -> str:
    folder = shared_folder(spark, "notifications")
    parts = spark.sparkContext.defaultParallelism
    notifications(spark, sf_dir).repartition(parts).write.json(folder)
    return folder


_FORMS = "[" + ", ".join(f"'{k}'" for k in _KEYS) + "]"
_RECORDS = f"""
forms AS (SELECT {_FORMS} AS f),
records AS (
  SELECT '2024-01-01T00:00:00.000Z' AS "eventTime", "eventName", lang AS "userIdentity",
         '10.0.0.1' AS "sourceIPAddress", bucket AS "bucketName", 'arn:aws:s3:::' || bucket AS "bucketArn",
         key AS "fileName", n_chars AS "fileSize", n_chars || 'e5' AS "fileeTag",
         CAST(doc_id AS VARCHAR) AS sequencer, string_split(key, '/')[2] AS "sourceSystem"
  FROM (
    SELECT *, CASE WHEN doc_id % {len(_KEYS)} = {_CURATED_FORM} THEN 'curated-bucket' ELSE 'raw-bucket' END AS bucket
    FROM (
      SELECT doc_id, lang, n_chars, 'Put' AS "eventName",
             replace(f[doc_id % {len(_KEYS)} + 1], '{{d}}', CAST(doc_id AS VARCHAR)) AS key
      FROM documents, forms
      UNION ALL
      SELECT doc_id, lang, n_chars, 'Copy', 'data/Posv/' || source || '/b/c/d/e/' || doc_id FROM documents
    )
  )
)
"""


@query(
    "bookmark_ledger",
    f"""WITH {_RECORDS}
SELECT *, 'RTDataHub' AS "dataLayer", 'Unprocessed' AS status FROM records
""",
)
def bookmark_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notification files to bookmarks, written as CSV with a header and read back."""
    folder = shared_folder(spark, "bookmarks")
    records = notification_records(scan_notifications(spark, _written_notifications(spark, sf_dir)))
    write_table(bookmarks(records), folder, "csv", options=BOOKMARK_CSV)
    return scan_bookmarks(spark, folder).select(*BOOKMARK.names)


_NAMES = """names(name) AS (VALUES ('BASEATTRIBUTES'), ('ACCOUNTDETAIL'), ('CLIENTPOLICYRELATIONSHIP'),
  ('BASEADDDETAIL'), ('COVERAGEDETAILS'), ('POLICYMESURES'), ('BONUSDETAILS'), ('PARTWITHDRWLDETAILS'),
  ('PAYMENTHISTORYDTLS'), ('LOANDETAIL'), ('CREDITCARDDETAIL'), ('POLICYBASICDETAILS'), ('NOMINEEDETAILS'))"""

_ROUTED = f"""WITH {_RECORDS},
{_NAMES},
layers(layer, payload) AS (VALUES ('rdh', 'RTDataHub'), ('curated', 'Curated'), ('rds', 'RTDataHub')),
bulk(suffix) AS (VALUES (''), ('_1'), ('_2'), ('_3'), ('_4'), ('_5'), ('_6'), ('_COVERAGEDETAILS'),
  ('_POLICYMESURES'), ('_BASEATTRIBUTES'), ('_POLICYBASICDETAILS'), ('_CLIENTPOLICYRELATIONSHIP')),
p AS (
  SELECT *, string_split("fileName", '/') AS x,
         string_split_regex(string_split("fileName", '/')[4], '\\.|__')[2] AS m3,
         string_split_regex(string_split("fileName", '/')[5], '\\.|__')[2] AS m4,
         string_split(string_split("fileName", '/')[4], '.') AS t
  FROM records WHERE NOT contains("fileName", 'control')
),
first AS (
  SELECT *, CASE
    WHEN "bucketArn" = '{CURATED_ARN}' THEN 'R1'
    WHEN x[2] IN ('Zeus', 'Whatsapp', 'Posv', 'NeoProposal', 'mquote') THEN 'R2'
    WHEN lower(x[2]) = 'telemer' THEN 'R3'
    WHEN lower(x[1]) = 'rds_src_data_1' THEN 'R4'
    WHEN starts_with(x[4], 'MLI_Schema') AND x[2] = 'msales' THEN 'R5'
    WHEN starts_with(x[4], 'SCOPP') OR starts_with(x[4], 'SMSUSER') THEN 'R6'
    ELSE 'R7' END AS arm
  FROM p
),
routed AS (
  SELECT first.*, 'R1' AS rule, 'curatedSourceData' AS data_layer, 'Curated' AS "dataLayer",
         x[3] || '/' || x[4] AS tbl, x[5] || '.parquet' AS file FROM first WHERE arm = 'R1'
  UNION ALL SELECT first.*, 'R2', layer, payload, x[3], x[8] || '.csv' FROM first, layers WHERE arm = 'R2'
  UNION ALL SELECT first.*, 'R2', 'rdh', 'RTDataHub', x[3] || '-rider', x[8] || '.csv' FROM first WHERE arm = 'R2'
  UNION ALL SELECT first.*, 'R3', layer, payload, x[3] || '/' || x[4] || '/' || k, x[9] || '.csv'
    FROM first, layers, (VALUES ('base'), ('mdchck')) kinds(k) WHERE arm = 'R3'
  UNION ALL SELECT first.*, 'R4', 'rdh', 'RTDataHub', x[3] || '/' || x[4] || suffix, sequencer || '.csv'
    FROM first, bulk WHERE arm = 'R4'
  UNION ALL SELECT first.*, 'R5', 'qlik/curated', 'Curated', t[1] || '/' || t[2], x[5] || '.csv' FROM first WHERE arm = 'R5'
  UNION ALL SELECT first.*, 'R6', 'qlik/curated', 'Curated', x[3] || '/' || m3, x[6] || '.csv' FROM first WHERE arm = 'R6'
  UNION ALL SELECT first.*, 'R7a', 'qlik/' || layer, payload, x[3] || '/' || m4, x[7] || '.csv'
    FROM first, layers WHERE arm = 'R7' AND (starts_with(x[5], 'KCAPUAT3') OR starts_with(x[5], 'MNYLMIG'))
  UNION ALL SELECT first.*, 'R7a', 'qlik/rdh', 'RTDataHub', x[3] || '/' || m4 || '_' || name, x[7] || '.csv'
    FROM first, names WHERE arm = 'R7' AND (starts_with(x[5], 'KCAPUAT3') OR starts_with(x[5], 'MNYLMIG'))
  UNION ALL SELECT first.*, 'R7b', 'qlik/curated', 'Curated', x[3] || '/' || m4, x[7] || '.csv'
    FROM first WHERE arm = 'R7' AND starts_with(x[5], 'dbo')
  UNION ALL SELECT first.*, 'R7c', 'qlik/curated', 'Curated', x[3] || '/' || m4, x[7] || '.csv'
    FROM first WHERE arm = 'R7' AND (starts_with(x[5], 'SMSUSER') OR starts_with(x[5], 'RENOVAPRODIND'))
  UNION ALL SELECT first.*, 'R7d', 'qlik/curated', 'Curated', '', x[6] || '.csv'
    FROM first WHERE arm = 'R7' AND starts_with(x[2], 'daksh')
  UNION ALL SELECT first.*, 'R7e', 'rdh', 'RTDataHub', x[3] || '/' || x[4] || '_' || name, x[9] || '.csv'
    FROM first, names WHERE arm = 'R7'
  UNION ALL SELECT first.*, 'R7e', layer, payload, x[3] || '/' || x[4], x[9] || '.csv' FROM first, layers WHERE arm = 'R7'
),
keyed AS (
  SELECT *, 'bookmarks/' || data_layer || '/unprocessed/' || x[2]
         || CASE WHEN tbl = '' THEN '' ELSE '/' || tbl END || '/' || file AS "destKey"
  FROM routed
)
"""

_ROUTE_COLUMNS = ["fileName", "sequencer", "dataLayer", "status", "rule", "data_layer", "source", "table", "destKey"]
_ROUTE_SELECT = """
SELECT "fileName", sequencer, "dataLayer", 'Unprocessed' AS status, rule, data_layer, x[2] AS source,
       nullif(tbl, '') AS "table", "destKey"
FROM keyed WHERE "destKey" IS NOT NULL
"""


@query("route_notifications", _ROUTED + _ROUTE_SELECT)
def route_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route(notification_records(notifications(spark, sf_dir)), RULES)
    return destinations(routed).select(*_ROUTE_COLUMNS)


@query(
    "route_short_keys",
    _ROUTED
    + """SELECT "fileName", rule, count(*) AS n, 'short_key' AS reason
FROM keyed WHERE "destKey" IS NULL GROUP BY "fileName", rule""",
)
def route_short_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route(notification_records(notifications(spark, sf_dir)), RULES)
    return (
        quarantined(routed)
        .groupBy("fileName", "rule")
        .agg(F.count("*").alias("n"), F.max("reason").alias("reason"))
    )


@query("load_ledger", _ROUTED + _ROUTE_SELECT)
def load_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bookmarking job: notification files, routed, written as a partitioned ledger, read back."""
    ledger = shared_folder(spark, "ledger")
    bookmark_notifications(spark, _written_notifications(spark, sf_dir), RULES, ledger, 1)
    return read_ledger(spark, ledger).select(*_ROUTE_COLUMNS)


@query("stream_bookmarks", _ROUTED + _ROUTE_SELECT)
def stream_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, checkpoint = shared_folder(spark, "ledger"), shared_folder(spark, "checkpoint")
    parts = spark.sparkContext.defaultParallelism
    files = _written_notifications(spark, sf_dir)
    arrival_stream(spark, files, RULES, ledger, checkpoint, max_files=max(1, parts // 2)).awaitTermination()
    return read_ledger(spark, ledger).select(*_ROUTE_COLUMNS)


@query(
    "bookmark_files",
    _ROUTED
    + """SELECT "fileName", "fileeTag", "fileSize", "dataLayer", count(*) AS n
FROM keyed WHERE "destKey" IS NOT NULL GROUP BY ALL""",
)
def bookmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks as CSV files, one folder per queue, read back as one table."""
    folder = shared_folder(spark, "bookmarks")
    write_bookmark_files(destinations(route(notification_records(notifications(spark, sf_dir)), RULES)), folder)
    return (
        scan_bookmarks(spark, folder)
        .groupBy("fileName", "fileeTag", "fileSize", "dataLayer")
        .agg(F.count("*").alias("n"))
    )


_ARRIVED_SQL = "SELECT doc_id, source AS \"bucketName\", lang || '/' || doc_id || '.csv' AS \"fileName\" FROM documents"


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("bucketName"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("fileName"),
    )


@query(
    "pending_files",
    "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pending(arrived, table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "ledger_transition",
    """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'Processed' ELSE 'Unprocessed' END AS status FROM documents
""",
)
def ledger_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of the ledger is marked as done; what is pending is the rest."""
    path = shared_folder(spark, "processed")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("Unprocessed").alias("status"))
    write_table(processed(documents.where("lang = 'en'")), path)
    done = spark.read.schema(documents.schema).parquet(path)
    waiting = pending(documents, done, ["doc_id"])
    return waiting.unionByName(done).select("doc_id", "status")


@query(
    "first_n_files",
    """SELECT page_id, url FROM pages WHERE contains(url, '.example.') ORDER BY url, page_id LIMIT 100""",
)
def first_n_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 in path order."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.struct("url", "page_id").alias("path"))
    return first_n_files(pages.where(F.col("url").contains(".example.")), "path", 100).select("page_id", "url")


@query(
    "list_input_files",
    """SELECT lang, source, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS bytes
FROM documents GROUP BY lang, source""",
)
def list_input_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found below a folder that is partitioned by language and source."""
    folder = shared_folder(spark, "files")
    write_table(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source"),
        folder,
        "csv",
        partition_by=["lang", "source"],
    )
    parts = F.split("path", "/")
    return (
        list_input_files(spark, folder, contains=".csv")
        .select(
            F.replace(F.element_at(parts, -3), F.lit("lang="), F.lit("")).alias("lang"),
            F.replace(F.element_at(parts, -2), F.lit("source="), F.lit("")).alias("source"),
            "length",
        )
        .groupBy("lang", "source")
        .agg(F.sum("length").alias("bytes"))
    )


@query(
    "batch_slices",
    f"""
SELECT doc_id, CAST((row_number() OVER (ORDER BY "fileName") - 1) // 100 AS BIGINT) AS slice_id FROM ({_ARRIVED_SQL})
""",
)
def batch_slices_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_slices(_arrived(spark, sf_dir), ["fileName"], 100).select("doc_id", "slice_id")


@query(
    "numbered_rows",
    """
SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) AS n FROM events
""",
)
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number for every row in a given order, where one order value covers many rows."""
    events = table(spark, sf_dir, "events").select("event_type", "event_id")
    return numbered(events, ["event_type", "event_id"], "n").select("event_id", "n")


@query(
    "collect_paths",
    f"""
SELECT slice_id, string_agg(path, ',' ORDER BY path) AS paths FROM (
  SELECT 's3://' || concat_ws('/', "bucketName", "fileName") AS path,
         (row_number() OVER (ORDER BY 's3://' || concat_ws('/', "bucketName", "fileName")) - 1) // 100 AS slice_id
  FROM ({_ARRIVED_SQL})) GROUP BY slice_id
""",
)
def collect_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the raw files, as one list per slice of 100 files."""
    files = with_file_path(_arrived(spark, sf_dir))
    slices = batch_slices(files, ["filePath"], 100)
    return slice_paths(slices, F.col("filePath")).select("slice_id", F.array_join("paths", ",").alias("paths"))


_OUTCOMES = """
outcomes AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 THEN 'unparsed' ELSE lang END AS outcome FROM documents)
SELECT id, outcome FROM outcomes
UNION ALL SELECT DISTINCT source || '/none.txt', 'gone' FROM documents
UNION ALL SELECT 'audit', 'Completed ' || (SELECT count(*) FROM outcomes WHERE outcome <> 'unparsed')
UNION ALL SELECT 'third run', '0'
UNION ALL SELECT 'keys', 'shared'
"""


def _ingested(spark: SparkSession, sf_dir: str, through_csv: bool) -> DataFrame:
    """Feed files by language and source, notified, routed, and loaded in slices by two runs; a third finds nothing.

    Files of one task have one name in all their folders, and the rule makes keys of the names alone, so many
    files share a key. The first run sees one language; all files of it are notified again before the second.
    """
    names = ("raw", "notes", "ledger", "csv", "done", "table", "bad", "audit")
    raw, notes, ledger, csv, done, out, bad, audit = (shared_folder(spark, name) for name in names)
    key = F.col("doc_id").cast("string")

    def tagged(value: Column, name: str) -> Column:
        return F.struct(value.alias("S")).alias(name)

    change = F.struct(key.alias("SequenceNumber"), F.struct(tagged(key, "leadId"), tagged(F.col("lang"), "v")).alias("NewImage"))
    record = F.struct(F.lit("INSERT").alias("eventName"), change.alias("dynamodb"))
    line = F.to_json(F.struct(F.array(record).alias("Records")))
    broken = F.concat(F.lit('{"Records":[{"eventName":"INSERT","dynamodb":{"SequenceNumber":"'), key, F.lit('"'))
    documents = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, broken).otherwise(line).alias("value")
    write_table(documents.select(text, "lang", "source"), f"{raw}/data/we[b]", "text", partition_by=["lang", "source"])

    path = F.regexp_replace("path", "^file:/*", "/")
    place = F.substring(path, F.lit(len(raw.removeprefix("file://")) + 2), F.length(path))
    files = list_input_files(spark, raw, contains="lang=").select(place.alias("key"), "length")
    gone = F.concat(F.lit("data/we[b]/lang=none/"), "source", F.lit("/none.txt"))
    files = files.union(documents.select("source").distinct().select(gone, F.lit(0).cast("bigint")))
    bucket = F.struct(F.lit(raw.removeprefix("file://")).alias("name"), F.lit("arn").alias("arn"))

    def notify(some: DataFrame, time: str, folder: str) -> None:
        thing = F.struct("key", F.col("length").alias("size"), F.lit("tag").alias("eTag"), F.lit("1").alias("sequencer"))
        s3 = F.struct(bucket.alias("bucket"), thing.alias("object"))
        record = F.struct(F.lit(time).alias("eventTime"), F.lit("Put").alias("eventName"), s3.alias("s3"))
        some.select(F.array(record).alias("Records")).write.json(f"{notes}/{folder}")

    first = F.col("key").contains("lang=en")
    rules = [Rule("web", True, (Condition("x1", "eq", ("we[b]",)),), (Destination("rdh", "leads", "{x4}.csv", "RTDataHub"),))]
    notify(files.where(first), "1", "1")
    notify(files, "2", "2")

    def queue(batch: int) -> DataFrame:
        bookmark_notifications(spark, f"{notes}/{batch}", rules, ledger, batch)
        rows = read_ledger(spark, ledger).where("data_layer = 'rdh' AND source = 'we[b]' AND table = 'leads'")
        if not through_csv:
            return rows
        write_table(rows.select(*BOOKMARK.names), f"{csv}/{batch}", "csv", options=BOOKMARK_CSV)
        return scan_bookmarks(spark, csv)

    log = AuditLog(audit, 1, "web", "leads")
    slices = max(2, files.count() // 3)
    load = {"slice_size": slices, "scheme": "file", "multiline": False}
    runs = [ingest_pending(spark, queue(batch), done, out, bad, audit=log, **load) for batch in (1, 2)]
    assert all(runs) and sum(runs) > 2
    third = ingest_pending(spark, queue(2) if not through_csv else scan_bookmarks(spark, csv), done, out, bad, audit=log, **load)
    noted = read_or_empty(spark, done, DONE)
    assert noted.count() == noted.distinct().count() == files.count()
    loaded = read_current(spark, out, ["leadId"], "Sequence_No").select(F.col("leadId").alias("id"), F.col("v").alias("outcome"))
    raw_key = F.regexp_extract("raw", r'SequenceNumber":"(\d+)', 1)
    raw_key = F.when(F.col("reason") == "gone", F.regexp_extract("raw", "lang=none/(.*)", 1)).otherwise(raw_key)
    lost = read_quarantine(spark, bad).select(raw_key.alias("id"), F.col("reason").alias("outcome"))
    keys = read_ledger(spark, ledger).agg(F.count_distinct("destKey").alias("k"), F.count_distinct("fileName").alias("f"))
    facts = [("third run", str(third)), ("keys", "shared" if keys.where("k < f").count() else "apart")]
    states = spark.read.parquet(audit).where("status = 'Completed'").count()
    assert states == 1 and read_audit(spark, audit).count() == 1
    return loaded.union(lost).union(_total(spark, audit, out)).union(spark.createDataFrame(facts, "id string, outcome string"))


def _total(spark: SparkSession, audit: str, out: str) -> DataFrame:
    """The state of the last run, and how many documents all runs have loaded."""
    count = F.lit(read_current(spark, out, ["leadId"], "Sequence_No").count()).cast("string")
    return read_audit(spark, audit).select(F.lit("audit").alias("id"), F.concat("status", F.lit(" "), count).alias("outcome"))


@query("ingest_pending_job", "WITH" + _OUTCOMES)
def ingest_pending_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications to ledger to table, see :func:`_ingested`."""
    return _ingested(spark, sf_dir, through_csv=False)


@query("ingest_bookmark_files", "WITH" + _OUTCOMES)
def ingest_bookmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the queue read from bookmark CSV files."""
    return _ingested(spark, sf_dir, through_csv=True)

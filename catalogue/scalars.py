"""Text, names, clocks and stringification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.registry import query, table
from docweave.functions import clock, text
from docweave.functions.names import sanitise_names, strip_first_segments
from docweave.functions.stringify import fill_blank, json_rows, stringify


@query(
    "stringify",
    """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS ts,
       CASE WHEN event_type = 'click' THEN 'True' WHEN event_type = 'view' THEN '' ELSE 'False' END AS clicked,
       CAST(value AS VARCHAR) AS value, CAST(value * 1e15 AS VARCHAR) AS big, CAST(value / 1e7 AS VARCHAR) AS small,
       '["' || event_type || '",null]' AS kinds, props
FROM events
""",
)
def stringify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").select(
        "event_id",
        clock.epoch_millis(F.col("ts")).alias("ts"),
        F.when(kind != "view", kind == "click").alias("clicked"),
        "value",
        (F.col("value") * 1e15).alias("big"),
        (F.col("value") / 1e7).alias("small"),
        F.array(kind, F.lit(None)).alias("kinds"),
        "props",
    )
    return stringify(events)


@query(
    "json_roundtrip",
    """
SELECT '{"event_id":' || event_id || ',"ts":' || (epoch_us(ts) // 1000) || ',"event_type":"' || event_type
       || '","value":' || CAST(value AS VARCHAR) || ',"third":' || CAST(CAST(printf('%.10f', value / 3) AS DOUBLE) AS VARCHAR)
       || ',"none":null}' AS json
FROM events
""",
)
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_rows(
        table(spark, sf_dir, "events").select(
            "event_id",
            "ts",
            "event_type",
            "value",
            (F.col("value") / 3).alias("third"),
            F.lit(None).cast("string").alias("none"),
        )
    )


@query(
    "fill_blank",
    """
SELECT l.l_orderkey, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS flag, l_linestatus AS status
FROM lineitem l
""",
)
def fill_blank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return fill_blank(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", F.when(flag != "R", flag).alias("flag"), F.col("l_linestatus").alias("status")
        )
    )


@query(
    "sanitise_names",
    """
SELECT c_custkey AS customer_key, c_name AS customer_name, c_nationkey AS customer_name_2, c_acctbal AS balance
FROM customer
""",
)
def sanitise_names_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer.key"),
        F.col("c_name").alias("customer.name"),
        F.col("c_nationkey").alias("customer_name"),
        F.col("c_acctbal").alias("balance"),
    )
    return sanitise_names(dotted, on_collision="suffix")


@query(
    "strip_first_segment",
    "SELECT p_partkey AS key, p_name AS text_name, p_size AS text_size_cm FROM part",
)
def strip_first_segment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_first_segments(
        table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("part.key"),
            F.col("p_name").alias("part.text.name"),
            F.col("p_size").alias("part.text.size.cm"),
        )
    )


@query(
    "regex_table_name",
    r"""
SELECT doc_id, string_split_regex(file, '\.|__')[2] AS regex_name,
       string_split(file, '.')[1] AS schema_name, string_split(file, '.')[2] AS table_name,
       string_split_regex(file, '\.|__')[4] AS beyond
FROM (SELECT doc_id, lang || '.' || source || '__' || doc_id AS file FROM documents)
""",
)
def regex_table_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat("lang", F.lit("."), "source", F.lit("__"), "doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.regex_part(file, 1).alias("regex_name"),
        text.dot_part(file, 0).alias("schema_name"),
        text.dot_part(file, 1).alias("table_name"),
        text.regex_part(file, 3).alias("beyond"),
    )


@query(
    "path_parts",
    """
SELECT page_id, string_split(url, '/')[1] AS scheme, string_split(url, '/')[3] AS bucket,
       array_to_string(string_split(url, '/')[4:], '/') AS prefix,
       string_split(url, '/')[-1] AS file, string_split(url, '/')[6] AS sixth
FROM pages
""",
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.segment(url, 0).alias("scheme"),
        text.uri_bucket(url).alias("bucket"),
        text.uri_prefix(url).alias("prefix"),
        text.basename(url).alias("file"),
        text.segment(url, 5).alias("sixth"),
    )


@query(
    "concat_skip_null",
    """
SELECT doc_id, 's3://' || concat_ws('/', CASE WHEN lang <> 'en' THEN lang END, source, doc_id) AS path
FROM documents
""",
)
def concat_skip_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("lang") != "en", F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.object_uri(bucket, F.concat_ws("/", "source", "doc_id")).alias("path")
    )


@query(
    "char_count",
    "SELECT doc_id, CAST(length(text) - length(replace(text, 'e', '')) AS INTEGER) AS n_e FROM documents",
)
def char_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.char_count(F.col("text"), "e").alias("n_e"))


@query(
    "time_formats",
    """
SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y%m%d%H%M%S%f') AS load_clock,
       strftime(ts, '%Y%m%d%H%M%S') AS sequence_clock,
       CAST(floor(epoch(ts)) AS BIGINT) AS epoch_seconds,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS start_clock
FROM events
""",
)
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        clock.load_clock(ts).alias("load_clock"),
        clock.sequence_clock(ts).alias("sequence_clock"),
        clock.epoch_seconds(ts).alias("epoch_seconds"),
        clock.start_clock(ts).alias("start_clock"),
    )


@query(
    "blank_to_default",
    """
SELECT event_id, CASE event_type WHEN 'view' THEN '0' WHEN 'click' THEN '0' WHEN 'error' THEN '0'
       ELSE event_type END AS kind
FROM events
""",
)
def blank_to_default_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    gaps = F.when(kind == "view", "").when(kind == "click", " ").when(kind == "error", None).otherwise(kind)
    return table(spark, sf_dir, "events").select("event_id", text.blank_to_default(gaps).alias("kind"))

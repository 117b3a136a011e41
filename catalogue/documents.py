"""Flattening, unwrapping and path/value queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue.registry import query, table
from docweave.functions.typed_json import unwrap_typed
from docweave.operators.conform import conform, union_files
from docweave.operators.flatten import flatten_document, flatten_struct
from docweave.operators.path_values import json_path_value_rows, not_json, path_value_rows
from docweave.plans.jobs import load_changes, load_snapshot, snapshot_rows
from docweave.schemas import feed_schema
from docweave.sinks.tables import compact, read_changes, read_current, read_quarantine
from docweave.sources.documents import scan_change_feed, scan_snapshot
from docweave.sources.files import target_columns
from docweave.streaming.changes import feed_stream
from docweave.workspace import shared_folder


def _item(kind: str, value: Column, kind_name: str, value_name: str) -> Column:
    return F.struct(F.lit(kind).alias(kind_name), value.alias(value_name))


def line_documents(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    """Each lineitem as one document with a list of amounts and a list of partners.

    Amounts of zero are left out, and returned lines have no partners, so that lists have
    0 to 3 items.  The lists come from the row itself; nothing is grouped.
    """
    amounts = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.struct(F.col(f"l_{kind}").alias("amount")).alias("value"))
            for kind in ("extendedprice", "discount", "tax")
        ]
    )
    partners = F.array(
        _item("part", F.col("l_partkey"), "role", "id"), _item("supplier", F.col("l_suppkey"), "role", "id")
    )
    return table(spark, sf_dir, "lineitem").select(
        key.alias("leadId"),
        F.col("l_linenumber").alias("sequence"),
        F.struct(
            F.col("l_returnflag").alias("flag"),
            (F.col("l_linestatus") == "O").alias("open"),
            F.col("l_quantity").alias("quantity"),
        ).alias("status"),
        F.struct(
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
            F.when(F.col("l_returnflag") != "R", partners).alias("partyList"),
        ).alias("personalDetails"),
        F.filter(amounts, lambda a: a["value"]["amount"] > 0).alias("products"),
    )


# The flat columns of a line document, its amounts and its partners.
_LINE_SQL = """
WITH docs AS (
  SELECT *, row_number() OVER () AS rid, {key} AS k FROM lineitem
), base AS (
  SELECT rid, k, coalesce(k, '') AS "leadId",
         l_returnflag AS status_flag,
         CASE WHEN l_linestatus = 'O' THEN 'True' ELSE 'False' END AS status_open,
         CAST(l_quantity AS VARCHAR) AS status_quantity,
         strftime(l_shipdate, '%Y-%m-%d') AS "personalDetails_shipped"
  FROM docs
), party AS (
  SELECT rid, k, 'part' AS role, CAST(l_partkey AS VARCHAR) AS id FROM docs WHERE l_returnflag <> 'R'
  UNION ALL
  SELECT rid, k, 'supplier', CAST(l_suppkey AS VARCHAR) FROM docs WHERE l_returnflag <> 'R'
), product AS (
  SELECT rid, k, 'extendedprice' AS kind, CAST(l_extendedprice AS VARCHAR) AS amount
  FROM docs WHERE l_extendedprice > 0
  UNION ALL SELECT rid, k, 'discount', CAST(l_discount AS VARCHAR) FROM docs WHERE l_discount > 0
  UNION ALL SELECT rid, k, 'tax', CAST(l_tax AS VARCHAR) FROM docs WHERE l_tax > 0
)
SELECT "leadId", status_flag, status_open, status_quantity, "personalDetails_shipped",
       coalesce(party.role, '') AS "personalDetails_partyList_role",
       coalesce(party.id, '') AS "personalDetails_partyList_id",
       coalesce(product.kind, '') AS products_kind,
       coalesce(product.amount, '') AS products_value_amount
FROM base LEFT JOIN party ON {party_match} LEFT JOIN product ON {product_match}
"""


@query(
    "flatten_version_scope",
    _LINE_SQL.format(
        key="CAST(l_orderkey AS VARCHAR)", party_match="base.rid = party.rid", product_match="base.rid = product.rid"
    ),
)
def flatten_version_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_document(line_documents(spark, sf_dir, F.col("l_orderkey")), drop=["sequence"])


# Order and line number of a line, the key of its versions; that of all lines of the first
# order is NULL, so that NULL keys have to meet.
_LINE_KEY = "concat(nullif(l_orderkey, 0), '-', l_linenumber)"


@query(
    "flatten_key_scope",
    _LINE_SQL.format(
        key="nullif(l_orderkey, 0) || '-' || l_linenumber",
        party_match="base.k IS NOT DISTINCT FROM party.k",
        product_match="base.k IS NOT DISTINCT FROM product.k",
    ),
)
def flatten_key_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_document(line_documents(spark, sf_dir, F.expr(_LINE_KEY)), drop=["sequence"], scope="key")


@query(
    "explode_text_lines",
    """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
)
SELECT CAST(d.doc_id AS VARCHAR) AS "leadId", lang AS origin_lang, source AS origin_source,
       line AS products_0
FROM documents d JOIN lines l ON d.doc_id = l.doc_id
""",
)
def explode_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of plain values: one row per line of the whole text."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("leadId"),
        F.struct(F.col("lang"), F.col("source")).alias("origin"),
        F.split("text", "\n").alias("products"),
    )
    return flatten_document(documents)


def order_documents(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("leadId"),
        F.lit(1).alias("sequence"),
        F.struct(
            F.struct(F.col("o_custkey").alias("key")).alias("customer"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderdate").alias("date"),
        ).alias("order"),
        F.col("o_totalprice").alias("total"),
        (F.col("o_totalprice") / 3).alias("third"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("money"),
        F.col("o_orderpriority").alias("priority.text"),
    )


_ORDER_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS "leadId",
       CAST(o_custkey AS VARCHAR) AS order_customer_key,
       o_orderstatus AS order_status,
       CAST(epoch_ms(o_orderdate) AS VARCHAR) AS order_date,
       CAST(o_totalprice AS VARCHAR) AS total,
       CAST(CAST(printf('%.10f', o_totalprice / 3) AS DOUBLE) AS VARCHAR) AS third,
       CAST(o_totalprice AS VARCHAR) AS money,
       o_orderpriority AS priority_text,
       '20240101000000' AS "Sequence_No"
FROM orders
"""


@query("snapshot_flatten", _ORDER_SQL)
def snapshot_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_rows(order_documents(scan_snapshot(spark, f"{sf_dir}/orders.parquet")), "20240101000000")


@query("load_snapshot", _ORDER_SQL)
def load_snapshot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole full-load job: documents in parquet, read, flattened, written, read back."""
    files, out = shared_folder(spark, "snapshot"), shared_folder(spark, "table")
    order_documents(table(spark, sf_dir, "orders")).write.parquet(files)
    load_snapshot(spark, files, out, "20240101000000")
    return spark.read.parquet(out)


@query(
    "flatten_struct",
    """
SELECT event_id AS id, user_id AS who_user_id, event_type AS what_kind_type, value AS what_kind_value
FROM events
""",
)
def flatten_struct_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.struct(F.col("event_type").alias("type"), F.col("value"))
    return flatten_struct(
        table(spark, sf_dir, "events").select(
            F.col("event_id").alias("id"), F.struct("user_id").alias("who"), F.struct(kind.alias("kind")).alias("what")
        )
    )


def typed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as change-feed documents of typed JSON.

    ``state`` is a boolean for finished orders and text for others; ``notes`` is a list
    that mixes numbers and text; ``party`` nests a map in a list in a map.
    """

    def tag(name: str, value: Column) -> Column:
        return F.struct(value.cast("string").alias(name))

    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    finished = F.col("o_orderstatus") == "F"
    words = F.split("o_orderpriority", "-")
    image = F.struct(
        tag("N", key).alias("leadId"),
        tag("N", price).alias("total"),
        F.struct(F.when(finished, True).alias("BOOL"), F.when(~finished, F.col("o_orderstatus")).alias("S")).alias(
            "state"
        ),
        F.struct(F.lit(True).alias("NULL")).alias("nothing"),
        F.struct(words.alias("SS")).alias("words"),
        F.struct(
            F.array(
                F.struct(price.cast("string").alias("N"), F.lit(None).cast("string").alias("S")),
                F.struct(F.lit(None).cast("string").alias("N"), F.col("o_orderpriority").alias("S")),
            ).alias("L")
        ).alias("notes"),
        F.struct(
            F.struct(
                F.struct(
                    F.array(
                        F.struct(F.struct(tag("N", F.col("o_custkey")).alias("cust")).alias("M")),
                    ).alias("L")
                ).alias("partyList"),
                tag("S", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
            ).alias("M")
        ).alias("personalDetails"),
    )
    record = F.struct(
        F.lit("INSERT").alias("eventName"),
        F.struct(key.cast("string").alias("SequenceNumber"), image.alias("NewImage")).alias("dynamodb"),
    )
    return table(spark, sf_dir, "orders").select(F.array(record).alias("Records"))


def _written_feed(spark: SparkSession, feed: DataFrame) -> tuple[str, object]:
    folder = shared_folder(spark, "feed")
    feed.write.json(folder)
    return folder, feed.schema


@query(
    "unwrap_typed_json",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS "Sequence_No", 'I' AS change_type,
       CAST(o_orderkey AS VARCHAR) AS "leadId",
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total,
       CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE o_orderstatus END AS state,
       CAST(NULL AS VARCHAR) AS nothing,
       string_split(o_orderpriority, '-')[1] AS first_word,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '|' || o_orderpriority AS notes,
       CAST(o_custkey AS VARCHAR) AS cust,
       strftime(o_orderdate, '%Y-%m-%d') AS date
FROM orders
""",
)
def unwrap_typed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, schema = _written_feed(spark, typed_orders(spark, sf_dir))
    records = scan_change_feed(spark, folder, schema, multiline=False)
    plain = unwrap_typed(records, "image", expand=True)
    return plain.select(
        "Sequence_No",
        "change_type",
        "leadId",
        "total",
        "state",
        "nothing",
        F.element_at("words", 1).alias("first_word"),
        F.array_join("notes", "|").alias("notes"),
        F.element_at("personalDetails.partyList", 1)["cust"].alias("cust"),
        F.col("personalDetails.date").alias("date"),
    )


_LOADED_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS "leadId",
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total,
       CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE o_orderstatus END AS state,
       '' AS nothing,
       '["' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '","' || o_orderpriority || '"]' AS notes,
       strftime(o_orderdate, '%Y-%m-%d') AS "personalDetails_date",
       CAST(o_custkey AS VARCHAR) AS "personalDetails_partyList_cust",
       CAST(o_orderkey AS VARCHAR) AS "Sequence_No"{more}
FROM orders
"""
_LOADED = [
    "leadId",
    "total",
    "state",
    "nothing",
    "notes",
    "personalDetails_date",
    "personalDetails_partyList_cust",
    "Sequence_No",
]


@query("load_changes", _LOADED_SQL.format(more=", '' AS older_column"))
def load_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole incremental job: feed files, unwrapped, flattened, conformed, written, read back."""
    folder, schema = _written_feed(spark, typed_orders(spark, sf_dir))
    out, quarantine = shared_folder(spark, "changes"), shared_folder(spark, "quarantine")
    load_changes(spark, folder, out, quarantine, 1, schema, columns=["leadId", "older_column"], multiline=False)
    return read_changes(spark, out).select(*_LOADED, "older_column")


@query("stream_typed_feed", _LOADED_SQL.format(more=""))
def stream_typed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same job as a stream of feed files, in several micro-batches that each find their schema."""
    parts = spark.sparkContext.defaultParallelism
    folder, _ = _written_feed(spark, typed_orders(spark, sf_dir).repartition(parts))
    out, quarantine, checkpoint = (shared_folder(spark, name) for name in ("changes", "quarantine", "checkpoint"))
    feed_stream(
        spark, folder, out, quarantine, checkpoint, max_files=max(1, parts // 2), multiline=False
    ).awaitTermination()
    return read_changes(spark, out).select(_LOADED)


@query(
    "path_value_rows",
    """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents
)
SELECT doc_id, '.meta.lang' AS path, lang AS value FROM documents
UNION ALL SELECT doc_id, '.meta.origin.source', source FROM documents
UNION ALL SELECT doc_id, '.meta.origin.none', NULL FROM documents
UNION ALL SELECT doc_id, '.n_chars', CAST(n_chars AS VARCHAR) FROM documents
UNION ALL SELECT doc_id, '.lines.' || i || '.text', line FROM lines
UNION ALL SELECT doc_id, '.lines.' || i || '.blank', CASE WHEN line = '' THEN 'True' ELSE 'False' END FROM lines
""",
)
def path_value_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.struct(
            F.col("lang"), F.struct(F.col("source"), F.lit(None).cast("string").alias("none")).alias("origin")
        ).alias("meta"),
        "n_chars",
        F.transform(
            F.split("text", "\n"), lambda line: F.struct(line.alias("text"), (line == "").alias("blank"))
        ).alias("lines"),
        F.array().cast("array<string>").alias("empty"),
    )
    return path_value_rows(documents, ["doc_id"], ["meta", "n_chars", "lines", "empty"])


@query(
    "json_path_value_rows",
    """
WITH lines AS (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM conversations
)
SELECT conv_id, turn, '.role' AS path, role AS value FROM conversations
UNION ALL SELECT conv_id, turn, '.said.lines.' || i, line FROM lines
UNION ALL SELECT conv_id, turn, '.said.first', CASE WHEN turn = 0 THEN 'True' ELSE 'False' END FROM conversations
UNION ALL SELECT conv_id, turn, '.said.turn', CAST(turn AS VARCHAR) FROM conversations
UNION ALL SELECT conv_id, turn, '.said.none', NULL FROM conversations
""",
)
def json_path_value_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text of any shape; the nesting is found from the text."""
    said = F.struct(
        F.split("text", "\n").alias("lines"),
        (F.col("turn") == 0).alias("first"),
        F.col("turn"),
        F.lit(None).cast("string").alias("none"),
        F.array().cast("array<string>").alias("empty"),
    )
    doc = F.to_json(F.struct(F.col("role"), said.alias("said")), {"ignoreNullFields": "false"})
    return json_path_value_rows(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", doc.alias("doc")), ["conv_id", "turn"], "doc"
    )


@query(
    "conform_columns",
    """
SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey,
       '' AS c_acctbal, '' AS c_custkey, '' AS c_mktsegment, '' AS c_name, '' AS c_nationkey
FROM supplier
""",
)
def conform_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("s_suppkey"),
        "s_name",
        F.col("s_nationkey").cast("string").alias("s_nationkey"),
    )
    return conform(batch, target_columns(spark, f"{sf_dir}/customer.parquet"))


@query(
    "union_files",
    """
SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, NULL AS account FROM customer
UNION ALL
SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier
""",
)
def union_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("account"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")
    )
    return union_files([customers, suppliers])


# How an order arrives in the feed, by the remainder of its key.
_ARRIVES = {0: "loaded", 1: "loaded", 2: "deleted", 3: "no_key", 4: "no_image", 5: "not_a_list", 6: "uncovered", 7: "uncovered",
            8: "unparsed", 9: "unparsed", 10: "no_key", 11: "no_key", 12: "no_key", 13: "no_sequence", 14: "no_sequence",
            15: "uncovered", 16: "loaded"}


@query(
    "feed_rejects",
    f"""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
       CASE o_orderkey % {len(_ARRIVES)} {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _ARRIVES.items())} END AS outcome
FROM orders
""",
)
def feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order in one of many forms, most of them broken; each one is loaded, a removal, or in the quarantine with its reason."""
    key = F.col("o_orderkey").cast("string")

    def line(event: str, change: str, sequence: str | None = '"9"') -> Column:
        number = "" if sequence is None else f'"SequenceNumber":{sequence},'
        start = f'{{"Records":[{{"eventName":"{event}","dynamodb":{{{number}"Keys":{{"k":{{"S":"k-'
        return F.concat(F.lit(start), key, F.lit('"}' + change))

    def lead(more: str = "", key: str = '"leadId":{"S":"lead"},') -> str:
        return '},"NewImage":{' + key + '"id":{"S":"k-@"}' + more + "}}}]}"

    def filled(form: Column) -> Column:
        return F.replace(form, F.lit("@"), key)

    forms = [
        line("INSERT", lead(',"v":{"S":"x"}')),
        line("MODIFY", lead(',"products":{"L":[{"M":{"n":{"S":"p"}}}]}')),
        line("REMOVE", ',"leadId":{"S":"k-@"}}}}]}'),
        line("REMOVE", "}}}]}"),
        line("INSERT", "}}}]}"),
        line("INSERT", lead(',"products":{"S":"none"}')),
        line("INSERT", lead(',"extra":{"S":"x"}')),
        line("INSERT", lead(',"v":{"N":"5"}')),
        F.concat(F.lit('{"Records":[{"eventName":"INSERT","k-'), key),
        F.concat(F.lit('{"Records":[{"eventName":"k-'), key, F.lit('","dynamodb":5}]}')),
        line("INSERT", lead(key="")),
        line("INSERT", lead(key='"leadId":null,')),
        line("MODIFY", lead(key='"leadId":{"S":""},')),
        line("INSERT", lead(), None),
        line("REMOVE", ',"leadId":{"S":"k-@"}}}}]}', '" "'),
        line("INSERT", lead(',"v":{"S":"a\\\\\\":b"},"extra\\\\":{"S":"x"}')),
        line("INSERT", lead(',"v":{"S":"a\\\\\\":{\\"b\\":1}"},"products":null')),
    ]
    chosen = filled(F.get(F.array(*forms), (F.col("o_orderkey") % len(forms)).cast("int")))
    folder, out, quarantine = (shared_folder(spark, name) for name in ("feed", "changes", "quarantine"))
    table(spark, sf_dir, "orders").select(chosen.alias("value")).write.text(folder)
    text = "struct<S:string>"
    image = T.StructType.fromDDL(f"leadId {text}, id {text}, v {text}, products struct<L:array<struct<M:struct<n:{text}>>>, S:string>")
    schema = feed_schema(image, T.StructType.fromDDL(f"k {text}, leadId {text}"))
    load_changes(spark, folder, out, quarantine, 1, schema, multiline=False)
    outcome = F.when(F.col("_deleted"), "deleted").otherwise("loaded")
    kept = read_changes(spark, out).select(F.when(F.col("_deleted"), F.col("leadId")).otherwise(F.col("id")).alias("text"), outcome.alias("outcome"))
    lost = read_quarantine(spark, quarantine).select(F.col("raw").alias("text"), F.col("reason").alias("outcome"))
    return kept.union(lost).select(F.regexp_extract("text", r"k-(\d+)", 1).alias("o_orderkey"), "outcome")


@query(
    "current_documents",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS "leadId", unnest(items) AS products_n, sequence AS "Sequence_No" FROM (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 3 = 0 THEN [o_orderstatus, o_orderpriority, o_orderstatus]
              ELSE string_split(o_orderpriority, '-') END AS items,
         CASE WHEN o_orderkey % 3 = 0 THEN '20' ELSE '9' END AS sequence
  FROM orders WHERE o_orderkey % 5 <> 0)
""",
)
def current_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with several products in batches out of order, one of them twice and one again under another number."""

    def feed(event: str, sequence: int, items: Column | None, orders: DataFrame) -> str:
        key = F.struct(F.col("o_orderkey").cast("string").alias("S")).alias("leadId")
        change = [F.lit(str(sequence)).alias("SequenceNumber"), F.struct(key).alias("Keys")]
        if items is not None:
            product = F.transform(items, lambda i: F.struct(F.struct(F.struct(i.alias("S")).alias("n")).alias("M")))
            change.append(F.struct(key, F.struct(product.alias("L")).alias("products")).alias("NewImage"))
        record = F.struct(F.lit(event).alias("eventName"), F.struct(*change).alias("dynamodb"))
        return _written_feed(spark, orders.select(F.array(record).alias("Records")))[0]

    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    first = feed("INSERT", 9, F.split("o_orderpriority", "-"), orders)
    later = feed("MODIFY", 20, F.array("o_orderstatus", "o_orderpriority", "o_orderstatus"), orders.where(key % 3 == 0))
    gone = feed("REMOVE", 100, None, orders.where(key % 5 == 0))
    out, smaller, quarantine = (shared_folder(spark, name) for name in ("changes", "changes", "quarantine"))
    columns: list[str] = []
    for number, files in ((1, [later, gone]), (2, [first]), (2, [first]), (3, [later])):
        columns = load_changes(spark, files, out, quarantine, number, columns=columns, multiline=False).columns
    compact(spark, out, smaller, ["leadId"], "Sequence_No")
    return read_current(spark, smaller, ["leadId"], "Sequence_No", deletes="_deleted").select("leadId", "products_n", "Sequence_No")


# Lines of a compressed feed file: about 4 MB of text, which is what Spark takes for the opening of a file when it deals files to
# tasks. So a task gets about as much text as it would of plain files, which unlike these can be split.
_FEED_LINES = 10_000


def _lead_records(orders: DataFrame, event: str, sequence: Column, items: Column | None = None, **more: Column) -> DataFrame:
    """One record for each row: its key, and a document with products and other attributes, or none."""

    def text(value: Column) -> Column:
        return F.struct(value.alias("S"))

    key = text(F.col("o_orderkey").cast("string")).alias("leadId")
    change = [sequence.cast("string").alias("SequenceNumber"), F.struct(key).alias("Keys")]
    if items is not None:
        products = F.transform(items, lambda i: F.struct(F.struct(text(i).alias("n")).alias("M")))
        others = [text(value).alias(name) for name, value in more.items()]
        change.append(F.struct(key, F.struct(products.alias("L")).alias("products"), *others).alias("NewImage"))
    return orders.select(F.struct(F.lit(event).alias("eventName"), F.struct(*change).alias("dynamodb")).alias("record"))


_CURRENT_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS "leadId", CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS v,
       unnest(CASE WHEN o_orderkey % 3 = 0 THEN [o_orderstatus, o_orderpriority, o_orderstatus] ELSE [o_orderpriority] END) AS products_n,
       CASE WHEN o_orderkey % 3 = 0 THEN '100000000000000000000' ELSE '{clock}' END AS "Sequence_No",
       CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END AS w
FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0
"""


@query(
    "snapshot_then_changes",
    f"""
SELECT 'first' AS step, * FROM ({_CURRENT_SQL.format(clock=20240101000000)})
UNION ALL SELECT 'compacted', * FROM ({_CURRENT_SQL.format(clock=20240101000000)})
UNION ALL
SELECT 'second', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 7 = 0 THEN 'again' ELSE o_orderpriority END,
       CASE WHEN o_orderkey % 7 = 0 THEN 'late' ELSE o_orderstatus END,
       CASE WHEN o_orderkey % 7 = 0 THEN '100000000000000000001' ELSE '20240202000000' END, ''
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 7 = 0
""",
)
def snapshot_then_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full load, changes and removals above it, all of it compacted; a second full load in its place, and changes above that."""
    names = ("one", "two", "table", "bad", "small", "changes", "changes", "changes")
    one, two, out, bad, small, *feeds = (shared_folder(spark, name) for name in names)
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    removed = (key % 5 == 0) & (key % 3 != 0)

    def snapshot(rows: DataFrame, v: Column, item: Column, folder: str) -> str:
        products = F.array(F.struct(item.alias("n"))).alias("products")
        rows.select(key.cast("string").alias("leadId"), v.alias("v"), products, F.lit(1).alias("sequence")).write.parquet(folder)
        return folder

    def feed(records: DataFrame, folder: str) -> str:
        records.select(F.array("record").alias("Records")).write.json(folder)
        return folder

    def columns() -> list[str]:
        return target_columns(spark, out)

    def current(path: str, step: str) -> DataFrame:
        rows = read_current(spark, path, ["leadId"], "Sequence_No", deletes="_deleted")
        w = F.coalesce("w", F.lit("")) if "w" in rows.columns else F.lit("")
        return rows.select(F.lit(step).alias("step"), "leadId", "v", "products_n", "Sequence_No", w.alias("w"))

    def materialised(rows: DataFrame) -> DataFrame:
        folder = shared_folder(spark, "current")
        rows.write.parquet(folder)
        return spark.read.schema(rows.schema).parquet(folder)

    load_snapshot(spark, snapshot(orders, F.col("o_orderstatus"), F.col("o_orderpriority"), one), out, "20240101000000")
    items = F.array("o_orderstatus", "o_orderpriority", "o_orderstatus")
    late = F.lit("100000000000000000000")
    changed = feed(_lead_records(orders.where(key % 3 == 0), "MODIFY", late, items, v=F.lit("changed"), w=F.lit("x")), feeds[0])
    gone = feed(_lead_records(orders.where(removed), "REMOVE", late), feeds[1])
    for batch, files in ((1, changed), (2, gone), (2, gone)):
        load_changes(spark, files, out, bad, batch, columns=columns(), multiline=False)
    steps = [materialised(current(out, "first"))]  # before a second full load takes the place of what it reads
    compact(spark, out, small, ["leadId"], "Sequence_No")
    steps.append(current(small, "compacted"))
    half = orders.where(key % 2 == 0)
    load_snapshot(spark, snapshot(half, F.col("o_orderpriority"), F.col("o_orderstatus"), two), out, "20240202000000")
    seventh = _lead_records(orders.where(key % 7 == 0), "MODIFY", F.lit("100000000000000000001"), F.array(F.lit("late")), v=F.lit("again"))
    load_changes(spark, feed(seventh, feeds[2]), out, bad, 1, columns=columns(), multiline=False)
    steps.append(current(out, "second"))
    return union_files(steps)


@query(
    "redelivered_records",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS "leadId", unnest([o_orderpriority, o_orderstatus, o_orderpriority]) AS products_n,
       '7' AS "Sequence_No", scope
FROM orders, (VALUES ('version'), ('key'), ('compacted')) scopes(scope) WHERE o_orderkey % 4 <> 3
UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), unnest([o_orderstatus, o_orderstatus]), '8', scope
FROM orders, (VALUES ('version'), ('key'), ('compacted')) scopes(scope) WHERE o_orderkey % 4 = 3
UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), unnest([o_orderpriority, o_orderstatus, o_orderpriority]), '8', 'key'
FROM orders WHERE o_orderkey % 4 = 3
""",
)
def redelivered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record several times: twice in one file, in two files of a slice, and in two batches. Items of one document that
    are equal stay; of two versions of a document the later one stays, once, and with scope="key" it has the items of both."""
    feeds = [shared_folder(spark, "feed") for _ in range(2)]
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    items = F.array("o_orderpriority", "o_orderstatus", "o_orderpriority")
    first = _lead_records(orders, "INSERT", F.lit("7"), items)
    newer = _lead_records(orders.where(key % 4 == 3), "MODIFY", F.lit("8"), F.array("o_orderstatus", "o_orderstatus"))
    # A file holds every record twice, and there are two such files of each; the second batch has all of it again.
    twice = first.unionByName(newer).select(F.array("record", "record").alias("Records"))
    for folder in feeds:
        for _ in range(2):
            twice.write.mode("append").option("maxRecordsPerFile", _FEED_LINES).json(folder, compression="gzip")
    found = []
    for scope in ("version", "key"):
        out, small, bad = (shared_folder(spark, name) for name in ("changes", "changes", "bad"))
        for batch, folder in enumerate(feeds, 1):
            load_changes(spark, folder, out, bad, batch, columns=target_columns(spark, out), multiline=False, scope=scope)
        current = read_current(spark, out, ["leadId"], "Sequence_No", deletes="_deleted")
        found.append(current.select("leadId", "products_n", "Sequence_No", F.lit(scope).alias("scope")))
        if scope == "version":
            compact(spark, out, small, ["leadId"], "Sequence_No")
            again = read_current(spark, small, ["leadId"], "Sequence_No", deletes="_deleted")
            found.append(again.select("leadId", "products_n", "Sequence_No", F.lit("compacted").alias("scope")))
    return union_files(found)


@query(
    "json_text_paths",
    """
SELECT doc_id, '.text' AS path, text AS value FROM documents
UNION ALL SELECT doc_id, '.of.0.n', CAST(n_chars AS VARCHAR) FROM documents
""",
)
def json_text_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, some of them very long, as strings inside JSON; what is no JSON goes to the quarantine, which is empty here."""
    doc = F.to_json(F.struct("text", F.array(F.struct(F.col("n_chars").alias("n"))).alias("of")))
    documents = table(spark, sf_dir, "documents").select("doc_id", doc.alias("doc"))
    bad = not_json(documents, ["doc_id"], "doc").select("doc_id", F.col("reason").alias("path"), F.col("raw").alias("value"))
    return json_path_value_rows(documents, ["doc_id"], "doc").union(bad)

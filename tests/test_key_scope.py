"""Change feeds whose documents are paired with the items of all versions of their key."""

from __future__ import annotations

import duckdb
import pytest
from feed import record, rows, write_feed
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import ORACLES, QUERIES
from docweave.plans.jobs import Counts, load_changes, store_changes
from docweave.schemas import feed_schema
from docweave.sinks.tables import read_changes
from docweave.sources.documents import infer_feed_schema, read_feed


def test_key_scope_reads_the_feed_once(spark, tmp_path):
    """Every side of the joins has the parsed records; lists that never hold an item give no columns."""
    files = [[record({"leadId": "A", "products": [f"p{i}"], "none": []}, i, "MODIFY") for i in range(3)]]
    feed = write_feed(tmp_path / "feed", *files)
    parsed = read_feed(spark, feed, infer_feed_schema(spark, feed))
    seen = spark.sparkContext.accumulator(0)

    def count(path):
        seen.add(1)
        return path

    counted = parsed.withColumn("source_file", F.udf(count, "string")("source_file")).where("source_file is not null")
    loaded = store_changes(counted, str(tmp_path / "table"), str(tmp_path / "bad"), 1, scope="key")
    assert seen.value == 1
    assert loaded.counts == Counts(0, 3, 0, "0", "2") and loaded.odd == 0
    found = read_changes(spark, str(tmp_path / "table"))
    assert found.count() == 9 and sorted(found.columns) == sorted(["leadId", "none", "products_0", "Sequence_No", "_deleted", "batch_id"])


@pytest.mark.parametrize("inside", ["S string", "L array<struct<M:struct<>>>", "L array<struct<NULL:string>>"])
def test_key_scope_of_what_files_cannot_hold(spark, tmp_path, inside):
    image = T.StructType.fromDDL(f"leadId struct<S:string>, products struct<L:array<struct<S:string>>>, v struct<{inside.replace(' ', ':', 1)}>")
    feed = write_feed(tmp_path / "feed", [record({"leadId": "A", "products": [f"p{i}"]}, i) for i in range(2)])
    out = str(tmp_path / "table")
    loaded = load_changes(spark, feed, out, str(tmp_path / "bad"), 1, feed_schema(image), scope="key")
    assert loaded.counts.inserts == 2
    assert rows(read_changes(spark, out).select("leadId", "v", "products_0", "Sequence_No")) == [
        ("A", "", p, s) for p in ("p0", "p1") for s in "01"
    ]


def test_key_scope_of_lists_without_items(spark, tmp_path):
    feed = write_feed(tmp_path / "feed", [record({"leadId": "A", "products": []}, i) for i in range(2)])
    load_changes(spark, feed, str(tmp_path / "table"), str(tmp_path / "bad"), 1, scope="key")
    assert rows(read_changes(spark, str(tmp_path / "table")).drop("batch_id")) == [("A", s, False) for s in "01"]


def test_lines_without_a_key_meet(spark, tmp_path):
    """All lines of order 0, and those without a number, are versions of the NULL key; other lines meet only their like."""
    lines = [(0, 1, "a"), (0, 2, "b"), (0, 2, "c"), (3, None, "d"), (1, 1, "e"), (1, 1, "f"), (1, 2, "g")]
    text = "bigint, l_linenumber int, l_returnflag string"
    df = spark.createDataFrame(lines, f"l_orderkey {text}").selectExpr(
        "*", "ascii(l_returnflag) + 0L as l_partkey", "-ascii(l_returnflag) + 0L as l_suppkey", "'O' as l_linestatus",
        "1D as l_quantity", "2.5D as l_extendedprice", "0D as l_discount", "0D as l_tax", "timestamp'2024-01-02' as l_shipdate",
    )
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["flatten_key_scope"](spark, str(tmp_path))
    pairs = found.where("`personalDetails_partyList_role` = 'part'").select(
        "status_flag", F.char(F.col("personalDetails_partyList_id").cast("int")).alias("of")
    )
    groups = ("abcd", "ef", "g")
    # Each line has the partners of all lines of its key, once for each of their amounts.
    assert rows(pairs) == sorted((x, y) for group in groups for x in group for y in group for _ in group)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    columns = sorted(found.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {quoted} FROM ({ORACLES['flatten_key_scope']})").fetchall()
    assert rows(found.select(columns)) == sorted(want, key=repr)

from __future__ import annotations

import datetime as dt
import json
import random
from dataclasses import replace

import pytest
from feed import record, rows, write_feed
from pyspark.sql import functions as F

from docweave.functions import clock, text
from docweave.operators.conform import conform, union_files
from docweave.operators.ledger import batch_slices, first_n_files, numbered, pending, slice_paths, with_file_path
from docweave.operators.path_values import json_depth, json_path_value_rows, not_json, path_value_rows
from docweave.operators.skew import left_join_children, salted_keys
from docweave.plans.jobs import DONE, AuditLog, ingest_pending, load_changes, read_or_empty
from docweave.schemas import BOOKMARK
from docweave.sinks.tables import (
    append_batch,
    compact,
    read_audit,
    read_changes,
    read_current,
    read_quarantine,
    write_quarantine,
    write_table,
)
from docweave.sources.documents import case_sensitive, infer_feed_schema
from docweave.sources.files import list_input_files, target_columns
from docweave.sources.notifications import BOOKMARK_CSV, scan_bookmarks
from docweave.streaming.changes import change_stream, feed_stream
from docweave.workspace import shared_folder


def test_numbers_follow_the_order(spark):
    names = [f"p{random.Random(3).random()}-{i}" for i in range(5000)]
    random.Random(4).shuffle(names)
    df = spark.createDataFrame([(n,) for n in names], "path string").repartition(5)
    got = {r.path: r.row_number for r in numbered(df, ["path"]).collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(names))}


def test_slices(spark):
    df = spark.createDataFrame([(f"f{i:04d}",) for i in range(250)], "path string")
    slices = batch_slices(df, ["path"], 100)
    lists = {r.slice_id: r.paths for r in slice_paths(slices, F.col("path")).collect()}
    assert lists == {s: [f"f{i:04d}" for i in range(s * 100, min(s * 100 + 100, 250))] for s in range(3)}
    assert batch_slices(df.limit(0), ["path"], 100).isEmpty()


def test_first_files(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "path string")
    assert [r.path for r in first_n_files(df, "path", 2).collect()] == ["a", "b"]
    assert first_n_files(df, "path", None).count() == 3


def test_pending(spark):
    arrived = spark.createDataFrame([("a",), ("b",), (None,)], "path string")
    done = spark.createDataFrame([("a",), ("a",)], "path string")
    assert rows(pending(arrived, done, ["path"])) == [("b",), (None,)]
    assert pending(arrived, arrived, ["path"]).isEmpty()


def test_listing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv.gz", "c.txt", "in/d.csv"):
        (tmp_path / name).write_text("x")

    def names(**options):
        return sorted(r.path.rsplit("/", 1)[1] for r in list_input_files(spark, str(tmp_path), **options).collect())

    assert names(contains=".csv") == ["a.csv", "b.csv.gz", "d.csv"]
    assert names(contains=".csv", recursive=False) == ["a.csv", "b.csv.gz"]
    assert names(glob="*.csv") == ["a.csv", "d.csv"]


def test_target_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2)], "_hoodie_commit_time int, a int").write.parquet(path)
    spark.createDataFrame([(1, 2)], "a int, b int").write.mode("append").parquet(path)
    assert sorted(target_columns(spark, path)) == ["a", "b"]
    assert target_columns(spark, str(tmp_path / "none")) == []


def test_conform(spark):
    df = spark.createDataFrame([("1",)], "b string")
    once = conform(df, ["c", "B", "a", "c"])
    assert once.columns == ["b", "a", "c"]
    assert rows(once) == [("1", "", "")]
    assert conform(once, ["c", "a"]).columns == once.columns


def test_union(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "y int, x int")
    assert rows(union_files([a, b]).select("x", "y")) == [(1, None), (3, 2)]


def test_text_functions(spark):
    df = spark.createDataFrame([("s3://bucket/a/b/c.csv", "x.y__z", "banana")], "u string, t string, w string")
    u, t = F.col("u"), F.col("t")
    assert tuple(
        df.select(
            text.uri_bucket(u), text.uri_prefix(u), text.basename(u), text.segment(u, 9), text.regex_part(t, 2),
            text.dot_part(t, 1), text.dot_part(t, 5), text.char_count(F.col("w"), "a"),
            text.object_uri(F.lit(None).cast("string"), t), text.uri_prefix(F.lit("s3://b")),
        ).first()
    ) == ("bucket", "a/b/c.csv", "c.csv", None, "z", "y__z", None, 3, "s3://x.y__z", "")
    with pytest.raises(ValueError):
        text.char_count(u, "ab")


def test_clocks_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            instant = F.timestamp_micros(F.lit(1_700_000_000_123_456))
            row = spark.range(1).select(clock.load_clock(instant), clock.epoch_seconds(instant)).first()
            assert tuple(row) == ("20231115034320123456", 1_700_000_000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_path_values(spark):
    doc = '{"a":{"b":[1,{"c":"x"}],"e":{}},"n":null,"s":"q","t":[true,[]],"x.y":"{}","f":1e20}'
    want = [
        (1, ".a.b.0", "1"), (1, ".a.b.1.c", "x"), (1, ".f", "1e+20"), (1, ".n", None), (1, ".s", "q"),
        (1, ".t.0", "True"), (1, ".x.y", "{}"),
    ]
    df = spark.createDataFrame([(1, doc), (2, None), (3, "{}")], "id int, j string")
    assert rows(json_path_value_rows(df, ["id"], "j")) == sorted(want, key=repr)
    assert [r[0] for r in df.select(json_depth(F.col("j"))).collect()] == [4, None, 1]


def test_long_and_broken_json(spark):
    long = 'x\\\\" {[ ' * 40_000
    docs = [(1, json.dumps({"t": long, "u": [1]})), (2, "not json"), (3, '{"a":1,"a":2'), (4, None)]
    df = spark.createDataFrame(docs, "id int, j string")
    assert [r[0] for r in df.where("id = 1").select(json_depth(F.col("j"))).collect()] == [2]
    assert rows(json_path_value_rows(df, ["id"], "j")) == [(1, ".t", long), (1, ".u.0", "1")]
    assert rows(not_json(df, ["id"], "j")) == [(2, "not_json", "not json"), (3, "not_json", '{"a":1,"a":2')]


def test_path_values_from_columns(spark):
    df = spark.createDataFrame(
        [(1, ([1, 2], None), {"k": "v"}), (2, None, None)], "id int, a struct<b:array<int>,n:string>, m map<string,string>"
    )
    full = [(1, ".a.b.0", "1"), (1, ".a.b.1", "2"), (1, ".a.n", None), (1, ".m.k", "v"), (2, ".a", None), (2, ".m", None)]
    assert rows(path_value_rows(df, ["id"], ["a", "m"])) == sorted(full, key=repr)
    held = [r for r in full if r[2] is not None]
    assert rows(path_value_rows(df, ["id"], ["a", "m"], null_leaves=False)) == sorted(held, key=repr)


def test_hot_keys(spark):
    df = spark.createDataFrame([("h",)] * 60 + [(f"c{i}",) for i in range(40)] + [(None,)] * 20, "k string")
    weights = df.groupBy("k").agg(F.count("*").alias("__weight"))
    assert rows(salted_keys(weights, ["k"], 10)) == [("h", 6), (None, 2)]
    assert rows(salted_keys(weights, ["k"], 30)) == [("h", 2)]
    assert rows(salted_keys(weights, ["k"], 60)) == []


def test_salted_join_is_a_left_join(spark):
    base = spark.createDataFrame([("h", i) for i in range(200)] + [(f"c{i}", i) for i in range(20)], "k string, x int")
    child = spark.createDataFrame([("h", "p"), ("h", "q"), ("c1", "r"), ("zz", "s")], "k string, y string")
    weights = base.groupBy("k").agg(F.count("*").alias("__weight"))
    want = rows(base.join(child, "k", "left").select("k", "x", "y"))
    for rows_per_task in (10, 1_000_000):
        joined = left_join_children(base, [child], ["k"], weights, rows_per_task)
        assert joined.columns == ["k", "x", "y"] and rows(joined) == want


def test_no_task_gets_a_whole_hot_key(spark):
    """A key with all rows of the result is dealt over the tasks."""
    base = spark.range(0, 40_000, 1, 8).select(F.lit("h").alias("k"), "id")
    child = spark.createDataFrame([("h", "p"), ("h", "q")], "k string, y string")
    weights = base.groupBy("k").agg((2.0 * F.count("*")).alias("__weight"))
    before = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        joined = left_join_children(base, [child], ["k"], weights, 1000)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 80_000 and max(sizes) < 25_000


def test_quarantine(spark, tmp_path):
    path = str(tmp_path / "q")
    df = spark.createDataFrame([(dt.datetime(2024, 1, 9), "bad")], "at timestamp_ntz, reason string")
    write_quarantine(df, path, "web", "t", "at")
    write_quarantine(df, path, "web", "t", "at")
    assert sorted(str(p.relative_to(path)) for p in (tmp_path / "q").glob("*/*/*/*/*")) == [
        "source_system=web/table_name=t/year=2024/month=01/day=09"
    ]
    assert spark.read.parquet(path).count() == 2


def test_a_hot_partition_is_written_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise("cold").alias("p"), "id")
    write_table(df, path, partition_by=["p"])
    assert rows(spark.read.parquet(path).groupBy("p").count()) == [("cold", 1000), ("hot", 2000)]


def test_shared_folder(spark):
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one != two and one.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_incremental_job(spark, tmp_path):
    """Two slices of a feed, the second one repeated; a late row and a removed key."""
    party = [{"nm": "n"}]
    one = write_feed(
        tmp_path / "one",
        [
            record({"leadId": "A", "v": "old", "personalDetails": {"partyList": party}}, 5, keys={"leadId": "A"}),
            record({"leadId": "B", "v": "x", "personalDetails": {"partyList": party}}, 6, keys={"leadId": "B"}),
        ],
    )
    two = write_feed(
        tmp_path / "two",
        [
            record({"leadId": "A", "w": "new"}, 10, "MODIFY", keys={"leadId": "A"}),
            record({"leadId": "C", "products": "none"}, 11, keys={"leadId": "C"}),
            record(None, 12, "REMOVE", keys={"leadId": "B"}),
        ],
    )
    table, bad = str(tmp_path / "table"), str(tmp_path / "bad")
    load_changes(spark, one, table, bad, 1)
    for _ in range(2):
        load_changes(spark, two, table, bad, 2, columns=target_columns(spark, table))
    current = read_current(spark, table, ["leadId"], "Sequence_No", deletes="_deleted")
    assert rows(current.select("leadId", "Sequence_No", "v", "w", "personalDetails_partyList_nm")) == [
        ("A", "10", "", "new", "")
    ]
    assert [r.reason for r in read_quarantine(spark, bad).collect()] == ["not_a_list"]
    fewer = write_feed(tmp_path / "fewer", [record({"leadId": "C"}, 11, keys={"leadId": "C"})])
    load_changes(spark, fewer, table, bad, 2, columns=target_columns(spark, table))
    assert read_quarantine(spark, bad).count() == 0  # the batch has nothing to reject any more
    keyed, bad = str(tmp_path / "keyed"), str(tmp_path / "bad2")
    load_changes(spark, two, keyed, bad, 2, scope="key")
    assert spark.read.parquet(keyed).count() == 2
    assert [r.reason for r in spark.read.parquet(bad).collect()] == ["not_a_list"]


def test_change_stream_takes_files_in_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        (folder / f"{i}.json").write_text(f'{{"k":"a","seq":"{8 + i}"}}\n{{"k":"b{i}","seq":"1"}}')
    schema = spark.createDataFrame([], "k string, seq string").schema

    def run():
        query = change_stream(
            spark, str(folder), schema, lambda b: b, str(tmp_path / "t"), str(tmp_path / "cp"), ["k"], "seq", max_files=2
        )
        query.awaitTermination()
        return len([p for p in query.recentProgress if p.numInputRows])

    assert run() == 3
    want = [("a", "12"), *[(f"b{i}", "1") for i in range(5)]]
    assert rows(read_current(spark, str(tmp_path / "t"), ["k"], "seq")) == want
    assert run() == 0
    assert rows(read_current(spark, str(tmp_path / "t"), ["k"], "seq")) == want


def test_pending_files_are_taken_slice_by_slice(spark, tmp_path):
    folder = tmp_path / "raw"
    write_feed(folder, *[[record({"leadId": f"L{i}", "v": str(i)}, i)] for i in range(5)])
    (folder / "9.json").write_text("not json")
    queue = spark.createDataFrame(
        [("q/same", str(folder), f"{i}.json") for i in (0, 1, 2, 3, 4, 9, 9)], "destKey string, bucketName string, fileName string"
    )
    table, done, bad = (str(tmp_path / name) for name in ("table", "done", "bad"))

    def run(**options):
        return ingest_pending(spark, queue, done, table, bad, slice_size=2, scheme="file", **options)

    old = spark.createDataFrame([("L0", "0", "old")], "leadId string, Sequence_No string, more string")
    append_batch(old, table, 0)
    assert run(max_files=3) == 2
    assert "batch_id" not in spark.read.parquet(f"{table}/batch_id=2").columns
    assert read_or_empty(spark, done, DONE).count() == 3
    assert run() == 2
    assert run() == 0
    current = read_current(spark, table, ["leadId"], "Sequence_No", deletes="_deleted")
    assert rows(current.select("leadId", "v", "more")) == [(f"L{i}", str(i), "") for i in range(5)]
    assert [(r.reason, r.raw) for r in read_quarantine(spark, bad).collect()] == [("unparsed", "not json")]
    write_feed(folder, [record({"leadId": "L0", "v": "again"}, 50)])
    queue = queue.where("fileName = '0.json'").withColumn("sequencer", F.lit("7"))
    log = AuditLog(str(tmp_path / "audit"), 5, "Src", "Tab")
    assert run(audit=log) == 1 and run(audit=log) == 0  # a new file under an old name
    current = read_current(spark, table, ["leadId"], "Sequence_No", deletes="_deleted")
    assert rows(current.where("leadId = 'L0'").select("v")) == [("again",)]
    noted = rows(read_audit(spark, log.path).select("status", "insert_count", "record_start_sequence", "record_end_sequence"))
    assert noted == [("Completed", 1, "50", "50")]
    queue = queue.withColumn("fileName", F.lit("none.json"))
    assert run(audit=replace(log, epoch_timestamp=7)) == 1 and run() == 0  # a file that is gone is done too
    assert "gone" in [r.reason for r in read_quarantine(spark, bad).collect()]
    queue = queue.withColumn("fileName", F.lit("0.json")).withColumn("sequencer", F.lit("8"))
    with pytest.raises(Exception):
        run(audit=replace(log, epoch_timestamp=6), arrays=["leadId"], format="no such format")
    assert {r.status for r in read_audit(spark, log.path).collect()} == {"Completed", "Failed"}
    assert spark.read.parquet(log.path).count() == 6


def test_bookmark_files_drive_the_job(spark, tmp_path):
    folder = tmp_path / "raw"
    write_feed(folder, [record({"leadId": "A", "v": "1"}, 1)], [record({"leadId": "B", "v": "2"}, 2)])
    columns = {n: F.lit("x") for n in BOOKMARK.names} | {"bucketName": F.lit(str(folder)), "fileSize": F.lit(7)}
    columns |= {"fileName": F.concat(F.col("id").cast("string"), F.lit(".json")), "sequencer": F.col("id").cast("string")}
    write_table(spark.range(2).select(*[c.alias(n) for n, c in columns.items()]), str(tmp_path / "csv"), "csv", options=BOOKMARK_CSV)
    queue = scan_bookmarks(spark, str(tmp_path / "csv"))
    places = [str(tmp_path / name) for name in ("done", "table", "bad")]
    assert ingest_pending(spark, queue, *places, scheme="file") == 1
    assert ingest_pending(spark, queue, *places, scheme="file") == 0
    assert rows(read_current(spark, places[1], ["leadId"], "Sequence_No").select("leadId", "v")) == [("A", "1"), ("B", "2")]


def test_all_rows_of_the_latest_version_are_current(spark, tmp_path):
    def lead(key, sequence, products, event="INSERT"):
        return record({"leadId": key, "products": [{"n": p} for p in products]}, sequence, event, keys={"leadId": key})

    first = write_feed(tmp_path / "1", [lead("A", 5, "xyz"), lead("B", 6, "pq")])
    second = write_feed(tmp_path / "2", [lead("A", 4, "old"), lead("B", 10, "rr", "MODIFY")])
    table, bad, smaller = (str(tmp_path / name) for name in ("table", "bad", "smaller"))
    for batch, files in ((1, first), (2, second), (3, first)):
        load_changes(spark, files, table, bad, batch, columns=target_columns(spark, table))
    want = [("A", "x"), ("A", "y"), ("A", "z"), ("B", "r"), ("B", "r")]
    assert rows(read_current(spark, table, ["leadId"], "Sequence_No").select("leadId", "products_n")) == want
    compact(spark, table, smaller, ["leadId"], "Sequence_No")
    assert rows(read_current(spark, smaller, ["leadId"], "Sequence_No").select("leadId", "products_n")) == want


def test_attributes_that_differ_in_case(spark, tmp_path):
    files = write_feed(tmp_path / "raw", [record({"leadId": "A", "v": "1", "V": "2"}, 1)])
    table, streamed, bad = (str(tmp_path / name) for name in ("table", "streamed", "bad"))
    load_changes(spark, files, table, bad, 1)
    feed_stream(spark, files, streamed, bad, str(tmp_path / "cp")).awaitTermination()
    with case_sensitive(spark):
        for path in (table, streamed):
            assert rows(read_changes(spark, path).select("v", "V")) == [("1", "2")]


def test_partly_parsed_feeds_are_rejected(spark, tmp_path):
    folder = tmp_path / "raw"
    write_feed(folder, [record({"leadId": "A", "v": "1"}, 1)])
    (folder / "1.json").write_text('{"Records":[{"eventName":"INSERT","dynamodb":{"SequenceNumber":"2","NewImage":{"leadId":5}}}]}')
    schema = infer_feed_schema(spark, str(folder / "0.json"))
    table, bad = str(tmp_path / "table"), str(tmp_path / "bad")
    for batch, given in ((1, schema), (2, None)):
        load_changes(spark, str(folder), table, bad, batch, given)
    got = [(r.batch_id, r.leadId) for r in read_changes(spark, table).orderBy("batch_id", "leadId").collect()]
    lost = [(r.reason, "5" in r.raw) for r in read_quarantine(spark, bad).collect()]
    assert got[0] == (1, "A") and lost == [("uncovered", True)]
    assert len(got) == 3  # without a schema an untagged value is loaded as its text


@pytest.mark.parametrize("given", [False, True])
def test_feed_stream(spark, tmp_path, given):
    """Files one by one: the columns grow, and a batch may hold nothing but rejects or removals."""
    folder = tmp_path / "raw"
    write_feed(
        folder,
        [record({"leadId": "A", "v": "1"}, 1, keys={"leadId": "A"})],
        [record({"leadId": "B", "w": "2", "products": [{"n": "p"}]}, 2, keys={"leadId": "B"})],
        [record(None, 3, "REMOVE", keys={"leadId": "A"})],
    )
    schema = infer_feed_schema(spark, str(folder)) if given else None
    table, bad, checkpoint = (str(tmp_path / name) for name in ("table", "bad", "cp"))

    def run(*names):
        feed_stream(spark, str(folder), table, bad, checkpoint, schema, max_files=1).awaitTermination()
        current = read_current(spark, table, ["leadId"], "Sequence_No", deletes="_deleted")
        return rows(current.select("leadId", "v", "w", "products_n", *names))

    assert run() == [("B", "", "2", "p")]
    (folder / "7.json").write_text("not json")
    write_feed(tmp_path / "more", [record({"leadId": "C", "products": "x"}, 9), record({"leadId": "D", "x": "new"}, 10)])
    (folder / "9.json").write_text((tmp_path / "more" / "0.json").read_text())
    if given:
        # What the given schema does not know is kept, but not loaded.
        assert run() == [("B", "", "2", "p")]
    else:
        assert run("x") == [("B", "", "2", "p", None), ("D", "", "", "", "new")]
    rejected = read_quarantine(spark, bad).collect()
    reasons = ["uncovered", "uncovered", "unparsed"] if given else ["not_a_list", "unparsed"]
    assert sorted(r.reason for r in rejected) == reasons
    assert not given or any("new" in r.raw for r in rejected)

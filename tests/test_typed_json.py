from __future__ import annotations

import json
from decimal import Decimal

from feed import record, rows, typed, write_feed
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions.typed_json import unwrap_typed
from docweave.plans.jobs import change_rows, rejected_records
from docweave.sources.documents import read_feed, infer_feed_schema, scan_change_feed, unparsed

DOC = {
    "s": "t",
    "n": Decimal("1.50"),
    "b": False,
    "z": None,
    "set": {"b", "a"},
    "list": [1, "x", {"k": [True, None]}],
    "map": {"in": {"deep": "v"}, "n": 7},
}


def unwrapped(spark, folder):
    return unwrap_typed(scan_change_feed(spark, folder), "image", expand=True)


def test_every_tag(spark, tmp_path):
    folder = write_feed(tmp_path, [record(DOC, 5)])
    row = unwrapped(spark, folder).first()
    assert (row.Sequence_No, row.change_type) == ("5", "I")
    assert (row.s, row.n, row.b, row.z, row.set) == ("t", "1.50", False, None, ["a", "b"])
    assert row["map"]["in"]["deep"] == "v" and row["map"]["n"] == "7"
    assert [row.list[0], row.list[1]] == ["1", "x"]
    assert json.loads(row.list[2]) == {"k": ["True", None]} or json.loads(row.list[2]) == {"k": [True, None]}


def test_binary_and_number_sets(spark, tmp_path):
    image = {"b": {"B": "aGk="}, "ns": {"NS": ["1", "2.0"]}, "bs": {"BS": ["aGk="]}}
    change = {"eventName": "INSERT", "dynamodb": {"SequenceNumber": "1", "NewImage": image}}
    row = unwrapped(spark, write_feed(tmp_path, [change])).first()
    assert (row.b, row.ns, row.bs) == ("aGk=", ["1", "2.0"], ["aGk="])


def test_mixed_types_become_text(spark, tmp_path):
    folder = write_feed(tmp_path, [record({"v": 1}, 1), record({"v": "x"}, 2), record({"v": True}, 3), record({"v": None}, 4)])
    assert [r.v for r in unwrapped(spark, folder).orderBy("Sequence_No").collect()] == ["1", "x", "True", None]


def test_removed_keys_come_through(spark, tmp_path):
    folder = write_feed(
        tmp_path,
        [
            record({"leadId": "A"}, 1, keys={"leadId": "A"}),
            record(None, 2, "REMOVE", keys={"leadId": "A"}),
            record({"leadId": "B"}, 3, "MODIFY", keys={"leadId": "B"}),
        ],
    )
    feed = scan_change_feed(spark, folder)
    assert [r.change_type for r in feed.orderBy("Sequence_No").collect()] == ["I", "D", "U"]
    flat = change_rows(feed).select("leadId", "Sequence_No", "_deleted")
    assert rows(flat) == [("A", "1", False), ("A", "2", True), ("B", "3", False)]


def test_text_that_is_not_json_is_kept(spark, tmp_path):
    folder = write_feed(tmp_path / "f", [record({"leadId": "A"}, 1)])
    schema = infer_feed_schema(spark, folder)
    (tmp_path / "f" / "bad.json").write_text('{"Records": [')
    files = read_feed(spark, folder, schema)
    bad = unparsed(files).collect()
    assert [(r.reason, r.raw, r.source_file.endswith("bad.json")) for r in bad] == [("unparsed", '{"Records": [', True)]
    assert scan_change_feed(spark, folder, schema).count() == 1


def test_incomplete_records_are_kept(spark, tmp_path):
    folder = write_feed(
        tmp_path,
        [
            record({"leadId": "A"}, 1, keys={"leadId": "A"}),
            record(None, 2, "REMOVE"),
            record(None, 3, "INSERT", keys={"leadId": "B"}),
        ],
    )
    feed = scan_change_feed(spark, folder)
    assert rows(change_rows(feed).select("leadId")) == [("A",)]
    assert sorted(r.reason for r in rejected_records(feed).collect()) == ["no_image", "no_key"]


def test_map_typed_attributes(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},)], "v map<string,string>").select(
        F.struct(F.struct(F.transform_values("v", lambda _, x: F.struct(x.alias("N"))).alias("M")).alias("m")).alias("image")
    )
    assert unwrap_typed(df, "image").first().image.m == {"a": "1", "b": "2"}


scalars = st.one_of(st.text("abc'\"\\{[ é", max_size=6), st.integers(-(10**9), 10**9), st.booleans())
documents = st.fixed_dictionaries(
    {"key": st.integers(0, 99)},
    optional={
        "t": st.text(max_size=8),
        "flag": st.booleans(),
        "items": st.lists(st.fixed_dictionaries({"a": st.integers(0, 9)}, optional={"b": st.text(max_size=3)}), max_size=3),
        "in": st.fixed_dictionaries({}, optional={"x": scalars, "y": st.lists(st.integers(0, 9), max_size=3)}),
    },
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(documents, min_size=1, max_size=6))
def test_unwrapping_undoes_wrapping(spark, docs):
    """The unwrapped table holds what the plain documents hold, numbers as text."""
    lines = [
        json.dumps({"Records": [{"eventName": "INSERT", "dynamodb": {"SequenceNumber": str(i), "NewImage": typed(d)["M"]}}]})
        for i, d in enumerate(docs)
    ]
    reader = spark.read.option("primitivesAsString", "true")
    parsed = reader.json(spark.sparkContext.parallelize(lines, 1))
    records = parsed.select(F.explode("Records").alias("r")).select("r.dynamodb.SequenceNumber", "r.dynamodb.NewImage")
    plain = unwrap_typed(records, "NewImage").orderBy(F.col("SequenceNumber").cast("int")).collect()

    def simple(value):
        """Without attributes that are absent, empty or NULL; every scalar as text."""
        if hasattr(value, "asDict"):
            value = value.asDict()
        if isinstance(value, dict):
            fields = {k: simple(v) for k, v in value.items()}
            return {k: v for k, v in fields.items() if v not in (None, {})}
        if isinstance(value, list):
            return [simple(v) for v in value]
        return None if value is None else str(value)

    for row, doc in zip(plain, docs):
        assert simple(row.NewImage) == simple(doc)

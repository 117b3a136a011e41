from __future__ import annotations

import datetime as dt
import json
import random
import struct
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from docweave.functions.stringify import fill_blank, float_text, json_rows, snapshot_float, stringify


def floats() -> list[float]:
    rng = random.Random(7)
    out = [0.0, -0.0, 0.1, 2.0, 1e7, 12345678.5, 1e15, 1e16, 1e17, 1.5e-5, 1e-4, 0.001, 1 / 3, 2 / 3e5, 123456789.125]
    out += [128.01 * 1e15, 2e23, 1e23, 5e-324, 1.7976931348623157e308, 9007199254740993.0, -1234.5678e9]
    out += [rng.uniform(-1e6, 1e6) for _ in range(2000)]
    out += [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(2000)]
    out += [round(rng.uniform(0, 1e8), 2) for _ in range(2000)]
    bits = [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(1000)]
    return out + [b for b in bits if b == b and abs(b) != float("inf")]


def test_float_text_is_the_shortest_text(spark):
    values = floats()
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", float_text(F.col("v")).alias("t"))
    different = [(r.v, r.t) for r in rows.collect() if r.t != repr(r.v)]
    # Java may choose other digits for a float; they have to read back as the same one.
    assert all(float(t) == v for v, t in different)
    assert len(different) < len(values) / 100


def test_snapshot_floats_match_ten_digit_json(spark):
    values = [v for v in floats() if 1e-6 < abs(v) < 1e14] + [0.0, 1 / 3, 143399.46333333335, 0.99999999999]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", snapshot_float(F.col("v")).alias("s"))
    for row in rows.collect():
        assert row.s == json.loads(pd.Series([row.v, "x"]).to_json())["0"], row


def test_stringify_goldens(spark):
    df = spark.createDataFrame(
        [
            (True, 1, 0.1, Decimal("1.50"), [1], ("x",), "s", None),
            (None, None, 2.0, None, None, None, None, None),
        ],
        "b boolean, i int, f double, d decimal(10,2), l array<int>, s struct<a:string>, t string, n void",
    )
    assert [tuple(r) for r in stringify(df).collect()] == [
        ("True", "1", "0.1", "1.50", "[1]", '{"a":"x"}', "s", ""),
        ("", "", "2.0", "", "", "", "", ""),
    ]
    assert stringify(df, fill=None).collect()[1][0] is None


def test_stringify_special_floats(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),)], "f double")
    assert [r[0] for r in stringify(df).collect()] == ["", "inf", "-inf"]
    small = spark.createDataFrame([(0.1,)], "f double").select(F.col("f").cast("float").alias("f"))
    assert stringify(small).first()[0] == "0.1"


def test_stringify_snapshot(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2023, 1, 2), dt.date(2023, 1, 2), 1 / 3, Decimal("1.50"))],
        "t timestamp_ntz, d date, f double, m decimal(10,2)",
    )
    assert tuple(stringify(df, snapshot=True).first()) == ("1672617600000", "1672617600000", "0.3333333333", "1.5")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert stringify(df, snapshot=True).first()[0] == "1672617600000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_json_rows_keep_nulls(spark):
    df = spark.createDataFrame([(1, None, 1 / 3)], "a int, b string, c double")
    assert json_rows(df).first()[0] == '{"a":1,"b":null,"c":0.3333333333}'


def test_fill_blank_only_touches_text(spark):
    df = spark.createDataFrame([(None, None)], "a string, b int")
    assert tuple(fill_blank(df).first()) == ("", None)

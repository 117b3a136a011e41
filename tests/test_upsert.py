from __future__ import annotations

from feed import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.operators.counts import audit_entry, record_counts
from docweave.operators.upsert import latest_per_key, live_rows, upsert_latest
from docweave.sinks.tables import append_audit, append_batch, compact, read_audit, read_changes, read_current

SCHEMA = "k string, seq string, v string"


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_longer_sequences_are_greater(spark):
    df = table(spark, [("a", "9", "old"), ("a", "1000", "new"), ("a", "0999", "mid"), ("a", None, "none")])
    assert rows(latest_per_key(df, ["k"], "seq")) == [("a", "1000", "new")]
    assert rows(latest_per_key(df, ["k"], "seq", order="lexical")) == [("a", "9", "old")]


def test_stored_row_survives_an_older_change_and_loses_a_tie(spark):
    target = table(spark, [("a", "5", "kept"), ("b", "5", "replaced"), ("c", "5", "alone"), (None, "1", "null key")])
    changes = table(spark, [("a", "4", "late"), ("b", "5", "tie"), ("d", "1", "fresh"), (None, "2", "null key 2")])
    want = [("a", "5", "kept"), ("b", "5", "tie"), ("c", "5", "alone"), ("d", "1", "fresh"), (None, "2", "null key 2")]
    for small in (False, True):
        merged = upsert_latest(target, changes, ["k"], "seq", small_changes=small)
        assert rows(merged) == sorted(want, key=repr)
        assert rows(upsert_latest(merged, changes, ["k"], "seq", small_changes=small)) == rows(merged)


def test_new_columns_join_the_table(spark):
    target = table(spark, [("a", "1", "x")])
    changes = spark.createDataFrame([("b", "2", "n")], "k string, seq string, w string")
    for small in (False, True):
        merged = upsert_latest(target, changes, ["k"], "seq", small_changes=small)
        assert rows(merged.select("k", "seq", "v", "w")) == [("a", "1", "x", None), ("b", "2", None, "n")]


def test_tombstones(spark):
    target = table(spark, [("a", "1", "x"), ("b", "1", "y")])
    gone = table(spark, [("a", "3", None)]).withColumn("gone", F.lit(True))
    for small in (False, True):
        merged = upsert_latest(target, gone, ["k"], "seq", deletes="gone", small_changes=small)
        assert rows(live_rows(merged, "gone")) == [("b", "1", "y")]
        late = table(spark, [("a", "2", "late"), ("b", "2", "z")]).withColumn("gone", F.lit(False))
        again = upsert_latest(merged, late, ["k"], "seq", deletes="gone", small_changes=small)
        assert rows(live_rows(again, "gone")) == [("b", "2", "z")]


def test_equal_rows_are_chosen_the_same_way(spark):
    data = [("a", "1", str(i)) for i in range(50)]
    one = latest_per_key(table(spark, data).repartition(7), ["k"], "seq")
    two = latest_per_key(table(spark, data[::-1]).repartition(3), ["k"], "seq")
    assert rows(one) == rows(two)


def test_only_the_best_row_of_a_partition_is_shuffled(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 10).cast("string"))
    df = spark.range(0, 100_000, 1, 4).select(key.alias("k"), F.col("id").cast("string").alias("seq"), "id")
    latest = latest_per_key(df, ["k"], "seq")
    assert {r.k: r.id for r in latest.collect()}["hot"] == 99_999
    plan = latest._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in before_shuffle


changes = st.lists(
    st.tuples(st.sampled_from("abc"), st.integers(0, 2000), st.booleans()), max_size=12, unique_by=lambda c: c[1]
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(changes, st.integers(0, 12))
def test_order_of_batches_does_not_matter(spark, data, cut):
    schema = "k string, seq string, gone boolean"
    frame = spark.createDataFrame([(k, str(s), gone) for k, s, gone in data], schema)
    empty = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(k, str(s), g) for k, s, g in data[:cut]], schema)
    two = spark.createDataFrame([(k, str(s), g) for k, s, g in data[cut:]], schema)

    def apply(*batches):
        current = empty
        for batch in batches:
            current = upsert_latest(current, batch, ["k"], "seq", deletes="gone")
        return rows(live_rows(current, "gone"))

    best = {}
    for k, s, gone in data:
        if s >= best.get(k, (-1,))[0]:
            best[k] = (s, gone)
    want = sorted([(k, str(s)) for k, (s, gone) in best.items() if not gone], key=repr)
    assert apply(frame) == apply(one, two) == apply(two, one, two) == want


def test_change_table(spark, tmp_path):
    path, smaller = str(tmp_path / "t"), str(tmp_path / "c")
    append_batch(table(spark, [("a", "1", "x"), ("b", "1", "y")]), path, 0)
    append_batch(table(spark, [("a", "2", "z"), ("b", "1", "tie")]), path, 1)
    more = spark.createDataFrame([("c", "1", "w", "extra")], SCHEMA + ", e string")
    for _ in range(2):
        append_batch(more, path, 2)
    assert read_changes(spark, path).count() == 5
    want = [("a", "2", "z", None), ("b", "1", "tie", None), ("c", "1", "w", "extra")]
    assert rows(read_current(spark, path, ["k"], "seq")) == want
    compact(spark, path, smaller, ["k"], "seq")
    assert rows(read_current(spark, smaller, ["k"], "seq")) == want
    assert read_changes(spark, smaller).count() == 3


def test_counts(spark):
    df = table(spark, [("I", "9", None), ("U", "1000", None), ("D", "0999", None), ("I", None, None)])
    assert tuple(record_counts(df, "seq", "k").first()) == (2, 1, 1, "9", "1000")
    assert tuple(record_counts(df, "seq", order="lexical").first()) == (4, 0, 0, "0999", "9")
    empty = df.where(F.lit(False))
    assert tuple(record_counts(empty, "seq", "k").first()) == (0, 0, 0, "0", "0")
    blank = table(spark, [("I", "", None), ("I", " ", None)])
    for order in ("numeric", "lexical"):
        assert tuple(record_counts(blank, "seq", order=order).first()) == (2, 0, 0, "0", "0")


def test_audit_keeps_the_last_state_of_a_job(spark, tmp_path):
    path = str(tmp_path / "audit")
    empty = record_counts(table(spark, []), "seq")
    full = record_counts(table(spark, [("a", "7", "x")]), "seq")
    append_audit(audit_entry(empty, 1, "Src", "Tab", "Started", "l"), path)
    append_audit(audit_entry(empty, 2, "Src", "Tab", "Started", "l"), path)
    append_audit(audit_entry(full, 1, "Src", "Tab", "Completed", "l"), path)
    append_audit(audit_entry(empty, 2, "Src", "Tab", "Failed", "l"), path)
    assert [tuple(r) for r in read_audit(spark, path).orderBy("epoch_timestamp").collect()] == [
        (1, "Src", "Tab", "Completed", 1, 0, 0, "7", "7", "l"),
        (2, "Src", "Tab", "Failed", 0, 0, 0, "0", "0", "l"),
    ]

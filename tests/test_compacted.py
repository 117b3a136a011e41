"""Compacted tables, and queries that read them."""

from __future__ import annotations

import os

import pytest
from feed import rows

from catalogue import QUERIES
from docweave.sinks.tables import append_batch, compact, read_current

SF = "/root/testdata/sf0.001"


def _batch(spark, *documents):
    return spark.createDataFrame(documents, "id string, seq string, v string, _deleted boolean")


def _has_shuffle(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_a_compacted_table_is_read_without_a_shuffle(spark, tmp_path):
    table, small = str(tmp_path / "table"), str(tmp_path / "small")
    append_batch(_batch(spark, ("a", "9", "old", False), ("b", "1", "x", False), ("b", "1", "y", False), ("c", "1", "z", False)), table, 1)
    append_batch(_batch(spark, ("a", "10", "new", False), ("c", "2", None, True)), table, 2)
    compact(spark, table, small, ["id"], "seq")

    def current(path, order="numeric"):
        return read_current(spark, path, ["id"], "seq", order, deletes="_deleted")

    want = [("a", "10", "new"), ("b", "1", "x"), ("b", "1", "y")]
    assert rows(current(table)) == rows(current(small)) == want
    assert _has_shuffle(current(table)) and not _has_shuffle(current(small))
    # By another order it might be another table.
    assert _has_shuffle(current(small, "lexical"))
    assert _has_shuffle(read_current(spark, small, ["v"], "seq"))
    # What comes above counts, also a late change of a removed key.
    append_batch(_batch(spark, ("b", "2", "w", False), ("c", "1", "late", False)), small, 1)
    assert rows(current(small)) == [("a", "10", "new"), ("b", "2", "w")]


def test_a_compacted_batch_that_is_written_again_is_compared_again(spark, tmp_path):
    small = str(tmp_path / "small")
    append_batch(_batch(spark, ("a", "1", "x", False)), str(tmp_path / "table"), 1)
    compact(spark, str(tmp_path / "table"), small, ["id"], "seq")
    append_batch(_batch(spark, ("a", "1", "x", False), ("a", "2", "y", False)), small, 0)
    assert rows(read_current(spark, small, ["id"], "seq", deletes="_deleted")) == [("a", "2", "y")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_only_what_is_replaced_is_written_out(spark, monkeypatch):
    from catalogue import documents

    folders = []
    shared = documents.shared_folder
    monkeypatch.setattr(documents, "shared_folder", lambda s, name: folders.append(name) or shared(s, name))
    assert QUERIES["snapshot_then_changes"](spark, SF).count() > 0
    assert folders.count("current") == 1

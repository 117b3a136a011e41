"""Every registered query of this subpackage: names, columns, and its SQL where it has one."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from docweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

COLUMNS = {
    1: "doc_id fingerprint component_id",
    2: "doc_id held_out score predicted",
    3: "doc_id n_words n_hit n_items items_sha256 contaminated",
    4: "doc_id held_out score predicted",
    5: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    6: "doc_id held_out n_tokens n_known train_tokens base_score score",
    7: "vec_id n_links component_id kept",
    8: "doc_id n_statements licenses statements",
    9: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    10: "doc_id held_out lang_pred score",
    11: "doc_id leaf subroot root proof_sha256 folded_root verified",
    12: "doc_id size source_size target taken",
    13: "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == sorted(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    got = QUERIES[name](spark, SF).columns
    assert set(COLUMNS[int(name[2:].split("_")[0])].split()) <= set(got)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    from check_queries import compare, connect

    assert compare(spark, connect(SF), SF, name) is None

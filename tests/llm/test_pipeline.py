"""The pipeline, stage by stage, against plain versions over the rows of each stage's input."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from docweave.llm.decontaminate import contamination
from docweave.llm.language import fit_profiles
from docweave.llm.packing import END
from docweave.llm.quality import CUT, features, fit_quality
from docweave.llm.simhash import fingerprint
from docweave.llm.tokens import default_path, encoder

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages_against_plain(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        kept[name] = (docs.collect(), spark.read.parquet(out).collect())
        docs = spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == columns
            rows = {r.doc_id: r for r in kept[name][0]}
            assert all(rows[r.doc_id] == r for r in kept[name][1])

    def ids(name):
        return [r.doc_id for r in kept[name][0]], sorted(r.doc_id for r in kept[name][1])

    given, left = kept["quality"]
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_quality(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.score(np.array([features(r.text.encode()) for r in given]))
    assert sorted(r.doc_id for r, s in zip(given, scores) if s >= CUT) == ids("quality")[1]

    given, left = kept["language"]
    profiles = fit_profiles(spark.createDataFrame(given))
    assert sorted(r.doc_id for r in given if profiles.identify(r.text.encode())[1] >= corpus_pipeline.LEAST_FIT) == ids("language")[1]

    given, left = kept["near_dedup"]
    prints = sorted((r.doc_id, fingerprint(r.text.encode())) for r in given)
    group = {i: i for i, _ in prints}
    moved = True
    while moved:
        moved = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= 3 and group[b] < group[a]:
                    group[a], moved = group[b], True
    assert sorted(set(group.values())) == ids("near_dedup")[1]

    given, left = kept["decontaminate"]
    judged = contamination(spark.createDataFrame(given), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert sorted(r.doc_id for r in judged if not r.contaminated) == ids("decontaminate")[1]

    given, left = kept["packing"]
    encode = encoder(default_path()).encode
    parts = {}
    for r in sorted(left, key=lambda r: r.start):
        parts.setdefault(r.doc_id, []).append(r.ids)
    end = np.array([END], "<u4").tobytes()
    assert {i: b"".join(p) for i, p in parts.items()} == {r.doc_id: encode(r.text) + end for r in given}
    assert 0 < len(given) < raw.count()


def test_stages_take_any_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, and a table without rows."""
    fine = "The plain words of a plain document, one after the other, in a row. " * 4
    rows = [(1, fine, "en", "a", 5, 0.5), (1, fine, "en", "a", 5, 0.5), (2, fine, None, None, None, None), (None, fine + "More.", "en", "b", 1, None)]
    rows += [(4, None, "en", "c", 1, 1.0), (5, "", "de", "c", 1, 1.0), (6, "?!", None, "c", 1, 1.0), (7, "Long words follow here. " * 40_000, "en", "c", 1, 1.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, label double"
    frame = spark.createDataFrame(rows, schema).withColumns({n: F.lit("clash") for n in ("print", "shingle", "score", "row", "x")})
    for given in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, given, SF)
            if name == "packing":
                assert (got.count() > 0) == (given is frame)
                continue
            assert got.columns == frame.columns
            kept = [r.doc_id for r in got.collect()]
            assert given is frame or kept == []
            if given is frame and name == "near_dedup":
                assert sorted(map(str, kept)) == sorted(map(str, [1, 1, None, 4, 6, 7]))
            if given is frame and name == "decontaminate":
                assert len(kept) == len(rows)


def test_registered(spark):
    assert contract.queries()["pipeline"].__wrapped__ is corpus_pipeline.run
    assert "pipeline" not in contract.oracle_sql()
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_columns_whose_names_need_quotes(spark):
    """The stages that join keep every column under its name."""
    from docweave.llm.decontaminate import clean_documents
    from docweave.llm.simhash import simhash_dedup

    rows = [(1, "one two three four", 7), (2, "one two three four", 8), (3, "five six seven", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnRenamed("n", "meta.src")
    items = spark.createDataFrame([(1, "five six seven")], "item_id long, text string")
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns and sorted(r["meta.src"] for r in kept.collect()) == [7, 9]
    clean = clean_documents(docs, items)
    assert clean.columns == docs.columns and sorted(r["meta.src"] for r in clean.collect()) == [7, 8]

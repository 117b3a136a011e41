"""The audit against applying every order row by row."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.llm import audit as a

SCHEMA = "doc_id bigint, source string, text string"
LABELS = "doc_id bigint, quality int, toxic int"


def fails(rows):
    """The letters that each row fails."""
    out = []
    for doc_id, _, text in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        letters = ""
        letters += "A" * (len(words) < 200)
        letters += "B" * (100 * len(set(words)) < 50 * len(words))
        letters += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
        letters += "D" * any(c in "#$%&*|" for c in text)
        smaller = [r[0] for r in rows if (r[2] or "") == text and r[0] is not None and doc_id is not None and r[0] < doc_id]
        out.append(letters + "E" * bool(smaller))
    return out


def plain(rows, labels):
    letters = fails(rows)
    good = {r[0] for r in labels if r[1] == 1 and r[0] is not None}
    toxic = {r[0] for r in labels if r[2] == 1 and r[0] is not None}
    shapley, out = {}, []
    for order in itertools.permutations("ABCDE"):
        for part in {r[1] or "" for r in rows}:
            left = [(r, f) for r, f in zip(rows, letters) if (r[1] or "") == part]
            every = list(left)
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                failing = sum(letter in f for _, f in every)
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
                lost = [sum(r[0] in marked for r, _ in gone) for marked in (good, toxic)]
                alone = sum(f == letter for _, f in every)
                out.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, *lost])
    return sorted((*row, shapley[row[0], row[1][row[2] - 1]]) for row in out)


def texts():
    long = " ".join(f"w{i}" for i in range(250))
    return [None, "", "x", long, long + " #", long.upper(), "a b " * 300, "A B " * 300, "a\x0bb\x1cc " * 120, "ÄÖ " * 250, long]


def test_against_plain(spark):
    kinds = texts()
    rows = [(None if i % 13 == 0 else i // 2, [None, "", "s", "hot", "hot"][i % 5], kinds[i * 7 % len(kinds)]) for i in range(160)]
    labels = [(i % 70, i % 2, i % 3 % 2) for i in range(120)] + [(None, 1, 1), (3, None, None)]
    got = a.filter_audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, got)) == plain(rows, labels)


def test_a_part_with_nothing_to_remove_has_all_rows(spark):
    rows = [(1, "s", " ".join(f"w{i}" for i in range(300)))]
    got = a.filter_audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS)).collect()
    assert len(got) == 600 and {(r.kept, r.removed, r.shapley) for r in got} == {(1, 0, 0)}


def test_many_batches_of_one_part(spark):
    """A part that spans partitions and batches, and a crowd of copies."""
    n = 30_000
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("hot").alias("source"),
        F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("only #"), F.col("id"))).alias("text"),
    ).repartition(4)
    got = a.filter_audit(docs, spark.createDataFrame([(5, 1, 1), (6, 0, 1)], LABELS))
    one = got.where("filter_order = 'EDABC'").orderBy("step").collect()
    copies, others = n // 3, n - n // 3
    assert [(r.removed, r.redundant) for r in one] == [(copies - 1, 0), (others, 0), (1, n - 1), (0, 0), (0, 0)]
    assert [(r.good_lost, r.toxic_lost) for r in one[:2]] == [(0, 1), (1, 1)]
    assert one[0].kept == others + 1 and one[2].kept == 0


def test_empty_and_clashing_columns(spark):
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert a.filter_audit(spark.createDataFrame([], SCHEMA), labels).collect() == []
    rows = [(1, "s", "x"), (2, None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    other = docs.withColumns({"part": F.lit("p"), "id": F.lit(0), "mask": F.lit(7), "meta.src": F.lit(1), "good": F.lit(True)})
    got = [sorted(map(tuple, a.filter_audit(d, labels).collect())) for d in (docs, other)]
    assert got[0] == got[1] == plain(rows, [(1, 1, 1)])


def test_words_of_long_texts():
    """A word that is longer than a piece is one word, also at the end; words that repeat across pieces are not distinct."""
    long = b"y" * (3 << 20)
    assert a.words(long) == (1, 1)
    assert a.words(b"a " + long + b" " + long + b" a") == (4, 2)
    assert a.words(b"ab cd " * 500_000) == (1_000_000, 2)
    assert a.words(b"") == a.words(b" \x0b\n") == (0, 0)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_galloping(x, y):
    a1, b1 = (np.array(sorted(s), np.int64) for s in (x, y))
    assert a.present(a1, b1).tolist() == [i in y for i in sorted(x)]
    assert a.merged(a1, b1).tolist() == sorted(x | y)


@pytest.mark.parametrize("letters", ["A", "AB", "ABC"])
def test_other_numbers_of_filters(spark, letters):
    rows = spark.createDataFrame([("p", i, i % (1 << len(letters)), i % 2 == 0, False) for i in range(40)], f"part string, {a.ROW} bigint, mask int, good boolean, toxic boolean")
    got = a.order_effects(rows, letters).collect()
    assert {r.filter_order for r in got} == {"".join(p) for p in itertools.permutations(letters)}
    for r in got:
        if r.step == len(letters):
            assert r.kept == sum(i % (1 << len(letters)) == 0 for i in range(40))

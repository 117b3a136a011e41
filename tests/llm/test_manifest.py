"""Merkle manifest against trees built plainly, and what proofs are worth."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from docweave.llm import manifest as m

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return H("".join(map(enc, (row[0], row[3], row[2], row[4], text))))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, place):
    for level in tree[:-1]:
        first = place // 8 * 8
        yield place - first, level[first : first + 8]
        place //= 8


def plain(rows):
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append(((row[0] is not None, row[0] or 0, leaf(row, row[1])), row))
    names = sorted(by, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in names:
        by[lang].sort(key=lambda x: x[0])
    trees = {lang: levels([key[2] for key, _ in by[lang]]) for lang in names}
    top = levels([trees[lang][-1][0] for lang in names])
    for k, lang in enumerate(names):
        for i, (key, row) in enumerate(by[lang]):
            steps = [*way(trees[lang], i), *way(top, k)]
            folded = key[2]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = row[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])
                folded = leaf(row, text)
            for place, run in steps:
                folded = H("".join([*run[:place], folded, *run[place + 1 :]]))
            proof = H("".join("".join(run[:place] + run[place + 1 :]) for place, run in steps))
            root = top[-1][0]
            yield row[0], key[2], trees[lang][-1][0], root, proof, folded, folded == root


def check(spark, rows):
    got = m.verify(spark.createDataFrame(rows, SCHEMA), m.tampered_leaf()).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))
    return got


ODD = [
    (None, "No id", "en", "a", 5),
    (None, None, None, None, None),
    (3, "", "", "", 0),
    (3, "", "", "", 0),
    (3, "Ä ß\n\x00 字", "zz", "é", -1),
    (-7, "X" * 100_000, "en", "a", 100_000),
    (9, "ABC", "ÿ", "a", 3),
    (10, "ABC", "\U0001f600", "a", 3),
]


def test_odd_rows(spark):
    """Nulls in any column, a lone leaf, repeated rows, a long text, languages in the order of their bytes."""
    check(spark, ODD)


@pytest.mark.parametrize("n", [1, 8, 9, 512, 513, 4097])
def test_sizes_around_blocks(spark, n):
    """Runs of one, whole blocks, and one leaf more than a block."""
    check(spark, [(i * 7 % n, f"Text {i}", "en", f"s{i % 3}", i) for i in range(n)])


def test_many_trees(spark):
    """More trees than a run, some of one leaf."""
    got = check(spark, [(i, f"T{i}", f"lang{i % 37 if i < 200 else i}", "s", i) for i in range(260)])
    assert len({r.subroot for r in got}) == 97 and len({r.root for r in got}) == 1


def test_one_id_holds_most_rows(spark):
    check(spark, [(1 if i % 3 else i, f"T{i % 50}", "en", "s", i % 50) for i in range(1500)])


def test_proofs_fold_to_the_root(spark):
    """The steps of a proof lead every leaf to the root, and no other digest."""
    rows = [(i, f"T{i}", "en" if i % 4 else None, "s", i) for i in range(600)]
    for row in m.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        steps = [s.asDict() for s in row.steps]
        assert m.fold(row.leaf, steps) == row.root
        assert m.fold(H("another"), steps) != row.root


def test_layout_and_other_columns_do_not_matter(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    other = df.withColumn("tree", F.lit("x")).withColumn("meta.src", F.lit(1)).withColumn("digest", F.lit(None).cast("string"))
    runs = [m.verify(d, m.tampered_leaf()).collect() for d in (df, other.repartition(7), df.coalesce(1))]
    assert sorted(map(repr, runs[0])) == sorted(map(repr, runs[1])) == sorted(map(repr, runs[2]))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert m.verify(empty, m.tampered_leaf()).collect() == []
    assert m.manifest(empty).columns == ["doc_id", "leaf", "subroot", "root", "steps"]

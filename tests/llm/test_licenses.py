"""Alignment against plain dynamic programming, and statements that were put into texts."""

from __future__ import annotations

import os
import random

import pytest

from docweave.llm.licenses import TEMPLATES, Scanner, align, ascending, scan_licenses, words_of

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, licenses string, statements string"


def longest(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = max([1, *(best[j] + 1 for j in range(i) if values[j] < values[i])])
    return max(best, default=0)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_ascending_is_longest():
    rng = random.Random(1)
    for _ in range(500):
        values = [rng.randrange(20) for _ in range(rng.randint(0, 15))]
        kept = [values[i] for i in ascending(values)]
        assert len(kept) == longest(values) and kept == sorted(set(kept))


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        template = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 14))]
        text = [w for w in template if rng.random() > 0.1]
        for _ in range(rng.randint(0, 3)):
            text.insert(rng.randint(0, len(text)), rng.choice("abxyz"))
        pairs = align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert len(pairs) <= common(text, template)
        if len(set(template)) == len(template) == len(set(template) & set(text)) and len(set(text)) == len(text):
            assert len(pairs) == common(text, template)


def test_planted_statements_are_found():
    rng = random.Random(3)
    scanner = Scanner(TEMPLATES)
    filler = "the of and this is under version licensed code by words to in a 2 0".split() + [f"w{i}" for i in range(300)]
    for _ in range(120):
        names = rng.sample(sorted(TEMPLATES), rng.choice([0, 1, 2, 3]))
        names += names[:1] * rng.choice([0, 1])  # the same one twice
        words, want = [], []
        for name in names:
            words += rng.choices(filler, k=rng.randint(60, 200))
            own = TEMPLATES[name].split()
            if len(own) > 15:  # a changed copy
                for _ in range(len(own) // 12):
                    own[rng.randrange(3, len(own))] = "changed"
            want.append((name, len(words_of(" ".join(words).encode()))))
            words += own
        words += rng.choices(filler, k=80)
        got = [(m.license, m.first_word) for m in scanner.scan(" ".join(words).upper().encode())]
        assert [n for n, _ in got] == [n for n, _ in want]
        assert all(abs(a - b) <= 3 for (_, a), (_, b) in zip(got, want))
        scattered = rng.sample(words, len(words))
        assert len(scanner.scan(" ".join(w for w in scattered if w in filler).encode())) == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: set(r.licenses) for r in scan_licenses(docs).collect()}
    for r in docs.collect():
        want = {n for n, t in TEMPLATES.items() if t in r.text}
        assert want == got[r.doc_id]
    assert sum(map(bool, got.values())) > 0


def test_edges(spark):
    rows = [(1, None, "", ""), (2, "", "", ""), (None, "all RIGHTS reserved", "", ""), (4, "all rights reserved " * 2000, "", ""), (4, "rights all reserved", "", "")]
    got = sorted((str(r.doc_id), r.n_statements, r.licenses) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect())
    name = ["all-rights-reserved"]
    assert got == [("1", 0, []), ("2", 0, []), ("4", 0, []), ("4", 2000, name), ("None", 1, name)]
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
    assert scan_licenses(spark.createDataFrame(rows, SCHEMA), {}).where("n_statements > 0").count() == 0

"""Decontamination against a search for every window at every word."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from docweave.llm import decontaminate
from docweave.llm.decontaminate import clean_documents, contamination

DOCS = "doc_id long, text string, shingle string, items string"
ITEMS = "item_id long, text string, doc_id string"


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items):
    out = []
    for doc_id, text, *_ in docs:
        words, hit, found = split(text), set(), set()
        for item_id, item, *_ in items:
            own = split(item)
            n = min(10, len(own))
            for s in range(len(own) - n + 1 if own else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(item_id)
        ids = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    return sorted(
        map(tuple, contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()), key=str
    )


def tables(seed):
    rng = random.Random(seed)
    pool = ["a", "b", "the", "Of", "É", "x1", "ünd", "9"]

    def text(n):
        return " ".join(rng.choice(pool) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 25])), "clash") for i in range(12)]
    items += [(12, items[5][1], "c"), (13, None, "c"), (14, "", "c"), (15, "?!", "c"), (None, text(12), "c"), (3, items[3][1], "c")]
    docs = []
    for i in range(40):
        words = split(text(rng.choice([0, 1, 5, 60, 200])))
        for _ in range(rng.choice([0, 1, 3])):
            own = split(rng.choice(items)[1] or "")
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words).title(), "clash", "clash"))
    return docs + [(None, docs[3][1], "", ""), (3, docs[3][1], "", ""), (50, None, "", ""), (51, "", "", "")], items


@pytest.mark.parametrize("seed", range(3))
def test_against_every_place(spark, seed):
    docs, items = tables(seed)
    assert run(spark, docs, items) == plain(docs, items)


def test_long_text_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{rng.randrange(50)}" for _ in range(3000)]
    docs = [(1, " ".join(words), "", "")]
    items = [(i, " ".join(words[s : s + 14]), "") for i, s in enumerate(range(0, 2980, 91))]
    whole = decontaminate.shingle_hashes([w.encode() for w in words], 3)
    monkeypatch.setattr(decontaminate, "AT_ONCE", 64)
    parts = list(decontaminate._blocks([w.encode() for w in words], 3))
    assert len(parts) > 40 and np.array_equal(np.concatenate([h for _, h in parts]), whole)
    assert [s for s, _ in parts] == list(range(0, 2998, 64))
    assert run(spark, docs, items) == plain(docs, items)


def test_clean_documents(spark):
    docs, items = tables(1)
    frame = spark.createDataFrame(docs, DOCS)
    bad = {r[0] for r in plain(docs, items) if r[5]}
    kept = clean_documents(frame, spark.createDataFrame(items, ITEMS))
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in bad)


def test_nothing(spark):
    docs, items = tables(2)
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert contamination(no_docs, spark.createDataFrame(items, ITEMS)).collect() == []
    assert {r.contaminated for r in contamination(spark.createDataFrame(docs, DOCS), no_items).collect()} == {False}
    assert clean_documents(spark.createDataFrame(docs, DOCS), no_items).count() == len(docs)

"""Links of vectors against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from docweave.llm import embeddings
from docweave.llm.embeddings import fit, linked, unit

SCHEMA = "vec_id long, embedding array<double>, links long, unit string"


def plain(rows, similarity=0.95):
    units = {}
    for n, (_, v, *_) in enumerate(rows):
        if v is not None and len(v) and None not in v and all(map(math.isfinite, v)) and any(v):
            units[n] = np.array(v) / max(map(abs, v))
            units[n] /= np.linalg.norm(units[n])
    near = {n: [] for n in range(len(rows))}
    for a in units:
        for b in units:
            if a != b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= similarity:
                near[a].append(b)
    out = []
    for n, (vec_id, *_) in enumerate(rows):
        seen, stack = {n}, [n]
        while stack:
            for b in near[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        named = [rows[b][0] for b in seen if rows[b][0] is not None]
        component = min(named) if named else None
        out.append((vec_id, len(near[n]), component, vec_id == component))
    return sorted(out, key=str)


def vectors(seed, n=150, dimension=24):
    rng = np.random.default_rng(seed)
    rows, next_id = [], 0
    for _ in range(n):
        v = rng.normal(size=dimension)
        rows.append((next_id, v.tolist(), 7, "c"))
        next_id += 1
        for _ in range(rng.integers(0, 4)):
            v = v + rng.normal(size=dimension) * rng.choice([0, 0.02, 0.2])
            rows.append((next_id, (v * rng.choice([1, 5])).tolist(), 7, "c"))
            next_id += 1
    crowd = rng.normal(size=dimension)
    for _ in range(150):
        rows.append((next_id, (crowd + rng.normal(size=dimension) * 0.05).tolist(), 7, "c"))
        next_id += 1
    odd = [None, [], [0.0] * dimension, [math.nan] * dimension, [math.inf, 1.0], [None, 1.0], [1e-300, 0.0], [2e300, 0.0], [3.0, 0.1]]
    rows += [(1000 + i, v, 7, "c") for i, v in enumerate(odd)]
    return rows + [(None, rows[0][1], 7, "c"), rows[1], rows[1], (None, [-5.0, 1.0], 1, "c")]


@pytest.mark.parametrize("cell,block", [(embeddings.CELL, embeddings.BLOCK), (32, 48)])
def test_against_all_pairs(spark, cell, block):
    rows = vectors(3)
    got = sorted(map(tuple, linked(spark.createDataFrame(rows, SCHEMA), cell=cell, block=block).collect()), key=str)
    want = plain(rows)
    if cell == embeddings.CELL:
        assert got == want
    links, found = sum(w[1] for w in want), sum(g[1] for g in got)
    assert 0.98 * links <= found <= links and [g[0] for g in got] == [w[0] for w in want]


def test_recall_at_the_threshold():
    """Pairs at exactly the threshold, the hardest, meet and pass the count."""
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(2000, 64))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    model = fit(sample, 60_000)
    assert model.cuts == 6 and model.count > 8
    aside = rng.normal(size=sample.shape)
    aside -= (aside * sample).sum(axis=1, keepdims=True) * sample
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    partners = 0.95001 * sample + math.sqrt(1 - 0.95001**2) * aside
    meet = (model.cells(sample) == model.cells(partners)).any(axis=1)
    apart = np.abs((sample - partners) @ model.lines(64))
    passed = (apart <= model.window).sum(axis=1) >= model.count
    assert (meet & passed).mean() > 0.98


def test_unit_and_nothing(spark):
    assert np.allclose(np.frombuffer(unit([3e200, 4e200])), [0.6, 0.8])
    assert unit([0.0, -0.0]) is None
    assert linked(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(1, None, 1, "")], SCHEMA)
    assert list(map(tuple, linked(none).collect())) == [(1, 0, 1, True)]

"""Near-duplicate vectors by counting collisions in sorted one-dimensional projections.

Vectors are projected on many random lines. On one line, two vectors collide if one lies in the
window centred at the other. Pairs above the similarity collide on more lines than others, so the
count tells which pairs are worth an exact cosine. Windows and the count that is asked for are
calibrated on a bounded sample: each sampled vector is given a partner at exactly the threshold, and
the count is the largest that nearly all these pairs reach.

Comparing everyone with everyone does not scale, so pairs are counted inside cells. A table cuts some
lines in the middle, and vectors on the same side of all its cuts share a cell. The number of cuts
grows with the logarithm of the number of vectors, which keeps cells small, and the number of tables
follows from the measured chance that a pair at the threshold shares a cell. A pair counts in the first table where it meets.
Cells that are large nevertheless (a crowd of near copies) are cut into blocks, and every pair of
blocks is a group of its own.

A group returns, for each of its vectors, how many links it has there and the least vector it
is connected to there: as many rows as vectors, never the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import materialise
from docweave.llm.components import components

SIMILARITY = 0.95
#: Share of the pairs at the threshold that must pass the count, and that must meet in some table.
RECALL_COUNT, RECALL_TABLES = 0.998, 0.995
#: Lines on which collisions are counted. Windows reach as far as a pair at the threshold is apart on average.
LINES = 32
#: On the line by which a cell is sorted, the window is so many times as wide.
WIDE = 4.0
#: Vectors that a cell is meant to hold, and that a block of a large cell holds at most.
CELL, BLOCK = 1_024, 4_096
#: Vectors that cuts and counts are calibrated on, at most.
SAMPLE = 10_000
#: Vectors compared at once with those in their windows.
AT_ONCE = 128


@dataclass(frozen=True)
class Projections:
    """What a fit gives: cuts per table, tables, where the lines are cut, the count, the similarity."""

    cuts: int
    tables: int
    middles: np.ndarray
    count: int
    similarity: float

    def lines(self, dimension: int) -> np.ndarray:
        return np.random.default_rng(dimension).normal(size=(dimension, LINES)).astype(np.float32)

    def cut_lines(self, dimension: int) -> np.ndarray:
        return np.random.default_rng(dimension + 1_000_003).normal(size=(dimension, self.cuts * self.tables))

    def cells(self, units: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table."""
        if not self.cuts:
            return np.zeros((len(units), self.tables), np.int64)
        middles = self.middles if len(self.middles) == self.cuts * self.tables else 0.0
        sides = (units @ self.cut_lines(units.shape[1]) > middles).reshape(len(units), self.tables, self.cuts)
        return sides.astype(np.int64) @ (np.int64(1) << np.arange(self.cuts, dtype=np.int64))

    @property
    def window(self) -> float:
        return float(np.sqrt(2 - 2 * self.similarity))


def unit(vector) -> bytes | None:
    """A vector scaled to length one in double precision, as bytes; None if it has no direction."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    values = np.array(vector, np.float64)
    most = np.abs(values).max()
    if not np.isfinite(most) or most == 0:
        return None
    values = values / most
    return (values / np.sqrt(values @ values) + 0.0).tobytes()


def _collisions(a: np.ndarray, b: np.ndarray, window: float) -> np.ndarray:
    """On how many lines each row of a collides with each row of b."""
    counts = np.zeros((len(a), len(b)), np.uint8)
    for line in range(a.shape[1]):
        counts += np.abs(a[:, line, None] - b[None, :, line]) <= window
    return counts


def fit(sample: np.ndarray, total: int, similarity: float = SIMILARITY) -> Projections:
    """Choose cuts, tables and count for ``total`` vectors from a sample of them."""
    cuts = max(0, int(np.ceil(np.log2(max(1, total) / CELL))))
    if not len(sample):
        return Projections(0, 1, np.zeros(0), 0, similarity)
    rng = np.random.default_rng(1)
    aside = rng.normal(size=sample.shape)
    aside -= (aside * sample).sum(axis=1, keepdims=True) * sample
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    partners = similarity * sample + np.sqrt(1 - similarity**2) * aside
    probe = Projections(cuts, 1, np.zeros(0), 0, similarity)
    lines = probe.lines(sample.shape[1])
    apart = np.abs((sample - partners) @ lines)
    passed = np.sort(np.where(apart[:, 0] <= WIDE * probe.window, (apart <= probe.window).sum(axis=1), 0))
    count = int(passed[int(len(passed) * (1 - RECALL_COUNT))])
    tables = 1
    if cuts:
        many = Projections(cuts, 8, np.zeros(0), 0, similarity)
        middles = np.median(sample @ many.cut_lines(sample.shape[1]), axis=0)
        many = Projections(cuts, 8, middles, 0, similarity)
        meet = float((many.cells(sample) == many.cells(partners)).mean())
        tables = int(np.ceil(np.log(1 - RECALL_TABLES) / np.log(1 - min(max(meet, 1e-3), 0.999))))
    middles = np.median(sample @ Projections(cuts, tables, np.zeros(0), 0, similarity).cut_lines(sample.shape[1]), axis=0)
    return Projections(cuts, tables, middles, count, similarity)


def _root(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a with b: the least number each is connected to."""
    while True:
        least = np.minimum(labels[a], labels[b])
        after = labels.copy()
        for side in (a, b):
            np.minimum.at(after, side, least)
            np.minimum.at(after, labels[side], least)
        after = after[after]
        if np.array_equal(after, labels):
            return labels
        labels = after


def compare(units: np.ndarray, cells: np.ndarray, copies: np.ndarray, part: np.ndarray, table: int, model: Projections):
    """Links and roots within one group: positions of ``units`` that are connected, and links weighed by copies.

    ``part`` is 0 or 1; if both occur, only pairs of unlike parts are compared.
    """
    both = bool(part.any()) and not bool(part.all())
    lines = units.astype(np.float32) @ model.lines(units.shape[1])
    order = np.argsort(lines[:, 0], kind="stable")
    units, cells, weight, part, lines = units[order], cells[order], copies[order], part[order], lines[order]
    links, labels = np.zeros(len(units), np.int64), np.arange(len(units))
    for start in range(0, len(units), AT_ONCE):
        end = min(len(units), start + AT_ONCE)
        far = int(np.searchsorted(lines[:, 0], lines[end - 1, 0] + WIDE * model.window, "right"))
        near = _collisions(lines[start:end], lines[start:far], model.window) >= model.count
        near &= np.arange(far - start)[None, :] > np.arange(end - start)[:, None]
        if both:
            near &= part[start:end, None] != part[None, start:far]
        a, b = np.nonzero(near)
        a, b = a + start, b + start
        for some in range(0, len(a), 1 << 17):
            i, j = a[some : some + (1 << 17)], b[some : some + (1 << 17)]
            alike = np.einsum("ij,ij->i", units[i], units[j]) >= model.similarity
            i, j = i[alike], j[alike]
            first = (cells[i] == cells[j]).argmax(axis=1) == table
            i, j = i[first], j[first]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            labels = _root(labels, i, j) if len(i) else labels
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return links[back], order[labels][back]


def linked(vectors: DataFrame, similarity: float = SIMILARITY, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of
    different lengths do not link. Copies are one vector with a weight until the end, and each row
    counts the other rows it links with. Rows with one id are rows of their own; a null id never
    names a component unless there is no other. Other columns are not read; an empty table gives an empty result.
    """
    kind = dict(vectors.dtypes)["vec_id"]

    def scaled(batches):
        for batch in batches:
            units = [unit(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary())], names=["vec_id", "unit"])

    rows = materialise(vectors.select("vec_id", "embedding").mapInArrow(scaled, f"vec_id {kind}, unit binary"), "units")
    distinct = rows.where("unit is not null").groupBy("unit").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-units")
    total = distinct.count()
    picked = distinct.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE).toArrow().column("unit").to_pylist()
    usual = max({len(u) for u in picked}, key=[len(u) for u in picked].count, default=0)
    sample = np.array([np.frombuffer(u) for u in picked if len(u) == usual]).reshape(-1, max(1, usual // 8))
    model = fit(sample, total * CELL // cell, similarity)

    def dealt(batches):
        for batch in batches:
            units = batch.column(2).to_pylist()
            cells = [model.cells(np.frombuffer(u)[None])[0] for u in units]
            for table in range(model.tables):
                here = [int(c[table]) for c in cells]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), batch.column(2),
                        pa.array([c.tobytes() for c in cells], pa.binary()),
                        pa.array([len(u) for u in units], pa.int32()),
                        pa.array([table] * len(here), pa.int32()),
                        pa.array(here, pa.int64()),
                    ],
                    names=["node", "copies", "unit", "cells", "size", "table", "cell"],
                )

    schema = "node long, copies long, unit binary, cells binary, size int, table int, cell long"
    placed = distinct.select("node", "copies", "unit").mapInArrow(dealt, schema)
    key = ["size", "table", "cell"]
    large = placed.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > block)
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("own")).alias("first"), F.greatest(o, F.col("own")).alias("second")),
    )
    grouped = (
        placed.join(large, key, "left")
        .withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("pair", F.explode(others))
        .select("node", "copies", "unit", "cells", *key, "pair.first", "pair.second", (F.col("own") != F.col("pair.first")).cast("int").alias("part"))
    )

    def group(t: pa.Table) -> pa.Table:
        nodes = t.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")
        units = np.array([np.frombuffer(u) for u in t.column("unit").to_pylist()])[order]
        cells = np.array([np.frombuffer(c, np.int64) for c in t.column("cells").to_pylist()])[order]
        copies, part = t.column("copies").to_numpy()[order], t.column("part").to_numpy()[order]
        nodes = nodes[order]
        links, roots = compare(units, cells, copies, part, t.column("table")[0].as_py(), model)
        held = links > 0
        return pa.table({"node": nodes[held], "links": links[held], "root": nodes[roots[held]]})

    found = grouped.groupBy(*key, "first", "second").applyInArrow(group, "node long, links long, root long")
    found = materialise(found, "linked-units")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("component", "root")
    named = distinct.join(joined, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(heads, "root").select("unit", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return rows.join(materialise(named, "named-units"), "unit", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

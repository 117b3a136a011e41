"""Merkle manifest of a dataset, by time-forward processing.

A node's label is its tree, its level and its place; a parent's label is greater than those of its children. The
upward sweep takes nodes in the order of their labels and sends each digest forward, to its parent's label, in a
priority queue. That queue is external: inside a block of ``BLOCK`` consecutive nodes it is a heap, and between
blocks it is a table of the blocks' roots, which Spark sorts by label for the next round. The reversed sweep takes
labels in descending order and sends every node what its parent knows of the way to the root, so
leaves receive the rest of their proofs and nobody looks a node up.

A round divides the number of nodes by ``BLOCK``, so 10^11 leaves take five rounds; no task holds more than a block.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.names import quoted
from docweave.llm.common import is_remainder, materialise
from docweave.llm.running import running_totals

#: Children of a node.
FAN = 8
#: Levels that one task climbs, and the nodes below a block's root.
LEVELS = 3
BLOCK = FAN**LEVELS

#: The columns that a leaf covers, in their order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Characters of a digest.
WIDTH = 64
#: Of the documents whose id has a crc32 that this divides, the text is tampered with.
TAMPERED = 3

_NODES = "tree string, place bigint, digest string"
_STEPS = "array<struct<place:int,run:string>>"
_WAYS = f"tree string, place bigint, steps {_STEPS}, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def climb(digests: Sequence[str], whole: bool, levels: int = LEVELS) -> list[list[str]]:
    """The digests of every level of a block, from the given one up.

    A ``whole`` tree ends at its single node; another block is one of several, and ends ``levels`` above.
    Nodes wait in a heap ordered by (level, place); when all children of a parent have been taken, its digest
    is sent forward to the parent's label.
    """
    tree: list[list[str]] = [[]]
    queue = [(0, place, own) for place, own in enumerate(digests)]  # in order, and so a heap
    size, children = len(queue), []
    while queue:
        level, place, own = heapq.heappop(queue)
        if level == len(tree):
            tree.append([])
            size = -(-size // FAN)
        tree[level].append(own)
        children.append(own)
        if len(children) == FAN or place == size - 1:
            if level < levels and not (whole and size == 1):
                heapq.heappush(queue, (level + 1, place // FAN, digest("".join(children))))
            children = []
    return tree


def ways(tree: Sequence[Sequence[str]], above: list[dict]) -> list[list[dict]]:
    """For each node of the lowest level its steps up to the root: its place in its run, and the run's digests.

    Labels are taken from the top down, beginning with the way ``above`` the block, and each node passes its own way on
    to its children.
    """
    sent = [above]
    for level in reversed(tree[:-1]):
        runs = ["".join(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        sent = [[{"place": i % FAN, "run": runs[i // FAN]}, *sent[i // FAN]] for i in range(len(level))]
    return sent


def siblings(steps: Sequence[dict]) -> str:
    """The digests that a proof consists of: those of each run without the node's own."""
    return "".join(s["run"][: WIDTH * s["place"]] + s["run"][WIDTH * s["place"] + WIDTH :] for s in steps)


def fold(leaf: str, steps: Sequence[dict]) -> str:
    """The root that a leaf and its proof lead to."""
    for s in steps:
        leaf = digest(s["run"][: WIDTH * s["place"]] + leaf + s["run"][WIDTH * s["place"] + WIDTH :])
    return leaf


def _up(block: pa.Table) -> pa.Table:
    block = block.sort_by("place")
    number = block.column("place")[0].as_py() // BLOCK
    top = climb(block.column("digest").to_pylist(), whole=number == 0)[-1]
    return pa.table({"tree": block.column("tree")[:1], "place": [number], "digest": top})


def _blocks(nodes: DataFrame):
    return nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).cast("bigint").alias("block"))


def _rounds(nodes: DataFrame, purpose: str) -> list[DataFrame]:
    """The nodes that the upward sweep starts from, and those that every round ends with, up to one for each tree."""
    rounds = [nodes]
    while rounds[-1].agg(F.max("place")).first()[0]:
        below = rounds[-1].select("tree", "place", "digest")
        rounds.append(materialise(_blocks(below).applyInArrow(_up, _NODES), f"{purpose}-round"))
    return rounds


def _way_columns(block: pa.Table, steps: list, subroot: str, root: str) -> dict:
    kind = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.string())]))
    n = len(steps)
    return {"steps": pa.array(steps, kind), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n)}


def _proof_columns(block: pa.Table, steps: list, subroot: str, root: str) -> dict:
    n = len(steps)
    folded = [fold(own, way) for own, way in zip(block.column("given").to_pylist(), steps)]
    return {
        "subroot": pa.array([subroot] * n),
        "root": pa.array([root] * n),
        "proof_sha256": pa.array([digest(siblings(way)) for way in steps]),
        "folded_root": pa.array(folded),
        "verified": pa.array([own == root for own in folded]),
    }


def _sweep_down(
    nodes: DataFrame, sent: DataFrame, columns: Callable = _way_columns, kept: Sequence[str] = ("tree", "place"), schema: str = _WAYS
) -> DataFrame:
    """Deliver the ways of block roots to the nodes of their blocks."""

    def run(block: pa.Table, root: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        tree = climb(block.column("digest").to_pylist(), whole=block.column("place")[0].as_py() < BLOCK)
        steps = ways(tree, root.column("steps")[0].as_py())
        subroot, top = root.column("subroot")[0].as_py(), root.column("root")[0].as_py()
        return pa.table({name: block.column(name) for name in kept} | columns(block, steps, subroot, top))

    blocks = sent.groupBy("tree", F.col("place").alias("block"))
    return _blocks(nodes).cogroup(blocks).applyInArrow(run, schema)


def _down(rounds: Sequence[DataFrame], sent: DataFrame, purpose: str) -> DataFrame:
    """Ways of the nodes that the second of ``rounds`` and later ones ended with."""
    for nodes in reversed(rounds[1:-1]):
        sent = materialise(_sweep_down(nodes, sent), f"{purpose}-ways")
    return sent


def _leaves(docs: DataFrame, order: str, tree: str, columns: Sequence[str], given: Column | None) -> DataFrame:
    """place, tree, digest, given and id of every row."""
    own = leaf_digest([F.col(quoted(c)) for c in columns])
    name = F.col(quoted(tree))
    rows = docs.select(
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name.cast("string"))).alias("tree"),
        F.col(quoted(order)).alias("id"),
        own.alias("digest"),
        (own if given is None else given).alias("given"),
        F.lit(1).cast("bigint").alias("one"),
    )
    counted = running_totals(rows, "tree", [F.col("id").asc_nulls_first(), F.col("digest")], ["one"], "leaves")
    return materialise(counted.withColumnRenamed("before_one", "place").drop("one"), "manifest-leaves")


def _trees(spark: SparkSession, subroots: DataFrame) -> DataFrame:
    """The way from every tree's root to the root of all."""
    one = subroots.select(F.col("tree").alias("of"), "digest", F.lit(1).cast("bigint").alias("one"), F.lit("").alias("tree"))
    ranked = running_totals(one, "tree", [F.col("of")], ["one"], "trees")
    ranked = materialise(ranked.select("tree", F.col("before_one").alias("place"), "digest", "of"), "manifest-trees")
    rounds = _rounds(ranked, "trees")
    top = rounds[-1].select("tree", "place", F.array().cast(_STEPS).alias("steps"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    if len(rounds) > 1:
        top = _sweep_down(ranked.select("tree", "place", "digest"), _down(rounds, top, "trees"))
    named = ranked.select("place", F.col("of").alias("named"), F.col("digest").alias("own"))
    joined = top.join(named, "place")
    return joined.select(
        F.col("named").alias("tree"), F.lit(0).cast("bigint").alias("place"), "steps", F.col("own").alias("subroot"), "root"
    )


def _swept(docs: DataFrame, order: str, tree: str, columns: Sequence[str], given: Column | None) -> tuple[DataFrame, DataFrame]:
    leaves = _leaves(docs, order, tree, columns, given)
    rounds = _rounds(leaves, "leaves")
    sent = materialise(_trees(docs.sparkSession, rounds[-1].select("tree", "place", "digest")), "manifest-ways")
    return leaves, _down(rounds, sent, "leaves")


def manifest(docs: DataFrame, order: str = "doc_id", tree: str = "lang", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """A row for every row of ``docs``: ``order``, leaf, subroot, root, and the steps of its proof.

    There is a tree for each value of ``tree``, whose leaves ascend by ``order``, nulls first; rows of one
    value are ordered by their digests, and equal rows are leaves of equal digests beside each other. Nulls in any
    column, and texts of any length, have a digest of their own. An empty table has no rows and no root. Other
    columns are not read.
    """
    leaves, sent = _swept(docs, order, tree, columns, None)
    kind = leaves.schema["id"].dataType.simpleString()
    schema = f"id {kind}, digest string, steps {_STEPS}, subroot string, root string"
    rows = _sweep_down(leaves, sent, _way_columns, ("id", "digest"), schema)
    return rows.select(F.col("id").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "steps")


def verify(
    docs: DataFrame, given: Column, order: str = "doc_id", tree: str = "lang", columns: Sequence[str] = COLUMNS
) -> DataFrame:
    """A row for every row of ``docs``: ``order``, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``given`` is the leaf digest that is put to the proof of the stored row: another than the row's own leads to another
    root. Rows are as those of :func:`manifest`.
    """
    leaves, sent = _swept(docs, order, tree, columns, given)
    kind = leaves.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, digest string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    rows = _sweep_down(leaves, sent, _proof_columns, ("id", "digest"), schema)
    return rows.withColumnsRenamed({"id": order, "digest": "leaf"})


def tampered_leaf(columns: Sequence[str] = COLUMNS, text: str = "text", order: str = "doc_id") -> Column:
    """The leaf digest with the ASCII letters of ``text`` in lower case where ``TAMPERED`` divides the crc32 of the id."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    lowered = F.translate(F.col(quoted(text)), upper, upper.lower())
    changed = leaf_digest([lowered if c == text else F.col(quoted(c)) for c in columns])
    own = leaf_digest([F.col(quoted(c)) for c in columns])
    return F.when(is_remainder(order, TAMPERED, 0), changed).otherwise(own)

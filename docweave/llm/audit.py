"""Filter interaction audit over sorted posting lists.

Each filter has a posting list of the rows that fail it, in ascending order, for every part and range of rows. What a
filter removes after others is the difference of its list and the union of theirs; all unions and differences come from
galloping merges of these lists, range by range, and the sizes are summed. With n filters there are 2^n unions and
n * 2^(n-1) differences whatever the number of orders, so the orders are read off the sums.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.names import quoted
from docweave.llm.common import as_bytes, materialise, pieces
from docweave.llm.running import ROW

#: The filters of the query, and what their conditions compare.
LETTERS = "ABCDE"
LEAST_WORDS = 200
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"
#: Bytes that go on a character that another byte began.
INNER = bytes(range(0x80, 0xC0))
SPACE = b" \t\n\r\x0b\x0c"

REPEATED = 1 << 4
_FLAGS = "part string, id {kind}, digest binary, mask int, `" + ROW + "` bigint"
_COUNTS = "part string, filter int, before int, n bigint, good bigint, toxic bigint"


def words(text: bytes) -> tuple[int, int]:
    """Words and distinct words of a text, in memory for its distinct words and one piece."""
    n, seen, rest = 0, set(), b""
    for piece in pieces(text):
        own = (rest + piece).split()
        # The last word may go on in the next piece.
        rest = own.pop() if own and piece[-1:] not in SPACE else b""
        n += len(own)
        seen.update(own)
    if rest:
        n += 1
        seen.add(rest)
    return n, len(seen)


def failures(text: bytes) -> int:
    """Which of the first four filters a text fails, as bits: short, repetitive, shouting, symbols."""
    n, distinct = words(text)
    upper = len(text) - len(text.translate(None, UPPER))
    characters = len(text.translate(None, INNER))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (n < LEAST_WORDS) | (100 * distinct < 50 * n) << 1 | (100 * upper > 2 * characters) << 2 | (symbols > 0) << 3


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, masks = [], []
        for text in as_bytes(batch.column("text")):
            text = text or b""
            digests.append(sha256(text).digest())
            masks.append(failures(text))
        columns = [batch.column("part"), batch.column("id"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, batch.column(ROW)], ["part", "id", "digest", "mask", ROW])


def present(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of the ascending ``ids`` are in the ascending ``among``, by galloping through the longer list."""
    if len(ids) <= len(among):
        at = np.minimum(np.searchsorted(among, ids), len(among) - 1)
        return among[at] == ids
    at = np.searchsorted(ids, among)
    there = at < len(ids)
    found = np.zeros(len(ids), bool)
    found[at[there]] = ids[at[there]] == among[there]
    return found


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two ascending lists: what the shorter has more is put in its places in the longer."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    new = short[~present(short, long)]
    return np.insert(long, np.searchsorted(long, new), new)


def interactions(lists: Sequence[np.ndarray], marked: Sequence[np.ndarray]) -> Iterator[tuple]:
    """(filter, before, removed, and how many of these are in each list of ``marked``), where there are any.

    ``before`` has a bit for each filter that was applied before.
    """
    unions = [np.zeros(0, np.int64)]
    for subset in range(1, 1 << len(lists)):
        highest = subset.bit_length() - 1
        unions.append(merged(unions[subset ^ (1 << highest)], lists[highest]))
    for subset, union in enumerate(unions):
        for number, own in enumerate(lists):
            if not subset >> number & 1 and len(own):
                removed = own[~present(own, union)]
                if len(removed):
                    yield number, subset, len(removed), *[int(present(removed, m).sum()) for m in marked]


def _audit(filters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # in the order of part and row
            if not batch.num_rows:
                continue
            parts = batch.column("part")
            cuts = [0, *(np.flatnonzero(pc.not_equal(parts[1:], parts[:-1]).to_numpy(zero_copy_only=False)) + 1), len(parts)]
            rows, mask = batch.column(ROW).to_numpy(), batch.column("mask").to_numpy()
            good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))
            out = []
            for start, end in itertools.pairwise(cuts):
                ids, bits = rows[start:end], mask[start:end]
                lists = [ids[bits >> number & 1 == 1] for number in range(filters)]
                part, marked = parts[start].as_py(), [ids[good[start:end]], ids[toxic[start:end]]]
                out.append((part, -1, 0, end - start, *map(len, marked)))
                out += [(part, *row) for row in interactions(lists, marked)]
            names = ["part", "filter", "before", "n", "good", "toxic"]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def order_effects(rows: DataFrame, letters: str) -> DataFrame:
    """One row per part, order and step of ``rows(part, __row, mask, good, toxic)``; see :func:`filter_audit`.

    ``mask`` has a bit for each filter that a row fails. Rows are put in ranges by part and number, so a part that holds most
    of the table is spread over the tasks, and a task holds lists of one Arrow batch.
    """
    n = len(letters)
    ranged = rows.repartitionByRange("part", ROW).sortWithinPartitions("part", ROW)
    counts = ranged.mapInArrow(_audit(n), _COUNTS).groupBy("part", "filter", "before")
    counts = counts.agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # At most n * 2^(n-1) sums and the number of rows, for each part.
    entry = F.struct((F.col("filter") * (1 << n) + F.col("before")).alias("key"), F.struct("n", "good", "toxic").alias("value"))
    sums = counts.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("filter") >= 0, entry))).alias("sums"),
        F.max(F.when(F.col("filter") < 0, F.col("n"))).alias("rows"),
    )
    orders = [
        {"name": "".join(letters[i] for i in order), "steps": [{"f": f, "b": sum(1 << e for e in order[:k])} for k, f in enumerate(order)]}
        for order in itertools.permutations(range(n))
    ]
    given = F.from_json(F.lit(json.dumps(orders)), "array<struct<name:string,steps:array<struct<f:int,b:int>>>>")

    def size(filter, before, field: str = "n"):
        return F.coalesce(F.try_element_at("sums", filter * (1 << n) + before)[field], F.lit(0).cast("bigint"))

    def shapley(f):
        # In so many orders exactly these filters come before.
        subsets = [(s, math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())) for s in range((1 << n) - 1)]
        weighed = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).cast("bigint").alias("w")) for s, w in subsets])
        return F.aggregate(weighed, F.lit(0).cast("bigint"), lambda acc, x: acc + x["w"] * size(f, x["s"]))

    others = F.array(*[F.lit((1 << n) - 1 - (1 << f)) for f in range(n)])

    def effects(step, place):
        f, before = step["f"], step["b"]
        removed, failing = size(f, before), size(f, F.lit(0))
        return F.struct(
            (place + 1).alias("step"),
            removed.alias("removed"),
            (failing - removed).alias("redundant"),
            size(f, F.get(others, f)).alias("unique_fails"),
            size(f, before, "good").alias("good_lost"),
            size(f, before, "toxic").alias("toxic_lost"),
            shapley(f).alias("shapley"),
        )

    expanded = sums.select("part", "sums", "rows", F.explode(given).alias("o"))
    steps = expanded.select("part", "rows", F.col("o")["name"].alias("filter_order"), F.transform(F.col("o")["steps"], effects).alias("steps"))
    gone = F.aggregate(F.slice("steps", 1, F.col("s")["step"]), F.lit(0).cast("bigint"), lambda acc, x: acc + x["removed"])
    out = steps.select("part", "rows", "filter_order", "steps", F.explode("steps").alias("s"))
    return out.select("part", "filter_order", F.col("s")["step"].alias("step"), (F.col("rows") - gone).alias("kept"), *[
        F.col("s")[c].alias(c) for c in ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    ])


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What each of five filters does in every order, for each value of ``part``.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. All orders
    and steps of a part that has rows are there, zeros included.

    A null or empty part is the empty one, a null text an empty one. Every row counts, repeated ones too. A row without
    an id has no smaller one, and no other row has it as a smaller one; rows of one id are not smaller than each
    other. An id that is labelled several times has a label if one of them says so. Texts of any
    length are counted whole. An empty table gives no rows. Other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(
        F.coalesce(F.col(quoted(part)).cast("string"), F.lit("")).alias("part"), F.col("doc_id").alias("id"), "text",
        F.monotonically_increasing_id().alias(ROW),
    )
    flagged = materialise(rows.mapInArrow(_flag, _FLAGS.format(kind=kind)), "audit-flags")
    copies = flagged.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    copies = materialise(copies.where("copies > 1").select(F.col("digest").alias("own"), "first"), "audit-copies")
    named = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled"))
    marks = named.agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    marks = materialise(marks.where("good or toxic"), "audit-labels")
    repeated = F.when(F.col("first") < F.col("id"), F.lit(REPEATED)).otherwise(0)
    joined = flagged.join(copies, flagged["digest"] == copies["own"], "left")
    joined = joined.select("part", "id", (F.col("mask") + repeated).alias("mask"), ROW)
    joined = joined.join(marks, joined["id"] == marks["labelled"], "left")
    marked = joined.select("part", ROW, "mask", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    return order_effects(marked, LETTERS)

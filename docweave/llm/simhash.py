"""Near-duplicates by SimHash, found by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits of each other meet at a variant half-way. A step of one bit
changes the parity of a fingerprint, which tells who has to walk how far:

* an even fingerprint emits its 64 neighbours at one bit;
* an odd one emits itself, its 64 neighbours, and those neighbours at two bits where both bits
  lie in the same half of the fingerprint. Of three differing bits two lie in one half, so an
  odd and an even fingerprint at three bits always meet. Two of equal parity differ by two bits
  and meet at one bit from each.

That is 1057 variants for an odd and 64 for an even fingerprint, where a plain ball of radius
two has 2081. Everyone at a variant is linked to the nearest one there, so a variant gives one
link less than it has visitors and never all pairs, and no connection is lost: whoever is
nearest is within 3 bits of all others, unless all are two bits away, and those meet elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.names import quoted
from docweave.llm.common import as_bytes, materialise
from docweave.llm.components import components

RADIUS = 3
BITS = 64
SEED = 42
SHINGLE = 3
#: Shingles hashed at once, so a text of any length takes the same memory.
SHINGLES_AT_ONCE = 1 << 16
#: Fingerprints expanded at once, and variants that one bucket is meant to hold.
FINGERPRINTS_AT_ONCE = 1024
VARIANTS_PER_BUCKET = 1 << 20


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number; no words (or no text) give zero.

    Words are runs without white space, of lower-cased ASCII letters. A bit is set if more than half
    of the shingles, repeats included, have it set in their XXH64.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
        total = len(words) - size + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    counts = np.zeros(BITS, np.int64)
    for start in range(0, total, SHINGLES_AT_ONCE):
        h = np.fromiter(hashes, np.uint64, min(SHINGLES_AT_ONCE, total - start))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, print (the 64 bits as a signed long): a row for every row of ``docs``."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches):
        for batch in batches:
            prints = np.fromiter(map(fingerprint, as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"]
            )

    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, print long")


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """Bit patterns that lead to the variants, and how many bits each flips; the first 64 flip one."""
    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    two = [a | b for half in (one[:32], one[32:]) for i, a in enumerate(half) for b in half[:i]]
    masks = np.concatenate([one, np.zeros(1, np.uint64), np.array(two, np.uint64)])
    return masks, np.bitwise_count(masks).astype(np.uint8)


MASKS, STEPS = _masks()
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _emit(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and mask number of all variants of some distinct fingerprints."""
    odd = np.bitwise_count(prints) % 2 == 1
    even, odd = prints[~odd], prints[odd]
    numbers = np.arange(len(MASKS), dtype=np.uint16)
    owners = np.concatenate([np.repeat(even, BITS), np.repeat(odd, len(MASKS))])
    return owners, np.concatenate([np.tile(numbers[:BITS], len(even)), np.tile(numbers, len(odd))])


def _meet(owners: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the visitors of the same variant and the nearest of them, verified, each once."""
    variants = owners ^ MASKS[numbers]
    order = np.argsort(variants, kind="stable")
    variants = variants[order]
    same = variants[1:] == variants[:-1]
    shared = np.zeros(len(variants), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order, variants = order[shared], variants[shared]
    if not len(order):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    steps, visitors = STEPS[numbers[order]], owners[order]
    nearest = np.lexsort((visitors, steps, variants))
    variants, steps, visitors = variants[nearest], steps[nearest], visitors[nearest]
    first = np.concatenate([[True], variants[1:] != variants[:-1]])
    hubs = visitors[np.flatnonzero(first)[np.cumsum(first) - 1]]
    links = ~first & (np.bitwise_count(hubs ^ visitors) <= RADIUS)
    hubs, visitors = hubs[links], visitors[links]
    pairs = np.unique(np.stack([np.minimum(hubs, visitors), np.maximum(hubs, visitors)], axis=1), axis=0)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def links(prints: DataFrame, count: int) -> DataFrame:
    """src, dst: links between distinct fingerprints (column ``print``, ``count`` rows) that connect all within 3 bits.

    Variants are dealt to buckets by a hash of the variant; the number of buckets grows with the
    number of fingerprints, so a bucket has the same size at any scale. A variant has
    at most 1122 visitors, whatever the number of documents, as fingerprints are distinct.
    """
    average = (BITS + len(MASKS)) / 2
    buckets = max(1, int(count * average / VARIANTS_PER_BUCKET) + 1)

    def emit(batches):
        for batch in batches:
            column = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(column), FINGERPRINTS_AT_ONCE):
                owners, numbers = _emit(column[start : start + FINGERPRINTS_AT_ONCE])
                spread = ((owners ^ MASKS[numbers]) * _SPREAD) >> np.uint64(32)
                bucket = (spread % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, owners, numbers = bucket[order], owners[order], numbers[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cuts[:-1]], pa.int32()),
                        pa.array([owners[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([numbers[a:b].tobytes() for a, b in spans], pa.binary()),
                    ],
                    names=["bucket", "owners", "masks"],
                )

    def meet(group: pa.Table) -> pa.Table:
        owners = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group.column("owners")])
        numbers = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in group.column("masks")])
        src, dst = _meet(owners, numbers)
        return pa.table({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    variants = prints.select("print").mapInArrow(emit, "bucket int, owners binary, masks binary")
    return variants.groupBy("bucket").applyInArrow(meet, "src long, dst long")


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row for every row of ``docs``.

    component_id is the least id that is reachable by links of 3 or fewer differing bits. Copies share
    a fingerprint and are reduced to it before anything is paired. A null or empty text, and one of
    white space only, has fingerprint zero and is linked like any other. A null id gives a row with a
    null id, and never names a group unless all ids of the group are null. Repeated rows stay
    repeated. An empty table gives an empty result. Other columns are not read.
    """
    rows = materialise(fingerprints(docs, id_column, text_column), "prints")
    distinct = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    found = components(links(distinct, distinct.count())).toDF("print", "component")
    named = distinct.join(found, "print", "left").withColumn("component", F.coalesce("component", "print"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(heads, "component").select("print", "component_id"), "named-prints")
    return rows.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their group: one document of each, with all its columns.

    Rows with a null id stay, as nothing can name them; repeated ids count as one document.
    """
    groups = simhash_groups(docs, id_column, text_column)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(gone, id_column, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])

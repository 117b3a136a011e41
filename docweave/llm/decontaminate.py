"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of consecutive words; a window is the set of its shingles with their
positions. Containment must be whole, so of a window's shingles, ordered by rarity over all
documents, one is a necessary prefix: a document holds the window only if it holds the rarest
shingle. Only this shingle is joined. Its place in the window says where the window must begin and
end in the document (position and length bounds), and the words there are then compared one by one.

Documents are read twice: once to count the shingles that windows hold, once to look for the
rarest. What a task must know beforehand is a bitmap of shingle hashes, whose size is bounded whatever the
benchmark's size; hashes that are in it by accident fail in the join or at the comparison.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.names import quoted
from docweave.llm.common import as_bytes, materialise

#: Words in a window, and in a shingle; an item shorter than a window is one window.
WINDOW = 10
SHINGLE = 3
#: Bits in the bitmap of shingle hashes: many for each shingle, and 16 MB at most.
LEAST_BITS, MOST_BITS, BITS_PER_SHINGLE = 1 << 18, 1 << 27, 1024
#: Copies of a window by the remainder of the row number, so a passage in a third of all rows is dealt to as many keys.
SALTS = 32
#: Words handled at once, so a text of any length takes bounded memory beside itself.
AT_ONCE = 1 << 18

#: Words are runs of digits, ASCII letters (lower-cased) and all above ASCII.
_WORD = bytes(
    b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_ROUND = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * _ROUND
    return values ^ (values >> np.uint64(32))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words, the same in every process."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(crc32, words), np.uint64, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out * _ROUND + one[i : i + len(out)])
    return out


def _blocks(words: list[bytes], size: int):
    """First position and shingle hashes, for a bounded number of words at a time."""
    for start in range(0, max(0, len(words) - size + 1), AT_ONCE):
        yield start, shingle_hashes(words[start : start + AT_ONCE + size - 1], size)


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, words, place, size, shingle: every shingle of every window of every item, hashed.

    Items without words have no windows. A repeated item repeats its windows.
    """
    kind = dict(items.dtypes)["item_id"]

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = words_of(text)
                for start in range(max(1, len(words) - WINDOW + 1) if words else 0):
                    window = words[start : start + WINDOW]
                    size = min(SHINGLE, len(window))
                    for place, shingle in enumerate(shingle_hashes(window, size).view(np.int64).tolist()):
                        rows.append((item, b" ".join(window), len(window), place, size, shingle))
            columns = list(zip(*rows)) or [()] * 6
            types = [batch.schema.field(0).type, pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["item_id", "words", "length", "place", "size", "shingle"],
            )

    schema = f"item_id {kind}, words binary, length int, place int, size int, shingle long"
    return items.select("item_id", "text").mapInArrow(run, schema)


class Bitmap:
    """Which hashes may be among some others. Its size follows their number up to a fixed bound."""

    def __init__(self, shingles: DataFrame, count: int):
        bits = LEAST_BITS
        while bits < min(MOST_BITS, count * BITS_PER_SHINGLE):
            bits *= 2
        self.mask = np.uint64(bits - 1)
        mask = int(self.mask)

        def run(batches):  # at most as many numbers as the bitmap has words leave a task
            own = np.zeros(bits // 64, np.uint64)
            for batch in batches:
                at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(mask)
                np.bitwise_or.at(own, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            held = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.astype(np.int32)), pa.array(own[held].view(np.int64))], names=["at", "bits"]
            )

        words = shingles.select("shingle").mapInArrow(run, "at int, bits long")
        rows = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words = np.zeros(bits // 64, np.uint64)
        self.words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        held = self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
        return np.flatnonzero(held)


def _counts(docs: DataFrame, bitmap, sizes: list[int]) -> DataFrame:
    """shingle, n: how often the bitmap's shingles occur in all documents, summed in each batch before the shuffle."""

    def run(batches):
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in as_bytes(batch.column(0)):
                words = words_of(text)
                for size in sizes:
                    for _, hashes in _blocks(words, size):
                        found.append(hashes[bitmap.value.positions(hashes)])
            shingles, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, bitmap, sizes: list[int]) -> DataFrame:
    """row, doc_id, n_words, found: places in each document where a necessary shingle may stand, with the words around."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            counts, found = [], []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                places = []
                for size in sizes:
                    for start, hashes in _blocks(words, size):
                        for i in bitmap.value.positions(hashes).tolist():
                            at, before = start + i, min(start + i, WINDOW - size)
                            around = b" ".join(words[at - before : at + WINDOW])
                            places.append({"shingle": int(hashes[i : i + 1].view(np.int64)[0]), "at": at, "before": before, "around": around})
                counts.append(len(words))
                found.append(places)
            item = pa.struct([("shingle", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.binary())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(item))], names=["doc_id", "n_words", "found"]
            )

    schema = f"doc_id {kind}, n_words long, found array<struct<shingle: long, at: long, before: int, around: binary>>"
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    return rows.withColumn("row", F.monotonically_increasing_id())


def _verified(found: DataFrame) -> DataFrame:
    """The candidates whose words at the window's place are the window's words."""
    first = F.col("before") - F.col("place")
    words = F.split(F.col("around").cast("string"), " ", -1)
    fits = (first >= 0) & (F.size(words) >= first + F.col("length"))
    same = F.concat_ws(" ", F.slice(words, first + 1, F.col("length"))) == F.col("words").cast("string")
    return found.where(F.when(fits, same).otherwise(False))


def benchmark_hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, n_words) and occurrences (row, start, length, window, items).

    ``row`` numbers the rows of ``docs``, so repeated and null ids stay apart. items are the distinct ids of
    the items that have the window, sorted as strings.
    """
    windows = materialise(item_windows(items), "windows")
    sizes = [r.size for r in windows.select("size").distinct().orderBy("size").collect()]
    shingles = windows.select("shingle").distinct()
    spark = docs.sparkSession
    every = spark.sparkContext.broadcast(Bitmap(shingles, shingles.count()))
    counts = _counts(docs, every, sizes)
    rarest = Window.partitionBy("words").orderBy(F.coalesce("n", F.lit(0)), "shingle", "place")
    held = windows.groupBy("words", "length", "place", "size", "shingle").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    keys = materialise(
        held.join(counts, "shingle", "left").withColumn("order", F.row_number().over(rarest)).where("order = 1").drop("order", "n"),
        "rarest-shingles",
    )
    needed = keys.select("shingle").distinct()
    bitmap = spark.sparkContext.broadcast(Bitmap(needed, needed.count()))
    read = materialise(_candidates(docs, bitmap, sizes), "candidates")
    places = read.select("row", F.explode("found").alias("f")).select("row", "f.*").withColumn("salt", F.col("row") % SALTS)
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    hits = _verified(places.join(salted, ["shingle", "salt"])).select(
        "row", (F.col("at") - F.col("place")).alias("start"), "length", "words", "items"
    )
    return read.select("row", "doc_id", "n_words"), materialise(hits, "occurrences")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for every row of ``docs``.

    n_hit counts the words inside any occurrence of a window, each once. A null text has no words, nor has
    an empty one; items without words match nothing; a null item id has no name among the items. Null and
    repeated document ids keep a row each. Other columns are not read. An empty table of documents gives
    an empty result, an empty benchmark no hits.
    """
    rows, hits = benchmark_hits(docs, items)
    spans = hits.select("row", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = (
        spans.withColumn("new", F.greatest(F.col("end") - covered, F.lit(0)))
        .groupBy("row")
        .agg(F.sum("new").alias("n_hit"))
    )
    named = (
        hits.select("row", "items").distinct().select("row", F.explode("items").alias("item")).distinct()
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        rows.join(hit.join(named, "row", "left"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.

    Rows are told apart by their id, and those without one by their text; rows that share an id share a fate.
    """
    key = "_key" + "_" * max(map(len, docs.columns))
    named = F.concat(F.lit("id "), F.col("doc_id").cast("string"))
    keyed = docs.withColumn(key, F.coalesce(named, F.sha2(F.coalesce("text", F.lit("")), 256)))
    judged = contamination(keyed.select(F.col(key).alias("doc_id"), "text"), items)
    return keyed.join(judged.where("contaminated").select(F.col("doc_id").alias(key)), key, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])

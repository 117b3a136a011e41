"""Language identification by rank-order profiles of letter n-grams.

A profile is the list of the most frequent n-grams (one to three letters, word boundaries
included) of a language, most frequent first. A document has such a list too; the language whose
profile is least out of place, summed over the document's n-grams, is the answer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import as_bytes, pieces

UNKNOWN = "und"
#: Length of a profile, and of a document's own list. An n-gram that a profile lacks counts as this far out of place.
RANKS = 300
#: Documents of each language that its profile is learned from, at most.
MOST_EXAMPLES = 1_000
#: Bytes of a text whose n-grams are counted at once.
AT_ONCE = 1 << 18
#: Bits of a character in the code of an n-gram, and what stands for a boundary: no character has this number.
BITS, BOUNDARY = 21, 0x110000
#: Bits of a hash by which ids are counted to find the first ones.
BUCKET_BITS = 12


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point that of its letter in lower case, or the boundary."""
    out = np.full(0x110000, BOUNDARY, np.uint32)
    for point in range(0x110000):
        character = chr(point)
        if character.isalpha():
            out[point] = ord(character.lower()[0])
    return out


def ngrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a whole text and how often each occurs.

    A code is the n-gram's own characters, 21 bits each, so different n-grams of any script have different codes.
    """
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    table, edge = letters(), np.array([BOUNDARY], np.uint32)
    for piece in pieces(text, AT_ONCE):
        points = np.frombuffer(piece.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        s = np.concatenate([edge, table[points], edge]).astype(np.int64)
        inside = s != BOUNDARY
        kept = np.concatenate([[True], inside[1:] | inside[:-1]])
        s, inside = s[kept], inside[kept]
        two = s[:-1] << BITS | s[1:]
        three = two[:-1] << BITS | s[2:]
        found = np.concatenate([s[inside], two[inside[:-1] | inside[1:]], three[inside[1:-1]]])
        more, n = np.unique(found, return_counts=True)
        if len(codes):
            more, at = np.unique(np.concatenate([codes, more]), return_inverse=True)
            n = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
        codes, counts = more, n
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent codes, most frequent first; ties go to the lesser code."""
    return codes[np.lexsort((codes, -counts))[:RANKS]]


@dataclass(frozen=True)
class Profiles:
    """Languages in the order of their names, the codes of all profiles in ascending order, and ranks[language, place of the
    code]; the last column is for codes that no profile has."""

    languages: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray

    def identify(self, text: bytes | None) -> tuple[str, float]:
        """The language and how well it fits: 1 for the profile itself, 0 if no n-gram is in it.

        Ties go to the first name. Text that is null or has no letter is ``und`` with score 0, and
        so is any text when no language was learned.
        """
        codes, counts = ngrams(text or b"")
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(codes, counts)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = self.ranks[:, np.where(self.codes[at] == own, at, len(self.codes))]
        places = np.abs(ranks.astype(np.int64) - np.arange(len(own)))
        apart = np.where(ranks == RANKS, RANKS, places).sum(axis=1)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (RANKS * len(own)))


def first_ids(ids: DataFrame, most: int) -> DataFrame:
    """(doc_id, lang) of the first ``most`` ids of each language in the order of a hash of the id.

    Ids are counted by the first bits of their hash; only those of the buckets that hold the first ones are put in order, which
    are few, however many partitions and rows there are.
    """
    bucket = F.shiftright(F.xxhash64("doc_id"), 64 - BUCKET_BITS)
    numbered = ids.withColumn("bucket", bucket)
    before = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("lang", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    needed = counts.where(F.col("before") < most).select("lang", "bucket")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = numbered.join(F.broadcast(needed.groupBy("lang").agg(F.max("bucket").alias("last"))), "lang").where("bucket <= last")
    few = few.groupBy("lang", "doc_id").agg(F.count("*").alias("n"))
    return few.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).select("doc_id", "lang")


def fit_profiles(docs: DataFrame, most: int = MOST_EXAMPLES) -> Profiles:
    """Learn a profile for every non-null ``lang`` of ``docs(doc_id, text, lang)``.

    From each language at most ``most`` documents are read, first in the order of a hash of the id; texts
    that are null do not count. Languages have to be few enough for their profiles to fit a worker.
    """
    sample = first_ids(docs.where("lang is not null and doc_id is not null").select("doc_id", "lang"), most)
    texts = docs.select("doc_id", "lang", "text").where("text is not null").join(F.broadcast(sample), ["doc_id", "lang"])

    def count(batches):
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                codes, n = ngrams(text)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(codes), "code": pa.array(codes, pa.int64()), "n": pa.array(n, pa.int64())})

    frequent = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    counted = texts.select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    profile = (
        counted.groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
        .withColumn("place", F.row_number().over(frequent) - 1)
        .where(F.col("place") < RANKS)
        .collect()
    )
    languages = tuple(sorted({r.lang for r in profile}))
    codes = np.unique(np.array([r.code for r in profile], np.int64))
    ranks = np.full((len(languages), len(codes) + 1), RANKS, np.int16)
    for r in profile:
        ranks[languages.index(r.lang), np.searchsorted(codes, r.code)] = r.place
    return Profiles(languages, codes, ranks)


def identify_languages(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score: a row for every row of ``docs``, from the whole text alone.

    Null ids and repeated rows are passed on; other columns are not read; an empty table gives an
    empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for batch in batches:
            found = [shared.value.identify(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_languages(docs: DataFrame, profiles: Profiles, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for batch in batches:
            found = [shared.value.identify(t) for t in as_bytes(batch.column("text"))]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

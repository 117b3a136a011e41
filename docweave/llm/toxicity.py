"""Toxicity by the nearest labelled examples, under exact TF-IDF cosine.

Terms are words and the beginnings of words. The vocabulary holds every term of the labelled examples;
document frequencies are counted over all documents. Examples are found through a block-max inverted index:
similar ones share a block, the largest weights of its terms bound their cosines, and blocks that
cannot hold a neighbour are passed over. What is left is scored in single precision; examples that its rounding cannot tell
from the nearest ones are compared again in double precision, so the result is that of exact cosines with all examples. One task
makes the index and writes its arrays into the shared folder; workers map them into memory and hold none of their own.

Near examples vote with weights that fall with their distance. The votes that the examples themselves
get from the others are turned into shares by isotonic regression, which calibrates the score.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import CLEANUP, as_bytes, labelled, mounted_folder, one_text_each, pieces
from docweave.sources.documents import setting

#: Labelled examples of label 1 and of label 0, at most.
MOST_TOXIC, MOST_OTHER = 4_000, 12_000
#: Lengths in characters of the beginnings of words that are terms of their own.
PREFIXES = (4, 5, 6)
NEIGHBOURS = 16
#: Examples in a block, examples that the others are put in order by, and blocks whose examples give the first k-th best cosine.
BLOCK, LEADERS, TRIED = 16, 64, 2
#: Texts whose bounds are found at once, and those of them that share a pass over blocks.
AT_ONCE, GROUP = 256, 32
#: Postings of a term in more than this share of the examples are dense.
COMMON = 1 / 9
#: Words of which a worker remembers the terms.
REMEMBERED = 1 << 18
CUT = 0.3

#: Bytes that belong to words are digits, ASCII letters and all above ASCII.
_WORD = bytes(
    b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> Counter:
    """How often each lower-case word occurs in a whole text."""
    counts: Counter = Counter()
    for piece in pieces(text or b""):
        counts.update(piece.translate(_WORD).split())
    return counts


def terms_of(word: bytes) -> list[bytes]:
    """A word and, marked by a star, its beginnings that are shorter than it."""
    if word.isascii():
        return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]
    characters = word.decode("utf-8", "replace")
    return [word, *(characters[:n].encode() + b"*" for n in PREFIXES if len(characters) > n)]


#: Numbers of terms in order, and their weights.
Vector = tuple[np.ndarray, np.ndarray]


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places in some ranges, the length of each range, and where each begins among the places."""
    lengths = ends - starts
    cuts = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - cuts, lengths), lengths, cuts


def _joined(array: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The values in some ranges, one after the other; for few long ranges faster than taking all their places."""
    return np.concatenate([array[:0], *map(array.__getitem__, map(slice, starts.tolist(), ends.tolist()))])


#: What a saved index consists of.
_ARRAYS = (
    *("starts", "terms", "weights", "examples", "column", "dense", "dense_most"),
    *("pairs", "posted_at"),
)


class Index:
    """Weighted examples behind a block-max inverted index. ``rows`` are dictionaries or vectors.

    Examples that are alike stand together, ``BLOCK`` of them in a block, and a block knows the largest weights of its
    terms. Rare terms are summed for all examples by their postings; the largest of these sums in a block and the block's
    largest weights of common terms bound its cosines, so the common terms, which hold most products, are passed over
    in blocks whose bound is below the k-th best cosine that is known already.
    """

    def __init__(self, rows: Iterable[dict[int, float] | Vector], n_terms: int):
        terms, weights, ends = array("i"), array("d"), [0]
        for r in rows:
            own, weight = (sorted(r), [r[t] for t in sorted(r)]) if isinstance(r, dict) else r
            terms.frombytes(np.asarray(own, np.int32).tobytes())
            weights.frombytes(np.asarray(weight, float).tobytes())
            ends.append(len(terms))
        self.size, self.n_terms = len(ends) - 1, n_terms
        self.starts = np.array(ends, np.int64)
        self.terms, self.weights = np.array(terms, np.int32, copy=False), np.array(weights, float, copy=False)
        self._ready = False

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("size", "n_terms", "starts", "terms", "weights")} | {"_ready": False}

    def save(self, folder: str) -> None:
        """Write the arrays; a task that is run again replaces them by the same."""
        if not self._ready:
            self._prepare()
        for name in _ARRAYS:
            part = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with open(part, "wb") as file:
                np.save(file, getattr(self, name))
            os.replace(part, f"{folder}/{name}.npy")

    @classmethod
    def mapped(cls, folder: str) -> Index:
        """An index that was saved, whose arrays stay in their files."""
        index = cls.__new__(cls)
        for name in _ARRAYS:
            path = f"{folder}/{name}.npy"
            array = np.load(path, mmap_mode="r")
            setattr(index, name, array.view(np.ndarray))
        index.size, index.n_terms = len(index.starts) - 1, len(index.column)
        index.blocks = len(index.dense)
        pairs = index.pairs.base
        index.posted, index.posted_weights = pairs.view(np.int32)[::2].view(np.ndarray), pairs.view(np.float32)[1::2].view(np.ndarray)
        index._query = np.zeros(index.n_terms)
        index._ready = True
        return index

    def row(self, example: int) -> Vector:
        a, b = self.starts[example], self.starts[example + 1]
        return self.terms[a:b], self.weights[a:b]

    def _prepare(self) -> None:
        """The blocks, made where they are used.

        Of examples with the same vector no more than the first ``NEIGHBOURS`` and one can be among the nearest;
        the others are left out here. Terms that many examples hold have dense postings: a matrix of the
        weights and one of the blocks' largest.
        """
        copies: Counter = Counter()
        held = np.zeros(self.size, bool)
        for example in range(self.size):
            key = hashlib.blake2b(b"".join(x.tobytes() for x in self.row(example)), digest_size=16).digest()
            copies[key] += 1
            held[example] = copies[key] <= NEIGHBOURS + 1
        self.examples = self._alike(np.flatnonzero(held))
        n = len(self.examples)
        self.blocks = -(-n // BLOCK)
        places, lengths, _ = _spans(self.starts[self.examples], self.starts[self.examples + 1])
        terms, weights = self.terms[places], self.weights[places].astype(np.float32)
        del places
        number = np.repeat(np.arange(n, dtype=np.int32), lengths)
        common = np.flatnonzero(np.bincount(terms, minlength=self.n_terms) > max(4 * BLOCK, COMMON * n))
        self.column = np.full(self.n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        dense = self.column[terms] >= 0
        self.dense = np.zeros((self.blocks, BLOCK, len(common)), np.float32)
        self.dense.reshape(self.blocks * BLOCK, len(common))[number[dense], self.column[terms[dense]]] = weights[dense]
        self.dense_most = self.dense.max(axis=1)
        terms, weights, number = terms[~dense], weights[~dense], number[~dense]
        order = np.argsort(terms, kind="stable")
        terms, self.pairs = terms[order], np.empty(len(terms), np.int64)
        #: A posting's example and weight share eight bytes, so a list is taken at once.
        self.posted, self.posted_weights = self.pairs.view(np.int32)[::2], self.pairs.view(np.float32)[1::2]
        self.posted[:], self.posted_weights[:] = number[order], weights[order]
        del order, number, weights
        self.posted_at = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=self.n_terms))])
        block = self.posted // BLOCK
        first = np.ones(len(terms), bool)
        first[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
        begins = np.flatnonzero(first)
        #: For each rare term and block that holds it: the block and the largest weight, a bound that needs no postings.
        self.entry_block = block[begins]
        self.entry_most = np.maximum.reduceat(self.posted_weights, begins) if len(begins) else np.zeros(0, np.float32)
        self.at = np.concatenate([[0], np.cumsum(np.bincount(terms[begins], minlength=self.n_terms))])
        self._query = np.zeros(self.n_terms)
        self._ready = True

    def _alike(self, examples: np.ndarray) -> np.ndarray:
        """The examples in an order that puts those next to each other that are nearest to the same leader."""
        places, lengths, _ = _spans(self.starts[examples], self.starts[examples + 1])
        terms = self.terms[places]
        order = np.argsort(terms, kind="stable")
        posted = np.repeat(np.arange(len(examples), dtype=np.int32), lengths)[order]
        weights = self.weights[places][order].astype(np.float32)
        del places, order
        at = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=self.n_terms))])
        leader, best = np.zeros(len(examples), np.int32), np.full(len(examples), -1.0)
        for i, example in enumerate(examples[:: max(1, len(examples) // LEADERS)].tolist()):
            own, weight = self.row(example)
            found, lengths, _ = _spans(at[own], at[own + 1])
            scores = np.bincount(posted[found], np.repeat(weight, lengths) * weights[found], len(examples))
            leader[scores > best] = i
            best = np.maximum(best, scores)
        return examples[np.lexsort((-best, leader))]

    def nearest_of(self, queries: list[Vector], k: int, without: list[int] | None = None) -> Iterator[list[tuple[int, float]]]:
        """For each query the k examples of largest positive cosine, best first, ties by number; exact."""
        if k > NEIGHBOURS:
            raise ValueError(f"at most {NEIGHBOURS} neighbours")
        if not self._ready:
            self._prepare()
        for start in range(0, len(queries), AT_ONCE):
            some = queries[start : start + AT_ONCE]
            left_out = [-1] * len(some) if without is None else without[start : start + AT_ONCE]
            across = np.zeros((len(some), len(self.dense_most.T)), np.float32)
            for i, (terms, weights) in enumerate(some):
                column = self.column[terms]
                across[i, column[column >= 0]] = weights[column >= 0]
            bounds = across @ self.dense_most.T
            found: list = [[]] * len(some)
            # queries whose best blocks are near each other need much the same blocks
            alike = np.argsort(bounds.argmax(axis=1), kind="stable") if self.blocks else np.arange(0)
            for at in range(0, len(alike), GROUP):
                group = alike[at : at + GROUP]
                best = self._best_of([some[i] for i in group], across[group], bounds[group], k, [left_out[i] for i in group])
                for i, near in zip(group, best):
                    found[i] = near
            yield from found

    def _best_of(self, queries: list[Vector], across: np.ndarray, bounds: np.ndarray, k: int, without: list[int]) -> Iterator[list[tuple[int, float]]]:
        """The nearest of a few queries: sums of rare terms, bounds of all blocks, then the blocks that they leave."""
        rows, columns = self.blocks * BLOCK, across.shape[1]
        dense = self.dense.reshape(rows, columns)
        least = np.zeros(len(queries))
        needed = np.zeros(bounds.shape, bool)
        sums = []
        for i, (terms, weights) in enumerate(queries):
            rare = self.column[terms] < 0
            begins, ends = self.posted_at[terms[rare]], self.posted_at[terms[rare] + 1]
            pairs = _joined(self.pairs, begins, ends)
            products = np.repeat(weights[rare], ends - begins) * pairs.view(np.float32)[1::2]
            sums.append(np.bincount(pairs.view(np.int32)[::2], products, rows).astype(np.float32))
            bounds[i] += sums[i].reshape(-1, BLOCK).max(axis=1)
            first = np.argpartition(-bounds[i], TRIED)[:TRIED] if self.blocks > TRIED else np.arange(self.blocks)
            tried = (first[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            tried = tried[tried < len(self.examples)]
            tried = tried[self.examples[tried] != without[i]]
            known = sums[i][tried] + dense[tried] @ across[i]
            # a sum of n products of numbers rounded once is wrong by less than n + 3 units in the last place
            slack = 2 * (len(terms) + 3) * 2.0**-23
            if len(known) >= k:
                least[i] = max(0.0, np.partition(known, len(known) - k)[len(known) - k] - slack)
            needed[i] = (bounds[i] > 0) & (bounds[i] * (1 + slack) >= least[i] - slack)
        union = np.flatnonzero(needed.any(axis=0))
        if 2 * len(union) > self.blocks:  # the whole matrix is not copied
            union = np.arange(self.blocks)
            scores = across @ dense.T
        else:
            scores = across @ self.dense[union].reshape(len(union) * BLOCK, columns).T
        for i, query in enumerate(queries):
            own = scores[i]
            own += sums[i] if len(union) == self.blocks else sums[i].reshape(-1, BLOCK)[union].ravel()
            # both the k-th best and an example may be wrong by their rounding
            slack = 2 * (len(query[0]) + 3) * 2.0**-23
            near = np.flatnonzero((own > 0) & (own >= least[i] - slack))
            near = near[self.examples[union[near // BLOCK] * BLOCK + near % BLOCK] != without[i]]
            if len(near) > k:
                near = near[own[near] >= np.partition(own[near], len(near) - k)[len(near) - k] - slack]
            examples = self.examples[union[near // BLOCK] * BLOCK + near % BLOCK]
            exact = self._cosines(examples, query)
            order = np.lexsort((examples, -exact))[:k]
            yield [(int(e), min(1.0, float(c))) for e, c in zip(examples[order], exact[order]) if c > 0]

    def _cosines(self, examples: np.ndarray, query: Vector) -> np.ndarray:
        """Exact cosines, in double precision."""
        terms, weights = query
        starts, ends = self.starts[examples], self.starts[examples + 1]
        lengths = ends - starts
        cuts = np.cumsum(lengths) - lengths
        out = np.zeros(len(examples))
        some = lengths > 0
        if some.any():
            self._query[terms] = weights
            held = self._query.take(_joined(self.terms, starts, ends))
            out[some] = np.add.reduceat(_joined(self.weights, starts, ends) * held, cuts[some])
            self._query[terms] = 0
        return out

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[int, float]]:
        """The k examples of largest positive cosine, best first, ties by number; exact. ``without`` is left out."""
        terms = np.array(sorted(query), np.int32)
        return next(self.nearest_of([(terms, np.array([query[t] for t in terms.tolist()]))], k, [without]))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing means of y by x: places and values to interpolate between."""
    places, at = np.unique(x, return_inverse=True)
    total = np.bincount(at, weight)
    mean = np.bincount(at, weight * y) / total
    groups: list[list[float]] = []
    for place, m, w in zip(places, mean, total):
        groups.append([m, w, place, place])
        while len(groups) > 1 and groups[-2][0] >= groups[-1][0]:
            m2, w2, _, last = groups.pop()
            m1, w1, first, _ = groups[-1]
            groups[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last]
    edges = np.array([p for g in groups for p in (g[2], g[3])])
    return edges, np.repeat([g[0] for g in groups], 2)


def _packed(counted: Vector) -> bytes:
    terms, counts = counted
    return zlib.compress(np.stack([np.diff(terms, prepend=0), counts]).astype("<i4").tobytes(), 1)


def _unpacked(row: bytes) -> Vector:
    steps, counts = np.frombuffer(zlib.decompress(row), "<i4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), counts


class _Numbers(dict):
    """Numbers of the vocabulary's terms that a word gives, four bytes each; the last words are remembered."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = array("i", [n for n in map(self.vocabulary.get, terms_of(word)) if n is not None]).tobytes()
        return found


@dataclass(frozen=True)
class Examples:
    """Vocabulary, idf, the folder of the index, labels and ids of the examples."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray
    folder: str | None
    labels: np.ndarray
    ids: list

    def __getstate__(self):
        return {k: self.__dict__[k] for k in self.__dataclass_fields__}

    @cached_property
    def numbers(self) -> _Numbers:
        return _Numbers(self.vocabulary)

    @cached_property
    def index(self) -> Index:
        """The saved one, mapped; without examples an empty one."""
        return Index.mapped(self.folder) if self.folder else Index([], len(self.vocabulary))

    def counts(self, texts: Iterable[bytes | None]) -> Iterator[Vector]:
        """The vocabulary's terms in each text and how often each occurs."""
        numbers = self.numbers
        for text in texts:
            own = words(text)
            found = list(map(numbers.__getitem__, own))
            terms = np.frombuffer(b"".join(found), np.int32)
            lengths = np.fromiter(map(len, found), np.int64, len(own)) // terms.itemsize
            times = np.repeat(np.fromiter(own.values(), np.int64, len(own)), lengths)
            kinds, at = np.unique(terms, return_inverse=True)
            yield kinds, np.bincount(at, times, len(kinds))

    def vectors(self, texts: Iterable[bytes | None]) -> Iterator[Vector]:
        """Unit TF-IDF weights of each text's vocabulary terms; empty if it has none."""
        yield from map(self.weighed, self.counts(texts))

    def weighed(self, counted: Vector) -> Vector:
        terms, counts = counted
        weights = (1 + np.log(counts)) * self.idf[terms]
        return terms, weights / np.sqrt((weights * weights).sum()) if len(terms) else weights


@dataclass(frozen=True)
class Model:
    """The examples, which workers share, and the calibration: places of votes and the shares there."""

    examples: Broadcast
    places: np.ndarray
    shares: np.ndarray


def unit(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    weights = {t: (1 + np.log(n)) * idf[t] for t, n in sorted(counts.items())}
    norm = np.sqrt(sum(w * w for w in weights.values()))
    return {t: float(w / norm) for t, w in weights.items()} if norm else {}


def vote(near: list[tuple[int, float]], labels: np.ndarray) -> float:
    """Share of label 1 among the near examples, each weighed by its cosine over its distance; none give 0.

    One more vote against, of the weight of an example half-way, keeps a few far examples from deciding.
    """
    weights = [cosine / (1.05 - cosine) for _, cosine in near]
    return sum(w for w, (example, _) in zip(weights, near) if labels[example] == 1) / (sum(weights) + 1)


def fit_examples(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``labels(doc_id, toxic)``; document frequencies come from all of ``docs``.

    Labels that are neither 0 nor 1, null ids, and ids without a document are not learned from. An id of several
    documents teaches one of their texts. Null and empty texts are examples without terms. Texts of any length are read
    whole. Empty tables teach nothing. Without any example of both labels every score is the share of label 1.
    """
    with setting(docs.sparkSession, CLEANUP, "true"):
        return _fitted(docs, labels)


def _fitted(docs: DataFrame, labels: DataFrame) -> Model:
    context = docs.sparkSession.sparkContext
    known = labels.where("doc_id is not null and toxic in (0, 1)")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = labelled(known, "toxic", 1, MOST_TOXIC).union(labelled(known, "toxic", 0, MOST_OTHER))
    texts = one_text_each(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    held = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    one, zero = held.get(1, 0), held.get(0, 0)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if not one or not zero:
        flat = np.array([share if counts else 0.0] * 2)
        nothing = Examples({}, np.zeros(0), None, np.zeros(0, int), [])
        return Model(context.broadcast(nothing), np.array([0.0, 1.0]), flat)

    def distinct(batches):
        for batch in batches:
            own = set(chain.from_iterable(map(words, as_bytes(batch.column(0)))))
            yield pa.RecordBatch.from_pydict({"term": pa.array({t for w in own for t in terms_of(w)}, pa.binary())})

    chosen = texts.select("text").mapInArrow(distinct, "term binary").distinct().toArrow().column("term").to_pylist()
    vocabulary = {term: i for i, term in enumerate(sorted(chosen))}
    del chosen
    counter = context.broadcast(Examples(vocabulary, np.zeros(0), None, np.zeros(0, int), []))
    idf = _idf(docs, counter, len(vocabulary))

    def counted(batches):
        for batch in batches:
            rows = [_packed(c) for c in counter.value.counts(as_bytes(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "packed"])

    kind = dict(docs.dtypes)["doc_id"]
    found = texts.mapInArrow(counted, f"doc_id {kind}, label int, packed binary")
    weigher, size = Examples({}, idf, None, np.zeros(0, int), []), len(vocabulary)
    folder = mounted_folder(docs.sparkSession, "toxicity-index")

    def write_index(batches):
        kept = []

        def rows():
            for batch in batches:
                kept.append(batch.select(["doc_id", "label"]))
                for row in batch.column(2):
                    yield weigher.weighed(_unpacked(row.as_py()))

        Index(rows(), size).save(folder)
        yield from kept

    # the sample is bounded, so one task can hold it
    ordered = found.repartition(1).sortWithinPartitions("doc_id", "label", "packed")
    kept = ordered.mapInArrow(write_index, f"doc_id {kind}, label int").toArrow()
    y = kept.column("label").to_numpy()
    fitted = Examples(vocabulary, idf, folder, y, kept.column("doc_id").to_pylist())
    counter.unpersist()
    shared = context.broadcast(fitted)

    def votes(batches):
        own = shared.value
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            near = own.index.nearest_of([own.index.row(i) for i in numbers], NEIGHBOURS, numbers)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "vote": pa.array([vote(n, own.labels) for n in near], pa.float64())})

    own = docs.sparkSession.range(len(y)).mapInArrow(votes, "id long, vote double").toArrow().sort_by("id").column("vote").to_numpy()
    weight = np.where(y == 1, share / one, (1 - share) / zero)
    places, shares = isotonic(own, y.astype(float), weight)
    return Model(shared, places, shares)


def _idf(docs: DataFrame, shared: Broadcast, size: int) -> np.ndarray:
    """Inverse document frequencies of the vocabulary, counted over all documents."""

    def count(batches):
        seen, total = np.zeros(size, np.int64), 0
        for batch in batches:
            for terms, _ in shared.value.counts(as_bytes(batch.column(0))):
                total += 1
                seen[terms] += 1
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(np.append(there, -1), pa.int32()), "n": np.append(seen[there], total)}
        )

    found = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    terms, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    counts = np.zeros(size, np.int64)
    counts[terms[terms >= 0]] = n[terms >= 0]
    return np.log((1 + n[terms < 0].sum()) / (1 + counts)) + 1


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, evidence: a row for every row of ``docs``, from the whole text alone.

    evidence holds ids and cosines of the examples that voted, nearest first. A text without any
    term of the examples (null and empty ones too) has no neighbours and gets the share of label 1 among
    such examples. Null ids and repeated rows are passed on; other columns are not read; an empty table
    gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared, places, shares = model.examples, model.places, model.shares
    schema = f"doc_id {kind}, score double, predicted int, evidence array<struct<example: {kind}, cosine: double>>"

    def run(batches):
        fitted = shared.value
        for batch in batches:
            item = pa.list_(pa.struct([("example", batch.schema.field(0).type), ("cosine", pa.float64())]))
            vectors = fitted.vectors(as_bytes(batch.column(1)))
            done = 0
            while some := list(islice(vectors, AT_ONCE)):
                near = list(fitted.index.nearest_of(some, NEIGHBOURS))
                score = np.interp([vote(n, fitted.labels) for n in near], places, shares)
                evidence = [[{"example": fitted.ids[e], "cosine": c} for e, c in n] for n in near]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(some)), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32)), pa.array(evidence, item)],
                    names=["doc_id", "score", "predicted", "evidence"],
                )
                done += len(some)

    return docs.select("doc_id", "text").mapInArrow(run, schema)

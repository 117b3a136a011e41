"""Quality classifier: Bradley-Terry ranking of documents, learned from preference pairs.

A pair holds a document of label 1 and one of label 0. The chance that the first is preferred is
the logistic function of the difference of their scores, and a score is linear in features of the
whole text, so learning is logistic loss on feature differences. The threshold is the score
quantile that leaves as many training documents below it as carry label 0.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from docweave.llm.common import as_bytes, labelled, materialise, one_text_each, pieces

#: Labelled documents of each label that the classifier is fitted on, at most.
MOST_EXAMPLES = 8_000
#: Preference pairs drawn from them.
PAIRS = 80_000
#: The score that stands for the threshold.
CUT = 0.3
RIDGE = 1e-3

#: The class of a byte. Space, line end, lower case, upper case, digit, sentence mark, other mark, above ASCII.
CLASSES = 8


def _classes() -> np.ndarray:
    table = np.full(256, 6, np.uint8)
    table[[9, 11, 12, 32]] = 0
    table[[10, 13]] = 1
    table[ord("a") : ord("z") + 1] = 2
    table[ord("A") : ord("Z") + 1] = 3
    table[ord("0") : ord("9") + 1] = 4
    table[[ord(c) for c in ".,;:'\"()-?"]] = 5
    table[128:] = 7
    return table


_CLASS = _classes()
N_FEATURES = CLASSES * CLASSES + 6


class _Distinct:
    """How many different values there are in a few sets, by 64-bit hashes once there is more than one set."""

    def __init__(self):
        self.first: set[bytes] | None = None
        self.hashes = np.zeros(0, np.uint64)

    def add(self, values: set[bytes]) -> None:
        if self.first is None:
            self.first = values
            return
        for some in (self.first, values):
            self.hashes = np.union1d(self.hashes, np.fromiter(map(xxh3_64_intdigest, some), np.uint64, len(some)))
        self.first = set()

    def __len__(self) -> int:
        return len(self.hashes) or len(self.first or ())


def features(text: bytes | None, piece_bytes: int = 1 << 20) -> np.ndarray:
    """Features of a whole text: how classes of bytes follow each other, repetition, lengths.

    A text is read in pieces, and no feature depends on where it is cut, but that a word of more than
    ``piece_bytes`` counts as several. Besides a piece, memory holds eight bytes for each different word and line.
    """
    text = text or b""
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    words = repeated = lines = longest = read = 0
    distinct, distinct_lines = _Distinct(), _Distinct()
    last_word, last_kind = None, np.zeros(0, np.uint8)
    open_line: list[bytes] = []
    for piece in pieces(text, piece_bytes):
        kinds = np.concatenate([last_kind, _CLASS[np.frombuffer(piece, np.uint8)]])
        last_kind = kinds[-1:]
        pairs += np.bincount(kinds[:-1] * np.uint8(CLASSES) + kinds[1:], minlength=CLASSES * CLASSES)
        own = piece.split()
        repeated += sum(map(operator.eq, own, own[1:])) + bool(own and own[0] == last_word)
        last_word = own[-1] if own else last_word
        words += len(own)
        distinct.add(set(own))
        longest = max(longest, max(map(len, own), default=0))
        rows = piece.split(b"\n")
        open_line.append(rows[0])
        if len(rows) > 1:
            rows[0] = b"".join(open_line)
            open_line = [rows.pop()]
        else:
            rows = []
        if len(text) == (read := read + len(piece)):
            rows.append(b"".join(open_line))
        rows = [line for line in rows if line.strip()]
        lines += len(rows)
        distinct_lines.add(set(rows))
    out = np.zeros(N_FEATURES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, pairs.sum()))
    out[CLASSES * CLASSES :] = (
        repeated / max(1, words),
        1 - len(distinct) / max(1, words),
        (lines - len(distinct_lines)) / max(1, lines),
        np.log1p(words),
        np.log1p(longest),
        np.log1p(len(text) / max(1, words)),
    )
    return out


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking: standardised features, their weights, the threshold, and the share of label 1."""

    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``CUT`` at the threshold. Without both labels to learn from, the share of label 1."""
        if not self.weights.any():
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -30, 30)) * ((1 - CUT) / CUT))


def fit_pairs(x: np.ndarray, y: np.ndarray, share_of_one: float, pairs: int = PAIRS) -> Ranking:
    """Bradley-Terry weights by Newton steps on the logistic loss of feature differences."""
    n = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        prior = 0.5 if not len(y) else float(len(good) > 0)
        return Ranking(np.zeros(n), np.ones(n), np.zeros(n), 0.0, prior)
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - middle) / spread, -8, 8)
    rng = np.random.default_rng(0)
    difference = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(n)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        gradient = difference.T @ p / pairs - RIDGE * w
        curvature = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + RIDGE * np.eye(n)
        step = np.linalg.solve(curvature, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Ranking(middle, spread, w, _quantile(z @ w, 1 - share_of_one), share_of_one)


def _quantile(raw: np.ndarray, share_of_zero: float) -> float:
    """The score with a share of the documents below it, in the middle of the gap there."""
    ordered = np.sort(raw)
    at = min(len(raw), max(1, round(share_of_zero * len(raw)))) - 1
    above = ordered[ordered > ordered[at]]
    return float((ordered[at] + (above[0] if len(above) else ordered[at])) / 2)


def quantile_of(scores: DataFrame, rank: int, bins: int = 1 << 12, rounds: int = 4) -> float | None:
    """The middle between the ``rank``-th smallest of ``raw`` and the next larger value, found by counting in bins.

    Each round counts the rows in each of a number of bins and goes on in the one that holds the rank, so
    no row is sorted and a round brings one row for each bin to the driver.
    """
    low, high, total = scores.agg(F.min("raw"), F.max("raw"), F.count("raw")).first()
    if not total:
        return None
    rank = min(max(rank, 1), total)
    inside, before = scores, 0
    for _ in range(rounds):
        width = (high - low) / bins
        if not width or low + width == low:
            break
        place = F.least(F.floor((F.col("raw") - low) / width), F.lit(bins - 1))
        for least, most, n in sorted(map(tuple, inside.groupBy(place.alias("bin")).agg(F.min("raw"), F.max("raw"), F.count("raw")).drop("bin").collect())):
            if before + n >= rank:
                break
            before += n
        low, high = least, most
        inside = scores.where(F.col("raw").between(low, high))
        if low == high:
            break
    above = scores.where(F.col("raw") > high).agg(F.min("raw")).first()[0]
    return float((high + (high if above is None else above)) / 2)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> Ranking:
    """Learn from ``labels(doc_id, quality)``: at most ``most`` documents of either label.

    The threshold is the quantile of the scores of all labelled documents, whatever their number: as many are below it as carry
    label 0. Labels that are neither 0 nor 1, null ids, and ids without a document are not learned from. An id
    counts once for each label that it has, with one of its texts. Null and empty texts have the features
    of no text; texts of any length are read whole. Without documents of both labels there is no ranking, and all scores are
    the share of label 1, or 0.5 without any.
    """
    sample = labelled(labels, "quality", 1, most).union(labelled(labels, "quality", 0, most))

    def run(batches):
        for batch in batches:
            x = [features(t).tolist() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"]
            )

    texts = one_text_each(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).select("label", "text")
    rows = texts.mapInArrow(run, "label int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, N_FEATURES)
    y = np.array(rows.column("label").to_pylist(), int)
    order = np.lexsort((*x.T[::-1], y))  # the fit does not depend on the order in which rows arrive
    model = fit_pairs(x[order], y[order], 0.5)
    if not model.weights.any():
        return model

    def score(batches):
        for batch in batches:
            x = np.array([features(t) for t in as_bytes(batch.column(1))]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.raw(x))], names=["doc_id", "raw"])

    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    scores = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, raw double")
    every = materialise(scores.join(known, "doc_id").select("label", "raw"), "quality-scores")  # no text is shuffled
    one, total = every.agg(F.sum("label"), F.count("*")).first()
    return replace(model, threshold=quantile_of(every, total - one), prior=one / total)


def score_quality(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, score, predicted: a row for every row of ``docs``, from the text alone.

    Null and empty texts have the features of no text and get the score of these. Ids are passed on,
    null and repeated ones too; other columns are not read. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in as_bytes(batch.column(1))]).reshape(-1, N_FEATURES)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_quality(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least the threshold.

    Null and empty texts are judged by the features of no text; rows with null or repeated ids are judged one by one; an
    empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in as_bytes(batch.column("text"))]).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(model.score(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)

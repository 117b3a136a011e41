"""Interpolated modified Kneser-Ney language model of any order, as sorted hash arrays that workers memory-map.

Spark counts; arrays hold what was counted. A token, and a row of tokens, is known by its 64-bit hash.

1. Tokens: each task sums its tokens and sends them to the shard of their hash. A shard writes its
   sorted hashes and counts. From here on a token also has a number, its place in these arrays.
2. Rows of as many tokens as the order: a row goes to the shard of its context, all but its last token, where all
   rows of that context meet. Rows whose context is of very frequent tokens only go to the shard of their own
   hash instead, so no shard holds much more than another. What is sent are sorted token numbers, as differences and
   compressed. A shard writes sorted row hashes and counts.
3. Contexts: how many kinds of tokens follow once, twice, or more often, and the sum of their counts. A shard has
   and writes all of its contexts but those of very frequent tokens, whose sums from all shards are added up.
4. Shorter rows, one token less at a time: a distinct row counts once for the row without its first token, so these
   counts say how many kinds of tokens precede a row. They are sent and written like the longest.

The number of shards follows the bytes of the texts, so a shard's memory does not grow with the corpus.

Nearly all counts fit into a byte, and the others stand apart. Of the hashes of a large array those in one range share
their first bits, which are not written; all 64 bits of a hash are still compared. Shuffles are given up when the step
that reads them is written.

Scoring maps the arrays into memory and looks up each batch's distinct tokens and rows in sorted order, so
a worker holds the pages it touches and never the model.

Only what is summed crosses the driver: a few numbers from each shard, and the few frequent tokens.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import repeat
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import as_bytes, materialise
from docweave.sources.documents import setting
from docweave.workspace import shared_folder

SEED = 7
#: Hashes of what stands before the first and after the last word; no word holds white space.
BEGIN, END = (xxhash.xxh64_intdigest(mark, SEED) for mark in (b"  ", b" "))
#: Tokens that a task sums before it sends them on.
TOKENS_AT_ONCE = 1 << 21
#: Tokens that a task scores at once.
SCORED_AT_ONCE = 3 << 19
#: Bytes of text for each shard, a shard being what one task sorts; larger workers may have larger shards and so fewer files.
SHARD_BYTES = 8 << 20
#: A token with more than this share of a shard's tokens has its rows dealt to all shards.
FREQUENT = 0.25
#: Tokens that each shard names as candidates for that.
CANDIDATES = 256
#: Tokens in the longest rows of the registered query's model.
ORDER = 3
#: Added to a count in the base model.
ADDED = 0.1
#: Arrays of fewer hashes are written as they are; in others about so many hashes share their first bits.
FEW, SHARED = 1 << 16, 16
#: What a byte says of a count, or of a context, that does not fit into one and stands apart.
APART = 255
#: The setting under which Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of a whole text's tokens: words in lower-case ASCII, then the end."""
    words = (text or b"").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    out[-1] = END
    return out


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * _ONE) ^ (second + _TWO)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _TWO
    return mixed ^ (mixed >> np.uint64(29))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes, so shards in order hold hashes in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _dealt_to(contexts: np.ndarray, last: np.ndarray, dealt: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a row's context, or of the whole row where its context is of very frequent tokens only."""
    return shard_of(np.where(dealt, pair_hash(contexts, last), contexts), shards)


def batches_of_tokens(batches, column: int, at_once: int | None = None):
    """Token arrays of many texts, about ``TOKENS_AT_ONCE`` tokens at a time."""
    at_once = at_once or TOKENS_AT_ONCE
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for text in as_bytes(batch.column(column)):
            held.append(tokens(text))
            size += len(held[-1])
            if size >= at_once:
                yield held
                held, size = [], 0
    if held:
        yield held


def _before(last: np.ndarray, sizes: list[int], order: int, begin) -> list[np.ndarray]:
    """For every token of texts of some sizes the one before it, the one before that, and so on; begins before the first."""
    place = np.arange(len(last)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    out = []
    for back in range(1, order):
        token = np.full(len(last), begin, last.dtype)
        token[back:] = last[: max(0, len(last) - back)]
        token[place < back] = begin
        out.append(token)
    return out


def _contexts(before: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the contexts of all tokens before, one less, and so on to one."""
    out = []
    for length in range(len(before), 0, -1):
        own = before[length - 1]
        for token in before[length - 2 :: -1] if length > 1 else ():
            own = pair_hash(own, token)
        out.append(own)
    return out


def _often(before: list[np.ndarray], frequent: np.ndarray) -> np.ndarray:
    """With how many frequent tokens a context ends."""
    often, still = np.zeros(len(before[0]), np.uint8), np.ones(len(before[0]), bool)
    for token in before:
        still &= np.isin(token, frequent)
        often += still
    return often


def _often_before(frequent: np.ndarray, sizes: list[int], order: int, begin) -> np.ndarray:
    """With how many frequent tokens the context of every token ends, from which tokens are frequent themselves."""
    often, still = np.zeros(len(frequent), np.uint8), np.ones(len(frequent), bool)
    for own in _before(frequent, sizes, order, begin):
        still &= own
        often += still
    return often


def _small(values: np.ndarray) -> np.ndarray:
    """Counts in the smallest kind of integer that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if values.size else 0))


def _packed(values: np.ndarray) -> bytes:
    """Numbers, compressed with their first bytes together, their second ones, and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return values.dtype.str.encode() + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:3].decode())
    planes = np.frombuffer(zstandard.decompress(data[3:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _kinds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place that each has, and the place of every key among them; faster than np.unique."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(first) - 1
    return ordered[first], order[first], back


def _ranks(keys: np.ndarray) -> np.ndarray:
    return _kinds(keys)[2].astype(np.uint64)


def _narrow(shard: np.ndarray) -> np.ndarray:
    """Shard numbers as 16 bits if they fit, which are sorted faster."""
    return shard.astype(np.uint16) if len(shard) and int(shard.max()) < 1 << 16 else shard


def _sent(before: np.ndarray, last: np.ndarray, shard: np.ndarray, counts: np.ndarray, numbers: np.ndarray | None = None) -> dict[str, list]:
    """Distinct rows and their counts, a line for each shard; a context stands once for all that follow it.

    ``before`` holds the numbers of the context's tokens, the first one first; ``last`` those of the last tokens; or both
    the places of these in the sorted ``numbers``.
    """
    bits = max(int(before.max(initial=0)), int(last.max(initial=0))).bit_length()
    whole = (len(before) + 1) * bits <= 64
    if whole:  # a row is one number
        rank = before[0].astype(np.uint64)
        for column in (*before[1:], last):
            rank = rank << np.uint64(bits) | column
        order = np.argsort(rank)
        order = order[np.argsort(_narrow(shard[order]), kind="stable")]
        rank = rank[order]
    elif before.dtype == np.uint32:
        # Ranks of the context take the place of its tokens, one after the other; sorting one number is faster than several.
        rank = before[0].astype(np.uint64)
        for place, column in enumerate((*before[1:], last)):
            rank = (_ranks(rank) if place else rank) << np.uint64(32) | column
        order = np.argsort(rank)
        del rank
        order = order[np.argsort(_narrow(shard[order]), kind="stable")]
    else:
        order = np.lexsort((last, *before[::-1], shard))
    before, last, shard = before[:, order], last[order], shard[order]
    differs = rank[1:] != rank[:-1] if whole else (last[1:] != last[:-1]) | (before[:, 1:] != before[:, :-1]).any(axis=0)
    starts = np.flatnonzero(np.append(True, differs))
    counts = np.add.reduceat(counts[order].astype(np.int64), starts)
    before, last, shard = before[:, starts], last[starts], shard[starts]
    if numbers is not None:
        before, last = numbers[before], numbers[last]
    out: dict[str, list] = {k: [] for k in _SENT_TYPES}
    for number, a, b in _slices(shard):
        own = before[:, a:b]
        heads = np.flatnonzero(np.append(True, (own[:, 1:] != own[:, :-1]).any(axis=0)))
        steps = np.diff(own[:, heads], axis=1, prepend=np.zeros((len(own), 1), own.dtype))
        values = (steps.ravel(), _small(np.diff(np.append(heads, b - a))), last[a:b], _small(counts[a:b]))
        out["shard"].append(number)
        for name, value in zip(("before", "runs", "lasts", "counts"), values):
            out[name].append(_packed(value))
    return out


_SENT = "shard int, before binary, runs binary, lasts binary, counts binary"
_SENT_TYPES = {"shard": pa.int32(), **dict.fromkeys(("before", "runs", "lasts", "counts"), pa.binary())}


def _table(sent: dict[str, list]) -> dict[str, pa.Array]:
    return {k: pa.array(v, _SENT_TYPES[k]) for k, v in sent.items()}


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each value over them."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(keys) else v for v in values)


def _slices(shard: np.ndarray):
    """Shard numbers and ranges of an array that is in order of the shard."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def _write(folder: str, name: str, values: np.ndarray) -> None:
    """Whole or not at all: a task that is run again replaces what it wrote before by the same."""
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as file:
        np.save(file, values)
    os.replace(part, f"{folder}/{name}.npy")


@lru_cache(maxsize=4096)
def _mapped(folder: str, name: str) -> np.ndarray:
    path = f"{folder}/{name}.npy"
    return np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, np.uint64)


def _write_hashes(folder: str, name: str, keys: np.ndarray) -> None:
    """Sorted distinct hashes, as they are or without the first bits that those of a range share.

    What is left of a hash are its next 32 bits, and up to 16 more in an array of their own.
    """
    if len(keys) < FEW:
        return _write(folder, name, keys)
    first, width = keys[0], int(keys[-1] - keys[0])
    shift = min(48, max(32, width.bit_length() - (len(keys) // SHARED).bit_length()))
    own = keys - first
    starts = np.searchsorted(own >> np.uint64(shift), np.arange((width >> shift) + 2, dtype=np.uint64)).astype(np.uint32)
    _write(folder, f"{name}-range", np.array([first, keys[-1], shift], np.uint64))
    _write(folder, f"{name}-starts", starts)
    _write(folder, f"{name}-high", (own >> np.uint64(shift - 32)).astype(np.uint32))
    if shift > 32:
        low = own & np.uint64((1 << (shift - 32)) - 1)
        _write(folder, f"{name}-low", low.astype(np.uint8 if shift <= 40 else np.uint16))


def _places(folder: str, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted hashes stand in a written array, and which of them are there; the others have any place."""
    about = _mapped(folder, f"{name}-range")
    if not len(about):
        held = _mapped(folder, name)
        at = np.minimum(np.searchsorted(held, keys), max(0, len(held) - 1))
        return at, held[at] == keys if len(held) else np.zeros(len(keys), bool)
    first, last, shift = about[0], about[1], int(about[2])
    starts, high, low = (_mapped(folder, f"{name}-{part}") for part in ("starts", "high", "low"))
    within = (keys >= first) & (keys <= last)
    own = np.where(within, keys - first, np.uint64(0))
    bucket = (own >> np.uint64(shift)).astype(np.int64)
    at, end = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
    top = (own >> np.uint64(shift - 32)).astype(np.uint32)
    to = end.copy()
    for _ in range(int((end - at).max(initial=0)).bit_length()):
        middle = (at + to) >> 1
        less = (high[np.minimum(middle, len(high) - 1)] < top) & (at < to)
        at, to = np.where(less, middle + 1, at), np.where(less, to, middle)
    there = np.zeros(len(keys), bool)
    rest = (own & np.uint64((1 << (shift - 32)) - 1)).astype(low.dtype) if shift > 32 else None
    left = np.flatnonzero(within)
    while len(left):  # hashes that differ in their last bits only stand next to each other
        left = left[at[left] < end[left]]
        left = left[high[at[left]] == top[left]]
        same = low[at[left]] == rest[left] if shift > 32 else np.ones(len(left), bool)
        there[left[same]] = True
        left = left[~same]
        at[left] += 1
    return np.minimum(at, len(high) - 1), there


def _write_coded(folder: str, name: str, codes: np.ndarray, *values: np.ndarray) -> None:
    """A byte for each place, and the values of those places that a byte does not do for."""
    apart = np.flatnonzero(codes == APART)
    _write(folder, name, codes.astype(np.uint8))
    _write(folder, f"{name}-apart", apart.astype(np.uint32))
    _write(folder, f"{name}-values", _small(np.stack([v[apart] for v in values])))


def _coded(folder: str, name: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some places, which of them stand apart, and the values of those."""
    codes = _mapped(folder, name)[at]
    apart = np.flatnonzero(codes == APART)
    where = np.searchsorted(_mapped(folder, f"{name}-apart"), at[apart])
    return codes, apart, _mapped(folder, f"{name}-values")[:, where] if len(apart) else np.zeros((1, 0))


def _write_times(folder: str, name: str, times: np.ndarray) -> None:
    _write_coded(folder, name, np.minimum(times, APART), times)


def _times(folder: str, names: tuple[str, str], keys: np.ndarray) -> np.ndarray:
    """Counts of sorted rows; zero where a row is not there."""
    out = np.zeros(len(keys))
    at, there = _places(folder, names[0], keys)
    if there.any():
        out, apart, values = _coded(folder, names[1], at)
        out = out.astype(float)
        out[apart] = values[0]
        out[~there] = 0
    return out


def _write_followed(folder: str, name: str, followed: list[np.ndarray]) -> None:
    """How many kinds of tokens follow each context once, twice and more often, and the sum of their counts. A byte
    is enough where none follows more often and few do at all."""
    once, twice, more, _ = followed
    _write_coded(folder, name, np.where((more == 0) & (once < 32) & (twice < 7), once + 32 * twice, APART), *followed)


def _followed(folder: str, names: tuple[str, str], keys: np.ndarray) -> np.ndarray:
    """The four numbers of sorted contexts; zeros where a context is not there."""
    out = np.zeros((4, len(keys)))
    at, there = _places(folder, names[0], keys)
    if there.any():
        codes, apart, values = _coded(folder, names[1], at)
        out[0], out[1] = codes % 32, codes // 32
        out[3] = out[0] + 2 * out[1]
        out[:, apart] = values
        out[:, ~there] = 0
    return out


def _all(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([_unpacked(x.as_py()) for x in column])


@dataclass(frozen=True)
class Numbers:
    """Numbers of tokens: their places in the arrays of all shards, one after the other."""

    folder: str
    ends: np.ndarray

    @property
    def kind(self) -> type:
        return np.uint32 if self.ends[-1] < 1 << 32 else np.uint64

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted hashes, which are all there."""
        out = np.empty(len(hashes), self.kind)
        for shard, a, b in _slices(shard_of(hashes, len(self.ends))):
            held = _mapped(self.folder, f"token-{shard}")
            out[a:b] = self.ends[shard] - len(held) + np.searchsorted(held, hashes[a:b])
        return out

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        kinds, _, back = _kinds(numbers)
        out = np.empty(len(kinds), np.uint64)
        for shard, a, b in _slices(np.searchsorted(self.ends, kinds, "right")):
            held = _mapped(self.folder, f"token-{shard}")
            out[a:b] = held[kinds[a:b].astype(np.int64) - (self.ends[shard] - len(held))]
        return out[back]


def _look_up(folder: str, names: tuple[str, ...], keys: np.ndarray) -> np.ndarray:
    """Values of sorted keys in arrays, a row for each after the first; zero where a key is not there."""
    at, there = _places(folder, names[0], keys)
    if not there.any():
        return np.zeros((len(names) - 1, len(keys)))
    return np.stack([np.where(there, _mapped(folder, name)[at], 0) for name in names[1:]])


def discounts(n: np.ndarray) -> np.ndarray:
    """What counts of 0, 1, 2 and more lose, from how many things were seen once to four times.

    Where too few were seen for the estimate, it is kept between zero and the count.
    """
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


def _spare_and_total(lost: np.ndarray, folder: str, names: tuple[str, str], keys: np.ndarray) -> np.ndarray:
    """What sorted contexts leave to shorter ones, and the sum of their counts."""
    followed = _followed(folder, names, keys)
    return np.stack([lost[1:] @ followed[:3], followed[3]])


@dataclass(frozen=True)
class Model:
    """Where the arrays are and the numbers they are read with."""

    folder: str
    shards: int
    order: int
    frequent: np.ndarray
    tokens: int
    kinds: int
    #: For rows of two tokens, three, and so on.
    row_discounts: tuple[np.ndarray, ...]
    pair_kinds: int
    token_discounts: np.ndarray
    left: float

    def _found(self, look_up, n: int, names: tuple[str, ...], keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The ``n`` values that a look-up gives for each of sorted keys from the arrays of its shard."""
        out = np.empty((n, len(keys)))
        order = np.argsort(_narrow(shard), kind="stable")
        for number, a, b in _slices(shard[order]):
            at = order[a:b]
            out[:, at] = look_up(self.folder, tuple(f"{name}-{number}" for name in names), keys[at])
        return out

    def log_probabilities(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every token under the model, and every token's count."""
        last, sizes = np.concatenate(texts), list(map(len, texts))
        kinds, _, back = _kinds(np.append(last, np.uint64(BEGIN)))
        begin, back = back[-1], back[:-1]
        counts, before = self._found(_look_up, 2, ("token", "count", "before"), kinds, shard_of(kinds, self.shards))
        lower = np.full(len(kinds), self.left / (self.kinds + 1))
        lower += (before - self.token_discounts[np.minimum(before, 3).astype(int)]) / max(1, self.pair_kinds)
        chance, counts = lower[back], counts[back]
        # A context of some tokens is the row that ends at the token before, or one of begins: each kind is found once for both.
        keys, dealt = kinds, np.isin(kinds, self.frequent)
        own = np.append(dealt[back], dealt[begin])
        often = np.append(_often_before(own[:-1], sizes, self.order, own[-1]), np.uint8(self.order))
        ended, begun = last, np.array([BEGIN], np.uint64)
        for size, lost in enumerate(self.row_discounts, 2):
            context = np.append(_before(ended, sizes, 2, begun[0])[0], begun)
            sums = np.zeros((2, len(keys)))
            for name, some in (("context", ~dealt), ("dealt", dealt)):
                if some.any():
                    names = f"{name}{size}", f"{name}{size}-followed"
                    look_up = partial(_spare_and_total, lost)
                    sums[:, some] = self._found(look_up, 2, names, keys[some], shard_of(keys[some], self.shards))
            spare, total = sums[:, _before(back, sizes, 2, begin)[0]]
            rows = pair_hash(context, np.append(last, np.uint64(BEGIN)))
            ended, begun = rows[:-1], rows[-1:]
            keys, first, back = _kinds(rows)
            begin, back = back[-1], back[:-1]
            shard = shard_of(np.where(often[first] >= size - 1, keys, context[first]), self.shards)
            times = self._found(_times, 1, (f"row{size}", f"times{size}"), keys, shard)[0][back]
            dealt = own[first] & (often[first] >= size - 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = (times - lost[np.minimum(times, 3).astype(int)] + spare * chance) / total
            chance = np.where(total > 0, seen, chance)
        return np.log10(chance), counts.astype(np.int64)


def _folder(docs: DataFrame) -> str:
    """A new folder that every worker can map: the shared one, which has to be mounted."""
    path = urlparse(shared_folder(docs.sparkSession, "kneser-ney"))
    if path.scheme not in ("", "file"):
        raise ValueError("workers map the model into memory, so spark.checkpoint.dir has to be a mounted folder")
    os.makedirs(path.path)
    return path.path


def train(docs: DataFrame, order: int = 2, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the texts of ``docs`` and write the arrays of a model of rows of ``order`` tokens into the shared folder.

    A null or empty text has its end alone; a repeated row counts again; texts of any length are read whole, one
    at a time. Only ``text`` is read. An empty table gives a model of nothing.
    """
    if order < 2:
        raise ValueError("the order is two or more")
    with setting(docs.sparkSession, CLEANUP, "true"):
        return _trained(docs, order, shard_bytes, _folder(docs))


def _trained(docs: DataFrame, order: int, shard_bytes: int, folder: str) -> Model:
    texts = docs.select("text")
    size, documents = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    shards = 1 + (size + documents) // shard_bytes

    def sum_tokens(batches):
        for held in batches_of_tokens(batches, 0):
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            at = int(np.searchsorted(keys, np.uint64(BEGIN)))  # a document begins once; this is the begin's count as a context
            keys, counts = np.insert(keys, at, np.uint64(BEGIN)), np.insert(counts, at, len(held))
            for shard, a, b in _slices(shard_of(keys, shards)):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "keys": [_packed(np.diff(keys[a:b], prepend=np.uint64(0)))], "counts": [_packed(_small(counts[a:b]))]})

    def write_tokens(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        keys = np.concatenate([np.cumsum(_unpacked(x.as_py()), dtype=np.uint64) for x in group.column("keys")])
        keys, counts = _summed(keys, _all(group.column("counts")).astype(np.int64))
        _write(folder, f"token-{shard}", keys)
        _write(folder, f"count-{shard}", _small(counts))
        most = np.argsort(-counts, kind="stable")[:CANDIDATES]
        return pa.table({"shard": [shard] * len(most), "token": keys[most].view(np.int64), "n": counts[most], "kinds": [len(keys)] + [0] * (len(most) - 1), "total": [int(counts.sum())] + [0] * (len(most) - 1)})

    schema = "shard int, keys binary, counts binary"
    candidates = materialise(
        texts.mapInArrow(sum_tokens, schema).groupBy("shard").applyInArrow(write_tokens, "shard long, token long, n long, kinds long, total long"), "frequent"
    )
    begin = int(np.array([BEGIN], np.uint64).view(np.int64)[0])
    kinds, total, begun = candidates.agg(
        F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), F.lit(documents)
    ).first()
    sizes = np.zeros(shards, np.int64)
    for shard, n in candidates.where("kinds > 0").select("shard", "kinds").collect():  # one row for each shard
        sizes[shard] = n
    numbers = Numbers(folder, np.cumsum(sizes))
    limit = FREQUENT * (total / shards)
    often = candidates.where(F.col("n") > limit).select("token").toArrow().column("token").to_numpy().astype(np.int64)
    frequent = np.unique(np.append(often, begin)).view(np.uint64)
    total, kinds = total - begun, max(0, kinds - 1)

    def sum_rows(batches):
        for held in batches_of_tokens(batches, 0):
            last, sizes = np.concatenate(held), list(map(len, held))
            kinds, _, back = _kinds(np.append(last, np.uint64(BEGIN)))
            own, begin = back[:-1].astype(np.uint32), np.uint32(back[-1])
            often = np.isin(kinds, frequent)
            dealt = _often_before(often[own], sizes, order, often[begin]) >= order - 1
            shard = _dealt_to(_contexts(_before(last, sizes, order, np.uint64(BEGIN)))[0], last, dealt, shards)
            del back, often, dealt
            before = np.stack(_before(own, sizes, order, begin)[::-1])
            sent = _sent(before, own, shard, np.ones(len(own), np.uint8), numbers.of(kinds))
            yield pa.RecordBatch.from_pydict(_table(sent))

    def write_rows(size: int):
        def write(group: pa.Table) -> pa.Table:
            shard = group.column("shard")[0].as_py()
            before = np.concatenate(
                [np.cumsum(_unpacked(x.as_py()).reshape(size - 1, -1), axis=1, dtype=numbers.kind) for x in group.column("before")], axis=1
            )
            runs, last = _all(group.column("runs")), _all(group.column("lasts"))
            counts = _all(group.column("counts"))
            at = np.repeat(np.arange(len(runs), dtype=np.uint32), runs)
            hashed = [numbers.hashes(x) for x in before[::-1]]
            contexts, dealt = _contexts(hashed), _often(hashed, frequent)
            last_hashes = numbers.hashes(last)
            rows = pair_hash(contexts[0][at], last_hashes)
            by = np.argsort(rows)
            starts = np.flatnonzero(np.append(True, rows[by[1:]] != rows[by[:-1]]))
            counts = np.add.reduceat(counts[by].astype(np.int64), starts)
            by = by[starts]
            at, last, last_hashes, rows = at[by], last[by], last_hashes[by], rows[by]
            del by, hashed, runs
            _write_hashes(folder, f"row{size}-{shard}", rows)
            _write_times(folder, f"times{size}-{shard}", counts)
            followed = [(counts == n).astype(np.int64) for n in (1, 2)] + [(counts >= 3).astype(np.int64), counts]
            whole = dealt[at] < size - 1
            write_sums(f"context{size}", shard, *_summed(contexts[0][at[whole]], *(x[whole] for x in followed)))
            keys, *sums = _summed(contexts[0][at[~whole]], *(x[~whole] for x in followed))
            seen = np.array([len(counts), *((counts == n).sum() for n in (1, 2, 3, 4))], np.int64)
            out: dict[str, list] = {k: [] for k in _SENT_TYPES}
            for number, a, b in _slices(shard_of(keys, shards)) if len(keys) else ():
                for name, value in zip(_SENT_TYPES, (number, _packed(np.stack([x[a:b] for x in sums]).ravel()), b"", _packed(keys[a:b]), b"")):
                    out[name].append(value)
            n_sums = len(out["shard"])
            if size > 2:
                to = _dealt_to(contexts[1][at], last_hashes, dealt[at] >= size - 2, shards)
                shorter = _sent(before[1:, at], last, to, np.ones(len(last), np.uint8))
            else:
                keys, ones = _summed(last_hashes, np.ones(len(last), np.int64))
                shorter = {k: [] for k in _SENT_TYPES}
                for number, a, b in _slices(shard_of(keys, shards)):
                    for name, value in zip(_SENT_TYPES, (number, b"", b"", _packed(keys[a:b]), _packed(_small(ones[a:b])))):
                        shorter[name].append(value)
            n = n_sums + len(shorter["shard"])
            columns = {k: pa.array(out[k] + shorter[k], t) for k, t in _SENT_TYPES.items()}
            seen = pa.array([seen.tolist() if i == 0 else [0] * 5 for i in range(n)], pa.list_(pa.int64()))
            return pa.table(columns | {"shorter": pa.array(np.arange(n) >= n_sums), "seen": seen})

        return write

    def write_sums(name: str, shard: int, keys: np.ndarray, *sums: np.ndarray) -> None:
        _write_hashes(folder, f"{name}-{shard}", keys)
        _write_followed(folder, f"{name}-followed-{shard}", sums)

    def write_dealt(size: int):
        def write(group: pa.Table) -> pa.Table:
            sums = np.concatenate([_unpacked(x.as_py()).reshape(4, -1) for x in group.column("before")], axis=1)
            keys, *sums = _summed(_all(group.column("lasts")), *sums)
            write_sums(f"dealt{size}", group.column("shard")[0].as_py(), keys, *sums)
            return pa.table({"contexts": [len(keys)]})

        return write

    def write_before(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        keys, before = _summed(_all(group.column("lasts")), _all(group.column("counts")).astype(np.int64))
        held = _mapped(folder, f"token-{shard}")
        after = np.zeros(len(held), np.int64)
        after[np.searchsorted(held, keys)] = before
        _write(folder, f"before-{shard}", _small(after))
        return pa.table({"seen": [[int((before == n).sum()) for n in (1, 2, 3, 4)] + [int((before >= 3).sum())]]})

    sent = texts.mapInArrow(sum_rows, _SENT)
    row_discounts: list[np.ndarray] = []
    for size in range(order, 1, -1):
        found = materialise(sent.groupBy("shard").applyInArrow(write_rows(size), f"{_SENT}, shorter boolean, seen array<long>"), f"rows-{size}")
        seen = [x or 0 for x in found.agg(*(F.sum(F.col("seen")[i]) for i in range(5))).first()]
        row_discounts.insert(0, discounts(np.array(seen[1:])))
        dealt = found.where("not shorter").select("shard", "before", "lasts")
        dealt.groupBy("shard").applyInArrow(write_dealt(size), "contexts long").agg(F.sum("contexts")).collect()
        sent = found.where("shorter").select(*_SENT_TYPES)
    more = sent.groupBy("shard").applyInArrow(write_before, "seen array<long>")
    kinds_before = [x or 0 for x in more.agg(*(F.sum(F.col("seen")[i]) for i in range(5))).first()]
    token_discounts = discounts(np.array(kinds_before[:4]))
    lost = token_discounts[1] * kinds_before[0] + token_discounts[2] * kinds_before[1] + token_discounts[3] * kinds_before[4]
    left = lost / seen[0] if seen[0] else 1.0
    return Model(folder, shards, order, frequent, total, kinds, tuple(row_discounts), seen[0], token_discounts, left)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: a row for every row of ``docs``.

    Scores are sums of log10 probabilities over a text's tokens, its end included; a null text is empty and
    has its end alone. The base adds a constant to every count. Null and repeated ids are passed on; other
    columns are not read; an empty table gives an empty result, and a model of nothing gives every
    token the same chance.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        below = np.log10(own.tokens + ADDED * (own.kinds + 1))
        for batch in batches:
            done = 0
            for texts in batches_of_tokens([batch], 1, SCORED_AT_ONCE):
                chance, counts = own.log_probabilities(texts)
                base = np.log10(counts + ADDED) - below
                sizes = np.array(list(map(len, texts)), np.int64)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(texts)),
                        pa.array(sizes),
                        pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                        pa.array(np.full(len(texts), own.tokens, np.int64)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(chance, starts)),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                done += len(texts)

    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)

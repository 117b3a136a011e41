"""Exact ids of a public byte-level tokenizer."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, the rest follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as bytes, four for each id, least first.

    The vocabulary is read from a tokenizer's file; its ids are the ranks of its merges, so the
    faster of the two installed libraries gives the same ids. ``encode`` takes special tokens as ordinary text;
    ``encode_plain`` gives them their own ids wherever they stand, as a plain call of the file's tokenizer does.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self.size = tokenizer.get_vocab_size()
        byte = _bytes_of_characters()
        vocabulary = tokenizer.get_vocab(with_added_tokens=False).items()
        self._text = {n: bytes(byte[c] for c in token) for token, n in vocabulary if all(c in byte for c in token)}
        added = tokenizer.get_added_tokens_decoder()
        special = set(added)
        ranks = {text: n for n, text in self._text.items() if n not in special}
        self._encode = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError(f"{path}: added tokens that depend on what stands beside them are not supported")
        self._numbers = {t.content: n for n, t in added.items()}
        longest = sorted(self._numbers, key=len, reverse=True)
        self._added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def encode(self, text: str) -> bytes:
        return self._bytes(self._encode(text))

    def encode_plain(self, text: str) -> bytes:
        if self._added is None or not self._added.search(text):
            return self.encode(text)
        ids: list[int] = []
        for i, part in enumerate(self._added.split(text)):
            ids += [self._numbers[part]] if i % 2 else self._encode(part)
        return self._bytes(ids)

    @staticmethod
    def _bytes(numbers: list[int]) -> bytes:
        ids = array("I", numbers)
        return ids.tobytes() if ids.itemsize == 4 else np.array(ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)

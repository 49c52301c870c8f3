"""Counting things in many texts at the cost of their different words.

Texts are cut at white space by Arrow and dictionary-encoded, so Python sees
each different piece of a block once; what a piece is worth is kept in a
bounded store for the life of the task."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: words are runs of letters
words_of = re.compile(r"[^\W\d_]+").findall
_STORE = 500_000


def bucket(word: str, size: int) -> int:
    """A stable number below ``size`` (a power of two) for a word."""
    return zlib.crc32(word.encode("utf-8", "replace")) & (size - 1)


class Pieces:
    """The pieces of a block of texts: ``codes`` into ``names``, and for each
    text the range ``at[k]:at[k + 1]`` of codes."""

    def __init__(self, texts: pa.Array):
        lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        self.at = lists.offsets.to_numpy()
        self.codes, self.names = coded.indices.to_numpy(), coded.dictionary.to_pylist()

    def sums(self, table: np.ndarray) -> np.ndarray:
        """For each text the sum over its pieces of ``table[code]`` (one row
        for each name)."""
        total = np.zeros((len(self.codes) + 1, table.shape[1]))
        np.cumsum(table[self.codes], axis=0, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]


class Store:
    """What each piece is worth, as a row of numbers made by ``make``."""

    def __init__(self, width: int, make: Callable[[str], object]):
        self.width, self.make, self.known, self.rows = width, make, {}, []

    def table(self, names: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _STORE:
            known.clear()
        for name in names:
            if name not in known:
                known[name] = self.make(name)
        return np.array([known[n] for n in names], dtype=np.float64).reshape(len(names), self.width)

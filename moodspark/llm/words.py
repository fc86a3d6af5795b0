"""Words of many texts at once: Arrow splits them and numbers the distinct ones, numpy does the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that hold at most ``limit`` bytes together, or one longer text."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, size[at] + limit, side="right")) - 1)
        yield at, end
        at = end


class Words:
    """The words of a column of texts as numbers of distinct words; by default runs without ASCII white space.

    Row r has ``codes[offsets[r]:offsets[r + 1]]``, positions in ``distinct``.
    """

    def __init__(self, offsets: np.ndarray, codes: np.ndarray, distinct: pa.Array):
        self.offsets, self.codes, self.distinct = offsets, codes, distinct

    @classmethod
    def of(cls, texts: pa.Array, split_at: Callable = pc.ascii_split_whitespace) -> Words:
        split = split_at(pc.fill_null(texts, ""))
        flat = split.flatten()
        there = np.asarray(pc.binary_length(flat)) > 0         # pieces before and after outer white space are empty
        ends = np.concatenate([[0], np.cumsum(there)])
        coded = flat.filter(pa.array(there)).dictionary_encode()
        return cls(ends[np.asarray(split.offsets) - split.offsets[0].as_py()], np.asarray(coded.indices).astype(np.int64),
                   coded.dictionary)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def take(self, keep: np.ndarray) -> Words:
        """The rows for which ``keep`` holds."""
        return Words(np.concatenate([[0], np.cumsum(self.counts()[keep])]), self.codes[np.repeat(keep, self.counts())],
                     self.distinct)

    def sums(self, of_word: np.ndarray) -> np.ndarray:
        """Sum of a figure of each distinct word over the words of each row."""
        total = np.concatenate([[0], np.cumsum(of_word[self.codes])])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def paired(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each distinct pair (a, b) of small non-negative integers, in order of appearance, and how many there are."""
    codes, distinct = pd.factorize(a * (int(b.max(initial=0)) + 1) + b)
    return codes, len(distinct)

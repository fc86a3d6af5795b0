"""Hashed features of texts, many texts at a time, and a bounded, documented training sample.

Texts come in slices of a few MB. A slice's words are numbered (``words``), the
features of each distinct word are computed once on Arrow buffers, and a text's
feature set is the set of pairs (row, feature).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, text_slices

BITS = 30
PREFIX = 5
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„’‘¡¿…–—"
_MASK = (1 << BITS) - 1

#: Rows of distinct feature ids: row r has ``ids[offsets[r]:offsets[r + 1]]``, one id or more.
Ragged = tuple[np.ndarray, np.ndarray]


def hashed(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & _MASK


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    strings = strings.cast(pa.string())
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32, len(strings) + 1, strings.offset * 4).astype(np.int64) if offsets else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
    """A hash of each span of bytes: the sum of byte times a random odd number of its place, mixed."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], size)
    factor = _mixed(np.arange(1, int(size.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    terms = (data[np.repeat(start, size) + place].astype(np.uint64) + np.uint64(1)) * factor[place]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])     # wraps, and so do differences
    return _mixed(total[first[1:]] - total[first[:-1]] + np.uint64(kind * 0xD1B54A32D192ED03 % 2 ** 64))


def _ids(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(_MASK)).astype(np.int64)


def word_features(distinct: pa.Array) -> dict[str, np.ndarray]:
    """Features of distinct words.

    ``word``/``prefix``/``shape`` are feature ids of the lower-cased word, of its
    first letters and of what surrounds and cases it; ``caps``, ``marks`` and
    ``digits`` are 1 for words in capitals, with two or more symbols, with digits.
    """
    left = pc.utf8_ltrim(distinct, characters=_EDGES)
    core = pc.utf8_rtrim(left, characters=_EDGES)
    low = pc.utf8_lower(core)
    start, data = _buffers(distinct)
    ends, start = start[1:], start[:-1]
    core_at = start + np.asarray(pc.binary_length(distinct)) - np.asarray(pc.binary_length(left))
    core_end = core_at + np.asarray(pc.binary_length(core))
    size, core_size = (np.asarray(pc.utf8_length(x)).astype(np.int64) for x in (distinct, core))
    caps = np.asarray(pc.utf8_is_upper(core)) & (core_size > 1)
    around = span_hashes(data, start, core_at, 3) + np.uint64(3) * span_hashes(data, core_end, ends, 4) + caps.astype(np.uint64)
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    low_at, low_data = _buffers(low)
    short_at, short_data = _buffers(pc.utf8_slice_codeunits(low, 0, PREFIX))
    return {"word": _ids(span_hashes(low_data, low_at[:-1], low_at[1:], 1)),
            "prefix": _ids(span_hashes(short_data, short_at[:-1], short_at[1:], 2)), "shape": _ids(_mixed(around)),
            "caps": caps.astype(np.int64), "marks": (size - core_size > 1).astype(np.int64),
            "digits": (digit[core_end] > digit[core_at]).astype(np.int64), "size": size}


def buckets(name: str, value: np.ndarray) -> np.ndarray:
    """Feature ids of a figure: shares in twentieths, sizes by half powers of two."""
    large = value > 1
    step = np.where(large, np.log2(np.maximum(value, 1)) * 2, np.rint(value * 20)).astype(np.int64)
    found, at = np.unique(step * 2 + large, return_inverse=True)
    return np.array([hashed(f"{name} {bool(k & 1)} {k >> 1}") for k in found.tolist()], np.int64)[at]


def _pairs(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order of appearance."""
    width = int(code.max(initial=0)) + 1
    return np.divmod(pd.unique(row * width + code), width)


class TextFeatures:
    """Feature sets of the texts of a slice."""

    def __init__(self, texts: pa.Array):
        self.texts = pc.fill_null(texts, "")
        self.words = Words.of(self.texts)
        self.of_word = word_features(self.words.distinct)
        self.row, self.code = _pairs(self.words.rows(), self.words.codes)

    def __len__(self) -> int:
        return len(self.texts)

    def kind(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature id) of one kind of the words' features."""
        code, ids = pd.factorize(self.of_word[name])
        row, at = _pairs(self.row, code[self.code])
        return row, ids[at]

    def share(self, of_word: str) -> np.ndarray:
        return self.words.sums(self.of_word[of_word]) / np.maximum(1, self.words.counts())

    def distinct_share(self) -> np.ndarray:
        return np.bincount(self.row, minlength=len(self)) / np.maximum(1, self.words.counts())

    def repeat_share(self) -> np.ndarray:
        """How many words are the same as the word before."""
        row, code = self.words.rows(), self.words.codes
        again = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
        return np.bincount(row[1:][again], minlength=len(self)) / np.maximum(1, self.words.counts())

    def ragged(self, kinds: list[str], each: list[np.ndarray]) -> Ragged:
        """Feature sets of some kinds of features and of arrays with one id a row; all rows have the constant ``bias``."""
        every = np.arange(len(self))
        parts = [self.kind(k) for k in kinds] + [(every, x) for x in (*each, np.full(len(self), hashed("bias")))]
        row = np.concatenate([p[0] for p in parts])
        order = np.argsort(row, kind="stable")
        ids = np.concatenate([p[1] for p in parts])[order].astype(np.int32)
        return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(self)))]), ids


def term_features(f: TextFeatures) -> Ragged:
    """A text's words and their prefixes."""
    return f.ragged(["word", "prefix"], [])


def style_features(f: TextFeatures) -> Ragged:
    """Terms, word shapes and buckets of how far the text repeats itself, shouts or is made of symbols."""
    return f.ragged(["word", "shape"], [
        buckets("same as before", f.repeat_share()), buckets("distinct", f.distinct_share()),
        buckets("capitals", f.share("caps")), buckets("marks", f.share("marks"))])


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, TextFeatures]]:
    """Parts of a batch whose texts hold a few MB, and their features."""
    for a, b in text_slices(batch[text]):
        part = batch.slice(a, b - a)
        yield part, TextFeatures(part[text])


def ragged(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, all ids) of rows that each have one id or more."""
    return np.cumsum([0, *map(len, rows)])[:-1], np.concatenate(rows) if rows else np.zeros(0, np.int32)


def chosen(labels: DataFrame, label_cols: list[str], sample: int, where=None) -> DataFrame:
    """At most ``sample`` labelled ids in the order of a hash of the id: ``_id`` and the labels.

    Ids that are labelled more than once take their largest label; rows without
    an id or with a label other than 0 or 1 are not used.
    """
    good = F.lit(True) if where is None else where
    for c in label_cols:
        good = good & F.col(c).isin(0, 1)
    return (labels.where(F.col("doc_id").isNotNull() & good).groupBy(F.col("doc_id").cast("bigint").alias("_id"))
            .agg(*[F.max(c).cast("int").alias(c) for c in label_cols])
            .orderBy(F.xxhash64("_id"), "_id").limit(sample))


def gather(docs: DataFrame, ids: DataFrame, label_cols: list[str], features: Callable, columns: list[str],
           views: int = 1) -> tuple[list[list[np.ndarray]], np.ndarray, list[int]]:
    """Features (per view), labels and ids of the documents in ``ids``, a bounded sample that is broadcast.

    ``features`` gives, for a part of a batch of ``columns`` and its
    :class:`TextFeatures`, one :data:`Ragged` per view. Only the sample's feature
    ids reach the driver; a repeated id counts once.
    """
    names = [f"f{k}" for k in range(views)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, f in slices(batch):
                found = [[ids[a:b].tobytes() for a, b in zip(offsets, offsets[1:])] for offsets, ids in features(part, f)]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in ("_id", *label_cols)],
                                                  *[pa.array(x, pa.binary()) for x in found]], ["_id", *label_cols, *names])

    rows = (docs.select(F.col("doc_id").cast("bigint").alias("_id"), *columns).join(F.broadcast(ids), "_id")
            .select("_id", *label_cols, *columns)
            .mapInArrow(run, ", ".join(["_id bigint", *[f"{c} int" for c in label_cols],
                                        *[f"{n} binary" for n in names]])).collect())
    rows = list({r["_id"]: r for r in sorted(rows, key=lambda r: (r["_id"], *[r[n] for n in names]))}.values())
    views_out = [[np.frombuffer(r[n], np.int32) for r in rows] for n in names]
    labels = np.array([[r[c] for c in label_cols] for r in rows], np.int64).reshape(len(rows), len(label_cols))
    return views_out, labels, [r["_id"] for r in rows]

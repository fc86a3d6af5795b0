"""Packing documents into fixed-length sequences: shortest pack first over the length histogram.

1. One pass tokenises every whole text, cuts its ids into full sequences and a
   rest, and keeps only each piece's place, length and CRC.
2. The histogram of piece lengths (at most ``length`` rows) is all that the
   driver sees. Lengths are placed longest first, each into the packing
   patterns with the most room left; pattern counts are updated, so the work
   depends on the number of lengths and not on the number of documents.
3. Patterns are joined back by rank: the n-th piece of a length takes the n-th
   place that the patterns have for that length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, gapless_rank, materialize
from .words import Words, text_slices

LENGTH = 2048
END_ID = 1
CACHE_WORDS = 500_000
_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130),
                             *range(0x131, 0x180)]))
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: A word of Latin letters, which the tokenizer takes as one piece, and the marks after it, which it takes as another
_LATIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]+[!-&(-/:-@\[-`{-~]*$"
#: Arrow splits at these, the tokenizer doesn't
_SEPARATORS = r"[\x1c-\x1f]"


def joined(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of ``values`` one after the other."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


class TokenStore:
    """Ids of words and parts of words, learnt when they are first met; ``limit`` of them are remembered."""

    def __init__(self, limit: int):
        self.limit, self.place = limit, {}
        self.flat, self.start, self.size, self.uses = np.zeros(0, "<u4"), *(np.zeros(0, np.int64) for _ in range(3))

    def turn(self) -> None:
        """If there are too many, keep those used most, at most half."""
        if len(self.size) > self.limit:
            best = np.argsort(-self.uses, kind="stable")[:self.limit // 2]
            best = best[self.uses[best] > 1]
            words = list(self.place)
            self.place = {words[k]: at for at, k in enumerate(best.tolist())}
            self.flat, self.size = joined(self.flat, self.start[best], self.size[best]), self.size[best]
            self.start, self.uses = np.cumsum(self.size) - self.size, np.ones(len(best), np.int64)

    def places(self, words: list[str], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The place of each of the distinct ``words``; ``learn`` gives all ids and the sizes of new ones."""
        new = [w for w in words if w not in self.place]
        if new:
            flat, size = learn(new)
            self.place.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        self.uses[at] += 1
        return at


class WordTokens:
    """Ids of texts by their distinct white-space separated words.

    For tokenizers that drop white space, lower-case, never merge across white
    space or between letters and marks, and mark the end of a word. Words and
    parts are remembered for all tasks of a worker process.
    """

    def __init__(self, spec: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.spec, self.tokenizer = spec, Tokenizer.from_str(spec)
        self.cores, self.whole = TokenStore(limit), TokenStore(limit)
        # lower-case Latin words need no normaliser and no pattern: the same model behind plain white space
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = json.loads(spec)["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn_cores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All in one call with spaces between them; the last id of each is marked as such."""
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _learn_whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(ids), np.array([*map(len, ids)], np.int64)

    def _spans(self, store: TokenStore, strings: pa.Array, learn: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Start and size in ``store.flat`` for each string."""
        coded = strings.dictionary_encode()
        at = store.places(coded.dictionary.to_pylist(), learn)[np.asarray(coded.indices)]
        return store.start[at], store.size[at]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts: row r has ``ids[offsets[r]:offsets[r + 1]]``."""
        self.cores.turn()
        self.whole.turn()
        odd = np.asarray(pc.match_substring_regex(texts, _SEPARATORS))
        words = Words.of(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, pc.utf8_split_whitespace)
        distinct = words.distinct
        latin = np.asarray(pc.match_substring_regex(distinct, _LATIN))
        simple, other = distinct.filter(pa.array(latin)), distinct.filter(pa.array(~latin))
        core = pc.utf8_lower(pc.utf8_rtrim(simple, characters=_MARKS))
        marks = pc.utf8_ltrim(simple, characters=_LETTERS)
        # the ids of each distinct word: those of its core and of its marks, or of the word as a whole
        start, size = np.zeros((2, len(distinct)), np.int64), np.zeros((2, len(distinct)), np.int64)
        start[0, latin], size[0, latin] = self._spans(self.cores, core, self._learn_cores)
        for which, strings in ((latin, marks), (~latin, other)):
            begin, n = self._spans(self.whole, strings, self._learn_whole)
            start[1, which], size[1, which] = begin + len(self.cores.flat), n
        own = joined(np.concatenate([self.cores.flat, self.whole.flat]), start.T.ravel(), size.T.ravel())
        each = size.sum(axis=0)
        begin = np.cumsum(each) - each
        ids = joined(own, begin[words.codes], each[words.codes])
        offsets = np.concatenate([[0], np.cumsum(words.sums(each))])
        if odd.any():
            rows = [self.encode(t) if o else ids[a:b]
                    for t, o, a, b in zip(texts.to_pylist(), odd, offsets, offsets[1:])]
            offsets, ids = np.concatenate([[0], np.cumsum([*map(len, rows)])]), np.concatenate(rows)
        return offsets, ids


_shared: list[WordTokens] = []


def word_tokens(spec: str) -> WordTokens:
    """The words of this worker process: they outlast a task, and are dropped for another tokenizer."""
    if not _shared or _shared[0].spec != spec:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # a task has one core
        _shared[:] = [WordTokens(spec)]
    return _shared[0]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: full sequences and a rest for each document.

    Every document ends with ``end_id``, so empty and null texts have one
    piece of one id. The tokenizer's file is read by the driver and broadcast
    (a fixed size); texts are encoded where they are scanned.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(spec.value)
        for batch in batches:
            at, rows = [], []
            for a, b in text_slices(batch["text"]):
                offsets, ids = words.texts(pc.fill_null(batch["text"][a:b], ""))
                data = memoryview(ids.tobytes())
                for i, first, last in zip(range(a, b), offsets.tolist(), offsets[1:].tolist()):
                    n = last - first + 1            # with the end id
                    for begin in range(0, n, length):
                        crc = zlib.crc32(data[(first + begin) * 4:min(first + begin + length, last) * 4])
                        at.append(i)
                        rows.append((begin, min(length, n - begin), crc if begin + length < n else zlib.crc32(end, crc), n))
            figures = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())),
                                              *map(pa.array, figures.T)], names)

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, ", ".join(f"{c} bigint" for c in names)))


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """Packing patterns ``(count, lengths)`` that place every piece of the histogram.

    Lengths go longest first, each into the shortest packs, those with the
    most room left, as long as it fits there; else into new packs, one filled
    after the other. The packs are those that single pieces in this order give. Patterns
    are kept with their counts, and a pattern of which only some packs take a
    piece is split in two.
    """
    room: dict[int, list[tuple[int, list[int]]]] = {}
    open_rooms: list[int] = []
    for size in sorted((s for s, n in histogram.items() if n), reverse=True):
        left = histogram[size]
        if not 0 < size <= length:
            raise ValueError(f"a piece of {size} does not fit {length}")
        while left:
            while open_rooms and not room.get(-open_rooms[0]):
                heappop(open_rooms)
            most = -open_rooms[0] if open_rooms else -1
            if most < size:
                # a new pack has the most room until it is full: so many pieces fill one after the other
                each = min(left, length // size)
                take, pattern, rest, left = left // each, [size] * each, length - each * size, left % each
            else:
                packs, pattern = room[most].pop()
                take = min(left, packs)
                if take < packs:
                    room[most].append((packs - take, pattern))
                pattern, rest, left = [*pattern, size], most - size, left - take
            if not room.get(rest):
                room[rest] = []
                heappush(open_rooms, -rest)
            room[rest].append((take, pattern))
    return [p for rest in sorted(room) for p in room[rest]]


def places(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each place in a pattern: length, first rank, first sequence, offset; sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for packs, lengths in patterns:
        offset = 0
        for size in lengths:
            rows.append((size, used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + packs
            offset += size
        sequence += packs
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Packed pieces: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Sequences hold at most ``length`` ids, filled from offset 0 without gaps;
    their ids run from 0. Repeated rows and rows with a null id are documents
    like others. Further columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    block = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks_for(spark))).cast("int")
    stored = materialize(pieces(docs, tokenizer_path, id_col, text_col, length, end_id).withColumn("_block", block),
                         "pieces")
    histogram = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(shortest_pack_first(histogram, length)))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "start", "ids_crc32", "doc_tokens")]
    ranked = gapless_rank(stored, ["length"], "_block", order, "_rank").drop("_block")

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = where.value
        key = (at["length"] << 44) + at["rank"]
        for batch in batches:
            size, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            k = np.searchsorted(key, (size << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in names], pa.array(at["sequence"][k] + rank - at["rank"][k]),
                 pa.array(at["offset"][k])], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(
        run, ", ".join(f"{c} bigint" for c in [*names, "sequence_id", "offset"]))

"""Substring dedup by suffix automata of reference shards.

A word is removed if it lies in a window of ``length`` words that also starts
in a document with a smaller id. The reference is the corpus itself, which has
no size bound, so its shards are cut by content: each window belongs to the
smallest-hashed run of ``ANCHOR`` words in it (its anchor), and neighbouring
windows with one anchor form a passage. Equal windows have equal anchors, so
all places that can match a passage are in its anchor's shard, and each
shard's automata are needed, and held, only where its passages are streamed.

1. Each task cuts its documents and sends every distinct passage of some
   thousand documents once to its shard, with the places where it stands.
   Anchors that a sample finds in a good part of all documents (a bounded list)
   are routed apart: each of their windows goes to a shard by its own words.
   The sample decides where windows go, not what is found.
2. In a shard, the passages of an anchor are put into a suffix automaton in the
   order of their first documents, so a state's first document is the smallest
   that has its words. Each passage is then streamed through it; the matching
   statistics, cut at the window's length, give the first document of each window.
3. Runs of words in windows with an earlier document go to the documents'
   blocks, where they are removed from the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST

LENGTH = 13
ANCHOR = 3
DOCS_A_BLOCK = 2048
DOCS_A_SHARD = 1000
HOT_SHARE = 500
SAMPLE = 16
WORDS_HELD = 1_000_000
WORDS_KNOWN = 400_000
_ODD = [((2 * k + 1) * 0x9E3779B97F4A7C15 | 1) % 2 ** 64 for k in range(64)]


class SuffixAutomaton:
    """Suffix automaton of several word sequences; ``first[s]`` is the document of the earliest of them in state s."""

    def __init__(self):
        self.size, self.link, self.next, self.first = [0], [-1], [{}], [0]

    def _state(self, size: int, link: int, step: dict, first: int) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(step)
        self.first.append(first)
        return len(self.size) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state that ``p`` reaches by ``word``, cloned if it also holds longer sequences."""
        size, link, step = self.size, self.link, self.next
        q = step[p][word]
        if size[p] + 1 == size[q]:
            return q
        clone = self._state(size[p] + 1, link[q], dict(step[q]), self.first[q])
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, words: list[bytes], document: int) -> None:
        """Add a sequence; documents have to come in ascending order."""
        size, link, step = self.size, self.link, self.next
        last = 0
        for word in words:
            if word in step[last]:
                last = self._split(last, word)
                continue
            new = self._state(size[last] + 1, 0, {}, document)
            p = last
            while p >= 0 and word not in step[p]:
                step[p][word] = new
                p = link[p]
            link[new] = 0 if p < 0 else self._split(p, word)
            last = new

    def first_documents(self, words: list[bytes], length: int) -> list[int | None]:
        """For each run of ``length`` words the first document that has it; None if none has."""
        size, link, step, first = self.size, self.link, self.next, self.first
        at = matched = 0
        out = []
        for k, word in enumerate(words):
            while at and word not in step[at]:
                at = link[at]
                matched = size[at]
            if word in step[at]:
                at = step[at][word]
                matched += 1
            while at and size[link[at]] >= length:      # keep to the state of the last `length` words
                at = link[at]
                matched = size[at]
            if k >= length - 1:
                out.append(first[at] if matched >= length else None)
        return out


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words from their hashes."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out += h[k:len(h) - n + 1 + k] * np.uint64(_ODD[k])
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(32)


class Cutter:
    """Cuts documents into passages. Remembers a bounded number of word hashes."""

    def __init__(self, shards: int, hot: np.ndarray, length: int = LENGTH):
        self.shards, self.hot, self.length, self.words = shards, hot, length, _Words()

    def anchors(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each run of ``ANCHOR`` words, place of each window's anchor, and the word hashes."""
        if len(self.words) > WORDS_KNOWN:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        runs = _mixed(h, ANCHOR)
        inside = np.lib.stride_tricks.sliding_window_view(runs, self.length - ANCHOR + 1)
        return runs, np.arange(len(inside)) + inside.argmin(axis=1), h

    def passages(self, words: list[bytes]) -> tuple[list[int], list[int], list[int], list[int]]:
        """First word, number of words, place of the anchor and shard of each passage."""
        if len(words) < self.length:
            return [], [], [], []
        runs, at, h = self.anchors(words)
        start = np.flatnonzero(np.diff(at, prepend=-1))
        end = np.append(start[1:], len(at))
        key = runs[at[start]]
        if len(self.hot):
            k = np.searchsorted(self.hot, key).clip(max=len(self.hot) - 1)
            hot = self.hot[k] == key
            if hot.any():       # each window of a hot anchor by itself
                alone = np.concatenate([np.arange(a, b) for a, b in zip(start[hot], end[hot])])
                start, end = np.concatenate([start[~hot], alone]), np.concatenate([end[~hot], alone + 1])
                key = np.concatenate([key[~hot], _mixed(h, self.length)[alone]])
        n = end - start + self.length - 1
        return start.tolist(), n.tolist(), (at[start] - start).tolist(), (key % np.uint64(self.shards)).tolist()


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _tag(words: list[bytes]) -> int:
    """Tells rows with one id and different texts apart."""
    return zlib.crc32(b" ".join(words)) & 0xFFFF


class _Passages:
    """The distinct passages of some documents by shard, with their places (id, first word, tag)."""

    def __init__(self, cutter: Cutter):
        self.cutter, self.shards, self.words = cutter, {}, 0

    def add(self, key: int, words: list[bytes]) -> None:
        self.words += len(words)
        tag = _tag(words)
        for start, size, at, shard in zip(*self.cutter.passages(words)):
            there = self.shards.setdefault(shard, {})
            text = b" ".join(words[start:start + size])
            places = there.get(text)
            if places is None:
                there[text] = [at, key, start, tag]
            else:
                places += (key, start, tag)

    def packed(self) -> list[tuple[int, bytes]]:
        """(shard, data) for each shard."""
        out = []
        for shard, there in self.shards.items():
            flat = np.fromiter((x for p in there.values() for x in p[1:]), np.int64).reshape(-1, 3)
            n = np.fromiter(((len(p) - 1) // 3 for p in there.values()), "<i4", len(there))
            parts = [np.array([len(there), len(flat)], "<i4"), n, flat[:, 0].astype("<i8"), flat[:, 1].astype("<i4"),
                     flat[:, 2].astype("<u2"), np.fromiter((p[0] for p in there.values()), np.uint8, len(there))]
            out.append((shard, zstandard.compress(b"".join(x.tobytes() for x in parts) + b"\n".join(there), 5)))
        return out


def _unpacked(data: bytes) -> tuple:
    """(number of places per passage, ids, first words, tags, anchor places, passages)."""
    raw = zstandard.decompress(data)
    n, m = np.frombuffer(raw, "<i4", 2).tolist()
    out, at = [], 8
    for kind, size in (("<i4", n), ("<i8", m), ("<i4", m), ("<u2", m), ("u1", n)):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    return *out, raw[at:].split(b"\n")


def _runs(first: np.ndarray, key: int, start: int, length: int) -> list[tuple[int, int]]:
    """(begin, end) of the words in windows whose first document is before ``key``."""
    early = np.flatnonzero(first < key)
    if not len(early):
        return []
    cut = np.flatnonzero(np.diff(early) > length) + 1
    return [(start + int(p[0]), start + int(p[-1]) + length) for p in np.split(early, cut)]


def first_documents(passages: dict[bytes, tuple[int, int, int]], length: int = LENGTH) -> dict[bytes, list[int]]:
    """First document of each window of the passages that another document may share.

    ``passages`` maps a passage to its smallest id, largest id and anchor place.
    """
    groups: dict[bytes, list[bytes]] = {}
    for text, (_, _, at) in passages.items():
        groups.setdefault(b" ".join(text.split(b" ", at + ANCHOR)[at:at + ANCHOR]), []).append(text)
    out = {}
    for texts in groups.values():
        low, high = min(passages[t][0] for t in texts), max(passages[t][1] for t in texts)
        if low == high:
            continue
        if len(texts) == 1:
            out[texts[0]] = [low] * (texts[0].count(b" ") + 2 - length)
            continue
        split = {t: t.split(b" ") for t in texts}
        automaton = SuffixAutomaton()
        for t in sorted(texts, key=lambda t: passages[t][0]):
            automaton.add(split[t], passages[t][0])
        for t in texts:
            out[t] = automaton.first_documents(split[t], length)
    return out


def _blocks_of(keys: np.ndarray, tags: np.ndarray, blocks: int) -> np.ndarray:
    """A hash of the id, of the text where there is no id: ids with a stride, or rows without one, are spread as well."""
    x = np.where(keys == LOWEST, tags, keys).astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(blocks)).astype(np.int64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space).

    Words are runs without ASCII white space, unchanged. Windows are judged on
    the input. Rows with one id (repeated rows) are no repeats of each other; a
    null id counts as smaller than all others. Null and short texts lose
    nothing. Further columns are not read; an empty table gives no rows.
    """
    if not ANCHOR < length <= 64:
        raise ValueError(f"windows of {ANCHOR + 1} to 64 words")
    spark = docs.sparkSession
    n, partitions = docs.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, shards = max(2 * partitions, n // DOCS_A_BLOCK), max(2 * partitions, n // DOCS_A_SHARD)
    doc = F.col(id_col).cast("bigint")
    rows = docs.select(F.coalesce(doc, F.lit(LOWEST)).alias("key"), doc.isNotNull().alias("known"),
                       F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shards, np.zeros(0, np.uint64), length)
        for batch in batches:
            found = []
            for text in batch["text"]:
                words = _split(text.as_py())
                if len(words) >= length:
                    runs, at, _ = cutter.anchors(words)
                    found.append(np.unique(runs[at]))
            ids, times = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            keep = times > 1
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))],
                                             ["anchor", "n"])

    seen = rows.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select("text")
    many = (seen.mapInArrow(count, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= max(8, n // SAMPLE // HOT_SHARE)))
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["anchor"] for r in many.collect()], np.int64).view(np.uint64)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shards, hot.value, length)
        held = _Passages(cutter)

        def out() -> pa.RecordBatch:
            packed = held.packed()
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in packed], pa.int32()),
                                               pa.array([d for _, d in packed], pa.binary())], ["shard", "data"])

        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                held.add(key.as_py(), _split(text.as_py()))
                if held.words >= WORDS_HELD:
                    yield out()
                    held = _Passages(cutter)
        yield out()

    def match(shard: pd.DataFrame) -> pd.DataFrame:
        passages: dict[bytes, tuple[int, int, int]] = {}
        for data in shard["data"]:
            counts, ids, _, _, at, texts = _unpacked(data)
            begin = np.cumsum(counts) - counts
            for t, a, b, k in zip(texts, np.minimum.reduceat(ids, begin).tolist(),
                                  np.maximum.reduceat(ids, begin).tolist(), at.tolist()):
                x = passages.get(t)
                passages[t] = (a, b, k) if x is None else (min(a, x[0]), max(b, x[1]), k)
        firsts = {t: f for t, f in first_documents(passages, length).items() if min(f) < passages[t][1]}
        del passages
        found: list[tuple[int, int, int, int]] = []
        for data in shard["data"]:
            counts, ids, starts, tags, _, texts = _unpacked(data)
            end = np.cumsum(counts)
            for t, a, b in zip(texts, (end - counts).tolist(), end.tolist()):
                f = firsts.get(t)
                if f is None:
                    continue
                low, high = min(f), max(f)
                for key, start, tag in zip(ids[a:b].tolist(), starts[a:b].tolist(), tags[a:b].tolist()):
                    if key > high:
                        found.append((key, tag, start, start + len(f) - 1 + length))
                    elif key > low:
                        found += [(key, tag, x, y) for x, y in _runs(np.array(f), key, start, length)]
        spans = np.array(found, np.int64).reshape(-1, 4)
        block = _blocks_of(spans[:, 0], spans[:, 1], blocks)
        order = np.lexsort((spans[:, 2], spans[:, 0], block))
        spans, block = spans[order], block[order]
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        return pd.DataFrame({"block": block[cut].astype(np.int32), "spans": [
            zstandard.compress(p.tobytes(order="F"), 5) for p in np.split(spans, cut[1:])] if len(spans) else []})

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts go to their blocks compressed: they are the larger part of what is shuffled."""
        for batch in batches:
            packed = [zstandard.compress((t.as_py() or "").encode("utf-8", "surrogatepass"), 3) for t in batch["text"]]
            keys, tags = batch["key"].to_numpy(), np.zeros(len(batch), np.int64)
            for k in np.flatnonzero(keys == LOWEST).tolist():
                tags[k] = _tag(_split(batch["text"][k].as_py()))
            block = pa.array(_blocks_of(keys, tags, blocks).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["known"], block, pa.array(packed, pa.binary())],
                                             ["key", "known", "block", "text"])

    def finish(block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(zstandard.decompress(d), np.int64).reshape(4, -1).T for d in replies["spans"]]
        spans = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        out = []
        for key, known, text in zip(block["key"].tolist(), block["known"].tolist(), block["text"]):
            words = zstandard.decompress(text).split()
            a, b = np.searchsorted(spans[:, 0], [key, key + 1]).tolist()
            gone, kept = 0, words
            if a < b:
                mask, tag = np.zeros(len(words), bool), _tag(words)
                for _, own, begin, end in spans[a:b].tolist():
                    if own == tag:
                        mask[begin:end] = True
                gone = int(mask.sum())
                kept = [words[i] for i in np.flatnonzero(~mask).tolist()]
            out.append((key, known, len(words), gone, b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["key", "known", "n_words", "n_removed", "kept_text"])

    spans = rows.select("key", "text").mapInArrow(send, "shard int, data binary").groupBy("shard").applyInPandas(
        match, "block int, spans binary")
    dealt = rows.select("key", "known", "text").mapInArrow(
        squeeze, "key bigint, known boolean, block int, text binary")
    done = dealt.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(
        finish, "key bigint, known boolean, n_words bigint, n_removed bigint, kept_text string")
    return done.select(F.when(F.col("known"), F.col("key")).alias("doc_id"), "n_words", "n_removed", "kept_text")

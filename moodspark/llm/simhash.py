"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into ``segments`` of equal width. If two fingerprints
differ in at most ``d`` bits, then for some segment they differ there in at
most ``d // m`` bits (in the segments after the first ``d % m + 1``, in at most
``d // m - 1``). So each segment has a table from segment value to
fingerprint, every fingerprint looks up the small Hamming ball around its own
segment value, and each match is verified over all 64 bits.

Buckets of more than ``bucket`` fingerprints (a segment value shared by a large
group of near copies) get an index of their own instead of a quadratic join:
fingerprints that look into such a bucket are listed under all 64-bit values in
a ball of half the distance. Two of them within the distance meet under the
value half-way; a list holds at most the ball around its value, however
large the group, and for an even distance all its members are links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_names, materialize

BITS = 64
BUCKET = 64
_CHUNK = 1 << 15


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a whole text; 0 if it has no word.

    Words are runs without ASCII white space, A-Z lower-cased; a shingle is
    ``shingle`` words joined by a space, hashed by XXH64 (UTF-8). Texts of
    fewer words have one shingle, the whole sequence. A bit is set if it is set
    in over half of the hashes, repeats counted.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, seed)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[:n].tolist(), end[shingle - 1:].tolist())),
                         np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, _CHUNK):
        octets = hashes[k:k + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (bigint: the 64 bits) for every row; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), shingle, seed) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id bigint, fp bigint"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ball(width: int, radius: int, shift: int = 0) -> list[int]:
    """All masks with at most ``radius`` of ``width`` bits set, shifted, as signed 64-bit values."""
    return [_signed(sum(1 << (b + shift) for b in bits)) for r in range(radius + 1)
            for bits in combinations(range(width), r)]


def _segments(max_bits: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """(segment, mask of its bits, masks of its ball) for the segments that have to be looked up."""
    width, out = BITS // segments, []
    for s in range(segments):
        radius = max_bits // segments - (s > max_bits % segments)
        bits = width if s < segments - 1 else BITS - width * (segments - 1)
        if radius >= 0:
            out.append((s, _signed(((1 << bits) - 1) << (s * width)), ball(bits, radius, s * width)))
    return out


def links(fps: DataFrame, max_bits: int = 2, segments: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` between the distinct values of ``fps.fp`` that connect all at most ``max_bits`` apart.

    Every edge is verified to be within the distance; edges implied by others
    through the same half-way value may be missing, components are whole.
    """
    parts = _segments(max_bits, segments)
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits

    def keys(name: str, masks: list[tuple[int, int, int]]) -> DataFrame:
        """A row for each mask; of two values that differ by it, only the one whose lowest bit there is unset looks up."""
        rows = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m"), F.lit(x).alias("x"),
                                  F.lit(_signed((x & -x) % 2 ** 64)).alias("low")) for s, m, x in masks])
        return (fps.select(F.col("fp").alias(name), F.explode(rows).alias("p"))
                .where(F.col(name).bitwiseAND(F.col("p.low")) == 0).select(name, F.col("p.s").alias("s"),
                        F.col(name).bitwiseXOR(F.col("p.x")).bitwiseAND(F.col("p.m")).alias("key")))

    table = keys("b", [(s, m, 0) for s, m, _ in parts])
    probes = keys("a", [(s, m, x) for s, m, masks in parts for x in masks])
    large = (table.groupBy("s", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
             .select("s", "key", F.lit(True).alias("large")))
    small = (probes.join(table.join(large, ["s", "key"], "left_anti"), ["s", "key"])
             .where("a <> b").where(within).select("a", "b"))
    crowd = probes.join(large, ["s", "key"], "left_semi").select(F.col("a").alias("fp")).distinct()

    def listed(name: str, radius: int) -> DataFrame:
        masks = F.split(F.lit(",".join(map(str, ball(BITS, radius)))), ",").cast("array<bigint>")
        return crowd.select(F.col("fp").alias(name), F.explode(masks).alias("x")).select(
            name, F.col(name).bitwiseXOR(F.col("x")).alias("key"))

    if max_bits % 2 == 0:
        at = listed("fp", max_bits // 2).groupBy("key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        met = at.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    else:
        met = listed("a", max_bits // 2).join(listed("b", max_bits // 2 + 1), "key").select("a", "b")
    return small.union(met.where("a <> b").where(within))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                max_bits: int = 2, seed: int = 42, segments: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``, the smallest id reachable over links.

    Rows with equal fingerprints are linked, whatever their texts: they become
    one class before any join, so copies are never expanded into pairs. Null
    texts and texts without words have fingerprint 0. A null id is kept as a
    row; it never is a component's smallest id unless all its ids are null.
    Further columns are not read; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash_classes")
    roots = materialize(components(links(classes.select("fp"), max_bits, segments, bucket)), "simhash_roots")
    merged = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = merged.groupBy("root").agg(F.min("first").alias("component_id"))
    component = merged.join(least, "root").select("fp", "component_id")
    return rows.join(component, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(col: str = "fp"):
    """The fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id; all columns kept, whatever their names.

    A group whose ids are all null keeps one row. Rows with one id are copies
    of one document if their fingerprints are linked; one of them stays. Each
    row is shuffled once, by its id, to meet the ids that stay.
    """
    groups = near_groups(docs, id_col, text_col, **how)
    none = groups.where("component_id is null").groupBy("fp").agg(F.lit(1).alias("one"))
    (key,) = free_names(docs, "key")
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    with_id = docs.withColumn(key, F.col(id_col).cast("bigint")).join(keep, key, "left_semi").dropDuplicates([key]).drop(key)
    if none.isEmpty():
        return with_id
    nameless = docs.where(F.col(id_col).isNull()).dropDuplicates([text_col])
    return with_id.unionByName(_one_of_each(nameless, text_col, none, **how))


def _one_of_each(nameless: DataFrame, text_col: str, none: DataFrame, **how) -> DataFrame:
    """One row of each group among rows without ids: they get ids for the purpose."""
    (own,) = free_names(nameless, "own")
    named = materialize(nameless.withColumn(own, F.monotonically_increasing_id()), "simhash_nameless")
    groups = near_groups(named, own, text_col, **how).join(none, "fp", "left_semi")
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias(own))
    return named.join(keep, own, "left_semi").drop(own)

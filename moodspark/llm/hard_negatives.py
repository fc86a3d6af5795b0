"""Hard-negative mining with whole exact scores by the Four Russians' method.

Vectors are quantised to integers. A row is stored as bit planes in two's
complement: for each plane, one byte per group of eight dimensions. For an
anchor, each group has a table of the sums of all 256 subsets of its eight
components. An inner product is then, plane by plane, the sum of the table
entries that the row's bytes point at, shifted by the plane's place and added
up (subtracted for the plane of the sign). No product is formed, and nothing is
approximate.

The anchors are a stated query set. They go in blocks whose tables have a fixed
size: a block is broadcast, and each task scans its own rows against it. Tasks
keep the best few rows per anchor, so what is shuffled does not grow with the
table. A first scan finds the positives (only rows of the anchor's label are
scored), a second one the negatives within the window of each positive.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checkpoint_dir
from .common import materialize

GROUP = 8
TABLE_BYTES = 64 << 20
_ANCHORS, _ROWS = 256, 512          # scored together: tables and sums stay in a core's cache
_LOW = np.iinfo(np.int64).min


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``id, label, v`` (array of double) of the rows with an id, a label and a vector of finite components only."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad)


def bit_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Bytes (rows, planes, groups) of integers (rows, groups * 8) in two's complement."""
    n, dims = values.shape
    bits = (values[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.reshape(n, planes, dims // GROUP, GROUP).astype(np.uint8), axis=3, bitorder="little")[..., 0]


def from_planes(octets: np.ndarray) -> np.ndarray:
    """The integers (rows, groups * 8) of their bit planes."""
    n, planes, groups = octets.shape
    bits = np.unpackbits(octets[..., None], axis=3, bitorder="little").reshape(n, planes, groups * GROUP).astype(np.int64)
    weight = 1 << np.arange(planes, dtype=np.int64)
    weight[-1] = -weight[-1]
    return np.einsum("npd,p->nd", bits, weight)


def encode(rows: DataFrame, planes: int, groups: int, scale: int) -> DataFrame:
    """``uid, id, label, planes``: components become floor(scale * x); short vectors count as padded with zeros."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["v"]
            size = v.value_lengths().to_numpy(zero_copy_only=False)
            whole = np.zeros((len(batch), groups * GROUP), np.int64)
            whole[np.arange(groups * GROUP) < size[:, None]] = np.floor(v.flatten().to_numpy() * scale).astype(np.int64)
            packed = bit_planes(whole, planes).reshape(len(batch), planes * groups)
            yield pa.RecordBatch.from_arrays(
                [batch["uid"], batch["id"], batch["label"], pa.array([r.tobytes() for r in packed], pa.binary())],
                ["uid", "id", "label", "planes"])

    return rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "label", "v").mapInArrow(
        run, "uid bigint, id bigint, label bigint, planes binary")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (groups, 256, anchors): the sum of each subset of an anchor's eight components of a group."""
    n, dims = anchors.shape
    by_group = anchors.T.reshape(dims // GROUP, GROUP, n)
    small = dims * int(np.abs(anchors).max(initial=0)) < 2 ** 15
    out = np.zeros((dims // GROUP, 1 << GROUP, n), np.int16 if small else np.int64)
    for j in range(GROUP):
        out[:, 1 << j:2 << j] = out[:, :1 << j] + by_group[:, j, None, :]
    return out


def table_scores(octets: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products (rows, anchors) of rows given as bit planes with the anchors of ``tables``."""
    n, planes, groups = octets.shape
    total = np.zeros((n, tables.shape[2]), np.int64)
    for b in range(planes):
        place = np.zeros((n, tables.shape[2]), tables.dtype)
        for g in range(groups):
            place += tables[g].take(octets[:, b, g], axis=0)
        shifted = place.astype(np.int64) << b
        total += -shifted if b == planes - 1 else shifted
    return total


class Best:
    """The ``k`` best rows (highest score, then smallest id) of each anchor among those seen."""

    def __init__(self, anchors: int, k: int):
        self.k, self.least = k, np.full(anchors, _LOW)
        self.at = self.score = self.id = self.uid = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, fits: np.ndarray, id_: np.ndarray, uid: np.ndarray) -> None:
        """``score`` and ``fits`` (whether the row counts at all) are (rows, anchors)."""
        fits = fits & (score >= self.least)
        if fits.sum() > 4 * self.k * len(self.least) and len(score) > self.k:
            # rows below the k-th best of this very batch need not be sorted
            place = len(score) - self.k
            fits &= score >= np.partition(np.where(fits, score, _LOW), place, axis=0)[place]
        row, at = np.nonzero(fits)
        if not len(row):
            return
        got = [np.concatenate(p) for p in ((self.at, at), (self.score, score[row, at]), (self.id, id_[row]),
                                           (self.uid, uid[row]))]
        order = np.lexsort((got[3], got[2], -got[1], got[0]))
        got = [x[order] for x in got]
        first = np.searchsorted(got[0], got[0])
        kept = np.arange(len(order)) - first < self.k
        self.at, self.score, self.id, self.uid = (x[kept] for x in got)
        last = (np.arange(len(order)) - first == self.k - 1)[kept]
        self.least[self.at[last]] = self.score[last]


def _octets(batch: pa.RecordBatch, planes: int, groups: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["planes"].to_pylist()), np.uint8).reshape(len(batch), planes, groups)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch[c].to_numpy() for c in ("uid", "id", "label"))


def _scan(encoded: DataFrame, block, shape: tuple[int, int], k: int, windows) -> DataFrame:
    """``a, p, score, id, uid``: the best ``k`` rows that each task finds for anchor number ``a`` of the block.

    Without ``windows``, rows of the anchor's label but the anchor itself count
    (p is 0); else rows of other labels whose score is within the anchor's p-th window.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_uid, a_label, values = block.value
        ranges = windows.value if windows else None
        order = np.argsort(a_label, kind="stable")
        # anchors of one label stand together, so that the first scan leaves out the others
        cuts = (np.searchsorted(a_label[order], np.unique(a_label)).tolist() if ranges is None else [0]) + [len(order)]
        parts = [order[i:min(i + _ANCHORS, hi)] for lo, hi in zip(cuts, cuts[1:]) for i in range(lo, hi, _ANCHORS)]
        tables = [subset_sums(values[p]) for p in parts]
        best = [[Best(len(p), k) for _ in range(1 if ranges is None else ranges.shape[1])] for p in parts]
        for batch in batches:
            uid, id_, label = _columns(batch)
            octets = _octets(batch, *shape)
            for part, table, found in zip(parts, tables, best):
                mine = np.flatnonzero(label == a_label[part[0]]) if ranges is None else np.arange(len(label))
                for i in range(0, len(mine), _ROWS):
                    rows = mine[i:i + _ROWS]
                    score = table_scores(octets[rows], table)
                    if ranges is None:
                        found[0].add(score, uid[rows][:, None] != a_uid[part], id_[rows], uid[rows])
                        continue
                    other = label[rows][:, None] != a_label[part]
                    for p, b in enumerate(found):
                        low, high = ranges[part, p].T
                        b.add(score, other & (score >= low) & (score <= high), id_[rows], uid[rows])
        for part, found in zip(parts, best):
            for p, b in enumerate(found):
                if len(b.at):
                    yield pa.RecordBatch.from_arrays([pa.array(part[b.at]), pa.array(np.full(len(b.at), p)), pa.array(b.score),
                                                      pa.array(b.id), pa.array(b.uid)], ["a", "p", "score", "id", "uid"])

    found = encoded.select("uid", "id", "label", "planes").mapInArrow(
        run, "a bigint, p bigint, score bigint, id bigint, uid bigint")
    place = F.row_number().over(W.partitionBy("a", "p").orderBy(F.desc("score"), "id", "uid"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def windows_of(positive: np.ndarray, low: int, high: int) -> np.ndarray:
    """Smallest and largest negative score (last axis) with low * p <= 100 * n <= high * p; none for a p below 0."""
    return np.stack([-(-low * positive // 100), high * positive // 100], axis=-1)


def mine_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, scale: int = 256, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, and ``positive_rank``.

    Anchors are the rows whose id is divisible by ``every``. Components become
    floor(scale * x), a score is an integer inner product; higher scores come
    first, ties by smaller id. An anchor's positives are its first ``positives``
    other rows of the same label; of each, the first ``negatives`` rows of other
    labels with a score of ``low`` to ``high`` per cent of the positive's are
    returned, all if there are fewer.

    Rows with a null id, label, vector or component or a component that is not
    finite take no part. Vectors of different lengths count as padded with
    zeros, empty ones too. Repeated rows are rows of their own: a copy of the
    anchor can be its positive, and each copy of an anchor has its own rows.
    Vectors so large that scores might not fit a bigint are an error. Further
    columns are not read, whatever their names; an empty table gives no rows.

    The driver sees one block of anchors at a time (tables of at most
    ``table_bytes``, the anchors 32 to 128 times smaller) and its positives. Each
    block's result is written to the shared folder.
    """
    spark = rows.sparkSession
    good = usable(rows, id_col, label_col, vector_col)
    largest, dims = good.agg(F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    groups = max(1, -(-(dims or 0) // GROUP))
    bound = math.floor(scale * (largest or 0.0)) + 1
    if 100 * groups * GROUP * bound * bound >= 2 ** 63:
        raise ValueError(f"components of up to {largest:g} in {dims} dimensions: scores may not fit a bigint")
    shape = (bound.bit_length() + 1, groups)
    encoded = materialize(encode(good, *shape, scale).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions"))), "planes")
    anchors = encoded.where(F.col("id") % every == 0)
    blocks = -(-anchors.count() * groups * (1 << GROUP) * 8 // table_bytes)
    block_no = F.pmod(F.xxhash64("uid"), F.lit(max(blocks, 1)))
    schema = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
              "negative_score bigint, positive_rank int")
    base = f"{checkpoint_dir(spark).rstrip('/')}/tables/negatives-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/block=-1")
    for n in range(blocks):
        taken = anchors.where(block_no == n).orderBy("id", "uid").toArrow().combine_chunks()
        if not len(taken):
            continue
        batch = taken.to_batches()[0]
        uid, id_, label = _columns(batch)
        block = spark.sparkContext.broadcast((uid, label, from_planes(_octets(batch, *shape))))
        found = _scan(encoded, block, shape, positives, None).select("a", "rank", "score", "id").toArrow()
        at, place, score, positive = (found[c].to_numpy() for c in ("a", "rank", "score", "id"))
        ranges = np.empty((len(id_), positives, 2), np.int64)
        ranges[...] = (1, 0)            # nothing is within
        ranges[at, place - 1] = windows_of(score, low, high)
        windows = spark.sparkContext.broadcast(ranges)
        links = spark.createDataFrame(pa.table({
            "a": at, "p": place.astype(np.int64) - 1, "anchor_id": id_[at], "positive_id": positive,
            "positive_score": score}), "a bigint, p bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        (_scan(encoded, block, shape, negatives, windows).join(F.broadcast(links), ["a", "p"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"), (F.col("p") + 1).cast("int").alias("positive_rank"))
         .write.mode("overwrite").parquet(f"{base}/block={n}"))
        block.unpersist()
        windows.unpersist()
    return spark.read.schema(schema).parquet(base).drop("block")

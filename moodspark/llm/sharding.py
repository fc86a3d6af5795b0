"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A row's key descends region, rack and shard. At each level every child draws
-ln(u) / weight, where u in (0, 1) is a hash of (key, child) and the weight is
the number of shards below the child; the smallest draw wins. A child whose
weight grows can only win keys, never lose any to a sibling whose weight is
unchanged, so movement is confined to the subtrees whose weights change.

Shards fill racks, and racks fill regions, in order. While all regions are
full a further shard opens a region of its own, so rows then move only into
the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_of, blocks_for, free_names, gapless_rank, materialize, split_points

SHARDS_PER_RACK = 4
RACKS_PER_REGION = 2
OVERHEAD = 16


def tree(shards: int) -> list[list[list[int]]]:
    """Regions of racks of shard numbers, filled in order."""
    rack = [list(range(i, min(i + SHARDS_PER_RACK, shards))) for i in range(0, shards, SHARDS_PER_RACK)]
    return [rack[i:i + RACKS_PER_REGION] for i in range(0, len(rack), RACKS_PER_REGION)]


def _choose(key: Column, path: list[Column], weights: list[int], width: int) -> Column:
    """Index of the child with the smallest draw.

    ``weights`` lists ``width`` children for every node of the level, in order of
    the nodes; the node is the one that ``path`` (the choices above) leads to. A
    draw is -ln(u) / weight with u from 52 hash bits: the smallest of such draws
    is a choice in proportion to the weights. A child without weight is never chosen.
    """
    at = F.lit(0)
    for level, choice in enumerate(path):
        at = at * (RACKS_PER_REGION if level else 1) + choice
    table = F.array(*map(F.lit, map(float, weights)))

    def draw(i: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(len(path)), *path, F.lit(i)), 12)
        weight = F.element_at(table, at * width + i + 1) if path else F.lit(float(weights[i]))
        return F.when(weight > 0, -F.log((bits.cast("double") + 0.5) / F.lit(float(2 ** 52))) / weight)

    draws = F.array(*[F.coalesce(draw(i), F.lit(float("inf"))) for i in range(width)])
    return F.array_position(draws, F.array_min(draws)).cast("int") - 1


def with_shard(df: DataFrame, key: str, shards: int, name: str) -> DataFrame:
    """Add ``name``: the shard of ``key`` among ``shards``, a function of the key and the shard count alone.

    A null key counts as a key of its own. A level's draws are taken only
    among the children of the node chosen above it. All columns are kept,
    whatever their names; a column ``name`` is replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    layout = tree(shards)
    of = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    racks = [[len(rack) for rack in region] + [0] * (RACKS_PER_REGION - len(region)) for region in layout]
    leaves = [int(k < n) for region in racks for n in region for k in range(SHARDS_PER_RACK)]
    at_region, at_rack = free_names(df, "region", "rack")
    region, rack = F.col(at_region), F.col(at_rack)
    df = df.withColumn(at_region, _choose(of, [], [sum(r) for r in racks], len(layout)))
    df = df.withColumn(at_rack, _choose(of, [region], [n for r in racks for n in r], RACKS_PER_REGION))
    shard = (region * RACKS_PER_REGION + rack) * SHARDS_PER_RACK + _choose(of, [region, rack], leaves, SHARDS_PER_RACK)
    return df.withColumn(name, shard.cast("int")).drop(at_region, at_rack)


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``key``: the id and the shard count decide, so rows with equal
    ids share a shard. That one more shard takes rows only into itself holds
    where all regions are full (a multiple of eight shards); inside a partly
    filled region rows can also move between its shards. Size is the UTF-8 bytes of the text plus 16, a null text
    has none and its CRC is that of the empty text. Rows with a null id go to
    one shard together. ``slot`` numbers a shard's rows from 0 without gaps, by
    id (null first), then CRC and size. Further columns are not read; an empty
    table gives no rows. A shard is numbered in blocks of ids, so no task holds
    a whole shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.col(id_col).cast("bigint")
    points = split_points(docs.select(doc.alias("doc_id")), "doc_id", min(1024, blocks_for(docs.sparkSession, 1)))
    rows = docs.select(
        doc.alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"), F.lit("key").alias("law"),
        block_of(doc, points).alias("_block"))
    rows = with_shard(with_shard(rows, "doc_id", shards, "shard"), "doc_id", shards + 1, "grown_shard")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    ranked = gapless_rank(materialize(rows, "shards"), ["shard"], "_block", order, "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


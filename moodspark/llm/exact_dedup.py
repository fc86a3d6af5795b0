"""Exact dedup by a heavy-hitter split (DataFrame functions only).

1. Each row is reduced to (doc_id, digest) once and stored: no text takes part in the grouping.
2. A Misra-Gries summary (``approx_top_k``: bounded counters per task, merged) names
   the digests that may be frequent; their exact size and winner are then counted
   from the stored digests (verification).
3. The verified winners, at most ``heavy`` rows, are broadcast: rows of frequent
   digests get their answer in the scan task and are never shuffled.
4. All other digests are shuffled in the ordinary way; none of them is frequent. Their
   winners are aggregated before the shuffle and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAVY = 1000
COUNTERS = 10_000


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as the empty text."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of the rows with one digest the one with the largest id stays. Rows whose
    id is null rank below all others; among rows with the same id (repeated
    rows) exactly one stays. Null texts equal the empty text. An empty table
    gives no rows. Further columns of ``docs`` are not read. ``heavy`` bounds
    the broadcast winners, ``counters`` the summary.
    """
    spark = docs.sparkSession
    rows = materialize(docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                                   text_digest(F.col(text_col)).alias("text_sha256"))
                       .withColumn("_row", F.monotonically_increasing_id()), "digests")
    frequent = rows.agg(F.expr(f"approx_top_k(text_sha256, {int(heavy)}, {int(counters)})").alias("t"))
    found = [x["item"] for x in frequent.first()["t"]]          # at most `heavy` digests
    best = F.max(F.struct(F.col("doc_id"), F.col("_row"))).alias("best")
    size = F.count(F.lit(1)).alias("group_size")
    candidates = spark.createDataFrame([(x,) for x in found], "text_sha256 string")
    winners = (rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(best, size))
    hot = rows.join(F.broadcast(winners), "text_sha256")
    others = rows.join(F.broadcast(candidates), "text_sha256", "left_anti")
    cold = others.join(others.groupBy("text_sha256").agg(best, size), "text_sha256")
    return hot.unionByName(cold).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("_row") == F.col("best._row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops, all columns kept, whatever their names.

    Rows with a null id have no key to be found by: of each text at most one of
    them stays, and only if no row with an id has that text. Whole rows that
    repeat with one id and text are reduced to one. Each row is shuffled once,
    by id and digest, to meet the list of those that stay.
    """
    key, none, sha = free_names(docs, "key", "none", "sha")
    names = [F.coalesce(F.col("doc_id"), F.lit(0)).alias(key), F.col("doc_id").isNull().alias(none), F.col("text_sha256").alias(sha)]
    kept = exact_groups(docs, id_col, text_col, heavy, counters).where("kept").select(*names)
    own = F.col(id_col).cast("bigint")
    mine = docs.withColumns({key: F.coalesce(own, F.lit(0)), none: own.isNull(), sha: text_digest(F.col(text_col))})
    # equal ids with equal texts are one document; any row of it will do
    return mine.join(kept, [key, none, sha], "left_semi").dropDuplicates([key, none, sha]).select(*map(_quoted, docs.columns))


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")

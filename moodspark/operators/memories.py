"""Happy memories and flashbacks (J12: B7, H23, D13, D14) for all users.

The client only saw its 100 newest entries; here every entry counts. Output is
flat (one row per entry or per flashback day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from . import insights as I


def _history(entries: DataFrame, analysis: DataFrame) -> DataFrame:
    a = analysis.select("entry_id", "predicted_emotion", "confidence")
    j = entries.select("entry_id", "user_id", "text", "entry_time").join(a, "entry_id", "left")
    return j.withColumn("bucket", X.bucket("predicted_emotion"))


def happy_memories(entries: DataFrame, analysis: DataFrame) -> DataFrame:
    """Positive entries with title/summary defaults; sort by date desc to show."""
    h = _history(entries, analysis).where(X.is_positive_entry("bucket", "predicted_emotion"))
    title = F.coalesce(I.insight_title(F.col("bucket")), F.lit(fixed.MEMORY_DEFAULT_TITLE))
    summary = F.when(F.coalesce(F.col("text"), F.lit("")) == "", fixed.MEMORY_DEFAULT_SUMMARY).otherwise(F.col("text"))
    return h.select("user_id", "entry_id", title.alias("title"), summary.alias("summary"),
                    F.col("entry_time").alias("date"), F.col("predicted_emotion").alias("emotion"),
                    "confidence")


def memory_counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy("user_id").agg(F.count(F.lit(1)).alias("memory_count"))


def flashback_entries(entries: DataFrame, analysis: DataFrame, as_of: str) -> DataFrame:
    """H23 on every positive entry; rows whose date has no label are dropped."""
    return (_history(entries, analysis)
            .where(X.is_positive_entry("bucket", "predicted_emotion"))
            .withColumn("flash_date", F.to_date("entry_time"))
            .withColumn("label", X.flashback_label(F.col("flash_date"), as_of))
            .where(F.col("label").isNotNull()))


def flashback_groups(entries: DataFrame, analysis: DataFrame, as_of: str) -> DataFrame:
    """Flashback entries grouped by (user, day) with label, newest time, count.

    The entry list of a group is ``flashback_entries`` filtered to that day
    (a join), never collected into one row: a day may hold any number of rows.
    """
    h = flashback_entries(entries, analysis, as_of)
    newest = F.struct("entry_time", "entry_id")
    return h.groupBy("user_id", "flash_date").agg(
        F.first("label").alias("label"),
        F.max(newest).getField("entry_time").alias("date"),
        F.count(F.lit(1)).alias("entry_count"))

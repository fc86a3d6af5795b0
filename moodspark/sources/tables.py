"""Given tables and the journal views shaped from them (FIXTURES.md section 2).

The journal model (entries, analysis, long-range entries) is derived from the
supplied parquet tables by joins only; every function returns a lazy
DataFrame so Catalyst prunes columns and pushes filters into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def labels_dim(spark: SparkSession) -> DataFrame:
    """j_labels(label_index, label, bucket): 28 rows, a fixed-size broadcast dim."""
    rows = [(i, lab, fixed.bucket_of(lab)) for i, lab in enumerate(fixed.LABELS)]
    schema = "label_index int, label string, bucket string"
    return spark.createDataFrame(rows, schema)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """j_entries(entry_id, user_id, doc_id, text, entry_time): one entry per event.

    The text comes from ``documents`` row ``event_id % n_docs``; ``n_docs`` is a
    scalar subquery, evaluated once, not a join.
    """
    return entries_from_events(read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "documents"))


def entries_from_events(ev: DataFrame, docs: DataFrame, text_col: str = "text", n_docs: int | None = None) -> DataFrame:
    """The j_entries rule on any events frame (batch or one micro-batch).

    ``docs`` may carry a per-document derivative of the text (e.g. its
    preview) under ``text_col`` so only that crosses the join. A caller that
    has counted the documents gives ``n_docs``.
    """
    n_docs = docs.select(F.count(F.lit(1))).scalar() if n_docs is None else F.lit(n_docs)
    e = ev.select(F.col("event_id").alias("entry_id"), "user_id",
                  F.col("ts").alias("entry_time"),
                  (F.col("event_id") % n_docs).alias("doc_key"))
    d = docs.select("doc_id", text_col)
    return (e.join(d, e.doc_key == d.doc_id, "inner")
            .select("entry_id", "user_id", "doc_id", text_col, "entry_time"))


def entries_with_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """j_entries with the H10 preview computed once per document instead of the text."""
    from ..functions.exprs import preview
    docs = read_table(spark, sf_dir, "documents")
    return entries_from_events(read_table(spark, sf_dir, "events"),
                               docs.select("doc_id", preview("text").alias("preview")), "preview")


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """j_analysis(entry_id, predicted_emotion, confidence).

    Spreads all labels; 1/37 of entries unanalysed, 1/31 with a NULL emotion.
    """
    return analysis_from_events(spark, read_table(spark, sf_dir, "events"))


def analysis_from_events(spark: SparkSession, ev: DataFrame) -> DataFrame:
    """The j_analysis rule on any events frame."""
    ev = ev.where(F.col("event_id") % 37 != 0)
    lab = F.broadcast(labels_dim(spark).select("label_index", "label"))
    cond = ((lab.label_index == (ev.event_id * 7 + ev.user_id) % 28) & (ev.event_id % 31 != 0))
    return ev.join(lab, cond, "left").select(
        F.col("event_id").alias("entry_id"),
        F.col("label").alias("predicted_emotion"),
        (F.col("value") / (F.col("value") + 100)).alias("confidence"))


def entries_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """j_entries_long(entry_id, user_id, entry_time, predicted_emotion): several years."""
    o = read_table(spark, sf_dir, "orders")
    lab = F.broadcast(labels_dim(spark).select("label_index", "label"))
    return o.join(lab, lab.label_index == o.o_orderkey % 28, "inner").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("entry_time"), F.col("label").alias("predicted_emotion"))


def entries_long_as_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The long-range entries split into the (entries, analysis) pair."""
    el = entries_long(spark, sf_dir)
    ent = el.select("entry_id", "user_id", F.lit(None).cast("string").alias("text"), "entry_time")
    ana = el.select("entry_id", "predicted_emotion", F.lit(None).cast("double").alias("confidence"))
    return ent, ana


# --------------------------------------------------------------- journal schemas (A1)

USERS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("username", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
])
ENTRIES = T.StructType([
    T.StructField("entry_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("entry_time", T.TimestampNTZType(), True),
])
ANALYSIS = T.StructType([
    T.StructField("entry_id", T.LongType(), False),
    T.StructField("model_name", T.StringType(), True),
    T.StructField("predicted_emotion", T.StringType(), True),
    T.StructField("confidence", T.DoubleType(), True),
    T.StructField("scores", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("task_type", T.StringType(), True),
])
DAILY_SUMMARY = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("summary_date", T.DateType(), False),
    T.StructField("dominant_emotion", T.StringType(), True),
    T.StructField("breakdown", T.MapType(T.StringType(), T.LongType()), True),
    T.StructField("positivity_score", T.DoubleType(), True),
    T.StructField("entry_count", T.LongType(), False),
    T.StructField("latest_entry_preview", T.StringType(), True),
    T.StructField("summary_text", T.StringType(), True),
])
ADVICE = T.StructType([
    T.StructField("entry_id", T.LongType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("advice_key", T.StringType(), False),
    T.StructField("emotion_key", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("advice_text", T.StringType(), False),
    T.StructField("rationale_text", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])
INSIGHT = T.StructType([
    T.StructField("entry_id", T.LongType(), False),
    T.StructField("emotion_bucket", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("explanation", T.StringType(), False),
    T.StructField("details", T.ArrayType(T.StringType()), True),
])

JOURNAL_SCHEMAS = {"users": USERS, "entries": ENTRIES, "analysis": ANALYSIS,
                   "daily_summary": DAILY_SUMMARY, "advice": ADVICE, "insight": INSIGHT}


def read_journal_table(spark: SparkSession, path: str | list[str], name: str, fmt: str = "parquet") -> DataFrame:
    """A1: read a journal table with its fixed schema (no inference)."""
    return spark.read.schema(JOURNAL_SCHEMAS[name]).format(fmt).load(path)

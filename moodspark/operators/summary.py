"""Daily summary (D5), month statistics (D6) and the dense calendar.

All users at once: (user_id, day) is the grouping key. One hash aggregate
with map-side partial aggregation; a hot (user, day) key is merged from one
partial row per map task, so skew does not pile raw rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed


def day_rows(entries: DataFrame, analysis: DataFrame | None) -> DataFrame:
    """Entries left join analysis; one row per (entry, analysis).

    Entries may carry ``preview`` (H10 already applied, e.g. once per shared
    document) instead of ``text``; the join then moves 160 characters, not
    whole texts. With ``analysis=None`` the entries already carry
    ``predicted_emotion`` (joined upstream, e.g. per document).
    """
    prev = F.col("preview") if "preview" in entries.columns else X.preview("text")
    joined = entries if analysis is None else entries.join(
        analysis.select("entry_id", "predicted_emotion"), "entry_id", "left")
    return (joined
            .select("user_id", "entry_id", "entry_time",
                    F.to_date("entry_time").alias("summary_date"),
                    X.bucket("predicted_emotion").alias("bucket"),
                    prev.alias("preview")))


def daily_summary(entries: DataFrame, analysis: DataFrame | None, with_text: bool = True) -> DataFrame:
    """One row per (user, day) with breakdown, dominant bucket and positivity.

    * an unanalysed entry or a NULL emotion counts as neutral; an unknown label
      has bucket NULL and still counts in entry_count (joined rows);
    * dominant ties go to the bucket whose newest row is newest
      (entry_time, then entry_id);
    * positivity = (pos + neu/2) / total rounded as Python rounds.
    """
    rows = day_rows(entries, analysis)
    newest = F.struct("entry_time", "entry_id")
    agg = [F.count(F.lit(1)).alias("entry_count")]
    for b in fixed.BUCKETS:
        agg.append(F.count_if(F.col("bucket") == b).alias(b))
        agg.append(F.max(F.when(F.col("bucket") == b, newest)).alias(f"_last_{b}"))
    agg.append(F.count_if(F.col("bucket").isNull()).alias("_unknown"))
    agg.append(F.max(F.when(F.col("bucket").isNull(), newest)).alias("_last_unknown"))
    if with_text:
        agg.append(F.max_by("preview", newest).alias("latest_entry_preview"))
    g = rows.groupBy("user_id", "summary_date").agg(*agg)

    cands = [F.struct(F.col(b).alias("n"), F.col(f"_last_{b}").alias("t"), F.lit(b).alias("b"))
             for b in fixed.BUCKETS]
    cands.append(F.struct(F.col("_unknown").alias("n"), F.col("_last_unknown").alias("t"),
                          F.lit(None).cast("string").alias("b")))
    dominant = F.greatest(*cands).getField("b")
    score = X.py_round_ratio2(F.col("positive") * 2 + F.col("neutral"), F.col("entry_count") * 2)
    out = g.select(
        *[g[f"_last_{b}"] for b in fixed.BUCKETS],
        "user_id", "summary_date",
        dominant.alias("dominant_emotion"),
        "positive", "negative", "neutral",
        score.alias("positivity_score"),
        "entry_count",
        *(["latest_entry_preview"] if with_text else []))
    if with_text:
        from ..sources.io import json_counts
        out = out.withColumn("emotion_breakdown_json", json_counts(
            fixed.BUCKETS, [g[b] for b in fixed.BUCKETS], [g[f"_last_{b}"] for b in fixed.BUCKETS],
            descending=True))
        out = out.withColumn("summary_text", X.summary_text(
            "dominant_emotion", "positivity_score", "positive", "negative", "neutral",
            "latest_entry_preview"))
    return out.drop(*[f"_last_{b}" for b in fixed.BUCKETS])


def month_stats(summary: DataFrame) -> DataFrame:
    """Number of positive / neutral / negative days per (user, month)."""
    return (summary.groupBy("user_id", F.trunc("summary_date", "month").alias("month"))
            .agg(F.count_if(F.col("dominant_emotion") == "positive").alias("positive_days"),
                 F.count_if(F.col("dominant_emotion") == "neutral").alias("neutral_days"),
                 F.count_if(F.col("dominant_emotion") == "negative").alias("negative_days")))


def calendar_month(entries: DataFrame, analysis: DataFrame, year: int, month: int) -> DataFrame:
    """One month for every user who has an entry at any time.

    The range on ``entry_time`` comes before the join and the aggregation, so
    only that month is read and summarised; all users are a distinct of one column.
    """
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    t = F.col("entry_time")
    now = entries.where((t >= first.cast("timestamp_ntz"))
                        & (t < F.date_add(F.last_day(first), 1).cast("timestamp_ntz")))
    return _lay_out(daily_summary(now, analysis, with_text=False).groupBy("user_id").agg(
        F.collect_list(_day_cell()).alias("_cells")).join(entries.select("user_id").distinct(), "user_id", "right")
        .select("user_id", F.coalesce("_cells", F.array()).alias("_cells"), first.alias("month")))


def _day_cell() -> Column:
    return F.struct(F.dayofmonth("summary_date").alias("d"), "dominant_emotion", "positivity_score",
                    "entry_count", X.positivity_color("positivity_score").alias("color"),
                    X.short_summary("dominant_emotion", "positive", "negative", "neutral").alias("summary_text"))


def calendar_days(summary: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """C6 + J8: dense month of days per user, default row for days without entries.

    With ``year``/``month`` every user that has any summary gets that month;
    without them, each (user, month) that has at least one summary is
    densified. One aggregation per (user[, month]) gathers the month's day
    cells (at most 31, so the group is bounded by the calendar) and a
    generator lays out every calendar day: no densifying join, and the
    summary is read once.
    """
    cell = _day_cell()
    if year is not None and month is not None:
        first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
        in_month = F.col("summary_date").between(first, F.last_day(first))
        g = summary.groupBy("user_id").agg(F.collect_list(F.when(in_month, cell)).alias("_cells")) \
            .withColumn("month", first)
    else:
        g = summary.groupBy("user_id", F.trunc("summary_date", "month").alias("month")).agg(
            F.collect_list(cell).alias("_cells"))
    return _lay_out(g)


def _lay_out(g: DataFrame) -> DataFrame:
    """Every day of each row's ``month``, with its cell of ``_cells`` or the default."""
    days = g.select("user_id", "_cells", F.explode(F.sequence(F.col("month"), F.last_day("month"))).alias("date"))
    c = F.try_element_at(F.filter("_cells", lambda x: x["d"] == F.dayofmonth("date")), F.lit(1))
    has = c.isNotNull()
    pos = X.calendar_cell("date")
    return days.select(
        "user_id", "date", F.dayofmonth("date").alias("day"),
        F.when(has, c["entry_count"]).otherwise(F.lit(0).cast("long")).alias("entry_count"),
        F.when(has, c["color"]).otherwise(F.lit(fixed.COLOR_NO_ENTRY)).alias("color"),
        F.when(has, c["dominant_emotion"]).otherwise(F.lit(fixed.NO_ENTRY_BUCKET)).alias("dominant_emotion"),
        c["positivity_score"].alias("positivity_score"),
        F.when(has, c["summary_text"]).otherwise(F.lit(fixed.NO_ENTRY_TEXT)).alias("summary_text"),
        pos.grid_row.alias("grid_row"), pos.grid_col.alias("grid_col"))

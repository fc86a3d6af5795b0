"""User statistics (J9) and trend views (J11) for all users at once.

Each function takes the journal frames and returns a lazy DataFrame keyed by
``user_id``. Grouping keys are (user, small calendar key), so aggregates are
partial+final hash aggregates; windows only run over per-user *day* series,
whose length is bounded by the calendar, never by the row volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed


def users_of(entries: DataFrame) -> DataFrame:
    return entries.select("user_id").distinct()


def emotion_distribution(entries: DataFrame, analysis: DataFrame) -> DataFrame:
    """Analysed entries (inner join) counted by bucket; unknown labels dropped."""
    return bucket_counts(analysis.select("entry_id", "predicted_emotion").join(
        entries.select("entry_id", "user_id"), "entry_id", "inner"))


def bucket_counts(j: DataFrame) -> DataFrame:
    """D1 over rows that carry ``user_id`` and ``predicted_emotion``."""
    b = X.bucket("predicted_emotion")
    return j.groupBy("user_id").agg(*[F.count_if(b == k).alias(k) for k in fixed.BUCKETS])


def monthly_counts(entries: DataFrame) -> DataFrame:
    """Entries per (user, 'yyyy-MM'); months without entries are absent
    (an entry without a time counts under a NULL month, as the SQL grouping does)."""
    return (entries
            .groupBy("user_id", F.date_format("entry_time", "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("count")))


def _grid() -> list:
    return [F.struct(F.lit(d).alias("day"), F.lit(t).alias("time"))
            for d in fixed.WEEKDAYS for t in fixed.TIME_SLOTS]


def time_heatmap(entries: DataFrame, analysis: DataFrame) -> DataFrame:
    """D4 + C7: dense 7 x 3 weekday/time-slot grid per user.

    Rows without a time or an emotion are skipped (B5); an unknown label
    scores 0.5. Score = mean rounded as Python rounds; NULL for empty cells.
    One aggregation per user holds all 21 cells (partial aggregation map
    side), then a generator lays the cells out as rows: no densifying join.
    A user whose entries are all unanalysed still gets 21 empty cells.
    """
    return heatmap_cells(entries.select("entry_id", "user_id", "entry_time")
                         .join(analysis.select("entry_id", "predicted_emotion"), "entry_id", "left"))


def heatmap_cells(j: DataFrame) -> DataFrame:
    """D4 over rows that carry ``user_id, entry_time, predicted_emotion``."""
    ok = (F.col("entry_time").isNotNull() & F.col("predicted_emotion").isNotNull()
          & (F.col("predicted_emotion") != ""))
    b = X.bucket("predicted_emotion")
    day, slot = X.weekday_name("entry_time"), X.time_slot("entry_time")
    aggs = []
    for d in fixed.WEEKDAYS:
        for t in fixed.TIME_SLOTS:
            hit = ok & (day == d) & (slot == t)
            aggs += [F.count_if(hit).alias(f"n_{d}_{t}"), F.count_if(hit & (b == "positive")).alias(f"p_{d}_{t}"),
                     F.count_if(hit & (b == "negative")).alias(f"q_{d}_{t}")]
    g = j.groupBy("user_id").agg(*aggs)
    cells = F.array(*[F.struct(F.lit(d).alias("day"), F.lit(t).alias("time"), F.col(f"n_{d}_{t}").alias("n"),
                               F.col(f"p_{d}_{t}").alias("p"), F.col(f"q_{d}_{t}").alias("q"))
                      for d in fixed.WEEKDAYS for t in fixed.TIME_SLOTS])
    c = g.select("user_id", F.inline(cells))
    score = X.py_round_ratio2(F.col("p") * 2 + (F.col("n") - F.col("p") - F.col("q")), F.col("n") * 2)
    return c.select("user_id", "day", "time", score.alias("score"), F.col("n").alias("count")).withColumn(
        "color", X.heatmap_color("score", "count"))


def fluctuation(entries: DataFrame, analysis: DataFrame) -> DataFrame:
    """+1 / 0 / -1 per analysed entry (unknown label 0); sort by entry_time to plot."""
    j = (entries.select("entry_id", "user_id", "entry_time")
         .join(analysis.select("entry_id", "predicted_emotion"), "entry_id", "left")
         .where(F.col("predicted_emotion").isNotNull() & (F.col("predicted_emotion") != "")))
    return j.select("user_id", "entry_id", F.col("entry_time").alias("timestamp"),
                    X.bucket_sign(X.bucket("predicted_emotion")).alias("score"))


def daily_positivity(summary: DataFrame) -> DataFrame:
    """(user, date, score) series from the daily summary."""
    return summary.select("user_id", F.col("summary_date").alias("date"),
                          F.col("positivity_score").alias("score"))


def moving_average(series: DataFrame, window: int, as_of: str | None = None,
                   range_name: str = "all") -> DataFrame:
    """E1 after B6: trailing mean over the last ``window`` rows (days with entries).

    Half-up to 2 digits on exact hundredths (toFixed); window <= 1 passes the
    score through unrounded. The range filter runs first, as in the client.
    """
    s = series
    if range_name != "all":
        s = s.where(X.day_range(F.col("date").cast("timestamp_ntz"), as_of, range_name))
    if window <= 1:
        return s.select("user_id", "date", "score", F.date_format("date", "MMM d").alias("label"))
    w = Window.partitionBy("user_id").orderBy("date").rowsBetween(-(window - 1), 0)
    hund = F.round(F.col("score") * 100).cast("long")
    avg = X.half_up_hundredths(F.sum(hund).over(w), F.count(F.lit(1)).over(w))
    return s.select("user_id", "date", avg.alias("score"), F.date_format("date", "MMM d").alias("label"))


def _pattern_means(fluct: DataFrame, in_range, key, names: list[str], name_col: str) -> DataFrame:
    """Mean score per (user, name) over the in-range rows; 0 when empty.

    Every user with any fluctuation row gets every name: one aggregation per
    user with a conditional sum/count per name, then a generator.
    """
    aggs = []
    for i, n in enumerate(names):
        hit = in_range & (key == n)
        aggs += [F.sum(F.when(hit, F.col("score"))).alias(f"s{i}"), F.count_if(hit).alias(f"n{i}")]
    g = fluct.groupBy("user_id").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias(name_col), F.col(f"s{i}").alias("_s"), F.col(f"n{i}").alias("_n"))
                     for i, n in enumerate(names)])
    return g.select("user_id", F.inline(rows)).select(
        "user_id", name_col,
        F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.lit(0.0)).alias("score"),
        F.col("_n").alias("count"))


def _range(as_of, range_name):
    return X.day_range("timestamp", as_of, range_name) if range_name != "all" else F.lit(True)


def day_night(fluct: DataFrame, as_of: str | None = None, range_name: str = "all") -> DataFrame:
    """Day [6,18) vs Night mean of +1/0/-1 per user; 0 when empty."""
    return _pattern_means(fluct, _range(as_of, range_name), X.day_night("timestamp"), fixed.DAY_NIGHT, "name")


def seasons(fluct: DataFrame, as_of: str | None = None, range_name: str = "all") -> DataFrame:
    """Season means per user; 0 when empty."""
    return _pattern_means(fluct, _range(as_of, range_name), X.season("timestamp"), fixed.SEASONS, "name")

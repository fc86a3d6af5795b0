"""Composite journal jobs (J7 enrichment, J9 statistics bundle, J11 trend view) and the stored journal.

The frames are lazy; nothing is collected but the days that a change to the
store touches, which the calendar bounds.
"""

from __future__ import annotations

import datetime as dt
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import exprs as X
from ..operators import entities as EN
from ..operators import history as H
from ..operators import keyword as K
from ..operators import maintenance as MN
from ..operators import scoring as SC
from ..operators import stats as ST
from ..operators import summary as S
from ..session import materialize, shuffles_dropped
from ..sources import io as IO


@dataclass
class Enriched:
    analysis: DataFrame
    insight: DataFrame
    advice: DataFrame
    summary: DataFrame
    rejected: DataFrame         # analysis rows whose label is not one of the 28


SCORE_FIELDS = ["model_name", "predicted_emotion", "confidence", "scores", "task_type"]


def score_texts(texts: DataFrame, text_key: str = "doc_id", primary: DataFrame | None = None) -> DataFrame:
    """``text_key`` and ``SCORE_FIELDS`` of each text: the primary scorer's answer, else the keyword scorer's."""
    if primary is not None:
        return SC.with_fallback(primary, texts, text_key).select(text_key, *SCORE_FIELDS)
    return K.keyword_score(texts, text_key).withColumn(
        "scores", K.one_hot_scores(F.col("predicted_emotion"))).select(text_key, *SCORE_FIELDS)


def advise_texts(spark: SparkSession, texts: DataFrame, gazetteer: DataFrame, text_key: str = "doc_id") -> DataFrame:
    """Entity advice of each text."""
    votes = EN.entity_votes(EN.entity_mentions(texts, text_key, gazetteer, context=False), text_key)
    return EN.entity_advice(votes, text_key, spark)


def split_known(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analysis rows, and those whose label is outside the vocabulary."""
    unknown = F.col("predicted_emotion").isNotNull() & X.bucket("predicted_emotion").isNull()
    return found.where(~unknown), found.where(unknown)


def enrich(spark: SparkSession, entries: DataFrame, texts: DataFrame, gazetteer: DataFrame,
           text_key: str = "doc_id", primary: DataFrame | None = None,
           incognito_col: str | None = None) -> Enriched:
    """J7 in batch: score (primary scorer with keyword fallback, J4), insight (H12),
    general + entity advice (H13, J5, J6, G1) and the daily summary (D5).

    ``entries`` (entry_id, user_id, entry_time, ``text_key``[, incognito]) reference
    ``texts`` (``text_key``, text); each distinct text is analysed once.
    ``gazetteer`` (word, label) lists the names to look for. Rows with a label
    outside the vocabulary go to ``rejected``; their entries count as unanalysed.
    """
    scored = score_texts(texts, text_key, primary)
    analysis, rejected = split_known(entries.select("entry_id", text_key).join(scored, text_key, "inner").drop(text_key))
    advice = H.with_defaults(H.advice_rows(entries, analysis, advise_texts(spark, texts, gazetteer, text_key),
                                           text_key, incognito_col))
    ent_text = entries.join(texts.select(text_key, X.preview("text").alias("preview")), text_key, "inner")
    return Enriched(analysis, H.insight_rows(analysis), advice, S.daily_summary(ent_text, analysis), rejected)


def stats_base(entries: DataFrame, analysis: DataFrame) -> DataFrame:
    """One row per entry with the emotions of its analyses (an empty array if it has none), written once.

    The five frames of the statistics bundle read this table; the entries are scanned and joined once.
    """
    found = analysis.groupBy("entry_id").agg(F.collect_list(F.struct("predicted_emotion")).alias("found"))
    there = [c for c in ("entry_id", "user_id", "entry_time", "preview", "text") if c in entries.columns]
    joined = entries.select(*there).join(found, "entry_id", "left")
    if "preview" not in there:
        joined = joined.withColumn("preview", X.preview("text") if "text" in there else F.lit(None).cast("string")).drop("text")
    empty = F.array().cast("array<struct<predicted_emotion:string>>")
    return materialize(joined.withColumn("found", F.coalesce("found", empty)), "stats_base")


def user_stats(entries: DataFrame, analysis: DataFrame, advice: DataFrame) -> dict:
    """The five frames of the statistics view, for all users, from one stored base join.

    ``advice`` rows have an ``entry_id``, or the ``user_id`` already.
    """
    base = stats_base(entries, analysis)
    rows = base.select("entry_id", "user_id", "entry_time", "preview", F.explode_outer("found").alias("_a")).select(
        "entry_id", "user_id", "entry_time", "preview", "_a.predicted_emotion")
    analysed = base.select("user_id", F.explode("found").alias("_a")).select("user_id", "_a.predicted_emotion")
    return {
        "emotion_distribution": ST.bucket_counts(analysed),
        "writing_occurrences": ST.monthly_counts(base),
        "entity_impact": H.entity_impact(advice, base),
        "time_heatmap": ST.heatmap_cells(rows),
        "daily_positivity": ST.daily_positivity(S.daily_summary(rows, None, with_text=False)),
    }


def trend_view(summary: DataFrame, entries: DataFrame, analysis: DataFrame, as_of: str,
               range_name: str = "all", window: int = 7, pattern: str = "none") -> dict:
    """Range filter then smoothing of the positivity series, plus the
    fluctuation series or one of its day/night and season patterns."""
    fl = ST.fluctuation(entries, analysis)
    out = {"trend": ST.moving_average(ST.daily_positivity(summary), window, as_of, range_name)}
    if pattern == "dayNight":
        out["chart"] = ST.day_night(fl, as_of, range_name)
    elif pattern == "season":
        out["chart"] = ST.seasons(fl, as_of, range_name)
    else:
        rows = fl.where(X.day_range("timestamp", as_of, range_name)) if range_name != "all" else fl
        out["chart"] = rows.select("user_id", "timestamp", "score",
                                   F.date_format("timestamp", "MMM d, hh:mm a").alias("time"))
    return out


def _by_merge(rows: DataFrame) -> DataFrame:
    """``rows`` of a change are joined by sorting: their keys grow with the change, but their compressed files look
    small enough to be gathered on the driver, once per table."""
    return rows.hint("merge")


class JournalStore:
    """The journal as tables partitioned by day: ``base/<table>/entry_date=<day>`` (``summary_date`` for the summary).

    A change (entries added or enriched again, entries or users removed) rewrites
    the days it touches in every table and no others, by Spark's dynamic
    partition overwrite. Before anything is replaced, the new content of these
    days is written whole to ``_staged/<change>``; a change that fails later, also
    in the middle of a replacement, is finished from there when it is applied
    again under its name, and one that was finished is skipped. What was staged goes
    once it stands in its table.

    Dynamic overwrite can't remove a partition. Each touched day therefore keeps
    a row of nulls (no entry id, or no user in the summary), which ``read`` drops.
    Texts are analysed once per key; their scores and entity advice are kept
    under ``texts/`` by change, so a later change that ``reuse``s them analyses
    new texts only.

    The table ``advice`` holds the general advice of each entry and names the text
    and the changes (``text_key``, ``text_changes``) whose entity advice is the entry's,
    none for an incognito one. That advice is stored once a text, not once an entry;
    ``read`` puts it beside the general rows.
    """

    TABLES = ("entries", "analysis", "insight", "advice", "rejected")
    KEY = {"summary": "user_id"}
    TEXT_ADVICE = [types.StructField("ord", types.IntegerType())] + [types.StructField(c, types.StringType()) for c in (
        "advice_key", "emotion_key", "title", "advice_text", "rationale_text")]

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # ------------------------------------------------------------ reading

    def _path(self, *parts: str) -> str:
        return "/".join([self.base, *parts])

    def _stored(self, name: str) -> DataFrame | None:
        path = self._path(name)
        return self.spark.read.parquet(path) if IO.path_exists(self.spark, path) else None

    def days(self, name: str) -> DataFrame:
        """The rows of a table with their day."""
        stored = self._stored(name)
        if stored is None:
            raise ValueError(f"no change has been applied to {self.base}")
        return stored.where(F.col(self.KEY.get(name, "entry_id")).isNotNull())

    def read(self, name: str) -> DataFrame:
        rows = self.days(name)
        if name == "summary":
            return rows
        return (self._whole_advice(rows) if name == "advice" else rows).drop("entry_date")

    def _by_change(self, fields: list[types.StructField], *parts: str) -> DataFrame | None:
        """What the changes stored under ``texts/``; the name of a ``change`` is a string, also if it looks like a number."""
        if not IO.path_exists(self.spark, self._path("texts", *parts)):
            return None
        schema = types.StructType([*fields, types.StructField("change", types.StringType())])
        return self.spark.read.schema(schema).parquet(self._path("texts", *parts))

    def _whole_advice(self, stored: DataFrame) -> DataFrame:
        """General advice of each entry, and the advice stored for its text."""
        general = stored.drop("text_key", "text_changes")
        texts = self._by_change([stored.schema["text_key"], *self.TEXT_ADVICE], "advice")
        if texts is None:
            return general
        named = stored.select("entry_id", "created_at", "entry_date", "text_key", F.explode("text_changes").alias("change"))
        ent = named.join(_by_merge(texts), ["text_key", "change"])
        return general.unionByName(H.with_defaults(ent, "entry_date"))

    def done(self, change: str) -> bool:
        return IO.path_exists(self.spark, self._path("_done", change))

    # ------------------------------------------------------------ texts

    def _texts(self, change: str, entries: DataFrame, texts: DataFrame, gazetteer: DataFrame | None, text_key: str,
               primary: DataFrame | None, reuse: bool, analysed: bool) -> tuple[DataFrame | None, DataFrame | None]:
        """Scores of all texts known so far, and for each the changes that hold its entity advice; new texts are analysed."""
        wanted = texts.join(entries.select(text_key).distinct(), text_key, "left_semi")
        key = wanted.schema[text_key]
        out = []
        for name, make in (("scores", None if analysed else lambda t: score_texts(t, text_key, primary)),
                           ("advice", gazetteer and (lambda t: advise_texts(self.spark, t, gazetteer, text_key).withColumnRenamed(
                               text_key, "text_key")))):
            if not make:
                out.append(None)
                continue
            mine, keys = self._path("texts", name, f"change={change}"), self._path("texts", f"{name}_keys", f"change={change}")
            new, known = wanted, self._by_change([key], f"{name}_keys") if reuse else None
            if known is not None:
                new = wanted.join(known.where(F.col("change") != change).select(text_key), text_key, "left_anti")
            made = make(new)
            made.write.mode("overwrite").option("compression", "zstd").parquet(mine)
            new.select(text_key).write.mode("overwrite").parquet(keys)
            read = self._by_change(made.schema.fields, name) if name == "scores" else self._by_change([key], f"{name}_keys")
            out.append(read if reuse else read.where(F.col("change") == change))
        scores, held = out
        return (scores and scores.drop("change"), held and held.groupBy(text_key).agg(
            F.sort_array(F.collect_set("change")).alias("text_changes")))

    # ------------------------------------------------------------ changes

    def _stage(self, change: str, added: dict[str, DataFrame], gone: DataFrame, touched: DataFrame, days: list[dt.date]) -> None:
        """The touched days of every table after the change."""
        marks = self.spark.createDataFrame([(d,) for d in days], "entry_date date")

        def put(df: DataFrame, name: str, day: str) -> DataFrame:
            path = self._path("_staged", change, name)
            df.hint("rebalance", day).write.mode("overwrite").option("compression", "zstd").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        def table(name: str) -> DataFrame:
            rows, old = added.get(name), self._stored(name)
            if old is not None:
                kept = old.where(F.col("entry_date").isin(days) & F.col("entry_id").isNotNull()).join(gone, "entry_id", "left_anti")
                rows = kept if rows is None else kept.unionByName(rows, allowMissingColumns=True)
            return put(rows.unionByName(marks, allowMissingColumns=True), name, "entry_date")

        present = [n for n in self.TABLES if n in added or self._stored(n) is not None]
        with ThreadPoolExecutor(3) as pool:
            staged = dict(zip(present, pool.map(table, present)))
        rows = {n: staged[n].where("entry_id is not null").drop("entry_date") for n in ("entries", "analysis")}
        old = self._stored("summary")
        # stored between two jobs: the shuffles of the first are gone when those of the second are written
        found = materialize(MN.touched_rows(rows["entries"].select("entry_id", "user_id", "entry_time", "preview"),
                                            rows["analysis"], touched), "change_rows")
        summary = MN.refresh_summary(
            None if old is None else old.where(F.col("summary_date").isin(days) & F.col("user_id").isNotNull()),
            found, None, touched)
        put(summary.unionByName(marks.withColumnRenamed("entry_date", "summary_date"), allowMissingColumns=True),
            "summary", "summary_date")
        self.spark.createDataFrame([(len(days),)], "days int").write.mode("overwrite").parquet(
            self._path("_staged", change, "_complete"))

    def _replace(self, change: str) -> None:
        """Put the staged days in place; may be repeated."""
        def table(name: str) -> None:
            path = self._path("_staged", change, name)
            if IO.path_exists(self.spark, path):
                day = "summary_date" if name == "summary" else "entry_date"
                # the staged files are laid out by day already
                (self.spark.read.parquet(path).write.mode("overwrite").option("compression", "zstd")
                 .option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(self._path(name)))
                IO.drop_path(self.spark, path)

        with ThreadPoolExecutor(3) as pool:
            list(pool.map(table, (*self.TABLES, "summary")))
        self.spark.createDataFrame([(change,)], "change string").write.mode("overwrite").parquet(self._path("_done", change))

    def apply(self, entries: DataFrame | None = None, texts: DataFrame | None = None, gazetteer: DataFrame | None = None,
              text_key: str = "doc_id", primary: DataFrame | None = None, incognito_col: str | None = None,
              analysis: DataFrame | None = None, users_gone: DataFrame | None = None, entries_gone: DataFrame | None = None,
              leaving: DataFrame | None = None, change: str | None = None, reuse: bool = False) -> str:
        """One change; returns its name.

        ``entries`` (entry_id, user_id, entry_time, ``text_key``) are enriched (J7) and
        take the place of stored ones with their ids, on whatever day those
        stood (A6); the summary is recomputed for the touched (user, day) keys
        (A7). Without a ``gazetteer`` they get general advice only; ``analysis``
        (entry_id, predicted_emotion, ..) replaces scoring. Rows whose label is
        not known go to the table ``rejected``.

        ``entries_gone`` (entry_id, user_id: both must match a stored or added
        entry) and ``users_gone`` (user_id) are removed with all that hangs on
        them: analysis, insight, advice, rejected rows and summary days (C8). A
        caller that knows where the entries that go or are replaced stood, as the
        stream does from its state, gives ``leaving`` (entry_id, user_id,
        entry_date); then no stored table is searched for them.
        """
        change = change or uuid.uuid4().hex[:12]
        given = (entries, texts, analysis, users_gone, entries_gone, leaving)
        if not self.done(change):
            with shuffles_dropped(self.spark, *(d.sparkSession for d in given if d is not None)):
                self._apply(change, entries, texts, gazetteer, text_key, primary, incognito_col, analysis, users_gone,
                            entries_gone, leaving, reuse)
        return change

    def _apply(self, change: str, entries: DataFrame | None, texts: DataFrame | None, gazetteer: DataFrame | None, text_key: str,
               primary: DataFrame | None, incognito_col: str | None, analysis: DataFrame | None, users_gone: DataFrame | None,
               entries_gone: DataFrame | None, leaving: DataFrame | None, reuse: bool) -> None:
        if not IO.path_exists(self.spark, self._path("_staged", change, "_complete")):
            new = None
            day = F.to_date("entry_time").alias("entry_date")
            if entries is not None:
                previews = texts.select(text_key, X.preview("text").alias("preview"))
                new = _by_merge(materialize(entries.join(previews, text_key).select("*", day), "change_entries"))
            coming = new
            if leaving is None:
                leaving, coming = self._leaving(new, users_gone, entries_gone)
            keys = [d.select("user_id", F.col("entry_date").alias("summary_date")) for d in (leaving, coming) if d is not None]
            touched = _by_merge(materialize((keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])).distinct(),
                                            "change_days"))
            gone = leaving if leaving is not None else new
            gone = _by_merge(materialize(gone.select("entry_id").distinct(), "change_gone"))
            days = [r[0] for r in touched.select("summary_date").distinct().orderBy("summary_date").collect()]
            added = {} if coming is None else self._enriched(change, coming, texts, gazetteer, text_key, primary,
                                                             incognito_col, analysis, reuse)
            self._stage(change, added, gone, touched, days)
        self._replace(change)

    def _leaving(self, new: DataFrame | None, users_gone: DataFrame | None,
                 entries_gone: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
        """What leaves (stored versions of the new entries, removed entries, those of removed users), and what is new after that."""
        ids = ["entry_id", "user_id", "entry_date"]
        stored = self._stored("entries")
        there = [d.select(*ids) for d in (new, None if stored is None else stored.where("entry_id is not null")) if d is not None]
        if not there:
            raise ValueError("nothing is stored and nothing is added")
        removed = MN.entries_to_remove(there[0] if len(there) == 1 else there[0].unionByName(there[1]), users_gone, entries_gone)
        leaving = [] if removed is None else [removed]
        if len(there) == 2:
            leaving.append(there[1].join(new.select("entry_id"), "entry_id", "left_semi"))
        coming = new if new is None or removed is None else new.join(removed.select("entry_id"), "entry_id", "left_anti")
        return (leaving[0].unionByName(leaving[1]) if len(leaving) == 2 else leaving[0] if leaving else None), coming

    def _enriched(self, change: str, entries: DataFrame, texts: DataFrame, gazetteer: DataFrame | None, text_key: str,
                  primary: DataFrame | None, incognito_col: str | None, analysis: DataFrame | None,
                  reuse: bool) -> dict[str, DataFrame]:
        scores, held = self._texts(change, entries, texts, gazetteer, text_key, primary, reuse, analysis is not None)
        found = (entries.select("entry_id", text_key).join(scores, text_key).drop(text_key) if analysis is None
                 else analysis.join(entries.select("entry_id"), "entry_id", "left_semi"))
        known, rejected = split_known(found)
        own = H.analysed_entries(entries, known, text_key, *([incognito_col] if incognito_col else [])).withColumnRenamed(
            text_key, "text_key")
        if held is None:
            own = own.withColumn("text_changes", F.lit(None).cast("array<string>"))
        else:
            own = own.join(_by_merge(held.withColumnRenamed(text_key, "text_key")), "text_key", "left")
        if incognito_col:
            own = own.withColumn("text_changes", F.when(~F.coalesce(incognito_col, F.lit(False)), F.col("text_changes")))
        general = H.with_defaults(H.general_rows(own, "text_key", "text_changes"), "text_key", "text_changes")
        out = {"analysis": known, "insight": H.insight_rows(known), "rejected": rejected, "advice": general}
        dates = entries.select("entry_id", "entry_date")
        return {"entries": entries} | {n: d.join(dates, "entry_id") for n, d in out.items()}

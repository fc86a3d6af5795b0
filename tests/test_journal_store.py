"""The journal store: overlapping changes, emptied advice, rejected labels, incognito entries, failed changes, removal."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from moodspark.operators import maintenance as MN
from moodspark.plans import journal as JN

ENTRIES = "entry_id long, user_id long, entry_time timestamp_ntz, doc_id long, quiet boolean"


def _inputs(spark):
    texts = spark.createDataFrame([(1, "I love Anna."), (2, "It rained."), (3, "Anna was rude and I was angry.")],
                                  "doc_id long, text string")
    names = spark.createDataFrame([("Anna", "PER")], "word string, label string")
    day = lambda d: dt.datetime(2024, 1, d, 9, 0)
    rows = [(10, 1, day(1), 1, False), (11, 1, day(2), 2, False), (12, 2, day(2), 3, True), (13, 1, day(2), 3, False)]
    return texts, names, spark.createDataFrame(rows, ENTRIES)


def _days(store):
    return {(r.user_id, r.summary_date.day): r.entry_count for r in store.read("summary").collect()}


def _files(base):
    return {f"{d}/{n}" for d, _, names in os.walk(base) for n in names if n.endswith(".parquet") and "/_" not in d}


def test_changes_merge_by_key(spark, tmp_path):
    texts, names, entries = _inputs(spark)
    store = JN.JournalStore(spark, f"{tmp_path}/journal")
    store.apply(entries.where("entry_id < 12"), texts, names, incognito_col="quiet")
    store.apply(entries.where("entry_id > 10"), texts, names, incognito_col="quiet")
    analysis = {r.entry_id: r for r in store.read("analysis").collect()}
    assert sorted(analysis) == [10, 11, 12, 13]
    assert analysis[10].predicted_emotion == "love" and analysis[10].scores["love"] == 1.0
    advice = [(r.entry_id, r.ord) for r in store.read("advice").orderBy("entry_id", "ord").collect()]
    assert advice == [(10, 0), (10, 1), (11, 0), (12, 0), (13, 0), (13, 1)]      # 12 is incognito: general advice only
    assert _days(store) == {(1, 1): 1, (1, 2): 2, (2, 2): 1}
    # entry 10 again, with a text that names nobody and on another day: its advice and its old day go
    moved = entries.where("entry_id = 10").withColumn("doc_id", F.lit(2).cast("long")).withColumn(
        "entry_time", F.lit(dt.datetime(2024, 1, 5)).cast("timestamp_ntz"))
    store.apply(moved, texts, names, incognito_col="quiet")
    assert store.read("advice").where("entry_id = 10").count() == 1
    assert sorted((r.user_id, r.summary_date.day) for r in store.read("summary").collect()) == [(1, 2), (1, 5), (2, 2)]


def test_a_change_writes_the_days_it_touches_and_no_others(spark, tmp_path):
    texts, names, entries = _inputs(spark)
    store = JN.JournalStore(spark, f"{tmp_path}/journal")
    store.apply(entries, texts, names)
    before = _files(f"{tmp_path}/journal")
    store.apply(entries.where("entry_id = 10"), texts, names, reuse=True)
    after = _files(f"{tmp_path}/journal")
    gone = {f.split("_date=")[1][:10] for f in before - after if "_date=" in f}
    assert gone == {"2024-01-01"} and {f.split("_date=")[1][:10] for f in after - before if "_date=" in f} == gone


def test_a_change_that_failed_half_way_is_finished(spark, tmp_path, monkeypatch):
    texts, names, entries = _inputs(spark)
    store = JN.JournalStore(spark, f"{tmp_path}/journal")
    store.apply(entries.where("entry_id < 13"), texts, names)
    want_old = _days(store)
    replace = JN.JournalStore._replace
    # it fails before anything is put in place, then after one table was put in place and another was lost
    monkeypatch.setattr(JN.JournalStore, "_replace", lambda self, change: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.apply(entries.where("entry_id = 13"), texts, names, change="c2")
    assert _days(store) == want_old
    shutil.rmtree(f"{tmp_path}/journal/advice/entry_date=2024-01-02")
    monkeypatch.setattr(JN.JournalStore, "_replace", replace)
    store.apply(entries.where("entry_id = 13"), texts, names, change="c2")
    assert _days(store) == {(1, 1): 1, (1, 2): 2, (2, 2): 1}
    assert sorted({r.entry_id for r in store.read("advice").collect()}) == [10, 11, 12, 13]
    files = _files(f"{tmp_path}/journal")
    store.apply(entries.where("entry_id = 13"), texts, names, change="c2")      # done: nothing is written
    assert _files(f"{tmp_path}/journal") == files


def test_removal_cascades_from_users_and_entries(spark, tmp_path):
    texts, names, entries = _inputs(spark)
    store = JN.JournalStore(spark, f"{tmp_path}/journal")
    primary = spark.createDataFrame([(1, "bliss", 0.9, "p")], "doc_id long, predicted_emotion string, confidence double, model_name string")
    store.apply(entries, texts, names, primary=primary)
    assert [r.entry_id for r in store.read("rejected").collect()] == [10]
    pairs = spark.createDataFrame([(11, 1), (13, 2)], "entry_id long, user_id long")        # 13 is not user 2's
    store.apply(users_gone=spark.createDataFrame([(2,)], "user_id long"), entries_gone=pairs)
    for name in ("entries", "analysis", "insight", "advice"):
        assert {r.entry_id for r in store.read(name).collect()} == ({10, 13} if name == "entries" else {13})
    assert _days(store) == {(1, 1): 1, (1, 2): 1}
    store.apply(users_gone=spark.createDataFrame([(1,)], "user_id long"))
    assert all(store.read(n).count() == 0 for n in (*store.TABLES, "summary"))


def test_advice_of_a_text_is_stored_once_and_staged_content_goes(spark, tmp_path):
    texts, names, entries = _inputs(spark)
    many = spark.range(50).select(F.col("id").alias("entry_id"), (F.col("id") % 5).alias("user_id"), F.lit(
        dt.datetime(2024, 1, 1, 9)).cast("timestamp_ntz").alias("entry_time"), F.lit(1).cast("long").alias("doc_id"),
        (F.col("id") == 7).alias("quiet"))
    store = JN.JournalStore(spark, f"{tmp_path}/journal")
    # names of changes that look like numbers stay names
    store.apply(many, texts, names, incognito_col="quiet", change="12e3", reuse=True)
    store.apply(entries.where("entry_id = 13").withColumn("entry_id", F.lit(60).cast("long")), texts, names, change="c2", reuse=True)
    advice = {(r.entry_id, r.ord): r for r in store.read("advice").collect()}
    assert set(advice) == {(i, o) for i in [*range(50), 60] for o in (0, 1)} - {(7, 1)}
    assert advice[3, 1].title.endswith("Anna") and advice[3, 1].created_at == dt.datetime(2024, 1, 1, 9)
    assert spark.read.parquet(f"{tmp_path}/journal/advice").where("entry_id is not null").count() == 51
    assert spark.read.parquet(f"{tmp_path}/journal/texts/advice").count() == 2
    assert all(not os.path.exists(f"{tmp_path}/journal/_staged/{c}/{t}") for c in ("12e3", "c2") for t in (*store.TABLES, "summary"))


def test_shuffles_are_dropped_within_the_block_only(spark):
    from moodspark.session import SHUFFLE_CLEANUP, shuffles_dropped
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    with shuffles_dropped(spark, spark):
        assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before


def test_cascade_over_frames(spark):
    texts, names, entries = _inputs(spark)
    res = JN.enrich(spark, entries, texts, names)
    users = spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, username string")
    with_text = entries.join(texts, "doc_id")
    left = MN.cascade_delete({"users": users, "entries": with_text, "analysis": res.analysis, "insight": res.insight,
                              "advice": res.advice, "summary": res.summary},
                             users.where("user_id = 2").select("user_id"), entries.where("entry_id = 11").select("entry_id", "user_id"))
    assert [r.user_id for r in left["users"].collect()] == [1]
    assert all({r.entry_id for r in left[n].collect()} == {10, 13} for n in ("entries", "analysis", "insight", "advice"))
    assert {(r.user_id, r.summary_date.day): r.entry_count for r in left["summary"].collect()} == {(1, 1): 1, (1, 2): 1}


def test_unknown_labels_are_rejected(spark):
    texts, names, entries = _inputs(spark)
    primary = spark.createDataFrame([(1, "bliss", 0.9, "p"), (2, "joy", 0.8, "p"), (3, None, None, "p")],
                                    "doc_id long, predicted_emotion string, confidence double, model_name string")
    res = JN.enrich(spark, entries, texts, names, primary=primary)
    assert [(r.entry_id, r.predicted_emotion) for r in res.rejected.collect()] == [(10, "bliss")]
    assert {r.entry_id: r.model_name == "p" for r in res.analysis.collect()} == {11: True, 12: False, 13: False}
    first = res.summary.where("user_id = 1").orderBy("summary_date").first()
    assert first.dominant_emotion == "neutral" and "null" not in first.summary_text


def _join_columns(plan):
    kids = [plan.children().apply(i) for i in range(plan.children().size())]
    out = {plan.output().apply(i).name() for i in range(plan.output().size())} if plan.nodeName() == "Join" else set()
    return out.union(*map(_join_columns, kids))


def test_enriched_summary_joins_previews_not_texts(spark):
    texts, names, entries = _inputs(spark)
    cols = _join_columns(JN.enrich(spark, entries, texts, names).summary._jdf.queryExecution().optimizedPlan())
    assert "preview" in cols and "text" not in cols


def test_keys_of_a_change_are_joined_by_merge(spark):
    few = spark.createDataFrame([(1,)], "entry_id long")
    many = spark.range(1000).withColumnRenamed("id", "entry_id")
    for how in ("left_anti", "left_semi", "inner"):
        plan = many.join(JN._by_merge(few).select("entry_id"), "entry_id", how)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan

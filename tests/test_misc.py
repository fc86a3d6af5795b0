"""Smaller operators: day filter, non-zero impact, blank texts,
bucket colours, word-piece merging, scorer fallback."""

import datetime as dt

from moodspark.functions import exprs as X
from moodspark.operators import entities as EN
from moodspark.operators import history as H
from moodspark.operators import scoring as SC


def test_history_day_filter(spark):
    ent = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 5, 23, 59)), (2, 1, dt.datetime(2024, 1, 6, 0, 0)),
                                 (3, 1, dt.datetime(2024, 1, 5, 0, 0))], "entry_id long, user_id long, entry_time timestamp_ntz")
    ana = spark.createDataFrame([(1, "joy", 0.9)], "entry_id long, predicted_emotion string, confidence double")
    page = H.history_page(ent, ana, H.insight_rows(ana), H.advice_rows(ent, ana, None), day="2024-01-05")
    assert [r.entry_id for r in page.orderBy("position").collect()] == [1, 3]
    assert page.where("entry_id = 3").first().advice == []


def test_nonzero_impact(spark):
    df = spark.createDataFrame([("a", 1, 0, 0), ("b", 0, 0, 0)], "entity string, positive long, negative long, neutral long")
    assert [r.entity for r in H.nonzero_impact(df).collect()] == ["a"]


def test_blank_text(spark):
    df = spark.createDataFrame([(" \n\t",), ("hi",)], "text string")
    assert [r[0] for r in df.select(SC.blank_text_error()).collect()] == ["Text must not be empty", None]


def test_bucket_colors(spark):
    df = spark.createDataFrame([("positive",), ("negative",), ("neutral",), (None,)], "b string")
    assert [r[0] for r in df.select(X.bucket_color("b")).collect()] == ["#ffb3ba", "#bae1ff", "#e2e2e2", "#e2e2e2"]


def test_merge_word_pieces(spark):
    rows = [(1, 0, 0, "Jo", "PER", 0, 2), (1, 0, 1, "##hn", "PER", 2, 4), (1, 0, 2, "Paris", "LOC", 10, 15),
            (1, 1, 0, "##x", "ORG", 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, sentence_idx int, m_ord int, word string, label string, start int, end int")
    got = sorted((r.sentence_idx, r.word, r.label, r.start, r.end) for r in EN.merge_word_pieces(df, "doc_id").collect())
    assert got == [(0, "John", "PER", 0, 4), (0, "Paris", "LOC", 10, 15), (1, "x", "ORG", 0, 1)]


def test_scorer_fallback(spark):
    texts = spark.createDataFrame([(1, "I love you"), (2, "a")], "id long, text string")
    primary = spark.createDataFrame([(1, None, None, "model"), (2, "fear", 0.7, "model")],
                                    "id long, predicted_emotion string, confidence double, model_name string")
    got = {r.id: (r.predicted_emotion, r.model_name) for r in SC.with_fallback(primary, texts, "id").collect()}
    assert got == {1: ("love", "keyword-baseline"), 2: ("fear", "model")}


def test_store_of_all_entries(spark, tmp_path):
    from moodspark.plans import journal as JN
    from moodspark.sources import tables as T
    sf = "/root/testdata/sf0.001"
    ent = T.entries(spark, sf).select("entry_id", "user_id", "entry_time", "doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    store = JN.JournalStore(spark, f"{tmp_path}/journal")
    store.apply(ent, docs, EN.corpus_gazetteer(docs))
    assert store.read("summary").count() > 0
    # every analysed entry has exactly one general advice row at ord 0
    assert store.read("advice").where("ord = 0").count() == store.read("analysis").count()

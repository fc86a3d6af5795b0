"""A text's advice and the text itself stay with their doc_id; the page comes to them."""

import datetime as dt
import re

from moodspark.operators import entities as EN
from moodspark.operators import history as H
from moodspark.plans import catalog

TEXTS = ["Anna was angry at Bob. Bob loves Anna, but Carl is sad.", "Carl met Anna. She cried. Anna and Bob were happy.",
         "Bob fears Carl. Anna hopes. It rained.", "nobody came", None]


def _tables(spark, at):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 3) for i in range(90)],
                          "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{at}/events.parquet")
    return str(at)


def test_no_shuffle_of_the_page_carries_the_advice_of_its_texts(spark, tmp_path):
    at = _tables(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = catalog.j10_history_page(spark, at)
        plan = out._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
        assert moved and not [m for m in moved if re.search(r"\b(advice|advice_text|_t)#", m)]
        # texts are moved once, without what was found in them
        assert {m.count("#") for m in moved if re.search(r"\btext#", m)} == {2}
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len({r.entry_id for r in rows}) == 60 and {r.text for r in rows} == set(TEXTS)
    one = sorted((r.ord, r.advice_title) for r in rows if r.entry_id == 85)
    assert one == [(0, "General Advice"), (1, "Regarding Anna"), (2, "Regarding Bob"), (3, "Regarding Carl")]


def test_advice_gathered_by_text_equals_advice_by_entry(spark):
    when = dt.datetime(2024, 1, 1)
    ent = spark.createDataFrame([(1, 1, 7, when), (2, 1, 7, when), (2, 1, 7, when), (3, 2, 8, when), (4, 2, None, when)],
                                "entry_id long, user_id long, doc_id long, entry_time timestamp_ntz")
    ana = spark.createDataFrame([(1, "joy"), (2, "anger"), (4, None)], "entry_id long, predicted_emotion string")
    votes = spark.createDataFrame([(7, "Bob", "PER", "positive", 2), (7, "Anna", "PER", "negative", 1), (8, "Rome", "LOC", "positive", 1)],
                                  "doc_id long, entity string, type string, emotion_bucket string, _first int")
    advice = EN.entity_advice(votes, "doc_id", spark)

    def lists(df):
        return {r.entry_id: r.advice for r in df.collect()}

    by_entry = lists(H.attach_advice(ent, H.advice_rows(ent, ana, advice)))
    assert lists(H.attach_advice(ent, H.advice_rows(ent, ana, None), advice)) == by_entry
    assert [a.title for a in by_entry[1]] == ["General Advice", "Regarding Anna", "Regarding Bob"]
    assert by_entry[3] == [] and len(by_entry[4]) == 1 and len(by_entry[2]) > 3


def test_place_and_length_of_a_name_survive_the_move(spark):
    texts = spark.createDataFrame([(1, "So Anna Maria Lee met XAnna's Bob. He left.")], "doc_id long, text string")
    gaz = spark.createDataFrame([("Anna Maria Lee", "PER"), ("Anna", "PER"), ("Maria", "PER"), ("Bob", "PER"), ("Lee", "PER")],
                                "word string, label string")
    sents = EN.sentence_rows(texts, "doc_id")
    light = EN.gazetteer_mentions(sents, gaz, 3)
    assert not {"m_ord", "n_words", "expanded", "name"} & set(light.columns)
    got = sorted(r.n for r in light.select(EN.whole_name().alias("n")).collect() if r.n)
    want = EN.mention_candidates(sents, 3).join(gaz, "word").select("piece_idx", "m_ord", "n_words", "word", "label", "expanded")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 6

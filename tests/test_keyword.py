"""Keyword scorer: hand-worked cases and properties (whole tables: its oracle)."""

import random

from pyspark.sql import functions as F

from moodspark.functions import fixed
from moodspark.operators import keyword as K


def test_hand_cases(spark):
    cases = {"I am angry": ("amusement", 0.5, 5), "I love you": ("love", 0.5, 3), "a": ("admiration", 0.5, 10),
             "Grieving & sad!": ("grief", 0.5, 5), "He was very nervous; nervousness": ("nervousness", 0.5, 14),
             "Étrange 42": ("neutral", 0.1, 0), "": ("neutral", 0.1, 0)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id long, text string")
    got = {r.id: (r.predicted_emotion, r.confidence, r.match_score) for r in K.keyword_score(df, "id").collect()}
    for i, t in enumerate(cases):
        assert got[i] == cases[t], t


def _scores(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r.id: r for r in K.keyword_score(df, "id").collect()}


def test_word_order_case_and_marks_do_not_matter(spark):
    got = _scores(spark, ["grateful and calm, so calm", "CALM! so... calm (and) Grateful", "calm so and grateful calm"])
    assert len({(r.predicted_emotion, r.confidence, r.match_score) for r in got.values()}) == 1


def test_a_repeated_text_scores_twice_as_much_for_the_same_label(spark):
    texts = ["angry", "I love you", "nervous laughter", "sad and curious"]
    got = _scores(spark, texts + [f"{t} {t}" for t in texts])
    for i in range(len(texts)):
        assert got[i + 4].predicted_emotion == got[i].predicted_emotion
        assert got[i + 4].match_score == 2 * got[i].match_score


def test_the_own_stem_of_a_label_matches_it(spark):
    labels = [x for x in fixed.LABELS if x != "neutral"]
    got = _scores(spark, [fixed.stems_of(x)[0] for x in labels])
    assert all(r.match_score > 0 and r.confidence == 0.5 for r in got.values())


def _odd_texts():
    stems = [s for _, _, _, s in fixed.label_stems()]
    rnd = random.Random(7)
    parts = [*stems, *(s[:k] for s in stems for k in (1, 2, 3, 5)), "angle", "ANGRY", "İf", "ſad", "sad", "x", "9", "_", "é", "Σ",
             "\U0001d49c", "\U0001f600", "", "'", "-", ".", "! ", " ", " ", " ", "\n", " ", "s"]
    return ["", None, "A sad day. an angry\U0001d49cangry \U0001f600joy"] + [
        "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(400)]


def test_candidate_words_are_the_words_that_begin_like_a_stem(spark):
    stems = [s for _, _, _, s in fixed.label_stems()]
    prefixes, heads = {s[:k] for s in stems for k in range(1, len(s) + 1)}, {s[:3] for s in stems}
    rows = spark.createDataFrame([(t,) for t in _odd_texts()], "text string").select(
        K.tokens(F.col("text")).alias("all"), K.candidate_words(F.col("text")).alias("found")).collect()
    assert sum(len(r.found) for r in rows) > 400
    assert all(r.found == [w for w in r.all if w in prefixes or w[:3] in heads] for r in rows)


def test_labels_within_the_row_are_those_of_the_grouped_scorer(spark):
    df = spark.createDataFrame(list(enumerate(_odd_texts())), "i long, text string")
    cols = ["i", "predicted_emotion", "confidence"]
    got = K.keyword_labels(df.withColumn("w", K.candidate_words(F.col("text"))), "w").select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, K.keyword_score(df, "i").select(*cols).collect()))
    joined = K.keyword_labels(df.withColumn("w", F.concat(*[K.candidate_words(F.lit(t)) for t in ("I am sad", "so sad", "sad")])), "w").first()
    assert joined.predicted_emotion == "sadness"

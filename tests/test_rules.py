"""Hand-worked cases for the scalar rules (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from moodspark.functions import exprs as X
from moodspark.functions import fixed
from moodspark.functions import text as TX


def one(spark, col, schema="x string", rows=None):
    df = spark.createDataFrame(rows or [(None,)], schema)
    return [r[0] for r in df.select(col.alias("v")).collect()]


def test_python_rounding_matches_python(spark):
    pairs = [(n, d) for d in range(1, 121) for n in range(0, d + 1)]
    df = spark.createDataFrame(pairs, "n long, d long")
    got = df.select("n", "d", X.py_round_ratio2(F.col("n"), F.col("d")).alias("r")).collect()
    for r in got:
        assert r.r == round(r.n / r.d, 2), (r.n, r.d, r.r)


def test_positivity_colors(spark):
    cases = {None: "#ffffff", 0.0: "#bae1ff", 0.25: "#cee1f0", 0.5: "#e2e2e2", 0.75: "#f0cace",
             1.0: "#ffb3ba", 1.4: "#ffb3ba"}
    df = spark.createDataFrame([(k,) for k in cases], "s double")
    for r in df.select("s", X.positivity_color("s").alias("c")).collect():
        assert r.c == cases[r.s]


def test_time_slots(spark):
    cases = {"05:59": "Evening", "06:00": "Morning", "11:59": "Morning", "12:00": "Afternoon",
             "17:59": "Afternoon", "18:00": "Evening"}
    rows = [(dt.datetime.fromisoformat(f"2024-01-01T{k}:00"), v) for k, v in cases.items()]
    df = spark.createDataFrame(rows, "t timestamp_ntz, want string")
    for r in df.select(X.time_slot("t").alias("got"), "want").collect():
        assert r.got == r.want


def test_flashback_labels(spark):
    cases = {"2024-03-24": "1 week ago today", "2024-03-17": "2 weeks ago today",
             "2024-03-10": "3 weeks ago today", "2024-03-03": None, "2024-02-29": None,
             "2024-01-31": "2 months ago today", "2023-03-31": "1 year ago today",
             "2022-03-31": "2 years ago today", "2023-01-31": None, "2024-03-31": None, "2024-04-01": None}
    df = spark.createDataFrame([(dt.date.fromisoformat(k), v) for k, v in cases.items()], "d date, want string")
    for r in df.select("d", X.flashback_label("d", "2024-03-31").alias("got"), "want").collect():
        assert r.got == r.want, r


def test_preview_strips_like_python(spark):
    texts = ["  　hello\nworld \t", "", None, "x" * 200 + "   ", " " * 5 + "a" * 158 + "  \n b",
             "a" * 159 + " " + " " * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.preview("t")).collect()]
    want = [(t or "").strip().replace("\n", " ")[:160] for t in texts]
    assert got == want


def test_clauses_and_names(spark):
    df = spark.createDataFrame([("I like Anna, but Bob was rude.",), ("But I stayed.",)], "s string")
    got = [r[0] for r in df.select(TX.contrastive_clauses(F.col("s"))).collect()]
    assert got == [["I like Anna", "Bob was rude"], ["I stayed"]]
    df = spark.createDataFrame([("(Ann-Marie's)!!", "o'neil-SMITH jr")], "a string, b string")
    r = df.select(TX.clean_entity_name(F.col("a")).alias("a"), TX.capitalize_entity(F.col("b")).alias("b")).first()
    assert r.a == "Ann-Marie" and r.b == "O'neil-Smith Jr"


def test_like_entity_prefix(spark):
    from moodspark.operators.history import is_entity_key
    keys = ["entity_bob_positive", "ENTITY_x", "entityZx", "general_positive"]
    df = spark.createDataFrame([(k,) for k in keys], "advice_key string")
    got = [r[0] for r in df.where(is_entity_key("advice_key")).collect()]
    assert got == keys[:3]


def test_bucket_rule(spark):
    vals = [None, "", "  Joy ", "anger", "neutral", "mystery", "   "]
    df = spark.createDataFrame([(v,) for v in vals], "e string")
    got = [r[0] for r in df.select(X.bucket("e")).collect()]
    assert got == ["neutral", "neutral", "positive", "negative", "neutral", None, None]


def test_stems_rule():
    assert fixed.stems_of("sadness") == ["sad", "sadness"]
    assert fixed.stems_of("amusement") == ["amuse", "amusement"]
    assert fixed.stems_of("anger") == ["angr", "anger"]
    assert fixed.stems_of("joy") == ["joy"]

"""Chunk packing, windows, pooling, metrics (hand-worked cases)."""

from pyspark.sql import functions as F

from moodspark.functions import text as TX
from moodspark.operators import chunks as CH
from moodspark.operators import metrics as MT


def test_pack_sentences(spark):
    def run(ns):
        df = spark.createDataFrame([([{"s": f"s{i}", "n": n} for i, n in enumerate(ns)],)],
                                   "a array<struct<s:string,n:int>>")
        out = df.select(CH.pack_sentences(F.col("a")).alias("c")).first().c
        return [list(range(c.first, c.last + 1)) for c in out]
    assert run([50, 60, 20, 130, 5]) == [[1, 2], [3], [4], [5]]
    assert run([61, 61]) == [[1, 2]]
    assert run([62, 62]) == [[1], [2]]


def test_window_starts(spark):
    df = spark.createDataFrame([(0,), (126,), (127,), (400,)], "n int")
    got = [r[0] for r in df.select(CH.window_starts(F.col("n"))).collect()]
    assert got == [[1], [1], [1, 107], [1, 107, 213, 319]]


def test_mean_pool_and_argmax(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9]), (1, [0.5, 0.5]), (2, [0.3, 0.3])], "k int, v array<double>")
    out = {r.k: r for r in CH.mean_pool(df, "k", "v").select("k", "v", CH.argmax_label(F.col("v")).alias("b")).collect()}
    assert [round(x, 6) for x in out[1].v] == [0.3, 0.7] and out[1].b.label == "amusement"
    assert out[2].b["index"] == 0   # tie: lowest index


def test_metrics_hand_case(spark):
    truth = [[1, 0], [1, 1]]
    pred = [[1, 0], [0, 1]]
    rows = [(i, j, truth[i][j], 1.0 if pred[i][j] else -1.0) for i in range(2) for j in range(2)]
    df = spark.createDataFrame(rows, "item_id int, label int, y int, logit double")
    m = MT.multilabel_metrics(df).first()
    assert m.subset_accuracy == 0.5 and m.hamming_loss == 0.25
    assert (round(m.precision_macro, 4), round(m.recall_macro, 4), round(m.f1_macro, 4)) == (1.0, 0.75, 0.8333)
    assert (round(m.precision_micro, 4), round(m.recall_micro, 4), round(m.f1_micro, 4)) == (1.0, 0.6667, 0.8)


def test_java_class_of_white_space_holds_the_same_characters(spark):
    from moodspark.functions import exprs as X
    from moodspark.functions import fixed

    c = spark.range(1, 0xD800).select(F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), "UTF-8"),
                                               "UTF-8").alias("c"))
    a, b = fixed.PY_WHITESPACE_CLASS, X.JAVA_WS
    assert c.where(F.col("c").rlike(f"[{a}]") != F.col("c").rlike(f"[{b}]")).count() == 0
    assert c.where(F.col("c").rlike(f"[^{a}]") != F.col("c").rlike(f"[^{b}]")).count() == 0
    assert c.where(F.col("c").rlike(f"[{b}]")).count() == 29


def test_running_sums_over_many_blocks_and_runs_widened_to_their_piece(spark):
    from moodspark.functions import text as TX
    from moodspark.operators import entities as EN

    got = spark.range(1).select(TX.running_sums(F.transform(F.sequence(F.lit(0), F.lit(1499)), lambda i: (i % 7).cast("int")))
                                .alias("s")).first().s
    want = [sum(i % 7 for i in range(n + 1)) for n in range(1500)]
    assert got == want
    text = "(Anna-Maria's, a　BobCat) x " * 400
    rows = EN.expanded_runs(EN.sentence_rows(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id"), "doc_id")
    old = rows.where("word = 'Cat'").orderBy("start").select("start", "expanded").first()
    assert rows.count() == 1600 and tuple(old) == (20, "BobCat")
    at = rows.join(spark.createDataFrame([(text.strip(),)], "s string")).where(F.expr("substr(s, start + 1, length(word)) <> word"))
    assert at.count() == 0 and {r.expanded for r in rows.select("expanded").distinct().collect()} == {"Anna-Maria's", "BobCat"}


def test_plain_names_and_sentences_take_the_short_way(spark):
    names = ["Anna", "Anna Lee", "Anna  Lee", "anna", "ANNA", "Anna-lee", "Anna\n", " Anna", "Annas'", "Anna's", "É", "Ann1", "A", "", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", TX.clean_entity_name(F.col("n")).alias("c"), TX.capitalize_entity(F.col("n")).alias("k")).collect()
    assert [r.c for r in got] == ["Anna", "Anna Lee", "Anna  Lee", "anna", "ANNA", "Anna-lee", "Anna", "Anna", "Annas", "Anna",
                                  "", "Ann1", "A", "", ""]
    assert [r.k for r in got] == ["Anna", "Anna Lee", "Anna Lee", "Anna", "Anna", "Anna-Lee", "Anna", "Anna", "Annas'", "Anna's",
                                  "É", "Ann1", "A", "", None]

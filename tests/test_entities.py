"""Entity sentiment hand-worked cases (carry-forward, clauses, votes)."""

from moodspark.operators import entities as EN


def test_carry_forward_and_clauses(spark):
    texts = spark.createDataFrame([(1, "Anna came. It rained. She smiled. She left."),
                                   (2, "I like Anna, but Bob was rude.")], "doc_id long, text string")
    gaz = spark.createDataFrame([("Anna", "PER"), ("Bob", "PER")], "word string, label string")
    m = EN.entity_mentions(texts, "doc_id", gaz).collect()
    anna1 = sorted(r.sentence_idx for r in m if r.doc_id == 1)
    assert anna1 == [0, 2]
    assert sorted(r.entity for r in m if r.doc_id == 2) == ["Anna", "Bob"]


def test_vote_rules(spark):
    rows = [(1, 0, 0, "Ann", "PER", "positive", 0.4), (1, 1, 0, "Ann", "PER", "negative", 0.4),
            (2, 0, 0, "Bo", "LOC", "positive", 0.5), (2, 1, 0, "Bo", "LOC", "positive", 0.3),
            (2, 2, 0, "Bo", "LOC", "neutral", 0.9), (3, 0, 0, "Cy", "ORG", "neutral", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, sentence_idx int, t_ord int, entity string, type string, "
                                     "emotion_bucket string, confidence double")
    v = {r.doc_id: r.emotion_bucket for r in EN.entity_votes(df, "doc_id").collect()}
    assert v == {1: "negative", 2: "neutral"}


def _names(spark, text, gaz):
    texts = spark.createDataFrame([(1, text)], "doc_id long, text string")
    g = spark.createDataFrame(gaz, "word string, label string")
    per = EN.sentence_mentions(texts, "doc_id", g).collect()
    return [(v["entity"], v["label"]) for r in per for v in r.valid]


def test_every_run_of_a_piece_and_pairs_are_looked_up(spark):
    gaz = [("Maria", "PER"), ("Smith", "PER"), ("Anna Smith", "PER"), ("New York", "LOC"), ("York", "LOC")]
    assert _names(spark, "Lena-Maria came.", gaz) == [("Lena-Maria", "PER")]
    assert _names(spark, "We met Anna Smith, then Smith again.", gaz) == [("Anna Smith", "PER"), ("Smith", "PER")]
    assert _names(spark, "In New  York (and York).", gaz) == [("New York", "LOC"), ("York", "LOC")]
    assert _names(spark, "Anna, Smith is no pair.", gaz) == [("Smith", "PER")]
    assert _names(spark, "nobody here", gaz) == []


def test_names_of_any_length_the_longest_from_the_left(spark):
    gaz = [("New York", "LOC"), ("New York City", "LOC"), ("City", "LOC"), ("Maria Da Silva", "PER"), ("Da Silva Santos", "PER"),
           ("Santos", "PER"), ("Charles de Gaulle", "PER"), ("Bank of America", "ORG"), ("York", "LOC")]
    assert _names(spark, "New York City is big, New York too, and York.", gaz) == [
        ("New York City", "LOC"), ("New York", "LOC"), ("York", "LOC")]
    assert _names(spark, "Maria Da Silva Santos sang.", gaz) == [("Maria Da Silva", "PER"), ("Santos", "PER")]
    assert _names(spark, '"Charles de Gaulle," said the Bank of America.', gaz) == [
        ("Charles de Gaulle", "PER"), ("Bank of America", "ORG")]
    assert _names(spark, "Charles, de Gaulle and Bank of 9 America", gaz) == []


def test_a_callers_tagger_gives_spans(spark):
    texts = spark.createDataFrame([(1, "We saw Anna-Lena in New York City. Johnson left."), (2, "She came.")],
                                  "doc_id long, text string")
    tagged = spark.createDataFrame(
        [(1, 0, 0, "Anna", "PER", 7, 11), (1, 0, 1, "New York City", "LOC", 20, 33), (1, 1, 0, "John", "PER", 0, 4),
         (1, 1, 1, "##son", "PER", 4, 7), (1, 0, 2, "Anna", "PER", 7, 11), (1, 0, 3, "Paris", "LOC", None, None)],
        "doc_id long, sentence_idx int, m_ord int, word string, label string, start int, end int")
    per = EN.sentence_mentions(texts, "doc_id", None, tagged=tagged).orderBy("doc_id", "sentence_idx").collect()
    assert [[v["entity"] for v in r.valid] for r in per] == [["Anna-Lena", "New York City", "Paris"], ["Johnson"], []]
    assert EN.entity_mentions(texts, "doc_id", None, tagged=tagged).count() == 4


def test_dedupe_keeps_the_first_of_each_name_and_type(spark):
    gaz = [("Anna", "PER"), ("Bob", "PER")]
    assert _names(spark, "Bob, Anna's and Anna and Bob saw Anna.", gaz) == [("Bob", "PER"), ("Anna", "PER")]


def test_a_sentence_of_thousands_of_names_is_linear(spark):
    import time

    names = ["X" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(5000)]
    start = time.time()
    got = _names(spark, " and ".join(names), [(n, "PER") for n in names])
    assert len(got) == 5000 and time.time() - start < 60


def test_names_move_without_their_sentences(spark):
    texts = spark.createDataFrame([(1, "Anna came.")], "doc_id long, text string")
    gaz = spark.createDataFrame([("Anna", "PER")], "word string, label string")
    names = EN.sentence_targets(EN.sentence_names(texts, "doc_id", gaz), "doc_id")
    assert names.columns == ["doc_id", "sentence_idx", "digest", "targets"] and len(names.first().digest) == 16


def test_rule_within_the_row_equals_the_grouped_scorer_and_a_repeated_key_counts_once(spark):
    said = ("Anna was angry, but Bob Marley loves Anna. She cried. Bob came. Anna and Bob, while Anna is proud, fear Bob. "
            "It rained. It rained. Though she smiled, Anna was sad. Bob came.")
    texts = spark.createDataFrame([(1, said), (1, said), (2, "Bob came."), (3, None), (4, " "), (None, "Bob came.")],
                                  "doc_id long, text string")
    gaz = spark.createDataFrame([("Anna", "PER"), ("Bob", "PER"), ("Bob Marley", "PER")], "word string, label string")
    row = sorted(map(tuple, EN.entity_mentions(texts, "doc_id", gaz).collect()))
    assert row == sorted(map(tuple, EN.entity_mentions(texts, "doc_id", gaz, EN.keyword_label_scorer).collect()))
    once = texts.distinct()
    assert row == sorted(map(tuple, EN.entity_mentions(once, "doc_id", gaz).collect()))
    assert len(row) == len({(r[0], r[1], r[2]) for r in row}) > 6 and {r[0] for r in row} == {1, 2}

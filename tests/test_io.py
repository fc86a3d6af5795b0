"""Readers and codecs: delimited split discovery, JSON, AES, schema evolution."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from moodspark.sources import io as IO


def test_split_discovery_and_separator(spark):
    d = tempfile.mkdtemp(prefix="moodspark-io-")
    with open(os.path.join(d, "training.tsv"), "w") as f:
        f.write("text\tjoy\tfear\nhello\t1\t0\n\t0\t1\n")
    with open(os.path.join(d, "dev.csv"), "w") as f:
        f.write("text,joy,fear\nbye,0,1\n")
    df = IO.load_training_data(spark, d, "text", ["joy", "fear"])
    rows = sorted((r.split, r.text, list(r.labels)) for r in df.collect())
    assert rows == [("train", "hello", [1.0, 0.0]), ("validation", "bye", [0.0, 1.0])]
    assert IO.separator_for("a.TXT") == "\t" and IO.separator_for("a.csv") == ","


def test_json_and_encryption(spark):
    df = spark.createDataFrame([('{"positive": 2}',), ("not json",), (None,)], "j string")
    got = [r[0] for r in df.select(IO.decode_json_map(F.col("j"))).collect()]
    assert got == [{"positive": 2}, {}, {}]
    key = F.lit("0123456789abcdef")
    t = spark.createDataFrame([("secret text",), ("",), ("plain-not-a-token",)], "t string")
    enc = t.select("t", IO.encrypt_text(F.col("t"), key).alias("e"))
    out = enc.select("t", IO.decrypt_text(F.col("e"), key).alias("d"), IO.decrypt_text(F.col("t"), key).alias("raw"))
    for r in out.collect():
        assert r.d == r.t and r.raw == r.t


def test_schema_evolution(spark):
    old = spark.createDataFrame([(1, "joy")], "entry_id long, predicted_emotion string")
    new = IO.ensure_analysis_columns(old)
    assert "scores" in new.columns and "task_type" in new.columns


def test_replace_by_key_and_mergeschema(spark):
    import os
    import tempfile
    from moodspark.operators import history as H
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "entry_id long, ord int, k string")
    new = spark.createDataFrame([(1, 0, "z")], "entry_id long, ord int, k string")
    processed = spark.createDataFrame([(1,), (3,)], "entry_id long")
    got = sorted(tuple(r) for r in H.replace_by_key(old, new, processed).collect())
    assert got == [(1, 0, "z"), (2, 0, "c")]
    gone = spark.createDataFrame([(2,)], "entry_id long")        # processed, and now without rows
    assert [r.entry_id for r in H.replace_by_key(old, new.where("false"), gone).collect()] == [1, 1]
    d = tempfile.mkdtemp(prefix="moodspark-evo-")
    spark.createDataFrame([(1, "joy")], "entry_id long, predicted_emotion string").write.parquet(os.path.join(d, "a"))
    spark.createDataFrame([(2, "fear", "multi_label")], "entry_id long, predicted_emotion string, task_type string") \
        .write.parquet(os.path.join(d, "b"))
    df = IO.ensure_analysis_columns(IO.read_evolving(spark, [os.path.join(d, "a"), os.path.join(d, "b")]))
    rows = {r.entry_id: r.task_type for r in df.collect()}
    assert rows == {1: None, 2: "multi_label"} and "scores" in df.columns


TEXTS = ['plain', 'two\nlines', 'a\ttab', 'say "hi", twice', "", "back\\slash", " kept spaces ", "é 🙂\r\nend"]


def test_whole_texts_come_back_from_training_files(spark, tmp_path):
    rows = spark.createDataFrame([(t, i % 2) for i, t in enumerate(TEXTS)], "text string, joy int")
    for name in ("train.csv", "val.tsv"):
        (rows.write.option("header", True).option("sep", IO.separator_for(name)).option("escape", '"').option("quoteAll", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(f"{tmp_path}/{name}"))
    df = IO.load_training_data(spark, str(tmp_path), "text", ["joy"], schema="text string, joy int", multi_line=True)
    for split in ("train", "validation"):
        assert sorted(r.text for r in df.where(F.col("split") == split).collect()) == sorted(filter(None, TEXTS))


def test_broken_records_are_an_error_or_kept_aside(spark, tmp_path):
    path, schema = f"{tmp_path}/all.csv", "text string, joy int"
    with open(path, "w") as f:
        f.write('text,joy\ngood,1\ntoo few\nno number,many\n,1\nlast,0\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        IO.load_training_data(spark, path, "text", ["joy"], schema=schema).collect()
    good, bad = IO.load_with_rejects(spark, path, "text", ["joy"], schema)
    assert sorted(r.text for r in good.collect()) == ["good", "last"]
    assert sorted((r.reason, r.record) for r in bad.collect()) == [
        ("broken record", "no number,many"), ("broken record", "too few"), ("missing text", ",1")]


def test_a_cut_text_is_an_error_unless_lines_may_break(spark, tmp_path):
    path, schema = f"{tmp_path}/all.csv", "text string, joy int"
    with open(path, "w") as f:
        f.write('text,joy\ngood,1\n"a text\ncut in two",0\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        IO.load_training_data(spark, path, "text", ["joy"], schema=schema).collect()
    whole = IO.load_training_data(spark, path, "text", ["joy"], schema=schema, multi_line=True)
    assert sorted(r.text for r in whole.collect()) == ["a text\ncut in two", "good"]


def test_training_files_keep_rows_without_text(spark, tmp_path):
    from moodspark.plans import catalog

    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a \"b\"\tc\nd"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = catalog.a2_training_files(spark, str(tmp_path)).collect()
    assert sorted((r.text, r.quality, r.toxic) for r in got) == [("", 0.0, 1.0), ("", 1.0, 1.0), ("a \"b\"\tc\nd", 1.0, 0.0)]

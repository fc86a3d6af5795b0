"""Session settings: what is set already stays, the master is never invented."""

from pyspark import SparkConf

from moodspark import session as S


def test_preset_values_are_kept():
    conf = SparkConf(loadDefaults=False).set("spark.sql.adaptive.enabled", "false").set("spark.ui.enabled", "true")
    left = S.unset_defaults(conf, {"spark.sql.shuffle.partitions": "9"})
    assert "spark.sql.adaptive.enabled" not in left and "spark.ui.enabled" not in left
    assert left["spark.sql.shuffle.partitions"] == "9" and "spark.master" not in left
    conf.set("spark.sql.shuffle.partitions", "2000")
    assert "spark.sql.shuffle.partitions" not in S.unset_defaults(conf, {"spark.sql.shuffle.partitions": "9"})


def test_checkpoint_dir_is_the_session_setting(spark):
    assert S.checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_materialize_keeps_rows_and_types(spark):
    df = spark.range(5).selectExpr("id", "array(id) as a", "cast(null as string) as s")
    back = S.materialize(df, "t")
    assert back.dtypes == df.dtypes and back.count() == 5

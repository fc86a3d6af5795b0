"""A user holding a third of all rows: salted two-phase top-k and the
per-user aggregates give the same rows as the unsalted plan."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from moodspark.operators import joins as J
from moodspark.operators import stats as ST
from moodspark.operators import summary as S
from moodspark.sources import tables as T

SF = "/root/testdata/sf0.001"


def _hot(spark):
    ent = T.entries(spark, SF).withColumn(
        "user_id", F.when(F.col("entry_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    return ent, T.analysis(spark, SF)


def test_salted_top_k_equals_plain_ranking(spark):
    ent, _ = _hot(spark)
    rows = ent.select("user_id", "entry_id", "entry_time")
    order = [F.desc("entry_time"), F.desc("entry_id")]
    got = J.top_k_per_group(rows, ["user_id"], order, 25, salt_buckets=16)
    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))) \
        .where("rank <= 25")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select(*got.columns).collect()))
    assert got.where("user_id = 0").count() == 25


def test_hot_user_aggregates(spark):
    ent, ana = _hot(spark)
    d5 = S.daily_summary(ent, ana)
    assert d5.where("user_id = 0").agg(F.sum("entry_count")).first()[0] == ent.where("user_id = 0").count()
    h = ST.time_heatmap(ent, ana).where("user_id = 0")
    assert h.count() == 21

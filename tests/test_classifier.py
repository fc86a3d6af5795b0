"""Label classifier: shared features, saved and read back with its labels; metrics of stored logits against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from moodspark.operators import metrics as MT


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, ("sunny happy " if i % 2 else "rainy grey ") + ("angry " if i % 3 == 0 else "calm ") + f"word{i % 7}",
             i % 2, int(i % 3 == 0)) for i in range(120)] + [(900, None, 1, 0), (901, "sunny calm", None, 0)]
    return spark.createDataFrame(data, "doc_id long, text string, joy int, anger int")


def test_saved_model_gives_the_same_logits_for_its_labels(spark, rows, tmp_path):
    model = MT.LabelModel.fit(rows, ["joy", "anger"], num_features=1 << 10)
    model.save(spark, f"{tmp_path}/m")
    back = MT.LabelModel.load(spark, f"{tmp_path}/m")
    assert back.labels == ["joy", "anger"]
    first, second = ({(r.doc_id, r.label): r.logit for r in m.logits(rows, "doc_id").collect()} for m in (model, back))
    assert first == second and len(first) == 2 * rows.count()
    assert all((first[i, "joy"] > 0) == (i % 2 == 1) and (first[i, "anger"] > 0) == (i % 3 == 0) for i in range(120))


def test_metrics_of_stored_logits_equal_sql(spark, rows, tmp_path):
    model = MT.LabelModel.fit(rows.where("doc_id < 40"), ["joy", "anger"], num_features=64, max_iter=1)
    truth = rows.where("doc_id < 120").select("doc_id", F.inline(F.array(*[F.struct(
        F.lit(c).alias("label"), F.col(c).alias("y")) for c in ("joy", "anger")])))
    stored = model.logits(rows, "doc_id").join(truth, ["doc_id", "label"])
    stored.write.parquet(f"{tmp_path}/logits")
    got = MT.multilabel_metrics(spark.read.parquet(f"{tmp_path}/logits"), item="doc_id").first()
    want = duckdb.sql(f"""
        WITH r AS (SELECT doc_id, label, y = 1 AS y, 1 / (1 + exp(-logit)) > 0.5 AS p FROM '{tmp_path}/logits/*.parquet'),
        l AS (SELECT label, count(*) FILTER (y AND p) AS tp, count(*) FILTER (p) AS pp, count(*) FILTER (y) AS yy FROM r GROUP BY 1),
        i AS (SELECT doc_id, count(*) FILTER (y <> p) AS wrong FROM r GROUP BY 1)
        SELECT (SELECT count(*) FROM i), (SELECT avg((wrong = 0)::INT) FROM i), (SELECT avg((y <> p)::INT) FROM r),
               avg(coalesce(tp / nullif(pp, 0), 0)), avg(coalesce(tp / nullif(yy, 0), 0)),
               avg(coalesce(2 * tp / nullif(pp + yy, 0), 0)), coalesce(sum(tp) / nullif(sum(pp), 0), 0),
               sum(tp) / sum(yy), 2 * sum(tp) / sum(pp + yy) FROM l""").fetchall()[0]
    assert [round(x, 9) for x in got] == [round(x, 9) for x in want]

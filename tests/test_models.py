"""Models, writers and streams that have no registered twin."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from buylens.ml import models
from buylens.plans import ml
from buylens.schemas import SCHEMAS
from buylens.sources import tables as io
from buylens.streaming import checks, runs


@pytest.fixture(scope="module")
def fitted(t):
    return models.fit(models.logistic(ml.FEW), ml.kept(t))


def test_one_invoice_scores_as_in_the_batch(t, fitted):
    key = t["invoice_header"].agg(F.min("invoice_id")).first()[0]
    def rows(df):
        return sorted((r.invoice_line_number, r.prediction, round(r.probability, 9)) for r in df.collect())
    one = rows(models.score_one(fitted, t, key, ml.FEW))
    assert one and one == rows(models.score_batch(fitted, t, None, ml.FEW).filter(F.col("invoice_id") == key))


def test_attributions_add_up_to_the_logit(t, fitted):
    df = ml.kept(t)
    logit = fitted.transform(df).select("invoice_id", "invoice_line_number", F.element_at(vector_to_array("rawPrediction"), 2).alias("z"))
    total = F.aggregate("contributions", F.col("base"), lambda acc, c: acc + c["contribution"])
    worst = models.attributions(fitted, df, ml.FEW).join(logit, ["invoice_id", "invoice_line_number"]).agg(F.max(F.abs(total - F.col("z")))).first()[0]
    assert worst < 1e-9


def test_saved_tables_and_features_read_back(spark, t, tmp_path):
    io.save_tables(t, folder=str(tmp_path), names=["plant"])
    plants = io.load_tables(spark, "parquet", ["plant"], folder=str(tmp_path))
    assert io.verify_counts(plants, expected={"plant": 5}).filter("ok").count() == 2
    io.write_features(ml.kept(t), f"{tmp_path}/f", "invoice_date")
    assert spark.read.parquet(f"{tmp_path}/f").count() == t["invoice_line_item"].count()
    with pytest.raises(ValueError):
        io.load_tables(spark, "tape", ["plant"])


def test_replayed_invoices_are_dropped(spark, t, tmp_path):
    rows = t["invoice_header"].filter("vendor_id = 'VND-000001'")
    rows.unionByName(rows).coalesce(1).write.parquet(f"{tmp_path}/in/invoice_header")
    stream = runs.table_stream(spark, f"{tmp_path}/in", "invoice_header", SCHEMAS["invoice_header"])
    kept = checks.drop_replays(stream.withColumn("ts", F.col("invoice_date").cast("timestamp")), "ts", "1 day")
    assert runs.run_to_folder(kept, f"{tmp_path}/out", f"{tmp_path}/state").count() == rows.count() > 0

"""Round trips of the sinks (S4, S5, S8) and the delimited reader."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from assay.operators import scoring
from assay.sources import tables as tb
from assay.sources.views import obs
from tests.conftest import SF_SMALL


def _scratch(spark, name):
    base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp()
    return os.path.join(base.replace("file:", ""), "io-tests", name)


def test_csv_round_trip(spark):
    d = obs(spark, SF_SMALL).select("obs_id", "total_price", "label")
    path = _scratch(spark, "csv")
    tb.write_csv(d, path)
    back = tb.read_delimited(spark, path, ["obs_id", "total_price", "label"])
    back = back.select(F.col("obs_id").cast("long"), F.col("total_price").cast("double"), "label")
    assert sorted(back.collect()) == sorted(d.collect())


def test_json_summary_round_trip(spark):
    s = spark.createDataFrame([("m", 0.5)], "model string, accuracy double")
    s = tb.run_metadata(s, classes=["F", "O", "P"], n_rows=10)
    path = _scratch(spark, "json")
    tb.write_json_summary(s, path)
    r = spark.read.json(path).first()
    assert r["model"] == "m" and json.loads(r["classes"]) == ["F", "O", "P"] and r["n_rows"] == 10


def test_model_save_load(spark):
    from assay.plans.q_models import FEATURES, model_base
    b = model_base(spark, SF_SMALL)
    m = scoring.fit_scoring_pipeline(b.where("split = 'train'"), FEATURES)
    path = _scratch(spark, "model")
    m.write().overwrite().save(path)
    again = scoring.PipelineModel.load(path)
    x = scoring.batch_score(m, b, "id").orderBy("id").collect()
    y = scoring.batch_score(again, b, "id").orderBy("id").collect()
    assert x == y

"""The funnel's univariate stage decides what the later stages see."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from assay.operators import select as se
from assay.plans import q_models
from tests.conftest import SF_SMALL


def test_univariate_stage_of_the_funnel_decides(spark, monkeypatch):
    whole, scored = se.anova_f, []

    def by_name(sign):
        def scores(long):
            names = sorted(r.feature for r in whole(long).collect())
            scored.append(names)
            return long.sparkSession.createDataFrame([(n, float(sign * i)) for i, n in enumerate(names)], "feature string, f_score double")
        return scores
    kept = []
    for sign in (1, -1):
        monkeypatch.setattr(se, "anova_f", by_name(sign))
        rows = entry.queries()["feature_funnel"](spark, SF_SMALL).collect()
        kept.append({r.feature for r in rows})
        put = set(scored[-1][-q_models.UNIVARIATE:] if sign > 0 else scored[-1][:q_models.UNIVARIATE])
        assert put <= kept[-1] < set(scored[-1])
        assert {r.feature for r in rows if r.final} <= {r.feature for r in rows if r.importance_kept} < kept[-1]
    assert kept[0] != kept[1]


def test_low_variance_takes_no_place_in_the_rankings(spark, monkeypatch):
    seen = []
    whole = se.anova_f
    monkeypatch.setattr(se, "anova_f", lambda long: seen.append({r.feature for r in long.select("feature").distinct().collect()}) or whole(long))
    b = q_models.model_base(spark, SF_SMALL)
    # a column that hardly varies but tells the label apart
    flat = b.withColumn("is_auto", F.when(F.col("label") == "F", 0.01).otherwise(0.0))
    monkeypatch.setattr(q_models, "model_base", lambda *_: flat)
    got = {r.feature for r in entry.queries()["feature_funnel"](spark, SF_SMALL).collect()}
    assert "is_auto" not in seen[0] and "is_auto" not in got and len(got) >= q_models.UNIVARIATE

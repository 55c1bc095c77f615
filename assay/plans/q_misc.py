"""Queries for the cleaning audit (A22), fitted imputer (C10), isolation forest (C14),
scoring (T1, T2) and stream scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.functions.hashing import sql_uniform, uniform
from assay.functions.stats import r6
from assay.functions.text import normalize_target, parse_number
from assay.operators import clean, outliers, scoring
from assay.plans.registry import register
from assay.sources.views import obs, obs_raw

SEED = 42
_NUM_RE = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
CAUSES = ["header_row", "non_numeric", "invalid_class", "out_of_range"]


def _sql_parse(x):
    return f"(case when regexp_matches(trim({x}), {_NUM_RE}) then cast(trim({x}) as double) end)"


@register("cleaning_audit", f"""
with c as (
  select case
    when coalesce(regexp_matches(label_txt, 'label_txt|label', 'i'), false)
      or coalesce(regexp_matches(qty_txt, 'qty|txt', 'i'), false)
      or coalesce(regexp_matches(price_txt, 'price|txt', 'i'), false) then 'header_row'
    when {_sql_parse('qty_txt')} is null or {_sql_parse('price_txt')} is null then 'non_numeric'
    when not coalesce(upper(trim(label_txt)) in ('F', 'O', 'P'), false) then 'invalid_class'
    when {_sql_parse('qty_txt')} > 300 or {_sql_parse('price_txt')} < 0 then 'out_of_range'
  end as cause from obs_raw),
a as (select count(*) as n,
        {", ".join(f"cast(sum(case when cause = '{k}' then 1 else 0 end) as bigint) as {k}" for k in CAUSES)} from c)
select 0 as step, 'raw' as cause, cast(0 as bigint) as n_removed, n as n_remaining from a
{"".join(f" union all select {i + 1}, '{k}', {k}, n - ({' + '.join(CAUSES[:i + 1])}) from a" for i, k in enumerate(CAUSES))}
""", ("obs_raw",))
def cleaning_audit(spark, sf):
    """Rows removed per cause, each row counted once at its first failing
    step, all steps in ONE aggregate pass."""
    r = obs_raw(spark, sf)
    qty, price = parse_number(F.col("qty_txt")), parse_number(F.col("price_txt"))
    cause = (F.when(clean.header_row_mask("label_txt", "label_txt|label", ["qty_txt", "price_txt"]), "header_row")
             .when(qty.isNull() | price.isNull(), "non_numeric")
             .when(~F.coalesce(normalize_target(F.col("label_txt")).isin("F", "O", "P"), F.lit(False)), "invalid_class")
             .when((qty > 300) | (price < 0), "out_of_range"))
    a = r.select(cause.alias("cause")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("cause") == k).cast("bigint")).alias(k) for k in CAUSES])
    rows = [F.struct(F.lit(0).alias("step"), F.lit("raw").alias("cause"), F.lit(0).cast("bigint").alias("n_removed"),
                     F.col("n").alias("n_remaining"))]
    run = F.lit(0).cast("bigint")
    for i, k in enumerate(CAUSES):
        run = run + F.coalesce(F.col(k), F.lit(0))
        rows.append(F.struct(F.lit(i + 1).alias("step"), F.lit(k).alias("cause"),
                             F.coalesce(F.col(k), F.lit(0)).alias("n_removed"), (F.col("n") - run).alias("n_remaining")))
    return a.select(F.inline(F.array(*rows)))


@register("imputer_model", f"""
with t as (select * from obs where {sql_uniform("cast(obs_id as string)", "'split'")} >= 0.2),
m as (select quantile_disc(qty_sum, 0.5) as med from t)
select obs_id, coalesce(qty_sum, med) as qty_sum from obs cross join m
where {sql_uniform("cast(obs_id as string)", "'split'")} < 0.2""", ("obs",))
def imputer_model(spark, sf):
    """``ml.feature.Imputer(strategy='median')`` fitted on train, applied to test."""
    o = obs(spark, sf).select("obs_id", "qty_sum")
    u = uniform(F.col("obs_id"), "split")
    m = clean.fit_imputer_model(o.where(u >= 0.2), ["qty_sum"])
    return m.transform(o.where(u < 0.2))


@register("median_record", """
select quantile_cont(qty_sum, 0.5) as qty_sum, quantile_cont(total_price, 0.5) as total_price,
       quantile_cont(acct_bal, 0.5) as acct_bal,
       (select segment from obs group by segment order by count(*) desc, segment limit 1) as segment from obs""",
          ("obs",))
def median_record(spark, sf):
    """Median numeric values and modal category as the example record."""
    return scoring.median_record(obs(spark, sf), ["qty_sum", "total_price", "acct_bal"], ["segment"])


@register("isolation_forest")
def isolation_forest(spark, sf):
    """C14: isolation-forest scores and the 5 % outlier flag (rows-only; share tested)."""
    o = obs(spark, sf).select("obs_id", "qty_sum", "total_price", "acct_bal")
    d = outliers.isolation_forest(o, "obs_id", ["qty_sum", "total_price", "acct_bal"], 0.05, seed=SEED)
    return d.select("obs_id", r6("anomaly_score").alias("anomaly_score"), "is_outlier")


def _scoring_model(spark, sf):
    from assay.plans.q_models import FEATURES, model_base
    b = model_base(spark, sf)
    model = scoring.fit_scoring_pipeline(b.where(F.col("split") == "train"), FEATURES)
    return b, model


@register("batch_score")
def batch_score(spark, sf):
    """T1 + S8: fit, save, load and score the whole table with one PipelineModel."""
    from assay.streaming.scoring import scratch_dir
    b, model = _scoring_model(spark, sf)
    path = scratch_dir(spark, "models", f"score-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    loaded = scoring.PipelineModel.load(path)
    s = scoring.batch_score(loaded, b, "id", ["label"])
    return s.select("id", "label", "pred", *[r6(c).alias(c) for c in s.columns if c.startswith("p_")],
                    r6("confidence").alias("confidence"))


@register("stream_score")
def stream_score(spark, sf):
    """T1 on Structured Streaming: the fitted pipeline scores a parquet file stream."""
    from assay.streaming.scoring import read_scored, scratch_dir
    from assay.streaming.scoring import stream_score as run
    b, model = _scoring_model(spark, sf)
    run_id = uuid.uuid4().hex
    src = scratch_dir(spark, "stream", run_id, "in")
    b.write.mode("overwrite").parquet(src)
    schema = spark.read.parquet(src).schema
    sink, ck = scratch_dir(spark, "stream", run_id, "out"), scratch_dir(spark, "stream", run_id, "ck")
    run(spark, model, src, schema, sink, ck, "id", ["label"])
    s = read_scored(spark, sink)
    return s.select("id", "label", "pred", *[r6(c).alias(c) for c in s.columns if c.startswith("p_")],
                    r6("confidence").alias("confidence"))

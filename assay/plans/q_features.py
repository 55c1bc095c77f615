"""Queries for derived features (M*) and the flagship feature summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.stats import attach, one_row, quantile_row, r6
from assay.operators import clean, features as fe
from assay.plans.registry import register
from assay.sources.views import obs
from assay.sources.tables import read_table

# Qty bins (right-closed) for the flagship and M13.
QTY_EDGES = [0, 50, 100, 150, 200, 500]

SQL_FEATURE_SUMMARY = """
with st as (
  select quantile_cont(qty_sum, 0.5) as qm,
         quantile_cont(total_price, 0.25) as pq1, quantile_cont(total_price, 0.75) as pq3,
         quantile_cont(acct_bal, 0.25) as bq1, quantile_cont(acct_bal, 0.75) as bq3,
         avg(acct_bal) as bm, stddev_samp(acct_bal) as bsd
  from obs),
f as (
  select label, coalesce(qty_sum, qm) as qty_f,
    case when total_price is not null then least(greatest(total_price, pq1 - 1.5 * (pq3 - pq1)), pq3 + 1.5 * (pq3 - pq1)) end as price_c,
    case when acct_bal is not null then least(greatest(acct_bal, bq1 - 1.5 * (bq3 - bq1)), bq3 + 1.5 * (bq3 - bq1)) end as bal_c,
    (acct_bal - bm) / bsd as bal_z,
    coalesce(cast(total_price > pq3 as int), 0) as hi_price,
    coalesce(cast(acct_bal < bq1 as int), 0) as low_bal
  from obs cross join st),
g as (
  select *, price_c / (qty_f + 1) as price_per_qty,
    case when qty_f > 0 and qty_f <= 50 then 0 when qty_f > 50 and qty_f <= 100 then 1
         when qty_f > 100 and qty_f <= 150 then 2 when qty_f > 150 and qty_f <= 200 then 3
         when qty_f > 200 and qty_f <= 500 then 4 end as qty_bin
  from f)
select label, qty_bin, count(*) as n, round(avg(price_per_qty), 4) as avg_price_per_qty,
       round(avg(bal_z), 6) as avg_bal_z, cast(sum(hi_price) as bigint) as n_hi_price,
       cast(sum(low_bal) as bigint) as n_low_bal, round(avg(price_c), 2) as avg_price_c,
       round(avg(bal_c), 4) as avg_bal_c
from g group by label, qty_bin
"""


@register("feature_summary", SQL_FEATURE_SUMMARY, ("obs",))
def feature_summary(spark, sf):
    """Flagship: C7 median fill -> C12 IQR cap -> M1, M8, M9, M13 -> A3 per class.

    The statistics are one-row tables (moments, and exact quantiles read off value counts near the wanted ranks); the
    per-row work is a single projection and the output a map-side combined group-by on (label, bin).
    """
    o = obs(spark, sf)
    moments = one_row(o, {"acct_bal__mean": F.avg("acct_bal"), "acct_bal__sd": F.stddev_samp("acct_bal")})
    points = quantile_row(o, {
        "qty_sum__median": ("qty_sum", 0.5), "total_price__q1": ("total_price", 0.25),
        "total_price__q3": ("total_price", 0.75), "acct_bal__q1": ("acct_bal", 0.25), "acct_bal__q3": ("acct_bal", 0.75)})
    j = attach(attach(o, moments), points)
    qty_f = F.coalesce(F.col("qty_sum"), F.col("qty_sum__median"))
    price_c = clean.cap_expr("total_price", 1.5, False)
    g = j.select(
        "label", qty_f.alias("qty_f"), price_c.alias("price_c"),
        clean.cap_expr("acct_bal", 1.5, False).alias("bal_c"),
        ((F.col("acct_bal") - F.col("acct_bal__mean")) / F.col("acct_bal__sd")).alias("bal_z"),
        fe.flag(F.col("total_price") > F.col("total_price__q3")).alias("hi_price"),
        fe.flag(F.col("acct_bal") < F.col("acct_bal__q1")).alias("low_bal"))
    g = g.select("*", (F.col("price_c") / (F.col("qty_f") + 1)).alias("price_per_qty"),
                 fe.bin_fixed(F.col("qty_f"), QTY_EDGES).alias("qty_bin"))
    return g.groupBy("label", "qty_bin").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("price_per_qty"), 4).alias("avg_price_per_qty"),
        r6(F.avg("bal_z")).alias("avg_bal_z"), F.sum("hi_price").cast("bigint").alias("n_hi_price"),
        F.sum("low_bal").cast("bigint").alias("n_low_bal"), r6(F.avg("price_c"), 2).alias("avg_price_c"),
        r6(F.avg("bal_c"), 4).alias("avg_bal_c"))


NUM = ["qty_sum", "total_price", "acct_bal"]


def _o(spark, sf):
    return obs(spark, sf).select("obs_id", "qty_sum", "total_price", "acct_bal", "label")


@register("feat_ratio", """
select obs_id, round(total_price / (qty_sum + 1), 6) as total_price_per_qty_sum,
       round(qty_sum / (total_price + 1), 9) as qty_sum_per_total_price from obs""", ("obs",))
def feat_ratio(spark, sf):
    """M1: safe ratio x/(y+1) in both directions."""
    d = fe.ratio_features(_o(spark, sf), [("total_price", "qty_sum"), ("qty_sum", "total_price")])
    return d.select("obs_id", r6("total_price_per_qty_sum").alias("total_price_per_qty_sum"),
                    r6("qty_sum_per_total_price", 9).alias("qty_sum_per_total_price"))


def _pair_sql():
    from itertools import combinations
    parts = []
    for a, b in combinations(NUM, 2):
        parts += [f"round({a} * {b}, 4) as {a}_x_{b}", f"round({a} / ({b} + 1e-8), 6) as {a}_ratio_{b}",
                  f"round({a} - {b}, 6) as {a}_diff_{b}"]
    return "select obs_id, " + ", ".join(parts) + " from obs"


@register("feat_pairwise", _pair_sql(), ("obs",))
def feat_pairwise(spark, sf):
    """M2: product / eps-ratio / difference for all pairs of the first 4 numerics."""
    from itertools import combinations
    d = fe.pairwise_features(_o(spark, sf), NUM)
    cols = []
    for a, b in combinations(NUM, 2):
        cols += [r6(f"{a}_x_{b}", 4).alias(f"{a}_x_{b}"), r6(f"{a}_ratio_{b}").alias(f"{a}_ratio_{b}"),
                 r6(f"{a}_diff_{b}").alias(f"{a}_diff_{b}")]
    return d.select("obs_id", *cols)


@register("feat_interaction", """
select obs_id, round(total_price * qty_sum, 4) as total_price_x_qty_sum,
       round(acct_bal * qty_sum, 4) as acct_bal_x_qty_sum, round(total_price * acct_bal, 4) as total_price_x_acct_bal
from obs""", ("obs",))
def feat_interaction(spark, sf):
    """M3: named interactions."""
    pairs = [("total_price", "qty_sum"), ("acct_bal", "qty_sum"), ("total_price", "acct_bal")]
    d = fe.interaction_features(_o(spark, sf), pairs)
    return d.select("obs_id", *[r6(f"{a}_x_{b}", 4).alias(f"{a}_x_{b}") for a, b in pairs])


@register("feat_power", """
select obs_id, round(qty_sum * qty_sum, 4) as qty_sum_sq, round(sqrt(qty_sum), 9) as qty_sum_sqrt,
       round(acct_bal * acct_bal, 4) as acct_bal_sq,
       round(case when acct_bal >= 0 then sqrt(acct_bal) end, 9) as acct_bal_sqrt from obs""", ("obs",))
def feat_power(spark, sf):
    """M4 square, M5 square root (null below 0)."""
    d = fe.power_features(_o(spark, sf), ["qty_sum", "acct_bal"])
    return d.select("obs_id", *[r6(f"{c}_sq", 4).alias(f"{c}_sq") for c in ["qty_sum", "acct_bal"]],
                    *[r6(f"{c}_sqrt", 9).alias(f"{c}_sqrt") for c in ["qty_sum", "acct_bal"]])


@register("feat_log", """
select obs_id, round(ln(1 + qty_sum), 9) as qty_sum_log, round(ln(1 + total_price), 9) as total_price_log,
       round(case when acct_bal > -1 then ln(1 + acct_bal) end, 9) as acct_bal_log from obs""", ("obs",))
def feat_log(spark, sf):
    """M6: log1p."""
    d = fe.log_features(_o(spark, sf), NUM)
    return d.select("obs_id", *[r6(f"{c}_log", 9).alias(f"{c}_log") for c in NUM])


@register("feat_log_if_skewed", """
with st as (select min(value) as mn, avg(value) as mu,
                   avg(power(value - (select avg(value) from events), 3)) / power(avg(power(value - (select avg(value) from events), 2)), 1.5) as sk
            from events)
select event_id, round(value, 6) as value, round(ln(1 + value), 9) as value_log from events
""")
def feat_log_if_skewed(spark, sf):
    """M7: log column only when min > 0 and |population skew| > 1.

    ``events.value`` (skew 1.9, min > 0) takes the branch; the schema follows
    the statistics, so the oracle states the branch taken on this data.
    """
    ev = read_table(spark, sf, "events").select("event_id", "value")
    d = fe.log_if_skewed(ev, ["value"])
    return d.select("event_id", r6("value").alias("value"),
                    *[r6(c, 9).alias(c) for c in d.columns if c.endswith("_log")])


@register("feat_zscore", """
select obs_id, round((total_price - avg(total_price) over ()) / stddev_samp(total_price) over (), 9) as total_price_z,
       round((acct_bal - avg(acct_bal) over ()) / stddev_samp(acct_bal) over (), 9) as acct_bal_z from obs""",
          ("obs",))
def feat_zscore(spark, sf):
    """M8: z-score with the sample std (one stats pass, broadcast)."""
    d = fe.zscore_features(_o(spark, sf), ["total_price", "acct_bal"])
    return d.select("obs_id", r6("total_price_z", 9).alias("total_price_z"),
                    r6("acct_bal_z", 9).alias("acct_bal_z"))


@register("feat_quantile_flags", """
with st as (select quantile_cont(total_price, 0.75) as p75, quantile_cont(acct_bal, 0.25) as b25,
                   quantile_cont(qty_sum, 0.9) as q90 from obs)
select obs_id, coalesce(cast(total_price > p75 as int), 0) as high_price,
       coalesce(cast(acct_bal < b25 as int), 0) as low_balance,
       coalesce(cast(qty_sum > q90 as int), 0) as high_qty from obs cross join st""", ("obs",))
def feat_quantile_flags(spark, sf):
    """M9: quantile flags, null comparison -> 0."""
    rules = [("high_price", "total_price", ">", 0.75), ("low_balance", "acct_bal", "<", 0.25),
             ("high_qty", "qty_sum", ">", 0.9)]
    d = fe.quantile_flags(_o(spark, sf), rules)
    return d.select("obs_id", "high_price", "low_balance", "high_qty")


@register("feat_median_flags", """
with st as (select quantile_cont(total_price, 0.5) as med from obs)
select obs_id, coalesce(cast(total_price > med as int), 0) as total_price_above_median,
       coalesce(cast(total_price < 0.5 * med as int), 0) as total_price_below_half_median from obs cross join st""",
          ("obs",))
def feat_median_flags(spark, sf):
    """Median flags."""
    d = fe.median_flags(_o(spark, sf), "total_price")
    return d.select("obs_id", "total_price_above_median", "total_price_below_half_median")


@register("feat_risk_score", """
with st as (select quantile_cont(total_price, 0.75) as p75, quantile_cont(acct_bal, 0.25) as b25,
                   quantile_cont(qty_sum, 0.75) as q75, quantile_cont(total_price, 0.25) as p25 from obs),
f as (select obs_id, coalesce(cast(total_price > p75 as int), 0) as a, coalesce(cast(acct_bal < b25 as int), 0) as b,
             coalesce(cast(qty_sum > q75 as int), 0) as c, coalesce(cast(total_price < p25 as int), 0) as d
      from obs cross join st)
select obs_id, cast(2.0 * a + 2.0 * b + 1.0 * c + 0.5 * d as double) as risk_score from f""", ("obs",))
def feat_risk_score(spark, sf):
    """Weighted risk score 2a + 2b + 1c + 0.5d over quantile flags."""
    rules = [("a", "total_price", ">", 0.75), ("b", "acct_bal", "<", 0.25), ("c", "qty_sum", ">", 0.75),
             ("d", "total_price", "<", 0.25)]
    d = fe.quantile_flags(_o(spark, sf), rules)
    return d.select("obs_id", fe.weighted_score({"a": 2.0, "b": 2.0, "c": 1.0, "d": 0.5}).alias("risk_score"))


@register("feat_combined_score", """
select obs_id, cast(case segment when 'AUTOMOBILE' then -1 when 'BUILDING' then 0 when 'FURNITURE' then 1 end
  + case priority when '1-URGENT' then 2.0 when '2-HIGH' then 1.0 when '3-MEDIUM' then 0.5
      when '4-NOT SPECIFIED' then 0.0 end as double) as combined_score from obs""", ("obs",))
def feat_combined_score(spark, sf):
    """Sum of ordinal codes (null-propagating)."""
    from assay.operators.encode import encode_fixed
    from assay.plans.q_encode import PRIORITY_ORDINAL, SEGMENT_CODES
    o = obs(spark, sf)
    s = encode_fixed(F.col("segment"), SEGMENT_CODES) + encode_fixed(F.col("priority"), PRIORITY_ORDINAL)
    return o.select("obs_id", s.cast("double").alias("combined_score"))


@register("bin_fixed", """
select obs_id,
  case when qty_sum > 0 and qty_sum <= 50 then 0 when qty_sum > 50 and qty_sum <= 100 then 1
       when qty_sum > 100 and qty_sum <= 150 then 2 when qty_sum > 150 and qty_sum <= 200 then 3
       when qty_sum > 200 and qty_sum <= 500 then 4 end as qty_bin,
  case when acct_bal > 0 and acct_bal <= 3000 then 0 when acct_bal > 3000 and acct_bal <= 6000 then 1
       when acct_bal > 6000 and acct_bal <= 10000 then 2 end as bal_bin from obs""", ("obs",))
def bin_fixed(spark, sf):
    """Right-closed fixed-edge bins; outside -> null."""
    o = obs(spark, sf)
    return o.select("obs_id", fe.bin_fixed(F.col("qty_sum"), QTY_EDGES).alias("qty_bin"),
                    fe.bin_fixed(F.col("acct_bal"), [0, 3000, 6000, 10000]).alias("bal_bin"))


@register("bin_quantile", """
with st as (select list_distinct([quantile_cont(total_price, 0.2), quantile_cont(total_price, 0.4),
                   quantile_cont(total_price, 0.6), quantile_cont(total_price, 0.8)]) as e from obs)
select obs_id, cast(len(list_filter(e, lambda x: x < total_price)) as int) as total_price_qbin from obs cross join st""",
          ("obs",))
def bin_quantile(spark, sf):
    """Quintile bins, right-closed, lowest included."""
    d = fe.bin_quantile(_o(spark, sf), "total_price", 5)
    return d.select("obs_id", "total_price_qbin")


@register("feat_poly", """
select obs_id, round(qty_sum * total_price, 4) as poly_qty_sum_x_total_price,
       round(qty_sum * acct_bal, 4) as poly_qty_sum_x_acct_bal,
       round(total_price * acct_bal, 4) as poly_total_price_x_acct_bal from obs""", ("obs",))
def feat_poly(spark, sf):
    """Degree-2 interaction-only terms."""
    d = fe.poly_interactions(_o(spark, sf), NUM)
    return d.select("obs_id", *[r6(c, 4).alias(c) for c in d.columns if c.startswith("poly_")])


@register("feat_ratio_of_ratio", """
select obs_id, round(total_price / (qty_sum + 1), 6) as total_price_per_qty_sum,
       round((total_price / (qty_sum + 1)) / (acct_bal + 1), 6) as total_price_per_qty_sum_per_acct_bal from obs""",
          ("obs",))
def feat_ratio_of_ratio(spark, sf):
    """Ratio of a ratio."""
    d = fe.ratio_of_ratio(_o(spark, sf), "total_price", "qty_sum", "acct_bal")
    return d.select("obs_id", *[r6(c).alias(c) for c in d.columns if "_per_" in c])

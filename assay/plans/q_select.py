"""Queries for feature scoring / selection (F1-F3, F6, U2-U5, W2-W3) and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.stats import r6
from assay.operators import scale as sc
from assay.operators import select as se
from assay.plans.registry import register
from assay.sources.views import obs

# Derived feature set used by the selection queries (units keep magnitudes
# small: prices and balances in thousands).
FEATURES = {
    "qty_sum": ("qty_sum", "qty_sum"),
    "price_k": ("total_price / 1000", "total_price / 1000"),
    "bal_k": ("acct_bal / 1000", "acct_bal / 1000"),
    "price_per_qty_k": ("total_price / 1000 / (qty_sum + 1)", "total_price / 1000 / (qty_sum + 1)"),
    "qty_log": ("ln(1 + qty_sum)", "ln(1 + qty_sum)"),
    "price_log": ("ln(1 + total_price)", "ln(1 + total_price)"),
    "bal_sq_m": ("acct_bal * acct_bal / 1000000", "acct_bal * acct_bal / 1000000"),
    "is_urgent": ("cast(priority = '1-URGENT' as double)", "cast(priority = '1-URGENT' as double)"),
    "is_auto": ("cast(segment = 'AUTOMOBILE' as double)", "cast(segment = 'AUTOMOBILE' as double)"),
    "bal_negative": ("cast(acct_bal < 0 as double)", "cast(acct_bal < 0 as double)"),
    "bal_over_9990": ("cast(acct_bal > 9990 as double)", "cast(acct_bal > 9990 as double)"),
    "priority_score": ("case priority when '1-URGENT' then 2.0 when '2-HIGH' then 1.0 when '3-MEDIUM' then 0.5 "
                       "when '4-NOT SPECIFIED' then 0.0 end",) * 2,
}
ORIGINAL = ["qty_sum", "price_k", "bal_k"]
VARIANCE_THRESHOLD = 0.005


def feature_long(spark, sf):
    o = obs(spark, sf)
    w = o.select("obs_id", "label", *[F.expr(spark_sql).cast("double").alias(n)
                                      for n, (spark_sql, _) in FEATURES.items()])
    return se.to_long(w, ["obs_id", "label"], list(FEATURES))


SQL_LONG = "long as (" + " union all ".join(
    f"select obs_id, label, '{n}' as feature, cast({d} as double) as value from obs" for n, (_, d) in FEATURES.items()) + ")"

SQL_ANOVA = SQL_LONG + """,
g as (select feature, label, count(value) as n, avg(value) as mu, var_pop(value) as vp from long
      where value is not null group by feature, label),
g2 as (select *, sum(n * mu) over (partition by feature) / sum(n) over (partition by feature) as gm,
              sum(n) over (partition by feature) as nn, count(*) over (partition by feature) as k from g),
s as (select feature, nn, k, sum(n * (mu - gm) * (mu - gm)) as ssb, sum(n * vp) as ssw from g2 group by feature, nn, k),
anova as (select feature, round(case when ssw = 0 or k = 1 then null else (ssb / (k - 1)) / (ssw / (nn - k)) end, 6) as f_score from s)"""

SQL_MI = SQL_LONG + """,
e as (select feature, list_distinct([quantile_cont(value, 0.2), quantile_cont(value, 0.4), quantile_cont(value, 0.6),
                                     quantile_cont(value, 0.8)]) as edges from long group by feature),
ct as (select l.feature, len(list_filter(edges, lambda x: x < l.value)) as bin, label, count(*) as n
       from long l join e on l.feature = e.feature where l.value is not null group by all),
t as (select feature, n * 1.0 / sum(n) over (partition by feature)
             * ln((n * sum(n) over (partition by feature)) / (sum(n) over (partition by feature, bin) * sum(n) over (partition by feature, label))) as term
      from ct),
mi as (select feature, round(sum(term), 9) as mi from t group by feature)"""

SQL_VAR = "var as (select feature, var_pop(value) as variance from long group by feature)"


# Scores are rounded before ranking so that mathematically equal scores (e.g. MI of
# monotone transforms of one column) tie exactly and the name decides.
def _anova(spark, sf):
    return se.anova_f(feature_long(spark, sf)).select("feature", r6("f_score").alias("f_score"))


def _mi(spark, sf):
    return se.mutual_information(feature_long(spark, sf)).select("feature", r6("mi", 9).alias("mi"))


def _kept(spark, sf):
    return se.variance_table(feature_long(spark, sf)).where(F.col("variance") > VARIANCE_THRESHOLD)


@register("anova_f", f"with {SQL_ANOVA}\nselect feature, round(f_score, 6) as f_score from anova", ("obs",))
def anova_f(spark, sf):
    """F1: ANOVA F score of every feature."""
    return _anova(spark, sf).select("feature", r6("f_score").alias("f_score"))


@register("mutual_information", f"with {SQL_MI}\nselect feature, round(mi, 9) as mi from mi", ("obs",))
def mutual_information(spark, sf):
    """binned mutual information of every feature with the label."""
    return _mi(spark, sf).select("feature", r6("mi", 9).alias("mi"))


@register("variance_filter", f"with {SQL_LONG}, {SQL_VAR}\n"
          f"select feature, round(variance, 4) as variance, variance > {VARIANCE_THRESHOLD} as kept from var", ("obs",))
def variance_filter(spark, sf):
    """population variance and the 0.005 threshold decision."""
    v = se.variance_table(feature_long(spark, sf))
    return v.select("feature", r6("variance", 4).alias("variance"), (F.col("variance") > VARIANCE_THRESHOLD).alias("kept"))


@register("top_features", f"with {SQL_ANOVA}\nselect feature, round(f_score, 6) as f_score, rank from "
          "(select *, row_number() over (order by f_score desc nulls last, feature) as rank from anova) t where rank <= 10",
          ("obs",))
def top_features(spark, sf):
    """Top-10 features by F score."""
    a = _anova(spark, sf).where(F.col("f_score").isNotNull())
    return se.top_k(a, "f_score", 10).select("feature", r6("f_score").alias("f_score"),
                                              F.col("rank").cast("bigint").alias("rank"))


def _top_sql(table, score, k):
    return (f"(select feature from (select feature, row_number() over (order by {score} desc nulls last, feature) as rk "
            f"from {table}) x where rk <= {k})")


@register("select_intersect_or_union", f"""with {SQL_ANOVA}, {SQL_MI[len(SQL_LONG) + 2:]},
a as {_top_sql('anova', 'f_score', 6)}, b as {_top_sql('mi', 'mi', 6)},
i as (select feature from a intersect select feature from b)
select feature from i where (select count(*) from i) >= 6
union all
select feature from (select feature from a union select feature from b) u where (select count(*) from i) < 6""",
          ("obs",))
def select_intersect_or_union(spark, sf):
    """Intersection of F-test and MI top-6, or their union when smaller than 6."""
    a = se.top_k(_anova(spark, sf), "f_score", 6)
    b = se.top_k(_mi(spark, sf), "mi", 6)
    return se.intersect_or_union(a, b, 6)


@register("select_consensus", f"""with {SQL_ANOVA}, {SQL_MI[len(SQL_LONG) + 2:]}, {SQL_VAR},
a as {_top_sql('anova', 'f_score', 8)}, b as {_top_sql('mi', 'mi', 8)},
c as (select feature from var where variance > {VARIANCE_THRESHOLD}),
h as (select feature, count(*) as hits from (select feature from a union all select feature from b
      union all select feature from c) u group by feature),
r as (select h.feature, hits = 3 as in_all, sum(case when hits = 3 then 1 else 0 end) over () as n_all,
             row_number() over (order by anova.f_score desc nulls last, h.feature) as rk
      from h left join anova on h.feature = anova.feature)
select feature from r where (n_all >= 15 and in_all) or (n_all < 15 and rk <= 25)""", ("obs",))
def select_consensus(spark, sf):
    """Consensus of three selections, else the union capped at 25 by F score."""
    a = se.top_k(_anova(spark, sf), "f_score", 8)
    b = se.top_k(_mi(spark, sf), "mi", 8)
    return se.consensus([a, b, _kept(spark, sf)], _anova(spark, sf), 15, 25)


@register("select_union", f"""with {SQL_ANOVA}, {SQL_MI[len(SQL_LONG) + 2:]}, {SQL_VAR},
a as {_top_sql('anova', 'f_score', 5)}, b as {_top_sql('mi', 'mi', 5)},
c as {_top_sql(f'(select * from var where variance > {VARIANCE_THRESHOLD})', 'variance', 5)}
select feature from a union select feature from b union select feature from c""", ("obs",))
def select_union(spark, sf):
    """Union of three top-5 selections, distinct."""
    a = se.top_k(_anova(spark, sf), "f_score", 5)
    b = se.top_k(_mi(spark, sf), "mi", 5)
    c = se.top_k(_kept(spark, sf), "variance", 5)
    return se.union_of([a, b, c])


@register("engineered_only", f"""with {SQL_ANOVA}, {SQL_MI[len(SQL_LONG) + 2:]}, {SQL_VAR},
a as {_top_sql('anova', 'f_score', 5)}, b as {_top_sql('mi', 'mi', 5)},
c as {_top_sql(f'(select * from var where variance > {VARIANCE_THRESHOLD})', 'variance', 5)},
u as (select feature from a union select feature from b union select feature from c)
select feature from u except select unnest(['qty_sum', 'price_k', 'bal_k'])""", ("obs",))
def engineered_only(spark, sf):
    """Selected features that are not original columns."""
    u = select_union(spark, sf)
    orig = spark.createDataFrame([(c,) for c in ORIGINAL], "feature string")
    return u.join(F.broadcast(orig), "feature", "left_anti")


NUM = ["qty_sum", "total_price", "acct_bal"]


@register("scale_standard", "select obs_id, " + ", ".join(
    f"round(({c} - avg({c}) over ()) / case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end, 6) as {c}"
    for c in NUM) + " from obs", ("obs",))
def scale_standard(spark, sf):
    """Standard scaling with the population std."""
    d = sc.standard_scale(obs(spark, sf).select("obs_id", *NUM), NUM)
    return d.select("obs_id", *[r6(c).alias(c) for c in NUM])


@register("scale_robust", "with st as (select " + ", ".join(
    f"quantile_cont({c}, 0.25) as {c}_q1, quantile_cont({c}, 0.5) as {c}_q2, quantile_cont({c}, 0.75) as {c}_q3"
    for c in NUM) + " from obs) select obs_id, " + ", ".join(
    f"round(({c} - {c}_q2) / case when {c}_q3 - {c}_q1 = 0 then 1 else {c}_q3 - {c}_q1 end, 6) as {c}"
    for c in NUM).replace("with st as (select", "with st as (select") + " from obs cross join st",
          ("obs",))
def scale_robust(spark, sf):
    """Robust scaling (x - median) / IQR."""
    d = sc.robust_scale(obs(spark, sf).select("obs_id", *NUM), NUM)
    return d.select("obs_id", *[r6(c).alias(c) for c in NUM])

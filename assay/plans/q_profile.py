"""Queries for profiles and aggregates (A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.stats import r6
from assay.functions.text import parse_number
from assay.operators import profile as pr
from assay.plans.registry import register
from assay.sources.tables import read_table
from assay.sources.views import model_preds, obs, obs_raw, pred

NUM = ["qty_sum", "total_price", "acct_bal"]
ALL_OBS = ["obs_id", "qty_sum", "total_price", "acct_bal", "segment", "nation", "priority", "label"]


def _round_cols(df, digits=6, skip=()):
    return df.select(*[r6(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


@register("null_profile", " union all ".join(
    f"select '{c}' as feature, cast(count(*) - count({c}) as bigint) as n_null, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 6) as pct_null from obs" for c in ALL_OBS), ("obs",))
def null_profile(spark, sf):
    """A2: nulls per column."""
    return _round_cols(pr.null_profile(obs(spark, sf), ALL_OBS))


@register("value_counts", "select nation, count(*) as n from obs group by nation", ("obs",))
def value_counts(spark, sf):
    """A3: frequency table."""
    return pr.value_counts(obs(spark, sf), "nation")


@register("value_share", """
select label, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from obs group by label""",
          ("obs",))
def value_share(spark, sf):
    """A4: relative frequency."""
    return _round_cols(pr.value_share(obs(spark, sf), "label"))


@register("describe_numeric", " union all ".join(
    f"""select '{c}' as feature, count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
  round(min({c}), 4) as min, round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.5), 4) as p50,
  round(quantile_cont({c}, 0.75), 4) as p75, round(max({c}), 4) as max from obs""" for c in NUM), ("obs",))
def describe_numeric(spark, sf):
    """A5: describe with exact quartiles."""
    return _round_cols(pr.describe(obs(spark, sf), NUM), 4)


@register("range_profile", " union all ".join(
    f"""select '{c}' as feature, round(min({c}), 4) as min, round(max({c}), 4) as max, round(avg({c}), 4) as mean,
  round(quantile_cont({c}, 0.5), 4) as median, cast(sum(case when {c} >= 0 then 1 else 0 end) as bigint) as n_non_negative
from obs""" for c in NUM), ("obs",))
def range_profile(spark, sf):
    """Range profile."""
    return _round_cols(pr.range_profile(obs(spark, sf), NUM), 4)


PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


@register("quantiles", " union all ".join(
    f"select '{c}' as feature, cast({p} as double) as p, round(quantile_cont({c}, {p}), 6) as value from obs"
    for c in NUM for p in PROBS), ("obs",))
def quantiles(spark, sf):
    """Interpolated quantiles."""
    return _round_cols(pr.quantiles(obs(spark, sf), NUM, PROBS), skip=("p",))


_SKEW_SQL = """
select event_type, round(m3 / power(m2, 1.5), 6) as skewness, n from (
  select e.event_type, avg(power(value - mu, 3)) as m3, avg(power(value - mu, 2)) as m2, count(value) as n
  from events e join (select event_type, avg(value) as mu from events group by event_type) m
    on e.event_type = m.event_type group by e.event_type) t"""


@register("skewness_profile", _SKEW_SQL)
def skewness_profile(spark, sf):
    """Population skewness per event type."""
    ev = read_table(spark, sf, "events")
    return _round_cols(pr.skewness_by(ev, "value", "event_type"))


@register("correlation_matrix", " union all ".join(
    (f"select '{a}' as feature_a, '{b}' as feature_b, cast(1.0 as double) as corr" if a == b else
     f"select '{a}' as feature_a, '{b}' as feature_b, round(corr({a}, {b}), 6) as corr from obs")
    for a in NUM for b in NUM), ("obs",))
def correlation_matrix(spark, sf):
    """Correlation matrix (long form)."""
    return _round_cols(pr.correlation_matrix(obs(spark, sf), NUM))


@register("distinct_profile", " union all ".join(
    f"select '{c}' as feature, count(distinct {c}) as n_distinct from obs" for c in ALL_OBS), ("obs",))
def distinct_profile(spark, sf):
    """A10: exact distinct counts."""
    return pr.distinct_profile(obs(spark, sf), ALL_OBS)


@register("distinct_approx")
def distinct_approx(spark, sf):
    """A10 at scale: HyperLogLog++ distinct counts (rows-only; error bound tested)."""
    return pr.distinct_profile(obs(spark, sf), ALL_OBS, approx=True)


@register("class_balance", """
select count(*) as n_classes, min(n) as min_count, max(n) as max_count, round(min(n) / max(n), 6) as balance_ratio
from (select label, count(*) as n from doc_obs group by label) t""", ("doc_obs",))
def class_balance(spark, sf):
    """Class balance ratio."""
    from assay.sources.views import doc_obs
    return _round_cols(pr.class_balance(doc_obs(spark, sf), "label"))


@register("class_weights", """
select label, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as weight
from obs group by label""", ("obs",))
def class_weights(spark, sf):
    """Balanced class weights."""
    return _round_cols(pr.class_weights(obs(spark, sf), "label"))


@register("histogram", """
with st as (select min(value) as lo, max(value) as hi from events),
c as (select cast(least(floor((value - lo) / ((hi - lo) / 20)), 19) as int) as bin, count(*) as n
      from events cross join st group by 1),
g as (select cast(unnest(range(20)) as int) as bin)
select g.bin, round(lo + g.bin * ((hi - lo) / 20), 6) as bin_lo, round(lo + (g.bin + 1) * ((hi - lo) / 20), 6) as bin_hi,
       cast(coalesce(c.n, 0) as bigint) as n
from g cross join st left join c on g.bin = c.bin""")
def histogram(spark, sf):
    """20-bin histogram of events.value, empty bins kept."""
    return _round_cols(pr.histogram(read_table(spark, sf, "events").select("value"), "value", 20))


@register("box_stats_by_class", """
with q as (select label, quantile_cont(total_price, 0.25) as q1, quantile_cont(total_price, 0.5) as median,
                  quantile_cont(total_price, 0.75) as q3 from obs group by label)
select o.label, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
  round(min(case when total_price >= q1 - 1.5 * (q3 - q1) then total_price end), 6) as whisker_lo,
  round(max(case when total_price <= q3 + 1.5 * (q3 - q1) then total_price end), 6) as whisker_hi,
  cast(sum(case when total_price < q1 - 1.5 * (q3 - q1) or total_price > q3 + 1.5 * (q3 - q1) then 1 else 0 end) as bigint) as n_outliers,
  count(total_price) as n
from obs o join q on o.label = q.label group by o.label, q1, median, q3""", ("obs",))
def box_stats_by_class(spark, sf):
    """Box statistics per class."""
    return _round_cols(pr.box_stats(obs(spark, sf), "total_price", "label"))


@register("kde_by_class", """
with rng as (select min(value) as lo, max(value) as hi from events),
bw as (select event_type, stddev_samp(value) * power(count(value), -0.2) as h from events group by event_type),
g as (select unnest(range(32)) as i)
select e.event_type, cast(g.i as int) as grid_index, round(lo + g.i * (hi - lo) / 31, 6) as x,
       round(avg(exp(-power((lo + g.i * (hi - lo) / 31 - value) / h, 2) / 2)) / (h * sqrt(2 * pi())), 9) as density
from events e cross join rng join bw on e.event_type = bw.event_type cross join g
group by e.event_type, g.i, lo, hi, h""")
def kde_by_class(spark, sf):
    """Kernel density per event type on a 32-point grid."""
    d = pr.kde(read_table(spark, sf, "events"), "value", "event_type", 32)
    return d.select("event_type", "grid_index", r6("x").alias("x"), r6("density", 9).alias("density"))


@register("pair_bins", """
with st as (select min(total_price) as alo, max(total_price) as ahi, min(acct_bal) as blo, max(acct_bal) as bhi from obs)
select label, cast(least(floor((total_price - alo) / ((ahi - alo) / 10)), 9) as int) as bin_a,
       cast(least(floor((acct_bal - blo) / ((bhi - blo) / 10)), 9) as int) as bin_b, count(*) as n
from obs cross join st where total_price is not null and acct_bal is not null group by all""", ("obs",))
def pair_bins(spark, sf):
    """2-D bin counts per class."""
    return pr.pair_bins(obs(spark, sf), "total_price", "acct_bal", "label", 10)


_NUM_RE = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


@register("null_patterns", f"""
select case when regexp_matches(trim(qty_txt), {_NUM_RE}) then '0' else '1' end
    || case when regexp_matches(trim(price_txt), {_NUM_RE}) then '0' else '1' end
    || case when segment_txt is null then '1' else '0' end as pattern, count(*) as n
from obs_raw group by 1""", ("obs_raw",))
def null_patterns(spark, sf):
    """Null-pattern counts after coercion."""
    r = obs_raw(spark, sf).select(parse_number(F.col("qty_txt")).alias("qty"),
                                  parse_number(F.col("price_txt")).alias("price"), "segment_txt")
    return pr.null_patterns(r, ["qty", "price", "segment_txt"])


@register("errors_by_class", """
select label, cast(sum(case when label <> pred then 1 else 0 end) as bigint) as n_errors, count(*) as n
from pred group by label""", ("pred",))
def errors_by_class(spark, sf):
    """Errors per true class."""
    return pr.errors_by_class(pred(spark, sf), "label", "pred")


@register("confidence_hist", """
with st as (select 0.0 as lo, 1.0 as hi)
select model, cast(least(floor(confidence * 10), 9) as int) as bin, count(*) as n,
       round(avg(confidence), 6) as mean_confidence
from model_preds where split = 'test' group by all""", ("model_preds",))
def confidence_hist(spark, sf):
    """Distribution of the max class probability per model (10 fixed bins on [0, 1])."""
    m = model_preds(spark, sf).where(F.col("split") == "test")
    b = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int")
    return (m.groupBy("model", b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), r6(F.avg("confidence")).alias("mean_confidence")))


_QP_COLS = ["qty_sum", "segment", "nation", "label"]
_TYPES = {"qty_sum": "double", "segment": "string", "nation": "string", "label": "string"}


@register("quality_profile", " union all ".join(
    f"""select '{c}' as feature, '{_TYPES[c]}' as dtype, count(distinct {c}) as n_distinct,
  cast(count(*) - count({c}) as bigint) as n_null,
  {"cast(min(" + c + ") as string)" if _TYPES[c] == "string" else "cast(min(" + c + ") as string)"} as min,
  cast(max({c}) as string) as max from obs""" for c in _QP_COLS), ("obs",))
def quality_profile(spark, sf):
    """Column quality profile."""
    return pr.quality_profile(obs(spark, sf), _QP_COLS)


@register("top_values", """
select feature, value, n, rank from (
  select feature, value, n, row_number() over (partition by feature order by n desc, value asc nulls first) as rank
  from (select feature, value, count(*) as n from (
          select 'segment' as feature, segment as value from obs union all
          select 'nation', nation from obs union all
          select 'priority', priority from obs) u group by feature, value) c) t
where rank <= 5""", ("obs",))
def top_values(spark, sf):
    """Top-5 values per column."""
    d = pr.top_values(obs(spark, sf), ["segment", "nation", "priority"], 5)
    return d.select("feature", "value", "n", F.col("rank").cast("bigint").alias("rank"))


@register("any_null", " union all ".join(
    f"select '{c}' as feature, bool_or({c} is null) as has_null from obs" for c in ALL_OBS), ("obs",))
def any_null(spark, sf):
    """Any-null check per column."""
    return pr.any_null(obs(spark, sf), ALL_OBS)

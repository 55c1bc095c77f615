"""Queries for splitting, folds, shuffling and class rebalancing (R*, W6, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.hashing import sql_hash60, sql_uniform
from assay.operators import sampling as sa
from assay.plans.registry import register
from assay.sources.tables import read_table
from assay.sources.views import doc_obs, obs

SEED = 42


def _rank_sql(src, label, id_col="obs_id", seed=SEED):
    part = f"partition by {label}" if label else ""
    h = sql_hash60(f"cast({id_col} as string)", f"'{seed}'")
    cnt = f"count(*) over ({part})"
    return (f"select *, row_number() over ({part} order by {h}, {id_col}) - 1 as rk, {cnt} as n from {src}")


@register("split_stratified", f"""
with r as ({_rank_sql('(select obs_id, label from obs) b', 'label')})
select obs_id, label, case when rk < ceil(n * 0.2) then 'test' else 'train' end as split from r""", ("obs",))
def split_stratified(spark, sf):
    """Exact stratified 80/20 split."""
    return sa.split_stratified(obs(spark, sf).select("obs_id", "label"), "label", "obs_id", 0.2, SEED)


@register("split_safe", f"""
with r as ({_rank_sql('(select doc_id, label from doc_obs) b', 'label', 'doc_id')})
select doc_id, label, case when rk < ceil(n * 0.2) then 'test' else 'train' end as split from r""", ("doc_obs",))
def split_safe(spark, sf):
    """Stratified if the smallest class allows it (it does on doc_obs), else plain."""
    return sa.split_safe(doc_obs(spark, sf).select("doc_id", "label"), "label", "doc_id", 0.2, SEED)


@register("folds_stratified", f"""
with r as ({_rank_sql('(select obs_id, label from obs) b', 'label')})
select obs_id, label, cast(rk % 5 as int) as fold from r""", ("obs",))
def folds_stratified(spark, sf):
    """Stratified 5 folds."""
    return sa.folds_stratified(obs(spark, sf).select("obs_id", "label"), "label", "obs_id", 5, SEED)


@register("seeded_shuffle", f"""
with r as ({_rank_sql('(select obs_id, label from obs) b', None)})
select obs_id, label, rk as position from r""", ("obs",))
def seeded_shuffle(spark, sf):
    """Seeded permutation with explicit positions."""
    return sa.seeded_shuffle(obs(spark, sf).select("obs_id", "label"), "obs_id", SEED)


def _draw_sql(base, label, id_col, target_sql, under=None):
    h = sql_hash60(f"cast({label} as string)", f"'{SEED}'", "cast(draw as string)")
    keep_cond = "r.n >= t.target" if under is None else f"r.n >= t.target and r.n <= t.target * {under}"
    under_sql = "" if under is None else f"""
union all
select r.{id_col}, r.{label}, r.rk as draw from r cross join t where r.n > t.target * {under} and r.rk < t.target"""
    return f"""
with b as ({base}),
r as ({_rank_sql('b', label, id_col)}),
t as ({target_sql}),
c as (select distinct {label}, n from r),
s as (select c.{label}, c.n, unnest(range(t.target)) as draw from c cross join t where c.n < t.target),
p as (select {label}, draw, {h} % n as rk from s)
select r.{id_col}, r.{label}, p.draw from p join r on p.{label} = r.{label} and p.rk = r.rk
union all
select r.{id_col}, r.{label}, cast(null as bigint) as draw from r cross join t where {keep_cond}{under_sql}"""


@register("balance_max", _draw_sql("select obs_id, label from obs", "label", "obs_id",
                                   "select max(n) as target from (select label, count(*) as n from b group by label) x"),
          ("obs",))
def balance_max(spark, sf):
    """Every class resampled with replacement to the largest size."""
    return sa.balance_max(obs(spark, sf).select("obs_id", "label"), "label", "obs_id", SEED)


@register("balance_median_band", _draw_sql(
    "select doc_id, lang from documents", "lang", "doc_id",
    "select cast(floor(median(n) * 1.2) as bigint) as target from (select lang, count(*) as n from b group by lang) x",
    under=1.5))
def balance_median_band(spark, sf):
    """R2: int(1.2 * median) target; over below, under above 1.5 * target."""
    return sa.balance_median_band(read_table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", SEED)


@register("balance_noise")
def balance_noise(spark, sf):
    """int(1.3 * median) target with 1 % std Gaussian noise on continuous columns (rows-only)."""
    o = obs(spark, sf).select("obs_id", "total_price", "acct_bal", "label")
    return sa.balance_noise(o, "label", "obs_id", ["total_price", "acct_bal"], factor=1.3, scale=0.01, seed=SEED)


@register("balance_noise_max")
def balance_noise_max(spark, sf):
    """Max-size target with 0.5 % std noise (rows-only)."""
    o = obs(spark, sf).select("obs_id", "total_price", "acct_bal", "label")
    return sa.balance_noise(o, "label", "obs_id", ["total_price", "acct_bal"], scale=0.005, use_max=True, seed=SEED)


def _noise_sizes_sql(target):
    return f"""
with b as (select label, count(*) as n from obs group by label), t as (select {target} as target from b)
select label, n < target as drawn, case when n < target then target else n end as rows from b cross join t"""


def _noise_sizes(d):
    return d.groupBy("label", F.col("draw").isNotNull().alias("drawn")).agg(F.count(F.lit(1)).alias("rows"))


@register("balance_noise_sizes", _noise_sizes_sql("cast(floor(median(n) * 1.3) as bigint)"), ("obs",))
def balance_noise_sizes(spark, sf):
    """Rows per class after the draw to int(1.3 * median)."""
    return _noise_sizes(balance_noise(spark, sf))


@register("balance_noise_max_sizes", _noise_sizes_sql("max(n)"), ("obs",))
def balance_noise_max_sizes(spark, sf):
    """Rows per class after the draw to the largest size."""
    return _noise_sizes(balance_noise_max(spark, sf))


@register("balance_poisson")
def balance_poisson(spark, sf):
    """R1 scale variant: Poisson copies by hash, sizes right in expectation (rows-only)."""
    return sa.poisson_oversample(doc_obs(spark, sf).select("doc_id", "label"), "label", "doc_id", SEED)


@register("split_hash", f"""
select obs_id, label, case when {sql_uniform("cast(obs_id as string)", f"'{SEED}'", "'split'")} < 0.2
  then 'test' else 'train' end as split from obs""", ("obs",))
def split_hash(spark, sf):
    """R9/R10 scale variant: Bernoulli 80/20 split by hash threshold (no shuffle, no window)."""
    return sa.split_hash(obs(spark, sf).select("obs_id", "label"), "obs_id", 0.2, SEED)

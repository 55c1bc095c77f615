"""Queries for scans, projections, filters and cleaning (S*, P*, C*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.functions.stats import attach, r6
from assay.functions.text import (normalize_category, normalize_target, parse_number,
                                  sanitize_value, strip_numeric_symbols, title_case)
from assay.operators import clean
from assay.plans.registry import register
from assay.session import ensure_checkpoint_dir
from assay.sources.tables import read_delimited, read_table, require_columns, write_csv
from assay.sources.views import obs, obs_raw

# Fixed values used by the cleaning queries.
VALID_LABELS = ["F", "O", "P"]
LABEL_SYNONYMS = {"OPEN": "O", "FILLED": "F"}
SCAN_TABLES = ["orders", "lineitem", "customer", "documents", "events"]
RENAMES = {"qty_sum": "Quantity", "total_price": "Total_Price", "acct_bal": "Account_Balance"}
NUM_RAW = ["qty_txt", "price_txt"]


def _split_sql(col="obs_id"):
    from assay.functions.hashing import sql_uniform
    return sql_uniform(f"cast({col} as string)", "'split'")


# ---------------------------------------------------------------- S
@register("scan_count", " union all ".join(
    f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in SCAN_TABLES))
def scan_count(spark, sf):
    """Row count per table (parquet footers make this metadata-only)."""
    out = None
    for t in SCAN_TABLES:
        d = read_table(spark, sf, t).agg(F.count(F.lit(1)).alias("n_rows")) \
            .select(F.lit(t).alias("table_name"), "n_rows")
        out = d if out is None else out.unionByName(d)
    return out


@register("scan_pruned", "select obs_id, total_price, acct_bal, label from obs", ("obs",))
def scan_pruned(spark, sf):
    """Column-pruned scan; ReadSchema of each parquet scan holds only used columns."""
    return obs(spark, sf).select("obs_id", "total_price", "acct_bal", "label")


@register("csv_by_name", "select c_mktsegment, cast(c_custkey as varchar) as c_custkey from customer")
def csv_by_name(spark, sf):
    """``customer`` as a delimited table, two of its columns read back by name, in another order."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(read_table(spark, sf, "customer"), path)
    return read_delimited(spark, path, ["c_mktsegment", "c_custkey"])


@register("title_case", r"""
select o_orderkey, array_to_string(list_transform(regexp_extract_all(
    lower(o_orderpriority || ' of o''neil b-cell'), '(\p{L}+|[^\p{L}]+)', 1), lambda w: upper(w[1]) || w[2:]), '') as title
from orders""")
def title_of(spark, sf):
    """Title case after every non-letter, on texts of several words."""
    t = F.concat("o_orderpriority", F.lit(" of o'neil b-cell"))
    return read_table(spark, sf, "orders").select("o_orderkey", title_case(t).alias("title"))


@register("sanitize_text", r"""
select obs_id, regexp_replace(nation || ' / ' || priority, '[^\w\-_.]', '_', 'g') as safe_name from obs""",
          ("obs",))
def sanitize_text(spark, sf):
    """Name sanitising applied to values."""
    o = obs(spark, sf)
    return o.select("obs_id", sanitize_value(F.concat_ws(" / ", "nation", "priority")).alias("safe_name"))


# ---------------------------------------------------------------- P
@register("project_required", "select obs_id, qty_sum, total_price, acct_bal, label from obs", ("obs",))
def project_required(spark, sf):
    """P1 + S3: required-column check, then projection."""
    cols = ["obs_id", "qty_sum", "total_price", "acct_bal", "label"]
    return require_columns(obs(spark, sf), cols).select(*cols)


@register("drop_leakage", "select obs_id, qty_sum, total_price, acct_bal, segment, label from obs", ("obs",))
def drop_leakage(spark, sf):
    """Drop excluded columns."""
    return obs(spark, sf).drop("nation", "priority")


@register("rename_columns", """
select obs_id, qty_sum as Quantity, total_price as Total_Price, acct_bal as Account_Balance, label from obs""",
          ("obs",))
def rename_columns(spark, sf):
    """Rename by map."""
    return (obs(spark, sf).select("obs_id", "qty_sum", "total_price", "acct_bal", "label")
            .withColumnsRenamed(RENAMES))


@register("filter_valid_values", "select * from obs_raw where label_txt in ('F', 'O', 'P')", ("obs_raw",))
def filter_valid_values(spark, sf):
    """Keep rows whose target is a valid class."""
    return clean.filter_in(obs_raw(spark, sf), "label_txt", VALID_LABELS)


@register("invalid_values_report", """
select label_txt as value, count(*) as n from obs_raw
where not coalesce(label_txt in ('F', 'O', 'P'), false) group by label_txt""", ("obs_raw",))
def invalid_values_report(spark, sf):
    """Invalid target values with their counts."""
    return clean.invalid_values(obs_raw(spark, sf), "label_txt", VALID_LABELS)


@register("drop_null_rows", """
select * from obs where obs_id is not null and qty_sum is not null and total_price is not null
  and acct_bal is not null and segment is not null and nation is not null and priority is not null
  and label is not null""", ("obs",))
def drop_null_rows(spark, sf):
    """P5: drop rows with any null."""
    return clean.drop_null_rows(obs(spark, sf))


@register("filter_non_negative", "select * from obs where acct_bal >= 0 and total_price >= 0", ("obs",))
def filter_non_negative(spark, sf):
    """Drop negative values."""
    return clean.filter_non_negative(obs(spark, sf), ["acct_bal", "total_price"])


@register("filter_range", "select * from obs where acct_bal between 0 and 5000", ("obs",))
def filter_range(spark, sf):
    """Inclusive range filter."""
    return clean.filter_range(obs(spark, sf), "acct_bal", 0, 5000)


@register("remove_header_rows", """
select * from obs_raw
where not (coalesce(regexp_matches(label_txt, 'label_txt|label', 'i'), false)
        or coalesce(regexp_matches(qty_txt, 'qty|txt', 'i'), false)
        or coalesce(regexp_matches(price_txt, 'price|txt', 'i'), false))""", ("obs_raw",))
def remove_header_rows(spark, sf):
    """Drop header lines repeated inside the data."""
    return clean.remove_header_rows(obs_raw(spark, sf), "label_txt", "label_txt|label", NUM_RAW)


@register("outlier_counts", """
with st as (select quantile_cont(total_price, 0.25) as pq1, quantile_cont(total_price, 0.75) as pq3,
                   quantile_cont(acct_bal, 0.25) as bq1, quantile_cont(acct_bal, 0.75) as bq3 from obs)
select 'total_price' as feature,
       cast(sum(case when total_price < pq1 - 1.5 * (pq3 - pq1) then 1 else 0 end) as bigint) as n_low,
       cast(sum(case when total_price > pq3 + 1.5 * (pq3 - pq1) then 1 else 0 end) as bigint) as n_high
from obs cross join st
union all
select 'acct_bal',
       cast(sum(case when acct_bal < bq1 - 1.5 * (bq3 - bq1) then 1 else 0 end) as bigint),
       cast(sum(case when acct_bal > bq3 + 1.5 * (bq3 - bq1) then 1 else 0 end) as bigint)
from obs cross join st""", ("obs",))
def outlier_counts(spark, sf):
    """Rows outside the 1.5-IQR fences, counted before capping, one pass."""
    o = obs(spark, sf)
    cols = ["total_price", "acct_bal"]
    j = attach(o, clean.fit_iqr(o, cols))
    aggs = []
    for c in cols:
        q1, q3 = F.col(f"{c}__q1"), F.col(f"{c}__q3")
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        aggs += [F.sum(F.when(F.col(c) < lo, 1).otherwise(0)).cast("bigint").alias(f"{c}__low"),
                 F.sum(F.when(F.col(c) > hi, 1).otherwise(0)).cast("bigint").alias(f"{c}__high")]
    stack = ", ".join(f"'{c}', `{c}__low`, `{c}__high`" for c in cols)
    return j.agg(*aggs).selectExpr(f"stack({len(cols)}, {stack}) as (feature, n_low, n_high)")


@register("drop_singleton_classes", """
select * from obs_raw where label_txt in (select label_txt from obs_raw group by label_txt having count(*) >= 2)""",
          ("obs_raw",))
def drop_singleton_classes(spark, sf):
    """Left-semi join on classes with >= 2 rows."""
    return clean.drop_singleton_classes(obs_raw(spark, sf), "label_txt")


_NUMDET_SQL = " union all ".join(
    f"""select '{c}' as feature, round(count(case when regexp_matches(s, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')
         then 1 end) / count(*), 6) as parse_ratio,
       count(case when regexp_matches(s, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') then 1 end) / count(*) >= 0.7 as is_numeric
from (select case when trim(regexp_replace(coalesce({c}, ''), '[,()<>=]|nan|NaN', '', 'g')) = '' then '0'
             else trim(regexp_replace(coalesce({c}, ''), '[,()<>=]|nan|NaN', '', 'g')) end as s from obs_raw) t"""
    for c in ["qty_txt", "price_txt", "segment_txt", "label_txt"])


@register("numeric_detection", _NUMDET_SQL, ("obs_raw",))
def numeric_detection(spark, sf):
    """Parse ratio after symbol stripping, one pass over all columns."""
    d = clean.numeric_detection(obs_raw(spark, sf), ["qty_txt", "price_txt", "segment_txt", "label_txt"])
    return d.select("feature", r6("parse_ratio").alias("parse_ratio"), "is_numeric")


# ---------------------------------------------------------------- C
_NUM_RE = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


def _sql_parse(x):
    return f"case when regexp_matches(trim({x}), {_NUM_RE}) then cast(trim({x}) as double) end"


def _sql_strip(x):
    s = f"trim(regexp_replace(coalesce({x}, ''), '[,()<>=]|nan|NaN', '', 'g'))"
    return f"case when {s} = '' then '0' else {s} end"


@register("coerce_numeric", f"""
select obs_id, {_sql_parse('qty_txt')} as qty, {_sql_parse('price_txt')} as price from obs_raw""", ("obs_raw",))
def coerce_numeric(spark, sf):
    """Text -> number, bad -> null."""
    r = obs_raw(spark, sf)
    return r.select("obs_id", parse_number(F.col("qty_txt")).alias("qty"),
                    parse_number(F.col("price_txt")).alias("price"))


@register("coerce_null_counts", " union all ".join(
    f"""select '{c}' as feature, count({c}) as n_text,
       cast(sum(case when {c} is not null and ({_sql_parse(c)}) is null then 1 else 0 end) as bigint) as n_nulls_created
from obs_raw""" for c in NUM_RAW), ("obs_raw",))
def coerce_null_counts(spark, sf):
    """Nulls created by coercion, per column."""
    return clean.coerce_null_counts(obs_raw(spark, sf), NUM_RAW)


@register("strip_numeric_symbols", f"""
select obs_id, {_sql_parse(_sql_strip('qty_txt'))} as qty, {_sql_parse(_sql_strip('price_txt'))} as price
from obs_raw""", ("obs_raw",))
def strip_numeric_symbols_q(spark, sf):
    """Strip symbols, empty -> 0, then coerce."""
    r = obs_raw(spark, sf)
    return r.select("obs_id", parse_number(strip_numeric_symbols(F.col("qty_txt"))).alias("qty"),
                    parse_number(strip_numeric_symbols(F.col("price_txt"))).alias("price"))


_SQL_TITLE = ("case when t in ('Nan', 'None', 'null', '') then 'Unknown' else t end")


@register("normalize_text", f"""
select obs_id, upper(trim(coalesce(label_txt, 'nan'))) as label_norm,
       {_SQL_TITLE} as segment_norm
from (select obs_id, label_txt,
        upper(substr(trim(coalesce(segment_txt, 'nan')), 1, 1)) || lower(substr(trim(coalesce(segment_txt, 'nan')), 2)) as t
      from obs_raw) x""", ("obs_raw",))
def normalize_text(spark, sf):
    """C3 + C9: trim/upper the target; trim/title-case categories, null tokens -> Unknown."""
    r = obs_raw(spark, sf)
    return r.select("obs_id", normalize_target(F.col("label_txt")).alias("label_norm"),
                    normalize_category(F.col("segment_txt")).alias("segment_norm"))


_SQL_CONSOL = """case upper(trim(coalesce(label_txt, 'nan'))) when 'OPEN' then 'O' when 'FILLED' then 'F'
       else upper(trim(coalesce(label_txt, 'nan'))) end"""


@register("consolidate_values", f"select obs_id, {_SQL_CONSOL} as label from obs_raw", ("obs_raw",))
def consolidate_values(spark, sf):
    """C4: synonym consolidation after C3."""
    r = obs_raw(spark, sf)
    return r.select("obs_id", clean.consolidate(normalize_target(F.col("label_txt")), LABEL_SYNONYMS).alias("label"))


@register("merge_rare_classes", f"""
with c as (select obs_id, {_SQL_CONSOL} as label from obs_raw),
cnt as (select label, count(*) as n from c group by label),
tot as (select sum(n) as total, (select label from cnt order by n desc, label limit 1) as top from cnt)
select c.obs_id, case when cnt.n < greatest(3, cast(floor(tot.total * 0.01) as bigint)) then tot.top else c.label end as label
from c join cnt on c.label = cnt.label cross join tot""", ("obs_raw",))
def merge_rare_classes(spark, sf):
    """Classes under max(3, 1 % of rows) merge into the commonest."""
    r = obs_raw(spark, sf)
    c = r.select("obs_id", clean.consolidate(normalize_target(F.col("label_txt")), LABEL_SYNONYMS).alias("label"))
    return clean.merge_rare_classes(c, "label")


@register("topk_other", """
with cnt as (select nation, count(*) as n from obs group by nation),
rk as (select nation, row_number() over (order by n desc, nation) as rk, count(*) over () as levels from cnt)
select obs_id, case when levels <= 10 or rk <= 8 then obs.nation else 'Other' end as nation
from obs join rk on obs.nation = rk.nation""", ("obs",))
def topk_other(spark, sf):
    """Top-8 nations, the rest -> Other."""
    return clean.top_k_or_other(obs(spark, sf).select("obs_id", "nation"), "nation")


@register("impute_median", """
select obs_id, coalesce(qty_sum, (select quantile_cont(qty_sum, 0.5) from obs)) as qty_sum from obs""", ("obs",))
def impute_median(spark, sf):
    """Median fill."""
    return clean.impute_median(obs(spark, sf).select("obs_id", "qty_sum"), ["qty_sum"])


@register("impute_mode", """
with m as (select segment_txt as v, count(*) as n from obs_raw where segment_txt is not null
           group by segment_txt order by n desc, v limit 1)
select obs_id, coalesce(segment_txt, coalesce((select v from m), 'Unknown')) as segment_txt from obs_raw""",
          ("obs_raw",))
def impute_mode(spark, sf):
    """Mode fill, ties to the smallest value."""
    return clean.impute_mode(obs_raw(spark, sf).select("obs_id", "segment_txt"), ["segment_txt"])


@register("iqr_cap", """
with st as (select quantile_cont(total_price, 0.25) as pq1, quantile_cont(total_price, 0.75) as pq3,
                   quantile_cont(acct_bal, 0.25) as bq1, quantile_cont(acct_bal, 0.75) as bq3 from obs)
select obs_id,
  round(case when total_price is not null then least(greatest(total_price, pq1 - 1.5 * (pq3 - pq1)), pq3 + 1.5 * (pq3 - pq1)) end, 6) as total_price,
  round(case when acct_bal is not null then least(greatest(acct_bal, bq1 - 1.5 * (bq3 - bq1)), bq3 + 1.5 * (bq3 - bq1)) end, 6) as acct_bal
from obs cross join st""", ("obs",))
def iqr_cap(spark, sf):
    """Winsorise at 1.5 IQR."""
    d = clean.iqr_cap(obs(spark, sf).select("obs_id", "total_price", "acct_bal"), ["total_price", "acct_bal"])
    return d.select("obs_id", r6("total_price").alias("total_price"), r6("acct_bal").alias("acct_bal"))


@register("iqr_cap_guarded", """
with st as (select quantile_cont(qty_sum, 0.25) as a1, quantile_cont(qty_sum, 0.75) as a3,
                   quantile_cont(total_price, 0.25) as b1, quantile_cont(total_price, 0.75) as b3 from obs)
select obs_id,
  round(case when a3 - a1 > 0 then (case when qty_sum is not null then least(greatest(qty_sum, a1 - 2.0 * (a3 - a1)), a3 + 2.0 * (a3 - a1)) end) else qty_sum end, 6) as qty_sum,
  round(case when b3 - b1 > 0 then (case when total_price is not null then least(greatest(total_price, b1 - 2.0 * (b3 - b1)), b3 + 2.0 * (b3 - b1)) end) else total_price end, 6) as total_price
from obs cross join st""", ("obs",))
def iqr_cap_guarded(spark, sf):
    """k = 2, skipped when IQR = 0."""
    d = clean.iqr_cap(obs(spark, sf).select("obs_id", "qty_sum", "total_price"), ["qty_sum", "total_price"],
                      k=2.0, guard_zero_iqr=True)
    return d.select("obs_id", r6("qty_sum").alias("qty_sum"), r6("total_price").alias("total_price"))


@register("impute_regression")
def impute_regression(spark, sf):
    """C11: regression imputation of qty_sum from price and balance (rows-only check)."""
    o = obs(spark, sf).select("obs_id", "qty_sum", "total_price", "acct_bal")
    return clean.impute_regression(o, ["qty_sum", "total_price", "acct_bal"])

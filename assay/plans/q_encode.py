"""Queries for encoders (E*, S9, J1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.text import sanitize_name
from assay.operators import encode as en
from assay.plans.registry import register
from assay.sources.views import obs

# Code maps used by E1 (ternary -1/0/1 and ordinal 0/0.5/1/2).
SEGMENT_CODES = {"AUTOMOBILE": -1, "BUILDING": 0, "FURNITURE": 1}
PRIORITY_ORDINAL = {"1-URGENT": 2.0, "2-HIGH": 1.0, "3-MEDIUM": 0.5, "4-NOT SPECIFIED": 0.0}
PRIORITY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("encode_fixed", """
select obs_id, case segment when 'AUTOMOBILE' then -1 when 'BUILDING' then 0 when 'FURNITURE' then 1 end as segment_code
from obs""", ("obs",))
def encode_fixed(spark, sf):
    """Fixed -1/0/1 map, unmapped -> null."""
    return obs(spark, sf).select("obs_id", en.encode_fixed(F.col("segment"), SEGMENT_CODES).alias("segment_code"))


@register("encode_ordinal", """
select obs_id, case priority when '1-URGENT' then 2.0 when '2-HIGH' then 1.0 when '3-MEDIUM' then 0.5
  when '4-NOT SPECIFIED' then 0.0 end::double as priority_score from obs""", ("obs",))
def encode_ordinal(spark, sf):
    """Ordinal 0/0.5/1/2 map."""
    return obs(spark, sf).select("obs_id", en.encode_fixed(F.col("priority"), PRIORITY_ORDINAL).alias("priority_score"))


@register("encode_first_seen", """
with m as (select nation as value, row_number() over (order by min(obs_id)) - 1 as code from obs group by nation)
select obs_id, nation, cast(code as bigint) as nation_code from obs join m on obs.nation = m.value""", ("obs",))
def encode_first_seen(spark, sf):
    """E2 + J1: first-appearance codes, joined back."""
    o = obs(spark, sf).select("obs_id", "nation")
    return en.apply_code_map(o, "nation", en.first_seen_map(o, "nation", "obs_id"), "nation_code")


@register("code_map", """
select value, cast(row_number() over (order by value) - 1 as bigint) as code
from (select distinct label as value from obs) t""", ("obs",))
def code_map(spark, sf):
    """The label code map as a table."""
    return en.sorted_code_map(obs(spark, sf), "label").select("value", "code")


@register("encode_label", """
with m as (select value, row_number() over (order by value) - 1 as code from (select distinct label as value from obs) t)
select obs_id, cast(code as bigint) as label_code from obs join m on obs.label = m.value""", ("obs",))
def encode_label(spark, sf):
    """Sorted label codes."""
    o = obs(spark, sf).select("obs_id", "label")
    return en.apply_code_map(o, "label", en.sorted_code_map(o, "label"), "label_code").select("obs_id", "label_code")


@register("decode_label", """
with m as (select value, row_number() over (order by value) - 1 as code from (select distinct label as value from obs) t),
c as (select obs_id, code from obs join m on obs.label = m.value)
select obs_id, (c.code + 1) % 3 as shifted_code, m.value as decoded
from c join m on (c.code + 1) % 3 = m.code""", ("obs",))
def decode_label(spark, sf):
    """Decode codes back to labels (codes shifted to make the decode visible)."""
    o = obs(spark, sf).select("obs_id", "label")
    m = en.sorted_code_map(o, "label")
    c = en.apply_code_map(o, "label", m, "code")
    c = c.select("obs_id", ((F.col("code") + 1) % 3).alias("shifted_code"))
    return en.decode(c, "shifted_code", m, "decoded")


_ONE_HOT_SQL = "select obs_id, priority, " + ", ".join(
    f"coalesce(cast(priority = '{lv}' as int), 0) as \"{sanitize_name('priority_' + lv)}\""
    for lv in PRIORITY_LEVELS[1:]) + " from obs"


@register("one_hot", _ONE_HOT_SQL, ("obs",))
def one_hot(spark, sf):
    """E5: one-hot with the first level dropped."""
    o = obs(spark, sf).select("obs_id", "priority")
    return en.one_hot(o, "priority", en.fit_one_hot(o, "priority"))

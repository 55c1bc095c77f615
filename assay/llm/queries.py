"""The llm queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assay.llm import langid
from assay.llm import merkle
from assay.llm import rules
from assay.llm import urls
from assay.llm.common import remainder, scratch, table
from assay.llm.decontam import find_leaks
from assay.llm.exact import deduplicate, open_index
from assay.llm.html import extract_main_text
from assay.llm.importance import importance_resample
from assay.llm.neardup import near_duplicates
from assay.llm.packing import pack_documents
from assay.llm.periodic import periodic_runs
from assay.llm.tokens import token_counts
from assay.llm.toxicity import score_toxicity
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


@_query("op2_pack")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@_query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@_query("op1_importance")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return importance_resample(table(spark, sf_dir, "documents"), good)


@_query("op3_main_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@_query("op6_langid")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out), "doc_id")
    return langid.predict(docs, model).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


#: Rules of the URL query: the longest that fits decides.
URL_RULES = (urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"),
             urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"))
#: Host names whose pages make up the list of the URL query.
LISTED_HOSTS = ("casino-win", "ads-track", "spam-farm", "adult-x", "cheap-pills", "free-bets")


@_query("op7_url_filter", """
with p as (
  select page_id, coalesce(url, '') as url from pages
), h as (
  select page_id,
    translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      as host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from p
), c as (
  select *, regexp_replace(host, '^(www|m|blog)\\.', '') as bare,
    case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from h
), k as (
  select *, case when bare <> '' then bare || regexp_replace(path, '(\\.html)?/*$', '') end as canonical from c
), listed as (
  select distinct canonical from k
  where split_part(bare, '.', 1) in ('casino-win', 'ads-track', 'spam-farm', 'adult-x', 'cheap-pills', 'free-bets')
)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
       when k.canonical in (select canonical from listed) then 'block' else 'allow' end as verdict
from k
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    name = urls.canonical(urls.host_of(F.col("url")), urls.path_of(F.col("url")))
    listed = pages.select(name.alias("url")).where(F.substring_index("url", ".", 1).isin(*LISTED_HOSTS))
    return urls.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@_query("op10_quality_rules", """
with w as (
  select doc_id, lang, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents
), win as (
  select doc_id, i, [words[i], words[i + 1], words[i + 2]] as g
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n >= 2
), rep as (
  select doc_id, count(distinct j) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as j from twice) group by doc_id
), fig as (
  select w.doc_id, lang, len(words) as n_words,
    length(t) - length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, len(lines) as n_lines
  from w left join rep on w.doc_id = rep.doc_id
), f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    n_symbols / greatest(n_words, 1)::double as symbol_ratio,
    n_dup_lines / greatest(n_lines, 1)::double as dup_line_ratio,
    n_repeat_words / greatest(n_words, 1)::double as repeat_ratio,
    word_chars / greatest(n_words, 1)::double as mean_word_chars
  from fig
), grid as (
  select 'symbol_ratio' as rule, unnest([0.05, 0.1, 0.2, 0.4, 0.8, 1.6])::double as cutoff
  union all select 'dup_line_ratio', unnest([0.05, 0.1, 0.2, 0.3, 0.5, 0.7])::double
  union all select 'repeat_ratio', unnest([0.05, 0.1, 0.15, 0.2, 0.3, 0.4])::double
  union all select 'mean_word_chars', unnest([6, 7, 8, 10, 12, 16])::double
), good as (
  select f.* from f where not base_failed
    and doc_id in (select doc_id from labels group by doc_id having min(quality) = 1)
), tested as (
  select lang, rule, cutoff, count(*) as n,
    sum(case when case rule when 'symbol_ratio' then symbol_ratio when 'dup_line_ratio' then dup_line_ratio
                  when 'repeat_ratio' then repeat_ratio else mean_word_chars end > cutoff then 1 else 0 end)::bigint as k
  from good cross join grid group by lang, rule, cutoff
), p as (
  select lang, rule, cutoff, case when k < n * 0.01 then (
      select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))
      from (select unnest(range(k + 1)) as i)) else 1 end as p_value
  from tested
), chosen as (
  select lang, rule, min(cutoff) as cutoff from p
  where p_value <= 0.05 / greatest(24 * (select count(distinct coalesce(lang, '')) from good), 1) group by lang, rule
), cut as (
  select lang, min(cutoff) filter (rule = 'symbol_ratio') as c1, min(cutoff) filter (rule = 'dup_line_ratio') as c2,
    min(cutoff) filter (rule = 'repeat_ratio') as c3, min(cutoff) filter (rule = 'mean_word_chars') as c4
  from chosen group by lang
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  case when symbol_ratio > c1 then 'symbol_ratio' when dup_line_ratio > c2 then 'dup_line_ratio'
       when repeat_ratio > c3 then 'repeat_ratio' when mean_word_chars > c4 then 'mean_word_chars' end as rule,
  not base_failed and not coalesce(symbol_ratio > c1, false) and not coalesce(dup_line_ratio > c2, false)
    and not coalesce(repeat_ratio > c3, false) and not coalesce(mean_word_chars > c4, false) as kept
from f left join cut on f.lang is not distinct from cut.lang
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return rules.judge(table(spark, sf_dir, "documents"), labels)


@_query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 3) == 1
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    return score_toxicity(table(spark, sf_dir, "documents"), labels).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "hits", "hit_density", "near_you")


@_query("op8_neardup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, pct=80)


@_query("op9_decontam")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op12_exact_dedup", """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each run starts an empty index, so that its figures are those of a first load
    name = f"digest_index_{uuid.uuid4().hex}"
    index = open_index(spark, name, int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(spark, name))
    return deduplicate(table(spark, sf_dir, "documents"), index, "first").select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """The input that the contract of operator 13 states: every tenth document (by its key's crc32) repeats a stretch of
    its words from word ``a`` on; all other texts as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    chosen = docs.select("doc_id", "text", h.alias("h"), g.alias("g")).select(
        "doc_id", "text", "g", F.when(F.col("h") % 10 == 0, words).alias("w"))
    n = F.size("w")
    a = F.col("g") % n
    p = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    placed = chosen.select("*", F.when(n > 0, a).alias("a")).select("*", p.alias("p"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(
        F.col("text")).alias("text"))


@_query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted_runs(table(spark, sf_dir, "documents")))
    # the greatest length, then the smallest start and period
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("order"), r["start"], r["period"]))), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("best.order")
    return out.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"),
                      F.col("best.period").alias("period"),
                      F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")


MERKLE_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _merkle_sql(levels: int = 6, fan: int = merkle.FAN) -> str:
    """The trees level by level: enough levels for ``fan ** levels`` documents a source, and as many sources."""
    def enc(c):
        return f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"

    def leaf(text):
        return "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + enc(text) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # The reflected CRC-32 polynomial, and all bits set
    bit = "list_reduce([x] || [0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)"
    byte = bit.replace("[x]", "[xor(acc, b)]")
    crc = (f"xor(list_reduce([4294967295] || [ascii(ch)::bigint for ch in string_split(doc_id::varchar, '')], "
           f"lambda acc, b: {byte}), 4294967295)")
    ctes = [f"""r as (
  select doc_id, source, {leaf('text')} as leaf, case when {crc} % 5 = 0 then {leaf(lowered)} else {leaf('text')} end as claim
  from documents)""", """n0 as (
  select coalesce('1' || source, '0') as tree, row_number() over (partition by source order by doc_id) - 1 as idx,
    count(*) over (partition by source) as cnt, leaf as h, doc_id, claim from r)"""]

    def climb(prefix, first):
        for k in range(levels):
            here = first if k == 0 else f"{prefix}{k}"
            ctes.append(f"""{prefix}run{k} as (
  select tree, idx // {fan} as idx, any_value(cnt) as cnt, list(h order by idx) as hs from {here} group by tree, idx // {fan})""")
            ctes.append(f"""{prefix}{k + 1} as (
  select tree, idx, (cnt + {fan - 1}) // {fan} as cnt, case when cnt > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h
  from {prefix}run{k})""")
    climb("s", "n0")
    ctes.append(f"""subs as (
  select '' as tree, tree as source_tree, row_number() over (order by tree) - 1 as idx, count(*) over () as cnt, h from s{levels})""")
    climb("t", "subs")
    prev = "p0"
    ctes.append("""p0 as (
  select n.doc_id, n.h as leaf, n.tree, n.idx as i, s.idx as place, s.h as subroot, n.claim as f, '' as proof
  from n0 n join subs s on n.tree = s.source_tree)""")
    for kind, at in (("s", "p.i"), ("t", "p.place")):
        for k in range(levels):
            own = f"({at} // {fan ** k}) % {fan} + 1"
            on = "r.tree = p.tree" if kind == "s" else "true"
            name = f"p{kind}{k}"
            ctes.append(f"""{name} as (
  select p.doc_id, p.leaf, p.tree, p.i, p.place, p.subroot,
    case when r.cnt > 1 then sha256(array_to_string(list_transform(r.hs, lambda x, j: case when j = {own} then p.f else x end), ''))
         else p.f end as f,
    p.proof || case when r.cnt > 1 then array_to_string(r.hs[1:{own} - 1] || r.hs[{own} + 1:], '') else '' end as proof
  from {prev} p join {kind}run{k} r on {on} and r.idx = {at} // {fan ** (k + 1)})""")
            prev = name
    return ("with " + ", ".join(ctes) + f"""
select p.doc_id, p.leaf, p.subroot, t.h as root, sha256(p.proof) as proof_sha256, p.f as folded_root, p.f = t.h as verified
from {prev} p cross join t{levels} t""")


@_query("op11_merkle", _merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", urls.UPPER, urls.LOWER)
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                   merkle.digest([F.col(c) for c in MERKLE_COLUMNS[:-1]] + [lowered]))
    manifest = merkle.build(table(spark, sf_dir, "documents"), "doc_id", "source", MERKLE_COLUMNS, claim)
    return merkle.prove(manifest).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256",
                                         "folded_root", "verified")

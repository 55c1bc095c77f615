"""Base views over the driver tables, in Spark and as DuckDB SQL text.

``obs`` plays the role of the patient table (numeric columns with nulls,
categoricals and a three-class target), ``obs_raw`` is its text form with the
defects a raw export has, ``pred`` / ``scores`` are deterministic rule-based
predictions used to exercise the evaluation operators without a model, and
``doc_obs`` is an imbalanced binary table.  Every view is derived from the
given tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.hashing import hex4, sql_hex4, sql_uniform, uniform
from assay.sources.tables import read_table

# Fixed values of the rule-based scorers: model -> bonus added to the score of
# the true class F, O, P.  Scores are hex4(obs_id|model|class) % 1000 + 1.
RULE_MODELS = {
    "rule_a": (300, 150, 0),
    "rule_b": (250, 200, 50),
    "rule_c": (150, 100, 100),
    "rule_d": (100, 50, 150),
    "rule_e": (200, 0, 100),
}
CLASSES = ("F", "O", "P")
TEST_FRACTION = 0.2
N_FOLDS = 5


def obs(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    q = (read_table(spark, sf, "lineitem").groupBy("l_orderkey")
         .agg(F.sum("l_quantity").alias("qty_sum")))
    # the aggregate has a row per order, so it is joined by its own partitioning and never broadcast: whatever the files
    # of orders, the rows then lie spread over the shuffle partitions for the per-row work that follows
    j = (o.join(q.hint("merge"), o.o_orderkey == q.l_orderkey, "left")
         .join(c, o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey))
    return j.select(
        F.col("o_orderkey").alias("obs_id"), F.col("qty_sum"),
        F.col("o_totalprice").alias("total_price"), F.col("c_acctbal").alias("acct_bal"),
        F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("label"))


def obs_raw(spark: SparkSession, sf: str) -> DataFrame:
    b = obs(spark, sf)
    i = F.col("obs_id")
    qty = F.floor("qty_sum").cast("bigint").cast("string")
    price = F.floor("total_price").cast("bigint").cast("string")
    return b.select(
        "obs_id",
        F.when(i % 97 == 0, "qty_sum").when(i % 31 == 0, "").when(i % 29 == 0, "n/a")
         .when(i % 23 == 0, F.concat(F.lit(">"), qty)).otherwise(qty).alias("qty_txt"),
        F.when(i % 97 == 0, "total_price")
         .when(i % 19 == 0, F.concat(F.lit("("), price, F.lit(")"))).otherwise(price).alias("price_txt"),
        F.when(i % 13 == 0, F.lit(None).cast("string"))
         .when(i % 11 == 0, F.concat(F.lit("  "), F.lower("segment"), F.lit(" ")))
         .when(i % 211 == 0, "none").otherwise(F.col("segment")).alias("segment_txt"),
        F.when(i % 97 == 0, "Label").when(i % 41 == 0, "open").when(i % 43 == 0, "Filled")
         .when(i % 1009 == 0, "X").otherwise(F.col("label")).alias("label_txt"))


def pred(spark: SparkSession, sf: str) -> DataFrame:
    b = obs(spark, sf)
    sf_ = (hex4(F.col("obs_id"), "F") % 1000 + F.when(F.col("label") == "F", 300).otherwise(0)).cast("bigint")
    so_ = (hex4(F.col("obs_id"), "O") % 1000 + F.when(F.col("label") == "O", 150).otherwise(0)).cast("bigint")
    sp_ = (hex4(F.col("obs_id"), "P") % 1000).cast("bigint")
    t = b.select("obs_id", "label", sf_.alias("s_f"), so_.alias("s_o"), sp_.alias("s_p"))
    return t.select("*", F.when((F.col("s_f") >= F.col("s_o")) & (F.col("s_f") >= F.col("s_p")), "F")
                    .when(F.col("s_o") >= F.col("s_p"), "O").otherwise("P").alias("pred"))


def doc_obs(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels")
    j = d.join(lab, "doc_id")
    return j.select(
        "doc_id", "n_chars",
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))).cast("bigint")
        .alias("n_spaces"),
        "lang", "source", "quality", F.col("toxic").alias("label"))


def scores_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (observation, rule model) with class probabilities ``p_F, p_O, p_P``.

    Built by a narrow explode of the model list; no shuffle beyond ``obs``.
    The split and fold come from the row hash.
    """
    b = obs(spark, sf).select("obs_id", "label")
    models = [F.struct(F.lit(m).alias("model"), *[F.lit(bonus[k]).alias(f"b_{c}")
                                                  for k, c in enumerate(CLASSES)])
              for m, bonus in RULE_MODELS.items()]
    x = b.select("obs_id", "label", F.explode(F.array(*models)).alias("m"))
    s = {c: (hex4(F.col("obs_id"), F.col("m.model"), F.lit(c)) % 1000 + 1
             + F.when(F.col("label") == c, F.col(f"m.b_{c}")).otherwise(0)).cast("double")
         for c in CLASSES}
    tot = s["F"] + s["O"] + s["P"]
    u = uniform(F.col("obs_id"), "split")
    return x.select(
        "obs_id", "label",
        F.when(u < TEST_FRACTION, "test").otherwise("train").alias("split"),
        F.floor(uniform(F.col("obs_id"), "fold") * N_FOLDS).cast("bigint").alias("fold"),
        F.col("m.model").alias("model"),
        *[(s[c] / tot).alias(f"p_{c}") for c in CLASSES])


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Long probability table ``(obs_id, label, split, fold, model, cls, p)``."""
    w = scores_wide(spark, sf)
    arr = F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"p_{c}").alias("p")) for c in CLASSES])
    return (w.select("obs_id", "label", "split", "fold", "model", F.explode(arr).alias("e"))
            .select("obs_id", "label", "split", "fold", "model", "e.cls", "e.p"))


def model_preds(spark: SparkSession, sf: str) -> DataFrame:
    """Arg-max class per (obs_id, model); ties go to the smaller class name."""
    w = scores_wide(spark, sf)
    pf, po, pp = F.col("p_F"), F.col("p_O"), F.col("p_P")
    pred_ = F.when((pf >= po) & (pf >= pp), "F").when(po >= pp, "O").otherwise("P")
    return w.select("obs_id", "label", "split", "fold", "model", pred_.alias("pred"),
                    F.greatest(pf, po, pp).alias("confidence"))


# ---------------------------------------------------------------- SQL text
SQL_VIEWS: dict[str, str] = {}

SQL_VIEWS["obs"] = """
select o_orderkey as obs_id, l.qty_sum as qty_sum, o_totalprice as total_price, c_acctbal as acct_bal,
       c_mktsegment as segment, n_name as nation, o_orderpriority as priority, o_orderstatus as label
from orders
join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey
left join (select l_orderkey, sum(l_quantity) as qty_sum from lineitem group by l_orderkey) l
  on l.l_orderkey = o_orderkey"""

SQL_VIEWS["obs_raw"] = """
select obs_id,
  case when obs_id % 97 = 0 then 'qty_sum' when obs_id % 31 = 0 then '' when obs_id % 29 = 0 then 'n/a'
       when obs_id % 23 = 0 then '>' || cast(cast(floor(qty_sum) as bigint) as string)
       else cast(cast(floor(qty_sum) as bigint) as string) end as qty_txt,
  case when obs_id % 97 = 0 then 'total_price'
       when obs_id % 19 = 0 then '(' || cast(cast(floor(total_price) as bigint) as string) || ')'
       else cast(cast(floor(total_price) as bigint) as string) end as price_txt,
  case when obs_id % 13 = 0 then null when obs_id % 11 = 0 then '  ' || lower(segment) || ' '
       when obs_id % 211 = 0 then 'none' else segment end as segment_txt,
  case when obs_id % 97 = 0 then 'Label' when obs_id % 41 = 0 then 'open' when obs_id % 43 = 0 then 'Filled'
       when obs_id % 1009 = 0 then 'X' else label end as label_txt
from obs"""

SQL_VIEWS["pred"] = f"""
select obs_id, label, s_f, s_o, s_p,
  case when s_f >= s_o and s_f >= s_p then 'F' when s_o >= s_p then 'O' else 'P' end as pred
from (select obs_id, label,
  cast({sql_hex4("cast(obs_id as string)", "'F'")} % 1000 + case when label = 'F' then 300 else 0 end as bigint) as s_f,
  cast({sql_hex4("cast(obs_id as string)", "'O'")} % 1000 + case when label = 'O' then 150 else 0 end as bigint) as s_o,
  cast({sql_hex4("cast(obs_id as string)", "'P'")} % 1000 as bigint) as s_p from obs) t"""

SQL_VIEWS["doc_obs"] = """
select d.doc_id, n_chars, cast(length(text) - length(replace(text, ' ', '')) as bigint) as n_spaces,
       lang, source, quality, toxic as label
from documents d join labels l on d.doc_id = l.doc_id"""

_rm_rows = ", ".join(f"('{m}', '{c}', {b[k]})" for m, b in RULE_MODELS.items()
                     for k, c in enumerate(CLASSES))
SQL_VIEWS["scores"] = f"""
select obs_id, label, split, fold, model, cls, s / sum(s) over (partition by obs_id, model) as p
from (select obs_id, label,
        case when {sql_uniform("cast(obs_id as string)", "'split'")} < {TEST_FRACTION} then 'test' else 'train' end as split,
        cast(floor({sql_uniform("cast(obs_id as string)", "'fold'")} * {N_FOLDS}) as bigint) as fold,
        model, cls,
        cast({sql_hex4("cast(obs_id as string)", "model", "cls")} % 1000 + 1
             + case when label = cls then bonus else 0 end as double) as s
      from obs cross join (values {_rm_rows}) m(model, cls, bonus)) t"""

SQL_VIEWS["model_preds"] = """
select obs_id, label, split, fold, model, pred, confidence from (
  select obs_id, label, split, fold, model, cls as pred, p as confidence,
         row_number() over (partition by obs_id, model order by p desc, cls) as rk
  from scores) t where rk = 1"""

_DEPS = {"obs": [], "obs_raw": ["obs"], "pred": ["obs"], "doc_obs": [],
         "scores": ["obs"], "model_preds": ["obs", "scores"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with a WITH clause defining ``names`` and their inputs."""
    order: list[str] = []

    def add(n):
        for d in _DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} as ({SQL_VIEWS[n]})" for n in order)
    body = sql.lstrip()
    if body[:4].lower() == "with" and body[4:5].isspace():
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


SPARK_VIEWS = {"obs": obs, "obs_raw": obs_raw, "pred": pred, "doc_obs": doc_obs,
               "scores": scores, "scores_wide": scores_wide,
               "model_preds": model_preds}

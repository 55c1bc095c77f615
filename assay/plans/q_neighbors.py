"""Queries for k-NN, naive Bayes and neighbour-based resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.hashing import sql_hash60
from assay.functions.stats import r6
from assay.operators import neighbors as nb
from assay.operators import sampling as sa
from assay.plans.registry import register
from assay.sources.tables import read_table

SEED = 42
K = 7


def emb(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"),
                                                      F.col("embedding").alias("vec"), "label")


def emb_split(spark, sf):
    return sa.split_stratified(emb(spark, sf), "label", "id", 0.2, SEED)


SQL_ESPLIT = f"""esplit as (
  select vec_id, embedding::double[] as vec, label,
         case when row_number() over (partition by label order by {sql_hash60('cast(vec_id as string)', f"'{SEED}'")}, vec_id) - 1
                   < ceil(count(*) over (partition by label) * 0.2) then 'test' else 'train' end as split
  from embeddings)"""


_KNN_SQL = f"""
select vec_id, neighbor_id, rank, round(distance, 6) as distance from (
  select a.vec_id, b.vec_id as neighbor_id, list_distance(a.embedding::double[], b.embedding::double[]) as distance,
         row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as rank
  from embeddings a join embeddings b on a.vec_id <> b.vec_id) t where rank <= {K}"""


@register("knn_join", _KNN_SQL)
def knn_join(spark, sf):
    """Exact 7 nearest neighbours of every vector (blocked cogroup, top-k per block; an index beyond a few blocks)."""
    e = emb(spark, sf)
    nn = nb.knn(e.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")),
                e.select(F.col("id").alias("rid"), F.col("vec").alias("rvec")), K, exclude_self=True)
    return nn.select(F.col("qid").alias("vec_id"), F.col("rid").alias("neighbor_id"),
                     F.col("rank").cast("bigint").alias("rank"), r6(F.sqrt("dist2")).alias("distance"))


@register("knn_pruned_join", _KNN_SQL)
def knn_pruned_join(spark, sf):
    """J4 scale variant: the same neighbours through the cluster-pruned index, in rings of 64 rows on any table."""
    e = emb(spark, sf)
    nn = nb.knn(e.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")),
                e.select(F.col("id").alias("rid"), F.col("vec").alias("rvec")), K, exclude_self=True, block_rows=64, index_blocks=0)
    return nn.select(F.col("qid").alias("vec_id"), F.col("rid").alias("neighbor_id"),
                     F.col("rank").cast("bigint").alias("rank"), r6(F.sqrt("dist2")).alias("distance"))


@register("knn_classify", f"""with {SQL_ESPLIT},
nn as (select q.vec_id, t.label as nlabel, list_distance(q.vec, t.vec) as d,
              row_number() over (partition by q.vec_id order by list_distance(q.vec, t.vec), t.vec_id) as rk
       from esplit q join esplit t on q.split = 'test' and t.split = 'train'),
k as (select *, max(case when d = 0 then 1 else 0 end) over (partition by vec_id) as anyz from nn where rk <= {K}),
v as (select vec_id, nlabel, sum(case when anyz = 1 then (case when d = 0 then 1.0 else 0.0 end) else 1.0 / d end) as score
      from k group by vec_id, nlabel)
select q.vec_id, q.label, p.pred from esplit q join
  (select vec_id, nlabel as pred from (select *, row_number() over (partition by vec_id order by score desc, nlabel) as r from v) x
   where r = 1) p on q.vec_id = p.vec_id""")
def knn_classify(spark, sf):
    """Distance-weighted 7-NN classifier on a stratified split."""
    s = emb_split(spark, sf)
    test = s.where(F.col("split") == "test")
    p = nb.knn_classify(s.where(F.col("split") == "train"), test.select("id", "vec"), K)
    return test.select(F.col("id").alias("vec_id"), "label").join(p.withColumnRenamed("id", "vec_id"), "vec_id")


@register("naive_bayes", f"""with {SQL_ESPLIT},
lng as (select vec_id, label, split, unnest(range(len(vec))) as dim, unnest(vec) as x from esplit),
eps as (select max(v) * 1e-9 as e from (select dim, var_pop(x) as v from lng where split = 'train' group by dim) t),
st as (select label, dim, avg(x) as mu, var_pop(x) + (select e from eps) as var from lng where split = 'train' group by label, dim),
pr as (select label, ln(count(*) * 1.0 / sum(count(*)) over ()) as lp from esplit where split = 'train' group by label),
sc as (select t.vec_id, st.label, sum(-0.5 * ln(2 * pi() * var) - (x - mu) * (x - mu) / (2 * var)) + pr.lp as score
       from lng t join st on t.dim = st.dim join pr on st.label = pr.label where t.split = 'test'
       group by t.vec_id, st.label, pr.lp)
select e.vec_id, e.label, p.pred from esplit e join
  (select vec_id, label as pred from (select *, row_number() over (partition by vec_id order by score desc, label) as r from sc) x
   where r = 1) p on e.vec_id = p.vec_id""")
def naive_bayes(spark, sf):
    """Gaussian naive Bayes as SQL aggregates (fit on train, score test)."""
    s = emb_split(spark, sf)
    lng = s.select("id", "label", "split", F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "x"))
    model = nb.fit_gaussian_nb(lng.where(F.col("split") == "train"))
    p = nb.predict_gaussian_nb(s.where(F.col("split") == "test"), model)
    return (s.where(F.col("split") == "test").select(F.col("id").alias("vec_id"), "label")
            .join(p.withColumnRenamed("id", "vec_id"), "vec_id"))


@register("adasyn_allocation", """
with nn as (select a.vec_id, a.label, b.label as nl,
                   row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as rk
            from embeddings a join embeddings b on a.vec_id <> b.vec_id),
r as (select vec_id, label, sum(case when nl <> label then 1.0 else 0.0 end) / 5 as r from nn where rk <= 5 group by vec_id, label),
s as (select label, count(*) as n, max(count(*)) over () as t from embeddings group by label),
x as (select r.*, s.n, s.t, case when sum(r) over (partition by r.label) = 0 then null
                               else r / sum(r) over (partition by r.label) end as share
      from r join s on r.label = s.label where s.n < s.t)
select vec_id as id, label, round(r, 6) as r, round(share, 6) as share, round(coalesce(share, 0) * (t - n), 6) as g from x""")
def adasyn_allocation(spark, sf):
    """ADASYN allocation of synthetic points per minority row."""
    a = nb.adasyn_allocation(emb(spark, sf), "label", 5)
    return a.select("id", "label", r6("r").alias("r"), r6("share").alias("share"), r6("g").alias("g"))


@register("adasyn")
def adasyn(spark, sf):
    """ADASYN rows over the embeddings (rows-only; sizes and geometry tested)."""
    s = nb.adasyn(emb(spark, sf), "label", 5, SEED)
    return s.select("id", "label", "synthetic", "base_id", "neighbor_id", r6("gap").alias("gap"))


@register("tomek_links", """
with n1 as (
  select a.vec_id as a, min({'d': list_distance(a.embedding::double[], b.embedding::double[]), 'b': b.vec_id}).b as b
  from embeddings a join embeddings b on a.vec_id <> b.vec_id group by a.vec_id)
select x.a, x.b, la.label as label_a, lb.label as label_b from n1 x join n1 y on x.a = y.b and x.b = y.a
join embeddings la on la.vec_id = x.a join embeddings lb on lb.vec_id = x.b
where x.a < x.b and la.label <> lb.label""")
def tomek_links(spark, sf):
    """Tomek links (mutual nearest neighbours of different class)."""
    return nb.tomek_links(emb(spark, sf), "label")


@register("smote")
def smote(spark, sf):
    """SMOTE to the largest class (rows-only; segment invariant tested)."""
    s = nb.smote(emb(spark, sf), "label", 5, SEED)
    return s.select("id", "label", "synthetic", "base_id", "neighbor_id", "gap",
                    F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@register("smote_sizes", """
with n as (select label, count(*) as n from embeddings group by label), t as (select max(n) as t from n)
select label, false as synthetic, n as rows from n
union all select label, true, t - n from n cross join t where n > 1 and n < t""")
def smote_sizes(spark, sf):
    """Rows per class of the SMOTE result, given and synthetic."""
    return nb.smote(emb(spark, sf), "label", 5, SEED).groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("rows"))


@register("adasyn_sizes", """
with nn as (select a.vec_id, a.label, b.label as nl,
                   row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as rk
            from embeddings a join embeddings b on a.vec_id <> b.vec_id),
r as (select vec_id, label, sum(case when nl <> label then 1.0 else 0.0 end) / 5 as r from nn where rk <= 5 group by vec_id, label),
s as (select label, count(*) as n, max(count(*)) over () as t from embeddings group by label)
select vec_id as base_id, label, cast(round(g) as bigint) as rows from (
  select vec_id, r.label, case when sum(r) over w = 0 then 0 else r / sum(r) over w end * (t - n) as g
  from r join s on r.label = s.label where n < t and n > 1 window w as (partition by r.label)) x
where round(g) > 0""")
def adasyn_sizes(spark, sf):
    """Synthetic rows that each row of a smaller class gets."""
    s = nb.adasyn(emb(spark, sf), "label", 5, SEED).where("synthetic")
    return s.groupBy("base_id", "label").agg(F.count(F.lit(1)).alias("rows"))


@register("knn_lsh_join")
def knn_lsh_join(spark, sf):
    """7 approximate nearest neighbours via random-projection LSH, short queries completed exactly (rows-only).

    The vectors have unit length; a bucket of a quarter is about two standard deviations of their projections."""
    e = emb(spark, sf)
    nn = nb.knn_lsh(e.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")),
                    e.select(F.col("id").alias("rid"), F.col("vec").alias("rvec")), K, bucket_length=0.25)
    return nn.select(F.col("qid").alias("vec_id"), F.col("rid").alias("neighbor_id"),
                     F.col("rank").cast("bigint").alias("rank"), r6(F.sqrt("dist2")).alias("distance"))

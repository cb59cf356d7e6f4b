"""Queries for STA1-STA4."""

from pyspark.sql import functions as F

from ..functions.common import rounded
from ..operators import stats as S
from ..sources import views as V
from ..sources.views import query, rnd

B, N = 200, 200


def _long(s, d):
    r = V.repeats(s, d)
    return r.select("condition", "rep", F.lit("median_r").alias("metric"), F.col("metric").alias("value"))


def _pairs(s, d):
    """Each condition above 1 against condition 1."""
    r = V.repeats(s, d).withColumnRenamed("metric", "value")
    a = r.where("condition > 1").select("condition", F.lit("a").alias("side"), "rep", "value")
    b = r.where("condition = 1").drop("condition").crossJoin(r.where("condition > 1").select("condition").distinct())  # a few rows each
    return a.union(b.select("condition", F.lit("b").alias("side"), "rep", "value"))


def sta1(s, d):
    v = V.repeats(s, d).withColumnRenamed("metric", "value")
    a = S.bootstrap_interval(v, ["condition"], B, 95.0, "mean", 42).withColumn("stat", F.lit("mean"))
    out = a.union(S.bootstrap_interval(v, ["condition"], B, 90.0, "median", 43).withColumn("stat", F.lit("median")))
    return out.select("condition", "stat", rounded("ci_low", 8).alias("ci_low"), rounded("ci_high", 8).alias("ci_high"))


def sta2(s, d):
    p = _pairs(s, d)
    out = S.permutation_test(p, ["condition"], N, "two-sided").withColumn("alternative", F.lit("two-sided"))
    for a in ("greater", "less"):
        out = out.union(S.permutation_test(p, ["condition"], N, a).withColumn("alternative", F.lit(a)))
    return out.withColumn("p_value", rounded("p_value"))


def sta3(s, d):
    """p-values from the orders' prices."""
    t = V.table(s, d, "orders").groupBy((F.col("o_custkey") % 97).alias("test")).agg((F.pmod(F.sum(F.col("o_orderkey")), F.lit(1000)) / 1000.0).alias("p0"))
    t = t.select("test", (F.col("p0") ** 4).alias("p"))
    return S.benjamini_hochberg(t, 0.2).select("test", rounded("p").alias("p"), rounded("q").alias("q"), "reject")


def sta4(s, d):
    out = S.condition_summary(_long(s, d), "median_r", B, N, 0, 95.0, 0.3, 42)
    return out.select("condition", "metric", "n", "reject", *[rounded(c, 8).alias(c) for c in ("mean", "sd", "ci_low", "ci_high", "delta", "p", "q")])


QUERIES = {"STA1_bootstrap_interval": sta1, "STA2_permutation_test": sta2, "STA3_benjamini_hochberg": sta3, "STA4_condition_summary": sta4}


def _key(seed, *parts):
    return f"('0x' || substr(md5('{seed}-' || {" || '-' || ".join(f'({p})::varchar' for p in parts)}), 1, 8))::bigint"


def _boot(seed, agg, low, extra="", name="bt"):
    parts = ["b", "condition"] + (["'median_r'"] if extra else []) + ["k"]
    return f"""{name}d as (select condition, b, {_key(seed, *parts)} % n as i from (select condition, n, b, k from sz, unnest(range(0, {B})) u(b), unnest(range(0, n)) v(k))),
{name} as (select condition, quantile_cont(v, {low}) as ci_low, quantile_cont(v, {1 - low}) as ci_high from
  (select d.condition, b, {agg}(metric) as v from {name}d d join nm on nm.condition = d.condition and nm.i = d.i group by 1, 2) group by 1)"""


_NM = """nm as (select *, row_number() over (partition by condition order by rep) - 1 as i from repeats),
sz as (select condition, count(*) as n from nm group by 1)"""
_PERM = f"""pq as (select condition, 'a' as side, rep, metric from repeats where condition > 1
  union all select c.condition, 'b', rep, metric from repeats r, (select distinct condition from repeats where condition > 1) c where r.condition = 1),
pn as (select *, row_number() over (partition by condition order by side, rep) as i from pq),
ob as (select condition, count(*) filter (where side = 'a') as na, round(avg(metric) filter (where side = 'a') - avg(metric) filter (where side = 'b'), 10) as o from pn group by 1),
pr as (select condition, b, metric, row_number() over (partition by condition, b order by {_key(42, 'b', 'condition', 'i')}, i) as r from pn, unnest(range(0, {N})) u(b)),
pd as (select condition, b, o, round(avg(metric) filter (where r <= na) - avg(metric) filter (where r > na), 10) as d from pr join ob using (condition) group by 1, 2, 3)"""
_BH = """select {k}, {p} as p, min(least(p * m / r, 1.0)) over (order by r desc rows between unbounded preceding and current row) as q
  from (select *, row_number() over (order by p) as r, count(*) over () as m from {t})"""
ORACLE_SQL = {
    "STA1_bootstrap_interval": query("repeats", f""", {_NM}, {_boot(42, 'avg', 0.025, name='ba')}, {_boot(43, 'median', 0.05, name='bb')}
select condition, 'mean' as stat, {rnd('ci_low', 8)} as ci_low, {rnd('ci_high', 8)} as ci_high from ba
union all select condition, 'median', {rnd('ci_low', 8)}, {rnd('ci_high', 8)} from bb"""),
    "STA2_permutation_test": query("repeats", f", {_PERM}\n" + " union all ".join(
        f"select condition, {rnd(f'((count(*) filter (where {c})) + 1.0) / {N + 1}')} as p_value, '{a}' as alternative from pd group by 1"
        for a, c in (("two-sided", "abs(d) >= abs(o)"), ("greater", "d >= o"), ("less", "d <= o")))),
    "STA3_benjamini_hochberg": f"""with t as (select o_custkey % 97 as test, ((sum(o_orderkey) % 1000) / 1000.0) ** 4 as p from orders group by 1),
b as ({_BH.format(k='test', p='p', t='t')}) select test, {rnd('p')} as p, {rnd('q')} as q, q <= 0.2 as reject from b""",
    "STA4_condition_summary": query("repeats", f""", {_NM}, {_boot(42, 'avg', 0.025, 'm', name='ba')}, {_PERM},
t as (select condition, ((count(*) filter (where d >= o)) + 1.0)::double / {N + 1} as p from pd group by 1), bh as ({_BH.format(k='condition', p='p', t='t')}),
su as (select condition, count(*) as n, avg(metric) as mean, stddev_pop(metric) as sd from repeats group by 1)
select condition, 'median_r' as metric, n, q <= 0.3 as reject, {rnd('mean', 8)} as mean, {rnd('sd', 8)} as sd, {rnd('ci_low', 8)} as ci_low, {rnd('ci_high', 8)} as ci_high,
  case when condition > 1 then {rnd('mean - (select mean from su where condition = 1)', 8)} end as delta, {rnd('p', 8)} as p, {rnd('q', 8)} as q
from su join ba using (condition) left join bh using (condition)"""),
}

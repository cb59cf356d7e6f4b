"""Queries for TS1-TS17 and CON1-CON7."""

from pyspark.sql import functions as F

from ..functions.common import rounded
from ..operators import connectivity as C
from ..operators import timeseries as T
from ..sources import views as V
from ..sources.views import corr_sql, query, rnd
from .filter_sql import cleaned, highpass
from .ridge_sql import eliminated

R = 5  # parcels of the connectivity queries


def _x(df, *keys):
    return df.select(*(keys or ("run", "voxel", "t")), rounded("x").alias("x"))


def fd(s, d):
    return T.framewise_displacement(V.motion(s, d))


def runs(s, d):
    """(subject, session, run, n_steps, step)."""
    n = V.ts(s, d).where("voxel = 0").groupBy("run").agg(F.count("*").alias("n_steps"))
    return n.selectExpr("cast(run % 7 as int) as subject", "cast(run div 7 % 6 as int) as session", "run",
                        "case when run % 11 = 3 then 0 else n_steps end as n_steps",
                        "case when run % 5 = 0 then null when run % 5 = 1 then 0.0D when run % 5 = 2 then 2.0D else 1.6D end as step")


_RUNS = """runs as (select (run % 7)::int as subject, (run // 7 % 6)::int as session, run, case when run % 11 = 3 then 0 else n end as n_steps,
  case when run % 5 = 0 then null when run % 5 = 1 then 0.0 when run % 5 = 2 then 2.0 else 1.6 end::double as step
  from (select run, count(*) as n from ts_ where voxel = 0 group by 1))"""


def ts1(s, d):
    return _x(T.trim(V.ts(s, d), 5))


def ts2(s, d):
    return T.length_gate(V.ts(s, d), 66).groupBy("run", "voxel").agg(F.count("*").alias("n"))


def ts3(s, d):
    return _x(T.detrend(V.ts(s, d)))


def ts4(s, d):
    return _x(T.highpass(V.ts(s, d)))


def ts5(s, d):
    return fd(s, d).select("run", "t", rounded("fd").alias("fd"))


def ts6(s, d):
    return T.censor(V.ts(s, d), fd(s, d), 0.5, 0.2).groupBy("run", "voxel").agg(F.count("*").alias("n"), rounded(F.sum("x")).alias("total"))


def ts7(s, d):
    c = T.motion_confounds(V.motion(s, d), "friston24")
    return c.select("run", "t", *[rounded(x, 5).alias(x) for x in ("c1", "c6", "c7", "c12", "c13", "c24")])


def ts8_one(s, d):
    both = V.ts(s, d).join(V.motion(s, d).select("run", "t", "p1"), ["run", "t"])
    return _x(T.regress_one(both, "p1"))


def ts8(s, d):
    c = T.motion_confounds(V.motion(s, d), "motion12")
    return _x(T.regress(V.ts(s, d), c))


def ts8_one_grouped(s, d):
    return _x(T.regress(V.ts(s, d), V.motion(s, d).select("run", "t", "p1")))


def ts9(s, d):
    return _x(T.zscore(V.ts(s, d)))


def ts10(s, d):
    return _x(T.clean_runs(V.ts(s, d), V.motion(s, d), fd_limit=0.6, max_share=0.3))


def ts11(s, d):
    m = V.motion(s, d).where("not (run % 10 = 4 and t = 3)").withColumn(
        "p2", F.when((F.col("run") % 9 == 2) & (F.col("t") < 2), F.lit(float("nan"))).otherwise(F.col("p2")))
    return T.motion_violations(m, V.ts(s, d).where("voxel = 0"))


def ts12(s, d):
    return T.subject_gate(runs(s, d).select("subject", "run", "n_steps"), 2, 1200)


def ts13(s, d):
    return T.step_lengths(runs(s, d).select("run", "step"))


def ts14(s, d):
    files = runs(s, d).where("run % 3 <> 1").select("run", F.concat(F.lit("motion_"), F.col("run").cast("string")).alias("motion_file"))
    return T.motion_requirement(runs(s, d).select("run"), files)


def ts15(s, d):
    return T.global_signal(V.ts(s, d)).select("run", "t", rounded("signal").alias("signal"))


def ts16(s, d):
    return T.dvars(V.ts(s, d)).select("run", "t", rounded("dvars").alias("dvars"))


def ts17(s, d):
    return T.example_runs(runs(s, d).select("subject", "session", F.expr("cast(run div 42 as int)").alias("run")).where("subject <> 5 or run > 1"), [0], 2)


def con_series(s, d):
    return V.ts(s, d).withColumn("subject", (F.col("run") % 4).cast("int"))


def con_rows(s, d):
    """The same series with one row a step; a run's number tells its subject."""
    return V.channel_rows(s, d, 8).selectExpr("cast(user_id % 4 as int) as subject", "user_id as run", "t", "v")


def con_labels(s, d):
    v = con_rows(s, d).select("subject").distinct().withColumn("voxel", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return v.withColumn("label", F.expr("case when voxel = 7 then 0 else cast(voxel div 2 as int) + 1 end"))


_CON = """cser as (select (run % 4)::int as subject, * from ts_),
clab as (select distinct subject, voxel, case when voxel = 7 then 0 else voxel // 2 + 1 end as label from cser),
pm as (select subject, run, t, label, avg(x) as m from cser join clab using (subject, voxel) where label > 0 group by 1, 2, 3, 4),
par as (select g.subject, g.run, g.t, g.label, coalesce(m, 0.0) as x from (select distinct subject, run, t, l as label from cser, unnest(range(1, 6)) u(l)) g
  left join pm using (subject, run, t, label))"""


def con1(s, d):
    return C.parcel_series(con_series(s, d), con_labels(s, d), R).select("subject", "run", "t", "label", rounded("x").alias("x"))


def con2(s, d):
    c = C.column_correlation_rows(con_rows(s, d), "v", "v", ["run"])
    return c.select("run", F.col("i").alias("left"), F.posexplode("c").alias("right", "c")).withColumn("c", rounded("c"))


def con3(s, d):
    return C.parcel_connectivity_rows(con_rows(s, d), con_labels(s, d), R, by=["run"]).withColumn("c", rounded("c"))


def con3_concat(s, d):
    return C.parcel_connectivity_rows(con_rows(s, d), con_labels(s, d), R, "concat").withColumn("c", rounded("c"))


def con3_blocks(s, d):
    return C.parcel_connectivity_blocks(con_series(s, d), con_labels(s, d), R).withColumn("c", rounded("c"))


def con4(s, d):
    out = C.voxel_connectivity(con_rows(s, d), "average", by=["run"])
    return out.select("subject", "voxel", F.posexplode("c").alias("other", "c")).withColumn("c", rounded("c"))


def con5(s, d):
    return C.rest_connectivity(con_rows(s, d), "parcellation", con_labels(s, d), R, by=["run"]).withColumn("c", rounded("c"))


def con6(s, d):
    return C.voxel_profiles_rows(con_rows(s, d), con_labels(s, d), ["run"]).withColumn("c", rounded("c"))


def con7(s, d):
    return C.parcel_profiles(C.voxel_profiles_rows(con_rows(s, d), con_labels(s, d), ["run"])).withColumn("c", rounded("c"))


QUERIES = {"TS1_trim": ts1, "TS2_length_gate": ts2, "TS3_detrend": ts3, "TS4_highpass": ts4, "TS5_framewise_displacement": ts5, "TS6_censor": ts6,
           "TS7_motion_confounds": ts7, "TS8_regress_one": ts8_one, "TS8_regress_one_grouped": ts8_one_grouped, "TS8_regress": ts8, "TS9_zscore": ts9,
           "TS10_clean_runs": ts10, "TS11_motion_violations": ts11, "TS12_subject_gate": ts12, "TS13_step_lengths": ts13, "TS14_motion_requirement": ts14,
           "TS15_global_signal": ts15, "TS16_dvars": ts16, "TS17_example_runs": ts17, "CON1_parcel_series": con1, "CON2_column_correlation": con2,
           "CON3_parcel_connectivity": con3, "CON3_parcel_connectivity_concat": con3_concat, "CON3_parcel_connectivity_blocks": con3_blocks,
           "CON4_voxel_connectivity": con4, "CON5_rest_connectivity": con5, "CON6_voxel_profiles": con6, "CON7_parcel_profiles": con7}

_W = "partition by run, voxel"
_FD = "fd as (select run, t, coalesce(" + " + ".join(
    f"abs(p{i} - lag(p{i}) over w)" + (" * 50.0" if i > 3 else "") for i in range(1, 7)) + ", 0) as fd from motion window w as (partition by run order by t))"
_CC = f"cc as (select subject, run, label, voxel, {corr_sql('p.x', 's.x')} as c from par p join cser s using (subject, run, t) group by 1, 2, 3, 4)"
_CON3 = query("ts_", f", {_CON}, {_CC} select subject, label, voxel, {rnd('avg(c)')} as c from cc group by 1, 2, 3")
_CON6 = f"""kp as (select * from cser join clab using (subject, voxel) where label > 0),
pp as (select subject, run, t, label, avg(x) as p from kp group by 1, 2, 3, 4),
pr as (select k.subject, k.run, k.label as own, voxel, pp.label, covar_pop(x, p) / ((case when stddev_pop(x) < 1e-6 then 1 else stddev_pop(x) end)
  * (case when stddev_pop(p) < 1e-6 then 1 else stddev_pop(p) end)) * count(*) / (count(*) - 1) as c
  from kp k join pp on k.subject = pp.subject and k.run = pp.run and k.t = pp.t group by 1, 2, 3, 4, 5)"""
_REG = query("ts_ motion", f"""select run, voxel, t, {rnd('''x - avg(x) over w - coalesce(covar_pop(p1, x) over w / nullif(var_pop(p1) over w, 0), 0) * (p1 - avg(p1) over w)''')} as x
from ts_ join motion using (run, t) window w as ({_W})""")
#: Ledoit-Wolf shrinkage of each run's covariance, and the correlation from it.
_LW = """ce as (select subject, run, voxel, t, x - avg(x) over (partition by run, voxel) as x from cser),
em as (select a.subject, a.run, a.voxel, b.voxel as other, sum(a.x * b.x) / count(*) as e, count(*) as n from ce a join ce b on a.run = b.run and a.t = b.t group by 1, 2, 3, 4),
qu as (select run, sum(s * s) as quart from (select run, t, sum(x * x) as s from ce group by 1, 2) group by 1),
sz as (select subject, run, any_value(n) as n, count(distinct voxel) as p, sum(e * e) as e2, sum(e) filter (where voxel = other) as tr from em group by 1, 2),
sh as (select run, tr / p as mu, (e2 - 2 * tr * tr / p + tr * tr / p) / p as delta, (quart / n - e2) / (p * n) as beta from sz join qu using (run)),
sk as (select run, mu, case when least(beta, delta) = 0 then 0 else least(beta, delta) / delta end as s from sh),
cv as (select subject, run, voxel, other, (1 - s) * e + case when voxel = other then s * mu else 0 end as c from em join sk using (run)),
dg as (select run, voxel, greatest(sqrt(c), 1e-10) as d from cv where voxel = other)"""
_CON4 = query("ts_", f""", cser as (select (run % 4)::int as subject, * from ts_), {_LW}
select cv.subject, cv.voxel, cv.other, {rnd('avg(c / a.d / b.d)')} as c from cv join dg a on cv.run = a.run and cv.voxel = a.voxel
join dg b on cv.run = b.run and cv.other = b.voxel group by 1, 2, 3""")

#: Least squares on twelve confounds and an intercept, run by run.
_C12 = """md as (select run, t, [""" + ", ".join(f"p{i}" for i in range(1, 7)) + ", " + ", ".join(f"coalesce(p{i} - lag(p{i}) over w, 0)" for i in range(1, 7)) + """] as c
  from motion window w as (partition by run order by t)),
cl as (select run as key, t, unnest(range(12)) as f, unnest(c)::double as v from md), cm as (select key, f, avg(v) as m, stddev_pop(v) as sd from cl group by 1, 2),
cx as (select key, t, f, (v - m) / case when sd < 1e-8 then 1 else sd end as v from cl join cm using (key, f)),
xm as (select run, voxel, avg(x) as m from ts_ group by 1, 2),
am as (select key, f, list(v order by g) as r from (select a.key, a.f, b.f as g, sum(a.v * b.v) as v from cx a join cx b on a.key = b.key and a.t = b.t group by 1, 2, 3) group by 1, 2),
bm as (select key, f, list(v order by voxel) as r from (select key, f, s.voxel, sum(v * (x - m)) as v from cx join ts_ s on s.run = key and s.t = cx.t join xm on xm.run = key and xm.voxel = s.voxel group by 1, 2, 3)
  group by 1, 2),
ag as (select key, list(list_concat(am.r, bm.r) order by f) as a, 12::bigint as n from am join bm using (key, f) group by 1),
""" + eliminated("sv", "ag") + """,
sl as (select key, f, unnest(range(8)) as voxel, unnest(r[13:]) as w from (select key, unnest(range(12)) as f, unnest(a) as r from sv)),
ft as (select key, t, voxel, sum(v * w) as p from cx join sl using (key, f) group by 1, 2, 3)"""
_TS8 = query("ts_ motion", f", {_C12} select s.run, s.voxel, s.t, {rnd('x - m - p')} as x from ts_ s join xm using (run, voxel) join ft on ft.key = s.run and ft.t = s.t and ft.voxel = s.voxel").replace(
    "with ", "with recursive ", 1)

ORACLE_SQL = {
    "TS8_regress": _TS8,
    "TS4_highpass": query("ts_", f", {highpass('hp', 'ts_')} select run, voxel, t, {rnd('x')} as x from hp").replace("with ", "with recursive ", 1),
    "TS10_clean_runs": query("ts_ motion", f", {cleaned(0.6)} select run, voxel, t, {rnd('x')} as x from cl").replace("with ", "with recursive ", 1),
    "CON4_voxel_connectivity": _CON4,
    "TS1_trim": query("ts_", f"select run, voxel, t - 5 as t, {rnd('x')} as x from ts_ where t >= 5"),
    "TS2_length_gate": query("ts_", "select run, voxel, count(*) as n from ts_ group by 1, 2 having count(*) >= 66"),
    "TS3_detrend": query("ts_", f"""select run, voxel, t, {rnd('x - (avg(x) over w + coalesce(covar_pop(t, x) over w / nullif(var_pop(t) over w, 0), 0) * (t - avg(t) over w))')} as x
from ts_ window w as ({_W})"""),
    "TS5_framewise_displacement": query("motion", f", {_FD} select run, t, {rnd('fd')} as fd from fd"),
    "TS6_censor": query("ts_ motion", f""", {_FD}, g as (select *, avg((fd > 0.5)::int) over (partition by run) as share from fd)
select run, voxel, count(*) as n, {rnd('sum(x)')} as total from ts_ join g using (run, t) where fd <= 0.5 and share <= 0.2 group by 1, 2"""),
    "TS7_motion_confounds": query("motion", """, d as (select run, t, p1 as c1, p6 as c6, coalesce(p1 - lag(p1) over w, 0) as c7, coalesce(p6 - lag(p6) over w, 0) as c12
  from motion window w as (partition by run order by t)),
e as (select *, c1 * c1 as c13, c12 * c12 as c24 from d)
select run, t, """ + ", ".join(rnd(f"(c{i} - avg(c{i}) over w) / (case when stddev_pop(c{i}) over w < 1e-8 then 1 else stddev_pop(c{i}) over w end)", 5) + f" as c{i}"
                               for i in (1, 6, 7, 12, 13, 24)) + " from e window w as (partition by run)"),
    "TS8_regress_one": _REG, "TS8_regress_one_grouped": _REG,
    "TS9_zscore": query("ts_", f"select run, voxel, t, {rnd('(x - avg(x) over w) / greatest(stddev_pop(x) over w, 1e-8)')} as x from ts_ window w as ({_W})"),
    "TS11_motion_violations": query("ts_", """, n as (select run, count(*) as n from ts_ where voxel = 0 group by 1)
select run, 'steps' as rule, 1 as n from n where run % 10 = 4 union all select run, 'not_finite', 2 from n where run % 9 = 2"""),
    "TS12_subject_gate": query("ts_", f""", {_RUNS}, g as (select *, count(*) over (partition by subject) as k, sum(n_steps) over (partition by subject) as st from runs)
select subject, run, n_steps, (row_number() over (partition by subject order by run))::int as new_run from g where k >= 2 and st >= 1200 and n_steps > 0"""),
    "TS13_step_lengths": query("ts_", f", {_RUNS} select run, coalesce(nullif(step, 0), 1.333) as step, abs(coalesce(nullif(step, 0), 1.333) - 1.333) > 0.5 as warn from runs"),
    "TS14_motion_requirement": query("ts_", f""", {_RUNS} select run, case when run % 3 <> 1 then 'motion_' || run end as motion_file,
  case when run % 3 <> 1 then 'regress' else 'skip' end as action from runs"""),
    "TS15_global_signal": query("ts_", f"select run, t, {rnd('avg(x)')} as signal from ts_ group by 1, 2"),
    "TS16_dvars": query("ts_", f"""select run, t, {rnd('sqrt(avg(dx * dx))')} as dvars from (select run, t, x - lag(x) over (partition by run, voxel order by t) as dx from ts_)
where dx is not null group by 1, 2"""),
    "TS17_example_runs": query("ts_", f""", {_RUNS}, a as (select subject, session, (run // 42)::int as run from runs where subject <> 5 or run // 42 > 1),
se as (select subject, list_sort(list(distinct session)) as s from a group by 1),
pk as (select distinct subject, unnest([s[1], s[(len(s) - 1) // 2 + 1], s[len(s)]]) as session from se),
so as (select a.* from a join pk using (subject, session) where run in (0)),
re as (select *, row_number() over (partition by subject order by ('0x' || substr(md5('42-0-' || subject || '-' || session || '-' || run), 1, 8))::bigint, session, run) as k
  from a where subject not in (select subject from so))
select * from so union all select subject, session, run from re where k <= 2"""),
    "CON1_parcel_series": query("ts_", f", {_CON} select subject, run, t, label, {rnd('x')} as x from par"),
    "CON2_column_correlation": query("ts_", f""", {_CON} select a.run, a.voxel as "left", b.voxel as "right", {rnd(corr_sql('a.x', 'b.x'))} as c
from cser a join cser b on a.run = b.run and a.t = b.t group by 1, 2, 3"""),
    "CON3_parcel_connectivity": _CON3, "CON3_parcel_connectivity_blocks": _CON3,
    "CON3_parcel_connectivity_concat": query("ts_", f", {_CON} select subject, label, voxel, {rnd(corr_sql('p.x', 's.x'))} as c from par p join cser s using (subject, run, t) group by 1, 2, 3"),
    "CON5_rest_connectivity": _CON3.replace("select subject, label, voxel, round", "select subject, label as \"row\", voxel, round"),
    "CON6_voxel_profiles": query("ts_", f", {_CON}, {_CON6} select subject, run, own, voxel, label, {rnd('c')} as c from pr"),
    "CON7_parcel_profiles": query("ts_", f", {_CON}, {_CON6} select subject, run, own, label, {rnd('avg(c)')} as c from pr group by 1, 2, 3, 4"),
}

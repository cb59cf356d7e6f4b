"""Queries for EXP3, EXP5-EXP16 and EXP20."""

from pyspark.sql import functions as F

from ..functions.common import rounded
from ..operators import experiments as X
from ..sources import views as V
from ..sources.views import corr_sql, query, rnd
from .metrics import CORR, NC, ceiling, corr


def _results(s, d):
    return V.table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("kind"), (F.col("l_linenumber") - 1).alias("n_shots"),
                                             (F.col("l_orderkey") % 5).cast("int").alias("rep")).agg(F.round(F.avg("l_discount"), 10).alias("score"))


_RES = """res as (select l_suppkey % 3 as kind, l_linenumber - 1 as n_shots, (l_orderkey % 5)::int as rep, round(avg(l_discount), 10) as score from lineitem group by 1, 2, 3)"""


def exp3(s, d):
    return X.backbone_summary(_results(s, d)).select("kind", "best_n", *[rounded(c, 8).alias(c) for c in ("zero", "best", "first_repeat", "delta")])


def exp5_states(s, d):
    return X.trial_states(V.trial_log(s, d))


def exp5_best(s, d):
    return X.best_trial(V.trial_log(s, d)).withColumn("value", rounded("value"))


def exp5_running(s, d):
    t = V.trial_log(s, d).withColumn("study", (F.col("number") % 13).cast("int"))
    t = t.withColumn("completed", F.expr("cast(started as timestamp) + make_interval(0, 0, 0, 0, 0, 0, seconds)"))
    return X.running_best(t, ["study"]).select("number", "study", rounded("best_so_far").alias("best_so_far"), rounded("duration").alias("duration"))


def exp6(s, d):
    t = V.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("study"), F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("step")).agg(F.max("l_discount").alias("score"))
    t = t.withColumn("state", F.when(F.col("trial") % 3 == 0, "COMPLETE").otherwise("PRUNED"))
    return X.median_pruning(t, 5, 2, 2, ["study"])


def record_files(s, d):
    """Run records: names of N and seed with some that don't fit."""
    return V.table(s, d, "orders").selectExpr(
        "o_orderkey as id", "case when o_orderkey % 10 = 3 then concat('runs/zeroshot_sub', o_orderkey, '.json') else "
        "format_string('runs/%d/fewshot_sub%d_N%d_seed%d_metrics.json', o_orderkey, o_orderkey % 4, (o_orderkey div 4) % 6 * 50, 42 + o_orderkey % 3) end as path",
        "case when o_orderkey % 11 = 5 then 'nan?' else cast(round(o_totalprice / 1000000, 6) as string) end as median_r")


_FILES = """files as (select o_orderkey as id, o_orderkey % 4 as subject, (o_orderkey // 4) % 6 * 50 as n_shots, 42 + o_orderkey % 3 as seed,
  format('runs/{}/fewshot_sub{}_N{}_seed{}_metrics.json', o_orderkey, o_orderkey % 4, (o_orderkey // 4) % 6 * 50, 42 + o_orderkey % 3) as path,
  round(o_totalprice / 1000000, 6) as median_r from orders where o_orderkey % 10 <> 3 and o_orderkey % 11 <> 5)"""


def exp7(s, d):
    return X.fewshot_runs(record_files(s, d)).withColumn("median_r", rounded("median_r"))


def exp7_dedupe(s, d):
    return X.fewshot_runs(record_files(s, d), True).withColumn("median_r", rounded("median_r"))


def exp8(s, d):
    r = V.table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("kind"), F.col("l_linenumber").alias("line")).agg(F.round(F.avg("l_discount"), 2).alias("m"))
    r = r.select("kind", "line", F.when(F.col("line") == 4, "n/a").otherwise(((F.col("line") - 1) * 25).cast("string")).alias("n_shots"), F.col("m").cast("string").alias("mean"))
    return X.best_n(r, ["kind"])


def exp9(s, d):
    r = X.fewshot_runs(record_files(s, d), True)
    out = X.select_run(r).withColumn("how", F.lit("best"))
    for how, args in (("preferred", {"preferred_n": 100}), ("forced", {"force_n": 50, "force_seed": 43})):
        out = out.union(X.select_run(r, **args).withColumn("how", F.lit(how)))
    return out.select("how", "subject", "n_shots", "seed", "path")


def _two(s, d):
    """The held-out prediction as the few-shot one, a damped neighbour channel as the zero-shot one."""
    few = V.prediction(s, d)
    zero = few.withColumn("p", F.col("p") * (1 + F.col("voxel") % 3) - F.lit(0.1) * (F.col("voxel") % 2))
    return few, zero


_ZERO = "zr as (select subject, stim_id, voxel, y, p * (1 + voxel % 3) - 0.1::double * (voxel % 2) as p from prediction)"


def exp10(s, d):
    few, zero = [x.where("subject = 1") for x in _two(s, d)]
    return X.ranked_manifest(few, zero, 12).select("stim_id", "rank", rounded("few_r").alias("few_r"), rounded("zero_r").alias("zero_r"), rounded("gain").alias("gain"))


_EXP10 = f"""f as (select stim_id, {corr_sql('y', 'p')} as few_r from prediction where subject = {{0}} group by 1),
z as (select stim_id, {corr_sql('y', 'p')} as zero_r from zr where subject = {{0}} group by 1),
g as (select *, round(few_r - zero_r, 9) as gain from f join z using (stim_id)), m as (select *, row_number() over (order by gain desc, stim_id) as rank from g)"""


def values(s, d):
    return V.responses(s, d).groupBy("subject", "voxel").agg(F.round(F.avg("val"), 9).alias("val"))


_VAL = """vals as (select subject, voxel, round(avg(val), 9) as val from responses group by 1, 2),
pk as (select subject, x as px, y as py, z as pz from (select *, row_number() over (partition by subject order by abs(val) desc, voxel) as k from vals join mask using (subject, voxel)) where k = 1)"""


def _grid(s, d):
    return V.mask(s, d).drop("in_mask")


def exp11(s, d):
    return X.peak_voxel(values(s, d), _grid(s, d))


def exp12(s, d):
    out = X.orthogonal_slices(values(s, d), _grid(s, d), exp11(s, d))
    return out.withColumn("val", rounded("val"))


def exp13(s, d):
    return X.value_limit(V.responses(s, d)).withColumn("limit", rounded("limit"))


def exp14(s, d):
    r = X.histogram(corr(s, d).withColumn("r", F.round("r", 9)), "r", -1.0, 1.0, 100).withColumn("what", F.lit("r"))
    return r.union(X.histogram(ceiling(s, d).withColumn("nc", F.round("nc", 9)), "nc", 0.0, 1.0, 100).withColumn("what", F.lit("nc")))


def exp15_curve(s, d):
    return X.shot_curve(_results(s, d)).select("n_shots", "n", rounded("mean", 8).alias("mean"), rounded("sd", 8).alias("sd"))


def exp15_parcels(s, d):
    r = corr(s, d).join(V.labels_raw(s, d).where("label > 0 and (label + subject) % 5 <> 0"), ["subject", "voxel"])
    r = r.select("label", F.concat(F.lit("s"), F.col("subject").cast("string")).alias("condition"), "r")
    out = X.parcel_table(r, ["s0", "s1", "s2"])
    return out.select("label", *[rounded(c).alias(c) for c in ("s0", "s1", "s2")])


def exp16(s, d):
    return X.top_patterns(V.prediction(s, d).where("subject = 3"), 5).withColumn("r", rounded("r"))


def exp20(s, d):
    few, zero = _two(s, d)
    return X.example_manifest(few, zero, record_files(s, d), 2, 12).select("stim_id", "rank", "n_shots", "seed", "path")


QUERIES = {"EXP3_backbone_summary": exp3, "EXP5_trial_states": exp5_states, "EXP5_best_trial": exp5_best, "EXP5_running_best": exp5_running, "EXP6_median_pruning": exp6,
           "EXP7_fewshot_runs": exp7, "EXP7_fewshot_runs_dedupe": exp7_dedupe, "EXP8_best_n": exp8, "EXP9_select_run": exp9, "EXP10_ranked_manifest": exp10,
           "EXP11_peak_voxel": exp11, "EXP12_orthogonal_slices": exp12, "EXP13_value_limit": exp13, "EXP14_histogram": exp14, "EXP15_shot_curve": exp15_curve,
           "EXP15_parcel_table": exp15_parcels, "EXP16_top_patterns": exp16, "EXP20_example_manifest": exp20}

_DEDUP = "dd as (select * from (select *, row_number() over (partition by subject, n_shots, seed order by median_r desc, path) as k from files) where k = 1)"


def _pick(how, where):
    return f"select '{how}' as how, subject, n_shots, seed, path from (select *, row_number() over (partition by subject order by median_r desc, n_shots desc, seed) as r from dd where {where}) where r = 1"


ORACLE_SQL = {
    "EXP3_backbone_summary": f"""with {_RES}, l as (select kind, n_shots, avg(score) as mean, arg_min(score, rep) as first from res group by 1, 2),
b as (select *, row_number() over (partition by kind order by mean desc, n_shots) as k from l where n_shots > 0)
select kind, b.n_shots as best_n, {rnd('z.mean', 8)} as zero, {rnd('b.mean', 8)} as best, {rnd('b.first', 8)} as first_repeat, {rnd('b.mean - z.mean', 8)} as delta
from b left join (select * from l where n_shots = 0) z using (kind) where k = 1""",
    "EXP5_trial_states": query("trial_log", "select state, count(*) as n from trial_log group by 1"),
    "EXP5_best_trial": query("trial_log", f"select number, {rnd('\"value\"')} as \"value\" from trial_log where state = 'COMPLETE' order by 2 desc, 1 limit 1"),
    "EXP5_running_best": query("trial_log", f"""select number, (number % 13)::int as study,
  {rnd("max(case when state = 'COMPLETE' then \"value\" end) over (partition by number % 13 order by number)")} as best_so_far, {rnd('seconds::double')} as duration from trial_log"""),
    "EXP6_median_pruning": """with t as (select l_suppkey as study, l_orderkey as trial, l_linenumber as step, max(l_discount) as score, l_orderkey % 3 = 0 as done from lineitem group by 1, 2, 3),
b as (select *, max(score) over (partition by study, trial order by step) as best from t),
m as (select b.study, b.trial, b.step, b.score, b.best, median(d.score) as m, count(d.score) as n from b left join t d on d.done and d.study = b.study and d.step = b.step and d.trial < b.trial group by 1, 2, 3, 4, 5)
select study, trial, step, score, coalesce(n >= 5 and step >= 2 and (step - 2) % 2 = 0 and best < m, false) as prune from m""",
    "EXP7_fewshot_runs": f"with {_FILES} select subject::int as subject, n_shots::int as n_shots, seed::int as seed, {rnd('median_r')} as median_r, path from files",
    "EXP7_fewshot_runs_dedupe": f"with {_FILES}, {_DEDUP} select subject::int as subject, n_shots::int as n_shots, seed::int as seed, {rnd('median_r')} as median_r, path from dd",
    "EXP8_best_n": """with r as (select l_suppkey % 3 as kind, l_linenumber as line, round(avg(l_discount), 2) as m from lineitem group by 1, 2)
select kind, ((line - 1) * 25)::int as best_n from (select *, row_number() over (partition by kind order by m desc, line) as k from r where line > 1 and line <> 4) where k = 1""",
    "EXP9_select_run": f"""with {_FILES}, {_DEDUP}, pf as (select subject from dd where n_shots = 100 group by 1)
{_pick('best', 'true')} union all {_pick('preferred', 'n_shots = 100 or subject not in (select subject from pf)')} union all {_pick('forced', 'n_shots = 50 and seed = 43')}""",
    "EXP10_ranked_manifest": query("prediction", f", {_ZERO}, {_EXP10.format(1)} select stim_id, rank, {rnd('few_r')} as few_r, {rnd('zero_r')} as zero_r, {rnd('gain')} as gain from m where rank <= 12"),
    "EXP11_peak_voxel": query("responses mask", f", {_VAL} select subject, px as x, py as y, pz as z from pk"),
    "EXP12_orthogonal_slices": query("responses mask", f", {_VAL}, b as (select * from vals join mask using (subject, voxel) join pk using (subject))\n" + " union all ".join(
        f"select subject, '{c}' as plane, x, y, z, {rnd('val')} as val from b where {c} = p{c}" for c in "xyz")),
    "EXP13_value_limit": query("responses", f"select subject, {rnd('greatest(quantile_cont(abs(val), 0.99), 1e-6)')} as \"limit\" from responses group by 1"),
    "EXP14_histogram": query("prediction trials", f""", {CORR}, {NC}
select least(floor((round(r, 9) + 1) / 2 * 100), 99)::int as bin, count(*) as n, 'r' as what from corr group by 1
union all select least(floor(round(nc, 9) * 100), 99)::int, count(*), 'nc' from nc group by 1"""),
    "EXP15_shot_curve": f"with {_RES} select n_shots, count(*) as n, {rnd('avg(score)', 8)} as mean, {rnd('stddev_pop(score)', 8)} as sd from res group by 1",
    "EXP15_parcel_table": query("prediction labels_raw", f""", {CORR}, j as (select label, subject, r from corr join labels_raw using (subject, voxel) where label > 0 and (label + subject) % 5 <> 0)
select label, """ + ", ".join(rnd(f"coalesce(median(r) filter (where subject = {i}), 0)") + f" as s{i}" for i in range(3)) + " from j group by 1"),
    "EXP16_top_patterns": query("prediction", f"""select stim_id, {rnd('r')} as r from (select stim_id, round({corr_sql('y', 'p')}, 9) as r from prediction where subject = 3 group by 1) order by r desc, stim_id limit 5"""),
    "EXP20_example_manifest": query("prediction", f""", {_ZERO}, {_EXP10.format(2)}, {_FILES}, {_DEDUP}, ch as ({_pick('best', 'subject = 2')})
select stim_id, rank, n_shots, seed, path from m, ch where rank <= 12"""),
}

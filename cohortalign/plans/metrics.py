"""Queries for MET1-MET11 and ENC2."""

from pyspark.sql import functions as F

from ..functions.common import rounded
from ..operators import masks, metrics as M
from ..sources import views as V
from ..sources.views import corr_sql, query, rnd

K = ["subject"]
THRESHOLDS = [0.0, 0.05, 0.1, 0.3]
CORR = f"corr as (select subject, voxel, {corr_sql('y', 'p')} as r from prediction group by 1, 2)"
NC = f"""halves as (
  select stim_id % 5 as subject, stim_id, voxel, avg(case when trial % 2 = 0 then val end) as y, avg(case when trial % 2 = 1 then val end) as p
  from trials group by 1, 2, 3 having count(*) > 1),
hr as (select subject, voxel, greatest(-0.999, least(0.999, {corr_sql('y', 'p')})) as r from halves group by 1, 2),
nc as (select subject, voxel, greatest(0.0, least(1.0, 2 * r / (1 + abs(r)))) as nc from hr)"""


def corr(s, d):
    return M.voxelwise_correlation(V.prediction(s, d), K)


def ceiling(s, d):
    """Ten items of repeated trials, dealt to five subjects, two items each."""
    t = V.trials(s, d).withColumn("subject", (F.col("stim_id") % 5).cast("int"))
    return M.noise_ceiling(t, K)


def met1(s, d):
    return corr(s, d).withColumn("r", rounded("r"))


def met2(s, d):
    return M.correlation_summary(corr(s, d), K).select("subject", rounded("median_r").alias("median_r"), rounded("mean_r").alias("mean_r"))


def met3(s, d):
    return M.pattern_correlation(V.prediction(s, d), K).withColumn("r", rounded("r"))


def met3_rows(s, d):
    p = V.prediction(s, d).groupBy("subject", "stim_id").agg(F.sort_array(F.collect_list(F.struct("voxel", "y", "p"))).alias("a"))
    p = p.select("subject", "stim_id", F.col("a.y").alias("y"), F.col("a.p").alias("p"))
    return M.pattern_correlation_rows(p).select("subject", "stim_id", rounded("r").alias("r"))


def met4(s, d):
    return M.two_vs_two(V.prediction(s, d), 300, 42, K).withColumn("accuracy", rounded("accuracy"))


def met5(s, d):
    return ceiling(s, d).withColumn("nc", rounded("nc"))


def met6(s, d):
    out = M.normalized_performance(corr(s, d), ceiling(s, d), ["subject", "voxel"])
    return out.groupBy("subject").agg(F.count_if(F.col("normalized").isNull()).alias("n_excluded"), F.count("*").alias("n"),
                                      rounded(F.median("normalized")).alias("median_normalized"))


def met7(s, d):
    out = M.roi_evaluation(corr(s, d), V.labels_raw(s, d), ["subject", "voxel"], K)
    return out.withColumn("median_r", rounded("median_r")).withColumn("mean_r", rounded("mean_r"))


def met8(s, d):
    out = M.reliability_strata(corr(s, d), ceiling(s, d), masks.parse_thresholds(THRESHOLDS), ["subject", "voxel"], K)
    return out.withColumn("median_r", rounded("median_r")).withColumn("mean_r", rounded("mean_r"))


def met9(s, d):
    out = M.label_split(corr(s, d), V.labels_raw(s, d), ["subject", "voxel"], K)
    return out.select("subject", "n_labeled", "n_unlabeled", *[rounded(c).alias(c) for c in (
        "labeled_median_r", "labeled_mean_r", "unlabeled_median_r", "unlabeled_mean_r")])


def met10(s, d):
    return M.r_squared(V.prediction(s, d), K).withColumn("r2", rounded("r2"))


def enc2(s, d):
    return M.total_r_squared(V.prediction(s, d), K).withColumn("r2", rounded("r2"))


def met11(s, d):
    out = M.run_record(V.prediction(s, d), ceiling(s, d), V.labels_raw(s, d), K, THRESHOLDS)
    first = F.col("strata")[0]
    return out.select("subject", "n_eval", "n_voxels", "n_labeled", "n_unlabeled", F.size("strata").alias("n_strata"),
                      first["n_voxels"].alias("n_first"), *[rounded(c).alias(c) for c in (
                          "median_r", "mean_r", "median_pattern_r", "nc_median", "nc_mean")])


_PAIR = ("('0x' || substr(md5('42-' || j || '-{0}'), 1, 8))::bigint")
QUERIES = {
    "MET1_voxelwise_correlation": met1, "MET2_correlation_summary": met2, "MET3_pattern_correlation": met3,
    "MET3_pattern_correlation_rows": met3_rows, "MET4_two_vs_two": met4, "MET5_noise_ceiling": met5,
    "MET6_normalized_performance": met6, "MET7_roi_evaluation": met7, "MET8_reliability_strata": met8,
    "MET9_label_split": met9, "MET10_r_squared": met10, "MET11_run_record": met11, "ENC2_training_r2": enc2,
}
_PATTERN = query("prediction", f"select subject, stim_id, {rnd(corr_sql('y', 'p'))} as r from prediction group by 1, 2")
_SS = "one as (select subject, voxel, sum((y - p) ** 2) as sse, var_pop(y) * count(y) as sst from prediction group by 1, 2)"
ORACLE_SQL = {
    "MET1_voxelwise_correlation": query("prediction", f", {CORR} select subject, voxel, {rnd('r')} as r from corr"),
    "MET2_correlation_summary": query("prediction", f", {CORR} select subject, {rnd('median(r)')} as median_r, {rnd('avg(r)')} as mean_r from corr group by 1"),
    "MET3_pattern_correlation": _PATTERN, "MET3_pattern_correlation_rows": _PATTERN,
    "MET4_two_vs_two": query("prediction", f""",
items as (select *, row_number() over (partition by subject order by stim_id) - 1 as i from (select distinct subject, stim_id from prediction)),
n as (select subject, count(*) as n from items group by 1),
d0 as (select subject, j, {_PAIR.format('a')} % n as a, {_PAIR.format('b')} % (n - 1) as b from n, unnest(range(0, 300)) u(j) where n > 1),
dr as (select subject, j, a, case when b >= a then b + 1 else b end as b from d0),
c as (select i, p.* from prediction p join items using (subject, stim_id)),
o as (select dr.subject, j, {corr_sql('x.y', 'x.p')} as aa, {corr_sql('z.y', 'z.p')} as bb, {corr_sql('x.y', 'z.p')} as ab, {corr_sql('z.y', 'x.p')} as ba
      from dr join c x on x.subject = dr.subject and x.i = a join c z on z.subject = dr.subject and z.i = b and z.voxel = x.voxel group by 1, 2)
select subject, {rnd('avg((round(aa + bb, 10) > round(ab + ba, 10))::int)')} as accuracy, count(*) as n_pairs from o group by 1"""),
    "MET5_noise_ceiling": query("trials", f", {NC} select subject, voxel, {rnd('nc')} as nc from nc"),
    "MET6_normalized_performance": query("prediction trials", f""", {CORR}, {NC}
select subject, count(*) filter (where nc < 0.1) as n_excluded, count(*) as n, {rnd('median(case when nc >= 0.1 then r / nc end)')} as median_normalized
from corr join nc using (subject, voxel) group by 1"""),
    "MET7_roi_evaluation": query("prediction labels_raw", f""", {CORR}
select subject, label, {rnd('median(r)')} as median_r, {rnd('avg(r)')} as mean_r, count(*) as n_voxels
from corr join labels_raw using (subject, voxel) where label > 0 group by 1, 2"""),
    "MET8_reliability_strata": query("prediction trials", f""", {CORR}, {NC}
select subject, threshold, count(*) filter (where nc >= threshold) as n_voxels, {rnd('median(r) filter (where nc >= threshold)')} as median_r,
  {rnd('avg(r) filter (where nc >= threshold)')} as mean_r
from corr join nc using (subject, voxel), unnest([0.0::double, 0.05, 0.1, 0.3]) t(threshold) group by 1, 2"""),
    "MET9_label_split": query("prediction labels_raw", f""", {CORR}
select subject, count(*) filter (where label > 0) as n_labeled, count(*) filter (where label = 0) as n_unlabeled,
  {rnd('median(r) filter (where label > 0)')} as labeled_median_r, {rnd('avg(r) filter (where label > 0)')} as labeled_mean_r,
  {rnd('median(r) filter (where label = 0)')} as unlabeled_median_r, {rnd('avg(r) filter (where label = 0)')} as unlabeled_mean_r
from corr join labels_raw using (subject, voxel) group by 1"""),
    "MET10_r_squared": query("prediction", f", {_SS} select subject, {rnd('avg(case when sst > 0 then 1 - sse / sst when sse = 0 then 1.0 else 0.0 end)')} as r2 from one group by 1"),
    "ENC2_training_r2": query("prediction", f", {_SS} select subject, {rnd('1 - sum(sse) / sum(sst)')} as r2 from one group by 1"),
    "MET11_run_record": query("prediction trials labels_raw", f""", {CORR}, {NC},
pat as (select subject, median(r) as m from (select subject, stim_id, {corr_sql('y', 'p')} as r from prediction group by 1, 2) group by 1),
cs as (select subject, median(nc) as nc_median, avg(nc) as nc_mean from nc group by 1),
z as (select subject, count(distinct stim_id) as n_eval, count(distinct voxel) as n_voxels from prediction group by 1)
select subject, n_eval, n_voxels, count(*) filter (where label > 0) as n_labeled, count(*) filter (where label = 0) as n_unlabeled,
  4 as n_strata, count(*) filter (where nc >= 0) as n_first, {rnd('median(r)')} as median_r, {rnd('avg(r)')} as mean_r,
  {rnd('any_value(m)')} as median_pattern_r, {rnd('any_value(nc_median)')} as nc_median, {rnd('any_value(nc_mean)')} as nc_mean
from corr join nc using (subject, voxel) join labels_raw using (subject, voxel) join pat using (subject) join cs using (subject) join z using (subject)
group by 1, 2, 3"""),
}

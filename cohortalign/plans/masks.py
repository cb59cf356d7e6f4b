"""Queries for FIL1-FIL12 and HAR1-HAR9."""

from pyspark.sql import functions as F

from ..functions.common import rounded
from ..operators import harmonize as H
from ..operators import masks as M
from ..sources import views as V
from ..sources.views import query, rnd
from .metrics import NC, ceiling

L3, L4 = 3, 4  # at size 4 few labels are common, at size 3 all are


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def design(s, d):
    """(subject, order, image): orders 1.. of each subject."""
    return V.table(s, d, "orders").selectExpr("cast(o_custkey % 5 as int) as subject", "o_orderkey as order", "o_custkey + 1 as image")


def numbered(s, d):
    """Trials with session numbers: (subject, session, trial, stim_id)."""
    return V.table(s, d, "lineitem").selectExpr("cast(l_suppkey % 5 as int) as subject", "l_linenumber as session",
                                                "l_orderkey as trial", "l_partkey as stim_id")


def fil1(s, d):
    return M.keep_masked(V.responses(s, d), V.mask(s, d)).groupBy("subject", "voxel").agg(
        F.count("*").alias("n"), rounded(F.sum("val")).alias("total"))


def fil2(s, d):
    return M.labels_in_mask(V.labels_raw(s, d), V.mask(s, d))


def fil3(s, d):
    return M.mask_summary(M.analysis_mask(V.labels_raw(s, d), V.mask(s, d), "labelled", 2)).withColumn("fraction", rounded("fraction"))


def fil4(s, d):
    second = V.labels_raw(s, d).select("subject", "voxel", (F.col("voxel") % 3).alias("label"))
    return M.merge_atlases([(V.labels_raw(s, d), 0), (None, 100), (second, 200)])


def fil5(s, d):
    return M.split_of_order(design(s, d), "order", 1000).groupBy("subject", "split").agg(F.count("*").alias("n"))


def fil6(s, d):
    t = numbered(s, d).select("subject", F.col("trial").alias("order"), "session")
    return M.trial_stimulus(t, design(s, d)).groupBy("subject", "stim_id").agg(F.count("*").alias("n"))


def fil7(s, d):
    return M.first_sessions(numbered(s, d), 3).groupBy("subject", "session").agg(F.count("*").alias("n"))


def fil8(s, d):
    return M.session_of_trial(numbered(s, d).drop("session"), "trial", 750, 12_000).groupBy("subject", "session").agg(F.count("*").alias("n"))


def fil9(s, d):
    a = M.item_order(numbered(s, d), order="first_seen").withColumnRenamed("row_idx", "seen_idx")
    return a.join(M.item_order(numbered(s, d), order="sorted"), ["subject", "stim_id"])


def fil10(s, d):
    rows = V.table(s, d, "embeddings").select(F.col("vec_id").alias("row_idx"))
    want = s.range(0, 2000, 3).select((F.col("id")).alias("row_idx"))
    kept, counts = M.rows_at(rows, want)
    return kept.agg(F.sum("row_idx").alias("total")).crossJoin(counts)  # one row each


def fil11(s, d):
    return M.reliable_channels(ceiling(s, d), 0.1).groupBy("subject").agg(F.count("*").alias("n"))


def fil12(s, d):
    t = M.parse_thresholds([0.1, 0.3, 0.1, 0.05, 1])
    parts = V.table(s, d, "part").select((F.col("p_partkey") % 5).alias("k")).distinct()
    rows = parts.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in t])))
    return rows.select("k", "threshold", M.threshold_token(F.col("threshold")).alias("token"))


def har1(s, d):
    return H.label_sizes(V.labels_raw(s, d), L4)


def har2(s, d):
    return H.common_labels(V.labels_raw(s, d), L3)


def har3(s, d):
    return H.require_common(H.common_labels(V.labels_raw(s, d), L3), 10)


def har4(s, d):
    return H.harmonize(V.labels_raw(s, d), L4)


def _summary(df):
    return df.select(*[_joined(c) if c in ("empty", "small") else rounded(c).alias(c) if c in (
        "labeled_fraction", "mean_size", "median_size") else F.col(c) for c in df.columns])


def har5(s, d):
    return _summary(H.utilization_summary(V.labels_raw(s, d), 18, L4))


def har6(s, d):
    out = H.utilization_report(H.utilization_summary(V.labels_raw(s, d), 16, L3, 0.88))
    return out.select(*[_joined(c) if c == "warned" else rounded(c).alias(c) for c in out.columns])


def har7(s, d):
    return _summary(H.parcel_qc(V.labels_raw(s, d), 18, L4))


def har8(s, d):
    return H.drop_reasons(V.labels_raw(s, d), L4)


def har8b(s, d):
    return H.reason_counts(H.drop_reasons(V.labels_raw(s, d), L4))


def har9(s, d):
    a = H.retained_coverage(V.labels_raw(s, d), V.mask(s, d), 2).select("subject", rounded("coverage").alias("masked"))
    return a.join(H.retained_coverage(V.labels_raw(s, d), None, L3).select("subject", rounded("coverage").alias("whole")), "subject")


QUERIES = {"FIL1_keep_masked": fil1, "FIL2_labels_in_mask": fil2, "FIL3_analysis_mask": fil3, "FIL4_merge_atlases": fil4,
           "FIL5_split_of_order": fil5, "FIL6_trial_stimulus": fil6, "FIL7_first_sessions": fil7, "FIL8_session_of_trial": fil8,
           "FIL9_item_order": fil9, "FIL10_rows_at": fil10, "FIL11_reliable_channels": fil11, "FIL12_threshold_tokens": fil12,
           "HAR1_label_sizes": har1, "HAR2_common_labels": har2, "HAR3_require_common": har3, "HAR4_harmonize": har4,
           "HAR5_utilization_summary": har5, "HAR6_utilization_report": har6, "HAR7_parcel_qc": har7, "HAR8_drop_reasons": har8,
           "HAR8_reason_counts": har8b, "HAR9_retained_coverage": har9}

_N = "numbered as (select (l_suppkey % 5)::int as subject, l_linenumber as session, l_orderkey as trial, l_partkey as stim_id from lineitem)"
_D = "design as (select (o_custkey % 5)::int as subject, o_orderkey as \"order\", o_custkey + 1 as image from orders)"


def _common(src, m, name="common"):
    return (f"{name} as (select label from (select subject, label from {src} where label > 0 group by 1, 2 having count(*) >= {m}) "
            f"group by 1 having count(*) = (select count(distinct subject) from {src}))")


def _inside(name="inside"):
    return (f"{name} as (select m.subject, m.voxel, coalesce(label, 0) as label from mask m left join labels_raw l "
            "on m.subject = l.subject and m.voxel = l.voxel where in_mask)")


def _stats(m, n, where):
    return f"""
grid as (select subject, label from (select distinct subject from labels_raw), unnest(range(1, {n} + 1)) u(label)),
cnt as (select g.subject, g.label, count(l.voxel) as n from grid g left join labels_raw l on g.subject = l.subject and g.label = l.label group by 1, 2),
st as (select subject, count(*) filter (where n > 0) as present, min(n) filter (where {where}) as min_size, median(n) filter (where {where}) as median_size,
  avg(n) filter (where {where}) as mean_size, max(n) filter (where {where}) as max_size,
  coalesce(string_agg(label::varchar, ',' order by label) filter (where n = 0), '') as empty,
  coalesce(string_agg(label::varchar, ',' order by label) filter (where n > 0 and n < {m}), '') as small from cnt group by 1),
sh as (select subject, avg((label > 0)::int) as labeled_fraction from labels_raw group by 1)"""


_NEW = "re as (select label, row_number() over (order by label) as new_label from common)"
ORACLE_SQL = {
    "FIL1_keep_masked": query("responses mask", f"select subject, voxel, count(*) as n, {rnd('sum(val)')} as total from responses "
                              "join mask using (subject, voxel) where in_mask group by 1, 2"),
    "FIL2_labels_in_mask": query("labels_raw mask", f", {_inside()} select * from inside"),
    "FIL3_analysis_mask": query("labels_raw mask", f""", {_inside()}, {_common('inside', 2)}
select subject, count(*) filter (where k) as kept, count(*) filter (where not k) as dropped, {rnd('avg(k::int)')} as fraction
from (select subject, label in (select label from common) as k from inside) group by 1"""),
    "FIL4_merge_atlases": query("labels_raw", "select subject, voxel, case when label > 0 then label else voxel % 3 + 200 end as label "
                                "from labels_raw where label > 0 or voxel % 3 > 0"),
    "FIL5_split_of_order": f"with {_D} select subject, case when \"order\" > 1000 then 'train' else 'test' end as split, count(*) as n from design group by 1, 2",
    "FIL6_trial_stimulus": f"with {_N}, {_D} select n.subject, image - 1 as stim_id, count(*) as n from numbered n join design d "
                           "on n.subject = d.subject and n.trial = d.\"order\" group by 1, 2",
    "FIL7_first_sessions": f"with {_N} select subject, session, count(*) as n from (select *, dense_rank() over (partition by subject order by session) as k "
                           "from numbered) where k <= 3 group by 1, 2",
    "FIL8_session_of_trial": f"with {_N} select subject, (trial // 750 + 1)::int as session, count(*) as n from numbered where trial < 12000 group by 1, 2",
    "FIL9_item_order": f"""with {_N} select subject, stim_id, (row_number() over (partition by subject order by f, stim_id) - 1)::int as seen_idx,
  (row_number() over (partition by subject order by stim_id) - 1)::int as row_idx
from (select subject, stim_id, min(trial) as f from numbered group by 1, 2)""",
    "FIL10_rows_at": """with w as (select unnest(range(0, 2000, 3)) as r)
select (sum(vec_id))::bigint as total, count(vec_id) as n_kept, count(*) filter (where vec_id is null) as n_dropped from w left join embeddings on r = vec_id""",
    "FIL11_reliable_channels": query("trials", f", {NC} select subject, count(*) as n from nc where nc >= 0.1 group by 1"),
    "FIL12_threshold_tokens": "select k, threshold, token from (select distinct p_partkey % 5 as k from part), "
                              "(values (0.05::double, '0p05'), (0.1, '0p1'), (0.3, '0p3'), (1.0, '1')) t(threshold, token)",
    "HAR1_label_sizes": query("labels_raw", "select subject, label, count(*) as n from labels_raw where label > 0 group by 1, 2 having count(*) >= 4"),
    "HAR2_common_labels": query("labels_raw", f", {_common('labels_raw', L3)} select label from common"),
    "HAR3_require_common": query("labels_raw", f", {_common('labels_raw', L3)} select count(*) as n_common from common"),
    "HAR4_harmonize": query("labels_raw", f", {_common('labels_raw', L4)}, {_NEW} select subject, voxel, coalesce(new_label, 0)::int as label "
                            "from labels_raw left join re using (label)"),
    "HAR5_utilization_summary": query("labels_raw", f""", {_stats(L4, 18, 'n > 0')}
select subject, {rnd('labeled_fraction')} as labeled_fraction, present, min_size, {rnd('median_size')} as median_size, {rnd('mean_size')} as mean_size, max_size,
  empty, small, (labeled_fraction < 0.5 or empty <> '' or small <> '') as warn from st join sh using (subject)"""),
    "HAR6_utilization_report": query("labels_raw", f""", {_stats(L3, 16, 'n > 0')}
select {rnd('min(labeled_fraction)')} as min_fraction, {rnd('median(labeled_fraction)')} as median_fraction, {rnd('max(labeled_fraction)')} as max_fraction,
  {rnd('min(present)')} as min_present, {rnd('median(present)')} as median_present, {rnd('max(present)')} as max_present,
  coalesce(string_agg(subject::varchar, ',' order by subject) filter (where labeled_fraction < 0.88 or empty <> '' or small <> ''), '') as warned
from st join sh using (subject)"""),
    "HAR7_parcel_qc": query("labels_raw", f""", {_stats(L4, 18, 'true')}
select subject, present, min_size, {rnd('median_size')} as median_size, {rnd('mean_size')} as mean_size, max_size, empty, small from st"""),
}
_REASON = """
g as (select s.subject, l.label from (select distinct subject from labels_raw) s, (select distinct label from labels_raw where label > 0) l),
rs as (select g.subject, g.label, count(r.voxel) as n from g left join labels_raw r on g.subject = r.subject and g.label = r.label group by 1, 2),
why as (select *, case when n = 0 then 'absent' when n < 4 then 'small' when label not in (select label from common) then 'not_common' else 'kept' end as reason from rs)"""
ORACLE_SQL |= {
    "HAR8_drop_reasons": query("labels_raw", f", {_common('labels_raw', L4)}, {_REASON} select subject, label, n, reason from why"),
    "HAR8_reason_counts": query("labels_raw", f""", {_common('labels_raw', L4)}, {_REASON}
select subject, """ + ", ".join(f"count(*) filter (where reason = '{r}') as {r}" for r in ("absent", "small", "not_common", "kept")) + " from why group by 1"),
    "HAR9_retained_coverage": query("labels_raw mask", f""", {_inside()}, {_common('inside', 2, 'c1')}, {_common('labels_raw', L3, 'c2')},
a as (select subject, {rnd('avg((label in (select label from c1))::int)')} as masked from inside group by 1),
b as (select subject, {rnd('avg((label in (select label from c2))::int)')} as whole from labels_raw group by 1)
select * from a join b using (subject)"""),
}

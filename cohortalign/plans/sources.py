"""Queries for SRC1-SRC13 and SNK1-SNK5."""

from pyspark.sql import functions as F

from ..functions.common import rounded, shared_path
from ..operators import sources as S
from ..sources import views as V
from ..sources.views import query, rnd


def series(s, d):
    return S.session_run(V.listing(s, d).select("name"))


def motion(s, d):
    return S.session_run(V.listing(s, d).where("motion_name is not null").select(F.col("motion_name").alias("name")).distinct())


def src1(s, d):
    r = V.responses(s, d).withColumn("split", F.when(F.col("stim_id") > 40, "train").otherwise("test"))
    return S.subject_scan(r, 2, ["stim_id", "voxel", "val"], "test").withColumn("val", rounded("val"))


def src2(s, d):
    r = V.table(s, d, "events").selectExpr("cast(user_id % 3 as int) as subject", "user_id div 3 + 1 as run").where("(subject * 5 + run) % 23 <> 0")
    return S.gapless_runs(r).groupBy("subject", "run").agg(F.count("*").alias("n_steps"))


def _kind(s, d, kind):
    e = V.table(s, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return e.select(F.col("vec_id").alias("stim_id"), (F.slice("v", 1, 48) if kind == "a" else F.slice("v", 49, 16)).alias("vec"))


def src3(s, d):
    ids = V.table(s, d, "orders").select(F.col("o_orderkey").alias("stim_id"), F.col("o_custkey").alias("row_idx"))
    out = S.feature_lookup(ids, _kind(s, d, "a"), strict=False)
    return out.select("stim_id", "row_idx", rounded(F.col("vec")[0]).alias("first"), F.lit(False).alias("missing")).union(
        S.out_of_range(ids, _kind(s, d, "a")).select("stim_id", "row_idx", F.lit(None).cast("double"), F.lit(True)))


def src4(s, d):
    c = S.composite_features(_kind(s, d, "a"), _kind(s, d, "b"))
    return c.select("stim_id", F.size("vec").alias("width"), rounded(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def src5(s, d):
    return S.discover_sessions(V.listing(s, d))


def src6(s, d):
    more = V.listing(s, d).select(F.concat(F.lit("Run-0"), (F.col("id") % 4).cast("string"), F.lit("_SES-"), F.col("id").cast("string"), F.lit(".nii")).alias("name"))
    last = V.listing(s, d).select(F.concat(F.lit("bold_run"), F.col("id").cast("string")).alias("name"))
    return S.session_run(V.listing(s, d).select("name").union(more).union(last).union(V.listing(s, d).select(F.lit("readme").alias("name")).limit(1)))


def src7(s, d):
    return S.match_motion(series(s, d), motion(s, d))


def _design(s, d):
    return V.table(s, d, "events").selectExpr("cast(user_id % 25 as int) as file", "event_id as row", "cast(event_id % 3 as int) as col",
                                              "case when event_id % 3 = 0 then 1.0D when user_id % 25 % 3 = 0 then 0.0D else value end as val")


def src8(s, d):
    return S.rest_designs(_design(s, d))


def src8_runs(s, d):
    designs = V.listing(s, d).select(F.col("id").cast("int").alias("file"), F.regexp_replace("name", "timeseries", "design").alias("name"))
    designs = S.session_run(designs).drop("name")
    return S.rest_runs(series(s, d), designs, S.rest_designs(_design(s, d)))


def src9(s, d):
    m = S.run_manifest(S.match_motion(series(s, d), motion(s, d)))
    path = shared_path(s, "manifest")
    back = S.load_or_build_manifest(s, path, lambda: m)
    return back.select(F.col("session").cast("int").alias("session"), F.array_join("runs", ",").alias("runs"), F.size("runs").alias("n"))


def _runs(s, d):
    from .timeseries import runs

    return runs(s, d)


def src10(s, d):
    a, _ = S.run_inventory(_runs(s, d))
    return a.select("subject", "n_runs", "min_steps", rounded("median_steps").alias("median_steps"), "max_steps",
                    F.array_join(F.transform("steps", lambda x: F.format_string("%.3f", x)), ",").alias("steps"))


def src10_bins(s, d):
    return S.run_inventory(_runs(s, d))[1]


def src11(s, d):
    docs = V.table(s, d, "documents").select("doc_id", F.split("text", "\n").alias("c"))
    docs = docs.withColumn("c", F.when(F.col("doc_id") % 17 == 3, F.array(F.lit("  "), F.lit(""))).otherwise(F.col("c")))
    c = S.clean_captions(F.col("c"))
    return docs.select("doc_id", F.size(c).alias("n"), F.md5(F.array_join(c, "|")).alias("joined"))


def src12(s, d):
    e = V.table(s, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    return S.mean_pool(e, "label", "vec").select("label", F.posexplode("vec").alias("i", "x")).withColumn("x", rounded("x"))


def _lengths(pdf):
    import pandas as pd

    text = pdf["text"].fillna("")
    return pd.DataFrame({"stim_id": pdf["stim_id"], "vec": [[float(len(t)), float(t.count("\n")), float(len(set(t)))] for t in text]})


def src13(s, d):
    docs = V.table(s, d, "documents").select(F.col("doc_id").alias("stim_id"), "text")
    done = docs.where("stim_id % 4 = 1").select("stim_id")
    out = S.featurise(docs, _lengths, "stim_id long, vec array<double>", done)
    return out.select("stim_id", *[F.col("vec")[i].cast("long").alias(n) for i, n in enumerate(("chars", "breaks", "distinct_chars"))])


def _record(s, d):
    from .metrics import corr

    return corr(s, d).groupBy("subject").agg(rounded(F.median("r")).alias("median_r"), F.count("*").alias("n_voxels"))


def snk2(s, d):
    path = shared_path(s, "metrics")
    S.write_metrics(_record(s, d), path)
    return s.read.schema("subject int, median_r double, n_voxels long").json(path)


def snk3(s, d):
    path = shared_path(s, "summary")
    r = V.repeats(s, d)
    S.write_summary_csv([r.where("rep = 0").select("condition", F.col("metric").alias("first")),
                         r.groupBy("condition").agg(F.max("metric").alias("top"), F.count("*").alias("n"))], path)
    out = s.read.option("header", True).csv(path)
    return out.select(F.col("condition").cast("int").alias("condition"), rounded(F.col("first").cast("double")).alias("first"),
                      rounded(F.col("top").cast("double")).alias("top"), F.col("n").cast("long").alias("n"))


def snk4(s, d):
    path = shared_path(s, "trials")
    t = V.trial_log(s, d).select("number", "state", F.create_map(F.lit("alpha"), F.col("value"), F.lit("k"), F.col("seconds").cast("double")).alias("params"))
    S.write_trial_log(t, ["alpha", "k"], path)
    out = s.read.option("header", True).csv(path)
    return out.select(F.col("number").cast("long").alias("number"), "state", rounded(F.col("params_alpha").cast("double")).alias("alpha"),
                      F.col("params_k").cast("double").alias("k"))


def snk5(s, d):
    return S.subject_summaries(V.responses(s, d), V.mask(s, d)).withColumn("mask_fraction", rounded("mask_fraction"))


QUERIES = {"SRC1_subject_scan": src1, "SRC2_gapless_runs": src2, "SRC3_feature_lookup": src3, "SRC4_composite_features": src4, "SRC5_discover_sessions": src5,
           "SRC6_session_run": src6, "SRC7_match_motion": src7, "SRC8_rest_designs": src8, "SRC8_rest_runs": src8_runs, "SRC9_run_manifest": src9,
           "SRC10_run_inventory": src10, "SRC10_length_bins": src10_bins, "SRC11_clean_captions": src11, "SRC12_mean_pool": src12, "SRC13_featurise": src13,
           "SNK2_write_metrics": snk2, "SNK3_write_summary_csv": snk3, "SNK4_write_trial_log": snk4, "SNK5_subject_summaries": snk5}


def _sr(src):
    """(name, session, run) of names with the session before the run or with a run alone."""
    return (f"select name, nullif(regexp_extract(name, 'session(\\d+)', 1), '')::int as session, regexp_extract(name, 'run(\\d+)', 1)::int as run from {src}")


_SRC7 = f"""se as ({_sr('listing')}), mo as ({_sr('(select distinct motion_name as name from listing where motion_name is not null)')}),
ex as (select session, run, min(name) as m from mo where session is not null group by 1, 2),
lo as (select run, min(name) as m from mo where session is null group by 1 having count(*) = 1),
ma as (select se.name, se.session, se.run, coalesce(ex.m, lo.m) as motion_file from se left join ex on se.session = ex.session and se.run = ex.run left join lo on se.run = lo.run)"""
from .metrics import CORR  # noqa: E402
from .timeseries import _RUNS  # noqa: E402

_DES = """de as (select (user_id % 25)::int as file, bool_and(user_id % 25 % 3 = 0 or abs("value") < 1e-12) as is_rest from events where event_id % 3 <> 0 group by 1)"""
ORACLE_SQL = {
    "SRC1_subject_scan": query("responses", f"select stim_id, voxel, {rnd('val')} as val from responses where subject = 2 and stim_id <= 40"),
    "SRC2_gapless_runs": """with r as (select (user_id % 3)::int as subject, user_id // 3 + 1 as run from events where ((user_id % 3) * 5 + user_id // 3 + 1) % 23 <> 0),
k as (select subject, run, row_number() over (partition by subject order by run) as k from (select distinct subject, run from r))
select subject, run, count(*) as n_steps from r join k using (subject, run) where run = k group by 1, 2""",
    "SRC3_feature_lookup": f"""select o_orderkey as stim_id, o_custkey as row_idx, {rnd('embedding[1]::double')} as first, vec_id is null as missing
from orders left join embeddings on o_orderkey = vec_id""",
    "SRC4_composite_features": f"select vec_id as stim_id, 64 as width, {rnd('list_sum(embedding::double[])')} as total from embeddings",
    "SRC5_discover_sessions": query("listing", "select distinct id // 3 as session from listing").replace("id // 3", "(id // 3)::int"),
    "SRC6_session_run": query("listing", """select name, (id // 3)::int as session, regexp_extract(name, 'run(\\d+)', 1)::int as run from listing
union all select 'Run-0' || id % 4 || '_SES-' || id || '.nii', id::int, (id % 4)::int from listing
union all select 'bold_run' || id, null, id::int from listing union all select 'readme', null, null"""),
    "SRC7_match_motion": query("listing", f", {_SRC7} select * from ma"),
    "SRC8_rest_designs": f"with {_DES} select * from de",
    "SRC8_rest_runs": query("listing", f""", {_DES}, li as (select id, name, (id // 3)::int as session, regexp_extract(name, 'run(\\d+)', 1)::int as run from listing)
select distinct a.name from li a join li b on a.session = b.session and a.run = b.run join de on de.file = b.id where is_rest"""),
    "SRC9_run_manifest": query("listing", f", {_SRC7} select session, string_agg(name, ',' order by name) as runs, count(*) as n from ma group by 1"),
    "SRC10_run_inventory": query("ts_", f""", {_RUNS} select subject, count(*) as n_runs, min(n_steps) as min_steps, {rnd('median(n_steps)')} as median_steps,
  max(n_steps) as max_steps, array_to_string(list_transform(list_sort(list(distinct step) filter (where step is not null)), lambda x: format('{{:.3f}}', x)), ',') as steps
from runs group by 1"""),
    "SRC10_length_bins": query("ts_", f", {_RUNS} select subject, (n_steps // 10) * 10 as bin, count(*) as n from runs group by 1, 2"),
    "SRC11_clean_captions": """with c as (select doc_id, list_filter(list_transform(case when doc_id % 17 = 3 then ['  ', ''] else string_split(text, chr(10)) end, lambda x: trim(x, ' ')),
  lambda x: x <> '') as c from documents)
select doc_id, greatest(1, len(c)) as n, md5(array_to_string(c, '|')) as joined from c""",
    "SRC12_mean_pool": query("trials", f"select stim_id as label, voxel as i, {rnd('avg(val)')} as x from trials group by 1, 2"),
    "SRC13_featurise": """select doc_id as stim_id, length(text) as chars, length(text) - length(replace(text, chr(10), '')) as breaks,
  len(list_distinct(string_split(text, ''))) as distinct_chars from documents where doc_id % 4 <> 1""",
    "SNK2_write_metrics": query("prediction", f", {CORR} select subject, {rnd('median(r)')} as median_r, count(*) as n_voxels from corr group by 1"),
    "SNK3_write_summary_csv": query("repeats", f"""select condition, {rnd('metric')} as first, null::double as top, null::bigint as n from repeats where rep = 0
union all select condition, null, {rnd('max(metric)')}, count(*) from repeats group by 1"""),
    "SNK4_write_trial_log": query("trial_log", f"select number, state, {rnd('\"value\"')} as alpha, seconds::double as k from trial_log"),
    "SNK5_subject_summaries": query("responses mask", f"""select * from (select subject, count(*) as n_cells, count(distinct stim_id) as n_items, count(distinct voxel) as n_voxels
  from responses group by 1) join (select subject, count(*) filter (where in_mask) as n_mask, {rnd('avg(in_mask::int)')} as mask_fraction from mask group by 1) using (subject)"""),
}

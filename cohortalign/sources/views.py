"""Response-modelling tables derived from the given ones, in Spark and as SQL.

Each view has a Spark function of (spark, sf_dir) and, in ``SQL``, the text of the same common table
expression, with the names of those it builds on. ``query(names, body)`` makes a
full statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark, d):
    """Responses of five subjects: (subject, stim_id, vec_id, voxel, val)."""
    e = table(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 5).cast("int").alias("subject"), F.expr("vec_id div 5").alias("stim_id"), "vec_id",
                    F.posexplode("embedding").alias("voxel", "val")).withColumn("val", F.col("val").cast("double"))


def responses(spark, d):
    return cells(spark, d).where("(stim_id * 7 + subject * 3) % 10 <> 0").select("subject", "stim_id", "voxel", "val")


def response_rows(spark, d):
    """The same with one row per (subject, item): (subject, stim_id, v array<double>)."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 5).cast("int").alias("subject"),
                                             F.expr("vec_id div 5").alias("stim_id"), F.col("embedding").cast("array<double>").alias("v"))
    return e.where("(stim_id * 7 + subject * 3) % 10 <> 0")


def labels_raw(spark, d):
    v = cells(spark, d).select("subject", "voxel").distinct()
    return v.withColumn("label", F.expr("case when (voxel + subject) % 9 = 0 then 0 else 1 + cast(floor(voxel / 4.0) as int) end"))


def mask(spark, d):
    v = cells(spark, d).select("subject", "voxel").distinct()
    return v.select("subject", "voxel", F.expr("voxel % 4").alias("x"), F.expr("voxel div 4 % 4").cast("int").alias("y"),
                    F.expr("voxel div 16").cast("int").alias("z"), F.expr("(voxel * 7 + subject) % 10 <> 3").alias("in_mask"))


def ts(spark, d):
    """Multivariate time series: (run, voxel, t, x), eight channels."""
    return channels(spark, d, 8).selectExpr("user_id as run", "voxel", "t", "x")


def channels(spark, d, n: int):
    """Events of each user in order of time, with values for n channels: (user_id, voxel, t, x). Steps are numbered
    before channels are made, so that the sort is of the events alone."""
    e = table(spark, d, "events").selectExpr("user_id", "event_id", "value", "row_number() over (partition by user_id order by ts, event_id) - 1 as t")
    e = e.withColumn("voxel", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return e.selectExpr("user_id", "voxel", "t", "value * (((voxel * 37 + event_id * 11) % 101) + 1) / 101.0D as x")


def channel_rows(spark, d, n: int):
    """The same with one row a step: (user_id, t, v array<double>). Only the events are shuffled and sorted; values are made after that, and rows come
    by user, so that what is grouped by user moves no values."""
    e = table(spark, d, "events").selectExpr("user_id", "event_id", "value", "row_number() over (partition by user_id order by ts, event_id) - 1 as t")
    return e.select("user_id", "t", F.array(*[F.expr(f"value * ((({i} * 37 + event_id * 11) % 101) + 1) / 101.0D") for i in range(n)]).alias("v"))


def motion(spark, d):
    p = [f"(event_id * {k} % 1000) * {s}D as p{i}" for i, (k, s) in enumerate(MOTION, 1)]
    return table(spark, d, "events").selectExpr(
        "user_id as run", "row_number() over (partition by user_id order by ts, event_id) - 1 as t", *p)


MOTION = [(20, "0.0002"), (33, "0.0002"), (46, "0.0002"), (59, "0.000004"), (72, "0.000004"), (85, "0.000004")]


def trials(spark, d):
    """Repeated trials of ten items: (stim_id, trial, vec_id, voxel, val)."""
    e = table(spark, d, "embeddings").selectExpr(
        "label as stim_id", "row_number() over (partition by label order by vec_id) - 1 as trial", "vec_id", "embedding")
    return e.select("stim_id", "trial", "vec_id", F.posexplode("embedding").alias("voxel", "val")).withColumn(
        "val", F.col("val").cast("double"))


def repeats(spark, d):
    return table(spark, d, "lineitem").groupBy(
        F.col("l_linenumber").alias("condition"), (F.col("l_orderkey") % 5).cast("int").alias("rep")).agg(
        F.round(F.avg("l_discount"), 10).alias("metric"))


def prediction(spark, d):
    """Held-out prediction: (subject, stim_id, voxel, y, p), p the other subjects' mean."""
    r = responses(spark, d)
    s = r.groupBy("stim_id", "voxel").agg(F.sum("val").alias("s"), F.count("*").alias("n"))
    return r.join(s, ["stim_id", "voxel"]).where("n > 1").select(
        "subject", "stim_id", "voxel", F.col("val").alias("y"), ((F.col("s") - F.col("val")) / (F.col("n") - 1)).alias("p"))


def listing(spark, d):
    """File names: one series per nation, one motion file for most."""
    n = table(spark, d, "nation")
    return n.selectExpr("n_nationkey as id", "format_string('timeseries_session%02d_run%02d.nii.gz', n_nationkey div 3, n_regionkey + 1) as name",
                        "case when n_nationkey % 4 <> 0 then format_string('motion_session%02d_run%02d.tsv', n_nationkey div 3, n_regionkey + 1) "
                        "when n_nationkey % 8 = 0 then format_string('motion_run%02d.tsv', n_regionkey + 1) end as motion_name")


def trial_log(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey as number", "case o_orderstatus when 'F' then 'COMPLETE' when 'O' then 'PRUNED' else 'FAIL' end as state",
        "o_totalprice as value", "o_orderdate as started", "cast(o_custkey % 600 as int) as seconds")


SQL: dict[str, tuple[str, str]] = {
    "cells": ("", "select (vec_id % 5)::int as subject, vec_id // 5 as stim_id, vec_id, "
                  "unnest(range(len(embedding)))::int as voxel, unnest(embedding)::double as val from embeddings"),
    "responses": ("cells", "select subject, stim_id, voxel, val from cells where (stim_id * 7 + subject * 3) % 10 <> 0"),
    "labels_raw": ("cells", "select subject, voxel, case when (voxel + subject) % 9 = 0 then 0 else 1 + floor(voxel / 4.0)::int end as label "
                            "from (select distinct subject, voxel from cells)"),
    "mask": ("cells", "select subject, voxel, voxel % 4 as x, voxel // 4 % 4 as y, voxel // 16 as z, (voxel * 7 + subject) % 10 <> 3 as in_mask "
                      "from (select distinct subject, voxel from cells)"),
    "ts_": ("", "select user_id as run, ch::int as voxel, row_number() over (partition by user_id, ch order by ts, event_id) - 1 as t, "
               "\"value\" * (((ch * 37 + event_id * 11) % 101) + 1) / 101.0::double as x from events, unnest(range(0, 8)) u(ch)"),
    "motion": ("", "select user_id as run, row_number() over (partition by user_id order by ts, event_id) - 1 as t, " + ", ".join(
        f"(event_id * {k} % 1000) * {s}::double as p{i}" for i, (k, s) in enumerate(MOTION, 1)) + " from events"),
    "trials": ("", "select label as stim_id, trial, vec_id, unnest(range(len(embedding)))::int as voxel, unnest(embedding)::double as val from "
                   "(select *, row_number() over (partition by label order by vec_id) - 1 as trial from embeddings)"),
    "repeats": ("", "select l_linenumber as condition, (l_orderkey % 5)::int as rep, round(avg(l_discount), 10) as metric from lineitem group by 1, 2"),
    "prediction": ("responses", "select r.subject, stim_id, voxel, r.val as y, (s - r.val) / (n - 1) as p from responses r join "
                                "(select stim_id, voxel, sum(val) as s, count(*) as n from responses group by 1, 2) using (stim_id, voxel) where n > 1"),
    "listing": ("", "select n_nationkey as id, format('timeseries_session{:02d}_run{:02d}.nii.gz', n_nationkey // 3, n_regionkey + 1) as name, "
                    "case when n_nationkey % 4 <> 0 then format('motion_session{:02d}_run{:02d}.tsv', n_nationkey // 3, n_regionkey + 1) "
                    "when n_nationkey % 8 = 0 then format('motion_run{:02d}.tsv', n_regionkey + 1) end as motion_name from nation"),
    "trial_log": ("", "select o_orderkey as number, case o_orderstatus when 'F' then 'COMPLETE' when 'O' then 'PRUNED' else 'FAIL' end as state, "
                      "o_totalprice as \"value\", o_orderdate as started, (o_custkey % 600)::int as seconds from orders"),
}


def query(names: str, body: str) -> str:
    """``with`` the named views and all that they build on, then ``body``; a body that
    begins with a comma goes on with further expressions."""
    order: list[str] = []

    def need(name):
        for n in SQL[name][0].split():
            need(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        need(n)
    head = "with " + ",\n".join(f"{n} as ({SQL[n][1]})" for n in order)
    return f"{head}\n{body}" if order else body


def rnd(expr: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0"


#: Guarded correlation as SQL text.
def corr_sql(x: str, y: str) -> str:
    return (f"case when stddev_pop({x}) < 1e-10 or stddev_pop({y}) < 1e-10 then 0.0 "
            f"else covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) end")

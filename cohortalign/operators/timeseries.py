"""Cleaning of multivariate time series (TS1-TS17).

Long form (run, voxel, t, x). The window forms are built-in expressions; the filter,
the regression on many confounds and the whole chain run in Arrow groups of (run, block of
channels), never of a run or subject alone, so that groups stay small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.common import draw_key, fresh, require
from ..functions.matrices import aligned, to_long, to_matrix

P = [f"p{i}" for i in range(1, 7)]
MODELS = ("none", "motion6", "motion12", "friston24")
HEAD_MM = 50.0
MIN_STEPS = 30
BLOCK = 256  # channels per group


def trim(df: DataFrame, n: int) -> DataFrame:
    """TS1: without the first n steps; steps count from 0 again."""
    return df.where(F.col("t") >= n).withColumn("t", F.col("t") - n)


def length_gate(df: DataFrame, min_steps: int = MIN_STEPS, keys: list[str] = ["run", "voxel"]) -> DataFrame:
    """TS2: without series shorter than ``min_steps``."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= min_steps).drop("_n")


def detrend(df: DataFrame, keys: list[str] = ["run", "voxel"], value: str = "x") -> DataFrame:
    """TS3: residual of the least-squares line on t."""
    w = Window.partitionBy(*keys)
    mt, mx = F.avg("t").over(w), F.avg(value).over(w)
    slope = F.coalesce(F.try_divide(F.covar_pop("t", value).over(w), F.var_pop("t").over(w)), F.lit(0.0))
    return df.withColumn(value, F.col(value) - (mx + slope * (F.col("t") - mt)))


def _grouped(df: DataFrame, function, keys: list[str], value: str = "x") -> DataFrame:
    """Applies function(matrix of steps x channels) to each (keys, channel block)."""
    cols = [*keys, "voxel", "t", value]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)

    def one(rows: pa.Table) -> pa.Table:
        steps, names, m = to_matrix(rows, "t", "voxel", value)
        kinds = {c: rows.schema.field(c).type for c in cols}
        return to_long(function(m), steps, names, {k: rows.column(k)[0] for k in keys}, kinds, "t", "voxel", value)

    blocks = df.select(*cols, (F.col("voxel") / BLOCK).cast("int").alias("_b"))
    return blocks.groupBy(*keys, "_b").applyInArrow(one, schema)


def highpass(df: DataFrame, cutoff_hz: float = 0.01, step: float = 1.333, order: int = 5, keys: list[str] = ["run"]) -> DataFrame:
    """TS4: Butterworth high-pass, forward and backward."""
    return _grouped(df, lambda m: filters.highpass(m, cutoff_hz, step, order), keys)


def framewise_displacement(motion: DataFrame, keys: list[str] = ["run"]) -> DataFrame:
    """TS5: adds ``fd``: summed absolute first differences, rotations as arcs of a 50 mm sphere; 0 at the first step."""
    w = Window.partitionBy(*keys).orderBy("t")
    parts = [F.abs(F.col(p) - F.lag(p).over(w)) * (HEAD_MM if i > 2 else 1.0) for i, p in enumerate(P)]
    return motion.withColumn("fd", F.coalesce(sum(parts[1:], parts[0]), F.lit(0.0)))


def censor(df: DataFrame, fd: DataFrame, limit: float = 0.5, max_share: float = 0.3, keys: list[str] = ["run"]) -> DataFrame:
    """TS6: without steps of displacement above the limit, and without runs of which more than
    ``max_share`` would go. Runs without motion stay as they are."""
    w = Window.partitionBy(*keys)
    steps = fd.select(*keys, "t", (F.col("fd") <= limit).alias("_ok"))
    steps = steps.withColumn("_run_ok", F.avg((~F.col("_ok")).cast("double")).over(w) <= max_share)
    out = df.join(steps, [*keys, "t"], "left")
    return out.where(F.coalesce(F.col("_ok") & F.col("_run_ok"), F.lit(True))).drop("_ok", "_run_ok")


def motion_confounds(motion: DataFrame, model: str = "friston24", standardize: bool = True, keys: list[str] = ["run"]) -> DataFrame:
    """TS7: columns c1.. of 6, 12 (with first differences) or 24 (with squares) confounds."""
    w = Window.partitionBy(*keys).orderBy("t")
    base = [F.col(p) for p in P]
    diff = [F.coalesce(F.col(p) - F.lag(p).over(w), F.lit(0.0)) for p in P]
    names = {"none": [], "motion6": base, "motion12": base + diff, "friston24": base + diff}
    if model not in MODELS:
        raise ValueError(f"unknown motion model {model}")
    cols = [f"c{i}" for i in range(1, len(names[model]) + 1)]
    out = motion.select(*keys, "t", *[c.alias(n) for n, c in zip(cols, names[model])])
    if model == "friston24":
        out = out.select("*", *[(F.col(c) * F.col(c)).alias(f"c{i}") for i, c in enumerate(cols, 13)])
        cols = [f"c{i}" for i in range(1, 25)]
    if standardize and cols:
        g = Window.partitionBy(*keys)
        sd = lambda c: F.when(F.stddev_pop(c).over(g) < 1e-8, 1.0).otherwise(F.stddev_pop(c).over(g))
        out = out.select(*keys, "t", *[((F.col(c) - F.avg(c).over(g)) / sd(c)).alias(c) for c in cols])
    return out


def _standard_confounds(p: np.ma.MaskedArray, model: str) -> np.ma.MaskedArray:
    """TS7, standardised, for one run's motion as a matrix whose nulls are masked."""
    diff = np.ma.concatenate([np.ma.zeros((1, p.shape[1])), np.ma.masked_array(np.diff(p, axis=0)).filled(0.0)])
    base = {"none": p[:, :0], "motion6": p}.get(model, np.ma.concatenate([p, diff], axis=1))
    c = np.ma.concatenate([base, base * base], axis=1) if model == "friston24" else base
    sd = c.std(axis=0)
    return (c - c.mean(axis=0)) / np.ma.where(sd < 1e-8, 1.0, sd)


def regress_one(df: DataFrame, confound: str, keys: list[str] = ["run", "voxel"], value: str = "x") -> DataFrame:
    """TS8 for a single confound column beside the values: residual with intercept, built-in."""
    w = Window.partitionBy(*keys)
    slope = F.coalesce(F.try_divide(F.covar_pop(confound, value).over(w), F.var_pop(confound).over(w)), F.lit(0.0))
    return df.withColumn(value, F.col(value) - F.avg(value).over(w) - slope * (F.col(confound) - F.avg(confound).over(w)))


def regress(df: DataFrame, confounds: DataFrame, keys: list[str] = ["run"], value: str = "x") -> DataFrame:
    """TS8: residual of least squares (minimum norm) on all confounds and an intercept."""
    names = [c for c in confounds.columns if c not in (*keys, "t")]
    return _with_motion(df, confounds, lambda m, c: (np.arange(len(m)), filters.regress_out(m, c)), names, keys, value)


def _with_motion(df: DataFrame, side: DataFrame, function, names: list[str], keys: list[str], value: str = "x", prepare=None) -> DataFrame:
    """Applies function(matrix, side matrix) -> (kept step positions, matrix) per (keys, block); the
    side's rows go to every block of their run. ``prepare`` changes the run's side matrix, nulls
    masked, before it is put beside the steps of the series."""
    cols = [*keys, "voxel", "t", value]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)
    blocks = df.select(*cols, (F.col("voxel") / BLOCK).cast("int").alias("_b"))
    wide = fresh(side.select(*keys, "t", *names).join(blocks.select(*keys, "_b").distinct(), keys))

    def beside(b: pa.Table, steps: np.ndarray) -> np.ndarray:
        b = b.sort_by("t")
        have = b.column("t").to_numpy()
        if (have[1:] == have[:-1]).any():
            raise ValueError("more than one row of a run's motion or confounds for a step")
        parts = [np.ma.masked_array(c.to_numpy().astype(float), c.is_null().to_numpy()) for c in map(b.column, names)]
        s = np.ma.stack(parts, axis=1) if parts else np.ma.zeros((len(have), 0))
        return aligned((prepare(s) if prepare else s).filled(np.nan), have, steps)

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return a.select(cols)
        steps, channels, m = to_matrix(a, "t", "voxel", value)
        kept, out = function(m, beside(b, steps) if b.num_rows else None)
        return to_long(out, steps[kept], channels, {k: a.column(k)[0] for k in keys}, {c: a.schema.field(c).type for c in cols}, "t", "voxel", value)

    return blocks.groupBy(*keys, "_b").cogroup(wide.groupBy(*keys, "_b")).applyInArrow(one, kinds)


def zscore(df: DataFrame, keys: list[str] = ["run", "voxel"], value: str = "x") -> DataFrame:
    """TS9: population z-score with a floor of 1e-8 for the deviation."""
    w = Window.partitionBy(*keys)
    return df.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(1e-8)))


def clean_runs(df: DataFrame, motion: DataFrame, step: float = 1.333, discard: int = 5, do_detrend: bool = True,
               cutoff_hz: float | None = 0.01, fd_limit: float | None = 0.5, max_share: float = 0.3,
               confounds: str = "friston24", standardize: bool = True, keys: list[str] = ["run"]) -> DataFrame:
    """TS10: trim, length gate, detrend, high-pass, censor, nuisance regression, z-score in one
    pass over (run, channel block). Differences and z-scores of the confounds are taken
    before trimming; displacement after it; censoring comes after the filter. Runs that fail a
    gate give no rows; runs without motion are neither censored nor regressed."""
    if confounds not in MODELS:
        raise ValueError(f"unknown motion model {confounds}")

    def prepare(p):
        return np.ma.concatenate([p, _standard_confounds(p, confounds)], axis=1)

    def one(m, s):
        m = m[discard:]
        s = s[discard:] if s is not None else None
        none = (np.arange(0), np.zeros((0, m.shape[1])))
        if len(m) < MIN_STEPS:
            return none
        m = filters.detrend(m) if do_detrend else m
        m = filters.highpass(m, cutoff_hz, step) if cutoff_hz else m
        keep = np.ones(len(m), bool)
        if s is not None and np.isfinite(s).all():
            if fd_limit is not None:
                moved = np.abs(np.diff(s[:, :6], axis=0)) * np.array([1, 1, 1, HEAD_MM, HEAD_MM, HEAD_MM])
                keep = np.concatenate([[0.0], sum(moved.T)]) <= fd_limit  # added up as in TS5, so that both cut the same steps at the limit
                if 1 - keep.mean() > max_share:
                    return none
            m = filters.regress_out(m[keep], s[keep][:, 6:])
        m = filters.zscore(m) if standardize else m
        return np.flatnonzero(keep) + discard, m

    out = _with_motion(df, motion, one, P, keys, prepare=prepare)
    return out.withColumn("t", F.col("t") - discard)


def motion_violations(motion: DataFrame, series: DataFrame, keys: list[str] = ["run"]) -> DataFrame:
    """TS11: (run, rule, n): wrong number of steps, or non-finite parameters."""
    have = motion.groupBy(*keys).agg(F.count("*").alias("_m"), F.count_if(
        sum([F.when(F.col(p).isNull() | F.isnan(p) | (F.abs(p) == float("inf")), 1).otherwise(0) for p in P], F.lit(0)) > 0).alias("_bad"))
    want = series.groupBy(*keys).agg(F.count_distinct("t").alias("_s"))
    both = want.join(have, keys)
    return both.where("_m <> _s").select(*keys, F.lit("steps").alias("rule"), F.abs(F.col("_m") - F.col("_s")).alias("n")).union(
        both.where("_bad > 0").select(*keys, F.lit("not_finite"), "_bad"))


def require_motion_columns(motion: DataFrame) -> DataFrame:
    """TS11: six parameters at least."""
    if not set(P) <= set(motion.columns):
        raise ValueError("motion needs six parameters")
    return motion


def subject_gate(runs: DataFrame, min_runs: int = 2, min_steps: int = 100) -> DataFrame:
    """TS12: runs of subjects with enough runs and kept steps, renumbered from 1 without
    gaps. runs(subject, run, n_steps), n_steps 0 or null for runs that were dropped."""
    g = Window.partitionBy("subject")
    out = runs.withColumn("_runs", F.count("*").over(g)).withColumn("_steps", F.sum("n_steps").over(g))
    out = out.where((F.col("_runs") >= min_runs) & (F.col("_steps") >= min_steps) & (F.col("n_steps") > 0))
    return out.withColumn("new_run", F.row_number().over(g.orderBy("run"))).drop("_runs", "_steps")


def step_lengths(runs: DataFrame, default: float = 1.333, tolerance: float = 0.5) -> DataFrame:
    """TS13: the step length read, or the default where it is null or zero, and whether it is off."""
    s = F.coalesce(F.nullif("step", F.lit(0.0)), F.lit(default))
    return runs.withColumn("step", s).withColumn("warn", F.abs(s - default) > tolerance)


def motion_requirement(runs: DataFrame, files: DataFrame, regress_on: bool = True, required: bool = False) -> DataFrame:
    """TS14: (run, motion_file, action): regress, skip or, where it is required and missing, an error."""
    out = runs.join(files, "run", "left")
    if required and regress_on:
        out = require(out, F.col("motion_file").isNotNull(), "motion regression is required and a motion file is missing")
    return out.withColumn("action", F.when(F.lit(regress_on) & F.col("motion_file").isNotNull(), "regress").otherwise("skip"))


def global_signal(df: DataFrame) -> DataFrame:
    """TS15: mean over channels per step."""
    return df.groupBy("run", "t").agg(F.avg("x").alias("signal"))


def dvars(df: DataFrame) -> DataFrame:
    """TS16: root mean square over channels of first differences; the first step has none."""
    w = Window.partitionBy("run", "voxel").orderBy("t")
    return df.withColumn("_d", F.col("x") - F.lag("x").over(w)).where("_d is not null").groupBy("run", "t").agg(
        F.sqrt(F.avg(F.col("_d") ** 2)).alias("dvars"))


def example_runs(runs: DataFrame, wanted: list[int], n_random: int = 3, seed: int = 42) -> DataFrame:
    """TS17: wanted runs of the first, middle and last session of a subject; for a subject that
    has none of them a hash sample. runs(subject, session, run)."""
    sessions = runs.groupBy("subject").agg(F.sort_array(F.collect_set("session")).alias("_s"))
    n = F.size("_s")
    pick = sessions.select("subject", F.explode(F.array_distinct(F.array(
        F.col("_s")[0], F.col("_s")[((n - 1) / 2).cast("int")], F.col("_s")[n - 1]))).alias("session"))
    some = runs.join(pick, ["subject", "session"]).where(F.col("run").isin(wanted))
    rest = runs.join(some.select("subject").distinct(), "subject", "left_anti")
    w = Window.partitionBy("subject").orderBy(draw_key(seed, 0, "subject", "session", "run"), "session", "run")
    rest = rest.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_random).drop("_r")
    return some.select("subject", "session", "run").union(rest.select("subject", "session", "run"))

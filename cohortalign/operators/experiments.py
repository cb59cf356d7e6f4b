"""Experiment tables and jobs (EXP1-EXP20)."""

from __future__ import annotations

import heapq
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import staged
from ..functions.moments import apply_matrix, as_long, as_rows
from . import alignment as A
from . import encoding as E
from . import metrics as M
from . import scoring as Q
from . import trials as T


def _long_scores(measured: DataFrame, predicted: DataFrame) -> DataFrame:
    """(subject, stim_id, voxel, y, p) from array rows v and p."""
    return measured.join(predicted.select("subject", "stim_id", "p"), ["subject", "stim_id"]).select(
        "subject", "stim_id", F.posexplode(F.arrays_zip(F.col("v").alias("y"), F.col("p").alias("p"))).alias("voxel", "c")).select(
        "subject", "stim_id", "voxel", F.col("c.y").alias("y"), F.col("c.p").alias("p"))


def train(conn: DataFrame, responses: DataFrame, features: DataFrame, k: int = 50, min_k: int = 10, alpha: float = 1000.0, mode: str = "hybrid"):
    """EXP19, last part: shared space from common items, then one encoder over all subjects' rows."""
    space = A.fit_shared_space(conn, responses, k, min_k, mode)
    if space.latents is None:
        latents = A.project(responses.select("subject", "stim_id", "v"), space.basis, space.rotations)
    else:
        latents = apply_matrix(space.latents.withColumnRenamed("z", "y"), "subject", space.rotations, "y", "z")
    pooled = E.pooled_training(features, latents.select("subject", "stim_id", "z"))
    return space, E.fit_ridge(pooled, alpha)


def predict_zero_shot(space, encoder, conn: DataFrame, measured: DataFrame, features: DataFrame, eval_rows: DataFrame | None = None, min_k: int = 10) -> DataFrame:
    """EXP1: long scores (subject, stim_id, voxel, y, p) of new subjects, aligned by fingerprint, on
    the evaluation items or on all."""
    basis, rot = A.align_zero_shot(space, conn, min_k)
    rows = measured if eval_rows is None else measured.join(eval_rows.select("subject", "stim_id"), ["subject", "stim_id"], "left_semi")
    wanted = rows.select("subject", "stim_id").join(features, "stim_id")
    return _long_scores(rows, E.predict_voxels(wanted, encoder, basis, rot))


def _few_shot(space, encoder, conn: DataFrame, measured: DataFrame, features: DataFrame, shots: DataFrame, fine_tune_alpha: float | None, min_k: int):
    """Basis, rotations and encoder of new subjects from calibration rows."""
    calibration = measured.join(shots.select("subject", "stim_id"), ["subject", "stim_id"], "left_semi")
    basis, rot = A.align_few_shot(space, conn, calibration, min_k)
    if fine_tune_alpha is not None:
        z = A.project(calibration.select("subject", "stim_id", "v"), basis, rot).join(features, "stim_id")
        encoder = E.fine_tune(encoder, z, fine_tune_alpha)
    return basis, rot, encoder


def predict_few_shot(space, encoder, conn: DataFrame, measured: DataFrame, features: DataFrame, shots: DataFrame, eval_rows: DataFrame,
                     fine_tune_alpha: float | None = None, min_k: int = 10) -> DataFrame:
    """EXP1: the same with a rotation from calibration rows and, if an alpha is given, an encoder refit on them."""
    basis, rot, encoder = _few_shot(space, encoder, conn, measured, features, shots, fine_tune_alpha, min_k)
    rows = measured.join(eval_rows.select("subject", "stim_id"), ["subject", "stim_id"], "left_semi")
    return _long_scores(rows, E.predict_voxels(rows.select("subject", "stim_id").join(features, "stim_id"), encoder, basis, rot))


def _evaluated(measured: DataFrame, features: DataFrame, eval_rows: DataFrame | None) -> DataFrame:
    rows = measured if eval_rows is None else measured.join(eval_rows.select("subject", "stim_id"), ["subject", "stim_id"], "left_semi")
    return rows.select("subject", "stim_id", "v").join(features.select("stim_id", "x"), "stim_id")


def score_zero_shot(space, encoder, conn: DataFrame, measured: DataFrame, features: DataFrame, eval_rows: DataFrame | None = None, min_k: int = 10) -> DataFrame:
    """EXP1: (subject, voxel, r) of new subjects aligned by fingerprint, from cross-products; no prediction is written."""
    basis, rot = A.align_zero_shot(space, conn, min_k)
    return Q.rotated_scores(_evaluated(measured, features, eval_rows), encoder, basis, {s: [r] for s, r in rot.items()}).drop("g")


def score_few_shot(space, encoder, conn: DataFrame, measured: DataFrame, features: DataFrame, shots: DataFrame, eval_rows: DataFrame,
                   fine_tune_alpha: float | None = None, min_k: int = 10) -> DataFrame:
    """EXP1: the same after calibration."""
    basis, rot, encoder = _few_shot(space, encoder, conn, measured, features, shots, fine_tune_alpha, min_k)
    return Q.rotated_scores(_evaluated(measured, features, eval_rows), encoder, basis, {s: [r] for s, r in rot.items()}).drop("g")


def fewshot_ablation(space, encoder, conn: DataFrame, measured: DataFrame, features: DataFrame, candidates: DataFrame, eval_rows: DataFrame,
                     shots: list[int], seeds: list[int], min_k: int = 10) -> DataFrame:
    """EXP2: (n_shots, seed, median_r): every (level, seed) is a key of one grid job. Level 0 is
    zero-shot and run once; levels are clamped to the pool, as their repeats are then equal.

    The basis and the projected candidates are made once; a grid row only selects calibration rows, whose cross-products with the template
    give its rotation. All rotations are scored from one set of cross-products of the evaluation rows, so a grid point
    adds k x k numbers, not predictions.
    """
    spark = measured.sparkSession
    basis, zero = A.align_zero_shot(space, conn, min_k)
    basis = staged(basis, "ablation-basis")
    pool = candidates.join(eval_rows.select("subject", "row_idx"), ["subject", "row_idx"], "left_anti")
    z = A.project(measured.select("subject", "stim_id", "v"), basis).join(space.template.withColumnRenamed("z", "target"), "stim_id")
    z = staged(z.join(pool.select("subject", "stim_id", "row_idx"), ["subject", "stim_id"]), "ablation")
    grid = spark.createDataFrame([(int(n), int(s)) for n in shots if n > 0 for s in seeds], "n_shots int, seed int")
    key = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("seed").cast("string"), F.lit("0"), F.col("subject").cast("string"),
                                               F.col("row_idx").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = z.crossJoin(grid)  # pool rows x grid: the grid is a few dozen rows
    drawn = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("subject", "n_shots", "seed").orderBy(key, "row_idx"))).where("_r <= n_shots")
    rotations = A.procrustes(drawn, "z", "target", ["subject", "n_shots", "seed"])
    if 0 in shots:
        rotations |= {(s, 0, 0): r for s, r in zero.items()}
    by_subject: dict = {}
    for (s, n, seed), r in sorted(rotations.items()):
        by_subject.setdefault(s, []).append((n, seed, r))
    scores = Q.rotated_scores(_evaluated(measured, features, eval_rows), encoder, basis, {s: [r for _, _, r in found] for s, found in by_subject.items()})
    levels = spark.createDataFrame([(int(s), g, int(n), int(seed)) for s, found in by_subject.items() for g, (n, seed, _) in enumerate(found)],
                                   "subject int, g int, n_shots int, seed int")
    return Q.summary(scores, ["subject", "g"]).join(F.broadcast(levels), ["subject", "g"]).drop("g")  # a row a grid point


def ablation_summary(scores: DataFrame) -> DataFrame:
    """EXP2: mean and population deviation of median_r over seeds per level."""
    return scores.groupBy("subject", "n_shots").agg(F.avg("median_r").alias("mean_r"), F.stddev_pop("median_r").alias("sd_r"), F.count("*").alias("n"))


def backbone_summary(results: DataFrame) -> DataFrame:
    """EXP3: per feature kind the zero-shot score, the best level N > 0 by mean score (lowest N
    on ties), its gain and its first repeat's value. results(kind, n_shots, rep, score)."""
    level = results.groupBy("kind", "n_shots").agg(F.avg("score").alias("mean"), F.min_by("score", "rep").alias("first"))
    zero = level.where("n_shots = 0").select("kind", F.col("mean").alias("zero"))
    best = level.where("n_shots > 0").groupBy("kind").agg(F.max_by(F.struct("n_shots", "mean", "first"), F.struct("mean", -F.col("n_shots"))).alias("b"))
    out = best.join(zero, "kind", "left")
    return out.select("kind", "zero", F.col("b.n_shots").alias("best_n"), F.col("b.mean").alias("best"), F.col("b.first").alias("first_repeat"),
                      (F.col("b.mean") - F.col("zero")).alias("delta"))


def loso_sweep(conn: DataFrame, responses: DataFrame, features: DataFrame, ks: list[int], alphas: list[float], min_k: int = 2,
               train_function=None, predict_function=None) -> DataFrame:
    """EXP4: (k, alpha, fold, score) for a grid, each subject held out once; score is the zero-shot median r.
    All points come from the same passes (``scoring.loso_scores``). ``train_function(fold data, k, alpha)`` and ``predict_function`` may replace
    that; they are called for each point."""
    spark = responses.sparkSession
    subjects = sorted(r[0] for r in responses.select("subject").distinct().collect())
    if len(subjects) < 2:
        raise ValueError("at least two subjects")
    bounds = [a for a in alphas if a <= 0] + [k for k in ks if k < min_k]
    if bounds:
        raise ValueError(f"parameters out of bounds: {bounds}")
    grid = [(int(k), float(a)) for k in ks for a in alphas]
    if train_function is None:
        out = Q.loso_scores(conn, responses, features, grid, min_k)
    else:
        out = []
        for held, (k, a) in itertools.product(subjects, grid):
            model = train_function(responses.where(F.col("subject") != held), k, a)
            out.append((k, a, int(held), float(predict_function(model, responses.where(F.col("subject") == held)))))
    return spark.createDataFrame(out, "k int, alpha double, fold int, score double")


def sweep_objective(scores: DataFrame) -> DataFrame:
    """EXP4: objective of each grid point, the mean fold score to 12 places, best first."""
    return scores.groupBy("k", "alpha").agg(F.round(F.avg("score"), 12).alias("objective")).orderBy(F.desc("objective"), "k", "alpha")


def trial_states(trials: DataFrame) -> DataFrame:
    """EXP5: trials per state."""
    return trials.groupBy("state").agg(F.count("*").alias("n"))


def best_trial(trials: DataFrame) -> DataFrame:
    """EXP5: number and value of the best trial, among COMPLETE ones only; the lowest number on ties."""
    return trials.where("state = 'COMPLETE'").agg(F.max_by(F.struct("number", "value"), F.struct("value", -F.col("number"))).alias("b")).select("b.*")


def running_best(trials: DataFrame, by: list[str] = []) -> DataFrame:
    """EXP5: best complete value so far, and each trial's duration in seconds."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.when(F.col("state") == "COMPLETE", F.col("value"))).over(w)
    return trials.withColumn("best_so_far", best).withColumn(
        "duration", F.col("completed").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double"))


def median_pruning(scores: DataFrame, startup: int = 5, warmup: int = 1, interval: int = 1, by: list[str] = []) -> DataFrame:
    """EXP6: (by, trial, step, score, prune): after the start-up trials, at steps from ``warmup`` on and at the
    interval, a trial is pruned whose best score so far is below the median of the scores that earlier complete trials
    of the same study (columns ``by``) had at that step. scores(by, trial, step, score, state).

    The trials of a (study, step) pass once, in order, by two heaps that hold the lower and the upper half of the complete ones' scores,
    so the work is linear log in the trials and no trial meets another."""
    best = F.max("score").over(Window.partitionBy(*by, "trial").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    own = scores.select(*by, "step", "trial", "score", F.coalesce(F.col("state") == "COMPLETE", F.lit(False)).alias("_done"), best.cast("double").alias("_best"))
    dealt = own.repartition(*by, "step").sortWithinPartitions(*by, "step", "trial")
    k = len(by)

    def run(batches):
        at, trial, low, high, held = None, None, [], [], []
        for b in batches:
            keys = list(zip(*[b.column(i).to_pylist() for i in range(k + 1)]))
            scores_ = b.column("score").cast("double").to_pylist()
            out = []
            for key, t, x, done, top in zip(keys, b.column("trial").to_pylist(), scores_, b.column("_done").to_pylist(), b.column("_best").to_pylist()):
                if key != at:
                    at, trial, low, high, held = key, t, [], [], []
                elif t != trial:  # rows of one trial don't count for each other
                    for v in held:
                        halved(low, high, v)
                    trial, held = t, []
                n = len(low) + len(high)
                step = key[-1]
                due = n >= startup and step is not None and step >= warmup and (step - warmup) % interval == 0
                out.append(bool(due and top is not None and top < middle(low, high)))
                if done and x is not None:
                    held.append(x)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*by, "trial", "step", "score")], pa.array(out, pa.bool_())], [*by, "trial", "step", "score", "prune"])

    kinds = [f"`{c}` {own.schema[c].dataType.simpleString()}" for c in (*by, "trial", "step", "score")]
    return dealt.mapInArrow(run, ", ".join([*kinds, "prune boolean"]))


def halved(low: list, high: list, x: float) -> None:
    """Puts x into the heaps of the lower half (negated) and the upper half, of equal size or the lower one longer by one."""
    heapq.heappush(high, -heapq.heappushpop(low, -x))
    if len(high) > len(low):
        heapq.heappush(low, -heapq.heappop(high))


def middle(low: list, high: list) -> float:
    """The median; with no score yet nothing is below it."""
    return float("-inf") if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2


def fewshot_runs(files: DataFrame, dedupe: bool = False, path: str = "path", score: str = "median_r") -> DataFrame:
    """EXP7: (subject, n_shots, seed, median_r, path) from record names; names that don't fit and null
    scores go; with ``dedupe`` the best of each (subject, N, seed) stays."""
    pattern = r"fewshot_sub(\d+)_N(\d+)_seed(\d+)_metrics\.json$"
    n = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit("")).try_cast("int")
    out = files.select(n(1).alias("subject"), n(2).alias("n_shots"), n(3).alias("seed"), F.col(score).try_cast("double").alias("median_r"), F.col(path).alias("path"))
    out = out.where("subject is not null and median_r is not null")
    if not dedupe:
        return out
    w = Window.partitionBy("subject", "n_shots", "seed").orderBy(F.desc("median_r"), "path")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_n(summary: DataFrame, by: list[str] = []) -> DataFrame:
    """EXP8: the N > 0 of the highest mean; rows that don't parse are skipped, the first row wins ties.
    summary(line, n_shots string, mean string)."""
    s = summary.withColumn("_n", F.col("n_shots").try_cast("int")).withColumn("_m", F.col("mean").try_cast("double"))
    s = s.where("_n > 0 and _m is not null and not isnan(_m)")
    return s.groupBy(*by).agg(F.max_by("_n", F.struct("_m", -F.col("line"))).alias("best_n"))


def select_run(runs: DataFrame, by: list[str] = ["subject"], preferred_n: int | None = None, force_n: int | None = None, force_seed: int | None = None) -> DataFrame:
    """EXP9: one run per group: forced N and seed filter, a preferred N filters where it exists; then
    highest score, largest N, smallest seed."""
    r = runs
    if force_n is not None:
        r = r.where(F.col("n_shots") == force_n)
    elif preferred_n is not None:
        has = F.max((F.col("n_shots") == preferred_n).cast("int")).over(Window.partitionBy(*by))
        r = r.withColumn("_h", has).where((F.col("_h") == 0) | (F.col("n_shots") == preferred_n)).drop("_h")
    if force_seed is not None:
        r = r.where(F.col("seed") == force_seed)
    w = Window.partitionBy(*by).orderBy(F.desc("median_r"), F.desc("n_shots"), "seed")
    return r.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ranked_manifest(few: DataFrame, zero: DataFrame, n: int, item: str = "stim_id") -> DataFrame:
    """EXP10: the n items whose pattern correlation gained most from calibration, ranked from 1."""
    a = M.pattern_correlation(few, [], item).withColumnRenamed("r", "few_r")
    b = M.pattern_correlation(zero, [], item).withColumnRenamed("r", "zero_r")
    both = a.join(b, item).withColumn("gain", F.round(F.col("few_r") - F.col("zero_r"), 9)).orderBy(F.desc("gain"), item).limit(n)
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gain"), item)))  # n rows


def peak_voxel(values: DataFrame, voxels: DataFrame, by: list[str] = ["subject"]) -> DataFrame:
    """EXP11: coordinates of the largest absolute value (the first in voxel order on ties); the middle of the
    grid where all values are zero."""
    both = values.join(voxels, [*by, "voxel"])
    top = both.groupBy(*by).agg(F.max_by(F.struct("x", "y", "z"), F.struct(F.abs("val"), -F.col("voxel"))).alias("p"), F.max(F.abs("val")).alias("top"),
                                *[F.floor((F.max(c) + 1) / 2).cast("int").alias(f"_{c}") for c in "xyz"])
    return top.select(*by, *[F.when(F.col("top") > 0, F.col(f"p.{c}")).otherwise(F.col(f"_{c}")).cast("int").alias(c) for c in "xyz"])


def orthogonal_slices(values: DataFrame, voxels: DataFrame, peak: DataFrame, by: list[str] = ["subject"]) -> DataFrame:
    """EXP12: (by, plane, x, y, z, val): the cells of the three planes through the peak."""
    p = peak.select(*by, *[F.col(c).alias(f"_{c}") for c in "xyz"])
    both = values.join(voxels, [*by, "voxel"]).join(p, by)
    out = both.withColumn("plane", F.explode(F.array(*[F.when(F.col(c) == F.col(f"_{c}"), F.lit(c)) for c in "xyz"])))
    return out.where("plane is not null").select(*by, "plane", "x", "y", "z", "val")


def value_limit(values: DataFrame, by: list[str] = ["subject"], value: str = "val") -> DataFrame:
    """EXP13: 99th percentile of absolute values, 1e-6 at least."""
    return values.groupBy(*by).agg(F.greatest(F.percentile(F.abs(F.col(value)), 0.99), F.lit(1e-6)).alias("limit"))


def histogram(values: DataFrame, value: str, low: float, high: float, bins: int = 100, by: list[str] = []) -> DataFrame:
    """EXP14: counts per bin of equal width; the last bin holds the upper end."""
    b = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return values.where(F.col(value).between(low, high)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def shot_curve(results: DataFrame) -> DataFrame:
    """EXP15: mean and deviation of the score per level."""
    return results.groupBy("n_shots").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.count("*").alias("n"))


def parcel_table(scores: DataFrame, conditions: list[str]) -> DataFrame:
    """EXP15: parcels x conditions of the median score, 0 where missing. scores(label, condition, r)."""
    return scores.groupBy("label").pivot("condition", conditions).agg(F.median("r")).na.fill(0.0)


def top_patterns(df: DataFrame, n: int = 5, item: str = "stim_id") -> DataFrame:
    """EXP16: the n items of the highest pattern correlation."""
    r = M.pattern_correlation(df, [], item).withColumn("r", F.round("r", 9))
    return r.orderBy(F.desc("r"), item).limit(n)


def feature_benchmark(responses: DataFrame, targets: DataFrame, conditions: DataFrame, alpha: float = 1000.0) -> DataFrame:
    """EXP17, EXP18: R2 of feature targets predicted from responses, per condition and block.

    responses(stim_id, v) and targets(stim_id, block, z) train one ridge per block; conditions(condition, stim_id, v, ...) are
    standardised with the training statistics, predicted and brought to the training distribution (AGG5).
    """
    train = as_long(responses, ["stim_id"], "voxel", "val")
    st = T.channel_stats(train, ["voxel"], ddof=1)

    z = lambda df, keys: as_rows(T.standardize(as_long(df, keys, "voxel", "val"), st, ["voxel"]), keys, "voxel", "val", "x")
    x = z(responses, ["stim_id"]).join(targets, "stim_id")
    models = E.fit_ridge_blocks(x, "block", alpha)
    p = E.predict_blocks(z(conditions, ["condition", "stim_id"]), models, "block")
    p = as_long(p.withColumn("v", F.col("p")), ["condition", "block", "stim_id"], "j", "val")
    tgt = as_long(targets.withColumn("v", F.col("z")), ["block", "stim_id"], "j", "val")
    p = _renorm(p, tgt.join(responses.select("stim_id"), "stim_id", "left_semi"))
    both = p.withColumnRenamed("val", "p").join(tgt.withColumnRenamed("val", "y"), ["block", "stim_id", "j"])
    return M.r_squared(both, ["condition", "block"], "j")


def _renorm(p: DataFrame, targets: DataFrame) -> DataFrame:
    own = T.channel_stats(p, ["condition", "block", "j"]).withColumnsRenamed({"mean": "_m", "sd": "_s"})
    t = T.channel_stats(targets, ["block", "j"])
    return p.join(own, ["condition", "block", "j"]).join(t, ["block", "j"]).select(
        "condition", "block", "stim_id", "j", ((F.col("val") - F.col("_m")) / F.col("_s") * F.col("sd") + F.col("mean")).alias("val"))


def prepare_task(trials: DataFrame, design: DataFrame, mask: DataFrame, max_sessions: int | None = None, first_shared: int = 1000) -> DataFrame:
    """EXP19: (subject, split, stim_id, voxel, val): trials to items by the design, masked and averaged.
    trials(subject, session, order, voxel, val)."""
    from . import masks as K

    t = K.trial_stimulus(K.split_of_order(trials, "order", first_shared), design)
    t = t if max_sessions is None else K.first_sessions(t, max_sessions)
    return T.mean_responses(K.keep_masked(t, mask))


def prepare_rest(series: DataFrame, motion: DataFrame, runs: DataFrame, min_runs: int = 2, min_steps: int = 100, **options) -> DataFrame:
    """EXP19: cleaned series of subjects that pass the gates, runs renumbered. runs(subject, run)."""
    from . import timeseries as X

    clean = X.clean_runs(series, motion, **options)
    n = clean.groupBy("run").agg(F.count_distinct("t").alias("n_steps"))
    kept = X.subject_gate(runs.join(n, "run", "left").withColumn("n_steps", F.coalesce("n_steps", F.lit(0))), min_runs, min_steps)
    return clean.join(kept.select("run", "subject", "new_run"), "run")


def example_manifest(few: DataFrame, zero: DataFrame, runs: DataFrame, subject: int, n: int = 12) -> DataFrame:
    """EXP20: the chosen run of the subject beside the n items that gained most."""
    run = select_run(fewshot_runs(runs, True), ["subject"]).where(F.col("subject") == subject)
    items = ranked_manifest(few.where(F.col("subject") == subject), zero.where(F.col("subject") == subject), n)
    return items.crossJoin(run.select("n_shots", "seed", "path"))  # n rows x one

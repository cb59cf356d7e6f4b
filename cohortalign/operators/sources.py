"""Scans, file inventories and sinks (SRC1-SRC13, SNK2-SNK5; SNK1 is with the models)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import require

SESSION_FIRST = r"(?i)(?:session|ses-?)0*(\d+).*?run-?0*(\d+)"
RUN_FIRST = r"(?i)run-?0*(\d+).*?(?:session|ses-?)0*(\d+)"
RUN_ONLY = r"(?i)run-?0*(\d+)"


def subject_scan(responses: DataFrame, subject: int, columns: list[str], split: str | None = None) -> DataFrame:
    """SRC1: one quantity of one subject: filters reach the scan, other columns aren't read."""
    out = responses.where(F.col("subject") == subject)
    return (out if split is None else out.where(F.col("split") == split)).select(*columns)


def gapless_runs(runs: DataFrame, by: list[str] = ["subject"], run: str = "run") -> DataFrame:
    """SRC2: rows of runs 1, 2, .. up to the first missing number."""
    have = runs.select(*by, run).distinct()
    kept = have.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(run))).where(F.col(run) == F.col("_k"))
    return runs.join(kept.drop("_k"), [*by, run], "left_semi")


def feature_lookup(ids: DataFrame, features: DataFrame, key: str = "stim_id", strict: bool = True) -> DataFrame:
    """SRC3: features of each id, the ids' other columns kept; an id out of range is an error."""
    out = ids.join(features.withColumn("_in", F.lit(True)), key, "left")
    return (require(out, F.col("_in").isNotNull(), "an id has no features") if strict else out.where("_in")).drop("_in")


def out_of_range(ids: DataFrame, features: DataFrame, key: str = "stim_id") -> DataFrame:
    """SRC3: ids without features."""
    return ids.join(features.select(key), key, "left_anti")


def composite_features(a: DataFrame, b: DataFrame, key: str = "stim_id", vec: str = "vec") -> DataFrame:
    """SRC4: two kinds of features side by side."""
    return a.withColumnRenamed(vec, "_a").join(b.withColumnRenamed(vec, "_b"), key).select(key, F.concat("_a", "_b").alias(vec))


def _number(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("int")


def discover_sessions(files: DataFrame, name: str = "name") -> DataFrame:
    """SRC5: session numbers in the file names, ascending; none is an error on use of :func:`require_sessions`."""
    s = _number(F.col(name), r"(?i)(?:session|ses-?)0*(\d+)", 1)
    return files.select(s.alias("session")).where("session is not null").distinct().orderBy("session")


def require_sessions(sessions: DataFrame) -> DataFrame:
    return require(sessions.agg(F.count("*").alias("n")), F.col("n") > 0, "no session found")


def session_run(files: DataFrame, name: str = "name") -> DataFrame:
    """SRC6: adds session (may be null) and run, from either order of the two in the name."""
    c = F.col(name)
    both, turned = F.regexp_like(c, F.lit(SESSION_FIRST)), F.regexp_like(c, F.lit(RUN_FIRST))
    session = F.when(both, _number(c, SESSION_FIRST, 1)).when(turned, _number(c, RUN_FIRST, 2))
    run = F.when(both, _number(c, SESSION_FIRST, 2)).when(turned, _number(c, RUN_FIRST, 1)).otherwise(_number(c, RUN_ONLY, 1))
    return files.withColumn("session", session).withColumn("run", run)


def match_motion(series: DataFrame, motion: DataFrame) -> DataFrame:
    """SRC7: (name, motion_file): the motion file of the same session and run, else the only one with
    that run and no session, else none. Inputs are session_run() tables."""
    m = motion.where("run is not null").select("session", "run", F.col("name").alias("_m"))
    exact = m.where("session is not null").groupBy("session", "run").agg(F.min("_m").alias("_exact"))
    loose = m.where("session is null").groupBy("run").agg(F.min("_m").alias("_loose"), F.count("*").alias("_n")).where("_n = 1")
    out = series.join(exact, ["session", "run"], "left").join(loose.drop("_n"), "run", "left")
    return out.select("name", "session", "run", F.coalesce("_exact", "_loose").alias("motion_file"))


def rest_designs(design: DataFrame) -> DataFrame:
    """SRC8: (file, is_rest): all values below 1e-12 in size, the first column left out if there are more.
    design(file, row, col, val)."""
    width = F.max("col").over(Window.partitionBy("file"))
    used = design.withColumn("_w", width).where("_w = 0 or col > 0")
    return used.groupBy("file").agg(F.bool_and(F.abs("val") < 1e-12).alias("is_rest"))


def rest_runs(series: DataFrame, designs: DataFrame, rest: DataFrame, name_filter: str = "(?i)rest") -> DataFrame:
    """SRC8: series names of rest runs: those whose design, matched by session and run or by an unambiguous run,
    is at rest; if there is none at all, those whose name says so."""
    d = designs.join(rest.where("is_rest"), "file")
    matched = match_motion(series, d.select(F.col("file").alias("name"), "session", "run")).where("motion_file is not null").select("name")
    named = series.where(F.regexp_like("name", F.lit(name_filter))).select("name")
    none = matched.agg(F.count("*").alias("_n")).where("_n = 0")
    return matched.union(named.join(none, F.lit(True)).select("name"))  # one row or none on the right


def run_manifest(matched: DataFrame) -> DataFrame:
    """SRC9: per session the run files in order and the map of motion files."""
    return matched.groupBy("session").agg(
        F.sort_array(F.collect_list("name")).alias("runs"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("motion_file").isNotNull(), F.struct("name", "motion_file"))))).alias("motion"))


def load_or_build_manifest(spark: SparkSession, path: str, build) -> DataFrame:
    """SRC9: the stored manifest, else the one that ``build()`` gives, stored."""
    from .splits import _exists

    if not _exists(spark, path):
        build().write.json(path)
    return spark.read.json(path)


def run_inventory(runs: DataFrame, bin_width: int = 10) -> tuple[DataFrame, DataFrame]:
    """SRC10: length range, step lengths by subject; and counts of runs per length bin."""
    a = runs.groupBy("subject").agg(F.count("*").alias("n_runs"), F.min("n_steps").alias("min_steps"), F.median("n_steps").alias("median_steps"),
                                    F.max("n_steps").alias("max_steps"), F.sort_array(F.collect_set("step")).alias("steps"))
    b = runs.groupBy("subject", (F.floor(F.col("n_steps") / bin_width) * bin_width).alias("bin")).agg(F.count("*").alias("n"))
    return a, b


def clean_captions(captions: Column) -> Column:
    """SRC11: trimmed captions without null and empty ones; one empty caption if nothing is left."""
    kept = F.filter(F.transform(captions, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(F.lit("")))


def mean_pool(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """SRC12: mean of an item's vectors, position by position."""
    long = rows.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return long.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vec))


def featurise(items: DataFrame, function, schema: str, done: DataFrame | None = None, key: str = "stim_id") -> DataFrame:
    """SRC13: function(pandas frame) -> pandas frame on batches of items that aren't done."""
    todo = items if done is None else items.join(done.select(key), key, "left_anti")

    def run(frames):
        for pdf in frames:
            if len(pdf):
                yield function(pdf)

    return todo.mapInPandas(run, schema)


def write_metrics(record: DataFrame, path: str) -> None:
    """SNK2: one JSON object per row."""
    record.write.mode("append").json(path)


def write_summary_csv(parts: list[DataFrame], path: str) -> None:
    """SNK3: rows of several tables under the union of their columns, first seen first, with a header."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_trial_log(trials: DataFrame, keys: list[str], path: str, params: str = "params") -> None:
    """SNK4: the trial log with map entries as columns."""
    flat = trials.select(*[c for c in trials.columns if c != params], *[F.col(params)[k].alias(f"params_{k}") for k in keys])
    flat.write.mode("overwrite").option("header", True).csv(path)


def subject_summaries(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """SNK5: per subject rows, items, channels and the mask's share."""
    a = rows.groupBy("subject").agg(F.count("*").alias("n_cells"), F.count_distinct("stim_id").alias("n_items"), F.count_distinct("voxel").alias("n_voxels"))
    m = mask.groupBy("subject").agg(F.count_if("in_mask").alias("n_mask"), F.avg(F.col("in_mask").cast("double")).alias("mask_fraction"))
    return a.join(m, "subject")

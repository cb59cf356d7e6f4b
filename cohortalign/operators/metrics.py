"""Scores of predictions against measured responses (MET1-MET11), long form.

Inputs have one row per (item, channel) with the measured value ``y`` and the prediction ``p``;
``keys`` are further grouping columns such as the subject, so many subjects or conditions are
scored in one job. Each is one or two hash aggregates with partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import draw_key, guarded_corr

Keys = list[str]


def voxelwise_correlation(df: DataFrame, keys: Keys = [], channel: str = "voxel") -> DataFrame:
    """MET1: correlation over items per channel; 0 where either side is constant."""
    return df.groupBy(*keys, channel).agg(guarded_corr("y", "p").alias("r"))


def correlation_summary(corr: DataFrame, keys: Keys = []) -> DataFrame:
    """MET2: exact median and mean of the channel correlations."""
    return corr.groupBy(*keys).agg(F.median("r").alias("median_r"), F.avg("r").alias("mean_r"))


def pattern_correlation(df: DataFrame, keys: Keys = [], item: str = "stim_id") -> DataFrame:
    """MET3: correlation over channels per item."""
    return df.groupBy(*keys, item).agg(guarded_corr("y", "p").alias("r"))


def pattern_correlation_rows(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """MET3 on array rows: adds ``r``, computed inside the row without a shuffle."""
    n = F.size(y)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / n
    df = df.withColumn("_my", mean(y)).withColumn("_mp", mean(p))
    dot = lambda a, ma, b, mb: F.aggregate(F.zip_with(a, b, lambda u, v: (u - F.col(ma)) * (v - F.col(mb))), F.lit(0.0), lambda s, x: s + x) / n
    df = df.withColumn("_sy", F.sqrt(dot(y, "_my", y, "_my"))).withColumn("_sp", F.sqrt(dot(p, "_mp", p, "_mp")))
    r = F.when((F.col("_sy") < 1e-10) | (F.col("_sp") < 1e-10), 0.0).otherwise(F.try_divide(dot(y, "_my", p, "_mp"), F.col("_sy") * F.col("_sp")))
    return df.withColumn("r", r).drop("_my", "_mp", "_sy", "_sp")


def two_vs_two(df: DataFrame, n_pairs: int = 1000, seed: int = 42, keys: Keys = [], item: str = "stim_id",
               channel: str = "voxel") -> DataFrame:
    """MET4: share of drawn item pairs whose own correlations sum to strictly more than
    the crossed ones; ties and undefined correlations count as wrong.

    Items are numbered within ``keys``; draw j pairs two different numbers by hash, so
    pairs are rows and the four correlations one aggregate over pairs x channels.
    """
    items = df.select(*keys, item).distinct()
    order = Window.partitionBy(*keys).orderBy(item) if keys else Window.orderBy(item)
    items = items.withColumn("_i", F.row_number().over(order) - 1)
    size = items.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    draw = size.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n_pairs - 1))))
    a = F.pmod(draw_key(seed, F.col("_j"), F.lit("a")), F.col("_n"))
    b = F.pmod(draw_key(seed, F.col("_j"), F.lit("b")), F.col("_n") - 1)
    draw = draw.withColumn("_a", a).withColumn("_b", b).withColumn("_b", F.when(F.col("_b") >= F.col("_a"), F.col("_b") + 1).otherwise(F.col("_b")))
    cells = df.join(items, [*keys, item]).select(*keys, "_i", channel, "y", "p")
    left = cells.select(*keys, F.col("_i").alias("_a"), channel, F.col("y").alias("ya"), F.col("p").alias("pa"))
    right = cells.select(*keys, F.col("_i").alias("_b"), channel, F.col("y").alias("yb"), F.col("p").alias("pb"))
    pairs = draw.join(left, [*keys, "_a"]).join(right, [*keys, "_b", channel])
    one = pairs.groupBy(*keys, "_j").agg(*[guarded_corr(x, z).alias(n) for n, x, z in (
        ("aa", "ya", "pa"), ("bb", "yb", "pb"), ("ab", "ya", "pb"), ("ba", "yb", "pa"))])
    right_ = F.coalesce(F.round(F.col("aa") + F.col("bb"), 10) > F.round(F.col("ab") + F.col("ba"), 10), F.lit(False))
    return one.groupBy(*keys).agg(F.avg(right_.cast("double")).alias("accuracy"), F.count("*").alias("n_pairs"))


def noise_ceiling(trials: DataFrame, keys: Keys = [], item: str = "stim_id", trial: str = "trial", channel: str = "voxel",
                  value: str = "val") -> DataFrame:
    """MET5: split-half reliability per channel. Of items with two trials or more the means of the
    1st, 3rd, .. and 2nd, 4th, .. trials are correlated over items, clipped to
    +-0.999, stepped up by 2r / (1 + |r|) and clipped to [0, 1]."""
    order = Window.partitionBy(*keys, item, channel).orderBy(trial)
    t = trials.withColumn("_k", F.row_number().over(order) % 2)
    half = t.groupBy(*keys, item, channel).agg(
        F.avg(F.when(F.col("_k") == 1, F.col(value))).alias("y"), F.avg(F.when(F.col("_k") == 0, F.col(value))).alias("p"))
    r = voxelwise_correlation(half.where("p is not null"), keys, channel)
    r = r.withColumn("r", F.greatest(F.lit(-0.999), F.least(F.lit(0.999), "r")))
    nc = 2 * F.col("r") / (1 + F.abs("r"))
    return r.select(*keys, channel, F.greatest(F.lit(0.0), F.least(F.lit(1.0), nc)).alias("nc"))


def normalized_performance(corr: DataFrame, ceiling: DataFrame, on: Keys, nc_floor: float = 0.1) -> DataFrame:
    """MET6: r over the ceiling; null where the ceiling is below the floor."""
    return corr.join(ceiling, on).withColumn("normalized", F.when(F.col("nc") >= nc_floor, F.col("r") / F.col("nc")))


def roi_evaluation(corr: DataFrame, labels: DataFrame, on: Keys, keys: Keys = [], names: DataFrame | None = None) -> DataFrame:
    """MET7: median, mean and size per parcel; label 0 and empty parcels give no row."""
    out = corr.join(labels.where("label > 0"), on).groupBy(*keys, "label").agg(
        F.median("r").alias("median_r"), F.avg("r").alias("mean_r"), F.count("*").alias("n_voxels"))
    return out if names is None else out.join(names, "label", "left").withColumn(
        "name", F.coalesce("name", F.concat(F.lit("parcel_"), F.col("label").cast("string"))))


def reliability_strata(corr: DataFrame, ceiling: DataFrame, thresholds: list[float], on: Keys, keys: Keys = []) -> DataFrame:
    """MET8: per threshold the number of channels with a ceiling of at least it and
    their median and mean r; null where there are none."""
    both = corr.join(ceiling, on)
    grid = both.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    inside = F.col("nc") >= F.col("threshold")
    return grid.groupBy(*keys, "threshold").agg(
        F.count_if(inside).alias("n_voxels"), F.median(F.when(inside, F.col("r"))).alias("median_r"),
        F.avg(F.when(inside, F.col("r"))).alias("mean_r"))


def label_split(corr: DataFrame, labels: DataFrame, on: Keys, keys: Keys = []) -> DataFrame:
    """MET9: count, median and mean r of labelled and of unlabelled channels."""
    has = F.coalesce(F.col("label") > 0, F.lit(False))
    r = lambda c: F.when(c, F.col("r"))
    return corr.join(labels, on, "left").groupBy(*keys).agg(
        F.count_if(has).alias("n_labeled"), F.median(r(has)).alias("labeled_median_r"), F.avg(r(has)).alias("labeled_mean_r"),
        F.count_if(~has).alias("n_unlabeled"), F.median(r(~has)).alias("unlabeled_median_r"), F.avg(r(~has)).alias("unlabeled_mean_r"))


def r_squared(df: DataFrame, keys: Keys = [], channel: str = "voxel") -> DataFrame:
    """MET10: R2 per target column (1 - SSE / SST), averaged over columns; a constant
    column counts 1 if predicted exactly, else 0."""
    one = df.groupBy(*keys, channel).agg(F.sum((F.col("y") - F.col("p")) ** 2).alias("sse"),
                                         (F.var_pop("y") * F.count("y")).alias("sst"))
    r2 = F.when(F.col("sst") > 0, 1 - F.try_divide(F.col("sse"), F.col("sst"))).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return one.groupBy(*keys).agg(F.avg(r2).alias("r2"))


def total_r_squared(df: DataFrame, keys: Keys = [], channel: str = "voxel") -> DataFrame:
    """ENC2: 1 - SSE / SST with both summed over all target columns."""
    one = df.groupBy(*keys, channel).agg(F.sum((F.col("y") - F.col("p")) ** 2).alias("sse"),
                                         (F.var_pop("y") * F.count("y")).alias("sst"))
    return one.groupBy(*keys).agg((1 - F.try_divide(F.sum("sse"), F.sum("sst"))).alias("r2"))


def run_record(df: DataFrame, ceiling: DataFrame, labels: DataFrame, keys: Keys, thresholds: list[float]) -> DataFrame:
    """MET11: one row per key with the scores above, ceiling statistics and a list of strata."""
    corr = voxelwise_correlation(df, keys)
    on = [*keys, "voxel"]
    strata = reliability_strata(corr, ceiling, thresholds, on, keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("threshold", "n_voxels", "median_r", "mean_r"))).alias("strata"))
    pattern = pattern_correlation(df, keys).groupBy(*keys).agg(F.median("r").alias("median_pattern_r"))
    nc = ceiling.groupBy(*keys).agg(F.median("nc").alias("nc_median"), F.avg("nc").alias("nc_mean"))
    rows = df.groupBy(*keys).agg(F.count_distinct("stim_id").alias("n_eval"), F.count_distinct("voxel").alias("n_voxels"))
    out = correlation_summary(corr, keys)
    for part in (pattern, nc, rows, label_split(corr, labels, on, keys), strata):
        out = out.join(part, keys, "left")
    return out

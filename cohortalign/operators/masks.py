"""Filters, masks and predicates (FIL1-FIL12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import require


def keep_masked(values: DataFrame, mask: DataFrame, on: list[str] = ["subject", "voxel"]) -> DataFrame:
    """FIL1: rows of channels inside the mask."""
    return values.join(mask.where("in_mask").select(*on), on, "left_semi")


def labels_in_mask(labels: DataFrame, mask: DataFrame, on: list[str] = ["subject", "voxel"]) -> DataFrame:
    """FIL2: the label of every channel inside the mask, 0 where it has none."""
    return mask.where("in_mask").select(*on).join(labels, on, "left").select(*on, F.coalesce("label", F.lit(0)).alias("label"))


def analysis_mask(labels: DataFrame, mask: DataFrame, mode: str = "all", min_voxels: int = 10) -> DataFrame:
    """FIL3: (subject, voxel, keep). ``all`` keeps what is in the mask; ``labelled`` of that only channels whose
    label is common to all subjects with ``min_voxels`` channels or more in each.
    A subject of which nothing is left fails the job."""
    inside = labels_in_mask(labels, mask)
    if mode == "all":
        kept = inside.withColumn("keep", F.lit(True))
    elif mode == "labelled":
        from .harmonize import common_labels

        common = common_labels(inside, min_voxels).withColumn("_c", F.lit(True))
        kept = inside.join(common, "label", "left").withColumn("keep", F.coalesce("_c", F.lit(False))).drop("_c")
    else:
        raise ValueError(f"unknown mode {mode}")
    return kept.select("subject", "voxel", "label", "keep")


def mask_summary(kept: DataFrame) -> DataFrame:
    """Kept and dropped channels and the kept fraction by subject; none kept is an error."""
    out = kept.groupBy("subject").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"))
    out = require(out, F.col("kept") > 0, "the analysis mask leaves no channel")
    return out.withColumn("fraction", F.col("kept") / (F.col("kept") + F.col("dropped")))


def merge_atlases(atlases: list[tuple[DataFrame, int]], on: list[str] = ["subject", "voxel"]) -> DataFrame:
    """FIL4: labels of several atlases with offsets; the first atlas that labels a channel wins."""
    parts = [df.where("label > 0").select(*on, (F.col("label") + offset).alias("label"), F.lit(i).alias("_p"))
             for i, (df, offset) in enumerate(atlases) if df is not None]
    if not parts:
        raise ValueError("no atlas")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy(*on).agg(F.min_by("label", "_p").alias("label"))


def split_of_order(df: DataFrame, order: str = "order", first_shared: int = 1000) -> DataFrame:
    """FIL5: adds ``split``: orders above the shared block are train, the others test."""
    return df.withColumn("split", F.when(F.col(order) > first_shared, "train").otherwise("test"))


def trial_stimulus(trials: DataFrame, design: DataFrame, on: list[str] = ["subject", "order"]) -> DataFrame:
    """FIL6: the stimulus id of each trial, from a 1-based design table to 0-based ids."""
    return trials.join(design, on).withColumn("stim_id", F.col("image") - 1).drop("image")


def first_sessions(df: DataFrame, n: int, by: list[str] = ["subject"], session: str = "session") -> DataFrame:
    """FIL7: rows of the first n sessions of each subject; fewer sessions than n is an error."""
    if n < 1:
        raise ValueError("n must be at least 1")
    have = df.groupBy(*by).agg(F.sort_array(F.collect_set(session)).alias("_s"))
    have = require(have, F.size("_s") >= n, "fewer sessions than asked for")
    return df.join(have.select(*by, F.col("_s")[n - 1].alias("_last")), by).where(F.col(session) <= F.col("_last")).drop("_last")


def session_of_trial(df: DataFrame, index: str = "trial", per_session: int = 750, n_design: int | None = None) -> DataFrame:
    """FIL8: session number of a trial counted from 0; trials past the design's end go."""
    out = df.withColumn("session", F.floor(F.col(index) / per_session).cast("int") + 1)
    return out if n_design is None else out.where(F.col(index) < n_design)


def item_order(trials: DataFrame, by: list[str] = ["subject"], item: str = "stim_id", index: str = "trial", order: str = "sorted") -> DataFrame:
    """FIL9: (by, item, row_idx): position of each item, by id or by first appearance."""
    if order not in ("sorted", "first_seen"):
        raise ValueError(f"unknown order {order}")
    items = trials.groupBy(*by, item).agg(F.min(index).alias("_first"))
    w = Window.partitionBy(*by).orderBy(*([item] if order == "sorted" else ["_first", item]))
    return items.select(*by, item, (F.row_number().over(w) - 1).alias("row_idx"))


def rows_at(df: DataFrame, positions: DataFrame, column: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """FIL10: rows at the wanted positions, and a one-row table of the positions out of
    range; the latter fails if no position is in range."""
    kept = df.join(positions.select(column), column, "left_semi")
    hit = positions.join(df.select(column).distinct().withColumn("_in", F.lit(1)), column, "left")
    counts = hit.agg(F.count("_in").alias("n_kept"), F.count_if(F.col("_in").isNull()).alias("n_dropped"))
    return kept, require(counts, F.col("n_kept") > 0, "no position is in range")


def reliable_channels(ceiling: DataFrame, threshold: float = 0.1) -> DataFrame:
    """FIL11: channels whose noise ceiling is at least the threshold."""
    return ceiling.where(F.col("nc") >= threshold)


def parse_thresholds(thresholds) -> list[float]:
    """FIL12: distinct thresholds in order; negative ones are an error."""
    out = sorted({float(t) for t in thresholds or []})
    if out and out[0] < 0:
        raise ValueError("thresholds must not be negative")
    return out


def threshold_token(threshold):
    """FIL12: a threshold as part of a column name: 0.1 gives ``0p1``."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", threshold), r"0+$|\.0+$", ""), r"\.", "p")

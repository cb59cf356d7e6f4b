"""Label harmonisation across subjects (HAR1-HAR9). Tables of (subject, voxel, label), 0 = none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import require


def label_sizes(labels: DataFrame, min_voxels: int = 10) -> DataFrame:
    """HAR1: (subject, label, n) of labels with at least ``min_voxels`` channels."""
    return labels.where("label > 0").groupBy("subject", "label").agg(F.count("*").alias("n")).where(F.col("n") >= min_voxels)


def common_labels(labels: DataFrame, min_voxels: int = 10) -> DataFrame:
    """HAR2: labels large enough in every subject."""
    subjects = labels.agg(F.count_distinct("subject").alias("_n"))
    per = label_sizes(labels, min_voxels).groupBy("label").agg(F.count_distinct("subject").alias("n"))
    return per.join(subjects, per.n == subjects._n).select("label")  # one row on the right


def require_common(common: DataFrame, min_k: int) -> DataFrame:
    """HAR3: a one-row count of common labels; fails below ``min_k + 1``."""
    return require(common.agg(F.count("*").alias("n_common")), F.col("n_common") >= min_k + 1, "too few common labels")


def label_remap(common: DataFrame) -> DataFrame:
    """Old labels to contiguous new ones from 1; one row per label."""
    return common.select("label", F.row_number().over(Window.orderBy("label")).alias("new_label"))


def harmonize(labels: DataFrame, min_voxels: int = 10) -> DataFrame:
    """HAR4: common labels renumbered 1..R in order, all others 0."""
    remap = label_remap(common_labels(labels, min_voxels))
    return labels.join(remap, "label", "left").select("subject", "voxel", F.coalesce("new_label", F.lit(0)).alias("label"))


def parcel_counts(labels: DataFrame, n_parcels: int) -> DataFrame:
    """(subject, label, n) for labels 1..n_parcels, zero counts included."""
    grid = labels.select("subject").distinct().withColumn("label", F.explode(F.sequence(F.lit(1), F.lit(n_parcels))))
    have = labels.where("label > 0").groupBy("subject", "label").agg(F.count("*").alias("_n"))
    return grid.join(have, ["subject", "label"], "left").select("subject", "label", F.coalesce("_n", F.lit(0)).alias("n"))


def _sizes(counts: DataFrame, min_voxels: int, empty_count: bool) -> DataFrame:
    some = F.lit(True) if empty_count else F.col("n") > 0
    n = F.when(some, F.col("n"))
    ids = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("label"))))
    return counts.groupBy("subject").agg(
        F.count_if(F.col("n") > 0).alias("present"), F.min(n).alias("min_size"), F.median(n).alias("median_size"),
        F.avg(n).alias("mean_size"), F.max(n).alias("max_size"), ids(F.col("n") == 0).alias("empty"),
        ids((F.col("n") > 0) & (F.col("n") < min_voxels)).alias("small"))


def utilization_summary(labels: DataFrame, n_parcels: int, min_voxels: int = 10, min_labeled_fraction: float = 0.5) -> DataFrame:
    """HAR5: labelled share, parcels present, sizes of non-empty ones, empty and small ones, warning."""
    share = labels.groupBy("subject").agg(F.avg((F.col("label") > 0).cast("double")).alias("labeled_fraction"))
    out = share.join(_sizes(parcel_counts(labels, n_parcels), min_voxels, False), "subject")
    return out.withColumn("warn", (F.col("labeled_fraction") < min_labeled_fraction) | (F.size("empty") > 0) | (F.size("small") > 0))


def utilization_report(summary: DataFrame) -> DataFrame:
    """HAR6: range of labelled share and presence over subjects, and who has warnings."""
    f, p = "labeled_fraction", "present"
    return summary.agg(F.min(f).alias("min_fraction"), F.median(f).alias("median_fraction"), F.max(f).alias("max_fraction"),
                       F.min(p).alias("min_present"), F.median(p).alias("median_present"), F.max(p).alias("max_present"),
                       F.sort_array(F.collect_list(F.when(F.col("warn"), F.col("subject")))).alias("warned"))


def parcel_qc(labels: DataFrame, n_parcels: int, min_voxels: int = 10) -> DataFrame:
    """HAR7: like HAR5, but size statistics count empty parcels."""
    return _sizes(parcel_counts(labels, n_parcels), min_voxels, True)


def drop_reasons(labels: DataFrame, min_voxels: int = 10) -> DataFrame:
    """HAR8: (subject, label, n, reason): kept, absent, small or not_common, for every
    subject and every label that any subject has."""
    grid = labels.select("subject").distinct().crossJoin(labels.where("label > 0").select("label").distinct())  # subjects x labels
    have = labels.where("label > 0").groupBy("subject", "label").agg(F.count("*").alias("_n"))
    common = common_labels(labels, min_voxels).withColumn("_c", F.lit(True))
    out = grid.join(have, ["subject", "label"], "left").join(common, "label", "left")
    n = F.coalesce("_n", F.lit(0))
    reason = F.when(n == 0, "absent").when(n < min_voxels, "small").when(F.col("_c").isNull(), "not_common").otherwise("kept")
    return out.select("subject", "label", n.alias("n"), reason.alias("reason"))


def reason_counts(reasons: DataFrame) -> DataFrame:
    """HAR8: labels per subject and reason, one column each."""
    return reasons.groupBy("subject").pivot("reason", ["absent", "small", "not_common", "kept"]).count().na.fill(0)


def retained_coverage(labels: DataFrame, mask: DataFrame | None = None, min_voxels: int = 10) -> DataFrame:
    """HAR9: share of channels that keep a label after harmonisation, of those in
    the mask or of all."""
    if mask is not None:
        from .masks import labels_in_mask

        labels = labels_in_mask(labels, mask)
    return harmonize(labels, min_voxels).groupBy("subject").agg(F.avg((F.col("label") > 0).cast("double")).alias("coverage"))

"""Joins that align row sets (JON1-JON8). Checks return tables; the strict forms raise on the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import require


def align_rows(source: DataFrame, query: DataFrame, key: str = "stim_id", require_all: bool = True) -> DataFrame:
    """JON1: the source's row for each query id, with the query's ``row_idx`` kept. A missing id
    fails the job, or is dropped; see :func:`missing_count`."""
    if not require_all:
        return query.join(source, key)
    out = query.join(source.withColumn("_in", F.lit(True)), key, "left")
    return require(out, F.col("_in").isNotNull(), "an id has no source row").drop("_in")


def missing_count(source: DataFrame, query: DataFrame, key: str = "stim_id") -> DataFrame:
    """JON1: one row with how many query ids have and lack a source row; none at all fails."""
    hit = query.join(source.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    out = hit.agg(F.count("_in").alias("n_aligned"), F.count_if(F.col("_in").isNull()).alias("n_missing"))
    return require(out, F.col("n_aligned") > 0, "no query id has a source row")


def align_train_rows(train: DataFrame, targets: DataFrame, by_id: bool, key: str = "stim_id") -> DataFrame:
    """JON2: training rows beside their target rows, joined by id, or, if the targets carry no ids, by
    row number, which needs equal counts."""
    if by_id:
        return train.join(targets.drop("row_idx"), key)
    counts = train.agg(F.count("*").alias("_a")).crossJoin(targets.agg(F.count("*").alias("_b")))  # one row each
    counts = require(counts, F.col("_a") == F.col("_b"), "row counts differ and the targets have no ids")
    return train.join(targets.drop(key), "row_idx").join(counts, F.col("_a") == F.col("_b")).drop("_a", "_b")


def id_checks(ids: DataFrame, by: list[str], key: str = "stim_id", index: str = "row_idx") -> DataFrame:
    """JON3: per group the number of ids, of distinct ones, and whether they ascend by ``index``."""
    w = Window.partitionBy(*by).orderBy(index)
    down = F.coalesce(F.col(key) < F.lag(key).over(w), F.lit(False))
    return ids.withColumn("_down", down).groupBy(*by).agg(
        F.count(key).alias("n"), F.count_distinct(key).alias("n_distinct"), (~F.max("_down")).alias("sorted"))


def fewshot_candidates(own: DataFrame, shared: DataFrame | None, key: str = "stim_id") -> DataFrame:
    """JON4: (subject, id, own_row, template_row) of the subject's items that the template has; both
    rows are ranks by id. Without a shared list every own row is its own template row."""
    own = own.withColumn("own_row", F.row_number().over(Window.partitionBy("subject").orderBy(key)) - 1)
    if shared is None:
        return own.withColumn("template_row", F.col("own_row"))
    shared = shared.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("template_row"))
    return own.join(shared, key)


def exclude_rows(pool: DataFrame, evaluation: DataFrame, on: list[str]) -> DataFrame:
    """JON5: the support pool without the evaluation rows."""
    return pool.join(evaluation.select(*on), on, "left_anti")


def shared_manifest(a: DataFrame, b: DataFrame, key: str = "stim_id", pattern: str = "stim_%06d.png") -> DataFrame:
    """JON6: items of two runs with both row numbers and the file name of each."""
    out = a.select(key, F.col("row_idx").alias("row_a")).join(b.select(key, F.col("row_idx").alias("row_b")), key)
    return out.withColumn("path", F.format_string(pattern, F.col(key)))


def metric_deltas(a: DataFrame, b: DataFrame, on: list[str] = ["metric"]) -> DataFrame:
    """JON7: b minus a for every metric that both have."""
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), on).withColumn("delta", F.col("b") - F.col("a"))


def contract_violations(responses: DataFrame, features: DataFrame, labels: DataFrame, n_items: int) -> DataFrame:
    """JON8: (subject, rule, n) of broken input rules: ids outside 0..n_items-1, repeated cells,
    items without features, channels without a label row, non-finite values."""
    def rule(name, df):
        return df.groupBy("subject").agg(F.count("*").alias("n")).select("subject", F.lit(name).alias("rule"), "n")

    items = responses.select("subject", "stim_id").distinct()
    parts = [
        rule("id_range", items.where((F.col("stim_id") < 0) | (F.col("stim_id") >= n_items))),
        rule("repeated_cell", responses.groupBy("subject", "stim_id", "voxel").agg(F.count("*").alias("c")).where("c > 1")),
        rule("no_features", items.join(features.select("stim_id").distinct(), "stim_id", "left_anti")),
        rule("no_label", responses.select("subject", "voxel").distinct().join(labels, ["subject", "voxel"], "left_anti")),
        rule("not_finite", responses.where(F.col("val").isNull() | F.isnan("val") | (F.abs("val") == float("inf")))),
    ]
    return reduce(DataFrame.union, parts)


def require_contract(violations: DataFrame) -> DataFrame:
    """JON8, strict: fails the job on any violation."""
    return require(violations.agg(F.count("*").alias("n_violations")), F.col("n_violations") == 0, "input contract broken")

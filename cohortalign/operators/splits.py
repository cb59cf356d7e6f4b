"""Splits and samples (SPL1-SPL7). Draws are by md5 key, so they are reproducible in
SQL and on any cluster; see functions.common.draw_key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import draw_key, require


def draw(rows: DataFrame, n: int, seed: int, by: list[str] = [], key: str = "row_idx", replicate=0) -> DataFrame:
    """At most n rows of each group, by ascending draw key. The rank is limited per
    group, so Spark keeps only n rows per group and partition before the shuffle."""
    order = [draw_key(seed, replicate, *by, key), F.col(key)]
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def fixed_eval_split(rows: DataFrame, n: int, seed: int = 42, by: list[str] = ["subject"], path: str | None = None) -> DataFrame:
    """SPL1: the evaluation rows: those stored under ``path`` if they are there, whatever the seed,
    else n drawn once and stored. Fewer rows than n, or a stored split of another size, is an error."""
    spark = rows.sparkSession
    if path is not None and _exists(spark, path):
        out = spark.read.parquet(path)
    else:
        out = draw(rows.select(*by, "row_idx"), n, seed, by)
        if path is not None:
            out.write.parquet(path)
            out = spark.read.parquet(path)
    sizes = require(out.groupBy(*by).agg(F.count("*").alias("_n")), F.col("_n") == n, "the evaluation split has another size")
    return out.join(sizes.select(*by), by)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def split_checks(split: DataFrame, n_rows: int, by: list[str] = ["subject"]) -> DataFrame:
    """SPL2: per group the size, distinct rows and rows out of range."""
    out = (F.col("row_idx") < 0) | (F.col("row_idx") >= n_rows)
    return split.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("row_idx").alias("n_distinct"), F.count_if(out).alias("n_out"))


def sample_shots(rows: DataFrame, evaluation: DataFrame, n_shots: int | None, seed: int, by: list[str] = ["subject"]) -> DataFrame:
    """SPL3: shots from the rows outside the evaluation, as many as there are at most; all of them without a number."""
    pool = rows.join(evaluation.select(*by, "row_idx"), [*by, "row_idx"], "left_anti")
    return pool if n_shots is None else draw(pool, n_shots, seed, by)


def unfixed_split(rows: DataFrame, n_shots: int, seed: int, min_eval: int = 50, by: list[str] = ["subject"]) -> DataFrame:
    """SPL4: each row's role: n shots drawn with at least ``min_eval`` rows left to evaluate on, the rest evaluation."""
    size = F.count("*").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(draw_key(seed, 0, *by, "row_idx"), "row_idx"))
    shots = F.least(F.lit(n_shots), F.greatest(F.lit(0), size - min_eval))
    return rows.withColumn("role", F.when(rank <= shots, "shot").otherwise("eval"))


def eval_rows_of_run(runs: DataFrame, rows: DataFrame, min_eval: int = 50) -> DataFrame:
    """SPL5: (run, row_idx): the evaluation rows that a run's record lists, else those of SPL4
    for its number of shots and seed. runs(run, subject, n_shots, seed, eval_indices)."""
    listed = runs.where("eval_indices is not null").select("run", F.explode("eval_indices").alias("row_idx"))
    again = runs.where("eval_indices is null").join(rows.select("subject", "row_idx"), "subject")
    key = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("seed").cast("string"), F.lit("0"), F.col("subject").cast("string"),
                                               F.col("row_idx").cast("string"))), 1, 8), 16, 10).cast("long")
    w = Window.partitionBy("run")
    rank, size = F.row_number().over(w.orderBy(key, "row_idx")), F.count("*").over(w)
    again = again.withColumn("_r", rank).withColumn("_s", F.least(F.col("n_shots"), F.greatest(F.lit(0), size - min_eval)))
    return listed.union(again.where("_r > _s").select("run", "row_idx"))


def loso_folds(subjects: DataFrame) -> DataFrame:
    """SPL6: (fold, subject, role): every subject held out once; fewer than two is an error."""
    s = require(subjects.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))), F.col("_n") > 1, "at least two subjects").drop("_n")
    held = s.select(F.col("subject").alias("fold"))
    return held.crossJoin(s).withColumn("role", F.when(F.col("fold") == F.col("subject"), "test").otherwise("train"))  # subjects squared


def choose_examples(scores: DataFrame, n: int, mode: str = "top", seed: int = 42, key: str = "row_idx", score: str = "r") -> DataFrame:
    """SPL7: the n best, worst or randomly drawn rows; ties by row."""
    order = {"top": [F.desc(score), key], "worst": [F.asc(score), key], "random": [draw_key(seed, 0, key), key]}
    if mode not in order:
        raise ValueError(f"unknown mode {mode}")
    return scores.orderBy(*order[mode]).limit(n)

"""Aggregations on trials and scaling of responses (AGG1-AGG5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_responses(trials: DataFrame, keys: list[str] = ["subject", "split", "stim_id"], channel: str = "voxel", value: str = "val") -> DataFrame:
    """AGG1: mean over trials per key and channel (hash aggregate with partial sums)."""
    return trials.groupBy(*keys, channel).agg(F.avg(value).alias(value))


def mean_response_rows(trials: DataFrame, keys: list[str], values: str = "v") -> DataFrame:
    """AGG1 on array rows: the vectors of a key are summed in Arrow within each partition
    before the shuffle, which then carries one partial sum per key and partition."""
    fields = [trials.schema[k] for k in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def part(batches, count_in=False, final=False):
        sums: dict = {}
        width, kinds = len(keys), None
        for b in batches:
            kinds = [b.schema.field(i).type for i in range(width)]
            heads = list(zip(*[b.column(i).to_pylist() for i in range(width)])) if width else [()] * b.num_rows
            counts = b.column(width + 1).to_pylist() if count_in else [1] * b.num_rows
            for k, v, n in zip(heads, b.column(width).to_pylist(), counts):
                if v is None:
                    continue
                s = sums.get(k)
                v = np.asarray(v, float)
                sums[k] = (s[0] + v, s[1] + n) if s else (v, n)
        cols = [pa.array([k[i] for k in sums], kinds[i]) for i in range(width if sums else 0)]
        total = [(s / n if final else s) for s, n in sums.values()]
        rest = [pa.array([t.tolist() for t in total], pa.list_(pa.float64())), pa.array([n for _, n in sums.values()], pa.int64())]
        if sums:
            yield pa.RecordBatch.from_arrays([*cols, *rest], [*keys, "v", "n"])

    schema = f"{ddl}, v array<double>, n long" if ddl else "v array<double>, n long"
    partial = trials.select(*keys, F.col(values).cast("array<double>").alias("v")).mapInArrow(part, schema)
    return partial.repartition(*keys).mapInArrow(lambda it: part(it, True, True), schema)


def test_trials(trials: DataFrame) -> DataFrame:
    """AGG2: single trials of the test split, with the 0-based rank of their item as label."""
    t = trials.where("split = 'test'")
    items = t.select("subject", "stim_id").distinct()
    items = items.withColumn("label", F.row_number().over(Window.partitionBy("subject").orderBy("stim_id")) - 1)
    return t.join(items, ["subject", "stim_id"])


def split_counts(trials: DataFrame) -> DataFrame:
    """AGG3: per subject and split, trials, items and the sessions used."""
    return trials.groupBy("subject", "split").agg(F.count("*").alias("n_trials"), F.count_distinct("stim_id").alias("n_items"),
                                                  F.sort_array(F.collect_set("session")).alias("sessions"))


def channel_stats(df: DataFrame, keys: list[str], value: str = "val", ddof: int = 0, floor: float = 1e-8) -> DataFrame:
    """Mean and standard deviation per key and channel; a deviation under the floor becomes 1."""
    sd = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(sd, F.lit(0.0)).alias("sd"))
    return out.withColumn("sd", F.when(F.col("sd") < floor, 1.0).otherwise(F.col("sd")))


def standardize(df: DataFrame, stats: DataFrame, keys: list[str], scale: float = 1.0, value: str = "val") -> DataFrame:
    """AGG4: (scaled value - mean) / sd with the training set's statistics, for any set."""
    return df.join(stats, keys).withColumn(value, (F.col(value) * scale - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def unstandardize(df: DataFrame, stats: DataFrame, keys: list[str], scale: float = 1.0, value: str = "val") -> DataFrame:
    """AGG4 inverted."""
    return df.join(stats, keys).withColumn(value, (F.col(value) * F.col("sd") + F.col("mean")) / scale).drop("mean", "sd")


def renormalize(pred: DataFrame, train_stats: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """AGG5: predictions brought to the training mean and deviation by their own statistics."""
    own = channel_stats(pred, keys, value).withColumnsRenamed({"mean": "_m", "sd": "_s"})
    out = pred.join(own, keys).join(train_stats, keys)
    return out.withColumn(value, (F.col(value) - F.col("_m")) / F.col("_s") * F.col("sd") + F.col("mean")).drop("_m", "_s", "mean", "sd")

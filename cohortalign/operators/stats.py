"""Bootstrap, permutation, false discovery and condition summaries (STA1-STA4).

Samples are numbered, and replicate and draw numbers are hashed to sample numbers, so that every draw can be repeated.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import draw_key, require

HELD_VALUES, REPLICATES = 4_000_000, 50  # values of a key that travel as one array, and replicates that a task makes of it at a time
RANGES = 200  # ranges of p-values that false-discovery control ranks apart


def _numbered(samples: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    out = samples.withColumn("_i", F.row_number().over(w.orderBy("rep")) - 1).withColumn("_n", F.count("*").over(w))
    return out


def bootstrap_interval(samples: DataFrame, keys: list[str], n_bootstrap: int = 5000, ci_level: float = 95.0,
                       statistic: str = "mean", seed: int = 42) -> DataFrame:
    """STA1: (keys, ci_low, ci_high) of the mean or median of ``value``; samples(keys, rep, value)."""
    if n_bootstrap < 100 or not 0 < ci_level < 100 or statistic not in ("mean", "median"):
        raise ValueError("at least 100 replicates, a level in (0, 100), and mean or median")
    s = _numbered(samples, keys)
    sizes = s.groupBy(*keys).agg(F.max("_n").alias("_n"))
    large = (sizes.agg(F.max("_n")).first()[0] or 0) > HELD_VALUES
    one = _joined_replicates(s, sizes, keys, n_bootstrap, statistic, seed) if large else _held_replicates(s, keys, n_bootstrap, statistic, seed)
    a = (100.0 - ci_level) / 200.0
    return one.groupBy(*keys).agg(F.percentile("v", a).alias("ci_low"), F.percentile("v", 1 - a).alias("ci_high"))


def _held_replicates(s: DataFrame, keys: list[str], n_bootstrap: int, statistic: str, seed: int) -> DataFrame:
    """(keys, v): the statistic of each replicate. A key's values travel as one array to each block of ``REPLICATES`` replicates, whose
    draws are taken from it in Arrow; no draw is a row."""
    names = [f"_k{i}" for i in range(len(keys))]
    held = s.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "value"))), lambda x: x["value"].cast("double")).alias("_x"))
    part = F.concat_ws("-", *[F.col(n).cast("string") for n in names]) if names else F.lit("")
    some = reduce(or_, [F.col(n).isNotNull() for n in names], F.lit(False))
    blocks = held.withColumn("_name", F.when(some, F.concat(F.lit("-"), part)).otherwise(F.lit(""))).withColumn(
        "_r", F.explode(F.sequence(F.lit(0), F.lit(-(-n_bootstrap // REPLICATES) - 1))))
    blocks = blocks.repartition(*names, "_r").select(*names, "_name", "_r", "_x")
    k = len(names)

    def run(batches):
        ends: list[bytes] = []
        for b in batches:
            for at in range(b.num_rows):
                x = b.column("_x")[at].values
                there = ~np.array(x.is_null())
                x = x.to_numpy(zero_copy_only=False).astype(float)
                ends += [f"-{d}".encode() for d in range(len(ends), len(x))]
                first, name = b.column("_r")[at].as_py() * REPLICATES, b.column("_name")[at].as_py()
                out = []
                for r in range(first, min(first + REPLICATES, n_bootstrap)):
                    head = f"{seed}-{r}{name}".encode()
                    drawn = np.frombuffer(b"".join([md5(head + e).digest()[:4] for e in ends[:len(x)]]), ">u4") % len(x)
                    v = x[drawn[there[drawn]]]
                    out.append(None if not len(v) else float(v.mean() if statistic == "mean" else np.median(v)))
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array([at] * len(out))) for i in range(k)], pa.array(out, pa.float64())], [*names, "v"])

    kinds = "".join(f"{n} {blocks.schema[n].dataType.simpleString()}, " for n in names)
    return blocks.mapInArrow(run, f"{kinds}v double").select(*[F.col(n).alias(c) for n, c in zip(names, keys)], "v")


def _joined_replicates(s: DataFrame, sizes: DataFrame, keys: list[str], n_bootstrap: int, statistic: str, seed: int) -> DataFrame:
    """The same for keys with more values than one array should hold: each draw is a row that is joined with its value."""
    draws = sizes.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1)))).withColumn(
        "_d", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    draws = draws.withColumn("_i", F.pmod(draw_key(seed, F.col("_b"), *keys, "_d"), F.col("_n")).cast("int"))
    got = draws.drop("_n").join(s.select(*keys, "_i", "value"), [*keys, "_i"])
    stat = F.avg("value") if statistic == "mean" else F.median("value")
    return got.groupBy(*keys, "_b").agg(stat.alias("v")).drop("_b")


def permutation_test(pairs: DataFrame, keys: list[str], n_permutations: int = 10000, alternative: str = "two-sided",
                     seed: int = 42) -> DataFrame:
    """STA2: (keys, p_value) of a difference of means. pairs(keys, side 'a' or 'b', rep, value), at least
    two values a side. Ties are decided on means rounded to 10 places."""
    if n_permutations < 100 or alternative not in ("two-sided", "greater", "less"):
        raise ValueError("at least 100 permutations; two-sided, greater or less")
    s = pairs.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("side", "rep")))
    real = s.groupBy(*keys).agg(F.count_if(F.col("side") == "a").alias("_na"), F.count_if(F.col("side") == "b").alias("_nb"), F.round(
        F.avg(F.when(F.col("side") == "a", F.col("value"))) - F.avg(F.when(F.col("side") == "b", F.col("value"))), 10).alias("_o"))
    real = require(real, (F.col("_na") > 1) & (F.col("_nb") > 1), "at least two values a side")
    p = s.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
    w = Window.partitionBy(*keys, "_b").orderBy(draw_key(seed, F.col("_b"), *keys, "_i"), "_i")
    p = p.withColumn("_r", F.row_number().over(w)).join(real, keys)
    first = F.col("_r") <= F.col("_na")
    one = p.groupBy(*keys, "_b", "_o").agg(F.round(F.avg(F.when(first, F.col("value"))) - F.avg(F.when(~first, F.col("value"))), 10).alias("_d"))
    hit = {"greater": F.col("_d") >= F.col("_o"), "less": F.col("_d") <= F.col("_o"), "two-sided": F.abs("_d") >= F.abs("_o")}[alternative]
    return one.groupBy(*keys).agg(((F.count_if(hit) + 1) / (n_permutations + 1)).alias("p_value"))


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05, by: list[str] = []) -> DataFrame:
    """STA3: adds ``q`` and ``reject``; p outside [0, 1] is an error. Ties share the lowest q.

    Equal p-values are counted first. The distinct ones are dealt to ranges cut at their quantiles; running
    counts and minima are taken within ranges and over the ranges' totals, so no task holds all p-values."""
    t = require(tests, F.col("p").between(0, 1), "p-values must lie in [0, 1]")
    names = t.select(*by, "p").schema.names
    tied = t.groupBy(*names).agg(F.count("*").alias("_k"))
    cuts = tied.groupBy(*by).agg(F.percentile_approx("p", [i / RANGES for i in range(1, RANGES)]).alias("_cuts"), F.sum("_k").alias("_m"))
    same = reduce(and_, [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in by], F.lit(True))
    tied = tied.alias("_a").join(cuts.alias("_b"), same).select("_a.*", "_m", F.size(F.filter("_cuts", lambda x: x < F.col("p"))).alias("_range"))
    inside, across = Window.partitionBy(*by, "_range"), Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    totals = tied.groupBy(*by, "_range").agg(F.sum("_k").alias("_k"))  # RANGES rows a group at most
    before = totals.withColumn("_before", F.sum("_k").over(across.orderBy("_range")) - F.col("_k")).drop("_k")

    def ranged(left, right):
        on = reduce(and_, [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in by], F.col("_a._range") == F.col("_b._range"))
        return left.alias("_a").join(right.alias("_b"), on).select("_a.*", *[f"_b.{c}" for c in right.columns if c not in (*by, "_range")])

    tied = ranged(tied, before)
    last = F.col("_before") + F.sum("_k").over(inside.orderBy("p"))
    tied = tied.withColumn("_q", F.least(F.col("p") * F.col("_m") / last, F.lit(1.0)))
    least = tied.groupBy(*by, "_range").agg(F.min("_q").alias("_q"))
    later = least.select(*by, "_range", F.min("_q").over(across.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    tied = ranged(tied, later)
    within = F.min("_q").over(inside.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0))
    tied = tied.select(*names, F.least(within, "_later").alias("q"))
    on = reduce(and_, [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in names])
    return t.alias("_a").join(tied.alias("_b"), on).select("_a.*", "_b.q").withColumn("reject", F.col("q") <= alpha)


def condition_summary(long: DataFrame, permutation_metric: str = "median_r", n_bootstrap: int = 5000, n_permutations: int = 10000,
                      reference: int = 0, ci_level: float = 95.0, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """STA4: (condition, metric, n, mean, sd, ci_low, ci_high, delta, p, q, reject).

    long(condition, rep, metric, value). The last four are given for ``permutation_metric`` and conditions
    with two repeats or more, against the reference; if that has fewer, the first condition with two is used.
    """
    base = long.groupBy("condition", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    out = base.join(bootstrap_interval(long, ["condition", "metric"], n_bootstrap, ci_level, "mean", seed), ["condition", "metric"])
    chosen = long.where(F.col("metric") == permutation_metric)
    usable = chosen.groupBy("condition").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).where("n > 1")
    ref = usable.agg(F.min_by(F.struct("condition", "mean"), F.struct((F.col("condition") != reference), "condition")).alias("r")).select(
        F.col("r.condition").alias("ref"), F.col("r.mean").alias("ref_mean"))
    others = usable.crossJoin(ref).where("condition <> ref")  # one row on the right
    a = others.select("condition").join(chosen, "condition").select("condition", F.lit("a").alias("side"), "rep", "value")
    b = others.select(F.col("condition").alias("c"), "ref").join(chosen, F.col("ref") == chosen.condition).select(
        F.col("c").alias("condition"), F.lit("b").alias("side"), "rep", "value")
    p = permutation_test(a.union(b), ["condition"], n_permutations, "greater", seed).withColumnRenamed("p_value", "p")
    q = benjamini_hochberg(p, alpha)
    q = q.join(others.select("condition", (F.col("mean") - F.col("ref_mean")).alias("delta")), "condition").withColumn("metric", F.lit(permutation_metric))
    return out.join(q, ["condition", "metric"], "left")

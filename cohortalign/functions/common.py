"""Expressions and helpers used by many operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLAT = 1e-10  # a standard deviation below this counts as constant in correlations
FLOOR = 1e-8  # floor of standard deviations in z-scores and encoders
_own: list[str] = []


def rounded(c: Column | str, places: int = 6) -> Column:
    """Rounded, with minus zero made zero, so that engines agree."""
    return F.round(c, places) + F.lit(0.0)


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; 0 where either side is constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx < FLAT) | (sy < FLAT), F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(x, y), sx * sy))


def draw_key(seed: int, replicate, *parts) -> Column:
    """Reproducible sampling key: 32 bits of md5(seed-replicate-part-...)."""
    rep = replicate if isinstance(replicate, Column) else F.lit(replicate)
    text = F.concat_ws("-", F.lit(seed).cast("string"), rep.cast("string"), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: that of ``spark.checkpoint.dir``. A folder of
    this machine stands in for it in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        where = _own[0]
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df`` unchanged; the job fails with ``message`` on a row that breaks the condition."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint for a table whose row count is checked first; none if it is larger."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for cogrouping a table with what derives from it."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])

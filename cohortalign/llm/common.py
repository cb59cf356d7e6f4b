"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_own_dir: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only
    where that is unset in local mode (tests), a new temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that
    later steps neither repeat the work before it nor depend on an executor's disk."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def keeps_batch_size(function):
    """The function with the session's size of Arrow batches put back when it returns; what it writes meanwhile uses its own. Batches that run
    later are bounded by the session's bytes a batch."""
    @functools.wraps(function)
    def run(*args, **named):
        spark = SparkSession.active()
        before = spark.conf.get(BATCH, None)
        try:
            return function(*args, **named)
        finally:
            spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)

    return run


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Long texts: fewer rows per Arrow batch keep the Python workers small."""
    spark.conf.set(BATCH, str(rows))


def sliced(batches, rows: int = 1000):
    """Arrow batches in pieces of at most ``rows`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a staged table only if it has at most ``max_rows`` rows; otherwise
    the join stays a shuffled one."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, every other code point as it is. ``lower`` does the same for
    texts of one byte per code point and is much faster there."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, LOWER))


def text_key(col: Column) -> Column:
    """Identity of a text: two rows with equal texts get equal results, so copies
    are handled once under this key."""
    return F.unhex(F.md5(F.encode(F.coalesce(col, F.lit("")), "UTF-8")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (u long, v long) -> (node, component),
    component being the smallest node reachable. Nodes without edges don't appear.

    Alternating large-star and small-star rounds; each is two aggregations to a
    minimum and two joins, so a node with very many neighbours is never gathered
    in one task. Each round is written to the shared folder.
    """
    def shrink(e):
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                        F.least("u", "v").alias("v")).distinct()

    def mark(e):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    e = staged(shrink(edges.select("u", "v")), "cc")
    before = mark(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = shrink(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v"))
        e = staged(shrink(small), "cc")
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct())

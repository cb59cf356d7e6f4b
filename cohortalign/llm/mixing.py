"""Mixing sources to target weights by hash-threshold histograms (operator 5).

Every document has a 60-bit hash. Words are summed by source and by the next 12
bits of the hash; the bucket in which the running sum passes the source's budget is
the only one refined by the next 12 bits, five times at most. The threshold found
is a hash value: documents below it are taken once more. Nothing is sorted but
at most 4,096 bucket sums per source, and thresholds for smaller budgets are nested
in those for larger ones. DataFrame functions only.

Defined results: null or blank text has size 0 and is never taken; a null source is
a source of its own, last in order; rows with equal id and text share a hash and are
taken together; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, read, staged

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 5
MOST_COPIES = 3
MAX_BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(id_col: Column, text: Column) -> Column:
    key = F.concat_ws("-", id_col.cast("string"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, size) -> source, source_size, target.

    Weights 1, 2, 3, repeating, in code point order. Water filling in closed form:
    with sources in ascending order of cap / weight, a source is at its cap exactly
    if the level reached when all before it are at their caps is no less than its own.
    The windows run over one row per source, not over documents.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = total.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    w = w.withColumn("cap", (F.lit(MOST_COPIES) * F.col("source_size")).cast("double"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = (w.withColumn("all_words", F.sum("source_size").over(every))
          .withColumn("level", (F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                      / F.sum("w").over(after))
          .withColumn("capped", F.col("cap") <= F.col("level") * F.col("w")))
    # of the sources below their caps the first has the level, the highest: it takes no cap that isn't reached
    first_free = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    return w.withColumn("free_level", first_free).select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("free_level") * F.col("w")).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """docs(source, size, h), budgets(source, budget double) -> source, cut, with_cut.

    Documents of a source with ``h < cut`` are in; those with ``h = cut`` are in if
    ``with_cut``, which is so if that brings the sum nearer to the budget.
    """
    cur = budgets.where("budget > 0").select("source", F.lit(0).cast("long").alias("prefix"),
                                             F.col("budget").alias("left"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        part = docs.where("size > 0").select(
            F.col("source").alias("s"), "size", F.shiftright("h", shift).alias("b"))
        inside = part.join(cur, part.s.eqNullSafe(cur.source) & (F.shiftright(part.b, BITS) == cur.prefix))
        hist = inside.groupBy("source", "b", "left").agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("b")
        hist = hist.withColumn("upto", F.sum("n").over(run))
        last = F.max("b").over(Window.partitionBy("source"))
        hit = (hist.withColumn("last", last)
               .where(((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
                      | ((F.col("b") == F.col("last")) & (F.col("upto") < F.col("left")))))
        cur = hit.select("source", F.col("b").alias("prefix"),
                         (F.col("left") - (F.col("upto") - F.col("n"))).alias("left"), "n")
    return cur.select("source", F.col("prefix").alias("cut"),
                      (F.col("left") * 2 >= F.col("n")).alias("with_cut"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """Documents -> id, size, source_size, target, taken. See the module's text."""
    sized = staged(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        hash60(F.col(id_col), F.col(text_col)).alias("h")), "mix")
    target = staged(source_targets(sized), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    target = target.withColumn("whole", F.least(whole, F.lit(MOST_COPIES)).cast("long"))
    budgets = target.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    cuts = staged(thresholds(sized, budgets.where("budget >= 1e-6")), "mix-cuts")
    plan = target.join(cuts, target.source.eqNullSafe(cuts.source), "left").select(
        target.source.alias("s"), "source_size", "target", "whole", "cut", "with_cut")
    plan = broadcast_if_small(staged(plan, "mix-plan"), MAX_BROADCAST_SOURCES)
    extra = F.when(F.col("h") < F.col("cut"), 1).when(
        (F.col("h") == F.col("cut")) & F.col("with_cut"), 1).otherwise(0)
    return sized.join(plan, sized.source.eqNullSafe(plan.s)).select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * F.least(F.col("whole") + extra, F.lit(MOST_COPIES))).alias("taken"))


def op5_mixing(spark, sf_dir) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


QUERIES = {"op5_mixing": op5_mixing}

ORACLE_SQL = {"op5_mixing": r"""
with d as (
  select doc_id, source,
    case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size,
    ('0x' || substr(md5(concat_ws('-', doc_id::varchar, md5(coalesce(text, '')))), 1, 15))::bigint as h
  from documents),
s as (
  select source, sum(size)::double as source_size,
    ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::double as w
  from d group by source),
r as (
  select *, 3 * source_size as cap,
    ((select sum(source_size) from s) - coalesce(sum(3 * source_size) over (
      order by 3 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by 3 * source_size / w, source nulls last
                   rows between current row and unbounded following) as lvl
  from s),
t as (
  select source, source_size,
    case when cap <= lvl * w then cap
         else (select max(lvl) from r where not cap <= lvl * w) * w end as target
  from r),
p as (
  select *, least(3, case when source_size > 0 then floor(target / source_size) else 0 end) as whole from t),
b as (select *, target - whole * source_size as budget from p),
c as (
  select d.*, b.source_size, b.target, b.whole, b.budget,
    sum(size) over (partition by d.source order by h) as upto,
    sum(size) over (partition by d.source, h) as n,
    sum(size) over (partition by d.source) as total
  from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size::bigint as source_size, target,
  (size * least(3, whole + case when budget < 1e-6 or size = 0 then 0
     when upto < budget then case when upto = total then (2 * (budget - upto + n) >= n)::int else 1 end
     when upto - n < budget then (2 * (budget - (upto - n)) >= n)::int
     else 0 end))::bigint as taken
from c"""}

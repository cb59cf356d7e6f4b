"""From raw documents to a mixed training set in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet in the
shared folder and read back as the next stage's docs. All but the last return the columns of
``documents``; the last returns what the mix takes of each document.

1. language: documents without a recognisable language (no letters) go. The classifiers
   learn from all labelled rows that the stage gets.
2. lines: repeated lines, however short, and nearly repeated ones go; the earliest stays. A document that loses all its
   lines goes; one that had no text is kept as it is.
3. near_duplicates: of each group of documents with alike five-word shingles (0.8 or
   more) the one of smallest doc_id stays.
4. decontaminate: documents of which a twentieth or more is benchmark text go.
5. mix: sources are brought to their target weights.

Rows with null columns pass through; a null doc_id comes first in the order of lines and last in the
choice of a near-duplicate. Of rows repeated whole stage 3 leaves one, unless they are blank. Extra
columns are dropped; an empty table gives an empty result.
"""

from pyspark.sql import functions as F

from cohortalign.llm import decontaminate, langid, lines, mixing, simhash
from cohortalign.llm.common import broadcast_if_small, read, staged, text_key

MAX_BROADCAST_LOST = 500_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs):
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def language(spark, docs, sf_dir):
    docs = _columns(docs)
    return langid.predict(docs, langid.train(docs), keep=docs.columns).where("lang_pred <> 'und'").select(*docs.columns)


def line_dedup(spark, docs, sf_dir):
    docs = _columns(docs)
    out = lines.dedup_lines(docs, min_words=1)
    had = F.col("n_lines") > 0
    out = out.where(~(had & (F.col("n_removed") == F.col("n_lines"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    docs = _columns(docs)
    rows = docs.withColumn("_key", text_key(F.col("text")))
    groups = staged(simhash.near_duplicates(docs), "near-groups")
    # exact copies are a group as well, whether or not their texts are like others
    blank = ~F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    names = rows.where(~blank).select("doc_id", F.col("_key").alias("key")).join(groups, "key", "left")
    names = names.select("doc_id", "key", F.coalesce("component", F.xxhash64("key")).alias("component"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = names.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", "best")
    lost = names.join(best, "component").where(order != F.col("best")).select("doc_id", "key").distinct()
    lost = broadcast_if_small(staged(lost, "near-lost"), MAX_BROADCAST_LOST)
    kept = rows.join(lost, rows["_key"].eqNullSafe(lost["key"]) & rows["doc_id"].eqNullSafe(lost["doc_id"]), "left_anti")
    again = rows.where(~blank).groupBy("doc_id", "_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if again.isEmpty():
        return kept.select(*docs.columns)
    # rows repeated whole: one of each
    return kept.where(blank).select(*docs.columns).union(kept.where(~blank).dropDuplicates(["doc_id", "_key"]).select(*docs.columns))


def decontamination(spark, docs, sf_dir):
    docs = _columns(docs)
    found = decontaminate.judged(decontaminate.text_hits(docs, read(spark, sf_dir, "benchmark")))
    bad = broadcast_if_small(staged(found.where("contaminated").select("key"), "decon-bad"), MAX_BROADCAST_LOST)
    return docs.withColumn("key", text_key(F.col("text"))).join(bad, "key", "left_anti").select(*docs.columns)


def mix(spark, docs, sf_dir):
    return mixing.mix(docs)


STAGES = [("language", language), ("lines", line_dedup), ("near_duplicates", near_duplicates),
          ("decontaminate", decontamination), ("mix", mix)]

# Stage 1 applies trained classifiers and stage 3 verified fingerprints: no SQL for the whole.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs

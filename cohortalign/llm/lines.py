"""Line dedup by a deletion-neighbourhood join (operator 9).

Lines are compared as sequences of words (A-Z lower-cased, split at white space; each character of a script
written without spaces is a word of its own, whatever stands around it). Of equal lines, known by 128 bits of a hash of the whole sequence, the earliest stays, however short; a line also goes if a line with an earlier first
occurrence is within one edited word (inserted, removed or replaced) of it and the edit is at most one word in
``NEAR_WORDS``, that is, seven eighths of the line agree. Order is that of
(id, text's hash, line number). Blank lines always stay; ``min_words`` (1) can spare other short lines as well.

Lines within one edit share a half exactly, so lines whose halves are all unlike any
other line's emit nothing. The others emit the hashes of their variants with at
most one word deleted, tagged by the deleted position. Lines that meet in a variant with
the same tag, or where one of them had nothing deleted, are within one edit; so per variant
and tag only the earliest line has to be known, which is a minimum, and no pairs of a
group are written. Each line found is verified against that earliest line.

Defined results: a null text has no lines and stays null; an empty text has one
empty line, which stays; rows repeated whole are one document to the order, so their
copies get equal results; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, read, sliced, staged, text_key

MIN_WORDS, NEAR_WORDS = 1, 8
SPACE = r"[\x20\x09-\x0D]+"
MAX_BROADCAST_LINES = 250_000  # of about 80 bytes each
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def line_words(line: Column) -> Column:
    """Split at plain spaces where the line has no other white space, which is much faster."""
    low = ascii_lower(line)
    other = [F.contains(line, F.lit(c)) for c in "\t\r\v\f"]
    return F.array_remove(F.when(other[0] | other[1] | other[2] | other[3], F.split(low, SPACE)).otherwise(F.split(low, " ")), "")


def may_hold_unspaced(text: Column) -> Column:
    """Whether a text has a character beyond U+0E00, as all of scripts without spaces are: one cheap look at the text instead of one at every line."""
    return F.when(F.octet_length(text) > F.length(text), F.regexp_like(text, F.lit(r"[\x{E00}-\x{10FFFF}]"))).otherwise(F.lit(False))


def spaced(line: Column, may: Column) -> Column:
    """The line with spaces around the characters of scripts that are written without; ``may``: ``may_hold_unspaced`` of its text."""
    return F.when(may & (F.octet_length(line) > F.length(line)), F.regexp_replace(
        line, "([" + "".join(rf"\p{{Is{x}}}" for x in UNSPACED) + "])", " $1 ")).otherwise(line)


def _lines(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(h, id, t, line, halves) for lines that may be removed; halves only of those that may be near others.
    The one pass that looks at all words."""
    text = F.col(text_col)
    # what is made of the whole text is a column before the lines are, or it would be made for each of them
    texts = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), text_key(text).alias("t"), may_hold_unspaced(text).alias("may"), text.alias("text"))
    out = texts.select("id", "t", "may", F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    # blank lines go by a look at the line, as a condition on the words would be worked out beside them once more
    out = out.where(F.regexp_like("s", F.lit(r"[^\x20\x09-\x0D]"))).select("id", "t", "line", spaced(F.col("s"), F.col("may")).alias("s"))
    out = out.select("id", "t", "line", line_words(F.col("s")).alias("words"))
    out = out.where(F.size("words") >= min_words) if min_words > 1 else out
    halves = F.when(F.size("words") >= NEAR_WORDS, _halves(F.col("words")))
    return out.select(text_key(F.array_join("words", " ")).alias("h"), "id", "t", "line", halves.alias("halves"))


def _halves(words: Column) -> Column:
    """Keys (side, length, hash) of the line's halves; lines within one edit share one."""
    n = F.size(words)
    low, high = (n / 2).cast("int"), ((n + 1) / 2).cast("int")
    key = lambda side, part, p: F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side), p, part).alias("key"))
    front = lambda p: key(0, F.slice(words, 1, p), p)
    back = lambda p: key(1, F.slice(words, n - p + 1, p), p)
    return F.when(low == high, F.array(front(low), back(low))).otherwise(
        F.array(front(low), front(high), back(low), back(high)))


def variant_hashes(words: list[str], front: bool, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and tags of the line's variants: -1, nothing deleted, and each deletion
    that leaves a half it shares (the front, the back) as it is."""
    n = len(words)
    w = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in words), np.uint64, n)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _B)]), dtype=np.uint64)
    c = np.concatenate([[np.uint64(0)], np.cumsum(w * power, dtype=np.uint64)])
    at = np.arange(n)
    at = at[(front & (at >= (n - 1) // 2)) | (back & (at <= n // 2))]
    h = np.concatenate([c[n:], c[at] + _B_INV * (c[n] - c[at + 1])])
    return h.view(np.int64), np.concatenate([[-1], at]).astype(np.int32)


def within_one_edit(a: list[str], b: list[str]) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def near_removed(docs: DataFrame, lines: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h): lines that are within one edit of a line with an earlier first occurrence.
    lines: _lines(), written; first: (h, o) with the order of each line's first occurrence."""
    halves = lines.where("halves is not null").select("h", F.explode("halves").alias("k")).select("h", "k.side", "k.key")
    few = F.xxhash64("h")  # a number in place of the hash, of which Spark keeps minima in place
    shared = halves.groupBy("key").agg(F.min(few).alias("a"), F.max(few).alias("b")).where("a <> b").select("key")
    cand = halves.join(shared, "key").groupBy("h").agg(
        F.max((F.col("side") == 0)).alias("front"), F.max((F.col("side") == 1)).alias("back"))
    want = cand.join(first, "h").groupBy(F.col("o.id").alias("_id"), F.col("o.t").alias("_t")).agg(
        F.collect_list(F.struct("h", "o", "front", "back")).alias("want"))
    want = staged(want, "line-want")
    if (want.agg(F.sum(F.size("want"))).first()[0] or 0) <= MAX_BROADCAST_LINES:
        want = F.broadcast(want)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("t"), may_hold_unspaced(F.col(text_col)).alias("may"), F.col(text_col).alias("text"))
    rows = rows.join(want, rows.t.eqNullSafe(want["_t"]) & rows.id.eqNullSafe(want["_id"]))
    parts = F.split("text", "\n", -1)
    cut = F.transform(F.array(parts), lambda p: F.transform("want", lambda w: F.struct(
        w["h"].alias("h"), w["o"].alias("o"), w["front"].alias("front"), w["back"].alias("back"), spaced(F.get(p, w["o"]["line"]), F.col("may")).alias("s"))))
    texts = rows.select(F.explode(F.flatten(cut)).alias("w")).select("w.h", "w.o", line_words(F.col("w.s")).alias("words"), "w.front", "w.back")
    texts = staged(texts.dropDuplicates(["h"]), "line-texts")

    def emit(batches):
        for b in sliced(batches, 2000):
            hs, tags, own = [], [], []
            for h, words, front, back in zip(*[b.column(i).to_pylist() for i in range(4)]):
                v, tag = variant_hashes(words, front, back)
                hs.append(v)
                tags.append(tag)
                own += [h] * len(v)
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), *[pa.array(np.concatenate(x)) for x in (hs, tags)]], ["h", "v", "tag"])

    variants = texts.select("h", "words", "front", "back").mapInArrow(emit, "h binary, v long, tag int")
    variants = staged(variants, "line-variants")
    met = variants.groupBy("v").agg(F.min(few).alias("a"), F.max(few).alias("b")).where("a <> b").select("v")
    met = staged(variants.join(met, "v").join(texts.select("h", "o"), "h"), "line-met")
    earliest = F.struct(F.col("o"), F.col("h"))
    by_tag = met.groupBy("v", "tag").agg(F.min(earliest).alias("m"))
    by_variant = by_tag.groupBy("v").agg(F.min("m").alias("any"), F.min(F.when(F.col("tag") == -1, F.col("m"))).alias("whole"))
    best = by_tag.join(by_variant, "v").select("v", "tag", F.when(F.col("tag") == -1, F.col("any")).otherwise(
        F.least("m", "whole")).alias("m"))
    pairs = met.join(best, ["v", "tag"]).where("m.o < o").groupBy("h").agg(F.min("m").alias("m"))
    pairs = pairs.select("h", F.col("m.h").alias("g"))
    words = texts.select("h", "words")
    both = pairs.join(words, "h").join(words.select(F.col("h").alias("g"), F.col("words").alias("other")), "g")

    def verify(batches):
        for b in sliced(batches, 2000):
            ok = [within_one_edit(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0)], ["h"]).filter(pa.array(ok, pa.bool_()))

    return both.select("h", "words", "other").mapInArrow(verify, "h binary")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, t, gone): sorted numbers of the lines to remove, for texts that have some."""
    order = F.struct("id", "t", "line")
    lines = staged(_lines(docs, id_col, text_col, min_words), "line-places")
    places = lines.drop("halves")
    first = staged(places.groupBy("h").agg(F.min(order).alias("o")), "line-first")
    near = staged(near_removed(docs, lines, first, id_col, text_col), "line-near").withColumn("near", F.lit(True))
    state = first.join(near, "h", "left")
    gone = places.join(state, "h").where(F.col("near").isNotNull() | (order != F.col("o")))
    return gone.groupBy("id", "t").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text's remaining lines in the text column, and ``n_lines`` and ``n_removed``."""
    gone = removed_lines(docs, id_col, text_col, min_words).select(F.col("id").alias("_id"), F.col("t").alias("_t"), F.col("gone").alias("_gone"))
    gone = staged(gone, "line-gone")
    left = docs.withColumn("_key", text_key(F.col(text_col)))
    both = left.join(gone, left["_key"].eqNullSafe(gone["_t"]) & left[id_col].eqNullSafe(gone["_id"]), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return both.select(*[F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept).alias(c) if c == text_col
                         else left[c] for c in docs.columns],
                       F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
                       F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op9_lines(spark, sf_dir) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op9_lines": op9_lines}

ORACLE_SQL = {"op9_lines": rf"""
with l as (
  select doc_id, i as line, s,
    list_filter(regexp_split_to_array(translate(
      regexp_replace(s, '([{"".join(f"{chr(92)}p{{{x}}}" for x in UNSPACED)}])', ' \1 ', 'g'),
      '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from (select doc_id, unnest(string_split(text, chr(10))) as s, unnest(range(0, len(string_split(text, chr(10))))) as i from documents)),
e as (select w, min((doc_id, line)) as o from l where len(w) >= {MIN_WORDS} group by w),
v as (
  select w, o, -1 as tag, w as x from e where len(w) >= {NEAR_WORDS}
  union all
  select w, o, p, w[:p] || w[p + 2:] from (select w, o, unnest(range(0, len(w))) as p from e where len(w) >= {NEAR_WORDS})),
n as (
  select distinct a.w from v a join v b on a.x = b.x and (a.tag = b.tag or a.tag = -1 or b.tag = -1)
  where b.o < a.o),
k as (
  select l.doc_id, l.line, l.s, (len(l.w) >= {MIN_WORDS} and ((l.doc_id, l.line) <> e.o or n.w is not null)) as gone
  from l left join e on l.w = e.w left join n on l.w = n.w)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
  sha256(coalesce(string_agg(s, chr(10) order by line) filter (where not coalesce(gone, false)), '')) as kept_sha256
from k group by doc_id"""}

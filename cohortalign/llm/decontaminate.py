"""Benchmark decontamination by winnowing (operator 8). DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item. Both sides keep, of
every ``window - k + 1`` consecutive k-grams, one of smallest hash, so equal windows keep
an equal k-gram. Documents are scanned once; their fingerprints are joined with the distinct
fingerprints of the items, and each match names the few windows that hold the k-gram.
Only those windows are cut from the texts and joined with the items' windows; the windows found
are merged, which extends the hits to whole shared spans. Items shorter than a window are
looked up by the hash of all their words at every position, in the same scan. A text of n
words makes n windows at most, however often its words repeat, and no word of an item
is carried along with a match.

Defined results: null or wordless texts have no words, no hits and are not
contaminated; a null item_id counts as one item and is left out of the list of ids;
rows of equal text get equal results; an empty benchmark hits nothing; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, read, staged, text_key

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 13, 5
MAX_BROADCAST_FINGERPRINTS = 1_000_000
MAX_BROADCAST_FOUND = 200_000
POSITION = 31  # low bits of a packed k-gram hold its position, the others its hash


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


def _neighbours(xs: Column, apart: int, f) -> Column:
    """f(x[i], x[i + apart]) for every i that has both."""
    return _let(xs, lambda a: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - apart, F.lit(0))),
                                         F.slice(a, apart + 1, F.greatest(F.size(a) - apart, F.lit(0))), f))


def _over(xs: Column, width: int, f) -> Column:
    """A function that may meet elements twice, over every ``width`` consecutive ones, in a
    logarithmic number of passes."""
    span = 1
    while 2 * span <= width:
        xs, span = _neighbours(xs, span, f), 2 * span
    return _neighbours(xs, width - span, f) if span < width else xs


def gram_hashes(words: Column, k: int, seed: int = 0) -> Column:
    """A hash of every k consecutive words; k may not exceed the number of words."""
    return _over(F.transform(words, lambda w: F.xxhash64(w, F.lit(seed))), k, lambda a, b: F.xxhash64(a, b))


def _packed(hashes: Column) -> Column:
    return F.transform(hashes, lambda h, i: F.shiftleft(F.shiftright(h, POSITION), POSITION).bitwiseOR(i.cast("long")))


def kept_grams(words: Column, window: int, k: int) -> Column:
    """Packed k-grams (hash, position) that winnowing keeps; none below a window."""
    mins = _over(_packed(gram_hashes(words, k)), window - k + 1, lambda a, b: F.least(a, b))
    return F.when(F.size(words) >= window, F.array_distinct(mins)).otherwise(F.array().cast("array<long>"))


def fingerprints(words: Column, window: int, k: int, short: list[int]) -> Column:
    """Packed hashes by which windows are looked up: k-grams that winnowing keeps, and all runs
    of the lengths ``short``."""
    none = F.array().cast("array<long>")
    return F.concat(kept_grams(words, window, k), *[
        F.when(F.size(words) >= n, _packed(gram_hashes(words, n, -n))).otherwise(none) for n in short])


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("iw"))
    return staged(items.where(F.size("iw") > 0).distinct(), "decon-items")


def _known(items: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """(h, n): distinct fingerprints of the items; n is the length of a short item, or null."""
    grams = items.where(F.size("iw") >= window).select(
        F.explode(kept_grams(F.col("iw"), window, k)).alias("g"), F.lit(None).cast("int").alias("n"))
    for n in short:
        grams = grams.union(items.where(F.size("iw") == n).select(F.explode(_packed(gram_hashes(F.col("iw"), n, -n))), F.lit(n)))
    return grams.select(F.shiftright("g", POSITION).alias("h"), "n").distinct()


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item, n, w): the distinct windows of the items."""
    n = F.least(F.size("iw"), F.lit(window))
    at = items.select("item", n.alias("n"), F.explode(_let(F.col("iw"), lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - F.least(F.size(w), F.lit(window)) + 1),
        lambda i: _name(F.slice(w, i, F.least(F.size(w), F.lit(window))))))).alias("w"))
    return at.distinct()


def _name(words: Column) -> Column:
    """A window's identity."""
    return F.unhex(F.md5(F.array_join(words, " ").cast("binary")))


def scan(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str, window: int, k: int) -> DataFrame:
    """The one pass over all texts: for every document a row (kept, key, n_words), and for every
    fingerprint that an item has as well a row (kept, key, n, pos)."""
    short = sorted(r[0] for r in items.where(F.size("iw") < window).select(F.size("iw")).distinct().collect())  # at most window - 1
    known = broadcast_if_small(staged(_known(items, window, k, short), "decon-fp"), MAX_BROADCAST_FINGERPRINTS)
    text = F.col(text_col)
    found = _let(words_of(F.col("_text")), lambda w: F.concat(F.array(F.size(w).cast("long")), fingerprints(w, window, k, short)))
    # the key is a column before the rows multiply, or it would be made for each of them
    texts = docs.select(F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"),
                        text_key(text).alias("key"), text.alias("_text"))
    rows = texts.select("kept", "key", F.posexplode(found).alias("i", "g"))
    # the first element is the number of words; its key is beyond all hashes, and spread
    beyond = F.lit(-(1 << 40)) - F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    rows = rows.withColumn("h", F.when(F.col("i") > 0, F.shiftright("g", POSITION)).otherwise(beyond))
    rows = rows.join(known.withColumn("met", F.lit(True)), "h", "left").where("i = 0 or met")
    return staged(rows.select(
        "kept", "key", F.when(F.col("i") == 0, F.col("g")).alias("n_words"), F.when(F.col("i") > 0, F.col("n")).alias("n"),
        F.when(F.col("i") > 0, F.col("g").bitwiseAND(F.lit((1 << POSITION) - 1)).cast("int")).alias("pos")), "decon-scan")


def _settled(docs: DataFrame, scanned: DataFrame, items: DataFrame, text_col: str, window: int, k: int) -> DataFrame:
    """(key, spans, items) of the texts in which windows occur."""
    first = F.when(F.col("n").isNull(), F.greatest(F.col("pos") - (window - k), F.lit(0))).otherwise(F.col("pos"))
    places = scanned.where("pos is not null").select(
        "key", F.coalesce("n", F.lit(window)).alias("n"), F.explode(F.sequence(first, F.col("pos"))).alias("p")).distinct()
    places = staged(places.groupBy("key").agg(F.collect_list(F.struct("n", "p")).alias("places")), "decon-places")
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    texts = texts.join(broadcast_if_small(places.select("key"), MAX_BROADCAST_FOUND), "key", "left_semi").dropDuplicates(["key"])
    cut = _let(words_of(F.col("text")), lambda w: F.transform(
        F.filter("places", lambda c: c["p"] + c["n"] <= F.size(w)),
        lambda c: F.struct(c["n"].alias("n"), c["p"].alias("p"), _name(F.slice(w, c["p"] + 1, c["n"])).alias("w"))))
    found = texts.join(places, "key").select("key", F.explode(cut).alias("x")).select("key", "x.*")
    found = staged(found, "decon-windows")
    windows = staged(_windows(items, window), "decon-known")
    whole = broadcast_if_small(staged(windows.select("n", "w").distinct(), "decon-names"), MAX_BROADCAST_FINGERPRINTS)
    hit = staged(found.join(whole, ["n", "w"], "left_semi"), "decon-hit")
    order = Window.partitionBy("key").orderBy("p", "n")
    runs = hit.withColumn("e", F.col("p") + F.col("n"))
    runs = runs.withColumn("upto", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum(F.when(F.col("p") <= F.col("upto"), 0).otherwise(1)).over(order))
    runs = runs.groupBy("key", "run").agg(F.min("p").alias("s"), F.max("e").alias("e"))
    runs = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    named = hit.select("key", "n", "w").distinct().join(windows, ["n", "w"]).select("key", F.struct("item").alias("item")).distinct()
    named = named.groupBy("key").agg(F.transform(F.collect_list("item"), lambda x: x["item"]).alias("items"))
    return staged(runs.join(named, "key"), "decon-found")


def _filled(rows: DataFrame, found: DataFrame) -> DataFrame:
    out = rows.join(found, "key", "left")
    kind = {f.name: f.dataType for f in found.schema}
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(kind["spans"]))).withColumn(
        "items", F.coalesce("items", F.array().cast(kind["items"])))


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str] = ["doc_id"], text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per document with its columns ``keep``, ``n_words``, ``spans`` (sorted runs of hit
    words, [start, end) counted from 0) and ``items`` (ids of items with occurring windows)."""
    items = _items(benchmark, item_col, item_text_col)
    scanned = scan(docs, items, keep, text_col, window, k)
    found = _settled(docs, scanned, items, text_col, window, k)
    rows = scanned.where("n_words is not null").select("kept", "key", "n_words")
    return _filled(rows, found).select("kept.*", "n_words", "spans", "items")


def text_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
              window: int = WINDOW, k: int = K) -> DataFrame:
    """The same by text: (key, n_words, spans, items) of the distinct texts in which windows occur."""
    items = _items(benchmark, item_col, item_text_col)
    scanned = scan(docs, items, [], text_col, window, k)
    found = _settled(docs, scanned, items, text_col, window, k)
    return scanned.where("n_words is not null").select("key", "n_words").distinct().join(found, "key")


def judged(found: DataFrame) -> DataFrame:
    """``hits`` with the contamination rule: a twentieth of the words or more is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]).cast("long"))
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op8_decontamination(spark, sf_dir) -> DataFrame:
    out = judged(hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))
    ids = F.array_sort(F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op8_decontamination": op8_decontamination}

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE_SQL = {"op8_decontamination": f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
i as (select distinct item_id, {_WORDS} as w from benchmark),
iw as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[j + 1 : j + least(13, len(w))], ' ') as g
  from (select item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) as j from i where len(w) > 0)),
ns as (select distinct n from iw),
dw as (
  select rid, p, n, array_to_string(w[p + 1 : p + n], ' ') as g
  from (select rid, w, n, unnest(range(0, len(w) - n + 1)) as p from d, ns where len(w) >= n)),
h as (select rid, p, dw.n, item_id from dw join iw on dw.n = iw.n and dw.g = iw.g),
c as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + n)) as q from h) group by rid),
t as (select rid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
      from (select distinct rid, item_id from h) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  (coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w)) as contaminated
from d left join c using (rid) left join t using (rid)"""}

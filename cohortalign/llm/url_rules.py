"""URL filters by association rules (operator 10).

Spark's FP-growth mines combinations of URL tokens (host labels, path segments, query
keys) that go with the label ``block``; those of enough support and confidence become rules,
without those that a smaller rule implies. A rule is found through an inverted
index on its rarest token and checked against all tokens of the URL. Given host and path
rules come first, the longest that fits.

Only tokens that can be part of such a rule enter the mining: those of enough support among blocked URLs that don't stand in every URL
without being telling; of tokens that stand in exactly the same URLs one enters and brings the others along, so tokens that always come
together don't multiply the sets. Rules of one token are frequent sets like the others.

The labels in the query are the given rules' verdicts, the only labels that speak of URLs; pages that no rule
fits are unlabelled, and the mined rules judge them. A mined rule needs blocked URLs of ``MIN_REASONS`` different given rules at least:
otherwise it only says again, and more widely, what one rule says (all labelled URLs of a domain with one block rule are blocked).
The table ``labels`` is about documents: its ids are not those of pages. ``judge`` takes
labels by id as well, which count where no given rule fits, each as a reason of its own.

Defined results: a null URL or one without ``://`` has empty host and path, no tokens and
is allowed; without labelled rows of label block nothing is mined and all is allowed; repeated
rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, broadcast_if_small, read, staged

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MAX_TOKENS, MIN_REASONS = 0.005, 5, 0.9, 2, 2
MAX_RULES = 100_000


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(F.substring(rest, F.length(host) + 1, F.length(rest)), F.lit(""))


def given_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: h:label, p:segment with digits as one #, q:key."""
    host, path = host_path(url)
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.substring(url, F.instr(url, "?") + 1, F.length(url)), "#", 1))
    tag = lambda t, xs: F.transform(F.array_remove(xs, ""), lambda x: F.concat(F.lit(t), x))
    segs = F.split(F.regexp_replace(ascii_lower(path), "[0-9]+", "#"), "/")
    keys = F.transform(F.split(F.coalesce(ascii_lower(query), F.lit("")), "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(tag("h:", F.split(host, r"\.")), tag("p:", segs), tag("q:", keys)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         max_tokens: int = MAX_TOKENS, min_reasons: int = MIN_REASONS) -> DataFrame:
    """(url, label) -> (tokens, support, confidence, anchor): rules for ``block``. A column ``reason`` says which rows
    were labelled for one reason; without it each row is a reason of its own."""
    mark = "label=block"
    rid = F.xxhash64(F.col("url"), F.monotonically_increasing_id())
    rows = labelled.select(tokens(F.col("url")).alias("t"), F.col("label"), rid.alias("rid"),
                           (F.col("reason") if "reason" in labelled.columns else rid.cast("string")).alias("reason"))
    rows = staged(rows, "url-labelled")
    total = rows.count()
    need = max(MIN_COUNT, math.ceil(min_support * total))
    each = rows.select("rid", "label", F.explode("t").alias("one"))
    stats = each.groupBy("one").agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("label") == "block").alias("both"),
                                    F.sum(F.col("rid").cast("decimal(38,0)")).alias("where")).where(F.col("both") >= need)
    stats = staged(stats.withColumn("confidence", F.col("both") / F.col("support")), "url-tokens")
    some = stats.where((F.col("confidence") >= min_confidence) | (F.col("support") < total))
    # tokens of the same URLs, by the sum of these URLs' hashes
    together = staged(some.groupBy("where", "support").agg(F.min("one").alias("one"), F.collect_list("one").alias("all")), "url-together")
    items = each.join(together.select("one"), "one", "left_semi").groupBy("rid", "label").agg(F.collect_list("one").alias("t"))
    items = staged(items.select(F.when(F.col("label") == "block", F.concat("t", F.array(F.lit(mark)))).otherwise(F.col("t")).alias("items")), "url-items")
    n = items.count()
    if not n:
        none = stats.select(F.array("one").alias("tokens"), "support", "confidence", F.col("one").alias("anchor")).limit(0)
        return taught(rows, none, min_reasons)
    found = FPGrowth(itemsCol="items", minSupport=need / n).fit(items).freqItemsets
    found = staged(found.where(F.size("items") <= max_tokens + 1).select(F.array_sort("items").alias("items"), "freq"), "url-sets")
    # what FP-growth has counted: a set with the mark and the same set without it
    with_mark = found.where(F.array_contains("items", mark)).select(F.array_remove("items", mark).alias("tokens"), F.col("freq").alias("both"))
    plain = found.where(~F.array_contains("items", mark)).select(F.col("items").alias("tokens"), F.col("freq").alias("support"))
    sets = with_mark.where(F.size("tokens") > 0).join(plain, "tokens").withColumn("confidence", F.col("both") / F.col("support"))
    sets = sets.where((F.col("both") >= need) & (F.col("confidence") >= min_confidence)).select("tokens", "support", "confidence", F.explode("tokens").alias("one"))
    sets = staged(sets.join(together.select("one", F.col("support").alias("n"), "all"), "one"), "url-found")
    # each token of a group that comes together is a rule where one is
    alone = sets.where(F.size("tokens") == 1)
    single = alone.select(F.explode("all").alias("one"), "support", "confidence").select(F.array("one").alias("tokens"), "support", "confidence", F.col("one").alias("anchor"))
    implied = sets.where(F.size("tokens") > 1).join(alone.select("one"), "one", "left_semi").select("tokens").distinct()
    pairs = sets.where(F.size("tokens") > 1).join(implied, "tokens", "left_anti").groupBy("tokens", "support", "confidence").agg(
        F.min(F.struct("n", "one"))["one"].alias("anchor"), F.flatten(F.collect_list("all")).alias("all"))
    return taught(rows, single.union(pairs.select(F.array_sort("all"), "support", "confidence", "anchor")), min_reasons)


def fitting(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (.., t) with each rule (tokens, .., anchor) whose tokens they hold, by the inverted index on the anchors."""
    rules = broadcast_if_small(staged(rules, "url-index"), MAX_RULES)
    index = rows.withColumn("anchor", F.explode("t"))
    return index.join(rules, "anchor").where(F.size(F.array_except("tokens", "t")) == 0)


def taught(rows: DataFrame, rules: DataFrame, min_reasons: int) -> DataFrame:
    """The rules whose blocked rows have that many reasons."""
    rules = staged(rules, "url-rules")
    seen = fitting(rows.where("label = 'block'").select("t", "reason"), rules.select("tokens", "anchor"))
    enough = seen.groupBy("tokens").agg(F.count_distinct("reason").alias("reasons")).where(F.col("reasons") >= min_reasons)
    return rules.join(enough.select("tokens"), "tokens").select("tokens", "support", "confidence", "anchor")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls of ``urls(url)`` that a rule blocks."""
    return fitting(urls.select("url").distinct().select("url", tokens(F.col("url")).alias("t")), rules).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict) for every row; labels(id, label) with allow or block."""
    url = F.col(url_col)
    host, path = host_path(url)
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = staged(rows.withColumn("rule", rule).withColumn("given", verdict), "url-rows")
    known = rows
    if labels is not None:
        known = rows.join(labels.select(F.col("id").alias("_id"), "label"), F.col("id") == F.col("_id"), "left")
    label = F.coalesce("given", "label") if labels is not None else F.col("given")
    known = known.select("url", label.alias("label"), F.coalesce("rule", F.concat(F.lit("id="), F.col("id").cast("string"))).alias("reason"))
    known = known.where("label is not null")
    bad = staged(matched(rows.where("given is null"), mine(known)), "url-bad").withColumn("bad", F.lit(True))
    out = rows.join(bad, "url", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(
        "given", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op10_url_rules(spark, sf_dir) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


QUERIES = {"op10_url_rules": op10_url_rules}

_CUT = "case when instr(url, '://') > 0 then regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*$', '', 's') end"
_LOW = f"'{UPPER}', '{LOWER}'"
ORACLE_SQL = {"op10_url_rules": rf"""
with u as (
  select page_id, url, coalesce(translate(regexp_extract(r, '^[^/]*'), {_LOW}), '') as host,
         coalesce(substr(r, length(regexp_extract(r, '^[^/]*')) + 1), '') as path
  from (select page_id, url, {_CUT} as r from pages)),
g as (
  select *, case
    when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
    when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
    when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
    when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/' end as rule
  from u),
k as (
  select row_number() over () as rid, g.*, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end as given,
    list_distinct(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x)
      || list_transform(list_filter(string_split(regexp_replace(translate(path, {_LOW}), '[0-9]+', '#', 'g'), '/'), lambda x: x <> ''), lambda x: 'p:' || x)
      || list_transform(list_filter(list_transform(string_split(case when contains(url, '?') then
           translate(split_part(substr(url, instr(url, '?') + 1), '#', 1), {_LOW}) else '' end, '&'),
           lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x)) as t
  from g),
b as (select rid, t, given as label, rule from k where given is not null),
o as (select rid, unnest(t) as x, label, rule from b),
need as (select greatest({MIN_COUNT}, ceil({MIN_SUPPORT} * count(*))) as n from b),
s as (
  select x as x, null as y, count(*) as n, count(*) filter (where label = 'block') as c, count(distinct rule) filter (where label = 'block') as why from o group by all
  union all
  select p.x, q.x, count(*), count(*) filter (where p.label = 'block'), count(distinct p.rule) filter (where p.label = 'block') from o p join o q on p.rid = q.rid and p.x < q.x group by all),
r as (select x, y from s, need where c >= need.n and c >= {MIN_CONFIDENCE} * s.n and why >= {MIN_REASONS}),
m as (select distinct rid from k, r where list_contains(t, x) and (y is null or list_contains(t, y)))
select page_id, host, path, rule, coalesce(given, case when m.rid is not null then 'block' else 'allow' end) as verdict
from k left join m using (rid)"""}

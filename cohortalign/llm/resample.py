"""Target-distribution importance resampling by bit-sliced aggregation (operator 11).

Texts are runs of words, hashed to buckets. How much more frequent a bucket is in the target than in the corpus gives its
gain, an integer. A document's bucket counts are laid out as bit planes, one bit a bucket: plane k holds bit k of every
count. The gains are laid out alike, their sizes by sign. The number of bits that a count plane and a gain plane share,
times the power of two of both, adds up to the document's exact sum of gains; the floored mean is its weight. A draw
without replacement adds Gumbel noise from a hash of the id, so that reruns agree, and takes the highest scores.

Corpus and target counts are sums over all rows and have the size of ``buckets``. Scores are integers in a range that the
arithmetic bounds (fewer than 200,000 values), so ranks come from a count by score, and only rows of equal score
are put in order together; nothing is sorted as a whole.

Defined results: null, empty and wordless texts have no features, weight 0 and are not drawn; a null id counts as the
empty text in the hash and comes first among ties; repeated rows are rows of their own with equal scores; an
empty target or corpus gives gains from the other side alone; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, sliced, staged

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
PERCENT, MIN_WORDS = 10, 20
MAX_SCORES = 200_000
#: A-Z become a-z; ASCII characters that are no letter and no digit become spaces.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def bucket_numbers(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` words."""
    hashes = list(map(crc32, words))
    for n in range(2, longest + 1):
        hashes += [crc32(b" ".join(words[i:i + n])) for i in range(len(words) - n + 1)]
    return np.array(hashes, np.uint32) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in sliced(batches):
            for raw in b.column(0).to_pylist():
                if raw:
                    total += np.bincount(bucket_numbers(words_of(raw), longest, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("binary")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the corpus, one feature added to every bucket."""
    s, t, more = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda a, b: ((a + 1.0) * (s + more)) / ((b + 1.0) * (t + more))
    return np.array([math.floor(1000 * math.log(ratio(int(a), int(b)))) for a, b in zip(target, corpus)], np.int64)


def planes(numbers: np.ndarray) -> np.ndarray:
    """Row k holds bit k of every number, packed 64 to a word."""
    high = int(numbers.max(initial=0)).bit_length()
    bits = (numbers[None, :] >> np.arange(high)[:, None]) & 1
    packed = np.packbits(bits.astype(np.uint8), axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of the positive gains, then of the sizes of the negative ones, with the signed power of two of each."""
    up, down = planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0))
    power = lambda p: np.int64(1) << np.arange(len(p), dtype=np.int64)
    return np.concatenate([up, down]), np.concatenate([power(up), -power(down)])


def weighted_sum(counts: np.ndarray, gain: np.ndarray, value: np.ndarray) -> int:
    """Sum over buckets of count times gain, from shared bits of the planes."""
    total = 0
    for k, plane in enumerate(planes(counts)):
        shared = np.bitwise_count(plane & gain).sum(1, dtype=np.int64)
        total += int(shared @ value) << k
    return total


def noise(seed: int, name) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
            longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row, written once."""
    gain, value = gain_planes(gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))

    def weigh(batches):
        for b in sliced(batches):
            out = []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(raw or b"")
                at = bucket_numbers(words, longest, buckets)
                weight = weighted_sum(np.bincount(at, minlength=buckets), gain, value) // len(at) if len(at) else 0
                out.append((len(words), len(at), weight, weight + noise(seed, name)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in zip(*out)]], ["id", "n_words", "n_features", "weight", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return staged(rows.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long, score long"), "resample-scores")


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, .. for the floor of ``percent`` in a hundred of the rows of ``min_words`` or more with the highest scores, else null."""
    may = F.col("n_words") >= min_words
    by_score = staged(scored.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "resample-counts")
    total, values = by_score.agg(F.sum("n"), F.count(F.lit(1))).first()
    draw = percent * (total or 0) // 100
    # one row a score: a few ten thousand, however many documents there are
    above = by_score.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("_above")).where(F.col("_above") < draw)
    above = F.broadcast(above) if values <= MAX_SCORES else above
    both = scored.join(above, "score", "left").withColumn("_above", F.when(may, F.col("_above")))
    tied = F.row_number().over(Window.partitionBy("score").orderBy("id"))
    place = F.col("_above") + F.col("_tied")
    first = both.where("_above is not null").withColumn("_tied", tied)
    rest = both.where("_above is null").withColumn("_tied", F.lit(None).cast("int"))
    return first.unionByName(rest).select(*scored.columns, F.when(place <= draw, place).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = LONGEST,
             buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Every row's id, n_words, n_features, weight and score, and its rank if it is drawn."""
    out = ranked(weights(docs, target, id_col, text_col, target_col, longest, buckets, seed), percent, min_words)
    return out.withColumnRenamed("id", id_col)


def op11_resample(spark, sf_dir) -> DataFrame:
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_resample": op11_resample}

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE_SQL = {"op11_resample": f"""
with tab as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda x: 0::ubigint)),
      lambda c, x: case when c % 2 = 1 then xor(3988292384::ubigint, c // 2) else c // 2 end) as c from (select unnest(range(256)) as i))),
d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
dw as (select rid, unnest(w) as word from d),
bw as (select unnest({_WORDS}) as word from benchmark),
known as (select distinct word from (select word from dw union all select word from bw)),
buckets as (
  select word, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(range(0, len(h) // 2), lambda i:
    (strpos('0123456789ABCDEF', h[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 17)::ubigint)),
    lambda c, b: xor(t[(xor(c, b) % 256)::bigint + 1], c // 256))) % 10000 as bucket
  from (select word, hex(encode(word)) as h from known), tab),
s as (select bucket, count(*) as s from dw join buckets using (word) group by 1),
t as (select bucket, count(*) as t from bw join buckets using (word) group by 1),
n as (select (select coalesce(sum(s), 0) from s)::double as cs, (select coalesce(sum(t), 0) from t)::double as ct),
g as (select b.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * (cs + 10000)) / ((coalesce(s, 0) + 1)::double * (ct + 10000))))::bigint as gain
  from (select distinct bucket from buckets) b left join s using (bucket) left join t using (bucket), n),
f as (select rid, count(*) as nf, sum(gain)::bigint as total from dw join buckets using (word) join g using (bucket) group by 1),
x as (select doc_id, coalesce(nf, 0) as n_features, coalesce(floor(total / nf)::bigint, 0) as weight,
    ('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::ubigint as h from d left join f using (rid)),
y as (select doc_id, n_features::bigint as n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint)::bigint as score from x),
r as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as k, count(*) filter (where n_features >= 20) over () as many from y)
select doc_id, n_features, weight, score, case when n_features >= 20 and k <= 10 * many // 100 then k end as rank from r"""}

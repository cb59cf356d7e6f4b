"""Hard-negative mining by Kronecker-packed products (operator 13).

Components are made integers. A block of candidates is packed by dimension: the block's d-th components, a bias
added so that none is negative, lie side by side in separated fields of one wide integer. An anchor's d-th
component (biased as well) is multiplied once with the whole integer; the sum of these products over the dimensions holds every
candidate's inner product in its own field, which is as wide as the largest possible sum needs, so nothing carries over. Taking
the biases off gives the exact scores.

The anchors are a stated query set. Two passes compare them with all rows block by block: the first finds each anchor's
best rows of its own label, its positives, multiplying only the fields of that label; the second finds, for each positive, the best
rows of other labels between two bounds on its score. Tasks keep the best of all the blocks they see and send those
only. The rows are never shuffled; the smaller side's blocks meet each partition of the other's.

Defined results: rows with a null id, label or vector or with a null or non-finite component take no part; vectors
of different lengths are compared as if filled up with zeros; an anchor's own id is never its positive or negative; repeated
rows are rows of their own as candidates, so an id can come twice, and one as anchors; a score beyond the range of long is given and
ordered as the nearest long; an anchor without positives or a positive without negatives returns no row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, sliced, staged

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
BLOCK, ANCHORS, ANCHOR_BLOCKS = 4096, 256, 64  # rows of a block of each side, and anchor blocks a task holds together
LONG = 2**63 - 1


def field_bytes(width: int, most: int) -> int:
    """Bytes of a field: every sum of ``width`` products of biased components (twice ``most`` at most) fits."""
    need = max(1, (width * (2 * most) ** 2).bit_length())
    return 4 if need <= 32 else 8 * -(-need // 64)


def whole(rows: list, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) as integers of any size, shorter rows filled up with zeros."""
    m = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        m[i, :len(r)] = r
    m = np.floor(scale * m) + 0.0
    return m.astype(np.int64) if np.abs(m).max(initial=0) < 2.0**53 else np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)


def packed(components: np.ndarray, bias: int, size: int) -> list[bytes]:
    """For every dimension the rows' biased components in fields of ``size`` bytes, the first row lowest."""
    if size <= 8:
        return [c.tobytes() for c in np.ascontiguousarray((components + bias).T.astype(f"<u{size}"))]
    return [b"".join(int(x + bias).to_bytes(size, "little") for x in column) for column in components.T]


def products(wide: list[int], rows: int, own: np.ndarray, anchor: list[int], bias: int, size: int) -> np.ndarray:
    """The anchor's inner product with each packed row; ``own`` holds the sums of the rows' components."""
    total, lifted = 0, 0
    for w, a in zip(wide, anchor):
        total += w * (a + bias)
        lifted += a + bias
    raw = total.to_bytes(rows * size, "little")
    if size <= 8:
        sums = np.frombuffer(raw, f"<u{size}")
        # fields of 8 bytes hold less than 2^64, and the differences less than 2^63 in size: wrapping around is exact
        return (sums.astype(np.uint64) - np.uint64(lifted * bias % 2**64)).view(np.int64) - bias * own
    sums = [int.from_bytes(raw[i * size:(i + 1) * size], "little") for i in range(rows)]
    return np.array([s - lifted * bias - bias * o for s, o in zip(sums, own.tolist())], object)


def blocks_of(rows: DataFrame, width: int, most: int, scale: int) -> DataFrame:
    """(labels, ids, sums, packs): blocks of rows in order of (label, id), packed by dimension."""
    size = field_bytes(width, most)

    def pack(batches):
        for b in sliced(batches, BLOCK):
            ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort([ids, labels])
            q = whole(b.column(2).take(pa.array(order)).to_pylist(), width, scale)
            sums = [int(x).to_bytes(size + 8, "little", signed=True) for x in q.sum(1)]
            yield pa.RecordBatch.from_pydict({"labels": [labels[order].tolist()], "ids": [ids[order].tolist()], "sums": [b"".join(sums)],
                                              "packs": [packed(q, most, size)]}, schema=_BLOCK)

    return rows.select("id", "label", "v").mapInArrow(pack, "labels array<long>, ids array<long>, sums binary, packs array<binary>")


_BLOCK = pa.schema([("labels", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("sums", pa.binary()), ("packs", pa.list_(pa.binary()))])


def _first(scores: np.ndarray, ids: np.ndarray, count: int) -> list[tuple[int, int]]:
    """(-score, id) of the ``count`` highest scores, smaller ids first."""
    if len(scores) > 4 * count and scores.dtype != object:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
        scores, ids = scores[among], ids[among]
    order = np.lexsort([ids, -scores])[:count] if scores.dtype != object else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:count]
    return [(-int(scores[i]), int(ids[i])) for i in order]


def _compared(blocks: DataFrame, anchors: DataFrame, width: int, most: int, scale: int, count: int, bounds: tuple[int, int] | None) -> DataFrame:
    """(uid, k, score, id): for every anchor the best ``count`` rows that each task saw: of the anchor's label where ``bounds`` is
    None, else, for its k-th positive, of the other labels within the bounds."""
    size = field_bytes(width, most)

    def run(batches):
        best: dict[tuple[int, int], list] = {}
        for b in sliced(batches, 1):
            labels, ids = np.array(b["labels"][0].as_py(), np.int64), np.array(b["ids"][0].as_py(), np.int64)
            raw, packs = b["sums"][0].as_py(), b["packs"][0].as_py()
            own = [int.from_bytes(raw[i:i + size + 8], "little", signed=True) for i in range(0, len(raw), size + 8)]
            own = np.array(own, np.int64 if size <= 8 else object)
            spans: dict[int, tuple] = {}
            for a in b["anchors"][0].as_py():
                low, high = np.searchsorted(labels, a["label"]), np.searchsorted(labels, a["label"], "right")
                if bounds is None:
                    if low == high:
                        continue
                    here = slice(low, high)
                else:
                    here = slice(0, len(ids))
                if (key := (here.start, here.stop)) not in spans:
                    spans[key] = [int.from_bytes(p[here.start * size:here.stop * size], "little") for p in packs]
                q = [int(x) for x in whole([a["v"]], width, scale)[0]]
                scores, names = products(spans[key], here.stop - here.start, own[here], q, most, size), ids[here]
                may = names != a["id"]
                if bounds is None:
                    wanted = [(0, may)]
                else:
                    may[low:high] = False
                    wanted = []
                    for k, s in enumerate(a["positives"]):
                        # low * s <= 100 * score <= high * s, in whole numbers
                        wanted.append((k, may & (scores >= -(-bounds[0] * s // 100)) & (scores <= bounds[1] * s // 100)))
                for k, ok in wanted:
                    if (new := _first(scores[ok], names[ok], count)):
                        best[a["uid"], k] = sorted(best.get((a["uid"], k), []) + new)[:count]
        rows = [(uid, k, max(-LONG - 1, min(LONG, -s)), i) for (uid, k), found in best.items() for s, i in found]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 10_000]), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                             ["uid", "k", "score", "id"])

    held = F.collect_list(F.struct("uid", "id", "label", "v", *(["positives"] if bounds else [])))
    n = anchors.count()
    cut = F.pmod(F.xxhash64("uid"), F.lit(max(1, math.ceil(n / ANCHORS)))).alias("cut")
    groups = anchors.groupBy(cut).agg(held.alias("anchors")).select("anchors").repartition(max(1, math.ceil(n / ANCHORS / ANCHOR_BLOCKS)))
    # a stated query set against all rows, block by block: the rows of both sides are blocks
    found = blocks.crossJoin(groups).mapInArrow(run, "uid long, k int, score long, id long")
    order = Window.partitionBy("uid", "k").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", scale: int = SCALE,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds:
    the first ``negatives`` rows of other labels whose score is between ``low`` and ``high`` hundredths of a positive's."""
    label = F.col(label) if isinstance(label, str) else label
    vec = F.col(vec_col)
    fine = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & vec.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vec.cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    most, width = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(F.floor(x * float(scale)).cast("double"))))), F.max(F.size("v"))).first()
    # doubles beyond the range of long were cut by the floor; their size is taken anew
    if most is not None and most >= 2.0**62:
        most = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] * scale
    most, width = int(most or 0) + 1, int(width or 0)
    blocks = staged(blocks_of(rows, width, most, scale), "negative-blocks")
    anchors = rows.where("anchor").select("id", "label", "v").distinct().withColumn("uid", F.monotonically_increasing_id())
    anchors = staged(anchors, "negative-anchors")

    near = _compared(blocks, anchors, width, most, scale, positives, None)
    near = staged(near.select("uid", F.col("place").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negative-positives")
    own = near.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    far = _compared(blocks, staged(anchors.join(own, "uid"), "negative-queries"), width, most, scale, negatives, (low, high))
    far = far.select("uid", (F.col("k") + 1).alias("k"), F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(near, ["uid", "k"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark, sf_dir) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


QUERIES = {"op13_negatives": op13_negatives}

ORACLE_SQL = {"op13_negatives": """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
    coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::bigint as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, other as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_id order by score desc, other) as k from s where same) where k <= 5),
n as (
  select p.anchor_id, positive_id, other as negative_id, positive_score, score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by score desc, other) as rank
  from p join s on p.anchor_id = s.anchor_id and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5"""}

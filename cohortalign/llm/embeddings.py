"""Embedding near-duplicates by spherical k-means cells (operator 7).

Equal vectors are folded to a class with its count. Centroids are fitted on a sample
of at most about ``SAMPLE`` classes; all classes are then assigned: each is at home in its nearest
cell and visits those whose boundary is near. Where ``MAX_CELLS`` cells would hold more than ``CELL`` classes each,
every cell is parted again by a second set of centroids, fitted on the differences from the first, so that cells stay small at
every size. Cells are cut into blocks of about ``BLOCK`` home rows, and a task multiplies its block with the rows that meet
it, batch by batch. Of the links found it writes counts by vector and the edges of a spanning
forest, never all pairs. A link whose ends meet in two cells is counted in one of them.

No pair below the threshold is linked. The ends of a link at the threshold are ``sqrt(2 - 2 * threshold)`` apart; if a boundary
lies between them, one end is within half of that of it, so a margin of a half would miss nothing. Along one
direction they differ by the distance over the square root of the dimensions that the vectors fill (estimated from the sample), times
a normal deviate; the margin is ``SPREAD`` such deviations, at most the half, and a link is missed only if its
ends differ by more than twice that. Recall against brute force is measured in the tests.

Defined results: vectors that are null, empty or zero or hold null or non-finite
components link with nothing; vectors of different lengths are compared as if filled
up with zeros; copies link with each other; rows with a null id take part but name no
component, and are kept only where no row of their component has an id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, connected_components, read, small_batches, staged

THRESHOLD = 0.95
CELL, BLOCK, MAX_CELLS, SAMPLE, ROUNDS = 500, 2000, 4096, 40_000, 8
SPREAD = 1.5
MAX_BROADCAST_CELLS = 1_000_000


def unit(rows: list) -> np.ndarray:
    """Rows as double-precision unit vectors, shorter ones filled up with zeros."""
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        m = np.array(rows, float).reshape(len(rows), width)
    else:
        m = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            m[i, :len(r)] = r
    m = m / np.abs(m).max(1, keepdims=True, initial=1e-300)  # large components don't overflow
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def fitted(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(x, max(1, len(x) * k // 5_000_000))])
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(n > 1e-12, s / np.maximum(n, 1e-12), c)
    return c


def dimensions(x: np.ndarray) -> float:
    """How many directions the rows fill evenly, at least 1."""
    e = np.linalg.eigvalsh(np.cov(x.T)) if len(x) > 1 and x.shape[1] > 1 else np.ones(1)
    return max(1.0, float(e.sum() ** 2 / max((e * e).sum(), 1e-300)))


def centroids(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to MAX_CELLS unit centroids and, where k asks for more, a second set of differences from them (else one of zero)."""
    first = min(k, MAX_CELLS)
    c = spherical_kmeans(x, min(first, len(x)))
    more = math.ceil(k / first)
    if more == 1:
        return c, np.zeros((1, x.shape[1]))
    near = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(x, max(1, len(x) * len(c) // 5_000_000))])
    rest = x - c[near]
    size = np.linalg.norm(rest, axis=1, keepdims=True)
    r = spherical_kmeans(rest / np.maximum(size, 1e-12), min(more, len(x)))
    return c, r * np.median(size)


def _near(scores: np.ndarray, apart: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """scores: rows by centres, apart: distances between centres. (best by row; row, centre) of those whose boundary
    with the best is within the margin."""
    best = scores.argmax(1)
    gap = (scores.max(1)[:, None] - scores) / np.maximum(apart[best], 1e-12)
    return best, *np.nonzero(gap <= margin)


def distances(c: np.ndarray) -> np.ndarray:
    q = (c * c).sum(1)
    return np.sqrt(np.maximum(0, q[:, None] + q[None] - 2 * (c @ c.T)))


def visited(x: np.ndarray, c: np.ndarray, r: np.ndarray, apart: tuple[np.ndarray, np.ndarray], margin: float):
    """(home cell by row; row, cell) for the rows of x, cells being numbered over both sets of centroids."""
    homes, rows, cells = [], [], []
    for at in range(0, len(x), max(1, 2_000_000 // len(c))):
        part = x[at:at + max(1, 2_000_000 // len(c))]
        home, row, cell = _near(part @ c.T, apart[0], margin)
        if len(r) > 1:
            inner, pair, sub = _near((part[row] - c[cell]) @ r.T - (r * r).sum(1) / 2, apart[1], margin)
            first = np.flatnonzero(cell == home[row])  # one for each row, in order
            home = home * len(r) + inner[first]
            row, cell = row[pair], cell[pair] * len(r) + sub
        homes.append(home)
        rows.append(row + at)
        cells.append(cell)
    return np.concatenate(homes), np.concatenate(rows), np.concatenate(cells)


class Forest:
    """Union-find over names, telling the edges that join two trees."""

    def __init__(self):
        self.top = {}

    def find(self, x):
        self.top.setdefault(x, x)
        while self.top[x] != x:
            self.top[x] = self.top[self.top[x]]
            x = self.top[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.top[b] = a
        return a != b


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    vec = F.col(vec_col)
    fine = vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) \
        & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), vec.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    classes = rows.where("fine").groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = staged(classes.withColumn("uid", F.monotonically_increasing_id()), "vec-classes")
    total, width = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    share = min(1.0, SAMPLE / total)
    sample = classes.where((F.pmod(F.xxhash64("uid"), F.lit(1 << 40)) / (1 << 40)) < share).limit(2 * SAMPLE).select("v").collect()
    sample = fitted(unit([r[0] for r in sample]), width) if sample else np.ones((1, width)) / math.sqrt(width)
    c, r = centroids(sample, max(1, min(total // 2, round(total / CELL))))
    apart = distances(c), distances(r)
    margin = min(0.5, SPREAD / math.sqrt(dimensions(sample))) * math.sqrt(2 - 2 * threshold)

    kind = classes.schema["v"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            lists = b.column(2)
            if not len(lists):
                continue
            home, row, cell = visited(fitted(unit(lists.to_pylist()), width), c, r, apart, margin)
            all_of = np.split(cell, np.flatnonzero(np.diff(row)) + 1)
            take = lambda a: a.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [take(b.column(0)), take(b.column(1)), pa.array(cell.astype(np.int64)), pa.array(home[row].astype(np.int64)),
                 take(pa.array([v.astype(np.int64) for v in all_of], pa.list_(pa.int64()))), take(lists)],
                ["uid", "n", "cell", "home", "visits", "v"])

    met = staged(classes.select("uid", "n", "v").mapInArrow(
        assign, f"uid long, n long, cell long, home long, visits array<long>, v {kind}"), "vec-met")
    blocks = met.where("cell = home").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    met = met.join(broadcast_if_small(staged(blocks, "vec-blocks"), MAX_BROADCAST_CELLS), "cell")
    own = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    base = met.where("cell = home").select("cell", own.alias("block"), F.lit(0).alias("probe"), "uid", "n", "home", "v", "visits")
    probe = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    # of two home rows of different blocks, the one of the smaller block goes to the other's
    probe = probe.where((F.col("cell") != F.col("home")) | (own <= F.col("block"))).select(
        "cell", "block", F.lit(1).alias("probe"), "uid", "n", "home", "v", F.lit(None).cast("array<long>").alias("visits"))
    dealt = base.union(probe).repartition("cell", "block").sortWithinPartitions("cell", "block", "probe")

    def compare(batches):
        at = forest = None
        uids, ns, xs, calls = [], [], [], []
        for b in batches:
            cell, block, probe = (b.column(i).to_numpy() for i in range(3))
            uid, n, home = b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5).to_numpy()
            if not len(uid):
                continue
            x = fitted(unit(b.column(6).to_pylist()), width)
            cuts = np.flatnonzero(np.diff(cell) | np.diff(block) | np.diff(probe)) + 1
            for part in np.split(np.arange(len(uid)), cuts):
                here = (cell[part[0]], block[part[0]])
                if here != at:
                    at, forest, uids, ns, xs, calls = here, Forest(), [], [], [], []
                if not probe[part[0]]:
                    uids.append(uid[part])
                    ns.append(n[part])
                    xs.append(x[part])
                    calls += b.column(7).take(pa.array(part)).to_pylist()
                    continue
                if isinstance(calls, list):
                    uids, ns, xs = [np.concatenate(uids or [uid[:0]])], [np.concatenate(ns or [n[:0]])], [np.concatenate(xs)] if xs else []
                    most = max(map(len, calls), default=0)
                    calls = np.array([v + [-1] * (most - len(v)) for v in calls], np.int64).reshape(-1, most)
                if not xs:
                    continue
                p, q = np.nonzero(x[part] @ xs[0].T >= threshold)
                a, c = part[p], q
                keep = np.where(home[a] == here[0], uid[a] < uids[0][c], True)
                # two home rows of one block meet twice, those of two blocks once
                twice = (home[a] == here[0]) & ~np.isin(uid[a], uids[0])
                keep |= twice
                far = np.flatnonzero(home[a] != here[0])
                if len(far):  # does the base row visit the probe's home as well?
                    back = (calls[c[far]] == home[a[far]][:, None]).any(1)
                    keep[far] = ~back | (home[a[far]] < here[0])
                a, c = a[keep], c[keep]
                if not len(a):
                    continue
                names = np.concatenate([uid[a], uids[0][c]])
                who, which = np.unique(names, return_inverse=True)
                more = np.zeros(len(who), np.int64)
                np.add.at(more, which, np.concatenate([ns[0][c], n[a]]))
                edges = [(u, w) for u, w in zip(uid[a].tolist(), uids[0][c].tolist()) if forest.join(u, w)]
                none = len(edges) * [None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who.tolist() + [e[0] for e in edges], pa.int64()), pa.array(more.tolist() + none, pa.int64()),
                     pa.array(len(who) * [None] + [e[1] for e in edges], pa.int64())], ["u", "links", "v"])

    found = staged(dealt.mapInArrow(compare, "u long, links long, v long"), "vec-links")
    links = found.where("links is not null").groupBy("u").agg(F.sum("links").alias("links"))
    cc = connected_components(found.where("v is not null").select("u", "v"))
    named = classes.join(cc, F.col("uid") == F.col("node"), "left").join(links, F.col("uid") == F.col("u"), "left")
    named = named.select("v", "first", "n", F.coalesce("links", F.lit(0)).alias("links"),
                         F.coalesce("component", "uid").alias("component"))
    named = staged(named, "vec-named")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select(
        F.col("v").alias("w"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(named, rows.fine & (rows.v == named.w), "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op7_embeddings(spark, sf_dir) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


QUERIES = {"op7_embeddings": op7_embeddings}
ORACLE_SQL = {}

"""Scores and sweeps from cross-products (EXP1, EXP2, EXP4).

A channel's correlation with its prediction follows from the products of a row's few latent values with the channel's
responses, so predictions are never written out: rows are read once, whatever the number of rotations, levels, seeds, ranks and
penalties that are scored from the sums.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import FLAT, staged
from ..functions.moments import BLOCK, SUMS, added, apply_matrix, as_rows, collected, matrix, moment_blocks, sent
from . import alignment as A
from . import encoding as E

MAX_SENT = 1 << 24  # numbers of a task's sums before it sends them
MAX_FOLDS = 1 << 24  # numbers of the folds' eigenbases that one job carries


def channel_products(rows: DataFrame, u: str, v: str) -> DataFrame:
    """(subject, i, m array<double>), written: row i of [u, 1, v]' [u, 1] of each subject, with the sum of squares of its column last.
    Rows 0 .. len(u) are u and the count, the others one a channel."""
    kind = rows.schema["subject"].dataType.simpleString()
    some = rows.select("subject", F.col(u).cast("array<double>").alias("u"), F.col(v).cast("array<double>").alias("v"))

    def part(batches):
        sums: dict = {}
        t = pa.int64()
        for b in batches:
            if not b.num_rows:
                continue
            t, names = b.schema.field(0).type, b.column(0).to_pylist()
            for s in dict.fromkeys(names):
                here = b.filter(pa.array([x == s for x in names]))
                left = matrix(here.column(1))
                left = np.column_stack([left, np.ones(len(left))])
                every = np.column_stack([left, matrix(here.column(2))])
                new = np.column_stack([every.T @ left, (every * every).sum(0)])
                sums[s] = sums[s] + new if s in sums else new
            if sum(x.size for x in sums.values()) > MAX_SENT:
                for s, g in sums.items():
                    yield from sent({"subject": (s, t)}, 0, np.zeros(0), g)
                sums = {}
        for s, g in sums.items():
            yield from sent({"subject": (s, t)}, 0, np.zeros(0), g)

    blocks = added(some.mapInArrow(part, f"subject {kind}, _block int, {SUMS}"), ["subject"])
    blocks = blocks.withColumn("w", F.lit(rows.select(F.size(u)).first()[0] + 2))

    def rows_of(batches):
        for b in batches:
            for s, block, g, w in zip(b.column("subject").to_pylist(), b.column("_block").to_pylist(), b.column("g"), b.column("w").to_pylist()):
                flat = g.values.to_numpy(zero_copy_only=False)
                n = len(flat) // w
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([s] * n, b.schema.field("subject").type), pa.array((block * max(1, BLOCK // w) + np.arange(n)).astype(np.int32)), lists],
                                                 ["subject", "i", "m"])

    return staged(blocks.mapInArrow(rows_of, f"subject {kind}, i int, m array<double>"), "products")


def _heads(products: DataFrame, width: int) -> dict:
    """subject -> (n, mean of u, covariance of u)."""
    held: dict = {}
    for r in products.where(F.col("i") <= width).collect():
        held.setdefault(r["subject"], {})[r["i"]] = r["m"]
    out = {}
    for s, found in held.items():
        g = np.array([found[i] for i in range(width + 1)])[:, :width + 1]
        n, mean = g[width, width], g[width, :width] / g[width, width]
        out[s] = n, mean, g[:width, :width] / n - np.outer(mean, mean)
    return out


def _correlated(products: DataFrame, basis: DataFrame, width: int, heads: dict, one) -> DataFrame:
    """(subject, g, voxel, r): one(subject, P, C) gives covariances and variances of predictions (channels x grid) from the channels' basis rows P and
    their covariances C with u."""
    kind = products.schema["subject"].dataType.simpleString()
    channels = products.where(F.col("i") > width).select("subject", (F.col("i") - width - 1).alias("voxel"), "m")
    both = channels.join(basis.select("subject", F.col("voxel").cast("int").alias("voxel"), "p"), ["subject", "voxel"])

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            for s in dict.fromkeys(names):
                if s not in heads:
                    continue
                here = b.filter(pa.array([x == s for x in names]))
                m, p = matrix(here.column(2)), matrix(here.column(3))
                n, mean, _ = heads[s]
                own = m[:, width] / n
                spread = m[:, width + 1] / n - own * own
                sd = np.sqrt(np.where(spread > 1e-14 * m[:, width + 1] / n, spread, 0.0))
                cov, var = one(s, p, m[:, :width] / n - np.outer(own, mean))
                scale = np.sqrt(np.maximum(var, 0.0))
                flat = (sd < FLAT)[:, None] | (scale < FLAT)
                r = np.where(flat, 0.0, cov / np.where(flat, 1.0, scale * sd[:, None]))
                g = r.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(here.column(0).to_numpy(zero_copy_only=False), g), b.schema.field(0).type), pa.array(np.tile(np.arange(g, dtype=np.int32), len(r))),
                     pa.array(np.repeat(here.column(1).to_numpy(), g)), pa.array(r.ravel())], ["subject", "g", "voxel", "r"])

    return both.select("subject", "voxel", "m", "p").mapInArrow(run, f"subject {kind}, g int, voxel int, r double")


def rotated_scores(rows: DataFrame, encoder: E.Encoder, basis: DataFrame, rotations: dict) -> DataFrame:
    """EXP1, EXP2: (subject, g, voxel, r) of rows(subject, x, v) for each of the subject's rotations, a list by subject."""
    z = E.predict(rows.select("subject", "x", "v"), encoder, "x", "u")
    width = encoder.w.shape[1]
    products = channel_products(z, "u", "v")
    heads = _heads(products, width)
    turned = {s: [r.T for r in rotations[s]] for s in heads if s in rotations}
    squares = {s: [m.T @ heads[s][2] @ m for m in turned[s]] for s in turned}

    def one(s, p, c):
        cov = np.column_stack([(p @ m.T * c).sum(1) for m in turned[s]])
        return cov, np.column_stack([(p @ q * p).sum(1) for q in squares[s]])

    return _correlated(products, basis, width, {s: heads[s] for s in turned}, one)


def summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.median("r").alias("median_r"), F.avg("r").alias("mean_r"))


def loso_scores(conn: DataFrame, responses: DataFrame, features: DataFrame, grid: list[tuple[int, float]], min_k: int = 2) -> list[tuple[int, float, int, float]]:
    """EXP4: (k, alpha, fold, score) for every grid point and fold, in a fixed number of passes over the tables.

    One decomposition a subject serves every k, as smaller bases are its first columns. Items are keyed by the subject that
    lacks them, so a fold's template moments are those of complete items and of items that only the held-out subject lacks;
    encoder moments are the total less the held-out subject's. Every penalty follows from one eigenbasis of a fold's features, and all
    voxel correlations of a fold from the products of the held-out subject's features and channels."""
    spark = responses.sparkSession
    subjects = sorted(r[0] for r in responses.select("subject").distinct().collect())
    ks, alphas = sorted({k for k, _ in grid}), sorted({a for _, a in grid})
    usable = {r["subject"]: r["usable"] for r in A.usable_rank(conn, max(ks)).collect()}
    if min(usable.values()) < min_k:
        raise ValueError("rank below the minimum")
    most = min(max(ks), min(usable.values()))
    channels = staged(as_rows(conn, ["subject", "voxel"], "row", "c", "c"), "sweep-channels")
    basis = staged(A.svd_basis_rows(channels, most, min(min_k, most)), "sweep-basis")
    fp: dict = {}
    for r in A.fingerprints(conn, basis).orderBy("subject", "row").collect():  # parcels x k a subject
        fp.setdefault(r["subject"], []).append(r["z"])
    fp = {s: np.array(m) for s, m in fp.items()}

    z = staged(A.project(responses, basis).select("subject", "stim_id", "z"), "sweep-latents")
    here = F.map_from_entries(F.collect_list(F.struct("subject", "z")))
    items = z.groupBy("stim_id").agg(here.alias("z"), F.count("*").alias("n")).where(F.col("n") >= len(subjects) - 1)
    kind = z.schema["subject"].dataType.simpleString()
    every = F.array(*[F.lit(s).cast(kind) for s in subjects])
    lacks = F.coalesce(F.get(F.filter(every, lambda s: F.try_element_at("z", s).isNull()), F.lit(0)).cast("long"), F.lit(-1))
    side = F.flatten(F.transform(every, lambda s: F.coalesce(F.try_element_at("z", s), F.array_repeat(F.lit(0.0), most))))
    shared = collected(moment_blocks(items.select(lacks.alias("lacks"), side.alias("u")), ["lacks"], ["u"]), ["lacks"])
    pooled = collected(moment_blocks(z.join(features, "stim_id"), ["subject"], ["x", "z"]), ["subject"])
    width = len(next(iter(pooled.values()))[1]) - most
    products = channel_products(responses.join(features, "stim_id"), "x", "v")
    heads = _heads(products, width)

    folds = {}
    for i, held in enumerate(subjects):
        train = [s for s in subjects if s != held]
        parts = [shared[k] for k in ((-1,), (int(held),)) if k in shared]
        if not parts:
            raise ValueError("no item is common to all subjects")
        n, sums, gram = (sum(p[j] for p in parts) for j in range(3))
        xn, xs, xg = (sum(pooled[s,][j] for s in train) for j in range(3))
        mean = xs[:width] / xn
        c = xg[:width, :width] - np.outer(mean, xs[:width])
        sd = np.maximum(np.sqrt(np.maximum(np.diag(c), 0) / xn), E.FLOOR)
        w, q = np.linalg.eigh(c / np.outer(sd, sd))
        top = min(usable[s] for s in train)
        maps = []
        for k in ks:
            k = min(k, top)
            at = np.concatenate([subjects.index(s) * most + np.arange(k) for s in train])
            rot, _ = A.iterate_template(gram[np.ix_(at, at)], sums[at], n, train, k)
            template = sum(fp[s][:, :k] @ rot[s] for s in train) / len(train)
            pair = np.column_stack([fp[held][:, :k], template])
            turn = A.checked_rotation(len(pair), pair.sum(0), pair.T @ pair)
            z_of = lambda s: pooled[s,][2][:width, width:width + k] @ rot[s]  # noqa: B023, E731
            cross = sum(z_of(s) for s in train) - np.outer(mean, sum(pooled[s,][1][width:width + k] @ rot[s] for s in train))
            maps.append(q.T @ (cross / sd[:, None]) @ turn.T)
        basis_of = q / sd[:, None]
        damp = np.array([1 / (np.maximum(w, 0) + a) for a in alphas])
        spread = basis_of.T @ heads[held][2] @ basis_of if held in heads else None
        squares = [[(m * d[:, None]).T @ spread @ (m * d[:, None]) for d in damp] for m in maps] if held in heads else None
        folds[held] = basis_of, maps, damp, squares

    found = []
    room = max(1, MAX_FOLDS // max(1, width * width))
    for at in range(0, len(subjects), room):
        some = {s: folds[s] for s in subjects[at:at + room] if s in heads}

        def one(s, p, c, some=some):
            basis_of, maps, damp, squares = some[s]
            c = c @ basis_of
            cov = [(p[:, :m.shape[1]] @ m.T * c) @ damp.T for m in maps]
            var = [np.column_stack([(p[:, :m.shape[1]] @ q * p[:, :m.shape[1]]).sum(1) for q in own]) for m, own in zip(maps, squares)]
            return np.concatenate(cov, 1), np.concatenate(var, 1)

        scored = _correlated(products, basis, width, {s: heads[s] for s in some}, one)
        found += summary(scored, ["subject", "g"]).collect()  # folds x grid points
    wanted = set(grid)
    out = [(ks[r["g"] // len(alphas)], alphas[r["g"] % len(alphas)], r["subject"], r["median_r"]) for r in found]
    return sorted((int(k), float(a), int(s), float(x)) for k, a, s, x in out if (k, a) in wanted)


LOG = "trial int, k int, alpha double, step int, fold int, score double, interim double, state string"


def pruned_trials(scores: DataFrame, startup: int = 5, warmup: int = 1, interval: int = 1, by: list[str] = []) -> DataFrame:
    """EXP4, EXP6: (by, trial, step, interim, state): trials one after another, their steps' interim scores being the running mean to 12 places;
    a trial ends, PRUNED, at the first step where the rule of ``median_pruning`` holds against the earlier trials that were completed.
    scores(by, trial, step, score). The trials of a study depend on those before and pass through one task in order, each at a logarithmic cost."""
    kinds = {c: scores.schema[c].dataType.simpleString() for c in (*by, "trial", "step")}

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by([("trial", "ascending"), ("step", "ascending")])
        done: dict = {}
        keep, interim, state = [], [], []
        trials, steps, values = g.column("trial").to_pylist(), g.column("step").to_pylist(), g.column("score").cast(pa.float64()).to_pylist()
        at = 0
        while at < len(trials):
            end = at
            while end < len(trials) and trials[end] == trials[at]:
                end += 1
            own, total, best, status = [], 0.0, float("-inf"), "COMPLETE"
            for i in range(at, end):
                total += values[i]
                own.append(round(total / (i - at + 1), 12))
                best = max(best, own[-1])
                earlier = done.get(steps[i], [])
                n = len(earlier)
                if n >= startup and n and steps[i] >= warmup and (steps[i] - warmup) % interval == 0 and best < (earlier[(n - 1) // 2] + earlier[n // 2]) / 2:
                    status = "PRUNED"
                    break
            if status == "COMPLETE":
                for i, x in enumerate(own):
                    bisect.insort(done.setdefault(steps[at + i], []), x)
            keep += range(at, at + len(own))
            interim += own
            state += [status] * len(own)
            at = end
        out = g.take(pa.array(keep, pa.int64())).select([*by, "trial", "step"])
        return out.append_column("interim", pa.array(interim, pa.float64())).append_column("state", pa.array(state, pa.string()))

    schema = ", ".join([*[f"`{c}` {k}" for c, k in kinds.items()], "interim double, state string"])
    return scores.select(*by, "trial", "step", "score").groupBy(*by).applyInArrow(run, schema)


def sweep(conn: DataFrame, responses: DataFrame, features: DataFrame, ks: list[int], alphas: list[float], min_k: int = 2, log: DataFrame | None = None,
          startup: int = 5, warmup: int = 1, interval: int = 1) -> DataFrame:
    """EXP4: the trial log (trial, k, alpha, step, fold, score, interim, state) of a sweep over ranks and penalties, each subject held
    out once. ``log`` is that of an earlier run: its grid points aren't run again, and its trials come first for pruning and numbers.

    All grid points of a sweep come out of the same few passes (``loso_scores``), so pruning saves no pass; it decides what the log holds."""
    spark = responses.sparkSession
    bounds = [a for a in alphas if a <= 0] + [k for k in ks if k < min_k]
    if bounds:
        raise ValueError(f"parameters out of bounds: {bounds}")
    if responses.select("subject").distinct().count() < 2:
        raise ValueError("at least two subjects")
    old = [] if log is None else [tuple(r) for r in log.select("trial", "k", "alpha", "step", "fold", "score", "interim", "state").collect()]  # a row a trial and fold
    known = {(r[1], r[2]) for r in old}
    grid = [(int(k), float(a)) for k in ks for a in alphas if (int(k), float(a)) not in known]
    first = max((r[0] for r in old), default=-1) + 1
    rows = []
    if grid:
        numbers = {p: first + i for i, p in enumerate(grid)}
        by_fold = loso_scores(conn, responses, features, grid, min_k)
        steps = {s: i + 1 for i, s in enumerate(sorted({r[2] for r in by_fold}))}
        rows = [(numbers[k, a], k, a, steps[s], s, x) for k, a, s, x in by_fold]
    new = spark.createDataFrame(rows, "trial int, k int, alpha double, step int, fold int, score double")
    before = spark.createDataFrame(old, LOG)
    state = pruned_trials(before.select("trial", "step", "score").union(new.select("trial", "step", "score")), startup, warmup, interval)
    fresh = new.join(state, ["trial", "step"]).select("trial", "k", "alpha", "step", "fold", "score", "interim", "state")
    return before.union(fresh)

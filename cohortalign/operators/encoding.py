"""Ridge encoders (ENC1-ENC10). Fits go through cross-products, so rows are read once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import FLOOR, staged
from ..functions.moments import MAX_WIDTH, SUMS, added, apply_matrix, collected, cross_moments, gathered, matrix, moment_blocks, sent
from .alignment import back_projected

SALTS = 8  # tasks that the rows of a block of targets are dealt to


@dataclass
class Encoder:
    """z = ((x - mean) / sd) W + b."""

    w: np.ndarray
    b: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def linear(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.w / self.sd[:, None]
        return w, self.b - self.mean @ w

    def save(self, spark: SparkSession, path: str) -> None:
        """SNK1: a one-row table of arrays."""
        row = [(self.w.tolist(), self.b.tolist(), self.mean.tolist(), self.sd.tolist())]
        spark.createDataFrame(row, "w array<array<double>>, b array<double>, mean array<double>, sd array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Encoder":
        return cls(*[np.array(x) for x in spark.read.parquet(path).select("w", "b", "mean", "sd").first()])


def solve(n: int, s: np.ndarray, g: np.ndarray, width: int, alpha: float, standardize: bool = True, scaling=None) -> Encoder:
    """Ridge from moments of rows [x, z], x of ``width`` columns: centred targets, features
    scaled by population deviation (floor 1e-8), or by given (mean, sd), or only centred."""
    mean = s[:width] / n
    c = g[:width, :width] - np.outer(mean, s[:width])
    sd = np.maximum(np.sqrt(np.maximum(np.diag(c), 0) / n), FLOOR) if standardize else np.ones(width)
    b = s[width:] / n
    if scaling is not None:  # features are shifted by a mean that is not their own
        mean, sd = scaling
        sx, sz = s[:width], s[width:]
        c = g[:width, :width] - np.outer(mean, sx) - np.outer(sx, mean) + n * np.outer(mean, mean)
        cross = g[:width, width:] - np.outer(mean, sz) - np.outer(sx - n * mean, b)
    else:
        cross = g[:width, width:] - np.outer(mean, s[width:])
    w = np.linalg.solve(c / np.outer(sd, sd) + alpha * np.eye(width), cross / sd[:, None])
    return Encoder(w, b, mean, sd)


def fit_ridge(rows: DataFrame, alpha: float, x: str = "x", z: str = "z", standardize: bool = True, scaling=None) -> Encoder:
    """ENC1 (and ENC6 with channel targets): one encoder for all rows."""
    width = rows.select(F.size(x)).where(F.col(x).isNotNull()).first()[0]
    (n, s, g), = collected(moment_blocks(rows, [], [x, z]), []).values()
    return solve(n, s, g, width, alpha, standardize, scaling)


def predict(rows: DataFrame, encoder: Encoder, x: str = "x", out: str = "z") -> DataFrame:
    """ENC3: adds the predicted latent row."""
    w, b = encoder.linear()
    return apply_matrix(rows, None, {None: w}, x, out, {None: b})


def predict_voxels(rows: DataFrame, encoder: Encoder, basis: DataFrame, rotations: dict[int, np.ndarray], x: str = "x", out: str = "p") -> DataFrame:
    """ENC4: predicted channels z R' P' of each row's subject, by blocks of channels. rows(subject, .., x): columns besides x tell rows apart."""
    z = predict(rows, encoder, x, "_z").drop(x)
    return back_projected(apply_matrix(z, "subject", {s: r.T for s, r in rotations.items()}, "_z", "_u").drop("_z"), basis, "_u", out)


def fine_tune(encoder: Encoder, rows: DataFrame, alpha: float, blend: float = 0.5, x: str = "x", z: str = "z") -> Encoder:
    """ENC5: refit on calibration rows with the old scaling, weights blended."""
    new = fit_ridge(rows, alpha, x, z, scaling=(encoder.mean, encoder.sd))
    return Encoder((1 - blend) * encoder.w + blend * new.w, (1 - blend) * encoder.b + blend * new.b, encoder.mean, encoder.sd)


def fold_of(row: str, n: int, folds: int):
    """Consecutive ranges of rows, the first n % folds ranges one longer."""
    big, size = n % folds, n // folds
    return F.when(F.col(row) < big * (size + 1), (F.col(row) / (size + 1)).cast("int")).otherwise(
        (big + (F.col(row) - big * (size + 1)) / max(1, size)).cast("int"))


def fit_ridge_cv(rows: DataFrame, alphas, folds: int = 5, row: str = "row_idx", x: str = "x", z: str = "z"):
    """ENC7: (encoder, alpha, scores): alpha by k-fold R2 (mean over targets). One pass makes
    the moments of every fold; training moments are the total minus the fold, and errors
    follow from moments as well, so no alpha needs another pass."""
    n = rows.count()
    folds = max(2, min(folds, n))
    width = rows.select(F.size(x)).first()[0]
    parts = {k[0]: v for k, v in collected(moment_blocks(rows.withColumn("_f", fold_of(row, n, folds)), ["_f"], [x, z]), ["_f"]).items()}
    total = tuple(sum(v[i] for v in parts.values()) for i in range(3))
    scores = []
    for alpha in alphas:
        r2 = []
        for m, s, g in parts.values():
            e = solve(total[0] - m, total[1] - s, total[2] - g, width, alpha, False)
            w, b = e.linear()
            zz = np.diag(g[width:, width:])
            sse = zz - 2 * (np.einsum("ft,ft->t", w, g[:width, width:]) + b * s[width:]) + np.einsum("ft,fg,gt->t", w, g[:width, :width], w) \
                + 2 * b * (w.T @ s[:width]) + m * b * b
            sst = zz - s[width:] ** 2 / m
            r2.append(np.mean(np.where(sst > 0, 1 - sse / np.where(sst > 0, sst, 1), np.where(sse <= 1e-12, 1.0, 0.0))))
        scores.append(float(np.mean(r2)))
    best = int(np.argmax(scores))
    return solve(*total, width, alphas[best], False), alphas[best], scores


def fit_ridge_blocks(rows: DataFrame, key: str, alpha: float, x: str = "x", z: str = "z") -> DataFrame:
    """ENC8, ENC9: (key, w, b) of one ridge with intercept per target block or token, solved on the executors."""
    width = rows.select(F.size(x)).first()[0]
    kind = rows.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        s = np.array(r["s"])
        w, b = solve(int(r["n"]), s, np.array(r["g"]).reshape(len(s), -1), width, alpha, False).linear()
        return pd.DataFrame({key: [r[key]], "w": [w.tolist()], "b": [b.tolist()]})

    return cross_moments(rows, [key], [x, z]).groupBy(key).applyInPandas(one, f"`{key}` {kind}, w array<array<double>>, b array<double>")


def predict_blocks(rows: DataFrame, models: DataFrame, key: str, x: str = "x") -> DataFrame:
    """Predictions of every block for every row, or of the row's own block if it has one: (row columns, key, p). models(key, w, b).

    A block's weights and the rows that it predicts are dealt to the same tasks, the weights first, and multiplied as matrices; a task holds the weights
    of one block at a time, and no weights ride on rows."""
    names = rows.columns if key in rows.columns else [*rows.columns, key]
    if key not in rows.columns:
        known = models.select(key)
        rows = rows.crossJoin(F.broadcast(known) if known.limit(10_001).count() <= 10_000 else known)  # rows x blocks is the result
    kept = F.struct(*[F.col(c) for c in names])
    kind = rows.select(kept.alias("_kept")).schema["_kept"].dataType
    head = models.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(
        F.col(key).alias("_key"), "_salt", F.lit(0).alias("_side"), F.col("w").alias("_w"), F.col("b").alias("_b"), F.lit(None).cast("array<double>").alias("_x"), F.lit(None).cast(kind).alias("_kept"))
    own = rows.where(F.col(x).isNotNull()).select(
        F.col(key).alias("_key"), F.pmod(F.xxhash64(x), F.lit(SALTS)).cast("int").alias("_salt"), F.lit(1).alias("_side"), F.lit(None).cast("array<array<double>>").alias("_w"),
        F.lit(None).cast("array<double>").alias("_b"), F.col(x).cast("array<double>").alias("_x"), kept.alias("_kept"))
    dealt = head.unionByName(own).repartition("_key", "_salt").sortWithinPartitions("_key", "_salt", "_side")

    def run(batches):
        w = at_key = None
        for b in batches:
            keys, side = b.column("_key").to_pylist(), b.column("_side").to_pylist()
            at = 0
            while at < len(side):
                end = at + 1
                if side[at] == 0:
                    w, c, at_key = np.array(b.column("_w")[at].as_py()), np.array(b.column("_b")[at].as_py()), keys[at]
                else:
                    while end < len(side) and side[end] == 1 and keys[end] == keys[at]:
                        end += 1
                    if keys[at] == at_key and w is not None:  # rows of a block without weights go
                        part = b.slice(at, end - at)
                        p = matrix(part.column("_x")) @ w + c
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                        yield pa.RecordBatch.from_arrays([part.column("_kept"), flat], ["_kept", "_p"])
                at = end

    out = dealt.mapInArrow(run, f"_kept {kind.simpleString()}, _p array<double>")
    return out.select("_kept.*", F.col("_p").alias("p"))


def fit_ridge_wide(rows: DataFrame, alpha: float, x: str = "x", z: str = "z", tol: float = 1e-8, max_iters: int = 200) -> Encoder:
    """Ridge with intercept for features too many for a Gram: conjugate gradients on all targets at once. The input is staged
    once; each step is one pass that sums X'(X D) over Arrow blocks, and what a step sends is arrays, added up block by block."""
    rows = staged(rows.where(F.col(x).isNotNull() & F.col(z).isNotNull()).select(F.col(x).cast("array<double>").alias("x"), F.col(z).cast("array<double>").alias("z")), "wide")

    def summed(function) -> tuple[int, np.ndarray]:
        """Number of rows and sum over them of function(x block, z block), a matrix."""
        def part(batches):
            n, total = 0, 0.0
            for b in batches:
                if b.num_rows:
                    n, total = n + b.num_rows, total + function(matrix(b.column(0)), matrix(b.column(1)))
            if n:
                yield from sent({}, n, np.zeros(0), total)

        out = gathered(added(rows.mapInArrow(part, f"_block int, {SUMS}"), []), [])
        n, _, g = next(iter(out.values()))
        return n, g

    width, targets = rows.select(F.size("x"), F.size("z")).first()
    n, sums = summed(lambda a, b: np.concatenate([a.sum(0), b.sum(0)])[None, :])
    mx, mz = sums[:width] / n, sums[width:] / n
    shape = (width, targets)
    r = summed(lambda a, b: (a - mx).T @ (b - mz))[1].reshape(shape)
    w, d, rr = np.zeros(shape), r.copy(), (r * r).sum(0)
    start = np.maximum(rr, 1e-300)
    for _ in range(max_iters):
        if (rr <= tol ** 2 * start).all():
            break
        q = summed(lambda a, b, d=d: (a - mx).T @ ((a - mx) @ d))[1].reshape(shape) + alpha * d
        step = rr / np.maximum((d * q).sum(0), 1e-300)
        w, r = w + step * d, r - step * q
        new = (r * r).sum(0)
        d, rr = r + new / np.maximum(rr, 1e-300) * d, new
    return Encoder(w, mz, mx, np.ones(len(mx)))


def fit_any_ridge(rows: DataFrame, alpha: float, max_width: int = MAX_WIDTH) -> Encoder:
    """Gram below ``max_width`` columns in all, conjugate gradients above; centred features."""
    width = rows.select(F.size("x") + F.size("z")).first()[0]
    return fit_ridge(rows, alpha, standardize=False) if width <= max_width else fit_ridge_wide(rows, alpha)


def pooled_training(features: DataFrame, latents: DataFrame, x: str = "x") -> DataFrame:
    """ENC10: features beside the projected rows of all subjects at once."""
    return latents.join(features.select("stim_id", x), "stim_id")

"""Shared-space alignment (ALN1-ALN12).

Big sides stay in Spark: channel rows and item rows are only mapped or summed to
cross-products. What reaches the driver has the size of parcels squared or of (subjects x k)
squared. The template iteration needs no pass per round: template and
rotations are linear in the subjects' projected rows, so one pass for the cross-products of all subjects
is enough for all rounds.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import FLAT, require, staged
from ..functions.moments import SUMS, added, apply_matrix, as_rows, collected, gathered, matrix, moment_blocks, sent

MAX_GRAM = 1000  # rows of connectivity up to which their Gram is made
MAX_SKINNY = 64_000_000  # numbers of all subjects' blocks of vectors in the range finder
CHANNELS, SALTS = 1024, 8  # channels in a block of a basis, and tasks that a block's rows are dealt to


def usable_rank(conn: DataFrame, k: int = 50) -> DataFrame:
    """ALN1: per subject rows, channels and min(k, min(rows, channels) - 1). conn(subject, row, voxel, c)."""
    n = conn.groupBy("subject").agg(F.count_distinct("row").alias("n_rows"), F.count_distinct("voxel").alias("n_voxels"))
    return n.withColumn("usable", F.least(F.lit(k), F.least("n_rows", "n_voxels") - 1))


def global_k(conn: DataFrame, k: int = 50, min_k: int = 10) -> DataFrame:
    """ALN1: one row with the smallest usable rank; below ``min_k`` is an error."""
    return require(usable_rank(conn, k).agg(F.min("usable").alias("k")), F.col("k") >= min_k, "rank below the minimum")


def sign_fix(long: DataFrame) -> DataFrame:
    """ALN3: (subject, voxel, j, p) with the entry of largest size of each column positive, the first on ties."""
    top = long.groupBy("subject", "j").agg(F.max_by(F.signum("p"), F.struct(F.abs("p"), -F.col("voxel"))).alias("_s"))
    return long.join(top, ["subject", "j"]).withColumn("p", F.col("p") * F.when(F.col("_s") < 0, -1.0).otherwise(1.0)).drop("_s")


def svd_basis(conn: DataFrame, k: int, min_k: int = 10) -> DataFrame:
    """ALN2: (subject, voxel, p array<double>): top-k right singular vectors of each subject's connectivity, signs fixed.
    conn(subject, row, voxel, c)."""
    return svd_basis_rows(staged(as_rows(conn, ["subject", "voxel"], "row", "c", "c"), "channel-rows"), k, min_k)


def svd_basis_rows(rows: DataFrame, k: int, min_k: int = 10, max_gram: int = MAX_GRAM) -> DataFrame:
    """ALN2 from one array of all rows a channel, (subject, voxel, c array<double>). Up to ``max_gram`` rows the rows x rows Gram
    comes from one pass over the channels; beyond, the range finder takes its place. The channel side is mapped by U / s either way."""
    if k < min_k:
        raise ValueError("rank below the minimum")
    width = rows.select(F.max(F.size("c"))).first()[0] or 0
    found = _gram_eigen(rows, k) if width <= max_gram else range_finder(rows, k, width)
    maps = {}
    for subject, (w, u) in found.items():
        if len(w) < k or w[-1] <= 0:
            raise ValueError(f"subject {subject} has no {k} singular values")
        maps[subject] = u / np.sqrt(w)
    p = apply_matrix(rows, "subject", maps, "c", "p").select("subject", "voxel", F.posexplode("p").alias("j", "p"))
    return as_rows(sign_fix(p), ["subject", "voxel"], "j", "p", "p")


def _gram_eigen(rows: DataFrame, k: int) -> dict:
    out = {}
    for (subject,), (_, _, g) in collected(moment_blocks(rows, ["subject"], ["c"]), ["subject"]).items():
        w, u = np.linalg.eigh(g)
        out[subject] = w[::-1][:k], u[:, ::-1][:, :k]
    return out


def range_finder(rows: DataFrame, k: int, width: int, more: int = 10, tol: float = 1e-6, max_passes: int = 60, seed: int = 42) -> dict:
    """subject -> (squared singular values, left singular vectors) of the k largest, for connectivity with too many rows for a Gram.

    A random block of k + ``more`` vectors (twice k at least) is multiplied by the rows x rows Gram without making it: each
    power pass streams the channels once, every task adding c (c' V) over its channels, so what is sent and collected is a tall
    skinny matrix a subject. It is made orthonormal by QR, and the pass's Rayleigh-Ritz values tell how far the leading k directions still
    turn; passes end when no subject's turn more than ``tol`` (the sine of the largest principal angle between passes)."""
    subjects = sorted(r[0] for r in rows.select("subject").distinct().collect())
    have = min(width, max(k + more, 2 * k))
    if len(subjects) * width * have > MAX_SKINNY:
        raise ValueError(f"{len(subjects)} x {width} x {have} numbers, more than {MAX_SKINNY}")
    rng = np.random.default_rng(seed)
    v = {s: np.linalg.qr(rng.standard_normal((width, have)))[0] for s in subjects}
    kind = rows.schema["subject"].dataType.simpleString()
    last: dict = {}
    some = rows.select("subject", F.col("c").cast("array<double>").alias("c"))
    for _ in range(max_passes):
        def power(batches, v=v):
            sums, t = {}, None
            for b in batches:
                if b.num_rows:
                    t, names = b.schema.field(0).type, b.column(0).to_pylist()
                    for s in dict.fromkeys(names):
                        m = matrix(b.column(1).filter(pa.array([x == s for x in names])))
                        z = m.T @ (m @ v[s])
                        n, old = sums.get(s, (0, 0.0))
                        sums[s] = n + len(m), old + z
            for s, (n, z) in sums.items():
                yield from sent({"subject": (s, t)}, n, np.zeros(0), z)

        z = gathered(added(some.mapInArrow(power, f"subject {kind}, _block int, {SUMS}"), ["subject"]), ["subject"])
        out, turn = {}, 0.0
        for s in subjects:
            y = z[s,][2].reshape(width, have)
            w, e = np.linalg.eigh((v[s].T @ y + y.T @ v[s]) / 2)
            out[s] = w[::-1][:k], v[s] @ e[:, ::-1][:, :k]
            if s in last:
                # how much of the leading directions lies outside of the last pass's
                turn = max(turn, np.linalg.norm(out[s][1] - last[s] @ (last[s].T @ out[s][1]), 2))
            else:
                turn = 1.0
            last[s] = out[s][1]
            v[s] = np.linalg.qr(y @ e[:, ::-1])[0]
        if turn < tol:
            return out
    warnings.warn(f"the leading {k} directions still turn by {turn:.1e} after {max_passes} passes", RuntimeWarning, stacklevel=2)
    return out


def rotation_from(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    return u @ vt


def checked_rotation(n: int, s: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Rotation from source to target out of the moments of rows [source, target]."""
    k = len(s) // 2
    if not (np.isfinite(s).all() and np.isfinite(g).all()):
        raise ValueError("NaN or infinity in the alignment input")
    c = g - np.outer(s, s) / n
    if (np.sqrt(np.maximum(np.diag(c), 0) / n) < FLAT).any():
        raise ValueError("constant column in the alignment input")
    return rotation_from(c[:k, k:])


def procrustes(pairs: DataFrame, source: str, target: str, keys: list[str] = []) -> dict[tuple, np.ndarray]:
    """ALN4: orthogonal rotation per key from source rows to target rows, both centred."""
    return {k: checked_rotation(*v) for k, v in collected(moment_blocks(pairs, keys, [source, target]), keys).items()}


def _partial_products(rows: DataFrame, basis: DataFrame, column: str, back: bool) -> DataFrame:
    """(the other columns of rows, _b, z): each row's array times its subject's basis, (subject, voxel, p), block of channels by block: a
    sum's part for each block, or (``back``) the block's channels from a row of k values.

    The blocks of a basis and the rows that meet them are dealt to the same tasks, in order, the block first; a task holds one block at a time."""
    names = [c for c in rows.columns if c != column]
    k_rows = basis.withColumn("_b", (F.col("voxel") / CHANNELS).cast("int"))
    blocks = k_rows.groupBy("subject", "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("voxel", "p"))), lambda x: x["p"]).alias("_m"))
    blocks = staged(blocks, "basis-blocks")
    span = blocks.groupBy("subject").agg(F.max("_b").alias("_last"))
    cut = rows.withColumnRenamed(column, "_v").join(F.broadcast(span) if span.limit(10_001).count() <= 10_000 else span, "subject")
    cut = cut.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    if not back:
        cut = cut.withColumn("_v", F.slice("_v", F.col("_b") * CHANNELS + 1, CHANNELS))
    salt = F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int")
    kept = F.struct(*[F.col(c) for c in names])
    head = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kind = rows.select(kept.alias("_kept")).schema["_kept"].dataType
    both = head.select("subject", "_b", "_salt", F.lit(0).alias("_side"), "_m", F.lit(None).cast("array<double>").alias("_v"), F.lit(None).cast(kind).alias("_kept")).unionByName(
        cut.select("subject", "_b", salt.alias("_salt"), F.lit(1).alias("_side"), F.lit(None).cast("array<array<double>>").alias("_m"), F.col("_v").cast("array<double>").alias("_v"), kept.alias("_kept")))
    dealt = both.repartition("subject", "_b", "_salt").sortWithinPartitions("subject", "_b", "_salt", "_side")

    def run(batches):
        m = None
        for b in batches:
            side = b.column("_side").to_numpy()
            for at, end in _runs(side):
                if side[at] == 0:
                    m = np.array(b.column("_m")[end - 1].as_py())
                    continue
                part = b.slice(at, end - at)
                v = matrix(part.column("_v"))
                z = v @ (m.T if back else m[:v.shape[1]])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(np.ascontiguousarray(z).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("_kept"), part.column("_b"), flat], ["_kept", "_b", "z"])

    out = dealt.mapInArrow(run, f"_kept {kind.simpleString()}, _b int, z array<double>")
    return out.select("_kept.*", "_b", "z")


def _runs(side: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values; blocks, which are 0, each by itself."""
    cuts = [0, *(np.flatnonzero((side[1:] != side[:-1]) | (side[1:] == 0)) + 1).tolist(), len(side)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def project(responses: DataFrame, basis: DataFrame, rotations: dict[int, np.ndarray] | None = None, column: str = "v") -> DataFrame:
    """ALN5: adds z = v P, rotated where a rotation is given. Rows of subjects without a basis or rotation go. Parts of the sum
    are added up by row, so rows need columns besides the array that tell them apart."""
    names = [c for c in responses.columns if c != column]
    parts = _partial_products(responses, basis, column, False)
    z = parts.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_b", "z"))).alias("_z"))
    z = z.withColumn("_z", F.transform("_z", lambda x: x["z"]))
    z = z.select(*names, F.aggregate(F.slice("_z", 2, F.size("_z")), F.get("_z", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda y, w: y + w)).alias("z"))
    return z if rotations is None else apply_matrix(z.withColumnRenamed("z", "_y"), "subject", rotations, "_y", "z").drop("_y")


def back_projected(rows: DataFrame, basis: DataFrame, column: str = "z", out: str = "p") -> DataFrame:
    """Rows of k values times the transposed basis of their subject: adds all channels, put together from blocks."""
    names = [c for c in rows.columns if c != column]
    parts = _partial_products(rows, basis, column, True)
    held = F.transform(F.array_sort(F.collect_list(F.struct("_b", "z"))), lambda x: x["z"])
    return parts.groupBy(*names).agg(F.flatten(held).alias(out))


def iterate_template(gram: np.ndarray, sums: np.ndarray, n: int, subjects: list, k: int, max_iters: int = 20, tol: float = 1e-5):
    """ALN6, ALN7: rotations of all subjects to their iterated mean, from cross-products of [z_1 .. z_S]."""
    s = len(subjects)
    at = lambda m, a, b: m[a * k:(a + 1) * k, b * k:(b + 1) * k]
    c = gram - np.outer(sums, sums) / n
    if (np.sqrt(np.maximum(np.diag(c), 0) / n) < FLAT).any() or not np.isfinite(gram).all():
        raise ValueError("constant or non-finite column in the alignment input")
    norm2 = lambda d: sum(np.sum(d[a] * (at(gram, a, b) @ d[b])) for a in range(s) for b in range(s)) / s ** 2
    now = [np.eye(k) for _ in subjects]
    for rounds in range(1, max_iters + 1):
        new = [rotation_from(sum(at(c, a, b) @ now[b] for b in range(s)) / s) for a in range(s)]
        change = np.sqrt(max(norm2([x - y for x, y in zip(new, now)]), 0) / norm2(now))
        now = new
        if change < tol:
            break
    return dict(zip(subjects, now)), rounds


def aligned_moments(z: DataFrame, item: str) -> tuple[list, int, np.ndarray, np.ndarray]:
    """Subjects, n, sums and cross-products of the subjects' rows side by side, over items common to all."""
    subjects = sorted(r[0] for r in z.select("subject").distinct().collect())
    wide = z.groupBy(item).agg(F.sort_array(F.collect_list(F.struct("subject", "z"))).alias("a")).where(F.size("a") == len(subjects))
    wide = wide.select(F.flatten(F.col("a.z")).alias("u"))  # a row holds one vector per subject
    (n, s, g), = collected(moment_blocks(wide, [], ["u"]), []).values()
    return subjects, n, s, g


def mean_template(z: DataFrame, rotations: dict[int, np.ndarray], item: str) -> DataFrame:
    """(item, z): mean over subjects of rotated rows, items common to all."""
    r = apply_matrix(z.select("subject", item, F.col("z").alias("y")), "subject", rotations, "y", "z").select(item, F.posexplode("z").alias("j", "x"))
    m = r.groupBy(item, "j").agg(F.avg("x").alias("x"), F.count("*").alias("n")).where(F.col("n") == len(rotations))
    return as_rows(m, [item], "j", "x", "z")


def fingerprints(conn: DataFrame, basis: DataFrame) -> DataFrame:
    """(subject, row, z): connectivity times basis, summed over channels."""
    p = basis.select("subject", "voxel", F.posexplode("p").alias("j", "p"))
    f = conn.join(p, ["subject", "voxel"]).groupBy("subject", "row", "j").agg(F.sum(F.col("c") * F.col("p")).alias("x"))
    return as_rows(f, ["subject", "row"], "j", "x", "z")


@dataclass
class SharedSpace:
    """A fitted shared space: small dense parts on the driver, the basis and item template as tables."""

    k: int
    mode: str
    basis: DataFrame
    rotations: dict[int, np.ndarray]
    template: DataFrame
    template_fp: DataFrame
    rounds: int = 0
    warnings: list[str] = field(default_factory=list)
    latents: DataFrame | None = None  # projected responses before rotation, written; not saved

    def save(self, path: str) -> None:
        """SNK1: one Parquet table per part."""
        spark = self.basis.sparkSession
        self.basis.write.mode("overwrite").parquet(f"{path}/basis")
        self.template.write.mode("overwrite").parquet(f"{path}/template")
        self.template_fp.write.mode("overwrite").parquet(f"{path}/template_fp")
        rows = [(int(s), i, [float(x) for x in r[i]]) for s, r in self.rotations.items() for i in range(self.k)]
        spark.createDataFrame(rows, "subject int, i int, r array<double>").write.mode("overwrite").parquet(f"{path}/rotation")
        spark.createDataFrame([(self.k, self.mode, self.rounds)], "k int, mode string, rounds int").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SharedSpace":
        part = lambda n: spark.read.parquet(f"{path}/{n}")
        meta = part("meta").first()
        rot: dict[int, list] = {}
        for r in part("rotation").orderBy("subject", "i").collect():
            rot.setdefault(r["subject"], []).append(r["r"])
        return cls(meta["k"], meta["mode"], part("basis"), {s: np.array(m) for s, m in rot.items()}, part("template"),
                   part("template_fp"), meta["rounds"])


def fit_shared_space(conn: DataFrame, responses: DataFrame | None, k: int = 50, min_k: int = 10, mode: str = "hybrid",
                     max_iters: int = 20, tol: float = 1e-5) -> SharedSpace:
    """ALN9: bases from connectivity, then rotations from the items that all subjects share (hybrid, ALN6) or from
    fingerprints alone (strict, ALN7), and the fingerprint template (ALN8). Responses to other items are projected as well."""
    if mode not in ("hybrid", "strict"):
        raise ValueError(f"unknown mode {mode}")
    k = global_k(conn, k, min_k).first()["k"]
    basis = staged(svd_basis(conn, k, min_k), "basis")
    fp = staged(fingerprints(conn, basis), "fingerprints")
    if mode == "hybrid":
        if responses is None:
            raise ValueError("the hybrid mode needs shared responses")
        z, item = staged(project(responses.select("subject", "stim_id", "v"), basis), "latents"), "stim_id"
    else:
        z, item = fp, "row"
    subjects, n, s, g = aligned_moments(z, item)
    rotations, rounds = iterate_template(g, s, n, subjects, k, max_iters, tol)
    template = mean_template(z, rotations, item)
    return SharedSpace(k, mode, basis, rotations, template, mean_template(fp, rotations, "row"), rounds, latents=z if mode == "hybrid" else None)


def align_zero_shot(space: SharedSpace, conn: DataFrame, min_k: int = 10) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """ALN10: basis and rotation of new subjects from the fingerprint template alone. Parcels must agree."""
    rows = {r[0] for r in space.template_fp.select("row").collect()}
    if {r[0] for r in conn.select("row").distinct().collect()} != rows:
        raise ValueError("zero-shot alignment needs the template's parcels")
    basis = staged(svd_basis(conn, space.k, min_k), "basis")
    pairs = fingerprints(conn, basis).join(space.template_fp.withColumnRenamed("z", "target"), "row")
    rot = {s: r for (s,), r in procrustes(pairs, "z", "target", ["subject"]).items()}
    for s, r in rot.items():
        if np.linalg.norm(r @ r.T - np.eye(space.k)) > 1e-4:
            space.warnings.append(f"rotation of subject {s} is not orthogonal")
    return basis, rot


def align_few_shot(space: SharedSpace, conn: DataFrame, shots: DataFrame, min_k: int = 10) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """ALN11: rotation from calibration rows (subject, stim_id, v) to the template's rows of the same items."""
    if space.mode == "strict":
        raise ValueError("few-shot alignment needs an item template")
    basis = staged(svd_basis(conn, space.k, min_k), "basis")
    z = project(shots, basis).join(space.template.withColumnRenamed("z", "target"), "stim_id")
    return basis, {s: r for (s,), r in procrustes(z, "z", "target", ["subject"]).items()}


def shared_items(responses: DataFrame) -> DataFrame:
    """ALN12: (stim_id, row_idx) of items that all subjects have, in order."""
    n = responses.agg(F.count_distinct("subject").alias("_n"))
    per = responses.groupBy("stim_id").agg(F.count_distinct("subject").alias("n"))
    both = per.join(n, per.n == n._n)  # one row on the right
    return both.select("stim_id", (F.row_number().over(Window.orderBy("stim_id")) - 1).alias("row_idx"))


def dropped_items(responses: DataFrame, shared: DataFrame) -> DataFrame:
    """ALN12: per subject the items outside the intersection; an empty intersection is an error."""
    own = responses.select("subject", "stim_id").distinct().join(shared.select("stim_id").withColumn("_in", F.lit(1)), "stim_id", "left")
    out = own.groupBy("subject").agg(F.count("_in").alias("n_shared"), F.count_if(F.col("_in").isNull()).alias("n_dropped"))
    return require(out, F.col("n_shared") > 0, "no item is common to all subjects")

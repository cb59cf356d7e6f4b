"""The registered queries of the modelling core, whose quantities SQL can't express, against NumPy on the smallest tables."""

import hashlib
import os

import numpy as np
import pytest

from cohortalign import registry
from cohortalign.plans import models as P
from compare import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
K, ALPHA, HELD = 8, 10.0, 4


def rotation(a, b):
    """Orthogonal Procrustes of centred a to centred b."""
    u, _, vt = np.linalg.svd((a - a.mean(0)).T @ (b - b.mean(0)))
    return u @ vt


def corr(a, b):
    """Columns of a with those of b, 0 where one is constant."""
    a, b = a - a.mean(0), b - b.mean(0)
    sa, sb = a.std(0), b.std(0)
    za, zb = [np.where(s < 1e-10, 0.0, m / np.where(s < 1e-10, 1.0, s)) for m, s in ((a, sa), (b, sb))]
    return za.T @ zb / len(a)


def basis(c, k):
    p = np.linalg.svd(c, full_matrices=False)[2][:k].T
    return p * np.sign(p[np.abs(p).argmax(0), np.arange(k)])


def template_of(zs):
    """Rotations to the iterated mean."""
    rot, mean = [np.eye(zs[0].shape[1])] * len(zs), np.mean(zs, 0)
    for rounds in range(1, 21):
        rot = [rotation(z, mean) for z in zs]
        new = np.mean([z @ r for z, r in zip(zs, rot)], 0)
        change = np.linalg.norm(new - mean) / np.linalg.norm(mean)
        mean = new
        if change < 1e-5:
            break
    return rot, mean, rounds


def ridge(x, z, alpha, scaling=None):
    """Predictions by a ridge on scaled features and centred targets; a given scaling is used as it is."""
    mean, sd = scaling or (x.mean(0), np.maximum(x.std(0), 1e-8))
    s = (x - mean) / sd
    w = np.linalg.solve(s.T @ s + alpha * np.eye(x.shape[1]), s.T @ (z - z.mean(0)))
    return lambda q: (q - mean) / sd @ w + z.mean(0)


class World:
    def __init__(self):
        import duckdb

        rows = lambda sql: duckdb.sql(sql).fetchall()
        ev = rows(f"select user_id, event_id, value from '{DATA}/events.parquet' order by user_id, ts, event_id")
        runs = {}
        for u, e, v in ev:
            runs.setdefault(u, []).append(v * (((np.arange(64) * 37 + e * 11) % 101) + 1) / 101.0)
        parts = {}
        for u, x in runs.items():
            x = np.array(x)
            parcels = x.reshape(len(x), 16, 4).mean(2)
            parts.setdefault(u % 5, []).append(corr(parcels, x))
        self.conn = {s: np.mean(c, 0) for s, c in parts.items()}
        emb = rows(f"select vec_id, embedding from '{DATA}/embeddings.parquet' order by 1")
        self.x = {i: np.array(e[:48], float) for i, e in emb}
        self.v = {s: {} for s in range(5)}
        for i, e in emb:
            if (i // 5 * 7 + i % 5 * 3) % 10:
                self.v[i % 5][i // 5] = np.array(e, float)
        self.p = {s: basis(c, K) for s, c in self.conn.items()}

    def fit(self, train, k=K, alpha=ALPHA, strict=False):
        items = sorted(set.intersection(*[set(self.v[s]) for s in train]))
        p = {s: self.p[s][:, :k] for s in self.p}
        z = [np.array([self.v[s][i] for i in items]) @ p[s] for s in train]
        fp = [self.conn[s] @ p[s] for s in train]
        rot, mean, rounds = template_of(fp if strict else z)
        x, y = zip(*[(self.x[i], v @ p[s] @ r) for s, r in zip(train, rot) for i, v in self.v[s].items() if i in self.x])
        return {"items": items, "rot": dict(zip(train, rot)), "template": mean, "rounds": rounds, "p": p,
                "fp": np.mean([f @ r for f, r in zip(fp, rot)], 0), "encode": ridge(np.array(x), np.array(y), alpha),
                "scaling": (np.mean(x, 0), np.maximum(np.std(x, 0), 1e-8))}

    def median_r(self, m, held, rot, items):
        items = [i for i in items if i in self.x]
        pred = m["encode"](np.array([self.x[i] for i in items])) @ rot.T @ m["p"][held].T
        y = np.array([self.v[held][i] for i in items])
        return np.diag(corr(pred, y))


@pytest.fixture(scope="module")
def world():
    return World()


@pytest.fixture(scope="module")
def fitted(world):
    return world.fit([0, 1, 2, 3])


def got(spark, name, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in registry.queries()[name](spark, DATA).collect()}


def same(a, b):
    assert set(a) == set(b) and max(abs(a[k] - b[k]) for k in a) < 2e-5


def cells(*named):
    return {(*head, i, j): x for head, m in named for (i, j), x in np.ndenumerate(m)}


def test_basis(spark, world):
    same(got(spark, "ALN2_svd_basis", ("subject", "voxel", "j"), "p"), cells(*[((s,), p) for s, p in world.p.items()]))


def test_procrustes_of_responses(spark, world):
    want = {}
    for s in range(5):
        items = sorted(set(world.v[s]) & set(world.v[0]))
        want[s] = rotation(np.array([world.v[s][i] for i in items]), np.array([world.v[0][i] for i in items]))
    same(got(spark, "ALN4_procrustes", ("subject", "i", "j"), "r"), cells(*[((s,), m) for s, m in want.items()]))


def test_projection(spark, world):
    want = {(s, i, j): x for s in range(5) for i, v in world.v[s].items() for j, x in enumerate(v @ world.p[s])}
    same(got(spark, "ALN5_project", ("subject", "stim_id", "j"), "z"), want)


def test_shared_space(spark, world, fitted):
    same(got(spark, "ALN6_hybrid_rotations", ("subject", "i", "j"), "r"), cells(*[((s,), m) for s, m in fitted["rot"].items()]))
    same(got(spark, "ALN7_strict_rotations", ("subject", "i", "j"), "r"), cells(*[((s,), m) for s, m in world.fit([0, 1, 2, 3], strict=True)["rot"].items()]))
    fp = got(spark, "ALN8_fingerprint_template", ("row", "j"), "z")
    first = min(r for r, _ in fp)
    same({(r - first, j): x for (r, j), x in fp.items()}, cells(((), fitted["fp"])))
    same(got(spark, "ALN9_shared_space", ("stim_id", "j"), "z"), {(i, j): x for i, row in zip(fitted["items"], fitted["template"]) for j, x in enumerate(row)})
    (k, mode, rounds, subjects, features), = map(tuple, registry.queries()["EXP19_train"](spark, DATA).collect())
    assert (k, mode, rounds, subjects, features) == (K, "hybrid", fitted["rounds"], 4, 48)


def zero_shot(world, m, held=HELD):
    return rotation(world.conn[held] @ m["p"][held], m["fp"])


def few_shot(world, m, items):
    at = [i for i in m["items"] if i in items]
    rows = [m["items"].index(i) for i in at]
    return rotation(np.array([world.v[HELD][i] for i in at]) @ m["p"][HELD], m["template"][rows])


def test_new_subject(spark, world, fitted):
    same(got(spark, "ALN10_zero_shot", ("subject", "i", "j"), "r"), cells(((HELD,), zero_shot(world, fitted))))
    same(got(spark, "ALN11_few_shot", ("subject", "i", "j"), "r"), cells(((HELD,), few_shot(world, fitted, set(world.v[HELD])))))


def test_predicted_channels_and_stored_model(spark, world, fitted):
    want = {}
    for s in range(4):
        for i in world.v[s]:
            if i in world.x:
                z = fitted["encode"](world.x[i][None])[0]
                want |= {(s, i, j): x for j, x in enumerate(z @ fitted["rot"][s].T @ fitted["p"][s].T)}
    same(got(spark, "ENC4_predict_voxels", ("subject", "stim_id", "voxel"), "p"), want)
    z = {(i, j): y for i, x in world.x.items() for j, y in enumerate(fitted["encode"](x[None])[0])}
    same(got(spark, "SNK1_save_load", ("stim_id", "j"), "z"), z)


def test_held_out_scores(spark, world, fitted):
    r, cand, ev = P._evaluation(spark, DATA)
    held_out = {x["stim_id"] for x in ev.collect()}
    pool = {x["row_idx"]: x["stim_id"] for x in cand.collect() if x["stim_id"] not in held_out}
    own = world.median_r(fitted, HELD, zero_shot(world, fitted), sorted(held_out))
    (_, median, mean), = [tuple(x) for x in registry.queries()["EXP1_zero_shot"](spark, DATA).collect()]
    assert median == pytest.approx(np.median(own), abs=2e-6) and mean == pytest.approx(own.mean(), abs=2e-6)
    grid = got(spark, "EXP2_fewshot_ablation", ("n_shots", "seed"), "median_r")
    want = {(0, 0): np.median(own)}
    for n in (10, 20, 1000):
        for seed in (42, 43):
            key = lambda i: (int(hashlib.md5(f"{seed}-0-{HELD}-{i}".encode()).hexdigest()[:8], 16), i)  # noqa: B023, E731
            items = {pool[i] for i in sorted(pool, key=key)[:n]}
            want[n, seed] = np.median(world.median_r(fitted, HELD, few_shot(world, fitted, items), sorted(held_out)))
    same(grid, want)


def test_calibrated_scores(spark, world, fitted):
    """Rotation from 30 calibration rows, the encoder refitted on them with the old scaling and blended half and half."""
    _, cand, ev = P._evaluation(spark, DATA)
    held_out = {x["stim_id"] for x in ev.collect()}
    pool = {x["row_idx"]: x["stim_id"] for x in cand.collect() if x["stim_id"] not in held_out}
    items = {pool[i] for i in sorted(pool, key=lambda i: (int(hashlib.md5(f"7-0-{HELD}-{i}".encode()).hexdigest()[:8], 16), i))[:30]}
    rot = few_shot(world, fitted, items)
    at = sorted(i for i in items if i in world.x)
    x, z = np.array([world.x[i] for i in at]), np.array([world.v[HELD][i] for i in at]) @ fitted["p"][HELD] @ rot
    mean, sd = fitted["scaling"]
    new = ridge(x, z, ALPHA, (mean, sd))
    blended = {**fitted, "encode": lambda q: 0.5 * fitted["encode"](q) + 0.5 * new(q)}
    own = world.median_r(blended, HELD, rot, sorted(held_out))
    (_, median, mean_r), = [tuple(r) for r in registry.queries()["EXP1_few_shot"](spark, DATA).collect()]
    assert median == pytest.approx(np.median(own), abs=2e-6) and mean_r == pytest.approx(own.mean(), abs=2e-6)


def test_sweep_over_held_out_subjects(spark, world):
    want = {}
    for held in range(5):
        for k in (4, 6, 8):
            for alpha in (1.0, 10.0, 100.0):
                m = world.fit([s for s in range(5) if s != held], k, alpha)
                want[k, alpha, held] = np.median(world.median_r(m, held, zero_shot(world, m, held), sorted(world.v[held])))
    same(got(spark, "EXP4_loso_sweep", ("k", "alpha", "fold"), "score"), want)
    log = [r for r in registry.queries()["EXP4_sweep_trials"](spark, DATA).collect()]
    assert all(abs(r["score"] - want[r["k"], r["alpha"], r["fold"]]) < 2e-5 for r in log) and {r["trial"] for r in log} == set(range(6))

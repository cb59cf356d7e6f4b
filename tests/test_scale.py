"""Forms meant for large inputs against NumPy: channel blocks, range finder, running medians, scores and sweeps from cross-products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortalign.functions import moments
from cohortalign.functions.moments import as_rows
from cohortalign.operators import alignment as A
from cohortalign.operators import connectivity as C
from cohortalign.operators import encoding as E
from cohortalign.operators import experiments as X
from cohortalign.operators import metrics as M
from cohortalign.operators import scoring as Q
from cohortalign.operators import stats as Z


def ledoit_wolf(x):
    n, p = x.shape
    x = x - x.mean(0)
    emp = x.T @ x / n
    mu = np.trace(emp) / p
    delta = ((emp ** 2).sum() - 2 * mu * np.trace(emp) + p * mu ** 2) / p
    beta = min((((x ** 2).T @ (x ** 2)).sum() / n - (emp ** 2).sum()) / (p * n), delta)
    s = beta / delta if beta else 0.0
    c = (1 - s) * emp + s * mu * np.eye(p)
    d = np.maximum(np.sqrt(np.diag(c)), 1e-10)
    return c / np.outer(d, d), s


@pytest.mark.parametrize("ensemble", ["average", "concat"])
def test_voxel_connectivity_by_blocks(spark, ensemble):
    rng = np.random.default_rng(1)
    runs = {(s, r): rng.standard_normal((20 + 3 * r, 50 + 9 * s)) @ rng.standard_normal((50 + 9 * s,) * 2) + 5 for s in (0, 1) for r in (0, 1, 2)}
    rows = spark.createDataFrame([(s, r, t, v.tolist()) for (s, r), x in runs.items() for t, v in enumerate(x)], "subject int, run long, t int, v array<double>")
    got = {(r["subject"], r["voxel"]): r for r in C.voxel_connectivity(rows, ensemble, channels=16).collect()}
    for s in (0, 1):
        parts = [runs[s, r] for r in (0, 1, 2)]
        each = [ledoit_wolf(x) for x in (parts if ensemble == "average" else [np.concatenate(parts)])]
        want, shrink = np.mean([c for c, _ in each], 0), np.mean([x for _, x in each])
        assert np.allclose([got[s, v]["c"] for v in range(len(want))], want, atol=1e-12)
        assert got[s, 0]["shrinkage"] == pytest.approx(shrink)


def test_constant_channel_and_long_runs(spark, monkeypatch):
    """A constant channel is correlated with nothing; more steps than a block may hold make blocks narrower, with the same result."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 20))
    x[:, 3] = 2.0
    rows = spark.createDataFrame([(0, 0, t, v.tolist()) for t, v in enumerate(x)], "subject int, run long, t int, v array<double>")
    want = ledoit_wolf(x)[0]
    wide = {r["voxel"]: r["c"] for r in C.voxel_connectivity(rows).collect()}
    monkeypatch.setattr(C, "HELD", 40 * 16)
    narrow = C.voxel_connectivity_blocks(rows)
    assert {r["block"] for r in narrow.select("block").distinct().collect()} == {0, 1}
    assert np.allclose([wide[i] for i in range(20)], want)
    assert np.allclose([r["c"] for r in C.voxel_connectivity(rows).orderBy("voxel").collect()], want)
    assert np.abs(np.delete(want[3], 3)).max() == 0


def test_range_finder_equals_svd(spark):
    rng = np.random.default_rng(3)
    m = {s: rng.standard_normal((300, 12)) @ np.diag(np.linspace(5, 1, 12)) @ rng.standard_normal((12, 400)) + 0.3 * rng.standard_normal((300, 400)) for s in (0, 1)}
    rows = spark.createDataFrame([(s, v, x[:, v].tolist()) for s, x in m.items() for v in range(400)], "subject int, voxel int, c array<double>")
    wide = A.svd_basis_rows(rows, 10, 4, max_gram=100).orderBy("subject", "voxel").collect()
    gram = A.svd_basis_rows(rows, 10, 4).orderBy("subject", "voxel").collect()
    assert np.allclose([r["p"] for r in wide], [r["p"] for r in gram], atol=1e-6)
    for s in (0, 1):
        p, q = np.array([r["p"] for r in wide if r["subject"] == s]), np.linalg.svd(m[s])[2][:10].T
        assert np.linalg.norm(p - q @ (q.T @ p), 2) < 1e-6
    with pytest.warns(RuntimeWarning, match="still turn"):
        A.range_finder(rows, 10, 300, max_passes=2)


def test_running_median_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [("a" if t % 3 else None, int(t), s, None if rng.random() < 0.05 else round(float(rng.random()), 1), rng.choice(["COMPLETE", "PRUNED"]).item())
            for t in range(60) for s in range(1, 6) for _ in range(1 + (t % 7 == 0))]
    df = spark.createDataFrame(rows, "study string, trial int, step int, score double, state string")
    got = sorted(map(tuple, X.median_pruning(df, 4, 2, 2, ["study"]).collect()), key=repr)
    want = []
    for g, t, s, v, _ in rows:
        earlier = [x for g2, t2, s2, x, st in rows if g2 == g and t2 < t and s2 == s and st == "COMPLETE" and x is not None]
        # rows of one step are peers in an order of their own; ties of (trial, step) make the best so far depend on it
        own = [x for g2, t2, s2, x, _ in rows if g2 == g and t2 == t and s2 <= s and x is not None]
        want.append((g, t, s, v, bool(len(earlier) >= 4 and s >= 2 and s % 2 == 0 and own and max(own) < np.median(earlier))))
    repeated = {(g, t, s) for g, t, s, _, _ in rows if t % 7 == 0}
    alone = lambda rs: [r for r in rs if (r[0], r[1], r[2]) not in repeated]
    assert alone(got) == alone(sorted(want, key=repr)) and len(got) == len(rows)


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    r, n, f, k = 10, 60, 6, 4
    shared, feats, w = rng.normal(size=(r, k)), rng.normal(size=(n, f)), rng.normal(size=(f, k))
    conn, resp = [], []
    for s in range(4):
        v = 30 + s
        p = np.linalg.qr(rng.normal(size=(v, k)))[0]
        c, y = shared @ p.T + 0.05 * rng.normal(size=(r, v)), feats @ w @ p.T + 0.8 * rng.normal(size=(n, v)) + 3
        conn += [(s, i, j, float(c[i, j])) for i in range(r) for j in range(v)]
        resp += [(s, i, y[i].tolist()) for i in range(n) if (i + s) % 9]
    return (spark.createDataFrame(conn, "subject int, row int, voxel int, c double"), spark.createDataFrame(resp, "subject int, stim_id long, v array<double>"),
            spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(feats)], "stim_id long, x array<double>"))


def test_scores_from_moments_equal_predictions(spark, world):
    conn, resp, feats = world
    seen, held = [[df.where(c) for df in (conn, resp)] for c in ("subject < 3", "subject = 3")]
    space, enc = X.train(*seen, feats, 4, 2, 1.0)
    rows = held[1].select("subject", "stim_id", F.col("stim_id").alias("row_idx"))
    ev, shots = rows.where("stim_id % 2 = 0"), rows.where("stim_id % 2 = 1")
    by = lambda df: {r["voxel"]: r["r"] for r in df.collect()}
    zero = by(X.score_zero_shot(space, enc, held[0], held[1], feats, ev, 2))
    assert zero == pytest.approx(by(M.voxelwise_correlation(X.predict_zero_shot(space, enc, held[0], held[1], feats, ev, 2), ["subject"])), abs=1e-9)
    few = by(X.score_few_shot(space, enc, held[0], held[1], feats, shots, ev, 1.0, 2))
    assert few == pytest.approx(by(M.voxelwise_correlation(X.predict_few_shot(space, enc, held[0], held[1], feats, shots, ev, 1.0, 2), ["subject"])), abs=1e-9)
    grid = X.fewshot_ablation(space, enc, held[0], held[1], feats, rows, ev, [0, 10, 500], [1, 2], 2).collect()
    assert [r["median_r"] for r in grid if r["n_shots"] == 0] == pytest.approx([np.median(list(zero.values()))], abs=1e-9)


def loop(conn, resp, feats, ks, alphas):
    """The sweep as trainings and predictions of each point."""
    out = {}
    for held in range(4):
        inside, outside = [[df.where(F.col("subject") != held), df.where(F.col("subject") == held)] for df in (conn, resp)], None
        (ci, co), (ri, ro) = inside
        for k in ks:
            for a in alphas:
                space, enc = X.train(ci, ri, feats, k, 2, a)
                r = M.voxelwise_correlation(X.predict_zero_shot(space, enc, co, ro, feats, None, 2), ["subject"])
                out[k, a, held] = M.correlation_summary(r, ["subject"]).first()["median_r"]
    return out


def test_sweep_equals_loop_and_resumes(spark, world):
    conn, resp, feats = world
    got = {(r["k"], r["alpha"], r["fold"]): r["score"] for r in X.loso_sweep(conn, resp, feats, [2, 3], [1.0, 50.0]).collect()}
    assert got == pytest.approx(loop(conn, resp, feats, [2, 3], [1.0, 50.0]), abs=1e-8)
    whole = Q.sweep(conn, resp, feats, [2, 3], [1.0, 50.0, 1e5], startup=2)
    log = sorted(map(tuple, whole.collect()))
    half = Q.sweep(conn, resp, feats, [2], [1.0, 50.0, 1e5], startup=2)
    again = sorted(map(tuple, Q.sweep(conn, resp, feats, [2, 3], [1.0, 50.0, 1e5], log=half, startup=2).collect()))
    assert [r[:5] + r[7:] for r in again] == [r[:5] + r[7:] for r in log]
    assert np.allclose([r[5:7] for r in again], [r[5:7] for r in log])
    assert {r[0] for r in log} == set(range(6))
    for t in range(6):
        mine = [r for r in log if r[0] == t]
        assert [r[3] for r in mine] == list(range(1, len(mine) + 1)) and (len(mine) == 4 or mine[0][7] == "PRUNED")
        assert mine[-1][6] == pytest.approx(np.mean([r[5] for r in mine]), abs=1e-11)
    with pytest.raises(ValueError, match="out of bounds"):
        Q.sweep(conn, resp, feats, [1], [1.0])


def test_pruned_trials_follow_the_rule(spark):
    rng = np.random.default_rng(6)
    rows = [(s, t, i, float(rng.random())) for s in (0, 1) for t in range(30) for i in range(1, 6)]
    log = Q.pruned_trials(spark.createDataFrame(rows, "study int, trial int, step int, score double"), 3, 2, 1, ["study"])
    flags = X.median_pruning(log.withColumnRenamed("interim", "score"), 3, 2, 1, ["study"])
    ends = log.where("state = 'PRUNED'").groupBy("study", "trial").agg(F.max("step").alias("step"))
    want = {tuple(r) for r in ends.collect()}
    got = {(r["study"], r["trial"], r["step"]) for r in flags.where("prune").collect()}
    assert got == want and 0 < len(want) < 60
    assert Q.pruned_trials(spark.createDataFrame([], "study int, trial int, step int, score double"), by=["study"]).count() == 0


def test_moments_of_many_partitions(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 200))
    df = spark.createDataFrame([(i % 2, r.tolist()) for i, r in enumerate(x)], "k int, v array<double>").repartition(100)
    got = moments.collected(moments.moment_blocks(df, ["k"], ["v"]), ["k"])
    whole = {r["k"]: r for r in moments.cross_moments(df, ["k"], ["v"]).collect()}
    for k in (0, 1):
        want = x[k::2].T @ x[k::2]
        assert np.allclose(got[k,][2], want) and got[k,][0] == 200 and np.allclose(got[k,][1], x[k::2].sum(0))
        assert np.allclose(np.array(whole[k]["g"]).reshape(200, 200), want)


def test_products_by_channel_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "CHANNELS", 7)
    rng = np.random.default_rng(8)
    p = {s: rng.standard_normal((20 + s, 3)) for s in (0, 1)}
    v = {(s, i): rng.standard_normal(20 + s) for s in (0, 1, 2) for i in range(9)}
    basis = spark.createDataFrame([(s, j, r.tolist()) for s, m in p.items() for j, r in enumerate(m)], "subject int, voxel int, p array<double>")
    rows = spark.createDataFrame([(s, i, x.tolist()) for (s, i), x in v.items()], "subject int, stim_id long, v array<double>")
    z = {(r["subject"], r["stim_id"]): r["z"] for r in A.project(rows, basis).collect()}
    assert set(z) == {k for k in v if k[0] < 2} and all(np.allclose(x, v[k] @ p[k[0]]) for k, x in z.items())
    turned = {(r["subject"], r["stim_id"]): r["z"] for r in A.project(rows, basis, {1: np.eye(3)[::-1]}).collect()}
    assert set(turned) == {(1, i) for i in range(9)} and np.allclose(turned[1, 4], z[1, 4][::-1])
    back = A.back_projected(A.project(rows, basis), basis)
    assert all(np.allclose(r["p"], np.array(z[r["subject"], r["stim_id"]]) @ p[r["subject"]].T) for r in back.collect())


def test_block_predictions_equal_numpy(spark):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, i % 3, rng.standard_normal(5).tolist(), rng.standard_normal(2).tolist()) for i in range(60)],
                                 "row_idx long, block int, x array<double>, z array<double>")
    models = E.fit_ridge_blocks(rows, "block", 2.0)
    held = {r["block"]: (np.array(r["w"]), np.array(r["b"])) for r in models.collect()}
    own = E.predict_blocks(rows.drop("z"), models, "block").collect()
    assert len(own) == 60 and all(np.allclose(r["p"], np.array(r["x"]) @ held[r["block"]][0] + held[r["block"]][1]) for r in own)
    every = E.predict_blocks(rows.drop("z", "block"), models, "block").collect()
    assert len(every) == 180 and all(np.allclose(r["p"], np.array(r["x"]) @ held[r["block"]][0] + held[r["block"]][1]) for r in every)


def test_ridge_of_twenty_thousand_features(spark):
    rng = np.random.default_rng(10)
    x, z = rng.standard_normal((60, 20_000)), rng.standard_normal((60, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, z)], "x array<double>, z array<double>")
    w, b = E.fit_ridge_wide(df, 500.0).linear()
    xc, zc = x - x.mean(0), z - z.mean(0)
    want = xc.T @ np.linalg.solve(xc @ xc.T + 500.0 * np.eye(60), zc)
    assert np.allclose(w, want, atol=1e-8) and np.allclose(b, z.mean(0) - x.mean(0) @ want)


@pytest.mark.parametrize("statistic", ["mean", "median"])
def test_replicates_are_the_same_held_and_joined(spark, monkeypatch, statistic):
    rng = np.random.default_rng(11)
    rows = [(k, "m" if k else None, i, None if i == 3 else float(rng.random())) for k in (0, 1, 2) for i in range(7 + k)]
    df = spark.createDataFrame(rows, "k int, metric string, rep int, value double").where("metric is not null")
    held = sorted(map(tuple, Z.bootstrap_interval(df, ["k", "metric"], 200, 90.0, statistic).collect()))
    monkeypatch.setattr(Z, "HELD_VALUES", 2)
    joined = sorted(map(tuple, Z.bootstrap_interval(df, ["k", "metric"], 200, 90.0, statistic).collect()))
    assert len(held) == 2 and all(a[:2] == b[:2] and np.allclose(a[2:], b[2:]) for a, b in zip(held, joined))
    monkeypatch.undo()
    assert Z.bootstrap_interval(df.limit(0), [], 200).count() in (0, 1)


def _series_rows(spark, missing=False):
    """Runs of two subjects as rows and as long series; with ``missing``, some values are null."""
    rng = np.random.default_rng(11)
    x = {(s, r): rng.standard_normal((9 + r, 7)) * 2 + 50 for s in (0, 1) for r in (2 * s, 2 * s + 1)}
    x[0, 1][:, 2] = 3.0  # a constant channel
    cells = {k: [[None if missing and (3 * t + v + k[1]) % 11 == 0 else float(m[t, v]) for v in range(7)] for t in range(len(m))] for k, m in x.items()}
    rows = spark.createDataFrame([(s, r, t, v) for (s, r), m in cells.items() for t, v in enumerate(m)], "subject int, run long, t int, v array<double>")
    labels = spark.createDataFrame([(s, v, [1, 1, 2, 0, 4, 4, 2][v]) for s in (0, 1) for v in range(7)], "subject int, voxel int, label int")
    return rows, rows.select("subject", "run", "t", F.posexplode("v").alias("voxel", "x")), labels


def _by(df, keys, value="c"):
    return {tuple(r[k] for k in keys): None if r[value] is None else round(r[value], 9) + 0.0 for r in df.collect()}


@pytest.mark.parametrize("missing", [False, True])
@pytest.mark.parametrize("batch", [4, 10_000])
def test_row_forms_equal_long_forms(spark, missing, batch):
    """Also where a run comes in several batches."""
    rows, long, labels = _series_rows(spark, missing)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        two = lambda c: long.withColumnRenamed("voxel", c)
        got = C.column_correlation_rows(rows, "v", "v", ["run"]).select("run", "i", F.posexplode("c").alias("j", "c"))
        assert _by(got, ["run", "i", "j"]) == pytest.approx(_by(C.column_correlation(two("i"), two("j"), ["run"], "i", "j"), ["run", "i", "j"]))
        for ensemble in ("average", "concat"):
            want = _by(C.parcel_connectivity(long, labels, 5, ensemble), ["subject", "label", "voxel"])
            for by in (["subject", "run"], ["run"]):
                assert _by(C.parcel_connectivity_rows(rows, labels, 5, ensemble, by), ["subject", "label", "voxel"]) == pytest.approx(want)
        keys = ["subject", "run", "own", "voxel", "label"]
        assert _by(C.voxel_profiles_rows(rows, labels, ["run"]), keys) == pytest.approx(_by(C.voxel_profiles(long, labels), keys))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_run_that_does_not_tell_its_subject(spark):
    rows, _, labels = _series_rows(spark)
    with pytest.raises(Exception, match="more than one subject"):
        C.parcel_connectivity_rows(rows.withColumn("run", F.lit(1)), labels, 5, by=["run"]).collect()

"""Literal cases, invariants and small NumPy solutions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortalign.functions import filters
from cohortalign.functions.matrices import aligned, to_long, to_matrix
from cohortalign.functions.moments import as_rows
from cohortalign.operators import alignment as A
from cohortalign.operators import connectivity as C
from cohortalign.operators import encoding as E
from cohortalign.operators import experiments as X
from cohortalign.operators import harmonize as H
from cohortalign.operators import masks as K
from cohortalign.operators import metrics as M
from cohortalign.operators import rowjoins as J
from cohortalign.operators import sources as S
from cohortalign.operators import splits as P
from cohortalign.operators import stats as Z
from cohortalign.operators import timeseries as T


def labels(spark, by_subject):
    return spark.createDataFrame([(s, i, v) for s, x in by_subject.items() for i, v in enumerate(x)], "subject int, voxel int, label int")


def test_common_labels(spark):
    df = labels(spark, {1: [0, 1, 2, 2, 3, 3], 2: [1, 2, 2, 0, 3, 4]})
    assert sorted(r[0] for r in H.common_labels(df, 1).collect()) == [1, 2, 3]
    assert {r["label"] for r in H.harmonize(df, 1).collect()} == {0, 1, 2, 3}
    with pytest.raises(Exception, match="too few common labels"):
        H.require_common(H.common_labels(df, 1), 3).collect()


def test_coverage(spark):
    r = H.utilization_summary(labels(spark, {1: [1, 1, 0, 2, 2, 0, 3]}), 3, 2).first()
    assert r["labeled_fraction"] == pytest.approx(5 / 7) and r["small"] == [3] and r["warn"]
    two = H.utilization_summary(labels(spark, {1: [1, 1, 2, 2, 0, 0], 2: [1, 1, 2, 2, 1, 2]}), 2, 2)
    rep = H.utilization_report(two).first()
    assert rep["min_fraction"] == pytest.approx(4 / 6) and rep["warned"] == []


def test_empty_parcels_count_in_one_summary_only(spark):
    df = labels(spark, {1: [1, 1, 3]})
    assert H.utilization_summary(df, 3, 1).first()["min_size"] == 1 and H.parcel_qc(df, 3, 1).first()["min_size"] == 0


def test_analysis_mask(spark):
    df = labels(spark, {1: [1, 1, 2], 2: [1, 1, 0]})
    mask = df.select("subject", "voxel", F.lit(True).alias("in_mask"))
    got = {r["subject"]: r["kept"] for r in K.mask_summary(K.analysis_mask(df, mask, "labelled", 2)).collect()}
    assert got == {1: 2, 2: 2}
    with pytest.raises(Exception, match="leaves no channel"):
        K.mask_summary(K.analysis_mask(df, mask, "labelled", 9)).collect()
    with pytest.raises(ValueError):
        K.analysis_mask(df, mask, "other")


def test_item_order(spark):
    t = spark.createDataFrame([(1, 12, 0), (1, 3, 1), (1, 8, 2)], "subject int, stim_id int, trial int")
    order = lambda how: [r["stim_id"] for r in K.item_order(t, order=how).orderBy("row_idx").collect()]
    assert order("sorted") == [3, 8, 12] and order("first_seen") == [12, 3, 8]
    with pytest.raises(ValueError):
        K.item_order(t, order="other")


def test_rows_at(spark):
    kept, counts = K.rows_at(spark.range(10).withColumnRenamed("id", "row_idx"), spark.createDataFrame([(1,), (4,), (10,), (12,)], "row_idx long"))
    assert sorted(r[0] for r in kept.collect()) == [1, 4] and tuple(counts.first()) == (2, 2)


def test_thresholds():
    assert K.parse_thresholds([0.3, 0.1, 0.3]) == [0.1, 0.3]
    with pytest.raises(ValueError):
        K.parse_thresholds([-1])


def test_stored_split_wins(spark, tmp_path):
    rows = spark.range(1000).select(F.lit(1).alias("subject"), F.col("id").alias("row_idx"))
    path = f"file://{tmp_path}/split"
    first = {r["row_idx"] for r in P.fixed_eval_split(rows, 250, 42, path=path).collect()}
    assert len(first) == 250 and first == {r["row_idx"] for r in P.fixed_eval_split(rows, 250, 999, path=path).collect()}
    with pytest.raises(Exception, match="another size"):
        P.fixed_eval_split(rows, 20, path=path).collect()


def test_shots_leave_evaluation_alone(spark):
    rows = spark.range(100).select(F.lit(1).alias("subject"), F.col("id").alias("row_idx"))
    got = {r["row_idx"] for r in P.sample_shots(rows, rows.where("row_idx < 20"), 30, 1).collect()}
    assert len(got) == 30 and min(got) >= 20


def test_folds(spark):
    df = P.loso_folds(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "subject int"))
    assert {(r["fold"], r["subject"]) for r in df.where("role = 'test'").collect()} == {(i, i) for i in (1, 2, 3, 4)} and df.count() == 16
    with pytest.raises(Exception, match="at least two"):
        P.loso_folds(spark.createDataFrame([(1,)], "subject int")).collect()


def test_alignment_of_rows(spark):
    src = spark.createDataFrame([(100 + i, float(i)) for i in range(10)], "stim_id long, v double")
    q = spark.createDataFrame([(210 - 100 + 1, 0), (103, 1)], "stim_id long, row_idx int")
    assert [r["v"] for r in J.align_rows(src, q, require_all=False).collect()] == [3.0]
    with pytest.raises(Exception, match="no source row"):
        J.align_rows(src, q).collect()
    assert tuple(J.missing_count(src, q).first()) == (1, 1)


def test_fewshot_without_list(spark):
    own = spark.createDataFrame([(1, 7), (1, 5)], "subject int, stim_id int")
    assert {(r["stim_id"], r["own_row"], r["template_row"]) for r in J.fewshot_candidates(own, None).collect()} == {(5, 0, 0), (7, 1, 1)}


def cells(spark, y, p):
    n, v = y.shape
    return spark.createDataFrame([(i, j, float(y[i, j]), float(p[i, j])) for i in range(n) for j in range(v)], "stim_id int, voxel int, y double, p double")


def test_correlations(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(size=(50, 10)), rng.normal(size=(50, 10))
    y[:, 0] = 5.0
    got = {r["voxel"]: r["r"] for r in M.voxelwise_correlation(cells(spark, y, p)).collect()}
    assert got[0] == 0 and all(got[j] == pytest.approx(np.corrcoef(y[:, j], p[:, j])[0, 1]) for j in range(1, 10))
    same = {round(r["r"], 9) for r in M.voxelwise_correlation(cells(spark, p, p)).collect()}
    assert same == {1.0}
    pat = {r["stim_id"]: r["r"] for r in M.pattern_correlation(cells(spark, y, p)).collect()}
    assert pat[3] == pytest.approx(np.corrcoef(y[3], p[3])[0, 1])


def test_two_vs_two(spark):
    y = np.random.default_rng(1).normal(size=(12, 20))
    assert M.two_vs_two(cells(spark, y, y), 50).first()["accuracy"] == 1.0
    assert M.two_vs_two(cells(spark, y, np.ones_like(y)), 50).first()["accuracy"] == 0.0  # ties are wrong


def test_ceiling_and_normalised(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(50, 4))
    rows = [(i, k, v, float(base[i, v] + (0 if v == 0 else 3 * v * rng.normal()))) for i in range(50) for k in range(3) for v in range(4)]
    nc = M.noise_ceiling(spark.createDataFrame(rows, "stim_id int, trial int, voxel int, val double"))
    got = {r["voxel"]: r["nc"] for r in nc.collect()}
    assert all(0 <= x <= 1 for x in got.values()) and got[0] > 0.99 and got[3] < got[0]
    corr = spark.createDataFrame([(v, 0.2) for v in range(4)], "voxel int, r double")
    norm = {r["voxel"]: r["normalized"] for r in M.normalized_performance(corr, nc, ["voxel"], 0.5).collect()}
    assert norm[0] == pytest.approx(0.2 / got[0]) and all((norm[v] is None) == (got[v] < 0.5) for v in norm)


def test_parcels(spark):
    corr = spark.createDataFrame([(0, 0.1), (1, 0.3), (2, 0.9)], "voxel int, r double")
    lab = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "voxel int, label int")
    r = M.roi_evaluation(corr, lab, ["voxel"]).collect()
    assert len(r) == 1 and r[0]["median_r"] == pytest.approx(0.2) and r[0]["n_voxels"] == 2


def sample(spark, groups):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in groups.items() for i, v in enumerate(vs)], "k string, rep int, value double")


def test_bootstrap(spark):
    r = {x["k"]: x for x in Z.bootstrap_interval(sample(spark, {"one": [0.4], "many": [0.1, 0.2, 0.3, 0.4]}), ["k"], 200).collect()}
    assert (r["one"]["ci_low"], r["one"]["ci_high"]) == (0.4, 0.4) and r["many"]["ci_low"] < 0.25 < r["many"]["ci_high"]
    with pytest.raises(ValueError):
        Z.bootstrap_interval(sample(spark, {"a": [1]}), ["k"], 10)


def test_permutation(spark):
    a, b = [.8, .9, 1.0, .85, .95], [.1, .2, .15, .05, .25]
    rows = [(1, s, i, v) for s, x in (("a", a), ("b", b)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, side string, rep int, value double")
    assert Z.permutation_test(df, ["k"], 1000).first()["p_value"] < 0.05


@pytest.mark.parametrize("p, want", [([.001, .01, .03, .2], None), ([.001, .01, .02, .6], [True, True, True, False])])
def test_false_discovery(spark, p, want):
    got = Z.benjamini_hochberg(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")).orderBy("i").collect()
    q = [r["q"] for r in got]
    assert all(a <= b for a, b in zip(p, q)) and q == sorted(q) and max(q) <= 1
    if want:
        assert [r["reject"] for r in got] == want


def test_false_discovery_by_ranges(spark):
    """Many tied, very small and single p-values, with and without groups, one of them null and one large."""
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.uniform(0, 1e-6, 900), np.full(700, 1 / 201), np.round(rng.uniform(0, 1, 900), 2), [0.0, 1.0]])
    g = [None if i % 50 == 0 else 1 if i % 3 else i % 7 for i in range(len(p))]
    df = spark.createDataFrame([(i, k, float(x)) for i, (k, x) in enumerate(zip(g, p))], "i int, g int, p double")

    def want(p):
        order = np.argsort(-p, kind="stable")
        rank = np.array([(p <= x).sum() for x in p])
        q = np.empty(len(p))
        q[order] = np.minimum.accumulate(np.minimum(p * len(p) / rank, 1)[order])
        return q

    got = np.array([r["q"] for r in Z.benjamini_hochberg(df).orderBy("i").collect()])
    np.testing.assert_allclose(got, want(p), rtol=1e-12)
    rows = Z.benjamini_hochberg(df, 0.05, ["g"]).orderBy("i").collect()
    assert len(rows) == len(p) and rows[0].__fields__ == ["i", "g", "p", "q", "reject"]
    for k in set(g):
        at = [i for i in range(len(p)) if g[i] == k]
        np.testing.assert_allclose([rows[i]["q"] for i in at], want(p[at]), rtol=1e-12)
    assert Z.benjamini_hochberg(df.limit(0)).count() == 0


def test_condition_summary_reference(spark):
    rows = [(c, i, "median_r", v) for c, vs in {0: [.1], 10: [.1, .12, .11], 50: [.3, .31, .29]}.items() for i, v in enumerate(vs)]
    out = {r["condition"]: r for r in Z.condition_summary(spark.createDataFrame(rows, "condition int, rep int, metric string, value double"), n_bootstrap=100, n_permutations=100).collect()}
    assert out[50]["delta"] == pytest.approx(.19) and out[10]["delta"] is None and out[0]["p"] is None


def test_highpass():
    b, a = filters.butter_highpass(5, 0.0267)
    gain = lambda w: abs(np.polyval(b, np.exp(1j * np.pi * w)) / np.polyval(a, np.exp(1j * np.pi * w)))
    assert gain(1.0) == pytest.approx(1) and gain(0.0267) == pytest.approx(0.5 ** 0.5, rel=1e-6) and gain(0.002) < 1e-4
    assert np.abs(filters.highpass(np.ones((100, 2)), 0.01, 1.333)).max() < 1e-8
    fast = np.sin(2 * np.pi * 0.2 * np.arange(2000) * 1.333)[:, None]
    assert np.abs(filters.highpass(fast, 0.01, 1.333) - fast)[600:1400].max() < 1e-3
    x = np.random.default_rng(0).normal(size=(300, 3))
    y = filters.highpass(x, 0.05, 1.333)
    assert np.allclose(filters.highpass(2 * x, 0.05, 1.333), 2 * y)
    assert np.abs(filters.highpass(x[::-1], 0.05, 1.333)[::-1] - y)[60:240].max() < 0.05
    assert filters.highpass(x, 5.0, 1.333) is x


def test_highpass_equals_one_step_at_a_time():
    b, a = filters.butter_highpass(5, 0.03)
    for n in (1, 31, 32, 33, 200):  # around the number of steps that are filtered at once
        x = np.random.default_rng(n).normal(size=(n, 2)).cumsum(0)
        past, out = [np.zeros(2)] * 5, []  # a high-pass of a constant is 0; so inputs less the first value start at rest
        fed = [np.zeros(2)] * 5 + list(x - x[0])
        for t in range(n):
            y = sum(c * fed[t + 5 - i] for i, c in enumerate(b)) - sum(c * past[-i] for i, c in enumerate(a[1:], 1))
            past.append(y)
            out.append(y)
        assert np.allclose(filters._run(filters._forms(5, 0.03), x), out, atol=1e-7)


def test_matrices():
    rows = pa.table({"g": ["a"] * 3, "t": pa.array([5, 2, 5], pa.int32()), "voxel": pa.array([1, 0, 0], pa.int32()), "x": [1.0, 2.0, None]})
    steps, names, m = to_matrix(rows, "t", "voxel", "x")
    assert steps.tolist() == [2, 5] and names.tolist() == [0, 1] and np.array_equal(m, [[2, np.nan], [np.nan, 1]], equal_nan=True)
    back = to_long(m, steps, names, {"g": rows.column("g")[0]}, {f.name: f.type for f in rows.schema}, "t", "voxel", "x")
    assert back.to_pylist() == [{"g": "a", "t": 2, "voxel": 0, "x": 2.0}, {"g": "a", "t": 5, "voxel": 1, "x": 1.0}] and back.schema == rows.schema
    assert np.array_equal(aligned(m, steps, np.array([1, 5, 9])), [[np.nan] * 2, [np.nan, 1], [np.nan] * 2], equal_nan=True)
    with pytest.raises(ValueError):
        to_matrix(pa.concat_tables([rows, rows]), "t", "voxel", "x")


@pytest.mark.parametrize("model", T.MODELS)
def test_confounds_of_the_chain_equal_those_of_the_columns(spark, model):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(40, 6))
    p[:, 3] = 0.5  # constant
    rows = [(1, t, *[None if (t, i) == (7, 2) else float(x) for i, x in enumerate(r)]) for t, r in enumerate(p)]
    motion = spark.createDataFrame(rows, "run int, t int, " + ", ".join(f"{c} double" for c in T.P))
    want = T.motion_confounds(motion, model).orderBy("t").toPandas().drop(columns=["run", "t"]).to_numpy(float)
    masked = np.ma.masked_invalid([[np.nan if x is None else x for x in r[2:]] for r in rows])
    assert np.allclose(T._standard_confounds(masked, model).filled(np.nan), want, atol=1e-9, equal_nan=True)


def test_parcel_rows_equal_the_long_form(spark):
    series = spark.createDataFrame([(0, 1, t, v, float(t * 7 % 5 + v)) for t in range(4) for v in range(3 if t else 1)], "subject int, run int, t int, voxel int, x double")
    labels = spark.createDataFrame([(0, 0, 0), (0, 1, 2), (0, 2, 2), (0, 3, 9)], "subject int, voxel int, label int")
    want = {(r.t, r.label): r.x for r in C.parcel_series(series, labels, 3).collect()}
    got = {(r.t, i): x for r in C.parcel_rows(series, labels, 3).collect() for i, x in enumerate(r.p, 1)}
    assert got == want and len(got) == 12


def test_regression():
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(60, 3)), rng.normal(size=(60, 2))
    r = filters.regress_out(x, c)
    assert np.abs(c.T @ r).max() < 1e-9 and np.abs(r.sum(0)).max() < 1e-9
    assert np.allclose(filters.regress_out(x, np.column_stack([c, c[:, 0], np.zeros(60)])), r)


def test_displacement_and_cleaning(spark):
    m = spark.createDataFrame([(1, t, float(t), 0.0, 0.0, 0.0, 0.0, 0.01 * t) for t in range(3)], "run int, t int, p1 double, p2 double, p3 double, p4 double, p5 double, p6 double")
    assert [round(r["fd"], 9) for r in T.framewise_displacement(m).orderBy("t").collect()] == [0, 1.5, 1.5]
    rng = np.random.default_rng(3)
    rows = [(r, v, t, float(rng.normal() + 0.1 * t)) for r, n in ((1, 60), (2, 20), (3, 60)) for v in range(3) for t in range(n)]
    motion = [(r, t, *[float(x) for x in rng.normal(size=6) * s]) for r, n, s in ((1, 60, 1e-3), (2, 20, 1e-3), (3, 60, 10.0)) for t in range(n)]
    out = T.clean_runs(spark.createDataFrame(rows, "run int, voxel int, t int, x double"), spark.createDataFrame(motion, "run int, t int, p1 double, p2 double, p3 double, p4 double, p5 double, p6 double"))
    got = out.groupBy("run", "voxel").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")).collect()
    assert {r["run"] for r in got} == {1}  # run 2 is too short, run 3 moves too much
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 and r["n"] == 55 for r in got)
    with pytest.raises(ValueError):
        T.motion_confounds(m, "other")


def rotation(k, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))
    return q


def test_procrustes(spark):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(40, 5)), rotation(5, 9)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, x @ q + 3)], "a array<double>, b array<double>")
    r = A.procrustes(df, "a", "b")[()]
    assert np.allclose(r, q) and np.allclose(r @ r.T, np.eye(5))
    flat = spark.createDataFrame([([1.0, 2.0], [0.0, float(i)]) for i in range(5)], "a array<double>, b array<double>")
    with pytest.raises(ValueError, match="constant"):
        A.procrustes(flat, "a", "b")
    with pytest.raises(ValueError, match="constant"):
        A.procrustes(df.limit(1), "a", "b")
    bad = spark.createDataFrame([([float("nan")], [1.0]), ([1.0], [2.0])], "a array<double>, b array<double>")
    with pytest.raises(ValueError, match="NaN"):
        A.procrustes(bad, "a", "b")


@pytest.fixture(scope="module")
def world(spark):
    """Three subjects of one latent space, a fourth held out."""
    rng = np.random.default_rng(5)
    k, r, f, n = 4, 8, 12, 60
    feats, w, shared = rng.normal(size=(n, f)), rng.normal(size=(f, k)), rng.normal(size=(r, k))
    conn, resp = [], []
    for s, v in ((1, 30), (2, 27), (3, 24), (4, 26)):
        p, _ = np.linalg.qr(rng.normal(size=(v, k)))
        c, y = shared @ p.T, feats @ w @ p.T + 0.01 * rng.normal(size=(n, v))
        conn += [(s, i, j, float(c[i, j])) for i in range(r) for j in range(v)]
        resp += [(s, i, y[i].tolist()) for i in range(n)]
    return (spark.createDataFrame(conn, "subject int, row int, voxel int, c double"), spark.createDataFrame(resp, "subject int, stim_id long, v array<double>"),
            spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(feats)], "stim_id long, x array<double>"))


def test_shared_space_end_to_end(spark, world, tmp_path):
    conn, resp, feats = world
    seen, held = [[df.where(c) for df in (conn, resp)] for c in ("subject < 4", "subject = 4")]
    space, enc = X.train(*seen, feats, 4, 2, 1.0)
    for m in space.rotations.values():
        assert np.allclose(m @ m.T, np.eye(4))
    p = {s: np.array([r["p"] for r in space.basis.where(F.col("subject") == s).orderBy("voxel").collect()]) for s in space.rotations}
    assert all(np.allclose(m.T @ m, np.eye(4), atol=1e-6) for m in p.values())
    score = lambda df: M.correlation_summary(M.voxelwise_correlation(df, ["subject"]), ["subject"]).first()["median_r"]
    rows = held[1].select("subject", "stim_id", F.col("stim_id").alias("row_idx"))
    ev = rows.where("stim_id % 2 = 0")
    assert score(X.predict_zero_shot(space, enc, held[0], held[1], feats, ev, 2)) > 0.9
    assert score(X.predict_few_shot(space, enc, held[0], held[1], feats, rows.where("stim_id % 2 = 1"), ev, 1.0, 2)) > 0.9
    grid = X.fewshot_ablation(space, enc, held[0], held[1], feats, rows, ev, [0, 10, 500], [1, 2], 2).collect()
    assert len(grid) == 5 and len({round(r["median_r"], 9) for r in grid if r["n_shots"] == 500}) == 1
    space.save(f"file://{tmp_path}/m")
    back = A.SharedSpace.load(spark, f"file://{tmp_path}/m")
    assert back.k == 4 and all(np.allclose(back.rotations[s], r) for s, r in space.rotations.items())
    strict = A.fit_shared_space(seen[0], None, 4, 2, "strict")
    with pytest.raises(ValueError, match="item template"):
        A.align_few_shot(strict, held[0], held[1], 2)
    with pytest.raises(ValueError, match="parcels"):
        A.align_zero_shot(space, held[0].where("row < 5"), 2)
    with pytest.raises(Exception, match="rank below"):
        A.global_k(conn, 4, 9).collect()


def test_encoders_equal_numpy(spark):
    rng = np.random.default_rng(6)
    x, z = rng.normal(size=(50, 7)) * 3 + 1, rng.normal(size=(50, 3))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist(), i % 2) for i, (a, b) in enumerate(zip(x, z))], "row_idx int, x array<double>, z array<double>, block int")
    xs = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(xs.T @ xs + 2 * np.eye(7), xs.T @ (z - z.mean(0)))
    enc = E.fit_ridge(df, 2.0)
    assert np.allclose(enc.w, w, atol=1e-8) and np.allclose(enc.b, z.mean(0))
    got = {r["row_idx"]: r["z"] for r in E.predict(df.drop("z"), enc).collect()}
    assert np.allclose([got[i] for i in range(50)], xs @ w + z.mean(0))
    half = slice(1, None, 2)
    xh = (x[half] - x.mean(0)) / x.std(0)
    wh = np.linalg.solve(xh.T @ xh + 2 * np.eye(7), xh.T @ (z[half] - z[half].mean(0)))
    tuned = E.fine_tune(enc, df.where("block = 1"), 2.0)
    assert np.allclose(tuned.w, (w + wh) / 2) and np.allclose(tuned.b, (z.mean(0) + z[half].mean(0)) / 2)
    wide, gram = E.fit_ridge_wide(df, 2.0), E.fit_ridge(df, 2.0, standardize=False)
    assert np.allclose(wide.w, gram.w, atol=1e-6)
    best, alpha, scores = E.fit_ridge_cv(df, [0.1, 10.0], 5)
    folds = np.repeat(np.arange(5), 10)

    def r2(a):
        out = []
        for f in range(5):
            tr, te = folds != f, folds == f
            xm, zm = x[tr].mean(0), z[tr].mean(0)
            wf = np.linalg.solve((x[tr] - xm).T @ (x[tr] - xm) + a * np.eye(7), (x[tr] - xm).T @ (z[tr] - zm))
            e = z[te] - ((x[te] - xm) @ wf + zm)
            out.append(np.mean(1 - (e ** 2).sum(0) / ((z[te] - z[te].mean(0)) ** 2).sum(0)))
        return np.mean(out)

    assert np.allclose(scores, [r2(0.1), r2(10.0)])
    m = E.predict_blocks(df.drop("z", "block"), E.fit_ridge_blocks(df, "block", 2.0), "block")
    one = E.fit_ridge(df.where("block = 1"), 2.0, standardize=False)
    a, b = one.linear()
    got = {r["row_idx"]: r["p"] for r in m.where("block = 1").collect()}
    assert np.allclose([got[i] for i in range(50)], x @ a + b)


def test_sweep_with_given_functions(spark):
    resp = spark.createDataFrame([(s, i, [1.0]) for s in (1, 2, 3) for i in range(2)], "subject int, stim_id long, v array<double>")
    out = X.loso_sweep(None, resp, None, [4], [1.0], 2, lambda df, k, a: None, lambda m, df: 0.1 * df.first()["subject"])
    assert X.sweep_objective(out).first()["objective"] == pytest.approx(0.2)
    with pytest.raises(ValueError, match="bounds"):
        X.loso_sweep(None, resp, None, [1], [1.0], 2)


def test_only_complete_trials_win(spark):
    t = spark.createDataFrame([(1, "COMPLETE", 0.15), (2, "PRUNED", 0.16), (3, "COMPLETE", 0.15)], "number int, state string, value double")
    assert tuple(X.best_trial(t).first()) == (1, 0.15)


def test_captions_and_sinks(spark, tmp_path):
    c = spark.createDataFrame([(1, [" a ", None, ""]), (2, ["  "]), (3, None)], "i int, c array<string>")
    assert [r[0] for r in c.orderBy("i").select(S.clean_captions(F.col("c"))).collect()] == [["a"], [""], [""]]
    S.write_summary_csv([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "c int, a int")], f"file://{tmp_path}/s")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/s").columns == ["a", "b", "c"]
    done = spark.createDataFrame([(1,)], "stim_id long")
    items = spark.createDataFrame([(1,), (2,)], "stim_id long")
    assert [r[0] for r in S.featurise(items, lambda p: p, "stim_id long", done).collect()] == [2]
    assert as_rows(spark.createDataFrame([(1, 1, 5.0), (1, 0, 4.0)], "k int, i int, x double"), ["k"], "i", "x").first()["v"] == [4.0, 5.0]


def test_moments_are_added_block_by_block(spark, monkeypatch):
    import numpy as np

    from cohortalign.functions import moments

    monkeypatch.setattr(moments, "BLOCK", 100)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 40))
    rows = spark.createDataFrame([(int(i % 3), [float(v) for v in r]) for i, r in enumerate(x)], "k int, v array<double>").repartition(16)
    got = moments.collected(moments.moment_blocks(rows, ["k"], ["v"]), ["k"])
    for k in range(3):
        m = x[k::3]
        n, s, g = got[(k,)]
        assert n == 100 and np.allclose(s, m.sum(0)) and np.allclose(g, m.T @ m)
    (n, s, g), = moments.collected(moments.moment_blocks(rows, [], ["v"]), []).values()
    assert n == 300 and np.allclose(g, x.T @ x)
    assert moments.collected(moments.moment_blocks(rows.limit(0), [], ["v"]), []) == {}

import numpy as np
import pytest

from tessitura.models import factors, gmm, svm
from tessitura.operators import scoring, stats


def planted(seed=0, classes=10, per=40, dim=8, noise=0.6):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(classes, dim))
    return [(f"m{k}", f"s{k}_{i}", k * per + i, (means[k] + rng.normal(size=dim) * noise).tolist()) for k in range(classes) for i in range(per)]


@pytest.fixture(scope="module")
def vectors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(planted(), "model_id string, seg_id string, pos long, stat1 array<double>").withColumn("stat0", F.array(F.lit(1.0)))
    return df.cache()


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[-4.0, -5], [4, -5], [-4, 5], [4, 5]])
    x = centres[np.arange(2000) % 4] + rng.normal(size=(2000, 2)) * 0.5
    rows = [(f"s{i % 20}", f"s{i % 20}", i // 20, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "show string, seg_id string, frame_idx long, cep array<double>").cache()


def test_moments_and_covariances(vectors):
    x = np.array([r[3] for r in planted()])
    k = np.repeat(np.arange(10), 40)
    n, s, ss = stats.moments(vectors)
    assert n == 400 and np.allclose(s, x.sum(0)) and np.allclose(ss, x.T @ x)
    total, within, between = stats.total_covariance(vectors), stats.within_covariance(vectors), stats.between_covariance(vectors)
    m = np.array([x[k == c].mean(0) for c in range(10)])
    assert np.allclose(within, (x - m[k]).T @ (x - m[k]) / 400)
    assert np.allclose(total, within + between)
    w = stats.wccn(vectors)
    assert np.allclose(np.linalg.inv(w @ w.T), np.mean([np.cov(x[k == c].T, bias=True) for c in range(10)], axis=0))


def test_lda_and_nap(vectors):
    d = stats.lda(vectors, 3)
    w, b = stats.within_covariance(vectors), stats.between_covariance(vectors)
    ratio = [v @ b @ v / (v @ w @ v) for v in d.T]
    assert ratio == sorted(ratio, reverse=True)
    assert np.allclose(b @ d[:, 0], ratio[0] * (w @ d[:, 0]))
    n = stats.nap(vectors, 2)
    left = stats.remove_directions(vectors.select("stat1"), "stat1", n).toPandas()["stat1"]
    assert np.abs(np.array(left.tolist()) @ n).max() < 1e-9


def test_spectral_norm(vectors):
    steps = stats.spectral_norm(vectors, 2, "efr")
    x = np.array([r.stat1 for r in stats.apply_spectral_norm(vectors, steps).select("stat1").collect()])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    with pytest.raises(ValueError):
        stats.spectral_norm(vectors, 1, "other")


def test_gmm_finds_planted_centres(frames):
    m, ll = gmm.fit_by_splitting(frames, 4, (2, 8))
    assert m.n == 4 and ll[-1] > ll[0]
    centres = {tuple(np.round(c).astype(int)) for c in m.mu}
    assert centres == {(-4, -5), (4, -5), (-4, 5), (4, 5)}
    full, _ = gmm.diagonal_to_full(frames, m, 2)
    assert full.full and np.allclose(full.mu, m.mu, atol=0.1)
    x = np.array([r.cep for r in frames.limit(50).collect()])
    assert np.allclose(m.to_full().log_density(x), m.log_density(x))


def test_gmm_likelihood_never_falls(frames):
    start = gmm.uniform_start(frames, 3)
    _, ll = gmm.fit(frames, start, 6, None, floor=0.0, ceiling=1e9)
    assert all(b >= a - 1e-9 for a, b in zip(ll, ll[1:]))


def test_mixture_tables_and_merge(spark, frames):
    m, _ = gmm.fit_by_splitting(frames, 2, (2,))
    again = gmm.Mixture.from_table(m.to_table(spark))
    assert np.allclose(again.mu, m.mu) and np.allclose(again.cov, m.cov)
    both = gmm.Mixture.merge([m, m])
    both.check()
    assert both.n == 4


def test_statistics_and_gmm_scores(spark, frames):
    m, _ = gmm.fit_by_splitting(frames, 4, (2, 6))
    st = gmm.sufficient_statistics(frames, m)
    got = {r.seg_id: (np.array(r.stat0), np.array(r.stat1)) for r in st.collect()}
    x = np.array([r.cep for r in frames.where("seg_id = 's3'").orderBy("frame_idx").collect()])
    g, _ = m.posteriors(x)
    assert np.allclose(got["s3"][0], g.sum(0)) and np.allclose(got["s3"][1], (g.T @ x).ravel())
    models = spark.createDataFrame([("a", (m.mu + 0.5).ravel().tolist())], "model_id string, v array<double>")
    trials = spark.createDataFrame([("a", "s3"), ("b", "s3"), ("a", "nowhere")], "model_id string, seg_id string")
    (r,) = gmm.score(trials, frames, models, m, block=7).collect()
    want = (np.logaddexp.reduce(m.log_density(x, m.mu + 0.5), axis=1) - np.logaddexp.reduce(m.log_density(x), axis=1)).mean()
    assert abs(r.score - want) < 1e-9
    llk = gmm.frame_log_likelihood(frames.where("seg_id = 's3'"), m).orderBy("frame_idx").collect()
    assert np.allclose([r.llk for r in llk], np.logaddexp.reduce(m.log_density(x), axis=1))


def test_gmm_scores_of_all_pairs_by_tiles(spark, monkeypatch):
    """No trial is listed: models and segments of a group meet in tiles. Frames far out and segments that are cut give the same scores."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    m = gmm.Mixture(np.array([0.5, 0.3, 0.2]), rng.normal(size=(3, 2)), rng.uniform(0.3, 1.0, (3, 2)))
    x = {f"s{k}": rng.normal(size=(5 + 9 * k, 2)) * 2 for k in range(9)}
    x["s3"][4] = [300.0, -200.0]  # exponents beyond a double's range
    frames = spark.createDataFrame([(k, i, v.tolist(), str(int(k[1]) % 2)) for k, r in x.items() for i, v in enumerate(r)] + [("s9", 0, None, "1"), ("n", 0, [0.0, 0.0], None)], "seg_id string, frame_idx long, cep array<double>, by string")
    means = {f"m{k}": m.mu + rng.normal(size=(3, 2)) for k in range(7)}
    models = spark.createDataFrame([(k, v.ravel().tolist(), str(int(k[1]) % 2)) for k, v in means.items()] + [("m9", m.mu.ravel().tolist(), "7")], "model_id string, v array<double>, by string")
    want = {(a, b): (np.logaddexp.reduce(m.log_density(x[b], v), axis=1) - np.logaddexp.reduce(m.log_density(x[b]), axis=1)).mean() for a, v in means.items() for b in x if int(a[1]) % 2 == int(b[1]) % 2}
    for limits in ({}, {"TILE_MODELS": 2, "TILE_PAIRS": 60, "WHOLE": 2}):
        for k, v in limits.items():
            monkeypatch.setattr(gmm, k, v)
        got = [((r.model_id, r.seg_id), r.score) for r in gmm.score_within(frames, models, m, block=7).collect()]
        assert len(got) == len(want) and all(abs(s - want[k]) < 1e-9 for k, s in got)
    one = gmm.Mixture(np.ones(1), m.mu[:1], m.cov[:1])
    assert gmm.score_within(frames, models.withColumn("v", F.slice("v", 1, 2)), one).count() == len(want)
    full = m.to_full()
    got = {(r.model_id, r.seg_id): r.score for r in gmm.score_within(frames, models, full).collect()}
    assert all(abs(got[k] - s) < 1e-9 * max(1, abs(s)) for k, s in want.items())


def sessions(spark, seed=2, n=300, c=3, d=2, r=2):
    rng = np.random.default_rng(seed)
    m = gmm.Mixture(np.full(c, 1 / c), rng.normal(size=(c, d)) * 3, np.full((c, d), 1.5))
    t = rng.normal(size=(c * d, r))
    rows = []
    for i in range(n):
        if i % 4 == 0:
            speaker = rng.normal(size=r)
        h = speaker
        n0 = rng.integers(20, 60, c).astype(float)
        white = np.repeat(n0, d) * (t @ h) + rng.normal(size=c * d) * np.sqrt(np.repeat(n0, d))
        f = white * np.sqrt(m.cov).ravel() + np.repeat(n0, d) * m.mu.ravel()
        rows.append((f"m{i // 4}", f"s{i}", n0.tolist(), f.tolist()))
    return spark.createDataFrame(rows, "model_id string, seg_id string, stat0 array<double>, stat1 array<double>"), m, t


def test_total_variability_recovers_the_subspace(spark):
    df, m, t = sessions(spark)
    model = factors.total_variability(df, m, 2, iterations=8)
    got, want = model.F @ model.F.T, t @ t.T
    assert np.linalg.norm(got - want) / np.linalg.norm(want) < 0.3
    iv = factors.extract(df, m, model)
    r = iv.where("seg_id = 's5'").first()
    row = df.where("seg_id = 's5'").first()
    n = np.array([row.stat0])
    h, cov = factors.posterior(n, factors.whitened(n, np.array([row.stat1]), m), model.F, m.n)
    assert np.allclose(r.v, h[0]) and np.allclose(r.variance, np.diag(cov[0])) and np.allclose(r.second_moment, np.diag(cov[0]) + h[0] ** 2)
    for method in ("weight", "eigen"):
        near = factors.extract_approximate(df, m, model.F, method).where("seg_id = 's5'").first()
        assert np.linalg.norm(np.array(near.v) - h[0]) < 0.5 * np.linalg.norm(h[0]) + 0.2


def test_plda_separates_and_equals_the_gaussian_ratio(spark, vectors):
    model = factors.plda(vectors, 4, 8)
    trials = spark.createDataFrame([(f"m{k}", f"s{j}_{39 - k % 3}") for k in range(10) for j in range(10)], "model_id string, seg_id string")
    enroll, test = scoring.mean_of(vectors), scoring.first_of(vectors, "seg_id")
    got = {(r.model_id, r.seg_id): r.score for r in scoring.fast_plda(trials, enroll, test, model.mean, model.F, model.sigma).collect()}
    same = [v for (m, s), v in got.items() if m[1:] == s[1:].split("_")[0]]
    other = [v for (m, s), v in got.items() if m[1:] != s[1:].split("_")[0]]
    assert np.mean(same) > np.mean(other) + 2

    x = {r.model_id: np.array(r.v) for r in enroll.collect()}["m1"] - model.mean
    y = {r.seg_id: np.array(r.v) for r in test.collect()}["s1_38"] - model.mean
    a, t = model.F @ model.F.T, model.F @ model.F.T + model.sigma
    def logn(v, c):
        return -0.5 * (np.linalg.slogdet(c)[1] + v @ np.linalg.solve(c, v))
    want = logn(np.concatenate([x, y]), np.block([[t, a], [a, t]])) - logn(x, t) - logn(y, t)
    assert abs(got[("m1", "s1_38")] - want) < 1e-8
    full = scoring.full_plda(trials, enroll, test, model.mean, model.F, np.zeros((8, 1)), model.sigma).where("model_id = 'm1' and seg_id = 's1_38'").first()
    assert abs(full.score - want) < 1e-8
    from pyspark.sql import functions as F
    unsure = test.withColumn("u", F.array(*[F.lit(0.0)] * 8))
    u = scoring.plda_uncertain(trials, enroll, unsure, model.mean, model.F, model.sigma).where("model_id = 'm1' and seg_id = 's1_38'").first()
    assert abs(u.score - want) < 1e-8
    open_ = scoring.fast_plda(trials, enroll, test, model.mean, model.F, model.sigma, p_known=0.5)
    assert open_.count() == 100


def test_closed_forms_against_numpy(spark, vectors):
    trials = spark.createDataFrame([("m1", "s2_3"), ("m1", "s1_4")], "model_id string, seg_id string")
    enroll, test = scoring.mean_of(vectors), scoring.first_of(vectors, "seg_id")
    e = np.array(enroll.where("model_id = 'm1'").first().v)
    t = {r.seg_id: np.array(r.v) for r in test.where("seg_id in ('s2_3', 's1_4')").collect()}
    rng = np.random.default_rng(0)
    a = rng.normal(size=(8, 8))
    spd = a @ a.T + np.eye(8)
    for r in scoring.mahalanobis(trials, enroll, test, spd).collect():
        d = e - t[r.seg_id]
        assert abs(r.score + 0.5 * d @ spd @ d) < 1e-8
    w, b = stats.within_covariance(vectors), stats.between_covariance(vectors)
    two = {r.seg_id: r.score for r in scoring.two_covariance(trials, enroll, test, w, b).collect()}
    assert two["s1_4"] > two["s2_3"]
    for r in scoring.cosine(trials, enroll, test, stats.wccn(vectors)).collect():
        u, v = e @ stats.wccn(vectors), t[r.seg_id] @ stats.wccn(vectors)
        assert abs(r.score - u @ v / np.linalg.norm(u) / np.linalg.norm(v)) < 1e-9


def test_gaussian_backend(spark, vectors):
    for alpha in (None, 0.1):
        p = scoring.gaussian_backend_train(vectors, alpha)
        got = scoring.gaussian_backend_test(scoring.first_of(vectors, "seg_id"), p).toPandas()
        best = got.loc[got.groupby("seg_id")["score"].idxmax()]
        assert (best["model_id"].str[1:] == best["seg_id"].str[1:].str.split("_").str[0]).mean() > 0.8


def test_svm_is_optimal_and_separates(spark, vectors):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(40, 3)) + 2, rng.normal(size=(60, 3)) - 1])
    y = np.repeat([1.0, -1.0], [40, 60])
    w, b, a = svm.solve(x, y, 0.1)
    size = np.sqrt((x**2).sum(1).mean())

    def primal(w, b):
        return 0.5 * (w @ w + (b / size) ** 2) + 0.1 * np.maximum(0, 1 - y * (x @ w + b)).sum()

    assert (a >= 0).all() and (a <= 0.1).all()
    for _ in range(50):
        assert primal(w + rng.normal(size=3) * 0.05, b + rng.normal() * 0.05) > primal(w, b) * (1 - 1e-3)
    from pyspark.sql import functions as F
    v = vectors.select("model_id", "seg_id", F.col("stat1").alias("v"))
    machines = svm.train(v.where("model_id = 'm2'"), v.where("model_id <> 'm2'"))
    trials = v.select(F.lit("m2").alias("model_id"), "seg_id")
    got = scoring.svm(trials, machines, v.select("seg_id", "v")).toPandas()
    own = got["seg_id"].str.startswith("s2_")
    assert got[own]["score"].mean() > got[~own]["score"].mean() + 0.5


def test_svm_without_size_limits(spark, vectors, monkeypatch):
    from pyspark.sql import functions as F

    v = vectors.select("model_id", F.col("stat1").alias("v"))
    background = v.where("model_id >= 'm4'").select("v")
    neg = np.array([r.v for r in background.collect()])
    own = {k: np.array([r[3] for r in planted() if r[0] == k]) for k in ("m0", "m3")}
    own["m3"] = own["m3"][own["m3"][:, 0] > 0]
    few = v.where("model_id = 'm0' or model_id = 'm3' and v[0] > 0")

    def check(machines):
        assert sorted(r.model_id for r in machines) == ["m0", "m3"]
        for r in machines:
            x, y = np.vstack([neg, own[r.model_id]]), np.repeat([-1.0, 1.0], [len(neg), len(own[r.model_id])])
            size = (x**2).sum(1).mean()
            w, b, _ = svm.solve(x, y, 1 / size, 1e-7)

            def primal(w, b):
                return 0.5 * (w @ w + b**2 / size) + np.maximum(0, 1 - y * (x @ w + b)).sum() / size

            assert primal(np.array(r.w), r.b) <= primal(w, b) * (1 + 1.1e-4)

    monkeypatch.setattr(svm, "MAX_BACKGROUND", 100)
    check(svm.train(few, background).collect())
    monkeypatch.setattr(svm, "MAX_BACKGROUND", 20_000)
    monkeypatch.setattr(svm, "MAX_SESSIONS", 39)
    check(svm.train(few, background).collect())


def test_svm_machines_are_solved_over_working_sets(monkeypatch):
    """Whole problems are not solved one by one, and yet each machine's gap over all of the background is small."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(2000, 8)) * 2
    background = centres + rng.normal(size=(2000, 8)) * 0.2
    own = [centres[k] + rng.normal(size=(n, 8)) * 0.5 for k, n in enumerate([1, 2, 3, 5, 8, 40, 700])]
    own += [np.full((1, 8), 1e-3), background[:1], np.vstack([centres[9:10]] * 4)]
    solve, rows = svm.solve, []
    monkeypatch.setattr(svm, "solve", lambda x, *a, **k: (rows.append(len(x)), solve(x, *a, **k))[1])
    got = svm.solve_many(own, background)
    assert all(700 < n < 2700 for n in rows)  # those of the large machine only
    for x, r in zip(own, got):
        x, y = np.vstack([background, x]), np.repeat([-1.0, 1.0], [len(background), len(x)])
        size = (x**2).sum(1).mean()
        w, b, _ = solve(x, y, 1 / size, 1e-6)

        def primal(w, b):
            return 0.5 * (w @ w + b**2 / size) + np.maximum(0, 1 - y * (x @ w + b)).sum() / size

        assert primal(r[:-1], r[-1]) <= primal(w, b) * (1 + 1.1e-4)
    monkeypatch.setattr(svm, "ROUNDS", 1)
    assert np.allclose(svm.solve_many(own[:2], background), got[:2], atol=0.02)


def test_joint_factor_analysis(spark):
    df, m, t = sessions(spark, n=200)
    model = factors.joint_factor_analysis(df, m, 2, 1, True, (6, 3, 3))
    assert model.F.shape == (6, 2) and model.G.shape == (6, 1) and model.H.shape == (6,)
    got, want = model.F @ model.F.T, t @ t.T
    assert np.linalg.norm(got - want) / np.linalg.norm(want) < 0.5
    e, te = factors.jfa_sides(df, df, m, model)
    trials = spark.createDataFrame([("m3", "s12"), ("m3", "s80"), ("m9", "s36"), ("m9", "s120")], "model_id string, seg_id string")
    got = {(r.model_id, r.seg_id): r.score for r in scoring.jfa(trials, e, te).collect()}
    assert got[("m3", "s12")] + got[("m9", "s36")] > got[("m3", "s80")] + got[("m9", "s120")]


@pytest.mark.parametrize("parts", ["vud", "vu", "vd", "v"])
def test_jfa_scores_equal_the_dense_formula(spark, parts):
    df, m, _ = sessions(spark, n=24)
    rng, sv = np.random.default_rng(5), m.super_size
    v, u, d = rng.normal(size=(sv, 2)), rng.normal(size=(sv, 1)) * 0.7, rng.uniform(0.2, 1.0, sv)
    model = factors.FactorModel(np.zeros(sv), F=v, G=u if "u" in parts else None, H=d if "d" in parts else None)
    data = df.collect()
    scale, mu = np.sqrt(m.cov).ravel(), m.mu.ravel()

    def dense(n, f, loadings):
        return np.linalg.solve(np.eye(loadings.shape[1]) + loadings.T @ np.diag(n) @ loadings, loadings.T @ f)

    def white(rows):
        n = np.repeat(np.sum([r.stat0 for r in rows], axis=0), m.dim)
        return n, (np.sum([r.stat1 for r in rows], axis=0) - n * mu) / scale

    e, te = factors.jfa_sides(df, df, m, model)
    trials = df.select("model_id").distinct().crossJoin(df.select("seg_id"))
    got = {(r.model_id, r.seg_id): r.score for r in scoring.jfa(trials, e, te).collect()}
    assert len(got) == 6 * 24
    for model_id in ("m0", "m4"):
        n, f = white([r for r in data if r.model_id == model_id])
        h = dense(n, f, np.column_stack([v] + [u] * ("u" in parts) + [np.diag(d)] * ("d" in parts)))
        offset = v @ h[:2] + (d * h[-sv:] if "d" in parts else 0)
        for r in data[::5]:
            n, f = white([r])
            if "u" in parts:
                f = f - n * (u @ dense(n, f, u))
            assert abs(got[(model_id, r.seg_id)] - offset @ f / np.sum(r.stat0)) < 1e-9


def test_gradients_are_those_of_the_loss():
    from tessitura.models import networks as NN
    from tessitura.models import training as TR

    rng = np.random.default_rng(4)
    small = NN.Network([NN.Layer(rng.normal(size=(3, 2, 4)) * 0.5, rng.normal(size=4) * 0.1, "leaky"), NN.Layer(rng.normal(size=(2, 4, 3)) * 0.5, np.zeros(3), "tanh", 2, np.full(3, 0.1), np.full(3, 2.0))], [NN.Layer(rng.normal(size=(6, 5)), np.zeros(5), "sigmoid"), NN.Layer(rng.normal(size=(5, 3)), np.zeros(3), "softmax")])
    ff = NN.random_network([4, 6, 3], 2)
    for net, x in ((small, rng.normal(size=(5, 9, 2))), (ff, rng.normal(size=(7, 4)))):
        y = rng.integers(0, 3, len(x))
        g, _ = TR.gradient(net, x, y)
        v = TR.parameters(net)
        assert np.array_equal(TR.parameters(TR.with_parameters(net, v)), v) and len(g) == len(v)
        for i in rng.choice(len(v), 12, replace=False):
            e = np.zeros(len(v))
            e[i] = 1e-6
            up, down = (TR.gradient(TR.with_parameters(net, v + s * e), x, y)[1] for s in (1, -1))
            assert abs((up - down) / 2e-6 - g[i]) < 1e-4 * max(1, abs(g[i]))


def test_networks_learn_planted_classes(spark):
    from tessitura.models import networks as NN
    from tessitura.models import training as TR

    rng = np.random.default_rng(1)
    centre = rng.normal(size=(3, 4)) * 2
    rows = [(str(i), i % 3, (centre[i % 3] + rng.normal(size=4)).tolist()) for i in range(900)] + [("n", None, [0.0] * 4), (None, 1, [0.0] * 4)]
    df = spark.createDataFrame(rows, "key string, label int, x array<double>")
    t = TR.Training(epochs=6, batches=3, rate=0.05, held_out=0.2, l2=1e-5)
    net = TR.train(df, NN.random_network([4, 8, 3]), t)
    x = np.array([r[2] for r in rows[:900]])
    ideal = (((x[:, None] - centre) ** 2).sum(2).argmin(1) == np.arange(900) % 3).mean()  # the rule of the planted centres
    assert (net.forward(x).argmax(1) == np.arange(900) % 3).mean() > ideal - 0.02 and t.history[-1][1] < t.history[0][1]
    # segments that differ in how their frames vary, not in their mean
    seg = [(str(i), i % 2, (rng.normal(size=(20, 2)) * (1 + i % 2)).ravel().tolist()) for i in range(240)]
    s = spark.createDataFrame(seg, "key string, label int, x array<double>")
    u = TR.Training(epochs=12, batches=2, rate=0.02)
    start = NN.Network([NN.Layer(rng.normal(size=(3, 2, 6)) * 0.4, np.zeros(6), "leaky"), NN.Layer(rng.normal(size=(1, 6, 6)) * 0.4, np.zeros(6), "leaky")], [NN.Layer(rng.normal(size=(12, 8)) * 0.4, np.zeros(8), "leaky"), NN.Layer(rng.normal(size=(8, 2)) * 0.4, np.zeros(2), "softmax")])
    net = TR.train(s, start, u, frames=20)
    got = [int(np.argmax(net.embed(np.array(x).reshape(20, 2), 2))) for _, _, x in seg]
    assert np.mean(np.array(got) == np.arange(240) % 2) > 0.85


def test_classes_are_separated_and_cross_validated(spark):
    from tessitura.models import classify as C

    rng = np.random.default_rng(3)
    centre = np.array([[3.0, 0, 0], [0, 3.0, 0], [0, 0, 3.0]])
    rows = [(i, i % 3, (centre[i % 3] + rng.normal(size=3) * 0.6).tolist(), (i // 3) % 4) for i in range(240)] + [(900, None, [1.0, 0.0, 0.0], 0), (901, 1, None, 1)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>, fold int")
    done, quality = C.cross_validate(df, "fold", 4, cost=1.0)
    got = {r.id: r.predicted for r in done.collect()}
    assert len(got) == 241 and 901 not in got and np.mean([got[i] == i % 3 for i in range(240)]) > 0.95
    assert quality.first().accuracy > 95

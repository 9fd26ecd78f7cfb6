"""Sources, sinks, codecs, networks, streams and frame operators on small tables."""

import datetime as dt
import os

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessitura.models import networks as N
from tessitura.operators import codecs, frames as FR, metrics as M, prefix, trials as T
from tessitura.signal import extract as X
from tessitura.signal import kernels as K
from tessitura.sources import binary as B
from tessitura.sources import lists as L
from tessitura.streaming import scoring as S


def test_text_round_trips(spark, tmp_path):
    p = str(tmp_path)
    idmap = spark.createDataFrame([(0, "m", "s", None, None), (1, "m", "t", 3, 9)], "pos long, model_id string, seg_id string, start int, stop int")
    L.write_idmap_text(idmap, f"{p}/a")
    assert rows(L.read_idmap_text(spark, f"{p}/a").drop("pos")) == rows(idmap.drop("pos"))
    key = spark.createDataFrame([("m", "s", True), ("m", "t", False)], "model_id string, seg_id string, is_target boolean")
    L.write_key_text(key, f"{p}/k")
    assert rows(L.read_key_text(spark, f"{p}/k")) == rows(key)
    sc = spark.createDataFrame([("m", "s", -1.5), ("m", "t", 0.1)], "model_id string, seg_id string, score double")
    L.write_scores_text(sc, f"{p}/s")
    assert rows(L.read_scores_text(spark, f"{p}/s")) == rows(sc)
    L.write_index_text(key, f"{p}/n")
    assert rows(L.read_index_text(spark, f"{p}/n")) == rows(key.select("model_id", "seg_id"))
    os.makedirs(f"{p}/lab")
    for name, text in (("u.lbl", "0.1 0.2 speech\n0.5 0.7 noise\n"), ("v.lbl", "")):
        open(f"{p}/lab/{name}", "w").write(text)
    assert rows(L.read_labels(spark, f"{p}/lab")) == [("u", 0.1, 0.2, "speech"), ("u", 0.5, 0.7, "noise")]
    open(f"{p}/ali", "w").write("u 3 3 4\n")
    assert rows(L.read_alignment(spark, f"{p}/ali")) == [("u", 0, 3), ("u", 1, 3), ("u", 2, 4)]
    open(f"{p}/svm", "w").write("1 1:0.5 3:2\n-1 2:1\n")
    assert rows(L.read_sparse(spark, f"{p}/svm").select("label", "features"))[1][1] == {1: 0.5, 3: 2.0}
    L.write_table(sc, f"{p}/t1", "append")
    L.write_table(sc.limit(1), f"{p}/t2")
    with pytest.raises(ValueError):
        L.merge_tables(spark, [f"{p}/t1", f"{p}/t2"], "seg_id")
    assert L.merge_tables(spark, [f"{p}/t1"], "seg_id").count() == 2


def test_audio_to_frames(spark, tmp_path):
    p = str(tmp_path)
    x = np.sin(np.arange(8000) * 0.3) * 0.5
    for n in ("a", "b"):
        open(f"{p}/{n}.wav", "wb").write(B.encode_wav(x, 8000))
    audio = B.read_audio(spark, p)
    assert rows(audio.select("show", "channel", "sample_rate", F.size("samples"))) == [("a", 0, 8000, 8000), ("b", 0, 8000, 8000)]
    f = X.extract(audio, X.Extraction(snr=30.0))
    assert f.groupBy("show").count().collect()[0]["count"] == 98 and f.where("vad is null").count() == 0
    assert X.extract(audio, X.Extraction(kind="plp")).count() == 196
    assert X.extract(spark.createDataFrame([("z", 0, 8000, None), ("y", 0, 8000, [0.0] * 10)], "show string, channel int, sample_rate int, samples array<float>")).count() == 0
    plan = spark.createDataFrame([("a", "a1", "n", 10.0, None), ("a", "a2", None, None, "r"), ("b", "b1", None, None, None)], "show string, new_show string, noise string, snr double, reverb string")
    aug = X.augment(audio, plan, {"n": np.random.default_rng(0).normal(size=500)}, {"r": np.array([1.0, 0.3])})
    assert rows(aug.select("show", F.size("samples"))) == [("a1", 8000), ("a2", 8000), ("b1", 8000)]
    post = X.post_process(f.select("show", "frame_idx", "cep", "vad"), X.PostProcessing(mask="[0-3]", delta=True, norm="cmvn", keep_all=False))
    assert len(post.first().cep) == 8
    os.makedirs(f"{p}/out")
    done = B.write_files(audio, f"{p}/out", lambda r: B.encode_wav(np.array(r["samples"]), r["sample_rate"]), ".wav")
    assert done.count() == 2 and B.read_audio(spark, f"{p}/out").count() == 2
    os.makedirs(f"{p}/feat")
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    open(f"{p}/feat/q.htk", "wb").write(B.encode_htk(m))
    assert rows(B.read_frames(spark, f"{p}/feat", B.htk_frames))[1] == ("q", 1, [3.0, 4.0, 5.0])


def frames(spark, n=60, shows=2, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"s{k}", i, rng.normal(size=2).tolist(), float(rng.normal()), bool(rng.random() < 0.7)) for k in range(shows) for i in range(n - 13 * k)], "show string, frame_idx long, cep array<double>, energy double, vad boolean")


@pytest.mark.parametrize("chunk", [5, 8192])
def test_chunks_do_not_change_windows(spark, monkeypatch, chunk):
    df = frames(spark)
    want = {f: rows(f(df)) for f in OPERATORS}
    small = lambda d, left, right, c=chunk: FR_HALO(d, left, right, c)
    monkeypatch.setattr(FR, "with_halo", lambda d, left, right, c=None: small(d, left, right))
    for f, w in want.items():
        got = rows(f(df))
        assert len(got) == len(w)
        for a, b in zip(got, w):
            assert repr(a)[:12] == repr(b)[:12] and np.allclose(np.array(a[-1], dtype=float), np.array(b[-1], dtype=float))


FR_HALO = FR.with_halo
OPERATORS = [
    lambda d: FR.delta(d).select("show", "frame_idx", "delta"),
    lambda d: FR.shifted_delta(d, k=3).select("show", "frame_idx", "cep"),
    lambda d: FR.context(d, 3, 2).select("show", "frame_idx", "context"),
    lambda d: FR.rasta(d).select("show", "frame_idx", "cep"),
    lambda d: FR.gaussianise(d, 11).select("show", "frame_idx", "cep"),
    lambda d: FR.sliding_norm(d, 2, 11, reduce=True).select("show", "frame_idx", "cep"),
    lambda d: FR.smooth_labels(d).select("show", "frame_idx", "vad"),
]


def test_rasta_equals_the_kernel_and_traps_have_their_width(spark):
    df = frames(spark, 50, 1)
    x = np.array([r.cep for r in df.orderBy("frame_idx").collect()])
    got = np.array([r.cep for r in FR.rasta(df).orderBy("frame_idx").collect()])
    assert np.allclose(got, K.rasta(x))
    t = FR.traps(df, 3, 3, 4).orderBy("frame_idx").first().traps
    ctx = np.concatenate([x[:1]] * 3 + [x[:4]])
    assert np.allclose(t, ((FR.dct_matrix(7, 4) * np.hamming(7)) @ ctx).T.ravel())
    assert len(FR.dct_context(df, 2, 2).first().cep) == 10


def test_frames_without_speech_or_rows(spark):
    df = frames(spark, 20, 1).withColumn("vad", F.lit(False))
    assert rows(FR.cms(df, speech=F.col("vad")).select("frame_idx", "cep")) == rows(df.select("frame_idx", "cep"))
    assert FR.labels_to_intervals(df).count() == 0
    empty = df.limit(0)
    for f in OPERATORS:
        assert f(empty).count() == 0
    assert FR.vad_energy(frames(spark)).where("vad is null").count() == 0


def test_codecs(spark):
    df = frames(spark, 100, 1)
    x = np.array([r.cep for r in df.orderBy("frame_idx").collect()])
    out = codecs.percentile_round_trip(df, "cep", ["show"], ["frame_idx"]).toPandas().sort_values(["frame_idx", "i"])
    back = out["decoded"].to_numpy().reshape(-1, 2)
    assert np.abs(back - x).max() < (x.max() - x.min()) / 64 and out["code"].between(0, 255).all()
    p = codecs.percentiles(df, "cep", ["show"]).where("i = 0").first()
    s = np.sort(x[:, 0])
    assert (p.p0, p.p25, p.p75, p.p100) == (s[0], s[24], s[74], s[99])
    lin = codecs.linear_code(df, "cep", ["show"], ["frame_idx"]).toPandas().sort_values(["frame_idx", "i"])
    assert np.abs(lin["decoded"].to_numpy().reshape(-1, 2) - x).max() < 1e-3 and lin["code"].abs().max() <= 32767


def test_running_sums(spark):
    data = [(i % 3 if i % 11 else None, (i * 37) % 101, i if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(data, "g int, o int, x int").withColumn("id", F.monotonically_increasing_id())
    got = prefix.running(df, ["o", "id"], {"s": "x"}, ["g"]).collect()
    assert len(got) == 300
    for g in (None, 0, 1, 2):
        own = sorted((r for r in got if r.g == g), key=lambda r: (r.o, r.id))
        assert [r.s for r in own] == np.cumsum([r.x or 0 for r in own]).tolist()
    assert prefix.running(df.limit(0), ["o"], {"s": "x"}).count() == 0


def test_roc_eer_and_costs(spark):
    rng = np.random.default_rng(0)
    tar, non = np.round(rng.normal(1.5, 1, 300), 1), np.round(rng.normal(0, 1, 900), 1)
    data = [(float(v), True) for v in tar] + [(float(v), False) for v in non] + [(None, True), (float("nan"), False), (1.0, None)]
    df = spark.createDataFrame(data, "score double, is_target boolean")
    roc = M.roc_points(df)
    assert roc.where("p_miss = 0 and p_fa = 1").count() >= 1 and roc.where("p_miss = 1 and p_fa = 0").count() == 1
    cost = min(0.3 * (tar <= t).mean() + 0.7 * (non > t).mean() for t in [-99, *tar, *non])
    got = M.min_dcf(roc, 0.3).first().min_dcf
    assert abs(got - cost) < 1e-12 and got < 0.9 * 0.3
    assert abs(M.min_dcf(roc, 0.3, normalize=True).first().min_dcf - cost / 0.3) < 1e-12
    pts = np.array([(r.p_miss, r.p_fa) for r in roc.collect()])
    i, j = pts[pts[:, 0] <= pts[:, 1]], pts[pts[:, 0] >= pts[:, 1]]
    d = (i[:, 1] - i[:, 0])[:, None] + (j[:, 0] - j[:, 1])[None]
    num = i[:, 1][:, None] * j[:, 0][None] - j[:, 1][None] * i[:, 0][:, None]
    want = np.where(d == 0, i[:, 1][:, None], num / np.where(d == 0, 1, d)).min()
    for block in (7, 100_000):
        assert abs(M.eer(M.rocch(roc, block=block)).first().eer - want) < 1e-12
    assert want < 0.4
    y, w = M.pav(np.array([1, 3, 2, 2, 5, 4]))
    assert (np.diff(y) >= 0).all() and y.tolist() == [1, 7 / 3, 7 / 3, 7 / 3, 4.5, 4.5] and w.tolist() == [1, 3, 2]
    curve = M.det_curve(M.rocch(roc), points=10)
    assert curve.where("x is null or y is null").count() == 0 and curve.count() > 0
    pm, pf = M.filter_roc(np.array([0, 0, 0, 0.5, 1]), np.array([1, 0.5, 0.2, 0.2, 0]))
    assert len(pm) < 5 and pm[0] == 0 and pm[-1] == 1
    p = spark.createDataFrame([(0.01,)], "p double").select(M.effective_prior(F.col("p"), 10.0, 1.0).alias("x"), M.probit("p").alias("q")).first()
    assert round(p.x, 4) == 0.0917 and abs(p.q + 2.3263) < 1e-3


def test_merges_report_conflicts(spark):
    a = spark.createDataFrame([("m", "s", True)], "model_id string, seg_id string, is_target boolean")
    b = spark.createDataFrame([("m", "s", False), ("n", "s", False)], "model_id string, seg_id string, is_target boolean")
    with pytest.raises(ValueError):
        T.merge_keys(a, b)
    assert rows(T.merge_keys(a, b, check=False)) == [("m", "s", True), ("n", "s", False)]
    s = spark.createDataFrame([("m", "s", 1.0)], "model_id string, seg_id string, score double")
    with pytest.raises(ValueError):
        T.merge_scores(s, s)
    assert T.parse_mask("[1-3,10]") == [1, 2, 3, 10]
    listing = spark.createDataFrame([("/a/x.wav",)], "path string")
    shows = spark.createDataFrame([("x",), ("y",)], "show string")
    assert rows(T.existing_files(shows, listing, "/a/{}.wav")) == [("x",)]


def test_networks(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(150, 3)) + 2, rng.normal(size=(150, 3)) - 2])
    df = spark.createDataFrame([(f"u{i % 3}", f"u{i % 3}", i // 3, v.tolist(), int(i < 150)) for i, v in enumerate(x)], "show string, seg_id string, frame_idx long, cep array<double>, state int")
    net = N.train_classifier(df, [5], iterations=50)
    out = N.posteriors(df, net).toPandas()
    p = np.array(out["posterior"].tolist())
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == out["state"]).mean() > 0.95
    assert len(N.posteriors(df, net, out="bnf", upto=1).first().bnf) == 5
    st = N.posterior_statistics(N.posteriors(df, net), 2, 3)
    assert abs(sum(sum(r.stat0) for r in st.collect()) - 300) < 1e-6
    m = N.class_mixture(N.posteriors(df, net), 2)
    m.check()
    assert np.allclose(sorted(m.mu[:, 0]), [-2, 2], atol=0.4)
    t = N.random_tdnn(3, 4, width=8, pooled=6)
    frames_ = np.array([r.cep for r in df.where("seg_id = 'u1'").orderBy("frame_idx").collect()])
    for block in (16, 4096):
        e = {r.seg_id: r.v for r in N.embeddings(df, t, upto=2, block=block).collect()}
        assert set(e) == {"u0", "u1", "u2"} and np.allclose(e["u1"], t.embed(frames_, 2))
    assert N.embeddings(df, t, least=101).count() == 0
    lab = spark.createDataFrame([("u0", 1)], "show string, label int")
    b = N.normalised_batches(df, lab, 40).collect()
    assert len(b) == 2 and abs(np.array(b[0].x).reshape(40, 3).std(0) - 1).max() < 1e-9


def test_streams(spark, tmp_path):
    p = str(tmp_path)
    day = dt.datetime(2024, 1, 1)
    data = [(i, f"s{i % 5}", [1.0, float(i % 3)], day + dt.timedelta(minutes=7 * i), float(i % 3)) for i in range(40)]
    schema = "score_id long, seg_id string, v array<double>, ts timestamp, score double"
    spark.createDataFrame(data + data[:3], schema).coalesce(1).write.parquet(f"{p}/in")
    read = lambda: spark.readStream.schema(schema).parquet(f"{p}/in")
    enroll = spark.createDataFrame([("m", [1.0, 0.0])], "model_id string, v array<double>")
    trials = spark.createDataFrame([("m", "s1"), ("m", "s2")], "model_id string, seg_id string")

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = run(S.score_stream(read(), enroll, trials), "t_scores")
    assert len(got) == 16 + 2 and all(abs(r.score - 1 / np.sqrt(1 + [x[4] for x in data if x[3] == r.ts][0] ** 2)) < 1e-9 for r in got)
    assert len(run(S.distinct_trials(read()), "t_distinct")) == 40
    rates = run(S.windowed_rates(read(), 1.0), "t_rates")
    assert rates and all(r.n_accepted <= r.n for r in rates)
    act = run(S.session_activity(read().select(F.col("seg_id").alias("show"), "ts", F.col("score").alias("value"))), "t_act")
    assert all(r.n >= 1 for r in act)
    y = run(S.filter_stream(read().where("score_id < 40").select(F.lit("a").alias("show"), F.col("score_id").alias("frame_idx"), F.col("score").alias("x")).dropDuplicates(["frame_idx"])), "t_filter")
    state, want = 0.0, []
    for i in range(40):
        state = i % 3 + 0.94 * state
        want.append(state)
    assert np.allclose([r.y for r in sorted(y, key=lambda r: r.frame_idx)], want)
    S.append_batches(read(), f"{p}/out", f"{p}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{p}/out").count() == 43


def test_repeated_scores_of_every_source(spark, tmp_path):
    from tessitura.plans import trial_queries as Q

    seg = "tel_zz0000f1_a"
    data = [("x", "a"), ("x", "a"), ("x", "b"), ("y", "b"), ("y", "c"), ("y", "c"), (None, "a"), (None, "a"), (None, "c")]
    df = spark.createDataFrame([(i, src, f"spk_{m}", seg, float(i), True) for i, (src, m) in enumerate(data)], "score_id long, source string, modelset string, segset string, scoremat double, scoremask boolean")
    df.write.parquet(f"{tmp_path}/scores.parquet")
    got = Q.QUERIES["scores_repeated_by_source"](spark, str(tmp_path))
    assert rows(got.select("source", "model_id")) == sorted([("x", "spk_a"), ("y", "spk_c"), (None, "spk_a")], key=repr)


def test_closed_set_ratios_of_every_source(spark, tmp_path):
    from tessitura.plans import trial_queries as Q

    rng, seg = np.random.default_rng(0), "tel_zz0000f1_a"
    sets = {"x": rng.normal(size=4), "y": np.array([90.0, -80.0, -81.0]), "tied": np.array([2.0, 2.0, -60.0]), None: np.array([800.0, 1.0]), "one": np.array([1.0])}
    data = [(f"{i}", src, f"spk_{i}", seg, float(v), True) for src, x in sets.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r[1:], r[0]) for r in data], "source string, modelset string, segset string, scoremat double, scoremask boolean, score_id string")
    df.write.parquet(f"{tmp_path}/scores.parquet")
    got = {(r.source, r.model_id): r.llr for r in Q.QUERIES["closed_set_llr_by_source"](spark, str(tmp_path)).collect()}
    assert len(got) == len(data) and got.pop(("one", "spk_0")) is None
    for (src, model), llr in got.items():
        x, i = sets[src], int(model[4:])
        others = np.delete(x, i)
        assert abs(llr - (np.log(0.5) + x[i] - np.logaddexp.reduce(others) - np.log(0.5 / len(others)))) < 1e-6

"""Sums of vectors, leave-one-out training, trained spatial filters and past-only mixes of the slow stream, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import classify, spd
from wavemill.operators import crossfit, moments, signal, spatial
from wavemill.plans import config, session
from wavemill.sources import synthetic


@pytest.fixture(scope="module")
def data(spark):
    s, eeg, nirs = synthetic.recordings(spark, 2, 1)
    return s.cache(), eeg.cache(), nirs.cache()


def test_vector_sums(spark, monkeypatch):
    monkeypatch.setattr(moments, "HELD", 100)  # hands its sums on after each batch
    rng = np.random.default_rng(2)
    x, key = rng.normal(size=(500, 3)), rng.integers(0, 3, 500)
    rows = [("ab"[k % 2] if k else None, int(k), v.tolist()) for k, v in zip(key, x, strict=True)]
    df = spark.createDataFrame([*rows, ("a", 1, None)], "s string, k int, v array<double>").repartition(5)
    got = {(r.s, r.k): (r.n, r.total) for r in moments.vector_sums(df, ["s", "k"], "v", lambda m: np.hstack([m, m * m])).collect()}
    assert set(got) == {(None, 0), ("b", 1), ("a", 2)}
    for (_, k), (n, total) in got.items():
        own = x[key == k]
        assert n == len(own)
        np.testing.assert_allclose(total, np.hstack([own, own * own]).sum(axis=0))
    sums = moments.vector_sums(df.where("s is not null"), ["k"], "v").select(F.lit("all").alias("g"), "k", "n", "total")
    less = {r.k: (r.n, r.total) for r in moments.totals_without(sums, ["g"], "k").collect()}
    np.testing.assert_allclose(less[1][1], x[key == 2].sum(axis=0))
    assert less[1][0] == (key == 2).sum() and moments.vector_sums(df.limit(0), ["k"], "v").count() == 0


def test_leave_one_out_equals_a_fit_per_fold(spark):
    rng = np.random.default_rng(1)
    n, d = 900, 20
    y, sub = rng.integers(1, 4, n), np.array([f"N{k % 4}" for k in range(n)])
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 5, d) + rng.normal(size=d) * 3
    x[:, :3] += np.eye(3)[y - 1]
    x[:, 7] = 2.0  # a constant
    x[sub == "N1"] *= 1.3
    rows = [(sub[k], int(y[k]), x[k].tolist()) for k in range(n)] + [("N0", 0, x[0].tolist()), (None, 1, x[1].tolist()), ("N9", 2, None)]
    df = spark.createDataFrame(rows, "subject string, label int, feature array<double>").repartition(6)
    got = {r.subject: r for r in crossfit.leave_one_out(df.where("subject is not null or feature is null"), ["N0", "N1", "N2", "N3", "stranger"], 0.3).collect()}
    assert set(got) == {"N0", "N1", "N2", "N3", "stranger"}
    for s, r in got.items():
        m = classify.fit_logistic(x[sub != s], y[sub != s], 0.3)
        np.testing.assert_allclose(r.w, m["w"], atol=1e-6)
        np.testing.assert_allclose(np.array(r.b) - np.mean(r.b), m["b"] - m["b"].mean(), atol=1e-6)
        np.testing.assert_allclose(r.mu, m["mu"], atol=1e-9)
    few = df.where("subject = 'N0' or (subject = 'N1' and label < 3)")
    assert {r.subject for r in crossfit.leave_one_out(few, ["N0", "N1"]).collect()} == {"N1"}  # without N0 a class is missing
    assert crossfit.leave_one_out(df.limit(0), ["N0"]).count() == 0


def brute_filters(covs, y, most):
    """The same rule over plain arrays: shrunk mean covariances, eigenvectors of each class against all, ordered by information."""
    p = covs.shape[-1]
    means = np.stack([spd.shrunk(covs[y == c], 250, "lw").mean(axis=0) for c in (1, 2, 3)])
    share = np.array([(y == c).mean() for c in (1, 2, 3)])
    total = np.einsum("c,cij->ij", share, means)
    values, vectors = np.linalg.eigh(total)
    white = (vectors / np.sqrt(values)) @ vectors.T
    out = []
    for m in means:
        for v in np.linalg.eigh(white @ m @ white)[1].T:
            w = v @ white
            w = w / np.sqrt(w @ total @ w)
            var = np.array([w @ q @ w for q in means])
            gain = -(share * np.log(np.sqrt(var))).sum() - 3 / 16 * (share * (var**2 - 1)).sum() ** 2
            out.append((-round(gain, 12), len(out), w * np.sign(w[np.abs(w).argmax()])))
    chosen = []
    for _, _, w in sorted(out, key=lambda r: r[:2]):
        if len(chosen) < most and all(abs(w @ total @ u) < 0.999 for u in chosen):
            chosen.append(w)
    assert p >= 2
    return np.array(chosen)


def test_trained_filters_leave_the_subject_out(spark):
    rng = np.random.default_rng(3)
    n, p = 360, 4
    y, sub = rng.integers(1, 4, n), np.array([f"N{k % 3}" for k in range(n)])
    a = rng.normal(size=(n, p, 30)) * (1 + np.eye(p)[y - 1][:, :, None] * 2)
    mix = rng.normal(size=(p, p))
    x = np.einsum("ij,njt->nit", mix, a)
    covs = x @ x.swapaxes(1, 2) / 30
    rows = [("raw", sub[k], int(y[k]), covs[k].ravel().tolist()) for k in range(n)] + [("8-12", sub[k], int(y[k]), (2 * covs[k]).ravel().tolist()) for k in range(n)]
    df = spark.createDataFrame(rows, "prep string, subject string, label int, moments array<double>").repartition(5)
    names = ("c3", "cz", "c4", "pz")
    got = {(r.prep, r.subject): r for r in spatial.train(df, names, 250, most=3).collect()}
    assert len(got) == 6
    for (prep, s), r in got.items():
        keep = sub != s
        assert r.n == keep.sum() and list(r.channels) == list(names) and r.reference == "none"
        np.testing.assert_allclose(r.filters, brute_filters(covs[keep] * (1 if prep == "raw" else 2), y[keep], 3), atol=1e-9)
    every = spatial.train(df, names, 250, most=3, everybody=True).where("prep = 'raw'").first()
    assert every.subject is None and every.n == n
    np.testing.assert_allclose(every.filters, brute_filters(covs, y, 3), atol=1e-9)
    # what they are for: the strongest filter's power differs by class
    f = spatial.features(covs, np.array(every.filters), None, False)
    assert np.ptp([f[y == c, 0].mean() for c in (1, 2, 3)]) > 0.5


def test_filter_contract(spark):
    make = lambda *r: spark.createDataFrame([r], spatial.FILTERS)
    good = ("4-30", "N0", ["c3", "c4"], "none", [[1.0, 2.0]], 5)
    assert spatial.checked(make(*good), [(4, 30.0)]).count() == 1
    wrong = {"trained on the input": (good, ["raw"]), "want the channels xx": ((*good[:2], ["c3", "xx"], *good[3:]), [(4, 30)]), "not as wide": ((*good[:4], [[1.0]], 5), [(4, 30)]), "no reference": ((*good[:3], "laplacian", *good[4:]), [(4, 30)])}
    for said, (row, preps) in wrong.items():
        with pytest.raises(Exception, match=said):
            spatial.checked(make(*row), preps).collect()
    with pytest.raises(ValueError, match="lack filters"):
        spatial.checked(make(*good).drop("filters"), ["raw"])


def test_filter_features_are_those_of_the_signal():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 3, 250)) + 50
    x[0] = 7.0  # no power at all
    c = x - x.mean(axis=2, keepdims=True)
    w = rng.normal(size=(2, 3))
    got = spatial.features(c @ c.swapaxes(1, 2) / 250, w, [(0, 2)])
    assert np.isfinite(got).all() and got[0, -1] == 0
    power = c.var(axis=2)[1:]
    want = np.column_stack([np.log(np.einsum("fi,nit->nft", w, c[1:]).var(axis=2)), np.log(power), np.tanh((np.log(power[:, 0]) - np.log(power[:, 2])) / 2)])
    np.testing.assert_allclose(got[1:], want, rtol=1e-9)


def test_front_end_inputs_of_filters():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 3)) + 1e5
    fe = signal.FrontEnd([(8.0, 13.0)], 2, 0.5, 250.0, ("raw", (4, 30)))
    ends, covs = fe.push(x)
    assert covs.shape == (len(ends), 3, 3, 3)
    for e, c in zip(ends, covs[:, 1], strict=True):
        np.testing.assert_allclose(c, np.cov(x[e - 250 : e].T, bias=True), rtol=1e-6, atol=1e-9)
    other = signal.FrontEnd([(8.0, 13.0)], 2, 0.5, 250.0, ("raw", (4, 30)))
    first, a = other.push(x[:333])
    again = signal.FrontEnd([(8.0, 13.0)], 2, 0.5, 250.0, ("raw", (4, 30))).thaw(*other.frozen())
    second, b = again.push(x[333:])
    assert first + second == ends
    np.testing.assert_allclose(np.concatenate([a, b]), covs, rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("kind", ["csponly", "ts"])
def test_plan_with_trained_filters(data, kind):
    s, eeg, nirs = data
    cfg = config.build(override={"eeg": {"features": kind, "bands": ((8, 13),), "channels": ("c3", "cz", "c4"), "csp": {"enabled": True, "preps": ("raw", (8, 13)), "n": 4, "stride": 2}}, "nirs": {"enabled": False}, "smoothing": {"tau_s": 0.0}})
    windows = session.eeg_windows(eeg, cfg["eeg"], 250.0)
    f = session.trained_filters(windows, s, cfg["eeg"]).cache()
    assert {(r.prep, r.subject) for r in f.collect()} == {(p, f"N0{k}") for p in ("raw", "8-13") for k in (0, 1)}
    w = session.with_filter_features(windows, s, cfg["eeg"], f)
    assert w.select(F.size("extra")).distinct().collect() == [(2 * (4 + 11 + 4),)]
    got = session.run(s, eeg, nirs, cfg).select("session_id", "end_sample", "y", "ls").toPandas().sort_values(["session_id", "end_sample"])
    given = session.run(s, eeg, nirs, cfg, filters=f).select("session_id", "end_sample", "y", "ls").toPandas().sort_values(["session_id", "end_sample"])
    assert len(got) > 50
    np.testing.assert_allclose(np.stack(got["ls"]), np.stack(given["ls"]), atol=1e-6)
    with pytest.raises(Exception, match="other channels"):
        session.run(s, eeg, nirs, cfg, filters=f.withColumn("reference", F.lit("car"))).collect()


def test_mdm_by_riemannian_distance(data):
    s, eeg, nirs = data
    base = {"eeg": {"features": "mdm", "bands": ((8, 13), (13, 30)), "channels": ("c3", "cz", "c4")}, "nirs": {"enabled": False}, "smoothing": {"tau_s": 0.0}}
    out = {}
    for metric, mean in (("riemann", "logeuclid"), ("logeuclid", "logeuclid"), ("riemann", "riemann")):
        cfg = config.build(override={**base, "eeg": {**base["eeg"], "mdm_metric": metric, "mean": mean}})
        out[metric, mean] = np.stack(session.run(s, eeg, nirs, cfg).toPandas().sort_values(["session_id", "end_sample"])["ls"])
    a, b, c = out.values()
    assert a.shape == b.shape == c.shape and not np.allclose(a, b) and not np.allclose(a, c)
    assert (a.argmax(axis=1) == b.argmax(axis=1)).mean() > 0.7 and (a.argmax(axis=1) == c.argmax(axis=1)).mean() > 0.8


SLOW = {"lags_s": (0, 2), "use_level": True}


@pytest.mark.parametrize("over", [{"signal": "cbsi"}, {"signal": "hb", "gsr": True}, {"signal": "cbsi", "gsr": True, "spatial": "regions", "lateral": False}])
def test_past_only_mixes(data, over):
    """Coefficients of each fit equal a plain loop over the samples delivered by the end of its block."""
    s, eeg, nirs = data
    cfg = config.build(override={"nirs": {**SLOW, **over}})["nirs"]
    assert signal.refits(cfg)
    ends = session.block_ends(eeg)
    got = {(r.session_id, r.fit): r for r in signal.slow_coefficients(signal.filtered_slow(nirs, s, cfg), ends).collect()}
    stop = {(r.session_id, r.fit): r.end for r in ends.collect()}
    assert set(got) == set(stop)
    for sid in {k for k, _ in stop}:
        g = nirs.where(F.col("session_id") == sid).toPandas().sort_values("seq")
        y, base = signal.slow_signals(np.stack(g["hbo"]), np.stack(g["hbr"]), cfg, 12.5)
        assert y.shape[1] == 38
        for fit in (1, 2, 3):
            x = y[g["frame"].to_numpy() <= stop[sid, fit]]
            common = np.repeat(x[:, 36:], 18, axis=1)
            beta = [np.polyfit(common[:, c], x[:, c], 1)[0] for c in range(36)]
            ratio = x[:, :18].std(axis=0) / x[:, 18:36].std(axis=0)
            np.testing.assert_allclose(got[sid, fit].ratio, ratio, rtol=1e-7)
            np.testing.assert_allclose(got[sid, fit].beta, beta, rtol=1e-6, atol=1e-9)
            mix = signal.slow_mix(cfg, 18, np.array(got[sid, fit].ratio), np.array(got[sid, fit].beta))
            n = np.array([20, 60, len(y)])
            want = signal.trailing(y @ mix.T, base @ mix.T, n, cfg, 12.5)  # features are linear: mixing signals first is the same
            np.testing.assert_allclose(signal.mixed_features(signal.trailing(y, base, n, cfg, 12.5), mix), want, atol=1e-9)


@pytest.mark.parametrize("over", [{"signal": "cbsi"}, {"gsr": True}, {"features": "mvp"}, {"features": "mvp", "gsr": True}])
def test_plan_with_mixes_of_the_past(data, over):
    s, eeg, nirs = data
    cfg = config.build(override={"eeg": {"features": "logpower", "bands": ((8, 13),), "channels": ("c3", "c4"), "bad_channels": False}, "nirs": {**SLOW, **over}, "smoothing": {"tau_s": 0.0}})
    got = session.run(s, eeg, nirs, cfg)
    a = {(r.session_id, r.end_sample): r for r in got.collect()}
    assert all(r.ln is not None for r in a.values())
    cut = eeg.agg((F.max("sample") * 0.7).cast("long")).first()[0]
    noise = lambda c: F.when(F.col("frame") >= cut, F.transform(c, lambda v: v + F.sin(v * 7919.0))).otherwise(F.col(c))
    b = {(r.session_id, r.end_sample): r for r in session.run(s, eeg, nirs.withColumn("hbo", noise("hbo")), cfg).collect()}
    assert all(np.allclose(a[k].ln, b[k].ln, atol=1e-7) for k in a if k[1] < cut) and any(not np.allclose(a[k].ln, b[k].ln) for k in a)


def test_short_and_long_means():
    rng = np.random.default_rng(6)
    y = rng.normal(size=(400, 2))
    cfg = {"features": "mvp", "mvp_short": 2.0, "mvp_long": 20.0, "mvp_lag": 4.0}
    got = signal.trailing(y, y, np.array([0, 3, 30, 400]), cfg, 10.0)
    mean = lambda a, b: y[max(a, 0) : max(b, 0)].mean(axis=0) if b > max(a, 0) else np.zeros(2)
    for r, n in zip(got, (0, 3, 30, 400), strict=True):
        now = mean(n - 20, n)
        np.testing.assert_allclose(r, np.concatenate([now - mean(n - 200, n), now - mean(n - 60, n - 40)]), atol=1e-9)


def test_log_power_of_many_bands(spark):
    m = np.random.default_rng(7).uniform(1, 2, size=(3, 20, 2, 2))
    df = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(m)] + [(9, [])], "k int, spd array<double>")
    got = {r.k: r.feature for r in signal.log_power(df, 2).collect()}
    assert got[9] == []
    for k, v in enumerate(m):
        np.testing.assert_allclose(got[k], np.log(np.einsum("bii->bi", v) + 1e-12).ravel())


def test_unknown_settings_are_errors():
    for over, kind in (({"eeg": {"banda": 1}}, KeyError), ({"nirs": {"signal": "hbx"}}, ValueError), ({"eeg": {"csp": {"file": "x"}}}, KeyError), ({"priors": [1, 1, 1]}, KeyError), ({"eeg": {"features": "csponly"}}, ValueError)):
        with pytest.raises(kind):
            config.build(override=over)
    assert config.build(override={"fusion": {"bias": {"hyb": [0, 0, 0]}}})["fusion"]["bias"]["hyb"] == (0, 0, 0)


def test_riemannian_means_and_nearest_class(spark):
    from wavemill.operators import riemann

    rng = np.random.default_rng(8)
    a = rng.normal(size=(90, 3, 12)) * np.array([1, 2, 0.5])[:, None]
    m = a @ a.swapaxes(1, 2) / 12 + 0.1 * np.eye(3)
    key = np.arange(90) % 3
    df = spark.createDataFrame([(int(key[k]), m[k].ravel().tolist()) for k in range(90)] + [(1, None)], "label int, m array<double>").repartition(4)
    got = riemann.means(df, ["label"], "m", 3).collect()
    assert {r.label: r.n for r in got} == {0: 30, 1: 30, 2: 30}
    for r in got:
        np.testing.assert_allclose(np.reshape(r.centre, (3, 3)), spd.karcher_mean(m[key == r.label]), rtol=1e-6)
        assert r.step < 1e-6
    whole = riemann.means(df, [], "m", 3).first()
    np.testing.assert_allclose(np.reshape(whole.centre, (3, 3)), spd.karcher_mean(m), rtol=1e-6)
    centres = riemann.means(df, ["label"], "m", 3)
    d2 = {tuple(r.m): r.d2 for r in riemann.distances(df.where("m is not null"), centres, "label", "m", 3).collect()}
    for k in range(90):
        np.testing.assert_allclose(d2[tuple(m[k].ravel())], [spd.distance2(m[k], np.reshape(r.centre, (3, 3))) for r in sorted(got)], rtol=1e-6)


def test_kernel_queries_equal_plain_arrays(spark, tmp_path):
    """lr_left_out, csp_features and mdm_riemann over a table, against numpy over all its rows."""
    from wavemill.plans import catalog

    rng = np.random.default_rng(9)
    n = 150
    x = rng.normal(size=(n, 64)).astype(np.float32)
    label = rng.integers(0, 10, n)
    x[:, ::4] *= (1 + label % 3)[:, None]
    order = rng.permutation(n).tolist()
    spark.createDataFrame([(k, int(label[k]), x[k].tolist()) for k in order], "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    y, sub, z = label % 3 + 1, np.arange(n) % 5, x.astype(float)
    m = z.reshape(n, 16, 4)
    c = np.einsum("nti,ntj->nij", m, m) / 16
    q = catalog.QUERIES
    for r in q["lr_left_out"](spark, str(tmp_path)).collect():
        own = sub != r.vec_id % 5
        if r.vec_id < 10:
            model = classify.fit_logistic(z[own], y[own], 1.0)
            assert r.y == classify.linear_log_prob(model, z[[r.vec_id]]).argmax() + 1 and r.truth == y[r.vec_id]
    safe = spd.ridge(c, 1e-3)
    got = {r.vec_id: r.feature for r in q["csp_features"](spark, str(tmp_path)).where("subject = concat('N', vec_id % 5)").collect()}
    for k in range(5):
        w = brute_filters_of(safe[sub != k], y[sub != k], 3)
        np.testing.assert_allclose(np.array([got[i] for i in range(k, n, 5)]), spatial.features(safe[sub == k], w, [(0, 1), (2, 3)]), rtol=1e-7, atol=1e-9)
    e = spd.estimate(c, 16)
    centres = [spd.karcher_mean(e[y == k]) for k in (1, 2, 3)]
    d2 = np.stack([spd.distance2(e, k) for k in centres], axis=1)
    for r in q["mdm_riemann"](spark, str(tmp_path)).collect():
        np.testing.assert_allclose(r.d2, d2[r.vec_id], rtol=1e-5)
        assert r.y == d2[r.vec_id].argmin() + 1


def brute_filters_of(covs, y, most):
    """brute_filters for windows of 16 samples."""
    means = np.stack([spd.shrunk(covs[y == c], 16, "lw").mean(axis=0) for c in (1, 2, 3)])
    return spatial.separating(means, np.array([(y == c).sum() for c in (1, 2, 3)], dtype=float), most)


def test_p_values(spark):
    import math

    from wavemill.operators import stats

    def integral(a, b, x):
        """The incomplete beta by Gauss and Legendre over the angle."""
        t = np.linspace(0, math.asin(math.sqrt(x)), 401)
        node, weight = np.polynomial.legendre.leggauss(20)
        half = np.diff(t)[:, None] / 2
        u = (t[1:] + t[:-1])[:, None] / 2 + half * node
        log_b = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
        return float((2 * np.exp((2 * a - 1) * np.log(np.sin(u)) + (2 * b - 1) * np.log(np.cos(u)) - log_b) * weight * half).sum())

    rows = [(a, b, x) for a in (0.5, 1.0, 3.7, 50.0, 900.0) for b in (0.5, 2.0, 40.0) for x in (1e-6, 0.01, 0.3, 0.9, 0.999)]
    got = spark.createDataFrame([*rows, (2.0, 3.0, 0.0), (2.0, 3.0, 1.0)], "a double, b double, x double")
    for r in got.select("*", stats.incomplete_beta(F.col("a"), F.col("b"), F.col("x")).alias("v")).collect():
        assert r.v == pytest.approx(r.x if r.x in (0, 1) else integral(r.a, r.b, r.x), abs=1e-9)
    c = spark.createDataFrame([(0.5, 20), (-0.5, 20), (1.0, 5), (0.1, 2), (0.0, 9)], "r double, n long").select(stats.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert c[0].p == c[1].p == pytest.approx(0.02477, abs=1e-5) and c[2].p == 0 and c[3].p is None and c[4].p == pytest.approx(1)
    t = spark.createDataFrame([(2.0, 10.0)], "t double, d double").select(stats.student_two_sided(F.col("t"), F.col("d")).alias("p")).first()
    assert t.p == pytest.approx(0.07339, abs=1e-5)
    w = spark.createDataFrame([(5, 6), (0, 5), (100, 30), (3000, 120)], "w long, n long").select(stats.signed_rank_p(F.col("w"), F.col("n")).alias("p")).collect()
    assert w[1].p == 2 / 32 and w[0].p == pytest.approx(2 * 10 / 64) and 0 < w[2].p < 0.01 and 0.0 < w[3].p < 0.2

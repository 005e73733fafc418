import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavemill.operators import scoring, signal
from wavemill.plans import config, session
from wavemill.sources import files, synthetic
from wavemill.streaming import processor


#: Recordings of these tests are too short for slow smoothing and many bands.
PLAN = config.build(override={"eeg": {"bands": ((8, 13), (13, 30)), "cov_avg_n": 5}, "nirs": {"lags_s": (0, 2), "use_level": False}, "smoothing": {"tau_s": 0.0}})


@pytest.fixture(scope="module")
def data(spark):
    s, eeg, nirs = synthetic.recordings(spark)
    return s.cache(), eeg.cache(), nirs.cache()


@pytest.fixture(scope="module")
def answers(data):
    return session.run(*data, PLAN).cache()


def test_learns_and_scores(data, answers):
    per = session.scored(answers, data[0]).collect()
    assert len(per) == 4 and np.mean([r.macro_recall for r in per]) > 0.55
    assert answers.where("block = 1").count() == 0 and answers.where("y_nirs is null").count() == 0
    assert session.summary(session.scored(answers, data[0])).count() == 1


def key(df, *cols):
    return {(r.session_id, r.end_sample): tuple(r[c] for c in cols) for r in df.collect()}


def test_causality(data, answers):
    s, eeg, nirs = data
    cut = eeg.agg((F.max("sample") * 0.6).cast("long")).first()[0]
    noise = F.transform("x", lambda v: v + 50 * F.sin(v * 7919.0))
    changed = eeg.withColumn("x", F.when(F.col("sample") >= cut, noise).otherwise(F.col("x")))
    a, b = key(answers, "y_eeg"), key(session.run(s, changed, nirs, PLAN), "y_eeg")
    assert all(a[k] == b[k] for k in a if k[1] <= cut) and any(a[k] != b[k] for k in a if k[1] > cut)


def test_label_isolation(data, answers):
    s, eeg, nirs = data
    last = eeg.agg(F.max("block")).first()[0]
    swap = F.when((F.col("block") == last - 1) & F.col("state").isin(2, 3), 5 - F.col("state")).otherwise(F.col("state"))
    a, b = key(answers, "y_eeg", "block"), key(session.run(s, eeg.withColumn("state", swap), nirs, PLAN), "y_eeg", "block")
    assert all(a[k] == b[k] for k in a if a[k][1] < last) and any(a[k] != b[k] for k in a if a[k][1] == last)


def test_sessions_without_the_slow_stream(spark):
    s, eeg, nirs = synthetic.recordings(spark, 1, 1, fs_nirs=None)
    got = session.run(s, eeg, nirs, config.build(preset="b1fix"))
    assert got.count() > 0 and got.where("y_nirs is not null").count() == 0


@pytest.mark.parametrize("preset", ["b2_original", "b1fix", "conf_frontocc", "conf_heog"])
def test_presets(data, preset):
    s, eeg, nirs = data
    keep = "session_id like 's000%'"
    got = session.run(s.where(keep), eeg.where(keep), nirs.where(keep), config.build(preset=preset, override={"smoothing": {"tau_s": 0.0}}))
    r = scoring.metrics(got.where("block = 3"), [], "y_eeg", "true_y").first()
    assert r.n > 20 and (r.macro_recall > 0.4 or preset.startswith("conf"))


def test_final_configuration(data):
    """Cross-subject models, both session models, biases from left-out blocks: answers follow from the parts by hand."""
    s, eeg, nirs = data
    cfg = config.build(preset="final", override={"bias": {"min_blocks": 2, "fixed": [0.0, 0.1, 0.0]}, "smoothing": {"tau_s": 1.0}})
    assert cfg["global"]["enabled"] and cfg["bias"]["mode"] == "session" and cfg["eeg"]["logit_T"] == 1
    got = session.run(s, eeg, nirs, cfg).toPandas().sort_values(["session_id", "end_sample"])
    per = scoring.metrics(s.sparkSession.createDataFrame(got[["session_id", "true_y", "y"]]), ["session_id"], "y", "true_y").collect()
    assert np.mean([r.macro_recall for r in per]) > 0.55
    soft = lambda z: z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    for _, g in got.groupby("session_id"):
        ls, lg, ln = (np.stack(g[c]) for c in ("ls", "lg", "ln"))
        w = 1 / (1 + (g["block"].to_numpy() - 1))[:, None]
        want, a = soft((1 - w) * ls + w * lg), np.exp(-1 / 4)
        for part in (want, ln):
            for i in range(1, len(part)):
                part[i] = a * part[i - 1] + (1 - a) * part[i]
        # ln in the result is smoothed already; le is smoothed here from its parts
        np.testing.assert_allclose(np.stack(g["le"]), soft(want), atol=1e-8)
        np.testing.assert_allclose(np.stack(g["probs"]), soft(0.8 * np.stack(g["le"]) + 0.2 * np.stack(g["ln"])), atol=1e-8)
    early = got[got["block"] == 2]  # one block of evidence: only the fixed bias
    assert (early["y_eeg"].to_numpy() == (np.stack(early["le"]) + [0.0, 0.1, 0.0]).argmax(axis=1) + 1).all()


def test_cross_subject_models_leave_the_subject_out(data):
    s, eeg, nirs = data
    cfg = config.build(preset="final", override={"nirs": {"enabled": False}, "bias": {"mode": "none"}})
    cfg["eeg"]["channels"] = ("c3", "cz", "c4")
    windows = session.eeg_windows(eeg, cfg["eeg"], 250.0)
    models = {r.session_id: r.w for r in session.session_models(windows, s, cfg).collect()}
    assert len(models) == 4 and models["s000_N00"] == models["s001_N00"] != models["s002_N01"]
    changed = windows.withColumn("label", F.when(F.col("session_id").endswith("N00"), 4 - F.col("label")).otherwise(F.col("label")))
    again = {r.session_id: r.w for r in session.session_models(changed, s, cfg).collect()}
    assert np.allclose(again["s000_N00"], models["s000_N00"]) and not np.allclose(again["s002_N01"], models["s002_N01"])


def test_trailing_slow_features():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(60, 3))
    cfg = {"lags_s": (0, 2), "use_level": True, "use_slope": True, "level_s": 2.0, "slope_s": 4.0}
    base = np.cumsum(y, axis=0) / np.arange(1, 61)[:, None]
    n = np.array([0, 1, 2, 5, 30, 60])
    got = signal.trailing(y, base, n, cfg, 3.0)
    for r, k in enumerate(n):
        want = []
        for lag in (0, 6):
            end = max(0, k - lag)
            part, long = y[max(0, end - 6) : end], y[max(0, end - 12) : end]
            want += [(part.sum(axis=0) / max(1, len(part))) - (base[end - 1] if end else 0), np.polyfit(np.arange(len(long)) / 3.0, long, 1)[0] if len(long) > 2 else np.zeros(3)]
        np.testing.assert_allclose(got[r], np.concatenate(want), atol=1e-9)


def test_train_skip(data):
    cfg = config.build(override={"eeg": {"train_skip_s": 1.0}})["eeg"]
    one = data[1].where("session_id like 's000%' and sample < 4000")
    w = session.eeg_windows(one, cfg, 250.0).where("homogeneous").select("start_sample", "trained").collect()
    state = [r.state for r in one.orderBy("sample").select("state").collect()]
    for r in w:
        first = r.start_sample
        while first and state[first - 1] == state[r.start_sample]:
            first -= 1
        assert r.trained == (r.start_sample >= first + 250)
    assert any(r.trained for r in w) and not all(r.trained for r in w)


def test_experiments(data):
    s, eeg, nirs = data
    keep = s.where("session_id like 's00%'").select("session_id").limit(2)
    small = [t.join(keep, "session_id", "left_semi") for t in (s, eeg, nirs)]
    configs = {n: config.build(preset="b1fix", override={"nirs": {"enabled": False}, "smoothing": {"tau_s": t}}) for n, t in (("a", 0.0), ("b", 2.0))}
    done = s.sparkSession.createDataFrame([("b", small[0].first().session_id)], "config string, session_id string")
    got = session.experiments(*small, configs, done).select("config", "session_id", "score").collect()
    assert sorted(r.config for r in got) == ["a", "a", "b"] and all(r.score > 0 for r in got)
    assert {r.config for r in session.summary(session.experiments(*small, {"a": configs["a"]})).collect()} == {"a"}


def test_eye_movement(data):
    one = data[1].where("session_id like 's000%' and sample < 1000")
    got = signal.eye_movement(one).agg(F.count("eye_h").alias("n"), F.avg(F.isnan("eye_v").cast("int")).alias("bad")).first()
    assert got.n == 1000 and got.bad == 0


def test_left_out_subject_models(data):
    cfg = config.build(override={"eeg": {"bands": ((8, 13), (13, 30))}})["eeg"]
    w = session.eeg_windows(data[1], cfg, 250.0)
    f = session.eeg_features(w, cfg).where("fit = 3 and role = 'train'")
    m = session.left_out_subject(f, data[0], "slda")
    assert m.count() == 2
    one = session.left_out_subject(f.where("session_id like '%N00'"), data[0].where("subject = 'N00'"), "slda")
    assert one.count() == 0  # nobody else to learn from


def test_front_end_chunks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 4)) + 1e6
    fe = signal.FrontEnd([(8.0, 13.0)], 2, 0.5, 250.0)
    ends, covs = fe.push(x)
    assert ends[:2] == [250, 312]
    for size in (1, 62, 333):
        f = signal.FrontEnd([(8.0, 13.0)], 2, 0.5, 250.0)
        got = [f.push(x[a : a + size]) for a in range(0, 900, size)]
        assert [e for g, _ in got for e in g] == ends
        np.testing.assert_allclose(np.concatenate([c for _, c in got]), covs, rtol=1e-6, atol=1e-9)


def test_spatial_matrix():
    m, kept = signal.spatial_matrix(("c3", "c4"), "car_clean", ("c4",))
    assert kept == ["c3"] and m.sum() == pytest.approx(0)
    m, kept = signal.spatial_matrix(("c3", "c4"), "laplacian", ("c4",), interpolate=True)
    assert kept == ["c3", "c4"] and m[0].sum() == pytest.approx(0)


@pytest.mark.parametrize("parts", [2, 5])
def test_stream_equals_batch(spark, data, tmp_path, parts):
    one = data[1].where("session_id like 's000%' and sample < 3000")
    cfg = config.build()["eeg"]
    batch = signal.grid_covariances(one, cfg, 250.0).orderBy("end_sample").collect()
    src = str(tmp_path / "in")
    for k in range(parts):
        one.where(f"sample >= {k * 3000 // parts} and sample < {(k + 1) * 3000 // parts}").coalesce(1).write.mode("append").parquet(src)
    q = processor.grid_windows(spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(src), cfg).writeStream.format("memory").queryName(f"w{parts}").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table(f"w{parts}").orderBy("end_sample").collect()
    assert [(r.end_sample, r.label, r.homogeneous) for r in got] == [(r.end_sample, r.label, r.homogeneous) for r in batch]


def test_stream_answers_equal_batch(spark, data, tmp_path):
    """Predictions and refits online are those of the batch plan, though samples come out of order and twice."""
    s, eeg, nirs = data
    one = eeg.where("session_id like 's000%'").cache()
    cfg = config.build(override={"eeg": {"bands": ((8, 13),), "channels": ("c3", "cz", "c4", "pz"), "cov_avg_n": 3, "features": "ts+mdm", "bad_channels": False}, "nirs": {"enabled": False}, "bias": {"mode": "session", "min_blocks": 2}})
    batch = session.run(s.where("session_id like 's000%'"), one, nirs, cfg).orderBy("end_sample").collect()
    src, n = str(tmp_path / "in"), one.count()
    for a, b in ((0, n // 3), (n // 2, n), (0, 100), (n // 3, n // 2)):
        one.where(f"sample >= {a} and sample < {b}").coalesce(1).write.mode("append").parquet(src)
    q = processor.answers(spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(src), cfg).writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("online").orderBy("k").collect()
    assert len(got) == len(batch) > 50 and {r.fit for r in got} == {1, 2}
    np.testing.assert_allclose([r.ls for r in got], [r.ls for r in batch], atol=1e-6)
    assert all((r.b_eeg is None) == (r.fit < 2) for r in got)


def test_event_streams(spark, tmp_path):
    rows = [(k, f"2026-01-01 00:{k:02d}:00", k % 2, "ab"[k % 2], float(k)) for k in range(0, 40, 2)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "ev")
    df.coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(df.schema).parquet(src)
    for f, name in ((processor.trailing_counts, "counts"), (processor.sessions, "sess")):
        q = f(read()).writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    c = spark.table("counts").where("window.start = timestamp'2026-01-01 00:10:00'").first()
    assert c.n == 3 and c["mean"] == 12.0


def test_gaps_are_errors_in_the_end():
    class Kept:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

        put = update

    class Handle:
        def getValueState(self, *a):  # noqa: N802
            return Kept()

        getListState = getValueState  # noqa: N815

    p = processor.GridWindows([(8.0, 13.0)], 2, 0.5, 250.0)
    p.most_early = 10
    p.init(Handle())
    rows = lambda a, b: iter([pd.DataFrame({"sample": range(a, b), "x": [[float(k)] * 2 for k in range(a, b)], "state": 1, "block": 1})])
    list(p.handleInputRows(("s",), rows(0, 5), None))
    list(p.handleInputRows(("s",), rows(6, 10), None))
    with pytest.raises(ValueError, match="session s: sample 5 is missing"):
        list(p.handleInputRows(("s",), rows(10, 30), None))


def test_files(spark, tmp_path, answers):
    p = str(tmp_path / "pred")
    files.write_predictions(answers.select("session_id", "end_sample", "start_sample", "true_y", "y", "y_eeg", "y_nirs"), p)
    assert files.listed(spark, p, "*.csv").count() > 0
    d = tmp_path / "dumps"
    d.mkdir()
    cols = "end," + ",".join(f"{a}{k}" for a in ("ls", "lg", "le", "ln", "lh") for k in (1, 2, 3)) + ",y,y_eeg,y_nirs"
    (d / "s1.csv").write_text("\n".join([cols, "5," + ",".join(["nan"] * 15) + ",1,1,-1", "5," + ",".join(["0.5"] * 15) + ",2,1,-1"]))
    got = files.dumps(spark, str(d)).collect()
    assert len(got) == 1 and got[0].y == 2 and got[0].session_id == "s1"
    m = spark.createDataFrame([("g", "s", 1, [0.0], [1.0], [[1.0]], [0.0], {"c": "1"})], "name string, session_id string, fit int, mu array<double>, sd array<double>, w array<array<double>>, b array<double>, meta map<string,string>")
    files.save_models(m, str(tmp_path / "m"))
    assert files.load_models(spark, str(tmp_path / "m"), "g", {"c": "1"}).count() == 1
    with pytest.raises(Exception, match="model made with"):
        files.load_models(spark, str(tmp_path / "m"), "g", {"c": "2"}).collect()
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [files.cached(spark, str(tmp_path / "c"), {"a": "1"}, make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    assert files.undone(spark.range(5), spark.range(2), ["id"]).count() == 3
    assert files.markdown(spark.range(2)).count("\n") == 3


def test_configuration():
    assert config.build(preset="b2_original")["eeg"]["features"] == "csp" and config.build()["eeg"]["features"] == "ts"
    art = {"eeg": {"cov_eps": 9, "channels": "sensorimotor9"}, "_comment": "a remark"}
    assert config.build(art)["eeg"]["cov_eps"] == 9 and len(config.build(art)["eeg"]["channels"]) == 9 and "_comment" not in config.build(art)
    assert config.build(art, use_artefact=False)["eeg"]["cov_eps"] != 9
    other = {"eeg": {"C": 3.0}}  # an override stands for itself unless told otherwise
    assert config.build(art, override=other)["eeg"]["cov_eps"] != 9 and config.build(art, override=other, use_artefact=True)["eeg"]["cov_eps"] == 9
    assert config.build(override={"preset": "conf_fes", "eeg": {"bands": [[1, 2]]}})["eeg"]["bands"] == ([1, 2],)
    assert config.DEFAULTS["eeg"]["cov_eps"] == 1e-4 and config.build(override={"eeg": {"channels": ["C3"]}})["eeg"]["channels"] == ("c3",)
    assert set(config.grid([{}, {}])) == {"0", "1"} and set(config.grid({"a": {"eeg": {}}})) == {"a"}
    with pytest.raises(KeyError):
        config.build(preset="none such")


def test_capped_sum(spark):
    assert scoring.capped_sum(spark.createDataFrame([(15.0,), (9.0,)], "p double"), "p", 20.0).first().p == 20.0

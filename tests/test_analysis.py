import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import sequence
from wavemill.plans import analysis, config, session
from wavemill.sources import synthetic


@pytest.fixture(scope="module")
def data(spark):
    s, eeg, nirs = synthetic.recordings(spark, 2, 1)
    return s.cache(), eeg.cache(), nirs.cache()


@pytest.fixture(scope="module")
def answers(data):
    # Recordings of these tests are too short for slow smoothing and many bands.
    plan = config.build(override={"eeg": {"bands": ((8, 13), (13, 30)), "cov_avg_n": 5}, "nirs": {"lags_s": (0, 2), "use_level": False}, "smoothing": {"tau_s": 0.0}})
    return session.run(*data, plan).cache()


@pytest.fixture(scope="module")
def segs(data):
    return sequence.segments(data[1], ["session_id"], ["sample"], "state").cache()


def test_bins_and_blocks(answers, segs):
    assert {r.block for r in analysis.by_block(answers).collect()} == {2, 3}
    n = analysis.by_time(answers, segs).agg(F.sum("n")).first()[0]
    assert 0 < n <= answers.count()


def test_aucs(spark, answers):
    got = analysis.two_aucs(answers, ["session_id"]).collect()
    assert len(got) == 2 and all(r.auc_move > 0.8 for r in got) and np.mean([r.auc_side for r in got]) > 0.5
    bad = answers.withColumn("probs", F.transform("probs", lambda x: F.when(F.col("end_sample") % 2 == 0, float("nan")).otherwise(x)))
    assert all(r.auc_move is None for r in analysis.two_aucs(bad, ["session_id"]).collect())
    f = spark.createDataFrame([("s", [float(i), 1.0], i > 5) for i in range(10)], "session_id string, feature array<double>, p boolean")
    assert {r.i: r.auc for r in analysis.feature_aucs(f, ["session_id"], F.col("p")).collect()} == {0: 1.0, 1: 0.5}


def test_left_out_bias(spark):
    rng = np.random.default_rng(0)
    rows = [("s", 1 + i // 30, True, 1 + i % 3, [float(v) for v in rng.normal(size=3) + 2 * np.eye(3)[i % 3]]) for i in range(90)]
    f = spark.createDataFrame(rows, "session_id string, block int, homogeneous boolean, label int, feature array<double>")
    bias = analysis.left_out_bias(f, 1)
    assert bias[0] == 0 and all(abs(b) <= 1.5 for b in bias)


def test_strength_and_strata(data, answers, segs):
    db = analysis.artefact_strength(data[1], segs, "c4", (8.0, 12.0))
    m = {r.label: r.m for r in db.groupBy("label").agg(F.avg("db").alias("m")).collect()}
    assert m[2] < -3 < m[3]  # the rhythm over c4 falls in class 2 only
    assert analysis.stratified(answers, db).agg(F.sum("n")).first()[0] >= 2


def test_spectra(data):
    r = analysis.class_ratios(analysis.spectra(data[1], ("c3", "c4")))
    at = {(x.channel, x.label): x.ratio for x in r.where("freq = 10.5").collect()}
    assert at["c4", 2] < 0.6 * at["c4", 3] and at["c3", 3] < 0.6 * at["c3", 2]
    assert analysis.spectral_peaks(r, 3).count() == 12


def test_slow_stream(data):
    g = analysis.grand_average(data[2], 10, 40)
    late = {(r.label, r.region): r.m for r in g.where("offset >= 25").groupBy("label", "region").agg(F.avg("mean").alias("m")).collect()}
    assert late[2, "right"] > late[2, "left"] and late[3, "left"] > late[3, "right"]
    assert all(r.r < -0.99 and r.sd_ratio == pytest.approx(2.5) for r in analysis.sign_check(data[2]).collect())


def test_comparisons(spark):
    a = spark.createDataFrame([(f"s{i}", f"u{i // 2}", float(i)) for i in range(12)], "session_id string, subject string, score double")
    b = a.withColumn("score", F.col("score") - 1 - F.col("score") / 100)
    r = analysis.compared(a, b).first()
    assert r.difference == pytest.approx(1.055) and r.w == 0 and r.n == 6
    c = analysis.control_correlations(a.withColumnRenamed("score", "min_f1"), a.select("session_id", F.col("score").alias("db"))).first()
    assert c.rho == pytest.approx(1) and c.slope == pytest.approx(1)


def test_permutation_null(data):
    cfg = config.build(override={"eeg": {"bands": ((8, 13),)}})["eeg"]
    f = session.eeg_features(session.eeg_windows(data[1], cfg, 250.0), cfg)
    null = session.permutation_null(f, 3).collect()
    assert len(null) == 3 and all(0 <= r.value <= 1 for r in null)


def test_power_of_segments_and_its_course(spark):
    """A rhythm whose size is known gives back its drop, side and course."""
    import numpy as np

    from wavemill.plans import analysis
    from wavemill.sources.schemas import CHANNELS

    fs, long = 250, 2000
    labels = [1, 2, 1, 3] * 4
    n = long * len(labels)
    t = np.arange(n)
    lab = np.repeat(labels, long)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.05, (n, len(CHANNELS)))
    size = {"c3": np.where(lab == 3, 0.5, 2.0), "c4": np.where(lab == 2, 0.5, 2.0)}
    for c, a in size.items():
        x[:, CHANNELS.index(c)] += a * np.sin(2 * np.pi * 10.5 * t / fs) + 100
    strong = np.repeat([0, 8, 0, 0.5] * 4, long)  # class 2 carries the artefact
    x += (1 + strong)[:, None] * np.sin(2 * np.pi * 83 * t / fs)[:, None] * 0.2
    eeg = spark.createDataFrame([("s", int(k), x[k].tolist()) for k in t], "session_id string, sample long, x array<double>")
    segs = spark.createDataFrame([("s", k * long, (k + 1) * long, v) for k, v in enumerate(labels)], "session_id string, start_sample long, end_sample long, label int")
    eeg, segs = eeg.cache(), segs.cache()
    got = analysis.physiology(eeg, segs).first()
    # one side falls by 20 log10(4) dB, the other stays: half of that in the mean of logs
    assert got.early_drop_db == pytest.approx(-10 * np.log10(16) / 2, abs=0.3) and got.side_auc == 0.0
    s = analysis.power_by_stratum(eeg, segs).first()
    assert (s.n_high, s.n_low) == (4, 0) or (s.n_high, s.n_low) == (4, 4)
    assert s.late_high_db == pytest.approx(-6.02, abs=0.3) and s.late_db == pytest.approx(-6.02, abs=0.3) and s.early_db == pytest.approx(-6.02, abs=0.3)
    c = {(r.label, round(r.offset_s, 2)): r.db for r in analysis.power_course(eeg, segs, "c4", (8.0, 13.0)).collect()}
    assert c[2, 3.0] == pytest.approx(-12.04, abs=0.4) and c[3, 3.0] == pytest.approx(0, abs=0.4) and abs(c[2, -0.75]) < 1.5
    assert min(k[1] for k in c) == -1.0 and max(k[1] for k in c) == 4.75


def test_only_the_channels_asked_for_reach_a_group(spark):
    """What is shuffled to the recordings' groups holds the band's channels, and the mean of many is one number."""
    from wavemill.sources.schemas import CHANNELS

    _, eeg, _ = synthetic.recordings(spark, 1, 1)
    p = analysis.band_power(eeg, ("c3", "c4"), (8.0, 13.0))
    assert "Project [session_id" in p._jdf.queryExecution().optimizedPlan().toString() and p.first().power is not None and len(p.first().power) == 2
    every = {r.sample: r.power for r in analysis.band_power(eeg, CHANNELS, (81.5, 85.5), both_ways=False).collect()}
    one = {r.sample: r.power for r in analysis.band_power(eeg, CHANNELS, (81.5, 85.5), both_ways=False, mean=True).collect()}
    assert all(len(v) == 1 and v[0] == pytest.approx(sum(every[k]) / len(CHANNELS), rel=1e-12) for k, v in one.items()) and len(one) == len(every)

"""What session plans send and keep: no samples of recordings made of a table, no windows, few sums of folds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavemill.operators import crossfit, sequence, signal
from wavemill.plans import catalog, config, session
from wavemill.sources import synthetic


def exchanged(df):
    """The shuffles of a plan, with the columns that they send."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    parts = text.split("\n\n")
    return [p for p in parts if p.split(")", 1)[-1].split("\n")[0].strip().startswith("Exchange")]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Lines of nine sessions of some 17,000 samples: two blocks each."""
    d = str(tmp_path_factory.mktemp("lines"))
    n = F.col("id")
    spark.range(153_000).select(
        F.floor(n / 4).alias("l_orderkey"), (n % 4 + 1).cast("int").alias("l_linenumber"), (n * 7919 % 20_000).alias("l_partkey"), (n * 104_729 % 1_000).alias("l_suppkey"),
        (n * 31 % 50 + 1).cast("double").alias("l_quantity"), (n * 6_151 % 90_000 + 1_000.5).alias("l_extendedprice"), (n * 13 % 11 / 100).alias("l_discount"), (n * 17 % 9 / 100).alias("l_tax"),
    ).repartition(3).write.parquet(f"{d}/lineitem.parquet")
    return d


def test_samples_and_windows_are_not_sent(spark, lines, monkeypatch):
    monkeypatch.setattr(catalog, "SESSION_KEYS", 4_250)
    s, eeg, nirs = catalog.table_recordings(spark, lines)
    assert s.count() == 9 and eeg.count() == 153_000
    groups = eeg.groupBy("session_id").applyInPandas(lambda g: g[["session_id", "sample"]].iloc[:1], "session_id string, sample long")
    assert groups.count() == 9 and not exchanged(groups)
    answers = session.run(s, eeg, nirs, config.build(preset="final", override={"global": {"enabled": False}}))
    sent = exchanged(answers)
    assert sent and not [p for p in sent if any(f" {c}#" in p or f"[{c}#" in p for c in ("x", "spd", "covs", "slow", "aux"))]
    assert answers.where("y_nirs is not null").count() == 9 * 6  # windows of the second block


def test_few_sessions_take_few_tasks(spark, lines, monkeypatch):
    monkeypatch.setattr(catalog, "SESSION_KEYS", 4_250)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        _, eeg, _ = catalog.table_recordings(spark, lines)
        groups = eeg.groupBy("session_id").applyInPandas(lambda g: g[["session_id", "sample"]].iloc[:1], "session_id string, sample long")
        assert groups.rdd.getNumPartitions() == 4 * 9 + 1 and groups.count() == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_samples_made_of_lines_are_in_order(spark, lines, monkeypatch):
    monkeypatch.setattr(catalog, "SESSION_KEYS", 4_250)
    _, eeg, nirs = catalog.table_recordings(spark, lines)
    one = eeg.where("session_id = 's00002'").orderBy("sample").toPandas()
    assert one["sample"].tolist() == list(range(17_000)) and one["block"].tolist() == [1] * 16_000 + [2] * 1_000
    n = 2 * 17_000 + 60  # the sixtieth line of the third session
    ground = (n * 7919 % 20_000 * 3 + n * 104_729 % 1_000) % 997 / 120
    assert one["x"][60][0] == pytest.approx(ground + 5.0 * np.sin(60 * 2 * np.pi * 10 / 250))
    assert nirs.where("session_id = 's00002'").count() == 850


@pytest.mark.parametrize("csp", [False, True])
def test_windows_of_a_session_equal_the_operators_on_tables(spark, csp):
    _, eeg, _ = synthetic.recordings(spark, 1, 2)
    noisy = F.transform("x", lambda v, i: F.when((i == 0) & (F.col("session_id") == "s001_N00"), v + 400 * F.sin(F.col("sample") * 0.3)).otherwise(v))
    eeg = eeg.withColumn("x", noisy)
    cfg = config.build(preset="final", override={"eeg": {"bands": ((8, 13), (13, 30)), "csp": {"enabled": csp, "preps": ("raw", (8, 13)), "avg_n": 2}}})["eeg"]
    grid = signal.grid_covariances(eeg, cfg, 250.0)
    bad = signal.bad_channels(grid.where("block = 1"), flat=cfg["bad_flat_frac"], ratio=cfg["bad_ratio"]).cache()
    assert {r.session_id: r.bad for r in bad.collect()} == {"s000_N00": [], "s001_N00": [0]}
    grid = signal.averaged(grid, cfg["cov_avg_n"])
    grid = signal.averaged(grid, cfg["csp"]["avg_n"], "aux") if csp else grid
    want = signal.referenced(grid, cfg, 250, bad).orderBy("session_id", "k").toPandas()
    got = session.eeg_windows(eeg, cfg, 250.0).orderBy("session_id", "k").toPandas()
    for c in ("session_id", "k", "start_sample", "end_sample", "label", "block", "homogeneous"):
        assert got[c].tolist() == want[c].tolist()
    for c in ("spd", "aux") if csp else ("spd",):
        np.testing.assert_allclose(np.stack(got[c]), np.stack(want[c]), rtol=1e-9, atol=1e-9)
    assert len(got) > 100 and got["trained"].tolist() == got["homogeneous"].tolist()


@pytest.mark.parametrize("signals", ["hb", "cbsi"])
def test_slow_features_of_a_session_equal_the_join(spark, signals):
    s, _, nirs = synthetic.recordings(spark, 1, 1)
    cfg = config.build(preset="final", override={"nirs": {"signal": signals}})["nirs"]
    ends = np.array([0, 10, 250, 312, 313, 4_000, 9_000, 10**7])
    right = signal.slow_features(nirs, s, cfg)
    left = spark.createDataFrame([("s000_N00", int(e)) for e in ends], "session_id string, end_sample long")
    want = sequence.asof_backward(left, right, ["session_id"], "end_sample", "at", ["slow"]).orderBy("end_sample").toPandas()["slow"]
    got = signal.slow_at(nirs.toPandas().assign(fs_nirs=12.5), ends, cfg)
    assert [v is None for v in got] == [v is None for v in want] and got[0] is None and got[-1] is not None
    for a, b in zip(got, want, strict=True):
        if a is not None:
            np.testing.assert_allclose(a, b, atol=1e-9)
    assert signal.slow_at(pd.DataFrame(), ends, cfg) == [None] * len(ends)


def test_folds_take_few_passes_and_tasks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n, d, subjects = 6_000, 12, 60
    y, sub = rng.integers(1, 4, n), np.arange(n) % subjects
    x = rng.normal(size=(n, d))
    x[:, :3] += 0.5 * np.eye(3)[y - 1]
    rows = spark.createDataFrame([(f"N{sub[k]}", int(y[k]), x[k].tolist()) for k in range(n)], "subject string, label int, feature array<double>").repartition(30)
    sums, tasks, work = crossfit._sums, [], []

    def counted(df, folds, classes):
        tasks.append(df.rdd.getNumPartitions())
        work.append(sum(not f.done for f in folds.values()))
        return sums(df, folds, classes)

    monkeypatch.setattr(crossfit, "_sums", counted)
    got = crossfit.leave_one_out(rows, [f"N{k}" for k in range(subjects)], 0.1)
    assert got.count() == subjects
    assert max(tasks) <= crossfit.TASKS * spark.sparkContext.defaultParallelism
    assert sum(work) <= 8 * subjects, work

"""The online path with both streams gives what the batch plan gives, however the samples come."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.plans import config, session
from wavemill.sources import synthetic
from wavemill.streaming import processor


@pytest.fixture(scope="module")
def data(spark):
    s, eeg, nirs = synthetic.recordings(spark, 1, 1)
    # a channel that stands still, which only the end of block 1 can tell
    eeg = eeg.withColumn("x", F.transform("x", lambda v, i: F.when(i == 8, F.lit(5.0)).otherwise(v)))
    return s.cache(), eeg.cache(), nirs.cache()


BASE = {
    "eeg": {"bands": ((8, 13),), "channels": ("c3", "cz", "c4", "pz"), "cov_avg_n": 3, "features": "ts+mdm", "mdm_metric": "logeuclid", "train_skip_s": 0.3},
    "nirs": {"lags_s": (0, 2), "use_level": True},
    "smoothing": {"tau_s": 1.0},
    "bias": {"mode": "session", "min_blocks": 2},
}


def played(spark, data, cfg, tmp_path, name, cuts, model=None):
    """Runs the stream over files that hold the samples between the cuts: (stream, from, to) as shares of its length."""
    s, eeg, nirs = data
    src, n, m = str(tmp_path / "in"), eeg.count(), nirs.count()
    both = processor.both_streams(eeg, nirs, s)
    for kind, a, b in cuts:
        size = n if kind == "eeg" else m
        both.where(f"kind = '{kind}' and sample >= {int(a * size)} and sample < {int(b * size)}").coalesce(1).write.mode("append").parquet(src)
    processor.both_streams(eeg.limit(0), nirs.limit(0), s, s.select("session_id")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = processor.online(stream, cfg, model=model).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).orderBy("end_sample").collect()


HALVES = (("eeg", 0, 0.5), ("nirs", 0, 0.5), ("eeg", 0.5, 1), ("nirs", 0.5, 1))
MIXED = (("nirs", 0.3, 1), ("eeg", 0, 0.6), ("nirs", 0, 0.2), ("eeg", 0.7, 1), ("nirs", 0.15, 0.31), ("eeg", 0.5, 0.75))


@pytest.mark.parametrize(("name", "over", "cuts"), [("halves", {}, HALVES), ("mixed", {"nirs": {"signal": "cbsi", "gsr": True}}, MIXED), ("mvp", {"nirs": {"features": "mvp"}, "fusion": {"mode": "avg"}, "smoothing": {"space": "prob"}}, MIXED[::-1])])
def test_online_equals_batch(spark, data, tmp_path, name, over, cuts):
    s, eeg, nirs = data
    cfg = config.build(override=config.layered(BASE, over))
    batch = session.run(s, eeg, nirs, cfg).orderBy("end_sample").collect()
    got = played(spark, data, cfg, tmp_path, name, cuts)
    assert len(got) == len(batch) > 40 and {r.block for r in got} == {2, 3}
    np.testing.assert_allclose([r.probs for r in got], [r.probs for r in batch], atol=1e-6)
    for x, y in zip(got, batch, strict=True):
        assert (x.start_sample, x.block, x.true_y, x.y_eeg, x.y_nirs) == (y.start_sample, y.block, y.true_y, y.y_eeg, y.y_nirs)
        top = sorted(y.probs)
        assert x.y == y.y or top[2] - top[1] < 1e-12  # two classes that are equal but for the last bit


def test_labels_of_later_blocks_change_nothing(spark, data, tmp_path):
    s, eeg, nirs = data
    cfg = config.build(override=BASE)
    last = eeg.agg(F.max("block")).first()[0]
    swap = F.when((F.col("block") == last) & F.col("state").isin(2, 3), 5 - F.col("state")).otherwise(F.col("state"))
    a = played(spark, data, cfg, tmp_path / "a", "plain", HALVES)
    b = played(spark, (s, eeg.withColumn("state", swap), nirs), cfg, tmp_path / "b", "swapped", HALVES)
    assert [(r.end_sample, r.y) for r in a] == [(r.end_sample, r.y) for r in b] and [r.true_y for r in a] != [r.true_y for r in b]


def test_sessions_without_the_slow_stream_wait_for_none(spark, data, tmp_path):
    s, eeg, nirs = data
    alone = s.withColumn("has_nirs", F.lit(False)).withColumn("fs_nirs", F.lit(None).cast("double"))
    cfg = config.build(override=BASE)
    got = played(spark, (alone, eeg, nirs.limit(0)), cfg, tmp_path, "alone", (("eeg", 0, 0.5), ("eeg", 0.5, 1)))
    batch = session.run(alone, eeg, nirs.limit(0), config.build(override=config.layered(BASE, {"nirs": {"enabled": False}}))).orderBy("end_sample").collect()
    assert len(got) == len(batch) and [r.y for r in got] == [r.y_eeg for r in batch] and {r.y_nirs for r in got} == {None}

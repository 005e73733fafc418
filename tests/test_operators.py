import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import scalar as S
from wavemill.operators import fusion, scoring, sequence, stats


def stream(spark, rows):
    return spark.createDataFrame(rows, "s string, i long, x double, lab int, blk int")


def test_grid_windows_and_segments(spark):
    lab = [0, 1, 1, 1, 1, 2, 2, 2, 2, 2]
    df = stream(spark, [("a", i, float(i), v if v else None, 1 if i < 5 else 2) for i, v in enumerate(lab)])
    got = sequence.grid_windows(df, ["s"], ["i"], "lab", 3, 1, "blk", 1).orderBy("start_sample").collect()
    assert [(r.start_sample, r.end_sample, r.label) for r in got] == [(5, 8, 2), (6, 9, 2), (7, 10, 2)]
    seg = sequence.segments(df, ["s"], ["i"], "lab").orderBy("start_sample").collect()
    assert [(r.start_sample, r.end_sample, r.label) for r in seg][1:] == [(1, 5, 1), (5, 10, 2)]
    k = sequence.grid_points(sequence.segments(df, ["s"], ["i"], "lab").where("label = 2"), 2, 2).orderBy("k")
    assert [r.k for r in k.collect()] == [3, 4]


def test_trailing_statistics(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=30)
    df = stream(spark, [("a", i, float(v), 1, 1) for i, v in enumerate(x)])
    got = df.select("i", sequence.trailing_slope("x", "i", ["s"], ["i"], 6, 2.0).alias("m"), sequence.clamped_mean("x", ["s"], ["i"], 3).alias("c"), sequence.trailing_level("x", ["s"], ["i"], 4).alias("l")).orderBy("i").collect()
    for r in got:
        part = x[max(0, r.i - 5) : r.i + 1]
        assert r.m == pytest.approx(0 if len(part) < 3 else np.polyfit(np.arange(len(part)), part, 1)[0] * 2)
        assert r.c == pytest.approx(np.mean([x[max(0, r.i - j)] for j in range(3)]))
        assert r.l == pytest.approx(x[max(0, r.i - 3) : r.i + 1].mean())
    e = [r.ema for r in sequence.ema(df, ["s"], ["i"], "x", 0.7).orderBy("i").collect()]
    y = [x[0]]
    for v in x[1:]:
        y.append(0.7 * y[-1] + 0.3 * v)
    np.testing.assert_allclose(e, y)
    assert sequence.ema_final(df, ["s"], ["i"], "x", 0.7).first().ema == pytest.approx(y[-1])


def test_asof_and_range_joins(spark):
    rng = np.random.default_rng(1)
    left = spark.createDataFrame([("ab"[i % 2], int(v)) for i, v in enumerate(rng.integers(0, 50, 40))], "s string, at long")
    right = spark.createDataFrame([("ab"[i % 2], int(v), i) for i, v in enumerate(rng.choice(50, 12, replace=False))], "s string, t long, v int")
    r = [tuple(x) for x in right.collect()]
    for f, pick in ((sequence.asof_backward, lambda a, s: max(((t, v) for q, t, v in r if q == s and t <= a), default=(None, None))), (sequence.asof_forward, lambda a, s: min(((t, v) for q, t, v in r if q == s and t >= a), default=(None, None)))):
        for x in f(left, right, ["s"], "at", "t", ["t", "v"]).collect():
            assert (x.t, x.v) == pick(x["at"], x.s)
    iv = right.select("s", "t", (F.col("t") + 7).alias("u"))
    got = sequence.range_join(left, iv, ["s"], "at", "t", "u", 4).count()
    assert got == sum(1 for s, a in map(tuple, left.collect()) for q, t, _ in r if q == s and t <= a <= t + 7)
    d = spark.range(1).select(sequence.delivered(F.lit(10), F.lit(100), F.lit(162), 250.0, 12.5).alias("n")).first().n
    assert d == 10 - round(62 / 20)


def test_order_rules(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, o int, v string")
    assert {r.v for r in sequence.last_per_key(df, ["k"], ["o", "v"]).collect()} == {"y", "z"}
    p = spark.createDataFrame([("a", 5), ("a", 9)], "s string, at long")
    got = sequence.event_order(p, p.where("at = 5"), ["s"]).orderBy("place").collect()
    assert [(r["at"], r.kind) for r in got] == [(5, 0), (5, 1), (9, 0)]
    r = spark.range(1).select(S.argmax_first(F.array(*map(F.lit, (1.0, 3.0, 3.0)))).alias("a"), S.step_of(F.lit(250.0)).alias("b"), S.subject_of(F.lit("2025_x_N03")).alias("c")).first()
    assert (r.a, r.b, r.c) == (2, 62, "N03")
    with pytest.raises(Exception, match="not a class"):
        spark.range(1).select(S.checked_label(F.lit(4)).alias("y")).collect()


def test_known_session(spark):
    # A confusion matrix (answers in rows, truths in columns) with its published scores.
    matrix = [[720, 6, 15], [36, 280, 117], [19, 105, 253]]
    rows = [(a + 1, t + 1, n) for a, line in enumerate(matrix) for t, n in enumerate(line)]
    df = spark.createDataFrame(rows, "y int, t int, n int").withColumn("i", F.explode(F.expr("sequence(1, n)")))
    r = scoring.metrics(df, []).first()
    assert (r.f1_1, r.f1_2, r.f1_3) == pytest.approx((0.9498680738786279, 0.6796116504854369, 0.6640419947506562))
    assert (r.min_f1, r.macro_recall, r.n) == (pytest.approx(0.6640419947506562), pytest.approx(0.7674292157255609), 1551)
    wide = {x.pred: [x["1"], x["2"], x["3"]] for x in scoring.confusion_wide(df, []).collect()}
    assert [wide[k] for k in (1, 2, 3)] == matrix


def test_scoring_edges(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 9, 1), ("a", None, 2), ("b", 5, 5)], "s string, y int, t int")
    m = {r.s: r for r in scoring.metrics(df, ["s"]).collect()}
    assert (m["a"].f1_1, m["a"].min_f1, m["a"].n) == (1.0, 0.0, 2) and m["a"].macro_recall == pytest.approx(1 / 3)
    assert (m["b"].min_f1, m["b"].n) == (0.0, 0)
    p = spark.createDataFrame([(0.3,), (0.26,), (0.1,)], "s double").agg(scoring.penalty(F.col("s"), 0.2, 0.05, 20.0).alias("p")).first().p
    assert p == 3.0


def test_fusion_and_bias(spark):
    rng = np.random.default_rng(4)
    t = rng.integers(1, 4, 240)
    lp = np.log(np.exp(rng.normal(size=(240, 3)) + 1.2 * np.eye(3)[t - 1] + np.array([1.0, 0.0, 0.0])))
    df = spark.createDataFrame([(f"g{i % 4}", int(c), v.tolist()) for i, (c, v) in enumerate(zip(t, lp, strict=True))], "g string, t int, p array<double>")
    bias = fusion.calibrated(df, "p", "t", ["g"], passes=1)
    one = lambda b: fusion.bias_scores(df, spark.createDataFrame([(b,)], "bias array<double>"), "p", "t", ["g"]).first().value
    assert bias[0] == 0 and one(bias) >= one([0.0, 0.0, 0.0])
    r = df.select(fusion.log_linear("p", F.lit(None).cast("array<double>"), 0.8).alias("f"), F.col("p")).first()
    assert r.f == r.p
    s = fusion.smoothed(df.withColumn("i", F.monotonically_increasing_id()), ["g"], "i", "p", 0.5)
    assert s.count() == 240
    x = df.select("g", F.col("p").alias("x"), F.col("t").alias("label"))
    from wavemill.functions.classify import fit_slda, linear_log_prob

    models = fusion.grouped_fit(x, ["g"], "x", "label", fit_slda)
    got = fusion.applied(x, models, ["g"], "x").where("g = 'g1'").collect()
    m = models.where("g = 'g1'").first()
    m = {k: np.array(m[k]) for k in ("mu", "sd", "w", "b")}
    np.testing.assert_allclose([r.lp for r in got], linear_log_prob(m, np.array([r.x for r in got])), atol=1e-9)


def test_statistics(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 6, 50).astype(float), rng.integers(0, 6, 50).astype(float)
    df = spark.createDataFrame([(float(x), float(y), bool(x + y > 5)) for x, y in zip(a, b, strict=True)], "a double, b double, p boolean")
    auc = stats.rank_auc(df, "a", F.col("p")).first()
    pos, neg = a[a + b > 5], a[a + b <= 5]
    assert auc.auc == pytest.approx(np.mean([(x > y) + 0.5 * (x == y) for x in pos for y in neg]))
    w = stats.wilcoxon(df, "a", "b").first()
    d = (a - b)[a != b]
    ranks = np.array([(np.abs(d) < abs(v)).sum() + ((np.abs(d) == abs(v)).sum() + 1) / 2 for v in d])
    assert w.w == pytest.approx(min(ranks[d > 0].sum(), ranks[d < 0].sum())) and w.n == len(d) and 0 <= w.p <= 1
    s = spark.createDataFrame([(f"u{i % 5}", float(i % 7)) for i in range(40)], "u string, v double")
    boot = stats.bootstrap(s, "u", "v", 100, 3)
    again = {r.rep: r.value for r in stats.bootstrap(s, "u", "v", 100, 3).collect()}
    assert {r.rep: r.value for r in boot.collect()} == again and len(again) == 100
    assert stats.permutation_p(spark.range(9).withColumn("v", F.col("id").cast("double")), "v", F.lit(7.0)).first().p == pytest.approx(3 / 10)
    segs = spark.createDataFrame([("s", 1, i * 10, [2, 3, 1][i % 3]) for i in range(12)], "s string, block int, start_sample long, lab int")
    p = stats.permuted_labels(segs, ["s", "block"], "lab", 3)
    assert sorted(r.lab for r in p.collect()) == sorted(r.lab for r in segs.collect())
    assert {r.start_sample for r in p.where("lab = 1").collect()} == {r.start_sample for r in segs.where("lab = 1").collect()}
    assert sorted(r.lab for r in stats.phase_permuted(segs, ["s", "block"], "lab", 1).collect()) == sorted(r.lab for r in segs.collect())


def test_means_over_uneven_times(spark):
    import numpy as np

    from wavemill.operators import sequence

    rng = np.random.default_rng(3)
    t = np.cumsum(rng.exponential(2, 400))
    rows = [(int(k % 3), float(t[k]), [float(v) for v in rng.normal(size=2)], float(rng.normal())) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, t double, v array<double>, w double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # means go over from batch to batch
    try:
        got = {(r.g, r.t): (r.ema, r.v) for r in sequence.ema_uneven(df, ["g"], "t", "v", 5.0).collect()}
        even = {(r.g, r.t): r.y for r in sequence.ema(df, ["g"], ["t"], "w", 0.7, "y").collect()}
        none = {(r.g, r.t): r.y for r in sequence.ema_uneven(df, ["g"], "t", "w", 0.0, "y").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(3):
        own, last, y, z = sorted(r for r in rows if r[0] == g), None, None, None
        for _, at, v, w in own:
            a = 0.0 if last is None else np.exp(-(at - last) / 5)
            y = np.array(v) if y is None else a * y + (1 - a) * np.array(v)
            z = w if z is None else 0.7 * z + 0.3 * w
            last = at
            np.testing.assert_allclose(got[g, at][0], y, atol=1e-12)
            assert even[g, at] == pytest.approx(z, abs=1e-12) and none[g, at] == w
    assert sequence.ema(df.limit(0), ["g"], ["t"], "w", 0.7).count() == 0


def test_windows_that_end_anywhere(spark):
    import numpy as np

    from wavemill.operators import sequence

    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2)) + 1e6
    df = spark.createDataFrame([("s", k, *map(float, x[k])) for k in range(200)], "k string, sample long, a double, b double")
    ends = spark.createDataFrame([("s", e) for e in (0, 1, 3, 50, 63, 199, 200, 260)] + [("none", 5), ("s", None)], "k string, stop long")
    for centred in (False, True):
        got = {(r.k, r.stop): r for r in sequence.moments_at(df, ["k"], "sample", ["a", "b"], ends, "stop", 50, centred).collect()}
        assert got["none", 5].m_0_0 is None and got["s", 0].m_0_0 is None and ("s", None) not in got
        for e in (1, 3, 50, 63, 199, 200):
            w = x[max(0, e - 50) : e]
            w = w - w.mean(axis=0) if centred else w
            want = w.T @ w / len(w)
            np.testing.assert_allclose([got["s", e].m_0_0, got["s", e].m_0_1, got["s", e].m_1_1], want[np.triu_indices(2)], rtol=1e-9, atol=1e-9)
        assert got["s", 260].m_0_0 == got["s", 200].m_0_0  # as of the last sample there is


def test_documents_over_many_lines(spark, tmp_path):
    from wavemill.sources import files

    one = {"status": "ok", "session": "a/2025_N02.mat", "hybrid": {"confusion": [[3, 0, 0], [0, 1, 0], [0, 0, 1]], "f1": {"1": 1.0, "2": 0.5, "3": 0.25}, "min_f1": 0.25, "macro_recall": 0.5, "n_windows": 5}, "nirs_only": None, "timings": {"predict_max_s": 0.03, "n_fit": 7, "penalty_fit": 10}, "score": {"base_quality": 52.25, "nirs_bonus": {"present": True, "points": 11.5, "detail": "x"}, "penalties": 10, "total": 63.3}, "wall_s": 1.5}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "N02.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "lines.json").write_text(json.dumps(one) + "\n" + json.dumps({**one, "status": "bad"}) + "\n")
    (tmp_path / "odd.json").write_text("no document")
    got = sorted(files.metric_documents(spark, str(tmp_path)).collect(), key=lambda r: (r.file, str(r.status)))
    assert [(r.file, r.status) for r in got] == [("N02", "ok"), ("lines", "bad"), ("lines", "ok"), ("odd", None)]
    r = got[0]
    assert r.hybrid.f1["3"] == 0.25 and r.hybrid.confusion[0][0] == 3 and r.nirs_only is None and r.timings.penalty_fit == 10 and r.timings.n_fit == 7 and r.score.nirs_bonus.points == 11.5 and r.score.total == 63.3


def test_latencies_of_a_stream(spark, tmp_path):
    import time

    from wavemill.operators import scoring
    from wavemill.streaming import latency

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(10)
    for _ in range(3):
        df.coalesce(1).write.mode("append").parquet(src)
    listener = latency.Latencies(spark, out)
    spark.streams.addListener(listener)
    try:
        slow = lambda batch, k: time.sleep(1.5 if k == 1 and batch.count() else 0 * batch.count())
        q = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(slow).queryName("timed").option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        until = time.time() + 20
        while time.time() < until:
            time.sleep(0.5)
            try:
                got = latency.latencies(spark, out).where("query = 'timed' and event = 'addBatch'")
                if got.where("rows > 0").count() == 3:
                    break
            except Exception:  # noqa: BLE001, S112 (nothing written yet)
                continue
    finally:
        spark.streams.removeListener(listener)
    own = got.where("rows > 0")
    per = scoring.latency(own, []).first()
    assert per.n == 3 and 1.5 <= per.max_s < 15
    slow, fast = (own.where(c).agg(scoring.penalty(F.col("seconds"), 1.0, 0.1, 20.0).alias("p")).first().p for c in ("batch = 1", "batch = 2"))
    assert slow >= 5 and fast < slow

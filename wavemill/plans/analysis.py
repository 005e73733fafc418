"""Analyses of answers and recordings: time bins, blocks, discriminability, artefact strength, spectra and grand averages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import filters
from ..functions import scalar as S
from ..functions.classify import fit_slda
from ..operators import fusion, scoring, sequence, signal, stats
from ..sources.schemas import CHANNELS, NIRS_REGIONS


#: Parts of a segment in seconds from its start (an end of None is the segment's): its first second left out, early, and late.
PARTS = {"whole": (1.0, None), "early": (0.5, 2.5), "late": (5.0, None)}


def band_power(eeg: DataFrame, channels: tuple[str, ...], band: tuple[float, float], fs: float = 250.0, both_ways: bool = True, mean: bool = False) -> DataFrame:
    """(session_id, sample, power): squares of channels within a band, less their medians first, or their `mean` alone; a recording
    is a group, to which only the channels asked for are sent."""
    at, sos = [CHANNELS.index(c) for c in channels], filters.butterworth(4, band, fs)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("sample")
        x = np.stack(g["x"].to_numpy())
        x = x - np.median(x, axis=0)
        y = filters.zero_phase(sos, x) if both_ways else filters.Stream(sos)(x)
        y = y * y
        if mean:
            y = sum(y[:, c] for c in range(len(at)))[:, None] / len(at)
        return pd.DataFrame({"session_id": key[0], "sample": g["sample"].to_numpy(dtype="int64"), "power": list(y)})

    return eeg.select("session_id", "sample", F.array(*[F.col("x")[c] for c in at]).alias("x")).groupBy("session_id").applyInPandas(run, "session_id string, sample long, power array<double>")


def segment_powers(power: DataFrame, segs: DataFrame, n: int, fs: float = 250.0, parts: dict = PARTS) -> DataFrame:
    """(session_id, start_sample, label, <part>): for each labelled segment and part, an array of ln mean power of the n channels, all
    parts and channels in one pass over the samples; null where a part has none."""
    s = segs.where("label > 0").select("session_id", "start_sample", "end_sample", "label", (F.col("end_sample") - 1).alias("_last"))
    rows = sequence.range_join(power, s, ["session_id"], "sample", "start_sample", "_last", int(4 * fs))
    since = F.col("sample") - F.col("start_sample")
    sums = []
    for name, (a, b) in parts.items():
        inside = (since >= int(round(a * fs))) & (F.lit(True) if b is None else since < int(round(b * fs)))
        sums += [F.avg(F.when(inside, F.col("power")[c])).alias(f"{name}_{c}") for c in range(n)]
    g = rows.groupBy("session_id", "start_sample", "label").agg(*sums)
    log = lambda name: F.when(F.col(f"{name}_0").isNotNull(), F.array(*[F.ln(F.col(f"{name}_{c}") + 1e-9) for c in range(n)]))
    return g.select("session_id", "start_sample", "label", *[log(name).alias(name) for name in parts])


def _mean(array: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v) / F.size(array)


def _decibels(log_ratio: Column) -> Column:
    return log_ratio * (10 / float(np.log(10)))


def physiology(eeg: DataFrame, segs: DataFrame, fs: float = 250.0, band: tuple[float, float] = (8.0, 13.0)) -> DataFrame:
    """(session_id, side_auc, early_drop_db): how well the difference of the two sides' log power tells the movements apart (the
    chance that class 3 has the larger one), and the change of early movement against rest in decibels."""
    p = segment_powers(band_power(eeg, ("c3", "c4"), band, fs), segs, 2, fs, {k: PARTS[k] for k in ("whole", "early")})
    side = stats.rank_auc(p.where("label > 1 and whole is not null").withColumn("_d", F.col("whole")[0] - F.col("whole")[1]), "_d", F.col("label") == 3, ["session_id"])
    drop = p.groupBy("session_id").agg(_decibels(F.avg(F.when(F.col("label") > 1, _mean("early"))) - F.avg(F.when(F.col("label") == 1, _mean("whole")))).alias("early_drop_db"))
    return drop.join(side.select("session_id", F.col("auc").alias("side_auc")), "session_id", "left").select("session_id", "side_auc", "early_drop_db")


def power_by_stratum(eeg: DataFrame, segs: DataFrame, fs: float = 250.0, band: tuple[float, float] = (8.0, 13.0), artefact: tuple[float, float] = (81.5, 85.5), high: float = 6.0, low: float = 2.0) -> DataFrame:
    """Per session: movements of strong (over `high` dB above rest late in the segment) and weak (under `low`) artefact, the change of
    band power of c3 and c4 against rest in either stratum, early and late over all, and the correlation of both."""
    own = segment_powers(band_power(eeg, ("c3", "c4"), band, fs, both_ways=False), segs, 2, fs, {k: PARTS[k] for k in ("early", "late")})
    art = segment_powers(band_power(eeg, CHANNELS, artefact, fs, both_ways=False, mean=True), segs, 1, fs, {"late": PARTS["late"]}).select("session_id", "start_sample", F.col("late")[0].alias("a"))
    p = own.join(art, ["session_id", "start_sample"]).select("session_id", "label", _mean("early").alias("e"), _mean("late").alias("l"), "a")
    rest = F.col("label") == 1
    w = Window.partitionBy("session_id")
    less = lambda c: _decibels(F.col(c) - F.avg(F.when(rest, F.col(c))).over(w)).alias(c)
    m = p.select("session_id", "label", less("e"), less("l"), less("a")).where("label > 1")
    strong, weak = F.col("a") > high, F.col("a") < low
    return m.groupBy("session_id").agg(F.sum(strong.cast("long")).alias("n_high"), F.sum(weak.cast("long")).alias("n_low"), F.avg(F.when(strong, F.col("l"))).alias("late_high_db"), F.avg(F.when(weak, F.col("l"))).alias("late_low_db"), F.avg("e").alias("early_db"), F.avg("l").alias("late_db"), F.corr("a", "l").alias("r"))


def power_course(eeg: DataFrame, segs: DataFrame, channel: str, band: tuple[float, float], before_s: float = 1.0, after_s: float = 5.0, step_s: float = 0.25, fs: float = 250.0) -> DataFrame:
    """(label, offset_s, db): the mean change of a band's power over time, each segment against the mean of the seconds before it."""
    before = int(round(before_s * fs))
    p = band_power(eeg, (channel,), band, fs).select("session_id", "sample", F.col("power")[0].alias("v"))
    s = segs.where("label > 0").select("session_id", F.col("start_sample").alias("at"), "label")
    e = s.withColumn("_lo", F.col("at") - before).withColumn("_hi", F.col("at") + int(round(after_s * fs)) - 1)
    rows = sequence.range_join(p, e, ["session_id"], "sample", "_lo", "_hi", before + int(round(after_s * fs)))
    since = F.col("sample") - F.col("at")
    g = rows.groupBy("session_id", "at", "label", F.floor(since / (step_s * fs)).alias("bin")).agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    w = Window.partitionBy("session_id", "at")
    base = F.sum(F.when(F.col("bin") < 0, F.col("s"))).over(w) / F.sum(F.when(F.col("bin") < 0, F.col("n"))).over(w)
    g = g.select("label", "bin", _decibels(F.ln((F.col("s") / F.col("n")) / base)).alias("db"))
    return g.groupBy("label", (F.col("bin") * step_s).alias("offset_s")).agg(F.avg("db").alias("db"))


def by_block(predictions: DataFrame) -> DataFrame:
    """Metrics per (session, block)."""
    return scoring.metrics(predictions, ["session_id", "block"], "y", "true_y")


def by_time(predictions: DataFrame, segs: DataFrame, fs: float = 250.0) -> DataFrame:
    """Metrics per (session, bin): how long the segment had lasted at the end of a window."""
    s = segs.select("session_id", "start_sample", F.col("start_sample").alias("seg_start"))
    p = sequence.asof_backward(predictions, s, ["session_id"], "start_sample", "start_sample", ["seg_start"])
    p = p.withColumn("bin", S.time_bin((F.col("end_sample") - F.col("seg_start")) / fs)).where("bin is not null")
    return scoring.metrics(p, ["session_id", "bin"], "y", "true_y")


def log_odds(probs: Column | str) -> tuple[Column, Column]:
    """Movement against rest, and class 3 against class 2, from three log-probabilities."""
    p = S.col(probs)
    return S.logaddexp(p[1], p[2]) - p[0], p[2] - p[1]


def two_aucs(predictions: DataFrame, keys: list[str], probs: str = "probs", truth: str = "true_y") -> DataFrame:
    """(keys, auc_move, auc_side); rows with NaN or null log-probabilities make both null for their group."""
    move, side = log_odds(probs)
    p = predictions.withColumn("_m", move).withColumn("_s", side).withColumn("_ok", F.coalesce(S.no_nan(probs), F.lit(False)))
    a = stats.rank_auc(p, "_m", F.col(truth) > 1, keys).withColumnRenamed("auc", "auc_move").drop("n_pos", "n_neg")
    b = stats.rank_auc(p.where(F.col(truth) > 1), "_s", F.col(truth) == 3, keys).withColumnRenamed("auc", "auc_side").drop("n_pos", "n_neg")
    good = p.groupBy(*keys).agg(F.min("_ok").alias("_ok"))
    out = a.join(b, keys, "left").join(good, keys)
    return out.select(*keys, *[F.when(F.col("_ok"), F.col(c)).alias(c) for c in ("auc_move", "auc_side")])


def feature_aucs(features: DataFrame, keys: list[str], positive: Column, column: str = "feature") -> DataFrame:
    """(keys, i, auc): discriminability of each element of a feature vector."""
    e = features.withColumn("_p", positive).select(*keys, "_p", F.posexplode(column).alias("i", "v"))
    return stats.rank_auc(e, "v", F.col("_p"), [*keys, "i"]).drop("n_pos", "n_neg")


def left_out_bias(features: DataFrame, passes: int = 2) -> list[float]:
    """Class biases from windows that their model hasn't seen: each block is answered by a model of the session's others."""
    f = features.where("homogeneous")
    folds = fusion.left_out_folds(f, "session_id", "block")
    models = fusion.grouped_fit(folds, ["session_id", "left_out"], "feature", "label", fit_slda)
    asked = fusion.applied(f.withColumn("left_out", F.col("block")), models, ["session_id", "left_out"], "feature").where("lp is not null")
    return fusion.calibrated(asked, "lp", "label", ["session_id"], passes)


def artefact_strength(eeg: DataFrame, segs: DataFrame, channel: str, band: tuple[float, float], fs: float = 250.0) -> DataFrame:
    """(session_id, start_sample, end_sample, label, db): power of a band in a segment against the session's rest, in dB.

    The band-pass runs both ways over whole recordings: an analysis, not part of the online path.
    """
    x = eeg.select("session_id", "sample", F.element_at("x", CHANNELS.index(channel) + 1).alias("v"))
    y = signal.filtered(x, ["session_id"], ["sample"], "v", filters.butterworth(4, band, fs), zero_phase=True)
    s = segs.where("label > 0").select("session_id", "start_sample", "end_sample", "label", (F.col("end_sample") - 1).alias("_last"))
    rows = sequence.range_join(y, s, ["session_id"], "sample", "start_sample", "_last", int(4 * fs))
    p = rows.groupBy("session_id", "start_sample", "end_sample", "label").agg(F.avg(F.col("filtered") * F.col("filtered")).alias("p"))
    rest = F.avg(F.when(F.col("label") == 1, F.col("p"))).over(Window.partitionBy("session_id"))
    return p.select("session_id", "start_sample", "end_sample", "label", S.to_decibel(F.col("p") / rest).alias("db"))


def stratified(predictions: DataFrame, strength: DataFrame, width: int = 2048) -> DataFrame:
    """Metrics per (session, group) of artefact strength, then means and numbers of sessions per group."""
    w = sequence.range_join(predictions, strength.select("session_id", F.col("start_sample").alias("s0"), F.col("end_sample").alias("s1"), "db"), ["session_id"], "start_sample", "s0", "s1", width).where("end_sample <= s1")
    m = scoring.metrics(w.withColumn("group", S.strength_group("db")), ["session_id", "group"], "y", "true_y")
    return m.groupBy("group").agg(F.avg("min_f1").alias("min_f1"), F.avg("macro_recall").alias("macro_recall"), F.count("*").alias("n"))


def spectra(eeg: DataFrame, channels: tuple[str, ...], fs: float = 250.0, size: int = 500) -> DataFrame:
    """(session_id, channel, label, freq, power): mean spectra of the samples of each class."""
    at = [CHANNELS.index(c) for c in channels]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("sample")
        x, state, out = np.stack(g["x"].to_numpy())[:, at], g["state"].to_numpy(), []
        for c in sorted(set(state.tolist()) - {0}):
            cut = np.flatnonzero(np.diff(np.concatenate([[0], (state == c).astype(int), [0]])))
            parts = [filters.welch(x[a:b], fs, size) for a, b in cut.reshape(-1, 2) if b - a >= size]
            if parts:
                p = np.mean([q for _, q in parts], axis=0)
                out += [(key[0], n, c, float(f), float(v)) for k, n in enumerate(channels) for f, v in zip(parts[0][0], p[:, k], strict=True)]
        return pd.DataFrame(out, columns=["session_id", "channel", "label", "freq", "power"])

    return eeg.groupBy("session_id").applyInPandas(run, "session_id string, channel string, label int, freq double, power double")


def class_ratios(spec: DataFrame) -> DataFrame:
    """(channel, label, freq, ratio): power against rest, log-averaged over sessions."""
    rest = spec.where("label = 1").select("session_id", "channel", "freq", F.col("power").alias("rest"))
    r = spec.where("label > 1").join(rest, ["session_id", "channel", "freq"])
    return r.groupBy("channel", "label", "freq").agg(F.exp(F.avg(F.ln(F.col("power") / F.col("rest")))).alias("ratio"))


def spectral_peaks(ratios: DataFrame, k: int = 6, width: int = 41) -> DataFrame:
    """The k frequencies per (channel, class) that stand out most from the moving mean of the log ratio."""
    keys = ["channel", "label"]
    r = ratios.withColumn("db", S.to_decibel("ratio"))
    r = r.withColumn("excess", F.col("db") - sequence.centred_mean("db", keys, ["freq"], width))
    return sequence.top_k(r, keys, [F.desc("excess"), "freq"], k).select(*keys, "freq", "excess", "rank")


def grand_average(nirs: DataFrame, before: int, after: int, column: str = "hbo") -> DataFrame:
    """(label, region, offset, mean, low, high): responses about segment starts less their baseline, over all epochs."""
    regions = F.explode(F.arrays_zip(F.array(*map(F.lit, NIRS_REGIONS)).alias("region"), signal.region_means(F.col(column), NIRS_REGIONS).alias("value"))).alias("r")
    rows = nirs.select("session_id", F.col("seq").alias("sample"), regions).select("session_id", "sample", "r.region", "r.value")
    starts = sequence.segments(nirs.withColumn("sample", F.col("seq")), ["session_id"], ["seq"], "state", index="seq").where("label > 0")
    ev = starts.select("session_id", F.col("start_sample").alias("at"), "label")
    names = F.broadcast(nirs.sparkSession.createDataFrame([(r,) for r in NIRS_REGIONS], "region string"))
    e = sequence.baseline_epochs(rows, ev.crossJoin(names).drop("label"), ["session_id", "region"], "value", before, after)
    e = e.join(ev, ["session_id", "at"])
    return e.groupBy("label", "region", "offset").agg(*stats.mean_band("value"))


def sign_check(nirs: DataFrame) -> DataFrame:
    """(session_id, sd_ratio, r): spread and mean correlation of the two species; r is negative if they are named rightly."""
    e = nirs.select("session_id", F.posexplode(F.arrays_zip("hbo", "hbr")).alias("c", "x"))
    g = e.groupBy("session_id", "c").agg((F.stddev_pop("x.hbo") / F.stddev_pop("x.hbr")).alias("q"), F.corr("x.hbo", "x.hbr").alias("r"))
    return g.groupBy("session_id").agg(F.median("q").alias("sd_ratio"), F.avg("r").alias("r"))


def compared(a: DataFrame, b: DataFrame, value: str = "score", subject: str = "subject") -> DataFrame:
    """Paired test of two runs by subject: mean difference, signed-rank statistic and p, over sessions both have."""
    one = lambda d, n: d.select("session_id", subject, F.col(value).alias(n))
    both = one(a, "_a").join(one(b, "_b").drop(subject), "session_id")
    per = both.groupBy(subject).agg(F.avg("_a").alias("a"), F.avg("_b").alias("b"))
    return per.agg(F.avg(F.col("a") - F.col("b")).alias("difference")).crossJoin(stats.wilcoxon(per, "a", "b"))


def control_correlations(per_session: DataFrame, control: DataFrame, value: str = "min_f1", column: str = "db") -> DataFrame:
    """Rank correlation, its p, and regression of a metric on a control variable per session; sessions without one don't count."""
    j = per_session.join(control.groupBy("session_id").agg(F.median(column).alias("c")), "session_id").where("c is not null")
    rho = stats.spearman(j, "c", value)
    return rho.withColumn("p", stats.correlation_p(F.col("rho"), F.col("n"))).crossJoin(stats.ols(j, "c", value).drop("n"))


def experiment_summary(documents: DataFrame) -> DataFrame:
    """Session documents (files.metric_documents, with a `config` column) to one row per configuration and its change."""
    g = documents.groupBy("config").agg(F.avg("hybrid.min_f1").alias("min_f1"), F.avg("hybrid.macro_recall").alias("macro_recall"), F.avg("nirs_only.min_f1").alias("nirs_min_f1"), F.count("*").alias("sessions"))
    return g.withColumn("delta", scoring.delta(g, ["config"], "min_f1"))

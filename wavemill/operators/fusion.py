"""Fusion of class log-probabilities, smoothing over time and calibration of class biases, as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import argmax_first, asum, col, dot, log_softmax
from . import sequence
from .scoring import CLASSES

GRID = [round(-1.5 + 0.1 * k, 1) for k in range(31)]


def log_linear(le: Column | str, ln: Column | str, w: float) -> Column:
    """log_softmax(w le + (1 - w) ln); le alone where the second is null."""
    le, ln = col(le), col(ln)
    return F.when(ln.isNull(), le).otherwise(log_softmax(F.zip_with(le, ln, lambda a, b: w * a + (1 - w) * b)))


def average(le: Column | str, ln: Column | str) -> Column:
    le, ln = col(le), col(ln)
    return F.when(ln.isNull(), le).otherwise(F.zip_with(le, ln, lambda a, b: F.ln(0.5 * (F.exp(a) + F.exp(b)) + 1e-12)))


def stacked(le: Column | str, ln: Column | str, model: dict, w: float) -> Column:
    """A linear model over both log-probability vectors; log-linear fusion where one is missing."""
    le, ln = col(le), col(ln)
    return F.when(ln.isNull(), le).when(F.size(F.concat(le, ln)) == len(model["mu"]), linear_log_prob(F.concat(le, ln), model)).otherwise(log_linear(le, ln, w))


def linear_log_prob(x: Column | str, model: dict) -> Column:
    """log_softmax(((x - mu) / sd) w' + b) with the model's numbers as literals."""
    arr = lambda v: F.array(*[F.lit(float(a)) for a in v])
    z = F.zip_with(F.zip_with(col(x), arr(model["mu"]), lambda a, m: a - m), arr(model["sd"]), lambda a, s: a / s)
    return log_softmax(F.array(*[dot(z, arr(row)) + float(b) for row, b in zip(model["w"], model["b"], strict=True)]))


def mixed(session: Column | str, other: Column | str, n_blocks: Column | str, k: float) -> Column:
    """Weight k / (k + n_blocks) on the cross-subject model; with k infinite, that alone; either alone if the other is null."""
    s, g = col(session), col(other)
    w = F.lit(1.0) if k == float("inf") else F.lit(float(k)) / (k + col(n_blocks))
    both = log_softmax(F.zip_with(s, g, lambda a, b: (1 - w) * a + w * b))
    return F.when(s.isNull(), g).when(g.isNull(), s).otherwise(both)


def nearest_mean_log_prob(x: Column | str, means: Column | str, t: float = 1.0) -> Column:
    """-|x - mean|^2 / t for an array of class means, normalised."""
    x = col(x)
    return log_softmax(F.transform(col(means), lambda m: -asum(F.transform(F.arrays_zip(x.alias("a"), m.alias("b")), lambda p: (p["a"] - p["b"]) * (p["a"] - p["b"]))) / t))


def smoothed(df: DataFrame, keys: list[str], order: str, probs: str, tau: float, rate: float = 4.0, space: str = "log") -> DataFrame:
    """Log-probabilities averaged over calls, a = exp(-1 / (tau * rate)), in `log` space (normalised again) or `prob` space;
    tau 0 leaves them. Normalising only shifts all classes alike, so one linear pass per session and one at the end suffice."""
    if not tau:
        return df
    x = F.col(probs) if space == "log" else F.transform(probs, F.exp)
    out = sequence.ema(df.withColumn("_x", x), keys, [order], "_x", float(np.exp(-1.0 / (tau * rate))), "_y")
    y = log_softmax("_y") if space == "log" else F.transform("_y", lambda p: F.ln(p + 1e-9))
    return out.withColumn(probs, y).drop("_x", "_y")


def biased_label(probs: Column | str, bias: Column | str) -> Column:
    """The class with the largest log-probability plus bias, the first of equals."""
    return argmax_first(F.zip_with(col(probs), col(bias), lambda p, b: p + b))


def shrunk(session: Column | str, prior: Column | str, n: Column | str, k: float, fixed: Column | str | None = None) -> Column:
    """lambda * session + (1 - lambda) * prior, lambda = n / (n + k), plus a fixed bias."""
    lam = col(n) / (col(n) + k)
    out = F.zip_with(col(session), col(prior), lambda s, g: lam * s + (1 - lam) * g)
    return out if fixed is None else F.zip_with(out, col(fixed), lambda a, b: a + b)


def bias_scores(df: DataFrame, candidates: DataFrame, probs: str, truth: str, groups: list[str], which: str = "min_f1") -> DataFrame:
    """(candidate columns, value): mean over groups of min F1 (or macro recall) for each row of candidates (`bias`).

    Candidates are a few dozen rows and broadcast; counts are combined before the shuffle.
    """
    ids = candidates.columns
    rows = df.select(*groups, truth, probs).crossJoin(F.broadcast(candidates))
    y = biased_label(probs, "bias")
    cells = []
    for c in CLASSES:
        cells += [F.sum(((y == c) & (F.col(truth) == c)).cast("long")).alias(f"tp{c}"), F.sum((y == c).cast("long")).alias(f"r{c}"), F.sum((F.col(truth) == c).cast("long")).alias(f"c{c}")]
    g = rows.where(F.col(truth).isin(*CLASSES)).groupBy(*ids, *groups).agg(*cells)
    if which == "min_f1":
        v = F.least(*[F.when(F.col(f"r{c}") + F.col(f"c{c}") > 0, 2.0 * F.col(f"tp{c}") / (F.col(f"r{c}") + F.col(f"c{c}"))).otherwise(0.0) for c in CLASSES])
    else:
        v = reduce(lambda a, b: a + b, [F.when(F.col(f"c{c}") > 0, F.col(f"tp{c}") / F.col(f"c{c}")).otherwise(0.0) for c in CLASSES]) / 3
    return g.withColumn("value", v).groupBy(*ids).agg(F.avg("value").alias("value"))


def calibrated(df: DataFrame, probs: str, truth: str, groups: list[str], passes: int = 2, grid: list[float] = GRID) -> list[float]:
    """Biases (0, b2, b3) by coordinate descent on min F1; equals within 1e-12 go to the smallest |b|, then the first."""
    spark, bias = df.sparkSession, [0.0, 0.0, 0.0]
    for _ in range(passes):
        for c in (1, 2):
            options = [[*bias[:c], g, *bias[c + 1 :]] for g in grid]
            cand = spark.createDataFrame([(k, o) for k, o in enumerate(options)], "k int, bias array<double>")
            got = bias_scores(df, cand, probs, truth, groups).collect()  # one row per grid point
            top = max(r["value"] for r in got)
            k = min((abs(grid[r["k"]]), r["k"]) for r in got if r["value"] >= top - 1e-12)[1]
            bias[c] = grid[k]
    return bias


def fitted_weight(df: DataFrame, le: str, ln: str, truth: str, groups: list[str], weights: tuple = (0.6, 0.7, 0.8, 0.9, 1.0)) -> dict:
    """The fusion weight and biases that give the largest 60 * min F1 + 30 * macro recall; the first of equals."""
    best: dict = {}
    for w in weights:
        fused = df.withColumn("_f", log_linear(le, ln, w))
        bias = calibrated(fused, "_f", truth, groups)
        cand = df.sparkSession.createDataFrame([(bias,)], "bias array<double>")
        f1 = bias_scores(fused, cand, "_f", truth, groups).first()["value"]
        recall = bias_scores(fused, cand, "_f", truth, groups, "recall").first()["value"]
        value = 60 * f1 + 30 * recall
        if not best or value > best["value"] + 1e-12:
            best = {"w": w, "bias": bias, "value": value}
    return best


def cascade_log_prob(x: Column | str, first: dict, second: dict) -> Column:
    """Rest against movement, then one side against the other, by two linear scores: log-probabilities of the three classes.

    `first` scores rest, `second` the third class, as mu, sd, w and b of one row each.
    """
    arr = lambda v: F.array(*[F.lit(float(a)) for a in v])

    def score(m: dict) -> Column:
        z = F.zip_with(F.zip_with(col(x), arr(m["mu"]), lambda a, b: a - b), arr(m["sd"]), lambda a, b: a / b)
        return dot(z, arr(m["w"])) + float(m["b"])

    soft = lambda z: -(F.greatest(-z, F.lit(0.0)) + F.ln(1 + F.exp(-F.abs(z))))  # noqa: E731 (log of the logistic curve)
    rest, side = score(first), score(second)
    return F.array(soft(rest), soft(-rest) + soft(-side), soft(-rest) + soft(side))


def normalised_logits(df: DataFrame, keys: list[str], logits: str, t: float = 1.0) -> DataFrame:
    """Logits of each row less their mean, over the standard deviation of all of a key's and t."""
    centred = F.transform(logits, lambda z: z - asum(F.col(logits)) / F.size(logits))
    rows = df.withColumn(logits, centred)
    sd = rows.select(*keys, F.explode(logits).alias("_z")).groupBy(*keys).agg(F.stddev_pop("_z").alias("_sd"))
    s = F.when(F.col("_sd") * t > 1e-12, F.col("_sd") * t).otherwise(F.lit(1.0))
    return rows.join(sd, keys).withColumn(logits, F.transform(logits, lambda z: z / s)).drop("_sd")


def left_out_folds(df: DataFrame, session: str, block: str) -> DataFrame:
    """Each row once for every block of its session but its own: the training rows of (session, left_out)."""
    blocks = df.select(session, F.col(block).alias("left_out")).distinct()
    return df.join(blocks, session).where(F.col(block) != F.col("left_out"))


def grouped_fit(df: DataFrame, keys: list[str], x: str, y: str, fit) -> DataFrame:
    """(keys, mu, sd, w, b): a linear model per group by `fit`; groups without a model are absent. A group is one session's
    labelled windows, some thousands at most."""
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        m = fit(np.stack(g[x].to_numpy()).astype(float), g[y].to_numpy())
        rows = [] if m is None else [(*key, m["mu"].tolist(), m["sd"].tolist(), m["w"].tolist(), m["b"].tolist())]
        return pd.DataFrame(rows, columns=[*keys, "mu", "sd", "w", "b"])

    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(run, f"{key_types}, mu array<double>, sd array<double>, w array<array<double>>, b array<double>")


def applied(df: DataFrame, models: DataFrame, keys: list[str], x: str, name: str = "lp") -> DataFrame:
    """Adds the log-probabilities of each row's model; null where its group has none."""
    j = df.join(models, keys, "left")
    z = F.zip_with(F.zip_with(F.col(x), F.col("mu"), lambda a, m: a - m), F.col("sd"), lambda a, s: a / s)
    logits = F.transform(F.arrays_zip("w", "b"), lambda r: asum(F.zip_with(r["w"], z, lambda a, b: a * b)) + r["b"])
    return j.withColumn(name, F.when(F.col("mu").isNotNull(), log_softmax(logits))).drop("mu", "sd", "w", "b")

"""The fitted stack against one numpy fit per fold and a plain search for biases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import classify
from wavemill.operators import fusion, stacking

GRID = np.asarray(fusion.GRID)


def log_softmax(z):
    return z - np.logaddexp.reduce(z, axis=1, keepdims=True)


def answers(m, x):
    return log_softmax((x - m["mu"]) / m["sd"] @ np.asarray(m["w"]).T + m["b"])


def min_f1(pred, y, g):
    out = []
    for s in np.unique(g):
        p, t = pred[g == s], y[g == s]
        out.append(min((2 * ((p == c) & (t == c)).sum() / max(1, (p == c).sum() + (t == c).sum())) for c in (1, 2, 3)))
    return float(np.mean(out))


def biases(lp, y, g):
    b = np.zeros(3)
    for _ in range(2):
        for c in (1, 2):
            tries = []
            for k, v in enumerate(GRID):
                o = b.copy()
                o[c] = v
                tries.append((min_f1(np.argmax(lp + o, axis=1) + 1, y, g), -abs(v), -k))
            top = max(t[0] for t in tries)
            b[c] = GRID[-max(t[1:] for t in tries if t[0] >= top - 1e-12)[1]]
    return b


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    n = 480
    y, sub = rng.integers(1, 4, n), np.array([f"N{k % 4}" for k in range(n)])
    le = log_softmax(rng.normal(size=(n, 3)) + 1.2 * np.eye(3)[y - 1])
    ln = log_softmax(rng.normal(size=(n, 3)) + 0.7 * np.eye(3)[(y % 3)])  # right about a shifted class: only a fit can use it
    return y, sub, np.array([f"s{k % 8}" for k in range(n)]), le, ln


def frame(spark, data, extra=()):
    y, sub, g, le, ln = data
    rows = [(k, str(sub[k]), str(g[k]), int(y[k]), le[k].tolist(), ln[k].tolist(), "x") for k in range(len(y))]
    return spark.createDataFrame([*rows, *extra], "id long, subject string, session string, t int, a array<double>, b array<double>, label string").repartition(5)


ODD = [
    (900, "N0", "s0", 1, [0.0, 0.0, 0.0], None, "x"),
    (901, "N0", "s0", 1, None, [0.0, 0.0, 0.0], "x"),
    (902, "N0", "s0", 9, [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], "x"),
    (903, "N0", "s0", None, [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], "x"),
    (904, "N0", "s0", 2, [0.0, float("nan"), 0.0], [0.0, 0.0, 0.0], "x"),
    (905, "N0", "s0", 2, [0.0, None, 0.0], [0.0, 0.0, 0.0], "x"),
]


def test_unseen_answers_equal_a_fit_per_subject(spark, data):
    y, sub, _, le, ln = data
    x = np.hstack([le, ln])
    got = {r.id: r for r in stacking.unseen(frame(spark, data, ODD), "a", "b", "t", "subject", 0.5).collect()}
    assert set(got) == set(range(len(y)))  # odd rows have no answer, and teach nothing
    for s in np.unique(sub):
        m = classify.fit_logistic(x[sub != s], y[sub != s], 0.5)
        want = answers(m, x[sub == s])
        np.testing.assert_allclose([got[k].stacked for k in np.flatnonzero(sub == s)], want, atol=1e-5)
    assert got[0].label == "x"


def test_fitted_stack_equals_numpy(spark, data):
    y, sub, g, le, ln = data
    x = np.hstack([le, ln])
    best = None
    for c in (0.1, 1.0):
        lp = np.zeros((len(y), 3))
        for s in np.unique(sub):
            lp[sub == s] = answers(classify.fit_logistic(x[sub != s], y[sub != s], c), x[sub == s])
        b = biases(lp, y, g)
        value = min_f1(np.argmax(lp + b, axis=1) + 1, y, g)
        if best is None or value > best[0]:
            best = (value, c)
    m = classify.fit_logistic(x, y, best[1])
    got = stacking.fitted(frame(spark, data, ODD), "a", "b", "t", ["session"], "subject")
    assert got["c"] == best[1] and got["value"] == pytest.approx(best[0], abs=1e-9)
    np.testing.assert_allclose(answers({k: np.asarray(got[k]) for k in ("mu", "sd", "w", "b")}, x), answers(m, x), atol=1e-5)
    assert got["bias"] == biases(answers(m, x), y, g).tolist()
    stack = frame(spark, data, ODD).withColumn("f", fusion.stacked("a", "b", got, 0.8))
    hit = stack.where("id < 900").select(F.avg((fusion.biased_label("f", F.array(*map(F.lit, got["bias"]))) == F.col("t")).cast("int"))).first()[0]
    assert hit > (np.argmax(le, axis=1) + 1 == y).mean()  # better than the first alone
    assert stack.where("id = 900").first().f is not None  # one classifier alone


def test_too_little_to_learn_from(spark, data):
    df = frame(spark, data)
    assert stacking.fitted(df.limit(0), "a", "b", "t", ["session"], "subject") is None
    assert stacking.fitted(df.where("t < 3"), "a", "b", "t", ["session"], "subject") is None
    assert stacking.unseen(df.limit(0), "a", "b", "t", "subject").count() == 0
    alone = stacking.fitted(df.where("subject = 'N0'"), "a", "b", "t", ["session"], "subject")
    assert alone["c"] == 0.1 and alone["value"] is None  # no other subjects: the first penalty

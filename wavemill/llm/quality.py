"""Quality from graded ratings by ordinal cumulative-link regression on hashed text.

P(grade <= k) = logistic(threshold_k - w . x) with one weight vector and ordered thresholds. x holds which hashed byte
1- to 3-grams occur in a text, each as a share of those that do, and steps of its shape: the shares of words that repeat the word before, of words that
occurred before, of lines that did, and the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, lean, small_batches, texts

#: Rated rows that the fit looks at, at most (in expectation), and slots of them that it unfolds at once.
FIT_ROWS, FIT_SLOTS = 5_000, 1 << 18
#: Grades that a scale may have: each is a threshold of the model.
LARGEST_SCALE = 100
TWO, THREE = 1 << 11, 1 << 12
SHAPE = 256 + TWO + THREE
#: One-hot steps of each shape share, and of the number of words; grams of a text with few of them count less by this many.
STEPS, SHORT = 8, 64
WIDTH = SHAPE + 4 * STEPS
_M2, _M3 = np.uint32(2654435761), np.uint32(2246822519)


def slots(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the 1-, 2- and 3-grams that occur in a text, and of its shape."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    two = ((b[:-1] * np.uint32(257) + b[1:]) * _M2 >> np.uint32(21)) + np.uint32(256)
    three = ((b[:-2] * np.uint32(66049) + b[1:-1] * np.uint32(257) + b[2:]) * _M3 >> np.uint32(20)) + np.uint32(256 + TWO)
    words, lines = text.split(), text.split("\n")
    n, m = max(1, len(words)), max(1, len(lines))
    shares = (sum(map(str.__eq__, words, words[1:])) / n, 1 - len(set(words)) / n if words else 0.0, 1 - len(set(lines)) / m)
    # Square roots: a few per cent of repeats already tell.
    steps = [int((STEPS - 1) * x**0.5 + 0.5) for x in shares] + [min(STEPS - 1, len(words).bit_length() // 2)]
    b, two, three = (np.flatnonzero(np.bincount(x)) for x in (b, two, three))  # which grams occur: a repeated word counts once
    return b, two, three, np.array([SHAPE + k * STEPS + x for k, x in enumerate(steps)], dtype=np.int32)


def score_text(text: str, w: np.ndarray) -> float:
    b, two, three, shape = slots(text)
    return float(sum(w[x].sum() / (len(x) + SHORT) for x in (b, two, three)) + w[shape].sum())


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    *grams, shape = slots(text)
    share = [np.full(len(x), 1 / (len(x) + SHORT), dtype=np.float32) for x in grams]
    return np.concatenate([*grams, shape]).astype(np.uint16), np.concatenate([*share, np.ones(len(shape), dtype=np.float32)])


@lean
def sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 4 << 20):
        x = [sparse(t) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.tobytes() for a, _ in x], pa.binary()), pa.array([v.tobytes() for _, v in x], pa.binary())], ["doc_id", "y", "at", "v"])


def fit_ordinal(at: list[np.ndarray], v: list[np.ndarray], y: np.ndarray, width: int = WIDTH, steps: int = 200, ridge: float = 1e-2) -> dict:
    """Weights and thresholds; y are ranks 0..K-1 of the grades. Grades count alike, however many rows they have.

    Columns are scaled by their root mean square for the descent and the weights scaled back. Each step goes over the rows in
    blocks of about FIT_SLOTS slots, so that besides `at` and `v` only a block's worth of memory is taken.
    """
    n, k = len(y), int(y.max()) + 1
    size = np.array([len(a) for a in at])
    ends = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // FIT_SLOTS)) + 1).tolist(), n]
    rows = [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]
    scale = np.sqrt(sum(np.bincount(np.concatenate(at[b]), np.concatenate(v[b]).astype(np.float64) ** 2, width) for b in rows) / n) + 1e-4
    share = 1 / (k * np.maximum(1, np.bincount(y, minlength=k)))[y]
    theta = np.concatenate([np.zeros(width), [-1.0], np.zeros(max(0, k - 2))])
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        w, gaps = theta[:width], np.exp(theta[width + 1 :])
        cuts = theta[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        by, f = w / scale, np.zeros(n)
        for b in rows:
            f[b] = np.bincount(np.repeat(np.arange(b.stop - b.start), size[b]), by[np.concatenate(at[b])] * np.concatenate(v[b]), b.stop - b.start)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        up, low = sigmoid(edges[y + 1] - f), sigmoid(edges[y] - f)
        up[y == k - 1], low[y == 0] = 1.0, 0.0
        p = np.maximum(up - low, 1e-9)
        du, dl = up * (1 - up), low * (1 - low)
        gf = share * (du - dl) / p
        gcut = np.zeros(k - 1)
        for c in range(k - 1):
            gcut[c] = -(share * du / p)[y == c].sum() + (share * dl / p)[y == c + 1].sum()
        gw = sum(np.bincount(np.concatenate(at[b]), np.repeat(gf[b], size[b]) * np.concatenate(v[b]), width) for b in rows) / scale
        g = np.concatenate([gw + ridge * w, [gcut.sum()], [gcut[c + 1 :].sum() * gaps[c] for c in range(k - 2)]])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    gaps = np.exp(theta[width + 1 :])
    cuts = theta[width] + np.concatenate([[0.0], np.cumsum(gaps)])
    return {"w": theta[:width] / scale, "cuts": cuts}


def ranked_grades(ratings: DataFrame, grade: str) -> tuple[DataFrame, list[float], list[int]]:
    """(doc_id, rank) of rated documents, the value of each rank, and how many documents have it.

    Grades are numbers of any kind; a document's lowest counts; null, NaN and infinite ones are no rating. A scale of more than
    LARGEST_SCALE grades is cut at its percentiles into as many ranks, whose values are their means.
    """
    y = ratings.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(grade).cast("double").alias("y"))
    y = y.where("y is not null and not isnan(y) and abs(y) < double('inf')").groupBy("doc_id").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).limit(LARGEST_SCALE + 1).collect()}
    if len(counts) <= LARGEST_SCALE:
        values = sorted(counts)
        rank = F.array_position(F.array(*map(F.lit, values)), F.col("y")) - 1 if values else F.lit(0)
        return y.select("doc_id", rank.cast("long").alias("rank")), values, [counts[v] for v in values]
    cuts = y.agg(F.percentile_approx("y", [k / LARGEST_SCALE for k in range(1, LARGEST_SCALE)], 10_000)).first()[0]
    cuts = F.array(*map(F.lit, sorted(set(cuts))))
    y = y.withColumn("step", F.size(F.filter(cuts, lambda c: c < F.col("y"))))
    steps = sorted(tuple(r) for r in y.groupBy("step").agg(F.avg("y"), F.count("*")).collect())  # LARGEST_SCALE rows at most
    rank = F.array_position(F.array(*[F.lit(s) for s, _, _ in steps]), F.col("step")) - 1
    return y.select("doc_id", rank.cast("long").alias("rank")), [v for _, v, _ in steps], [n for _, _, n in steps]


@lean
def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the rows of a partition: the ranks found, and weights and thresholds if they are two or more."""
    ys, at, v = [], [], []
    for batch in batches:
        ys += batch.column(1).to_pylist()
        at += [np.frombuffer(x, dtype=np.uint16) for x in batch.column(2).to_pylist()]
        v += [np.frombuffer(x, dtype=np.float32) for x in batch.column(3).to_pylist()]
    found = sorted(set(ys))
    m = fit_ordinal(at, v, np.searchsorted(found, ys)) if len(found) > 1 else {"w": np.zeros(WIDTH), "cuts": np.zeros(0)}
    yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.int64())), *(pa.array([m[x].tobytes()], pa.binary()) for x in ("w", "cuts"))], ["found", "w", "cuts"])


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "quality", most: int = FIT_ROWS) -> dict:
    """The model from rated rows (as ranked_grades reads them), `most` of them at most in expectation.

    With fewer than two grades nothing can be learned: every text then has the only grade (or none). Slots are found where the
    texts lie and one task fits them, in an order that their number of partitions doesn't change; the driver gets the model only.
    """
    small_batches(docs.sparkSession)
    y, values, counts = ranked_grades(ratings, grade)
    if len(values) < 2:
        return {"grades": values, "w": np.zeros(WIDTH), "cuts": np.zeros(0)}
    each = most / len(values)
    picked = F.lit(False)
    for k, n in enumerate(counts):
        picked = picked | ((F.col("rank") == k) & (F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < int(1_000_000 * min(1, each / n))))
    # At most twice the bound, so that it can go to all tasks; texts of other rows are never shuffled.
    some = y.where(picked).orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(2 * most)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", F.col("rank").alias("y"))
    rows = rows.mapInArrow(sparse_rows, "doc_id long, y long, at binary, v binary").repartition(1).sortWithinPartitions("doc_id", "y", "at")
    x = rows.mapInArrow(fitted, "found array<long>, w binary, cuts binary").first()
    found = x["found"] if x else []  # grades whose documents aren't in `docs` are no grades here
    w, cuts = (np.frombuffer(x[c], dtype=np.float64) for c in ("w", "cuts")) if x else (np.zeros(WIDTH), np.zeros(0))
    return {"grades": [values[k] for k in found], "w": w, "cuts": cuts}


def scored(model: dict):
    w = model["w"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([score_text(t, w) for t in texts(batch)], pa.float64())], [*batch.schema.names[:-1], "f"])

    return run


def _graded(f: F.Column, model: dict) -> tuple[F.Column, F.Column]:
    """Expected grade and the probability of more than the lowest grade."""
    grades, cuts = model["grades"], [float(c) for c in model["cuts"]]
    if len(grades) < 2:
        return F.lit(float(grades[0]) if grades else None).cast("double"), F.lit(1.0)
    above = [1 / (1 + F.exp(F.lit(c) - f)) for c in cuts]  # P(grade > k)
    expected = F.lit(float(grades[0]))
    for k, p in enumerate(above):
        expected = expected + p * float(grades[k + 1] - grades[k])
    return expected, above[0]


def grades(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of more than the lowest grade), kept (tail_probability >= least).

    Null and empty texts are scored as texts without grams. Other columns are ignored; every row gives one row.
    """
    small_batches(docs.sparkSession)
    f = docs.select("doc_id", "text").mapInArrow(scored(model), "doc_id long, f double")
    expected, tail = _graded(F.col("f"), model)
    return f.select("doc_id", expected.alias("expected_grade"), tail.alias("tail_probability"), (tail >= least).alias("kept"))


def accepted(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of `docs` that are not rejected; columns as given, nothing shuffled."""
    small_batches(docs.sparkSession)
    w = model["w"]
    names = docs.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = model["cuts"]
        for batch in by_bytes(batches):
            if not len(cuts):
                yield batch
                continue
            f = np.array([score_text(t, w) for t in texts(batch)])
            yield batch.filter(pa.array(1 / (1 + np.exp(np.clip(cuts[0] - f, -50, 50))) >= least))

    return docs.select(names).mapInArrow(run, docs.schema)

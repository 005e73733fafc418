"""Toxicity from a weighted lexicon, matched by Aho-Corasick over folded text.

Text is folded to plain lower-case words: compatibility forms, accents, look-alike letters of other scripts, digits and signs
that stand for letters. The lexicon holds whole words and word beginnings with weights, learned from labelled rows as log
odds; phrases that hold a lexicon entry but are common in clean rows are exceptions and hide it. The score is a logistic
curve over the weight per word and the total weight, fitted on the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, small_batches, staged, texts

#: Labelled rows that the fit looks at, at most (in expectation).
FIT_ROWS = 20_000
#: Toxic rows that a term is in, and its log odds less a standard error, at least.
LEAST_DOCS = 5
LEAST_LOG_ODDS = 2.0
PREFIXES = (4, 5, 6)

# Look-alikes of Latin letters in Cyrillic and Greek, digits and signs read as letters, l and i as one.
ALIKE = dict(zip("авесԁһіјкӏмпорԛѕтѵхузԝɡοαερνικτυωχηβμ", "abecdhijklmnopqstvxyzwgoaepvıktywxnbu", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}
_SIGN = re.compile(r"(?<=[^\W_])[@$!|€£](?=[^\W_])")


class _Fold(dict):
    """str.translate table, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKD", chr(code).lower())
        c = "".join(x for x in c if not unicodedata.combining(x))
        c = "".join(DIGITS.get(x) or ALIKE.get(x) or (x if x.isalnum() else " ") for x in c) if c else ""
        self[code] = out = c.replace("ı", "i").replace("l", "i")
        return out


_fold = _Fold()


def fold(text: str) -> str:
    """Words with one space around each."""
    text = unicodedata.normalize("NFC", text) if not text.isascii() else text
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    words = " ".join(text.translate(_fold).split())
    return f" {words} " if words else " "


def terms(folded: str) -> set[str]:
    """Patterns a document has: ' word ' and ' beginning'."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) >= n}


def counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 8 << 20):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for t, y in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
            seen[y].update(terms(fold(t)))
        # Clean counts go out too: another batch may have the term in its toxic rows.
        rows = [(k, seen[1][k], seen[0][k]) for k in {*seen[1], *seen[0]}]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["term", "bad", "good"])


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = ()):
        self.machine = ahocorasick.Automaton()
        for t, w in weights.items():
            self.machine.add_word(t, (w, len(t)))
        for e in exceptions:
            key = fold(e)
            self.machine.add_word(key, (None, len(key)))
        if len(self.machine):
            self.machine.make_automaton()

    def measure(self, text: str) -> tuple[float, int, int]:
        """Total weight (one entry, the heaviest, for each word), words, matched words."""
        line = fold(text)
        n = line.count(" ") - 1
        if not len(self.machine) or n <= 0:
            return 0.0, max(n, 0), 0
        best: dict[int, float] = {}
        hidden: list[tuple[int, int]] = []
        for end, (w, size) in self.machine.iter(line):
            at = end - size + 1
            if w is None:
                hidden.append((at, end))
            else:
                best[at] = max(w, best.get(at, 0.0))
        if hidden:
            best = {p: w for p, w in best.items() if not any(a <= p < b for a, b in hidden)}
        return sum(best.values()), n, len(best)


def features(total: float, words: int) -> tuple[float, float]:
    return math.log1p(100 * total / words) if words else 0.0, math.log1p(total)


def measured(weights: dict, exceptions: tuple, label: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights, exceptions)
        for batch in by_bytes(batches):
            x = [features(*lexicon.measure(t)[:2]) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0 if not label else 1), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], ["y" if label else "doc_id", "a", "b"])

    return run


def neighbours(weights: dict):
    """Two-word phrases with a lexicon entry, with the label of their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for batch in by_bytes(batches, 8 << 20):
            seen: dict[str, list[int]] = {}
            for t, y in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                line = fold(t)
                places = {end - size + 1 for end, (_, size) in lexicon.machine.iter(line)} if len(lexicon.machine) else ()
                found = set()
                for at in places:
                    before, after = line[: at + 1].rsplit(None, 1), line[at + 1 :].split(None, 2)
                    if after:
                        found.update([f"{before[-1]} {after[0]}"] if before else [])
                        found.update([f"{after[0]} {after[1]}"] if len(after) > 1 and after[1] != " " else [])
                for p in found:
                    seen.setdefault(p.strip(), [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["phrase", "bad", "good"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a small ridge-penalised logistic regression; x has a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), most: int = FIT_ROWS) -> dict:
    """Lexicon, exceptions and curve from rows with a label, `most` of them at most in expectation.

    A label above 0 marks a toxic text, one of 0 or less a clean one; null and NaN are no label. Repeated labels of a doc_id count
    once, the largest of them. Without both labels the lexicon is empty and the score constant.
    """
    small_batches(docs.sparkSession)
    marks = labels.where("doc_id is not null and toxic is not null and not isnan(cast(toxic as double))")
    y = marks.groupBy("doc_id").agg(F.max((F.col("toxic").cast("double") > 0).cast("int")).alias("y"))
    total = y.count()
    if total > most:
        y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * most / total))
    # At most twice the bound, so that it can go to all tasks; texts of other rows are never shuffled.
    some = y.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(2 * most)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "y")
    rows = staged(rows)
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {"weights": {}, "exceptions": exceptions, "curve": [0.0, 0.0, -20.0 if not bad else 20.0]}
    found = rows.mapInArrow(counted_terms, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    doubt = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    least = min(LEAST_DOCS, max(3, bad // 20))
    top = found.where(F.col("bad") >= least).withColumn("w", odds - doubt).where(F.col("w") >= LEAST_LOG_ODDS)
    top = top.collect()  # terms of several sampled toxic rows each: bounded by the sample's words
    weights: dict[str, float] = {}
    for r in sorted(top, key=lambda r: (len(r["term"].strip()), r["term"])):
        t = r["term"].strip()
        if not any(f" {t[:n]}" in weights for n in PREFIXES if n <= len(t)):  # a beginning stands for its words
            weights[r["term"]] = float(r["w"])
    pairs = rows.mapInArrow(neighbours(weights), "phrase string, bad long, good long").groupBy("phrase").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    clean = pairs.where("good >= 3 and good > 4 * bad").orderBy("phrase").collect()  # phrases about entries in sampled rows
    exceptions = (*exceptions, *(r["phrase"] for r in clean))
    x = rows.mapInArrow(measured(weights, exceptions, True), "y int, a double, b double").toPandas()
    w = logistic(np.column_stack([x["a"], x["b"], np.ones(len(x))]), x["y"].to_numpy(dtype=float))
    return {"weights": weights, "exceptions": exceptions, "curve": w.tolist()}


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted for every row. Null and empty texts have no weight and get the curve's lowest score."""
    small_batches(docs.sparkSession)
    a, b, c = model["curve"]
    m = docs.select("doc_id", "text").mapInArrow(measured(model["weights"], model["exceptions"], False), "doc_id long, a double, b double")
    score = 1 / (1 + F.exp(-(F.col("a") * a + F.col("b") * b + c)))
    return m.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labelled rows that are not held out."""
    model = fit(docs, labels.where(~held_out()))
    out = scores(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")

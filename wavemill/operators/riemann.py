"""Riemannian means and nearest means of positive definite matrices over rows, in rounds of grouped sums.

A round whitens every matrix by its group's present centre, takes logarithms where the rows lie, and adds them up by group; the
centre moves along their mean. No group is ever in one task, and what passes between rounds is one centre for each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spd
from ..sources import files
from .moments import matrix, vector_sums


def _logs(p: int):
    return lambda x: spd.log(x.reshape(-1, p, p)).reshape(len(x), -1)


def _whitened_logs(p: int):
    """Of rows (matrix, centre) in one vector: the logarithm of the matrix seen from the centre."""

    def of(x: np.ndarray) -> np.ndarray:
        m, c = x[:, : p * p].reshape(-1, p, p), x[:, p * p :].reshape(-1, p, p)
        return spd.log(spd.congruence(spd.inv_sqrt(c), m)).reshape(len(x), -1)

    return of


def means(df: DataFrame, keys: list[str], column: str, p: int, rounds: int = 20, tol: float = 1e-6) -> DataFrame:
    """(keys, n, centre, step): the Riemannian mean of the flattened p x p matrices of each key, from their log-Euclidean mean, until
    every key's last step is below `tol` in norm or `rounds` are over. Rows without a matrix don't count."""
    rows = files.kept(df.select(*keys, F.col(column).cast("array<double>").alias("_m")).where("_m is not null"))

    @F.pandas_udf("array<double>")
    def begun(total: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([spd.exp(np.reshape(t, (p, p)) / k).ravel() for t, k in zip(total, n, strict=True)])

    @F.pandas_udf("array<double>")
    def moved(centre: pd.Series, total: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([spd.congruence(spd.sqrt(np.reshape(c, (p, p))), spd.exp(np.reshape(t, (p, p)) / k)).ravel() for c, t, k in zip(centre, total, n, strict=True)])

    at = vector_sums(rows, keys, "_m", _logs(p)).withColumn("centre", begun("total", "n")).select(*keys, "n", "centre", F.lit(None).cast("double").alias("step"))
    at = files.kept(at)
    for _ in range(rounds):
        seen = rows.join(at.select(*keys, "centre"), keys) if keys else rows.crossJoin(F.broadcast(at.select("centre")))
        step = vector_sums(seen, keys, F.concat("_m", "centre"), _whitened_logs(p)).drop("n")
        both = at.drop("step").join(step, keys) if keys else at.drop("step").crossJoin(step)
        norm = F.sqrt(F.aggregate("total", F.lit(0.0), lambda a, v: a + v * v)) / F.col("n")
        at = files.kept(both.select(*keys, "n", moved("centre", "total", "n").alias("centre"), norm.alias("step")))
        if (at.agg(F.max("step")).first()[0] or 0.0) < tol:
            break
    return at


def distances(df: DataFrame, centres: DataFrame, name: str, column: str, p: int) -> DataFrame:
    """Adds d2, an array of squared affine-invariant distances to each row of `centres` (name, centre) in the order of name: a
    model's few matrices, which go along with every task."""
    model = [np.reshape(r["centre"], (p, p)) for r in centres.select(name, "centre").orderBy(name).collect()]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column(b.schema.get_field_index(column)))
            d = np.stack([spd.distance2(m.reshape(-1, p, p), c) for c in model], axis=1) if len(m) else np.zeros((0, len(model)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.tolist(), pa.list_(pa.float64()))], [*b.schema.names, "d2"])

    return df.mapInArrow(run, f"{schema}, d2 array<double>")

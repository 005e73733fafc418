"""Column functions: log-probability arithmetic, guarded division, ties, rounding, names and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def log_softmax(a: C) -> Column:
    """x - max - ln(sum(exp(x - max))) for an array of doubles."""
    a = col(a)
    top = F.array_max(a)
    return F.transform(a, lambda x: x - top - F.ln(asum(F.transform(a, lambda y: F.exp(y - top)))))


def logaddexp(a: C, b: C) -> Column:
    a, b = col(a), col(b)
    return F.greatest(a, b) + F.ln(1 + F.exp(-F.abs(a - b)))


def floored_log(a: C) -> Column:
    """ln(max(x, 1e-12 * mean(|x|) + 1e-300)) for each x of an array."""
    a = col(a)
    low = asum(F.transform(a, lambda x: F.abs(x))) / F.size(a) * 1e-12 + 1e-300
    return F.transform(a, lambda x: F.ln(F.greatest(x, low)))


def safe_divide(a: C, b: C) -> Column:
    """0 where the denominator isn't positive."""
    return F.when(col(b) > 0, col(a) / col(b)).otherwise(F.lit(0.0))


def argmax_first(a: C) -> Column:
    """1-based position of the largest element, the first of equals."""
    return F.array_position(col(a), F.array_max(col(a)))


def step_of(fs: C, share: float = 0.25) -> Column:
    """Samples of a step; halves round to even."""
    return F.bround(col(fs) * share).cast("long")


def subject_of(stem: C, separator: str = "_") -> Column:
    return F.element_at(F.split(col(stem), separator), -1)


def config_hash(*columns: C) -> Column:
    """The first ten hex digits of the md5 of a JSON object of the columns."""
    return F.substring(F.md5(F.to_json(F.struct(*map(col, columns)))), 1, 10)


def dot(a: C, b: C) -> Column:
    return asum(F.zip_with(col(a), col(b), lambda x, y: x * y))


def no_nan(a: C) -> Column:
    """Whether no element is NaN or null."""
    return ~F.exists(col(a), lambda x: x.isNull() | F.isnan(x))


def clip(x: C, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def to_decibel(ratio: C) -> Column:
    return 10 * F.log10(col(ratio))


def uniform_log(n: int = 3) -> Column:
    """Log-probabilities of n equally likely classes, for rows without a model."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda _: F.ln(F.lit(1.0 / n)))


def valid_class(*labels: C, classes: tuple = (1, 2, 3)) -> Column:
    out = F.lit(True)
    for c in labels:
        out = out & col(c).isin(*classes)
    return F.coalesce(out, F.lit(False))


def checked_label(y: C) -> Column:
    """y, or an error if it isn't 1, 2 or 3."""
    return F.when(valid_class(y), col(y)).otherwise(F.raise_error(F.concat(F.lit("not a class: "), F.coalesce(col(y).cast("string"), F.lit("null")))))


def time_bin(seconds: C, edges: tuple[float, ...] = (1.0, 2.5, 5.0, 9.1)) -> Column:
    """Number of the half-open bin [edge, next edge), from 0; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        out = F.when((col(seconds) >= edges[k]) & (col(seconds) < edges[k + 1]), k).otherwise(out)
    return out


def strength_group(db: C, low: float = 2.0, high: float = 6.0) -> Column:
    return F.when(col(db) < low, "weak").when(col(db) > high, "strong").otherwise("middle")

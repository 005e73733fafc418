"""Confusion, F1, recall, latency penalties and session scores; sessions count alike in every mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLASSES = (1, 2, 3)
# Seconds allowed, size of a step of excess and largest penalty, by event.
LIMITS = {"predict": (0.20, 0.05, 20.0), "fit_block": (1.5, 0.5, 10.0)}


def confusion(df: DataFrame, keys: list[str], pred: str = "y", truth: str = "t", classes: tuple = CLASSES) -> DataFrame:
    """(keys, pred, truth, n) for answers and truths that are classes."""
    ok = df.where(F.col(pred).isin(*classes) & F.col(truth).isin(*classes))
    return ok.groupBy(*keys, F.col(pred).alias("pred"), F.col(truth).alias("truth")).agg(F.count("*").alias("n"))


def confusion_wide(df: DataFrame, keys: list[str], pred: str = "y", truth: str = "t", classes: tuple = CLASSES) -> DataFrame:
    """The matrix with one row per (keys, answer) and a column per truth."""
    return confusion(df, keys, pred, truth, classes).groupBy(*keys, "pred").pivot("truth", list(classes)).agg(F.sum("n")).na.fill(0)


def _cells(pred: Column, truth: Column, classes: tuple) -> dict:
    one = lambda c: F.sum(c.cast("long"))
    ok = pred.isin(*classes) & truth.isin(*classes)
    out = {}
    for c in classes:
        out["tp", c] = one(F.coalesce(ok & (pred == c) & (truth == c), F.lit(False)))
        out["row", c] = one(F.coalesce(ok & (pred == c), F.lit(False)))
        out["col", c] = one(F.coalesce(ok & (truth == c), F.lit(False)))
    out["n"] = one(F.coalesce(ok, F.lit(False)))
    return out


def metrics(df: DataFrame, keys: list[str], pred: str = "y", truth: str = "t", classes: tuple = CLASSES) -> DataFrame:
    """(keys, f1_<class>, min_f1, macro_recall, n): one pass of conditional sums, combined before the shuffle.

    F1 is 0 where a class is neither answered nor true; recall is 0 for a class that is never true, and the mean is over
    all classes.
    """
    c = _cells(F.col(pred), F.col(truth), classes)
    g = df.groupBy(*keys).agg(*[v.alias("_" + "_".join(map(str, k)) if isinstance(k, tuple) else "_n") for k, v in c.items()])
    f1, recall = [], []
    for k in classes:
        den = F.col(f"_row_{k}") + F.col(f"_col_{k}")
        f1.append(F.when(den > 0, 2.0 * F.col(f"_tp_{k}") / den).otherwise(0.0))
        recall.append(F.when(F.col(f"_col_{k}") > 0, F.col(f"_tp_{k}") / F.col(f"_col_{k}")).otherwise(0.0))
    total = recall[0]
    for r in recall[1:]:
        total = total + r
    return g.select(*keys, *[f.alias(f"f1_{k}") for k, f in zip(classes, f1, strict=True)], F.least(*f1).alias("min_f1"), (total / len(classes)).alias("macro_recall"), F.col("_n").alias("n"))


def normalised(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of each truth's rows."""
    return conf.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "truth")))


def latency(df: DataFrame, keys: list[str], event: str = "event", seconds: str = "seconds") -> DataFrame:
    return df.groupBy(*keys, event).agg(F.avg(seconds).alias("mean_s"), F.max(seconds).alias("max_s"), F.count(seconds).alias("n"))


def penalty(seconds: Column, allowed: float, step: float, cap: float) -> Column:
    """min(floor(sum of excess seconds / step), cap) as an aggregate; the sum is rounded to 9 digits before the floor."""
    return F.least(F.floor(F.round(F.sum(F.greatest(seconds - allowed, F.lit(0.0))), 9) / step).cast("double"), F.lit(cap))


def bonus(nirs_min_f1: Column, n: Column) -> Column:
    """5 points, and 15 more by the second stream's min F1 if it has windows."""
    return F.when(n > 0, 5 + 15 * F.least(F.greatest(nirs_min_f1, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def composite(min_f1: Column, macro_recall: Column, extra: Column, penalties: Column, engineering: Column | None = None) -> Column:
    e = F.lit(0.0) if engineering is None else F.least(F.greatest(engineering, F.lit(0.0)), F.lit(20.0))
    return F.round(60 * min_f1 + 30 * macro_recall + extra + e - penalties, 4)


def session_mean(per_session: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Unweighted mean over sessions; sessions where a metric is null don't count for it."""
    return per_session.groupBy(*(keys or [])).agg(*[F.avg(c).alias(c) for c in columns])


def mean_of_means(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Mean over the inner groups' means, per outer group."""
    return df.groupBy(*outer, *inner).agg(F.avg(value).alias(value)).groupBy(*outer).agg(F.avg(value).alias(value))


def capped_sum(per_session: DataFrame, column: str, cap: float, keys: list[str] | None = None) -> DataFrame:
    """Penalties of sessions summed up and capped again."""
    return per_session.groupBy(*(keys or [])).agg(F.least(F.sum(column), F.lit(cap)).alias(column))


def complete_pivot(df: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    """Means by (row, column) with one column per value; rows that lack one are left out."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(value)).na.drop()


def delta(df: DataFrame, order: list[str], value: str, keys: list[str] | None = None) -> Column:
    """Change from the row before."""
    return F.col(value) - F.lag(value).over(Window.partitionBy(*(keys or [])).orderBy(*order))


def representatives(df: DataFrame, value: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, pick, name, value): the worst, the median (the upper one of two) and the best row by value, equals by name."""
    keys = keys or []
    every = Window.partitionBy(*keys)
    r = df.withColumn("_r", F.row_number().over(every.orderBy(value, name))).withColumn("_n", F.count("*").over(every))
    pick = F.array(*[F.when(c, F.lit(n)) for n, c in (("worst", F.col("_r") == 1), ("median", F.col("_r") == F.floor(F.col("_n") / 2) + 1), ("best", F.col("_r") == F.col("_n")))])
    return r.withColumn("pick", F.explode(pick)).where("pick is not null").select(*keys, "pick", name, value)

"""Stacking of two classifiers' log-probabilities with a fitted linear model, chosen on subjects that it has not seen.

Everything is sums: all leave-one-subject-out models of one penalty come from passes over the rows (crossfit), their answers and
the biases on top of them from grouped counts. What reaches the driver is a model or a few counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crossfit, fusion
from .fusion import CLASSES

#: The fold that leaves nobody out. No subject has an empty name: rows without one have no fold of their own either.
NOBODY = ""


def _rows(df: DataFrame, le: str, ln: str, truth: str, subject: str) -> DataFrame:
    """Rows with both vectors, all components finite, as (subject, label, feature) beside their own columns."""
    both = F.concat(F.col(le), F.col(ln))
    finite = F.forall(both, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.where(F.coalesce(finite, F.lit(False)) & F.col(truth).isin(*CLASSES) & (F.size(both) == 2 * len(CLASSES)))
    return rows.select("*", F.col(subject).cast("string").alias("_subject"), F.col(truth).cast("int").alias("_label"), both.alias("_feature"))


def _training(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_subject").alias("subject"), F.col("_label").alias("label"), F.col("_feature").alias("feature"))


def _answers(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows with `_lp`, the log-probabilities of their subject's model; those of a subject without one drop out."""
    models = models.select(F.col("subject").alias("_subject"), "mu", "sd", "w", "b")
    own = rows.select("_subject", "_label", "_feature", *[c for c in rows.columns if c.startswith("_group") or c == "_row"])
    return fusion.applied(own, F.broadcast(models), ["_subject"], "_feature", "_lp").where("_lp is not null")


def unseen(df: DataFrame, le: str, ln: str, truth: str, subject: str, c: float = 1.0) -> DataFrame:
    """`df`'s rows that a stack can answer, with `stacked`: log-probabilities by the model of all other subjects.

    Rows that lack a vector or one of its components, or whose truth is no class, are left out, and so are those of a subject
    whose fold has too little to learn from (crossfit). Rows without a subject train every fold and are answered by none.
    """
    row = F.struct(*[F.col(f"`{name}`") for name in df.columns if name != "stacked"]).alias("_row")  # columns may have a model's names
    rows = _rows(df, le, ln, truth, subject).select(row, "_subject", "_label", "_feature")
    return _answers(rows, crossfit.leave_one_out(_training(rows), _subjects(rows), c)).select("_row.*", F.col("_lp").alias("stacked"))


def _subjects(rows: DataFrame) -> list[str]:
    return sorted(r[0] for r in rows.select("_subject").distinct().where("_subject <> ''").collect())


def fitted(df: DataFrame, le: str, ln: str, truth: str, groups: list[str], subject: str, penalties: tuple[float, ...] = (0.1, 1.0)) -> dict | None:
    """The stack of all rows: {mu, sd, w, b, c, value, bias}, in the form that `fusion.stacked` takes.

    Its penalty c is the one under which models of the other subjects, with biases calibrated on their answers, reach the largest
    mean min F1 over `groups` (`value`); equals go to the first. `bias` is calibrated on the final stack's own answers. None if
    the rows don't hold all classes.
    """
    rows = _rows(df, le, ln, truth, subject).select("*", *[F.col(g).alias(f"_group{k}") for k, g in enumerate(groups)])
    names, by = _subjects(rows), [f"_group{k}" for k in range(len(groups))]
    best: tuple[float, float] | None = None
    for c in penalties:
        seen = crossfit.files.kept(_answers(rows, crossfit.leave_one_out(_training(rows), names, c)).select("_lp", "_label", *by))
        bias = fusion.calibrated(seen, "_lp", "_label", by) if seen.limit(1).count() else None
        if bias is not None:
            cand = df.sparkSession.createDataFrame([(bias,)], "bias array<double>")
            value = fusion.bias_scores(seen, cand, "_lp", "_label", by).first()["value"]
            if best is None or value > best[0] + 1e-12:
                best = (value, c)
    c = best[1] if best else penalties[0]
    final = crossfit.leave_one_out(_training(rows), [NOBODY], c).collect()
    if not final:
        return None
    m = final[0]
    model = {"mu": list(m["mu"]), "sd": list(m["sd"]), "w": [list(r) for r in m["w"]], "b": list(m["b"]), "c": c, "value": best[0] if best else None}
    own = crossfit.files.kept(rows.select(fusion.linear_log_prob("_feature", model).alias("_lp"), "_label", *by))
    return {**model, "bias": fusion.calibrated(own, "_lp", "_label", by)}

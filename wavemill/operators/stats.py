"""Rank statistics, regression, resampling and permutation tests over session tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window


def ordinal_rank(value: str, order: list[str], keys: list[str]) -> Column:
    """Place in the order of values within a key, equals by `order`."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(value, *order))


def tie_ranks(df: DataFrame, value: str, keys: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Adds _rank, the mean rank of equals, from counts of distinct values.

    Within keys the values of a key are sorted together. Without keys they are cut into `buckets` ranges at approximate
    quantiles; ranges are ranked in parallel and shifted by the counts of those below, so no task sees all values.
    """
    keys = keys or []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    if keys:
        part, base = keys, F.lit(0)
    else:
        shares = F.array(*[F.lit((k + 1) / buckets) for k in range(buckets - 1)])
        cuts = counts.agg(F.percentile_approx(value, shares, F.lit(10_000)).alias("_cuts"))
        counts = counts.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c < F.col(value)))).drop("_cuts")
        sums = counts.groupBy("_b").agg(F.sum("_c").alias("_s"))  # a row per range
        below = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("_b", F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_base"))
        counts, part, base = counts.join(F.broadcast(sums), "_b"), ["_b"], F.col("_base")
    w = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_rank", base + F.coalesce(F.sum("_c").over(w), F.lit(0)) + (F.col("_c") + 1) / 2.0)
    counts = counts.select(*keys, value, "_rank")
    on = [counts[c].eqNullSafe(df[c]) for c in [*keys, value]]
    return df.join(counts, on).select(df["*"], counts["_rank"])


def rank_auc(df: DataFrame, score: str, positive: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, auc, n_pos, n_neg): (rank sum of positives - n_pos (n_pos + 1) / 2) / (n_pos n_neg); null without both."""
    keys = keys or []
    r = tie_ranks(df.withColumn("_pos", positive.cast("long")), score, keys)
    g = r.groupBy(*keys).agg(F.sum(F.col("_rank") * F.col("_pos")).alias("_s"), F.sum("_pos").alias("n_pos"), F.sum(1 - F.col("_pos")).alias("n_neg"))
    p, n = F.col("n_pos"), F.col("n_neg")
    return g.select(*keys, F.when((p > 0) & (n > 0), (F.col("_s") - p * (p + 1) / 2.0) / (p * n)).alias("auc"), "n_pos", "n_neg")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n): Pearson correlation of mean ranks."""
    r = tie_ranks(tie_ranks(df.select(x, y), x).withColumnRenamed("_rank", "_rx"), y)
    return r.agg(F.corr("_rx", "_rank").alias("rho"), F.count("*").alias("n"))


def ols(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))


def quantiles(value: str, shares: list[float]) -> list[Column]:
    """Exact quantiles with linear interpolation."""
    return [F.percentile(value, F.lit(s)).alias(f"q{round(1000 * s):04d}") for s in shares]


def share_where(predicate: Column) -> Column:
    return F.avg(predicate.cast("int"))


def nan_mean(value: str) -> Column:
    return F.avg(F.when(~F.isnan(value), F.col(value)))


def mean_band(value: str) -> list[Column]:
    """Mean and the band of 1.96 standard errors about it."""
    m, se = F.avg(value), F.stddev_pop(value) / F.sqrt(F.count(value))
    return [m.alias("mean"), (m - 1.96 * se).alias("low"), (m + 1.96 * se).alias("high")]


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """(w, n, z, p) of the signed-rank test on pairs: zeros dropped, mean ranks of ties, normal approximation."""
    d = df.select((F.col(a) - F.col(b)).alias("_d")).where("_d <> 0").withColumn("_a", F.abs("_d"))
    ties = d.groupBy("_a").agg(F.count("*").alias("_c")).agg(F.sum(F.col("_c") * F.col("_c") * F.col("_c") - F.col("_c")).alias("ties"))
    g = tie_ranks(d, "_a").agg(F.sum(F.when(F.col("_d") > 0, F.col("_rank")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("_d") < 0, F.col("_rank")).otherwise(0.0)).alias("minus"), F.count("*").alias("n"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.coalesce("ties", F.lit(0)) / 48.0
    out = g.crossJoin(F.broadcast(ties)).select(F.least("plus", "minus").alias("w"), "n", F.when(var > 0, (F.least("plus", "minus") - n * (n + 1) / 4.0) / F.sqrt(var)).alias("z"))
    return out.withColumn("p", normal_two_sided(F.col("z")))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a normal deviate, by a rational approximation of erfc with an error below 1.2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # The coefficients of that approximation.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for v in reversed(c[:-1]):
        poly = poly * t + v
    return F.least(F.lit(1.0), t * F.exp(-x * x + poly))


def drawn(n: Column, *salt) -> Column:
    """A whole number below n, by a digest of what is given: the same everywhere."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *salt)), 1, 8), 16, 10).cast("long"), n)


def bootstrap(per_session: DataFrame, outer: str, value: str, reps: int = 2000, seed: int = 0) -> DataFrame:
    """(rep, value): means over subjects drawn with replacement, and over sessions drawn within each.

    Draws are digests of (seed, replicate, draw), so any task can make them again. The tables of subjects and of their session
    means have one row per recording and are joined to the draws by number; replicates spread over the tasks.
    """
    x = per_session.select(outer, value).where(F.col(value).isNotNull())
    w = Window.partitionBy(outer).orderBy(value)
    x = x.select(F.col(outer).alias("_o"), F.col(value).alias("_v"), (F.row_number().over(w) - 1).alias("_j"), F.count("*").over(Window.partitionBy(outer)).alias("_m"))
    subjects = x.select("_o", "_m").distinct()
    subjects = subjects.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_o")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    plan = per_session.sparkSession.range(0, reps, 1, max(1, reps // 50)).withColumnRenamed("id", "rep")
    total = F.broadcast(subjects.select("_n").limit(1))
    picks = plan.crossJoin(total).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    picks = picks.withColumn("_i", drawn(F.col("_n"), F.lit(seed), "rep", "_k")).join(F.broadcast(subjects.drop("_n")), "_i")
    picks = picks.withColumn("_l", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    picks = picks.withColumn("_j", drawn(F.col("_m"), F.lit(seed), "rep", "_k", "_l"))
    means = picks.join(F.broadcast(x.drop("_m")), ["_o", "_j"]).groupBy("rep", "_k").agg(F.avg("_v").alias("_v"))
    return means.groupBy("rep").agg(F.avg("_v").alias("value"))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, mean, sd, low, q25, q50, q75, high) of numeric columns: sample deviation, interpolated quantiles."""
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    g = df.select(one).select("x.*").groupBy("name")
    return g.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), *[F.percentile("v", F.lit(q / 100)).alias(f"q{q}") for q in (25, 50, 75)], F.max("v").alias("high"))


def numeric(df: DataFrame) -> DataFrame:
    """Only the columns of numbers."""
    return df.select(*[f.name for f in df.schema if isinstance(f.dataType, NumericType)])


def standardised(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation, per key; a deviation below 1e-12 counts as 1."""
    m = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    j = df.join(m, keys)
    for c in columns:
        j = j.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-12, 1.0).otherwise(F.col(f"_s_{c}")))
    return j.select(*df.columns)


def signed_rank_p(w: Column, n: Column, most: int = 50) -> Column:
    """Two-sided p of a signed-rank statistic without ties: exact for up to `most` pairs (how many of the 2^n sums are at most w; 62
    pairs are what whole numbers hold), by the normal form with a correction for continuity beyond.

    The numbers of subsets of 1..k with each sum follow from those of 1..k-1.
    """
    top = F.floor(n * (n + 1) / 2).cast("int")
    ways = F.concat(F.array(F.lit(1).cast("long")), F.array_repeat(F.lit(0).cast("long"), top))
    step = lambda a, k: F.transform(a, lambda x, s: x + F.when(s >= k, F.element_at(a, F.greatest(s - k + 1, F.lit(1)).cast("int"))).otherwise(F.lit(0).cast("long")))
    counts = F.aggregate(F.filter(F.sequence(F.lit(0), n.cast("int")), lambda k: k > 0), ways, step)
    below = F.aggregate(F.slice(counts, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    z = F.least(w + 0.5 - n * (n + 1) / 4, F.lit(0.0)) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return F.when(n <= most, F.least(F.lit(1.0), 2.0 * below / F.pow(F.lit(2.0), n))).otherwise(normal_two_sided(z))


def incomplete_beta(a: Column, b: Column, x: Column, terms: int = 300) -> Column:
    """The regularised incomplete beta function by its continued fraction, on the side where that converges fast.

    The fraction is summed from its last term: d_m / (1 + d_(m+1) / (1 + ...)), with `terms` of them.
    """
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    one = F.struct(p.alias("p"), q.alias("q"), y.alias("y"))

    def value(s: Column) -> Column:
        p, q, y = s["p"], s["q"], s["y"]

        def step(acc: Column, j: Column) -> Column:
            m = F.floor(j / 2)
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return F.when(j % 2 == 0, even).otherwise(odd) / (1 + acc)

        tail = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(0.0), step)
        front = F.exp(p * F.ln(y) + q * F.ln(1 - y) - log_beta(p, q)) / p
        return F.when(y <= 0, 0.0).when(y >= 1, 1.0).otherwise(front / (1 + tail))

    v = F.transform(F.array(one), value)[0]
    return F.when(swap, 1 - v).otherwise(v)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0, by its asymptotic series after a shift by ten."""
    # Numerators over denominators of the series.
    c = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
    z = x + 10
    series = F.lit(0.0)
    for v in reversed(c):
        series = series / (z * z) + v
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, k: s + F.ln(x + k))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series / z - shift


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def student_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t."""
    return F.when(dof > 0, incomplete_beta(dof / 2.0, F.lit(0.5), dof / (dof + t * t)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a (rank) correlation of n pairs against none, by Student's t with n - 2 degrees of freedom; null below three
    pairs, 0 for a perfect one."""
    dof = (n - 2).cast("double")
    t2 = r * r * dof / (1 - r * r)
    return F.when(n > 2, F.when(F.abs(r) >= 1, 0.0).otherwise(incomplete_beta(dof / 2.0, F.lit(0.5), dof / (dof + t2))))


def permutation_p(null: DataFrame, value: str, observed: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, p, n): (1 + how many of the null reach what was observed) / (1 + n)."""
    return null.groupBy(*(keys or [])).agg(((1 + F.sum((F.col(value) >= observed).cast("long"))) / (1 + F.count("*"))).alias("p"), F.count("*").alias("n"))


def permuted_labels(segs: DataFrame, keys: list[str], label: str, seed: int, movable: tuple = (2, 3)) -> DataFrame:
    """Labels of `movable` classes shuffled among their segments of a group; the rest stays."""
    moving = F.col(label).isin(*movable)
    w = Window.partitionBy(*keys, moving)
    at = F.row_number().over(w.orderBy("start_sample"))
    to = F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", *keys, "start_sample", F.lit(seed))), "start_sample"))
    s = segs.withColumn("_at", at).withColumn("_to", to).withColumn("_m", moving)
    new = s.select(*keys, F.col("_m"), F.col("_to").alias("_at"), F.col(label).alias("_new"))
    return s.join(new, [*keys, "_m", "_at"]).withColumn(label, F.when(F.col("_m"), F.col("_new")).otherwise(F.col(label))).drop("_at", "_to", "_m", "_new")


def phase_permuted(segs: DataFrame, keys: list[str], label: str, seed: int) -> DataFrame:
    """With probability one half per group, labels move on by one segment, the first to the end."""
    w = Window.partitionBy(*keys).orderBy("start_sample")
    shifted = F.coalesce(F.lead(label).over(w), F.first(label).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flip = drawn(F.lit(2), *keys, F.lit(seed)) == 0
    return segs.withColumn(label, F.when(flip, shifted).otherwise(F.col(label)))


def nested_selection(scores: DataFrame, subject: str, candidate: str, value: str, folds: int) -> DataFrame:
    """(fold, candidate, inner, outer): per fold of subjects, the candidate best on the others and its value on the fold.

    Subjects are folded by their order; equal candidates go to the first name.
    """
    ranked = scores.groupBy(subject, candidate).agg(F.avg(value).alias("v"))
    fold = ranked.select(subject).distinct().withColumn("fold", F.pmod(F.row_number().over(Window.orderBy(subject)) - 1, F.lit(folds)))
    ranked = ranked.join(F.broadcast(fold), subject)
    sums = ranked.groupBy("fold", candidate).agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    every = Window.partitionBy(candidate)
    sums = sums.withColumn("inner", (F.sum("s").over(every) - F.col("s")) / (F.sum("n").over(every) - F.col("n"))).withColumn("outer", F.col("s") / F.col("n"))
    best = Window.partitionBy("fold").orderBy(F.desc("inner"), candidate)
    return sums.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("fold", candidate, "inner", "outer")

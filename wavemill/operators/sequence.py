"""Windows, runs, trailing statistics and alignment of sample streams.

A stream is a DataFrame with key columns (a session), an order within the key and value columns. Everything is a window over
the key or an equi-join on it, so sessions spread over the cluster and no session meets another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

Keys = list[str]


def over(keys: Keys, order: Keys) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def numbered(df: DataFrame, keys: Keys, order: Keys, name: str = "sample") -> DataFrame:
    """Sample numbers from 0."""
    return df.withColumn(name, (F.row_number().over(over(keys, order)) - 1).cast("long"))


def grid_windows(df: DataFrame, keys: Keys, order: Keys, label: str, win: int, step: int, block: str | None = None, skip_block: int | None = None) -> DataFrame:
    """(keys, start_sample, end_sample, label) of windows [end - win, end), end = win + k * step, with one label (and block).

    A window counts if its label is the same throughout and not null, and its block too and not `skip_block`.
    """
    s = numbered(df, keys, order)
    w = over(keys, ["sample"]).rowsBetween(-(win - 1), 0)
    s = s.withColumn("_lo", F.min(label).over(w)).withColumn("_hi", F.max(label).over(w)).withColumn("_n", F.count(label).over(w))
    ok = (F.col("sample") >= win - 1) & ((F.col("sample") + 1 - win) % step == 0) & (F.col("_lo") == F.col("_hi")) & (F.col("_n") == win)
    if block:
        s = s.withColumn("_blo", F.min(block).over(w)).withColumn("_bhi", F.max(block).over(w))
        ok = ok & (F.col("_blo") == F.col("_bhi"))
        ok = ok & (F.col("_blo") != skip_block) if skip_block is not None else ok
    return s.where(ok).select(*keys, (F.col("sample") + 1 - win).alias("start_sample"), (F.col("sample") + 1).alias("end_sample"), F.col("_lo").alias("label"))


def segments(df: DataFrame, keys: Keys, order: Keys, label: str, index: str | None = None) -> DataFrame:
    """(keys, seg, start_sample, end_sample, label): maximal runs of a label, half-open.

    With `index`, a run also ends where the index leaves a gap (rows filtered out before).
    """
    s = df if index else numbered(df, keys, order)
    at = index or "sample"
    w = over(keys, [at])
    new = F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label)) | (F.lag(at).over(w) != F.col(at) - 1)
    s = s.withColumn("_seg", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys, F.col("_seg").alias("seg")).agg(F.min(at).cast("long").alias("start_sample"), (F.max(at) + 1).cast("long").alias("end_sample"), F.first(label).alias("label"))


def grid_points(segs: DataFrame, win: int, step: int, stride: int = 1) -> DataFrame:
    """One row per grid window inside a segment: k from ceil(start / step) to floor((end - win) / step)."""
    first, last = F.ceil(F.col("start_sample") / step), F.floor((F.col("end_sample") - win) / step)
    return segs.where(last >= first).withColumn("k", F.explode(F.sequence(first, last, F.lit(stride).cast("long"))))


def prefix_sums(df: DataFrame, keys: Keys, order: Keys, value: str) -> DataFrame:
    """Adds cum_x and cum_ix: running sums of x and of index * x."""
    s = numbered(df, keys, order)
    w = over(keys, ["sample"]).rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("cum_x", F.sum(value).over(w)).withColumn("cum_ix", F.sum(F.col("sample") * F.col(value)).over(w))


def trailing_level(value: str, keys: Keys, order: Keys, n: int, lag: int = 0) -> Column:
    """Mean of the last n values (fewer at the start), `lag` samples ago; null where there are none."""
    return F.avg(value).over(over(keys, order).rowsBetween(-(n - 1) - lag, -lag))


def trailing_slope(value: str, index: str, keys: Keys, order: Keys, n: int, fs: float = 1.0) -> Column:
    """Least squares slope per second over the last n samples; 0 for fewer than 3 or no spread."""
    w = over(keys, order).rowsBetween(-(n - 1), 0)
    i, x = F.col(index).cast("double"), F.col(value)
    m = F.count(value).over(w)
    si, sx = F.sum(i).over(w), F.sum(x).over(w)
    den = F.sum(i * i).over(w) - si * si / m
    num = F.sum(i * x).over(w) - si * sx / m
    return F.when((m < 3) | (den <= 1e-9), F.lit(0.0)).otherwise(num / den * fs)


def clamped_mean(value: str, keys: Keys, order: Keys, n: int) -> Column:
    """Mean of the values at k - n + 1 .. k, with places before the first taken as the first."""
    w = over(keys, order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.col(value)
    for j in range(1, n):
        total = total + F.coalesce(F.lag(value, j).over(w), first)
    return total / n


def first_difference(value: str, keys: Keys, order: Keys) -> Column:
    return F.col(value) - F.lag(value).over(over(keys, order))


def from_first(value: str, keys: Keys, order: Keys) -> Column:
    """The value less the first of its session."""
    return F.col(value) - F.first(value).over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def flat(value: str, keys: Keys, order: Keys) -> Column:
    """Whether a value repeats the one before."""
    return F.coalesce(first_difference(value, keys, order) == 0, F.lit(False))


def centred_mean(value: str, keys: Keys, order: Keys, width: int = 41) -> Column:
    """Moving mean over `width` samples about each, with zeros beyond the edges."""
    return F.sum(value).over(over(keys, order).rowsBetween(-(width // 2), width // 2)) / width


def cyclic_shift(value: str, keys: Keys, order: Keys) -> Column:
    """The next value of the group, the first one at its end."""
    w = over(keys, order)
    return F.coalesce(F.lead(value).over(w), F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def scanned(a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """y_i = a_i y_(i-1) + b_i over rows of b, from `before`: pairs (a, b) combine, so spans of 1, 2, 4 ... rows are joined."""
    a, y = a.astype(float)[:, None].copy(), b.astype(float).copy()
    if before is not None and len(y):
        y[0] += a[0] * before
    reach = 1
    while reach < len(y):
        y[reach:] = y[reach:] + a[reach:] * y[:-reach]
        a[reach:] = a[reach:] * a[:-reach]
        reach *= 2
    return y


def _recursive_mean(df: DataFrame, keys: Keys, order: Keys, value: str, kept: Column, name: str) -> DataFrame:
    """Adds the mean that keeps `kept` of what it was and takes the rest from each row; a key's first row is its first mean.

    Rows are sorted by key and order once; a task reads them in batches and carries one mean over, so no key is held whole.
    """
    many = isinstance(df.schema[value].dataType, ArrayType)
    keep = [f for f in df.schema if f.name != name]
    schema = StructType([*keep, StructField(name, ArrayType(DoubleType()) if many else DoubleType())])
    begins = F.row_number().over(over(keys, order)) == 1
    rows = df.select(*[f.name for f in keep], F.when(begins, 0.0).otherwise(kept).alias("_kept"), begins.alias("_begins"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: np.ndarray | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column(batch.schema.get_field_index(value))
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if many else column.to_numpy(zero_copy_only=False).astype(float)[:, None]
            a, begins = batch.column(n_own).to_numpy(zero_copy_only=False).astype(float), batch.column(n_own + 1).to_numpy(zero_copy_only=False).astype(bool)
            y = np.empty_like(x)
            edge = [*np.flatnonzero(begins).tolist(), n]
            if edge[0] > 0:  # goes on from the batch before
                y[: edge[0]] = scanned(a[: edge[0]], (1 - a[: edge[0], None]) * x[: edge[0]], last)
            if len(edge) > 1:
                y[edge[0] :] = scanned(a[edge[0] :], (1 - a[edge[0] :, None]) * x[edge[0] :])
            last = y[-1]
            out = pa.array(list(y), pa.list_(pa.float64())) if many else pa.array(y[:, 0], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_own], out], [*batch.schema.names[:n_own], name])

    n_own = len(keep)
    return rows.mapInArrow(run, schema)


def ema(df: DataFrame, keys: Keys, order: Keys, value: str, alpha: float, name: str = "ema") -> DataFrame:
    """Adds the exponential mean of `value`, a number or an array of numbers, over the rows of each key in order."""
    return _recursive_mean(df, keys, order, value, F.lit(float(alpha)), name)


def ema_uneven(df: DataFrame, keys: Keys, time: str, value: str, tau: float, name: str = "ema") -> DataFrame:
    """Adds the exponential mean over rows at uneven times: each keeps exp(-dt / tau) of the mean before, dt the time since the row
    before. Rows of one time follow each other with nothing taken in; tau 0 keeps nothing."""
    dt = F.col(time) - F.lag(time).over(over(keys, [time]))
    return _recursive_mean(df, keys, [time], value, F.exp(-dt / tau) if tau else F.lit(0.0), name)


def ema_final(df: DataFrame, keys: Keys, order: Keys, value: str, alpha: float, name: str = "ema") -> DataFrame:
    """(keys, ema): the last exponential mean of each key, in one aggregation."""
    rows = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_x")))), lambda r: r["_x"]).alias("_xs"))
    last = F.aggregate("_xs", F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(acc * alpha + x * (1 - alpha)))
    return rows.select(*keys, last.alias(name))


def ema_at(series: DataFrame, marks: DataFrame, keys: Keys, index: str, n: str, value: str) -> DataFrame:
    """`marks` with the value of the n-th sample of their key's series (index from 0): 0 before any sample, and the last one
    where n is beyond the end."""
    found = asof_backward(marks.withColumn("_n", F.col(n) - 1), series.select(*keys, index, value), keys, "_n", index, [value])
    return found.withColumn(value, F.coalesce(value, F.lit(0.0))).drop("_n")


def window_moments(df: DataFrame, keys: Keys, order: Keys, channels: Keys, win: int, step: int, centred: bool = False) -> DataFrame:
    """(keys, end_sample, m_<i>_<j>): second moments of channels over grid windows, X'X / win, or less the product of means."""
    s = numbered(df, keys, order)
    w = over(keys, ["sample"]).rowsBetween(-(win - 1), 0)
    cols = []
    for i, a in enumerate(channels):
        for j, b in enumerate(channels[i:], i):
            m = F.avg(F.col(a) * F.col(b)).over(w)
            cols.append((m - F.avg(a).over(w) * F.avg(b).over(w) if centred else m).alias(f"m_{i}_{j}"))
    rows = s.select(*keys, "sample", *cols)
    on_grid = (F.col("sample") >= win - 1) & ((F.col("sample") + 1 - win) % step == 0)
    return rows.where(on_grid).withColumn("end_sample", F.col("sample") + 1).drop("sample")


def moments_at(df: DataFrame, keys: Keys, sample: str, channels: Keys, ends: DataFrame, end: str, win: int, centred: bool = False) -> DataFrame:
    """`ends` (keys, end) with m_<i>_<j>: second moments of the `win` samples before each end (of all there are, where those are
    fewer), wherever it lies; null before the first sample.

    Running sums of outer products, taken once per sample about each key's first values so that no digits go, are looked up at a
    window's two ends; a window costs two rows, however long it is. `sample` numbers a key's rows from 0.
    """
    w = over(keys, [sample])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.select(*keys, sample, *channels, *[F.first(c).over(run).alias(f"_o{i}") for i, c in enumerate(channels)])
    pairs = [(i, j) for i in range(len(channels)) for j in range(i, len(channels))]
    x = [F.col(c) - F.col(f"_o{i}") for i, c in enumerate(channels)]
    sums = F.array(*[F.sum(v).over(run) for v in x], *[F.sum(x[i] * x[j]).over(run) for i, j in pairs])
    d = d.select(*keys, (F.col(sample) + 1).alias("_at"), sums.alias("_s"), F.array(*[F.col(f"_o{i}") for i in range(len(channels))]).alias("_o"))
    last = asof_backward(ends, d.withColumn("_n", F.col("_at")), keys, end, "_at", ["_n", "_s", "_o"]).where(F.col(end).isNotNull())
    from_ = d.select(*keys, F.col("_at").alias("_from"), F.col("_s").alias("_before"))
    both = last.withColumn("_from", F.greatest(F.col("_n") - win, F.lit(0))).join(from_, [*keys, "_from"], "left")
    n = F.col("_n") - F.col("_from")
    part = lambda k: (F.col("_s")[k] - F.coalesce(F.col("_before")[k], F.lit(0.0))) / n
    cols, p = [], len(channels)
    for k, (i, j) in enumerate(pairs):
        a, b = part(i), part(j)
        about = part(p + k) - a * b  # the covariance, whatever the origin
        cols.append((about if centred else about + (a + F.col("_o")[i]) * (b + F.col("_o")[j])).alias(f"m_{i}_{j}"))
    return both.select(*ends.columns, *cols)


def completed(df: DataFrame, block: str, state: str, which: int) -> DataFrame:
    """Labelled samples of a block that has ended: what a fit gets to see of it."""
    return df.where((F.col(block) == which) & (F.col(state) > 0))


def past_skip(start: Column | str, segment_start: Column | str, skip: int) -> Column:
    """Whether a window begins at least `skip` samples into its segment, so that it may be trained on."""
    at = lambda c: F.col(c) if isinstance(c, str) else c
    return at(start) >= at(segment_start) + skip


def time_decay_weight(seconds_ago: Column, tau: float) -> Column:
    """exp(-dt / tau), the weight of the past in an average over uneven times."""
    return F.exp(-seconds_ago / tau)


def asof_backward(left: DataFrame, right: DataFrame, keys: Keys, at: str, time: str, values: Keys) -> DataFrame:
    """Each left row with the values of the last right row of its key with time <= at.

    One union, one sort per key; no pair of rows is formed. Left rows without a match get nulls.
    """
    carry = F.struct(F.col(time).alias("_t"), *values)
    both = left.select("*", F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(carry.alias("c")).schema["c"].dataType).alias("_c"))
    other = right.select(*keys, F.col(time).cast(left.schema[at].dataType).alias("_at"), F.lit(0).alias("_side"), carry.alias("_c"))
    both = both.unionByName(other, allowMissingColumns=True)
    last = F.last("_c", ignorenulls=True).over(over(keys, ["_at", "_side"]).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_c", last).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_c.{v}").alias(v) for v in values])


def asof_forward(left: DataFrame, right: DataFrame, keys: Keys, at: str, time: str, values: Keys) -> DataFrame:
    """As asof_backward, with the first right row with time >= at."""
    carry = F.struct(F.col(time).alias("_t"), *values)
    both = left.select("*", F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(right.select(carry.alias("c")).schema["c"].dataType).alias("_c"))
    other = right.select(*keys, F.col(time).cast(left.schema[at].dataType).alias("_at"), F.lit(1).alias("_side"), carry.alias("_c"))
    both = both.unionByName(other, allowMissingColumns=True)
    nxt = F.first("_c", ignorenulls=True).over(over(keys, ["_at", "_side"]).rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("_c", nxt).where("_side = 0")
    return out.select(*left.columns, *[F.col(f"_c.{v}").alias(v) for v in values])


def delivered(n: Column, at: Column, mark: Column, fs_a: float, fs_b: float) -> Column:
    """Samples delivered by `at`, back-estimated from the count n at the next mark: n - round((mark - at) * fs_b / fs_a)."""
    return F.least(F.greatest(n - F.bround((mark - at) / (fs_a / fs_b)), F.lit(0)), n).cast("long")


def counts_at(ends: DataFrame, marks: DataFrame, keys: Keys, at: str, time: str, n: str, fs_a: float, fs_b: float) -> DataFrame:
    """`ends` with `n`, the samples delivered by each end: from the first mark at or after it (the last mark if there is none),
    less what its rate delivers in between."""
    found = asof_forward(ends, marks.select(*keys, time, n), keys, at, time, [time, n])
    last = marks.groupBy(*keys).agg(F.max_by(F.struct(F.col(time).alias("_t"), F.col(n).alias("_n")), time).alias("_last"))
    j = found.join(last, keys)
    count, mark = F.coalesce(n, "_last._n"), F.coalesce(time, "_last._t")
    return j.withColumn(n, delivered(count, F.col(at), mark, fs_a, fs_b)).drop("_last", time)


def mean_between(df: DataFrame, spans: DataFrame, keys: Keys, time: str, value: str, low: str, high: str) -> DataFrame:
    """`spans` with `mean`, the mean of values with low < time <= high, 0 where there are none: running sums at both ends, found
    as of them, so no pair of rows is formed."""
    w = over(keys, [time]).rangeBetween(Window.unboundedPreceding, 0)
    sums = df.select(*keys, time, F.sum(value).over(w).alias("_s"), F.count(value).over(w).alias("_c")).distinct()
    out = spans
    for end, side in ((low, "a"), (high, "b")):
        renamed = sums.select(*keys, F.col(time).alias("_t"), F.col("_s").alias(f"_s{side}"), F.col("_c").alias(f"_c{side}"))
        out = asof_backward(out, renamed, keys, end, "_t", [f"_s{side}", f"_c{side}"])
    part = lambda c: F.coalesce(F.col(f"{c}b"), F.lit(0)) - F.coalesce(F.col(f"{c}a"), F.lit(0))
    return out.withColumn("mean", part("_s") / F.greatest(part("_c"), F.lit(1))).drop("_sa", "_sb", "_ca", "_cb")


def range_join(left: DataFrame, right: DataFrame, keys: Keys, point: str, low: str, high: str, width: int) -> DataFrame:
    """Rows of `left` with point in [low, high] of `right` rows of the same key.

    Intervals are cut into buckets of `width`, so the join is an equi-join on (key, bucket) whose rows grow with the
    intervals' lengths and not with the product of both sides.
    """
    r = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))) 
    l = left.withColumn("_b", F.floor(F.col(point) / width))  # noqa: E741
    return l.join(r, [*keys, "_b"]).where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_b")


def inside(windows: DataFrame, segs: DataFrame, keys: Keys, width: int) -> DataFrame:
    """Windows that lie within a segment: start_sample >= s_start and end_sample <= s_end."""
    s = segs.withColumnsRenamed({"start_sample": "s_start", "end_sample": "s_end", "label": "s_label"})
    return range_join(windows, s, keys, "start_sample", "s_start", "s_end", width).where("end_sample <= s_end")


def baseline_epochs(df: DataFrame, events: DataFrame, keys: Keys, value: str, before: int, after: int) -> DataFrame:
    """(keys, event columns, offset, value less the mean of the `before` samples ahead of the event)."""
    e = events.withColumn("_lo", F.col("at") - before).withColumn("_hi", F.col("at") + after - 1)
    rows = range_join(df, e, keys, "sample", "_lo", "_hi", before + after)
    w = Window.partitionBy(*keys, "at")
    base = F.avg(F.when(F.col("sample") < F.col("at"), F.col(value))).over(w)
    return rows.select(*keys, "at", (F.col("sample") - F.col("at")).alias("offset"), (F.col(value) - base).alias("value"))


def last_per_key(df: DataFrame, keys: Keys, order: list) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_per_key(df: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    w = over(keys, order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_k(df: DataFrame, keys: Keys, order: list, k: int) -> DataFrame:
    """The k first rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def shard(df: DataFrame, number: str, k: int, n: int) -> DataFrame:
    """Rows whose number leaves k when divided by n."""
    return df.where(F.pmod(F.col(number), F.lit(n)) == k)


def event_order(predict: DataFrame, fit: DataFrame, keys: Keys) -> DataFrame:
    """(keys, at, kind, place): predictions come before fits of the same time."""
    both = predict.select(*keys, "at").withColumn("kind", F.lit(0)).unionByName(fit.select(*keys, "at").withColumn("kind", F.lit(1)))
    return both.withColumn("place", F.row_number().over(over(keys, ["at", "kind"])).cast("long"))

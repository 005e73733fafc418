"""Further registered queries with their SQL: fusion and calibration, statistics, analyses, alignment, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import fusion, scoring, sequence, signal, stacking, stats
from ..sources import files, schemas
from . import analysis, session
from .catalog import LS, SEGMENTS, STREAM, T, TRIPLE, TRUTH, NEAR, U, _student_sql, _vectors, class_means, long, r6, read, register, samples, spread_sql, triples, truth3

LP = ("lp1", "lp2", "lp3")
CLASS = "case event_type when 'click' then 1 when 'purchase' then 2 when 'view' then 3 end"


def f1_sql(source: str, keys: str, pred: str = "y", truth: str = "t", tag: str = "") -> str:
    """Two common table expressions that end in f<tag>: keys, n, f1_<c>, min_f1, macro_recall of `source`."""
    ok = f"({pred} in (1, 2, 3) and {truth} in (1, 2, 3))"
    cells = ", ".join(f"count(*) filter (where {ok} and {pred} = {c} and {truth} = {c}) tp{c}, count(*) filter (where {ok} and {pred} = {c}) r{c}, count(*) filter (where {ok} and {truth} = {c}) c{c}" for c in (1, 2, 3))
    f1 = [f"case when r{c} + c{c} > 0 then 2.0::double * tp{c} / (r{c} + c{c}) else 0 end" for c in (1, 2, 3)]
    recall = " + ".join(f"case when c{c} > 0 then tp{c}::double / c{c} else 0 end" for c in (1, 2, 3))
    return f"m{tag} as (select {keys}, {cells}, count(*) filter (where {ok}) n from {source} group by {keys}), f{tag} as (select {keys}, n, {', '.join(f'{x} f1_{c}' for c, x in enumerate(f1, 1))}, least({', '.join(f1)}) min_f1, ({recall}) / 3 macro_recall from m{tag})"


def rounded(df: DataFrame, *plain: str, digits: int = 6) -> DataFrame:
    """Columns as they are, the rest as rounded doubles."""
    return df.select(*plain, *[F.round(F.col(c), digits).alias(c) for c in df.columns if c not in plain])


def rounded_sql(source: str, plain: str, *columns: str) -> str:
    return f"select {plain}, " + ", ".join(f"round({c}, 6) {c}" for c in columns) + f" from {source}"


# Windows, alignment and trailing statistics.


@register(f"with {STREAM}, b as (select *, sample // 16 blk from s), w as (select *, min(event_type) over f lo, max(event_type) over f hi, min(blk) over f blo, max(blk) over f bhi, count(*) over f n from b window f as (partition by user_id order by sample rows between 1 preceding and current row)) select user_id, (sample - 1)::bigint start_sample, (sample + 1)::bigint end_sample, lo as label from w where lo = hi and n = 2 and blo = bhi and blo <> 0 and (sample - 1) % 2 = 0")
def grid_windows_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("blk", F.floor(F.col("sample") / 16))
    return sequence.grid_windows(s, U, T, "event_type", 2, 2, "blk", 0)


@register(f"with {STREAM}, b as (select user_id, sample, {CLASS} state, sample // 16 block from s) select user_id, sample::bigint sample, state::bigint state from b where block = 2 and state > 0")
def completed_block(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 3)
    s = samples(spark, d).select("user_id", "sample", state.alias("state"), F.floor(F.col("sample") / 16).alias("block"))
    return sequence.completed(s, "block", "state", 2).select("user_id", "sample", long("state").alias("state"))


@register(f"with {SEGMENTS}, w as (select user_id, sample start_sample, sample + 1 end_sample from s) select w.user_id, w.start_sample::bigint start_sample, g.start_sample s_start, w.start_sample >= g.start_sample + 1 as trained from w join g on w.user_id = g.user_id and w.start_sample >= g.start_sample and w.end_sample <= g.end_sample")
def train_skip(spark: SparkSession, d: str) -> DataFrame:
    w = samples(spark, d).select("user_id", F.col("sample").alias("start_sample"), (F.col("sample") + 1).alias("end_sample"))
    g = sequence.segments(read(spark, d, "events"), U, T, "event_type").drop("seg")
    return sequence.inside(w, g, U, 8).select("user_id", "start_sample", "s_start", sequence.past_skip("start_sample", "s_start", 1).alias("trained"))


@register(f"with {STREAM}, k as (select *, case when lag(event_type) over w is distinct from event_type or lag(sample) over w <> sample - 1 then 1 else 0 end nw from s where value > 10 window w as (partition by user_id order by sample)), c as (select *, sum(nw) over (partition by user_id order by sample) seg from k) select user_id, min(sample)::bigint start_sample, (max(sample) + 1)::bigint end_sample, min(event_type) as label from c group by user_id, seg")
def segments_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    return sequence.segments(samples(spark, d).where("value > 10"), U, T, "event_type", index="sample").drop("seg")


EMA = "r as (select user_id, list_reduce(list([value] order by ts, event_id), lambda a, x: list_append(a, 0.8 * a[-1] + 0.2 * x[1])) l from events group by 1), e as (select user_id, unnest(range(len(l)))::bigint sample, unnest(l) ema from r)"


@register(f"with {STREAM}, {EMA} select s.user_id, s.event_id, round(s.value - e.ema, 4) v from s join e using (user_id, sample)")
def ema_baseline(spark: SparkSession, d: str) -> DataFrame:
    s = sequence.ema(samples(spark, d).select("user_id", "event_id", "sample", "value"), U, ["sample"], "value", 0.8)
    return s.select("user_id", "event_id", F.round(F.col("value") - F.col("ema"), 4).alias("v"))


@register(f"with {STREAM}, {EMA}, l as (select user_id, max(sample) m from e group by 1), k as (select user_id, event_id, sample * 2 n from s where event_type = 'purchase') select k.user_id, k.event_id, k.n::bigint n, round(case when n <= 0 then 0 else ema end, 4) ema from k join l using (user_id) left join e on e.user_id = k.user_id and e.sample = least(n - 1, m)")
def ema_at_marks(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    series = sequence.ema(s.select("user_id", "sample", "value"), U, ["sample"], "value", 0.8)
    marks = s.where("event_type = 'purchase'").select("user_id", "event_id", (F.col("sample") * 2).alias("n"))
    return sequence.ema_at(series, marks, U, "sample", "n", "ema").select("user_id", "event_id", "n", F.round("ema", 4).alias("ema"))


@register("with l as (select user_id, max(ts) last from events group by 1), w as (select user_id, value, exp(-epoch(last - ts) / 86400.0::double) w from events join l using (user_id)) select user_id, round(sum(w * value) / sum(w), 5) v from w group by 1")
def time_decay_mean(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    j = e.join(e.groupBy("user_id").agg(F.max("ts").alias("last")), "user_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    j = j.withColumn("w", sequence.time_decay_weight((micros("last") - micros("ts")) / 1e6, 86400.0))
    return j.groupBy("user_id").agg(F.round(F.sum(F.col("w") * F.col("value")) / F.sum("w"), 5).alias("v"))


@register(f"with {STREAM}, f as (select user_id, sample, value a, (event_id % 7)::double b from s), w as (select user_id, sample, avg(a * a) over w m_0_0, avg(a * b) over w m_0_1, avg(b * b) over w m_1_1, avg(a) over w ma, avg(b) over w mb from f window w as (partition by user_id order by sample rows between 6 preceding and current row)) select user_id, (sample + 1)::bigint end_sample, round(m_0_0, 5) m_0_0, round(m_0_1, 5) m_0_1, round(m_1_1, 5) m_1_1, round(m_0_0 - ma * ma, 5) c_0_0, round(m_0_1 - ma * mb, 5) c_0_1, round(m_1_1 - mb * mb, 5) c_1_1 from w where sample >= 6 and (sample - 6) % 2 = 0")
def window_moments(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("b", (F.col("event_id") % 7).cast("double"))
    plain = sequence.window_moments(s, U, T, ["value", "b"], 7, 2)
    centred = sequence.window_moments(s, U, T, ["value", "b"], 7, 2, centred=True).withColumnsRenamed({f"m_{i}": f"c_{i}" for i in ("0_0", "0_1", "1_1")})
    return rounded(plain.join(centred, ["user_id", "end_sample"]), "user_id", "end_sample", digits=5)


@register(f"with {STREAM}, m as (select user_id, sample mark, count(*) filter (where event_type = 'view') over (partition by user_id order by sample) n, event_type from s), k as (select user_id, mark, n from m where event_type = 'purchase'), l as (select user_id, max(mark) lm, arg_max(n, mark) ln from k group by 1), a as (select s.user_id, s.sample, coalesce(k.mark, lm) mark, coalesce(k.n, ln) n from s asof left join k on s.user_id = k.user_id and s.sample <= k.mark join l on l.user_id = s.user_id) select user_id, sample::bigint sample, least(greatest(n - round_even((mark - sample) / 2.5::double, 0), 0), n)::bigint n from a")
def delivered_marks(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    views = F.sum((F.col("event_type") == "view").cast("long")).over(sequence.over(U, ["sample"]))
    marks = s.withColumn("n", views).where("event_type = 'purchase'").select("user_id", F.col("sample").alias("mark"), "n")
    return sequence.counts_at(s.select("user_id", "sample"), marks, U, "sample", "mark", "n", 250.0, 100.0).select("user_id", "sample", "n")


@register(f"with {STREAM}, p as (select user_id, sample from s where event_type = 'purchase') select p.user_id, p.sample::bigint sample, round(coalesce(sum(s.value), 0) / greatest(count(s.value), 1), 6) as mean from p left join s on s.user_id = p.user_id and s.sample > p.sample - 6 and s.sample <= p.sample - 2 group by all")
def mean_between(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    spans = s.where("event_type = 'purchase'").select("user_id", "sample", (F.col("sample") - 6).alias("low"), (F.col("sample") - 2).alias("high"))
    return sequence.mean_between(s, spans, U, "sample", "value", "low", "high").select("user_id", "sample", r6("mean").alias("mean"))


@register(f"with {STREAM}, f as (select user_id, event_id, sample, value, first_value(value) over (partition by user_id order by sample) f, lag(value, 1) over w a, lag(value, 2) over w b from s window w as (partition by user_id order by sample)) select user_id, event_id, round((value + coalesce(a, f) + coalesce(b, f)) / 3, 6) v0, round((2 * value + 2 * coalesce(a, f) + 2 * coalesce(b, f)) / 3 + 1, 6) v1 from f")
def averaged_matrices(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).select(F.col("user_id").alias("session_id"), "event_id", F.col("sample").alias("k"), F.array("value", 2 * F.col("value") + 1).alias("covs"))
    a = signal.averaged(s, 3)
    return a.select(F.col("session_id").alias("user_id"), "event_id", r6(F.col("covs")[0]).alias("v0"), r6(F.col("covs")[1]).alias("v1"))


# Scalars.


@register("select vec_id, len(list_filter(embedding, lambda x: x::double < -0.2::double)) = 0 as ok from embeddings")
def no_nan_rows(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("e", F.transform("embedding", lambda x: F.when(x.cast("double") < -0.2, float("nan")).otherwise(x.cast("double"))))
    return e.select("vec_id", S.no_nan("e").alias("ok"))


@register("select event_id, round(ln(1.0::double / 3), 6) uniform, round(case when value - 50 > 0 then event_id / (value - 50) else 0 end, 4) ratio, round(10 * log10((value + 1) / 2), 6) db, round(least(greatest(value, 20), 60), 6) clipped, floor(value)::bigint low, ceil(value)::bigint up, round(sqrt(abs(value)), 6) root, round((exp(value / 100) - exp(-value / 100)) / (exp(value / 100) + exp(-value / 100)), 6) hyper from events")
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return read(spark, d, "events").select("event_id", r6(S.uniform_log()[0]).alias("uniform"), F.round(S.safe_divide("event_id", v - 50), 4).alias("ratio"), r6(S.to_decibel((v + 1) / 2)).alias("db"), r6(S.clip(v, 20, 60)).alias("clipped"), long(F.floor(v)).alias("low"), long(F.ceil(v)).alias("up"), r6(F.sqrt(F.abs(v))).alias("root"), r6(F.tanh(v / 100)).alias("hyper"))


@register("with p as (select vec_id, list_transform(embedding, lambda x: x::double * x::double - 0.001::double) a from embeddings), l as (select vec_id, list_transform(a, lambda x: ln(greatest(x, list_sum(list_transform(a, lambda y: abs(y))) / len(a) * 1e-12 + 1e-300))) v from p) select vec_id, round(list_sum(v), 4) total, round(list_min(v), 5) low from l")
def floored_log(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double") - 0.001).alias("a"))
    e = e.withColumn("v", S.floored_log("a"))
    return e.select("vec_id", F.round(S.asum(F.col("v")), 4).alias("total"), F.round(F.array_min("v"), 5).alias("low"))


@register("select event_id, case event_type when 'click' then 1 when 'purchase' then 2 else 3 end::bigint y from events")
def checked_labels(spark: SparkSession, d: str) -> DataFrame:
    y = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return read(spark, d, "events").select("event_id", long(S.checked_label(y)).alias("y"))


@register("select c.channel, c.place::bigint place, c.channel not in ('fp1', 'fp2', 'f7', 'f8', 'lpa', 'rpa', 'o1', 'o2') in_average from (select unnest(string_split('" + ",".join(schemas.CHANNELS) + "', ',')) channel, unnest(range(21)) place) c")
def montage(spark: SparkSession, d: str) -> DataFrame:
    return schemas.channels(spark).withColumn("place", long("place"))


# Scores.

TWO = "b as (select l_suppkey, case l_returnflag when 'A' then 1 when 'N' then 2 when 'R' then 3 end t, case when l_quantity < 17 then 1 when l_quantity < 34 then 2 else 3 end y, case when l_discount < 0.03 then 1 when l_discount < 0.07 then 2 else 3 end y2 from lineitem)"


@register(f"with {TWO}, {f1_sql('b', 'l_suppkey')}, g as (select * from b where l_suppkey % 3 > 0), {f1_sql('g', 'l_suppkey', 'y2', tag='2')}, j as (select f.l_suppkey, f.min_f1, f.macro_recall, f2.min_f1 as min2, case when coalesce(f2.n, 0) > 0 then 5 + 15 * least(greatest(f2.min_f1, 0), 1) else 0 end bonus from f left join f2 on f.l_suppkey = f2.l_suppkey) select l_suppkey, round(min_f1, 6) min_f1, round(min2, 6) as second_f1, round(bonus, 6)::double bonus, round(60 * min_f1 + 30 * macro_recall + bonus + least(greatest(l_suppkey % 30, 0), 20) - l_suppkey % 5, 4)::double score from j")
def session_scores(spark: SparkSession, d: str) -> DataFrame:
    y2 = F.when(F.col("l_discount") < 0.03, 1).when(F.col("l_discount") < 0.07, 2).otherwise(3)
    b = truth3(spark, d, "l_suppkey", "l_discount").withColumn("y2", y2)
    one = scoring.metrics(b, ["l_suppkey"])
    two = scoring.metrics(b.where("l_suppkey % 3 > 0"), ["l_suppkey"], "y2").select("l_suppkey", F.col("min_f1").alias("second"), F.col("n").alias("n2"))
    j = one.join(two, "l_suppkey", "left").withColumn("bonus", scoring.bonus(F.col("second"), F.coalesce("n2", F.lit(0))))
    score = scoring.composite(F.col("min_f1"), F.col("macro_recall"), F.col("bonus"), F.col("l_suppkey") % 5, F.col("l_suppkey") % 30)
    return j.select("l_suppkey", r6("min_f1").alias("min_f1"), r6("second").alias("second_f1"), r6("bonus").alias("bonus"), score.alias("score"))


@register(f"with {TWO}, {f1_sql('b', 'l_suppkey')}, g as (select * from b where l_suppkey % 3 > 0), {f1_sql('g', 'l_suppkey', 'y2', tag='2')} select f.l_suppkey % 5 as grp, round(avg(f.min_f1), 6) a, round(avg(f2.min_f1), 6) b, round(least(sum(f.l_suppkey % 7), 9), 6)::double capped from f left join f2 on f.l_suppkey = f2.l_suppkey group by 1")
def session_means(spark: SparkSession, d: str) -> DataFrame:
    """Sessions without a second stream don't count for its mean; penalties are summed up to a cap."""
    y2 = F.when(F.col("l_discount") < 0.03, 1).when(F.col("l_discount") < 0.07, 2).otherwise(3)
    b = truth3(spark, d, "l_suppkey", "l_discount").withColumn("y2", y2)
    one = scoring.metrics(b, ["l_suppkey"]).select("l_suppkey", F.col("min_f1").alias("a"))
    two = scoring.metrics(b.where("l_suppkey % 3 > 0"), ["l_suppkey"], "y2").select("l_suppkey", F.col("min_f1").alias("b"))
    j = one.join(two, "l_suppkey", "left").withColumn("grp", F.col("l_suppkey") % 5).withColumn("pen", (F.col("l_suppkey") % 7).cast("double"))
    m = rounded(scoring.session_mean(j, ["a", "b"], ["grp"]), "grp")
    return m.join(scoring.capped_sum(j, "pen", 9.0, ["grp"]).select("grp", r6("pen").alias("capped")), "grp")


@register("with t as (select o_orderpriority p, o_custkey, avg(o_totalprice) v from orders group by all), r as (select *, row_number() over (partition by p order by v, o_custkey) r, count(*) over (partition by p) n from t), k as (select 'worst' pick, p, o_custkey, v from r where r = 1 union all select 'median', p, o_custkey, v from r where r = n // 2 + 1 union all select 'best', p, o_custkey, v from r where r = n) select p, pick, o_custkey, round(v, 4) v from k")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), "o_custkey").agg(F.avg("o_totalprice").alias("v"))
    return rounded(scoring.representatives(t, "v", "o_custkey", ["p"]), "p", "pick", "o_custkey", digits=4)


CONFIGS = "(values ('a', 10, 20), ('b', 17, 34), ('c', 25, 40)) c(config, lo, hi)"


@register(f"with b as (select config, l_suppkey, case l_returnflag when 'A' then 1 when 'N' then 2 when 'R' then 3 end t, case when l_quantity < lo then 1 when l_quantity < hi then 2 else 3 end y from lineitem, {CONFIGS}), {f1_sql('b', 'config, l_suppkey')} select config, round(avg(min_f1), 6) min_f1, round(avg(macro_recall), 6) macro_recall, round(1.96 * stddev_pop(min_f1) / sqrt(count(*)), 6) half_band, count(*)::bigint n from f group by 1")
def experiments_union(spark: SparkSession, d: str) -> DataFrame:
    """Sessions under each configuration, one beneath the other, and the mean of each with its band."""
    parts = []
    for name, lo, hi in (("a", 10, 20), ("b", 17, 34), ("c", 25, 40)):
        y = F.when(F.col("l_quantity") < lo, 1).when(F.col("l_quantity") < hi, 2).otherwise(3)
        parts.append(scoring.metrics(truth3(spark, d, "l_suppkey", "l_quantity").withColumn("y", y), ["l_suppkey"]).withColumn("config", F.lit(name)))
    out = session.stacked(parts).groupBy("config").agg(F.avg("min_f1").alias("min_f1"), F.avg("macro_recall").alias("macro_recall"), (1.96 * F.stddev_pop("min_f1") / F.sqrt(F.count("*"))).alias("half_band"), F.count("*").alias("n"))
    return rounded(out, "config", "n")


@register(f"select s_suppkey, config from supplier, {CONFIGS} except select s_suppkey, 'b' from supplier where s_suppkey % 5 = 0")
def todo_grid(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey")
    todo = session.planned(s, ["a", "b", "c"])
    done = s.where("s_suppkey % 5 = 0").withColumn("config", F.lit("b"))
    return files.undone(todo, done, ["s_suppkey", "config"])


# Statistics.


@register("select user_id, round(avg(value) filter (where value >= 20), 6) m from events group by 1")
def nan_skipping_mean(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("v", F.when(F.col("value") < 20, float("nan")).otherwise(F.col("value")))
    return e.groupBy("user_id").agg(r6(stats.nan_mean("v")).alias("m"))


@register("select event_id, row_number() over (partition by event_type order by round(value), event_id)::bigint r from events")
def ordinal_ranks(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("v", F.round("value"))
    return e.select("event_id", long(stats.ordinal_rank("v", ["event_id"], ["event_type"])).alias("r"))


@register("with v as (select 'value' as name, value v from events union all select 'user_id', user_id::double from events union all select 'event_id', event_id::double from events) select name, count(v)::bigint n, round(avg(v), 5) mean, round(stddev_samp(v), 5) sd, round(min(v), 5) low, round(quantile_cont(v, 0.25), 5) q25, round(quantile_cont(v, 0.5), 5) q50, round(quantile_cont(v, 0.75), 5) q75, round(max(v), 5) high from v group by 1")
def described(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return rounded(stats.described(e, stats.numeric(e).columns), "name", "n", digits=5)


@register("with m as (select user_id, avg(value) m, case when stddev_pop(value) < 1e-12 then 1 else stddev_pop(value) end s from events group by 1) select user_id, event_id, round((value - m) / s, 6) value from events join m using (user_id)")
def standardised(spark: SparkSession, d: str) -> DataFrame:
    z = stats.standardised(read(spark, d, "events").select("user_id", "event_id", "value"), U, ["value"])
    return z.select("user_id", "event_id", r6("value").alias("value"))


@register("select event_type, ((1 + count(*) filter (where value >= 50)) / (1 + count(*)))::double p, count(*)::bigint n from events group by 1")
def permutation_p(spark: SparkSession, d: str) -> DataFrame:
    p = stats.permutation_p(read(spark, d, "events"), "value", F.lit(50.0), ["event_type"])
    return p.select("event_type", "p", "n")


RUNS = SEGMENTS.replace(", g as", ", g0 as") + ", g as (select user_id, start_sample, case label when 'click' then 2 when 'purchase' then 3 else 1 end lab from g0)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    lab = F.when(F.col("label") == "click", 2).when(F.col("label") == "purchase", 3).otherwise(1)
    return sequence.segments(read(spark, d, "events"), U, T, "event_type").select("user_id", "start_sample", lab.alias("lab"))


@register(f"with {RUNS}, r as (select *, lab > 1 m, row_number() over (partition by user_id, lab > 1 order by start_sample) a, row_number() over (partition by user_id, lab > 1 order by md5(user_id || '|' || start_sample || '|5'), start_sample) b from g) select x.user_id, x.start_sample, case when x.m then y.lab else x.lab end::bigint lab from r x join r y on x.user_id = y.user_id and x.m = y.m and x.a = y.b")
def permuted_labels(spark: SparkSession, d: str) -> DataFrame:
    return stats.permuted_labels(_runs(spark, d), U, "lab", 5).select("user_id", "start_sample", long("lab").alias("lab"))


@register(f"with {RUNS}, r as (select *, coalesce(lead(lab) over w, first_value(lab) over w) nx, ('0x' || substr(md5(user_id || '|5'), 1, 8))::bigint % 2 = 0 flip from g window w as (partition by user_id order by start_sample)) select user_id, start_sample, case when flip then nx else lab end::bigint lab from r")
def phase_permuted(spark: SparkSession, d: str) -> DataFrame:
    return stats.phase_permuted(_runs(spark, d), U, "lab", 5).select("user_id", "start_sample", long("lab").alias("lab"))


SMALL = "with recursive x as (select s_nationkey k, row_number() over (partition by s_nationkey order by s_suppkey) r, (s_acctbal - 4500) / 100 + s_suppkey / 1e7::double v from supplier)"


@register(SMALL + ", z as (select k, v, rank() over (partition by k order by abs(v)) a from x), w as (select k, least(sum(case when v > 0 then a else 0 end), sum(case when v < 0 then a else 0 end))::bigint w, count(*) n from z group by 1), c as (select k, w, n, 0 i, 0 s from w union all select k, w, n, i + 1, s + d * (i + 1) from c, (values (0), (1)) t(d) where i < n) select k::bigint k, w, n::bigint n, round(least(1.0, 2.0 * count(*) filter (where s <= w) / pow(2.0, n)), 9)::double p from c where i = n group by k, w, n")
def signed_rank_exact(spark: SparkSession, d: str) -> DataFrame:
    v = (F.col("s_acctbal") - 4500) / 100 + F.col("s_suppkey") / 1e7
    x = read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), v.alias("v"), F.abs(v).alias("a"))
    z = stats.tie_ranks(x, "a", ["k"])
    plus, minus = (F.sum(F.when(c, F.col("_rank")).otherwise(0.0)) for c in (F.col("v") > 0, F.col("v") < 0))
    g = z.groupBy("k").agg(F.least(plus, minus).alias("w"), F.count("*").alias("n"))
    return g.select(long("k").alias("k"), long("w").alias("w"), "n", F.round(stats.signed_rank_p(F.col("w"), F.col("n")), 9).alias("p"))


LOGP = f"{TRIPLE}, l as (select vec_id, label % 3 + 1 t, label // 4 g, {LS.format('a')} a, {LS.format('b')} b from p)"


def logp(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d)
    return t.select("vec_id", (F.col("label") % 3 + 1).alias("t"), F.floor(F.col("label") / 4).alias("g"), S.log_softmax("a").alias("a"), S.log_softmax("b").alias("b"))


def auc_sql(source: str, score: str, positive: str, keys: str) -> str:
    return f"(select {keys}, case when sum(p) > 0 and sum(1 - p) > 0 then (sum(k * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * sum(1 - p)) end auc from (select {keys}, case when {positive} then 1 else 0 end p, rank() over (partition by {keys} order by {score}) + (count(*) over (partition by {keys}, {score}) - 1) / 2.0 k from {source}) group by {keys})"


@register(f"with {LOGP}, o as (select g, t, ln(exp(a[2]) + exp(a[3])) - a[1] mv, a[3] - a[2] sd from l), o2 as (select * from o where t > 1) select x.g::bigint g, round(x.auc, 6)::double auc_move, round(y.auc, 6)::double auc_side from {auc_sql('o', 'mv', 't > 1', 'g')} x left join {auc_sql('o2', 'sd', 't = 3', 'g')} y using (g)")
def two_aucs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.two_aucs(logp(spark, d), ["g"], "a", "t"), "g")


@register(f"with x as (select label % 3 g, label >= 5 p, unnest(range(64)) i, unnest(embedding)::double v from embeddings) select g::bigint g, i::bigint i, round(auc, 6)::double auc from {auc_sql('x', 'v', 'p', 'g, i')}")
def feature_aucs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("g", F.col("label") % 3).withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    return analysis.feature_aucs(e, ["g"], F.col("label") >= 5, "x").select(long("g").alias("g"), long("i").alias("i"), r6("auc").alias("auc"))


# Fusion and calibration.


@register(f"with {TRIPLE.replace('p as', 'q as', 1)}, p as (select vec_id, label % 3 + 1 t, label // 4 g, a[1] a, a[2] b, a[3] c from q), k as (select unnest(range(31)) k), j as (select k, g, t, case when a >= b + (-1.5 + 0.1 * k) and a >= c then 1 when b + (-1.5 + 0.1 * k) >= c then 2 else 3 end y from p, k), m as (select k, g, " + ", ".join(f"count(*) filter (where y = {c} and t = {c}) tp{c}, count(*) filter (where t = {c}) c{c}" for c in (1, 2, 3)) + " from j group by k, g) select k::bigint k, round(avg((" + " + ".join(f"case when c{c} > 0 then tp{c}::double / c{c} else 0 end" for c in (1, 2, 3)) + ") / 3), 6) v from m group by k")
def bias_grid_recall(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d).select((F.col("label") % 3 + 1).alias("t"), F.floor(F.col("label") / 4).alias("g"), "a")
    cand = spark.createDataFrame([(k, [0.0, -1.5 + 0.1 * k, 0.0]) for k in range(31)], "k long, bias array<double>")
    return fusion.bias_scores(t, cand, "a", "t", ["g"], "recall").select("k", r6("value").alias("v"))


def descent_sql(source: str, tag: str = "", passes: int = 2) -> str:
    """Steps of the coordinate descent over `source` (t, g, v): each takes the best bias of one class given the step before."""
    grid = "select k, round(-1.5 + 0.1 * k, 1)::double x from range(31) r(k)"
    out, last = [f"b{tag}0 as (select 0.0::double b2, 0.0::double b3)"], f"b{tag}0"
    for n in range(2 * passes):
        two, three = ("x", "b3") if n % 2 == 0 else ("b2", "x")
        j = f"select k, x, b2, b3, g, t, case when v[1] >= v[2] + {two} and v[1] >= v[3] + {three} then 1 when v[2] + {two} >= v[3] + {three} then 2 else 3 end y from {source}, {last}, ({grid})"
        cells = ", ".join(f"count(*) filter (where y = {c} and t = {c}) tp{c}, count(*) filter (where y = {c}) r{c}, count(*) filter (where t = {c}) c{c}" for c in (1, 2, 3))
        score = "least(" + ", ".join(f"case when r{c} + c{c} > 0 then 2.0::double * tp{c} / (r{c} + c{c}) else 0 end" for c in (1, 2, 3)) + ")"
        out.append(f"s{tag}{n} as (select k, x, b2, b3, avg(f) f from (select k, x, b2, b3, {score} f from (select k, x, b2, b3, g, {cells} from ({j}) group by all)) group by all)")
        keep = "x b2, b3" if n % 2 == 0 else "b2, x b3"
        out.append(f"b{tag}{n + 1} as (select {keep} from s{tag}{n} where f >= (select max(f) from s{tag}{n}) - 1e-12 order by abs(x), k limit 1)")
        last = f"b{tag}{n + 1}"
    return ", ".join(out)


@register(f"with {LOGP}, q as (select t, g, a v from l), {descent_sql('q')} select 0.0::double b1, b2, b3 from b4")
def bias_descent(spark: SparkSession, d: str) -> DataFrame:
    bias = fusion.calibrated(logp(spark, d), "a", "t", ["g"])
    return spark.createDataFrame([tuple(bias)], "b1 double, b2 double, b3 double")


WEIGHTS = (0.6, 0.7, 0.8, 0.9, 1.0)


def weight_sql() -> str:
    parts, best = [], []
    for k, w in enumerate(WEIGHTS):
        x = f"list_transform(range(1, 4), lambda i: {w} * a[i] + (1 - {w}) * b[i])"
        parts.append(f"z{k} as (select t, g, {x} c from l), q{k} as (select t, g, {LS.format('c')} v from z{k}), {descent_sql(f'q{k}', f'_{k}_')}")
        y = "case when v[1] >= v[2] + b2 and v[1] >= v[3] + b3 then 1 when v[2] + b2 >= v[3] + b3 then 2 else 3 end"
        parts.append(f"y{k} as (select g, t, {y} y from q{k}, b_{k}_4), {f1_sql(f'y{k}', 'g', tag=f'y{k}')}")
        best.append(f"select {w} w, b2, b3, (select 60 * avg(min_f1) + 30 * avg(macro_recall) from fy{k}) s, {k} k from b_{k}_4")
    return f"with {LOGP}, {', '.join(parts)}, u as ({' union all '.join(best)}) select w::double w, b2, b3, round(s, 6) as value from u order by round(s, 9) desc, k limit 1"


@register(weight_sql())
def fitted_weight(spark: SparkSession, d: str) -> DataFrame:
    m = fusion.fitted_weight(logp(spark, d), "a", "b", "t", ["g"], WEIGHTS)
    return spark.createDataFrame([(m["w"], m["bias"][1], m["bias"][2], round(m["value"], 6))], "w double, b2 double, b3 double, value double")


@register("with b as (select user_id, count(*) n, [0.0::double, avg(value) / 100, max(value) / 200] s from events group by 1) select user_id, round((n / (n + 3.0::double)) * s[1] + (1 - n / (n + 3.0::double)) * 0.1 + 0, 6) b1, round((n / (n + 3.0::double)) * s[2] + (1 - n / (n + 3.0::double)) * -0.2 + 0.05, 6) b2, round((n / (n + 3.0::double)) * s[3] + (1 - n / (n + 3.0::double)) * 0.3 - 0.05, 6) b3 from b")
def bias_shrunk(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.array(F.lit(0.0), F.avg("value") / 100, F.max("value") / 200).alias("s"))
    arr = lambda *v: F.array(*map(F.lit, v))
    out = b.withColumn("b", fusion.shrunk("s", arr(0.1, -0.2, 0.3), "n", 3.0, arr(0.0, 0.05, -0.05)))
    return out.select("user_id", *[r6(F.col("b")[k]).alias(f"b{k + 1}") for k in range(3)])


STACK = {"mu": [-1.0, -1.1, -1.2, -0.9, -1.0, -1.1], "sd": [0.5, 0.6, 0.7, 0.5, 0.6, 0.7], "w": [[0.5, -0.2, 0.1, 0.3, 0.0, -0.1], [-0.3, 0.6, 0.0, -0.1, 0.4, 0.1], [0.0, -0.1, 0.7, 0.1, -0.2, 0.5]], "b": [0.1, -0.1, 0.0]}


def linear_sql(x: str, m: dict) -> str:
    n = len(m["mu"])
    z = [f"(({x}[{k + 1}] - ({m['mu'][k]})) / {m['sd'][k]})" for k in range(n)]
    return "[" + ", ".join(" + ".join(f"({w[k]}) * {z[k]}" for k in range(n)) + f" + ({b})" for w, b in zip(m["w"], m["b"], strict=True)) + "]"


@register(f"with {LOGP}, x as (select vec_id, list_concat(a, b) x from l), c as (select vec_id, {linear_sql('x', STACK)} c from x), v as (select vec_id, {LS.format('c')} v from c) select vec_id, {spread_sql('v', LP)} from v")
def stacked_fusion(spark: SparkSession, d: str) -> DataFrame:
    t = logp(spark, d).withColumn("v", fusion.stacked("a", "b", STACK, 0.8))
    return t.select("vec_id", *[r6(F.col("v")[k]).alias(n) for k, n in enumerate(LP)])


def _by_subject(spark: SparkSession, d: str) -> DataFrame:
    return logp(spark, d).withColumn("subject", F.concat(F.lit("N"), F.col("vec_id") % 5))


@register()
def stacked_left_out(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's class by the stack that was fitted on all other subjects' answers."""
    out = stacking.unseen(_by_subject(spark, d), "a", "b", "t", "subject")
    return out.select("vec_id", "subject", F.col("t").cast("long").alias("truth"), S.argmax_first("stacked").cast("long").alias("y"))


@register()
def fitted_stack(spark: SparkSession, d: str) -> DataFrame:
    """The penalty that unseen subjects choose, its score there, and the biases of the stack of all rows."""
    m = stacking.fitted(_by_subject(spark, d), "a", "b", "t", ["g"], "subject")
    rows = [(m["c"], round(m["value"], 6), m["bias"][1], m["bias"][2])] if m else []
    return spark.createDataFrame(rows, "c double, value double, b2 double, b3 double")


FIRST = {"mu": [0.1, -0.1, 0.0], "sd": [0.5, 0.4, 0.3], "w": [1.0, -0.5, 0.2], "b": 0.3}
SECOND = {"mu": [0.0, 0.2, 0.1], "sd": [0.6, 0.5, 0.4], "w": [-0.4, 0.8, 0.1], "b": -0.2}
one_row = lambda m: linear_sql("a", {**m, "w": [m["w"]], "b": [m["b"]]})


@register(f"with {TRIPLE}, z as (select vec_id, ({one_row(FIRST)})[1] r, ({one_row(SECOND)})[1] s from p) select vec_id, round(-ln(1 + exp(-r)), 6) lp1, round(-ln(1 + exp(r)) - ln(1 + exp(s)), 6) lp2, round(-ln(1 + exp(r)) - ln(1 + exp(-s)), 6) lp3 from z")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d).withColumn("v", fusion.cascade_log_prob("a", FIRST, SECOND))
    return t.select("vec_id", *[r6(F.col("v")[k]).alias(n) for k, n in enumerate(LP)])


@register(f"with {TRIPLE}, z as (select vec_id, label, unnest(range(3)) k, unnest(a) - list_sum(a) / 3 z from p), s as (select label, stddev_pop(z) * 1.5 s from z group by 1), c as (select vec_id, list(z / s order by k) c from z join s using (label) group by 1), v as (select vec_id, {LS.format('c')} v from c) select vec_id, {spread_sql('v', LP)} from v")
def normalised_logits(spark: SparkSession, d: str) -> DataFrame:
    t = fusion.normalised_logits(triples(spark, d), ["label"], "a", 1.5).withColumn("v", S.log_softmax("a"))
    return t.select("vec_id", *[r6(F.col("v")[k]).alias(n) for k, n in enumerate(LP)])


@register(f"with {NEAR}, c as (select vec_id, list(-d2 / 2.0 order by c) c from q group by 1), v as (select vec_id, {LS.format('c')} v from c) select vec_id, {spread_sql('v', LP)} from v")
def nearest_log_prob(spark: SparkSession, d: str) -> DataFrame:
    e = class_means(_vectors(spark, d).withColumn("label", F.col("label") - 1))
    e = e.withColumn("v", fusion.nearest_mean_log_prob("x", "means", 2.0))
    return e.select("vec_id", *[r6(F.col("v")[k]).alias(n) for k, n in enumerate(LP)])


def smooth_sql(space: str) -> str:
    x = "l.a" if space == "log" else "list_transform(l.a, lambda x: exp(x))"
    base = f"n as (select g, vec_id, {x} c, row_number() over (partition by g order by vec_id) k from l)"
    a = "exp(-1 / (0.5 * 4.0::double))"
    walk = f"r as (select g, vec_id, k, c from n where k = 1 union all select n.g, n.vec_id, n.k, [{', '.join(f'{a} * r.c[{i}] + (1 - {a}) * n.c[{i}]' for i in (1, 2, 3))}] from r join n on n.g = r.g and n.k = r.k + 1)"
    v = LS.format("c") if space == "log" else "list_transform(c, lambda p: ln(p + 1e-9))"
    return f"with recursive {LOGP}, {base}, {walk}, v as (select vec_id, {v} v from r) select vec_id, {spread_sql('v', LP)} from v"


@register(smooth_sql("log"))
def smoothed_log(spark: SparkSession, d: str) -> DataFrame:
    t = fusion.smoothed(logp(spark, d), ["g"], "vec_id", "a", 0.5)
    return t.select("vec_id", *[r6(F.col("a")[k]).alias(n) for k, n in enumerate(LP)])


@register(smooth_sql("prob"))
def smoothed_prob(spark: SparkSession, d: str) -> DataFrame:
    t = fusion.smoothed(logp(spark, d), ["g"], "vec_id", "a", 0.5, space="prob")
    return t.select("vec_id", *[r6(F.col("a")[k]).alias(n) for k, n in enumerate(LP)])


@register("with x as (select label % 2 g, vec_id, unnest(range(64)) i, unnest(embedding)::double v, embedding[1]::double - embedding[2]::double s from embeddings), p as (select g, i, covar_pop(v, s) / var_pop(s) p from x group by all) select g::bigint g, i::bigint i, round(p / max(abs(p)) over (partition by g), 6) v from p")
def haufe_pattern(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    e = read(spark, d, "embeddings").select((F.col("label") % 2).alias("g"), x.alias("x")).withColumn("s", F.col("x")[0] - F.col("x")[1])
    p = signal.haufe_pattern(e, ["g"], "x", "s")
    return p.select(long("g").alias("g"), F.posexplode("pattern").alias("i", "v")).select("g", long("i").alias("i"), r6("v").alias("v"))


# Signal tables: arrays per window or sample.


@register("with w as (select label, vec_id, unnest(range(21)) c, unnest(list_transform(range(1, 22), lambda k: list_sum(list_transform(embedding[k:64:42], lambda x: abs(x::double) / 4)))) flat, unnest(list_transform(range(22, 43), lambda k: list_sum(list_transform(embedding[k:64:42], lambda x: x::double * 20)))) p from embeddings), k as (select label, c, avg(flat) flat, median(p) p, count(*) n from w group by all), d as (select *, p - median(p) over (partition by label) d from k) select label::bigint session_id, coalesce(string_agg(c, ',' order by c) filter (where n >= 8 and (flat > 0.05 or d > ln(8) or d < -ln(400))), '') bad from d group by 1")
def bad_channels(spark: SparkSession, d: str) -> DataFrame:
    of = lambda k, f: S.asum(F.transform(F.filter("embedding", lambda x, i: i % 42 == k - 1), lambda x: f(x.cast("double"))))
    part = lambda at, f: F.array(*[of(at + k, f) for k in range(21)])
    w = read(spark, d, "embeddings").select(F.col("label").alias("session_id"), part(1, lambda x: F.abs(x) / 4).alias("flat"), part(22, lambda x: x * 20).alias("power"))
    return signal.bad_channels(w).select(long("session_id").alias("session_id"), F.array_join("bad", ",").alias("bad"))


@register("with x as (select label, unnest(range(64)) i, unnest(embedding)::double v from embeddings) select label::bigint label, i::bigint i, round(avg(v), 6) v from x group by all")
def log_means(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("log"))
    m = signal.log_mean(e, ["label"]).select(long("label").alias("label"), F.posexplode("ref").alias("i", "v"))
    return m.select("label", long("i").alias("i"), r6("v").alias("v"))


@register("with x as (select vec_id, list_transform(embedding, lambda x: x::double * x::double) e from embeddings) select vec_id, unnest(range(16))::bigint k, round(unnest(list_transform(range(16), lambda k: ln(e[(k // 4) * 16 + (k % 4) * 5 + 1] + 1e-12))), 6) v from x")
def log_power(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("spd"))
    p = signal.log_power(e, 4).select("vec_id", F.posexplode("feature").alias("k", "v"))
    return p.select("vec_id", long("k").alias("k"), r6("v").alias("v"))


FILTERS, PAIRS = [[1.0, -1.0, 0.5, 0.0], [0.2, 0.3, -1.0, 1.0]], [(0, 1), (2, 3)]


def filter_sql() -> str:
    cell = lambda i, j: f"(list_sum(list_transform(range(16), lambda t: x[t * 4 + {i + 1}] * x[t * 4 + {j + 1}])) / 16)"
    cells = ", ".join(f"{cell(i, j)} c{i}{j}" for i in range(4) for j in range(4))
    along = [f"ln({' + '.join(f'({w[i] * w[j]}) * c{i}{j}' for i in range(4) for j in range(4))})" for w in FILTERS]
    power = [f"ln(c{i}{i})" for i in range(4)]
    apart = [f"case when c{i}{i} + c{j}{j} > 0 then (c{i}{i} - c{j}{j}) / (c{i}{i} + c{j}{j}) else 0 end" for i, j in PAIRS]
    return f"with e as (select vec_id, list_transform(embedding, lambda v: v::double) x from embeddings), c as (select vec_id, {cells} from e) select vec_id, " + ", ".join(f"round({v}, 6) f{k}" for k, v in enumerate(along + power + apart)) + " from c"


@register(filter_sql())
def filter_vector(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d).select("vec_id", "x")
    cell = lambda a, b: S.asum(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.get("x", t * 4 + a) * F.get("x", t * 4 + b))) / 16
    cells = F.array(*[cell(a, b) for a in range(4) for b in range(4)])
    f = signal.filter_vector(e.withColumn("spd", cells), 4, FILTERS, PAIRS)
    return f.select("vec_id", *[r6(F.col("feature")[k]).alias(f"f{k}") for k in range(8)])


HB = "h as (select label, vec_id, list_transform(range(1, 19), lambda k: list_sum(list_transform(embedding[k:64:36], lambda x: x::double))) o, list_transform(range(19, 37), lambda k: list_sum(list_transform(embedding[k:64:36], lambda x: x::double))) r from embeddings)"


def hb(spark: SparkSession, d: str) -> DataFrame:
    of = lambda k: S.asum(F.transform(F.filter("embedding", lambda x, i: i % 36 == k - 1), lambda x: x.cast("double")))
    part = lambda at: F.array(*[of(at + k) for k in range(18)])
    return read(spark, d, "embeddings").select(F.col("label").alias("session_id"), "vec_id", part(1).alias("hbo"), part(19).alias("hbr"))


@register(f"with {HB}, c as (select vec_id, list_transform(range(1, 19), lambda i: (o[i] - 0.7 * r[i]) / 2) c from h) select vec_id, round(list_sum(c[1:8]) / 8, 6) r_right, round(list_sum(c[9:16]) / 8, 6) r_left, round(list_sum(c[17:18]) / 2, 6) r_mid, round(list_sum(c[9:16]) / 8 - list_sum(c[1:8]) / 8, 6) as side_difference from c")
def slow_combination(spark: SparkSession, d: str) -> DataFrame:
    c = hb(spark, d).withColumn("c", signal.corrected(F.col("hbo"), F.col("hbr"), F.lit(0.7)))
    m = signal.region_means(F.col("c"), schemas.NIRS_REGIONS)
    return c.select("vec_id", *[r6(m[k]).alias(f"r_{n}") for k, n in enumerate(schemas.NIRS_REGIONS)], r6(signal.lateral(F.col("c"))).alias("side_difference"))


@register(f"with {HB}, e as (select label, unnest(range(18)) c, unnest(o) o, unnest(r) r from h), g as (select label, c, stddev_pop(o) / stddev_pop(r) q, corr(o, r) r from e group by all) select label::bigint session_id, round(median(q), 6) sd_ratio, round(avg(r), 6) r from g group by 1")
def sign_check(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.sign_check(hb(spark, d)).withColumn("session_id", long("session_id")), "session_id")


@register(f"with {STREAM}, n as (select user_id, sample, {CLASS} state, [value, value * 2, value - event_id % 5] v from s), b as (select *, case when lag(state) over w is distinct from state then 1 else 0 end nw from n window w as (partition by user_id order by sample)), c as (select *, sum(nw) over (partition by user_id order by sample) seg from b), g as (select user_id, min(sample) as mark, any_value(state) as label from c where state is not null group by user_id, seg), x as (select user_id, sample, unnest(['right', 'left', 'mid']) region, unnest([v[1], v[2], v[3]]) v from n), j as (select g.user_id, g.mark, g.label, region, sample - mark o, v, avg(case when sample < mark then v end) over (partition by g.user_id, mark, region) base from g join x on x.user_id = g.user_id and sample between mark - 2 and mark + 2), k as (select label, region, o, v - base v from j) select label::bigint as label, region, o::bigint as offset_, round(avg(v), 5) mean, round(avg(v) - 1.96 * stddev_pop(v) / sqrt(count(v)), 5) low, round(avg(v) + 1.96 * stddev_pop(v) / sqrt(count(v)), 5) high from k group by all")
def grand_average(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 3)
    flat = lambda v, n: F.array_repeat(v, n)
    v = F.col("value")
    n = samples(spark, d).select(F.col("user_id").alias("session_id"), F.col("sample").alias("seq"), state.alias("state"), F.concat(flat(v, 8), flat(v * 2, 8), flat(v - F.col("event_id") % 5, 2)).alias("hbo"))
    g = analysis.grand_average(n, 2, 3).withColumnRenamed("offset", "offset_")
    return rounded(g.withColumn("label", long("label")).withColumn("offset_", long("offset_")), "label", "region", "offset_", digits=5)


SPEC = f"{STREAM}, z as (select user_id % 5 session_id, event_type channel, event_id % 3 + 1 as label, (sample % 7)::double freq, avg(value + 1) power from s group by all), a as (select x.channel, x.label, x.freq, exp(avg(ln(x.power / y.power))) ratio from z x join z y on x.session_id = y.session_id and x.channel = y.channel and x.freq = y.freq and y.label = 1 where x.label > 1 group by all)"


def spec(spark: SparkSession, d: str) -> DataFrame:
    keys = ((F.col("user_id") % 5).alias("session_id"), F.col("event_type").alias("channel"), (F.col("event_id") % 3 + 1).alias("label"), (F.col("sample") % 7).cast("double").alias("freq"))
    return samples(spark, d).groupBy(*keys).agg(F.avg(F.col("value") + 1).alias("power"))


@register(f"with {SPEC} select channel, label::bigint as label, freq, round(ratio, 6) ratio from a")
def class_ratios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.class_ratios(spec(spark, d)), "channel", "label", "freq")


@register(f"with {SPEC}, e as (select *, 10 * log10(ratio) db from a), f as (select *, db - sum(db) over (partition by channel, label order by freq rows between 1 preceding and 1 following) / 3 x from e), r as (select *, row_number() over (partition by channel, label order by x desc, freq) k from f) select channel, label::bigint as label, freq, round(x, 6) excess, k::bigint as rank from r where k <= 3")
def spectral_peaks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.spectral_peaks(analysis.class_ratios(spec(spark, d)), 3, 3), "channel", "label", "freq", "rank")


# Analyses of answers.

ANSWERS = f"{STREAM}, a as (select user_id session_id, sample * 10 start_sample, sample * 10 + 8 end_sample, sample // 16 + 1 block, event_id % 3 + 1 true_y, case when value < 33 then 1 when value < 66 then 2 else 3 end y, case when event_id % 2 = 0 then event_id % 3 + 1 else 2 end y2 from s)"


def answers(spark: SparkSession, d: str) -> DataFrame:
    y = F.when(F.col("value") < 33, 1).when(F.col("value") < 66, 2).otherwise(3)
    y2 = F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 3 + 1).otherwise(2)
    s = F.col("sample")
    return samples(spark, d).select(F.col("user_id").alias("session_id"), (s * 10).alias("start_sample"), (s * 10 + 8).alias("end_sample"), (F.floor(s / 16) + 1).alias("block"), (F.col("event_id") % 3 + 1).alias("true_y"), y.alias("y"), y2.alias("y2"))


MEASURES = ("f1_1", "f1_2", "f1_3", "min_f1", "macro_recall")


@register(f"with {ANSWERS}, {f1_sql('a', 'session_id, block', 'y', 'true_y')} {rounded_sql('f', 'session_id, block::bigint as block, n::bigint n', *MEASURES)}")
def by_block(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.by_block(answers(spark, d)).withColumn("n", long("n")), "session_id", "block", "n")


LENGTHS = "g as (select session_id, start_sample seg_start, row_number() over (partition by session_id order by start_sample) r from a), h as (select session_id, seg_start from g where r % 4 = 1)"


@register(f"with {ANSWERS}, {LENGTHS}, j as (select a.*, (a.end_sample - seg_start) / 8.0::double sec from a asof join h on a.session_id = h.session_id and a.start_sample >= h.seg_start), k as (select *, case when sec >= 1 and sec < 2.5 then 0 when sec >= 2.5 and sec < 5 then 1 when sec >= 5 and sec < 9.1 then 2 end bin from j), b as (select * from k where bin is not null), {f1_sql('b', 'session_id, bin', 'y', 'true_y')} {rounded_sql('f', 'session_id, bin::bigint bin, n::bigint n', *MEASURES)}")
def by_time(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    starts = a.withColumn("r", F.row_number().over(sequence.over(["session_id"], ["start_sample"]))).where("r % 4 = 1").select("session_id", "start_sample")
    m = analysis.by_time(a, starts, 8.0)
    return rounded(m.withColumn("bin", long("bin")).withColumn("n", long("n")), "session_id", "bin", "n")


STRENGTH = "w as (select session_id, start_sample s0, start_sample + 40 s1, (session_id * 7 + start_sample // 10) % 10 db from a where (start_sample // 10) % 4 = 0)"


def strength(a: DataFrame) -> DataFrame:
    s = a.where((F.col("start_sample") / 10).cast("long") % 4 == 0)
    return s.select("session_id", "start_sample", (F.col("start_sample") + 40).alias("end_sample"), ((F.col("session_id") * 7 + (F.col("start_sample") / 10).cast("long")) % 10).alias("db"))


@register(f"with {ANSWERS}, {STRENGTH}, j as (select a.*, case when db < 2 then 'weak' when db > 6 then 'strong' else 'middle' end grp from a join w on a.session_id = w.session_id and a.start_sample >= s0 and a.end_sample <= s1), {f1_sql('j', 'session_id, grp', 'y', 'true_y')} select grp, round(avg(min_f1), 6) min_f1, round(avg(macro_recall), 6) macro_recall, count(*)::bigint n from f group by 1")
def stratified(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    return rounded(analysis.stratified(a, strength(a), 64).withColumnRenamed("group", "grp"), "grp", "n")


@register(f"with {ANSWERS}, {f1_sql('a', 'session_id', 'y', 'true_y')}, {f1_sql('a', 'session_id', 'y2', 'true_y', '2')}, p as (select f.session_id % 30 subject, avg(f.min_f1) a, avg(f2.min_f1) b from f join f2 on f.session_id = f2.session_id group by 1), z as (select round(a - b, 12) x from p), r as (select x, rank() over (order by abs(x)) + (count(*) over (partition by abs(x)) - 1) / 2.0 k from z where x <> 0) select round((select avg(a - b) from p), 6) difference, round(least(sum(case when x > 0 then k else 0 end), sum(case when x < 0 then k else 0 end)), 6)::double w, count(*)::bigint n from r")
def compared_runs(spark: SparkSession, d: str) -> DataFrame:
    run = lambda y: scoring.metrics(answers(spark, d), ["session_id"], y, "true_y").withColumn("subject", F.col("session_id") % 30)
    return analysis.compared(run("y"), run("y2"), "min_f1").select(r6("difference").alias("difference"), r6("w").alias("w"), "n")


@register(f"with {ANSWERS}, {STRENGTH}, {f1_sql('a', 'session_id', 'y', 'true_y')}, c as (select session_id, median(db) c from w group by 1), j as (select f.session_id, c.c, round(f.min_f1, 12) m from f join c using (session_id)), r as (select *, rank() over (order by c) + (count(*) over (partition by c) - 1) / 2.0 rc, rank() over (order by m) + (count(*) over (partition by m) - 1) / 2.0 rm from j), z as (select corr(rc, rm) rho, count(*)::bigint n, regr_slope(m, c) slope, regr_intercept(m, c) intercept, regr_r2(m, c) r2 from r) select round(rho, 6) rho, n, round(slope, 6) slope, round(intercept, 6) intercept, round(r2, 6) r2, round({_student_sql('z.rho', 'z.n')}, 6) p from z")
def control_correlations(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    per = scoring.metrics(a, ["session_id"], "y", "true_y").withColumn("min_f1", F.round("min_f1", 12))
    return rounded(analysis.control_correlations(per, strength(a)), "n")


@register(f"with {ANSWERS}, g as (select *, 'c' || session_id % 4 config from a), {f1_sql('g', 'config, session_id', 'y', 'true_y')}, {f1_sql('g', 'config, session_id', 'y2', 'true_y', '2')}, e as (select f.config, avg(f.min_f1) min_f1, avg(f.macro_recall) macro_recall, avg(f2.min_f1) nirs_min_f1, count(*) sessions from f join f2 on f.config = f2.config and f.session_id = f2.session_id group by 1) select config, round(min_f1, 6) min_f1, round(macro_recall, 6) macro_recall, round(nirs_min_f1, 6) nirs_min_f1, sessions::bigint sessions, round(min_f1 - lag(min_f1) over (order by config), 6) delta from e")
def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).withColumn("config", F.concat(F.lit("c"), F.col("session_id") % 4))
    doc = lambda y, n: scoring.metrics(a, ["config", "session_id"], y, "true_y").select("config", "session_id", F.struct("min_f1", "macro_recall").alias(n))
    docs = doc("y", "hybrid").join(doc("y2", "nirs_only"), ["config", "session_id"])
    return rounded(analysis.experiment_summary(docs), "config", "sessions")


@register(f"with {ANSWERS}, {LENGTHS} select a.session_id, a.start_sample::bigint start_sample, round((a.end_sample - seg_start) / 250.0::double, 6) t from a asof left join h on a.session_id = h.session_id and a.start_sample >= h.seg_start")
def time_in_segment(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    starts = a.withColumn("r", F.row_number().over(sequence.over(["session_id"], ["start_sample"]))).where("r % 4 = 1").select("session_id", "start_sample")
    return session.with_time(a, starts, 250.0).select("session_id", "start_sample", r6("t").alias("t"))


# Sources and sinks: what is written comes back.


def scratch(spark: SparkSession) -> str:
    """A new folder for a round trip: below spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/round-trip-{uuid.uuid4().hex}"


@register(f"with {ANSWERS} select 'u' || session_id session_id, end_sample::bigint end_sample, start_sample::bigint start_sample, true_y::bigint true_y, y::bigint y, y2::bigint y_eeg, null::bigint y_nirs from a")
def predictions_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    a = answers(spark, d).select(F.concat(F.lit("u"), F.col("session_id")).alias("session_id"), "end_sample", "start_sample", "true_y", "y", F.col("y2").alias("y_eeg"), F.lit(None).cast("int").alias("y_nirs"))
    files.write_predictions(a, path, packed=True)
    p = files.predictions(spark, path, packed=True)
    return p.select("session_id", *[long(c).alias(c) for c in ("end_sample", "start_sample", "true_y", "y", "y_eeg", "y_nirs")])


@register(f"with {ANSWERS}, r as (select session_id, end_sample // 40 as slot, y, y2, row_number() over (partition by session_id, end_sample // 40 order by end_sample desc) k from a) select 'u' || session_id session_id, slot::bigint as slot, y::bigint y, y2::bigint y_eeg, true as missing from r where k = 1")
def dumps_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Dumps are appended to; of rows with the same end the last one written counts, and NaN stays NaN."""
    path = scratch(spark)
    a = answers(spark, d).select(F.concat(F.lit("u"), F.col("session_id")).alias("session_id"), F.floor(F.col("end_sample") / 40).alias("end"), "y", F.col("y2").alias("y_eeg"), "end_sample")
    a = files.as_dump(a.withColumn("ls1", F.lit(float("nan"))))
    half = F.col("end_sample") % 20 < 10
    for part in (a.where(half), a.where(~half)):
        files.append_dump(part, path, "end_sample", packed=True)
    return files.dumps(spark, path, "end_sample", packed=True).select("session_id", F.col("end").alias("slot"), long("y").alias("y"), long("y_eeg").alias("y_eeg"), F.isnan("ls1").alias("missing"))


@register(f"with {ANSWERS}, {f1_sql('a', 'session_id', 'y', 'true_y')} select 'u' || session_id as session, round(min_f1, 6) min_f1, round(macro_recall, 6) macro_recall, n::bigint n, 'done' status from f")
def documents_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    m = scoring.metrics(answers(spark, d), ["session_id"], "y", "true_y")
    doc = m.select(F.concat(F.lit("u"), F.col("session_id")).alias("session"), F.lit("done").alias("status"), F.struct("min_f1", "macro_recall", F.col("n").alias("n_windows")).alias("hybrid"))
    files.write_metrics(doc, path)
    got = files.metric_documents(spark, path)
    return got.select("session", r6("hybrid.min_f1").alias("min_f1"), r6("hybrid.macro_recall").alias("macro_recall"), F.col("hybrid.n_windows").alias("n"), "status")


@register("select s_suppkey::varchar session_id, round(s_acctbal / 7, 6) mu, s_nationkey::bigint fit from supplier where s_suppkey % 2 = 0")
def models_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    s = read(spark, d, "supplier")
    arr = F.array((F.col("s_acctbal") / 7).cast("double"))
    m = s.select(F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("name"), F.col("s_suppkey").cast("string").alias("session_id"), F.col("s_nationkey").alias("fit"), arr.alias("mu"), arr.alias("sd"), F.array(arr).alias("w"), arr.alias("b"), F.create_map(F.lit("c"), F.lit("1")).alias("meta"))
    files.save_models(m, path)
    return files.load_models(spark, path, "even", {"c": "1"}).select("session_id", r6(F.col("mu")[0]).alias("mu"), long("fit").alias("fit"))


@register("select event_type, count(*)::bigint n, true again from events group by 1")
def cached_table(spark: SparkSession, d: str) -> DataFrame:
    """Made the first time, read the second: another table under the same settings isn't made."""
    folder, config = scratch(spark), {"table": "events", "by": "event_type"}
    make = lambda: read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    first = files.cached(spark, folder, config, make)
    second = files.cached(spark, folder, config, lambda: make().where("false"))
    return first.join(second.select("event_type", F.lit(True).alias("again")), "event_type")


@register("select 'u' || user_id stem, count(*)::bigint n from events group by 1")
def listed_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    e = read(spark, d, "events").withColumn("session_id", F.concat(F.lit("u"), F.col("user_id")))
    files.write_predictions(e.select("session_id", F.col("event_id").alias("end_sample")), path)
    found = files.listed(spark, path, "*.csv").select(F.regexp_extract("path", "session_id=([^/]*)", 1).alias("stem")).distinct()
    return found.join(e.groupBy(F.col("session_id").alias("stem")).agg(F.count("*").alias("n")), "stem")


EPOCH = "floor(epoch(ts::timestamp))::bigint"


@register(f"with recursive s as (select user_id, {EPOCH} t, event_id, value, row_number() over (partition by user_id order by {EPOCH}, event_id) n from events), g as (select user_id, t, avg(value) value, row_number() over (partition by user_id order by t) n from s group by user_id, t), e as (select user_id, t, n, value::double y from g where n = 1 union all select g.user_id, g.t, g.n, exp(-(g.t - e.t) / 3600.0) * e.y + (1 - exp(-(g.t - e.t) / 3600.0)) * g.value from e join g on g.user_id = e.user_id and g.n = e.n + 1) select user_id, t, round(y, 6) y from e")
def uneven_ema(spark: SparkSession, d: str) -> DataFrame:
    """An exponential mean of an hour over each user's events, at the times they come."""
    e = read(spark, d, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "value")
    e = e.groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    return sequence.ema_uneven(e, ["user_id"], "t", "value", 3600.0, "y").select("user_id", "t", r6("y").alias("y"))


OFF_GRID = 9


@register(f"with {STREAM}, x as (select user_id, sample, value / pi() a, (sample % 7 + value / 2) / pi() b from s), e as (select distinct user_id, 5 + (event_id * 13) % 40 stop from events), j as (select e.user_id, e.stop, x.sample, a, b, row_number() over (partition by e.user_id, e.stop order by x.sample desc) n from e join x on x.user_id = e.user_id and x.sample < e.stop) select user_id, stop::bigint stop, round(avg(a * a), 6) m_0_0, round(avg(a * b), 6) m_0_1, round(avg(b * b), 6) m_1_1 from j where n <= {OFF_GRID} group by all")
def off_grid_moments(spark: SparkSession, d: str) -> DataFrame:
    """Second moments of two channels over windows that end anywhere."""
    x = samples(spark, d).select("user_id", "sample", (F.col("value") / F.pi()).alias("a"), ((F.col("sample") % 7 + F.col("value") / 2) / F.pi()).alias("b"))
    ends = read(spark, d, "events").select("user_id", (5 + (F.col("event_id") * 13) % 40).alias("stop")).distinct()
    m = sequence.moments_at(x, ["user_id"], "sample", ["a", "b"], ends, "stop", OFF_GRID).where("m_0_0 is not null")
    return m.select("user_id", long("stop").alias("stop"), *[r6(c).alias(c) for c in ("m_0_0", "m_0_1", "m_1_1")])

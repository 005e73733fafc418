"""Registered queries over the driver's tables and the SQL that gives the same rows.

events is the stream: a user is a session, events are its samples in order of (ts, event_id), value is the signal and
event_type the state. lineitem and orders carry three-class truths, embeddings feature vectors, supplier, nation and region
the hierarchy of sessions and subjects. Doubles are rounded and whole numbers are 64-bit on both sides.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, filters, spd
from ..functions import scalar as S
from ..operators import crossfit, fusion, riemann, scoring, sequence, signal, spatial, stats
from ..sources import files
from ..sources.schemas import CHANNELS, NIRS_REGIONS
from . import config, session

QUERIES: dict = {}
ORACLES: dict = {}
U, T = ["user_id"], ["ts", "event_id"]


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def samples(spark: SparkSession, d: str) -> DataFrame:
    return sequence.numbered(read(spark, d, "events"), U, T).select("user_id", "sample", "event_id", "ts", "event_type", "value")


STREAM = "s as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as sample, event_id, ts, event_type, value from events)"
CODES = {"A": 1, "N": 2, "R": 3}


def truth3(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    t = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 3)
    y = F.when(F.col("l_quantity") < 17, 1).when(F.col("l_quantity") < 34, 2).otherwise(3)
    return li.select(*keep, t.alias("t"), y.alias("y"))


TRUTH = "q as (select l_suppkey, l_orderkey, l_quantity, case l_returnflag when 'A' then 1 when 'N' then 2 when 'R' then 3 end t, case when l_quantity < 17 then 1 when l_quantity < 34 then 2 else 3 end y from lineitem)"


def cells_sql(keys: str) -> str:
    parts = [f"count(*) filter (where y = {c} and t = {c}) tp{c}, count(*) filter (where y = {c}) r{c}, count(*) filter (where t = {c}) c{c}" for c in (1, 2, 3)]
    head = f"{keys}, " if keys else ""
    tail = f" group by {keys}" if keys else ""
    f1 = ", ".join(f"case when r{c} + c{c} > 0 then 2.0::double * tp{c} / (r{c} + c{c}) else 0 end f{c}, case when c{c} > 0 then tp{c}::double / c{c} else 0 end p{c}" for c in (1, 2, 3))
    return f"m as (select {head}{', '.join(parts)}, count(*) n from q{tail}), f as (select {head}n, {f1} from m)"


@register(f"with {TRUTH}, {cells_sql('l_suppkey')}, g as (select avg(least(f1, f2, f3)) a, avg((p1 + p2 + p3) / 3) b, count(*) n from f) select round(a, 6) min_f1, round(b, 6) macro_recall, round(60 * a + 30 * b + 5, 4) score, n::bigint n_sessions from g")
def session_mean_score(spark: SparkSession, d: str) -> DataFrame:
    m = scoring.metrics(truth3(spark, d, "l_suppkey"), ["l_suppkey"])
    g = scoring.session_mean(m, ["min_f1", "macro_recall"]).crossJoin(F.broadcast(m.agg(F.count("*").alias("n_sessions"))))
    score = scoring.composite(F.col("min_f1"), F.col("macro_recall"), F.lit(5.0), F.lit(0.0))
    return g.select(r6("min_f1").alias("min_f1"), r6("macro_recall").alias("macro_recall"), score.alias("score"), long("n_sessions").alias("n_sessions"))


@register(f"with {TRUTH}, {cells_sql('')} select round(f1, 6) f1_1, round(f2, 6) f1_2, round(f3, 6) f1_3, round(least(f1, f2, f3), 6) min_f1, round((p1 + p2 + p3) / 3, 6) macro_recall, n::bigint n from f")
def confusion_min_f1(spark: SparkSession, d: str) -> DataFrame:
    m = scoring.metrics(truth3(spark, d), [])
    return m.select(*[r6(f"f1_{c}").alias(f"f1_{c}") for c in (1, 2, 3)], r6("min_f1").alias("min_f1"), r6("macro_recall").alias("macro_recall"), long("n").alias("n"))


@register(f"with {TRUTH} select l_suppkey, y::bigint pred, t::bigint truth, count(*)::bigint n from q group by all")
def confusion_long(spark: SparkSession, d: str) -> DataFrame:
    return scoring.confusion(truth3(spark, d, "l_suppkey"), ["l_suppkey"]).select("l_suppkey", long("pred").alias("pred"), long("truth").alias("truth"), long("n").alias("n"))


@register(f"with {TRUTH} select y::bigint pred, count(*) filter (where t = 1)::bigint t1, count(*) filter (where t = 2)::bigint t2, count(*) filter (where t = 3)::bigint t3 from q group by y")
def confusion_wide(spark: SparkSession, d: str) -> DataFrame:
    w = scoring.confusion_wide(truth3(spark, d), [])
    return w.select(long("pred").alias("pred"), *[long(str(c)).alias(f"t{c}") for c in (1, 2, 3)])


@register(f"with {TRUTH}, c as (select l_suppkey, y, t, count(*) n from q group by all) select l_suppkey, y::bigint pred, t::bigint truth, n::bigint n, round(n / sum(n) over (partition by l_suppkey, t), 6)::double share from c")
def normalised_confusion(spark: SparkSession, d: str) -> DataFrame:
    n = scoring.normalised(scoring.confusion(truth3(spark, d, "l_suppkey"), ["l_suppkey"]), ["l_suppkey"])
    return n.select("l_suppkey", long("pred").alias("pred"), long("truth").alias("truth"), long("n").alias("n"), r6("share").alias("share"))


@register("select event_type event, round(avg(value / 1000), 6) mean_s, round(max(value / 1000), 6) max_s, count(*)::bigint n, round(least(floor(round(sum(greatest(value / 1000 - 0.2, 0)), 9) / 0.05), 20), 6)::double penalty from events group by 1")
def latency_penalty(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_type").alias("event"), (F.col("value") / 1000).alias("seconds"))
    p = e.groupBy("event").agg(r6(scoring.penalty(F.col("seconds"), *scoring.LIMITS["predict"])).alias("penalty"))
    return scoring.latency(e, []).select("event", r6("mean_s").alias("mean_s"), r6("max_s").alias("max_s"), "n").join(p, "event")


@register("with s as (select o_custkey, o_orderstatus st, avg(o_totalprice) m from orders group by all), p as (select o_custkey, max(m) filter (where st = 'F') f, max(m) filter (where st = 'O') o, max(m) filter (where st = 'P') p from s group by 1) select o_custkey, round(f, 6) f, round(o, 6) o, round(p, 6) p from p where f is not null and o is not null and p is not null")
def pivot_dropna(spark: SparkSession, d: str) -> DataFrame:
    p = scoring.complete_pivot(read(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", ["F", "O", "P"])
    return p.select("o_custkey", *[r6(c).alias(c.lower()) for c in ("F", "O", "P")])


@register("with a as (select n_regionkey, s_nationkey, avg(s_acctbal) m from supplier join nation on s_nationkey = n_nationkey group by all) select n_regionkey::bigint region, round(avg(m), 6) m from a group by 1")
def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return scoring.mean_of_means(s, ["n_regionkey"], ["s_nationkey"], "s_acctbal").select(long("n_regionkey").alias("region"), r6("s_acctbal").alias("m"))


@register("with m as (select o_orderpriority p, avg(o_totalprice) v from orders group by 1) select p, round(v, 4) v, round(v - lag(v) over (order by p), 4) delta from m")
def waterfall_delta(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.avg("o_totalprice").alias("v"))
    return m.select("p", F.round("v", 4).alias("v"), F.round(scoring.delta(m, ["p"], "v"), 4).alias("delta"))


@register(f"with {STREAM}, w as (select *, min(event_type) over f lo, max(event_type) over f hi, count(*) over f n from s window f as (partition by user_id order by sample rows between 1 preceding and current row)) select user_id, (sample - 1)::bigint start_sample, (sample + 1)::bigint end_sample, lo as label from w where lo = hi and n = 2")
def grid_windows(spark: SparkSession, d: str) -> DataFrame:
    return sequence.grid_windows(read(spark, d, "events"), U, T, "event_type", 2, 1)


@register(f"with {STREAM}, b as (select *, case when lag(event_type) over w is distinct from event_type then 1 else 0 end nw from s window w as (partition by user_id order by sample)), c as (select *, sum(nw) over (partition by user_id order by sample) seg from b) select user_id, seg::bigint seg, min(sample)::bigint start_sample, (max(sample) + 1)::bigint end_sample, min(event_type) as label from c group by user_id, seg")
def segments(spark: SparkSession, d: str) -> DataFrame:
    return sequence.segments(read(spark, d, "events"), U, T, "event_type").withColumn("seg", long("seg"))


SEGMENTS = f"{STREAM}, b as (select *, case when lag(event_type) over w is distinct from event_type then 1 else 0 end nw from s window w as (partition by user_id order by sample)), c as (select *, sum(nw) over (partition by user_id order by sample) seg from b), g as (select user_id, min(sample)::bigint start_sample, (max(sample) + 1)::bigint end_sample, min(event_type) as label from c group by user_id, seg)"


@register(f"with {SEGMENTS}, k as (select *, unnest(range(ceil(start_sample / 2)::bigint, floor((end_sample - 2) / 2)::bigint + 1)) k from g) select user_id, start_sample, end_sample, label, k::bigint k from k")
def segment_grid_points(spark: SparkSession, d: str) -> DataFrame:
    return sequence.grid_points(sequence.segments(read(spark, d, "events"), U, T, "event_type"), 2, 2).select("user_id", "start_sample", "end_sample", "label", long("k").alias("k"))


@register(f"with {SEGMENTS}, w as (select user_id, sample as end_sample from s) select w.user_id, w.end_sample::bigint end_sample, g.start_sample seg_start, g.label from w asof join g on w.user_id = g.user_id and w.end_sample - 2 >= g.start_sample")
def window_segment_asof(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    w = s.select("user_id", F.col("sample").alias("end_sample"), (F.col("sample") - 2).alias("at"))
    g = sequence.segments(read(spark, d, "events"), U, T, "event_type").withColumn("seg_start", F.col("start_sample"))
    out = sequence.asof_backward(w, g, U, "at", "start_sample", ["seg_start", "label"])
    return out.where("seg_start is not null").select("user_id", "end_sample", "seg_start", "label")


@register(f"with {STREAM}, a as (select user_id, sample from s where event_type = 'click'), m as (select user_id, sample, event_id from s where event_type = 'purchase') select a.user_id, a.sample::bigint sample, m.sample::bigint mark, m.event_id mark_event from a asof left join m on a.user_id = m.user_id and a.sample <= m.sample")
def forward_asof(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    a = s.where("event_type = 'click'").select("user_id", "sample")
    m = s.where("event_type = 'purchase'").select("user_id", F.col("sample").alias("mark"), F.col("event_id").alias("mark_event"))
    return sequence.asof_forward(a, m, U, "sample", "mark", ["mark", "mark_event"])


@register(f"with {STREAM}, a as (select user_id, sample from s), m as (select user_id, sample from s where event_type = 'view') select a.user_id, a.sample::bigint sample, count(m.sample)::bigint n from a join m on a.user_id = m.user_id and m.sample between a.sample - 9 and a.sample group by all")
def delivered_count(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    a = s.select("user_id", "sample", (F.col("sample") - 9).alias("lo"))
    m = s.where("event_type = 'view'").select("user_id", F.col("sample").alias("frame"))
    return sequence.range_join(m, a, U, "frame", "lo", "sample", 10).groupBy("user_id", "sample").agg(F.count("*").alias("n"))


@register(f"with {SEGMENTS}, w as (select user_id, sample start_sample, sample + 2 end_sample from s) select w.user_id, w.start_sample::bigint start_sample, w.end_sample::bigint end_sample, g.start_sample s_start, g.end_sample s_end, g.label s_label from w join g on w.user_id = g.user_id and w.start_sample >= g.start_sample and w.end_sample <= g.end_sample")
def theta_stratify(spark: SparkSession, d: str) -> DataFrame:
    w = samples(spark, d).select("user_id", F.col("sample").alias("start_sample"), (F.col("sample") + 2).alias("end_sample"))
    g = sequence.segments(read(spark, d, "events"), U, T, "event_type").drop("seg")
    return sequence.inside(w, g, U, 8).select("user_id", "start_sample", "end_sample", "s_start", "s_end", "s_label")


SLOPE = "sum(i * x) over f - sum(i) over f * sum(x) over f / count(*) over f"


@register(f"with {STREAM}, t as (select user_id, sample, event_id, sample::double i, value x from s), w as (select user_id, event_id, count(*) over f n, {SLOPE} num, sum(i * i) over f - sum(i) over f * sum(i) over f / count(*) over f den from t window f as (partition by user_id order by sample rows between 9 preceding and current row)) select user_id, event_id, round(case when n < 3 or den <= 1e-9 then 0 else num / den end, 6) slope from w")
def prefix_slope(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return s.select("user_id", "event_id", r6(sequence.trailing_slope("value", "sample", U, ["sample"], 10)).alias("slope"))


@register(f"with {STREAM} select user_id, event_id, round(sum(value) over w, 4) cum_x, round(sum(sample * value) over w, 3) cum_ix from s window w as (partition by user_id order by sample)")
def prefix_sums(spark: SparkSession, d: str) -> DataFrame:
    return sequence.prefix_sums(read(spark, d, "events"), U, T, "value").select("user_id", "event_id", F.round("cum_x", 4).alias("cum_x"), F.round("cum_ix", 3).alias("cum_ix"))


@register(f"with {STREAM} select user_id, event_id, round(avg(value) over (partition by user_id order by sample rows between 4 preceding and current row), 6) level_now, round(avg(value) over (partition by user_id order by sample rows between 12 preceding and 8 preceding), 6) level_lag from s")
def box_mean_lag(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return s.select("user_id", "event_id", r6(sequence.trailing_level("value", U, ["sample"], 5)).alias("level_now"), r6(sequence.trailing_level("value", U, ["sample"], 5, 8)).alias("level_lag"))


@register(f"with {STREAM}, w as (select user_id, event_id, value, first_value(value) over (partition by user_id order by sample) f, lag(value, 1) over p a, lag(value, 2) over p b, lag(value, 3) over p c, lag(value, 4) over p e from s window p as (partition by user_id order by sample)) select user_id, event_id, round((value + coalesce(a, f) + coalesce(b, f) + coalesce(c, f) + coalesce(e, f)) / 5, 6) v from w")
def clamped_trailing_mean(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return s.select("user_id", "event_id", r6(sequence.clamped_mean("value", U, ["sample"], 5)).alias("v"))


@register(f"with {STREAM} select user_id, event_id, coalesce(lead(event_type) over w, first_value(event_type) over w) label from s window w as (partition by user_id order by sample)")
def cyclic_shift(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return s.select("user_id", "event_id", sequence.cyclic_shift("event_type", U, ["sample"]).alias("label"))


@register(f"with {STREAM} select user_id, event_id, round(value - lag(value) over w, 6) diff, round(value - first_value(value) over w, 6) dc from s window w as (partition by user_id order by sample)")
def first_diff(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return s.select("user_id", "event_id", r6(sequence.first_difference("value", U, ["sample"])).alias("diff"), r6(sequence.from_first("value", U, ["sample"])).alias("dc"))


@register(f"with {STREAM}, f as (select user_id, case when round(value / 20) = round(lag(value) over (partition by user_id order by sample) / 20) then 1 else 0 end z from s) select user_id, round(avg(z), 6) share from f group by 1")
def flat_share(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("q", F.round(F.col("value") / 20))
    s = s.withColumn("z", sequence.flat("q", U, ["sample"]))
    return s.groupBy("user_id").agg(r6(stats.share_where(F.col("z"))).alias("share"))


@register(f"with {STREAM} select user_id, event_id, round(sum(value) over (partition by user_id order by sample rows between 20 preceding and 20 following) / 41, 6) v from s")
def centred_mean(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return s.select("user_id", "event_id", r6(sequence.centred_mean("value", U, ["sample"])).alias("v"))


@register("select user_id, round(list_reduce(list(value order by ts, event_id), lambda a, x: 0.9 * a + 0.1 * x), 4) ema from events group by 1")
def ema_final(spark: SparkSession, d: str) -> DataFrame:
    return sequence.ema_final(read(spark, d, "events"), U, T, "value", 0.9).select("user_id", F.round("ema", 4).alias("ema"))


@register("with r as (select user_id, list_reduce(list([value] order by ts, event_id), lambda a, x: list_append(a, 0.8 * a[-1] + 0.2 * x[1])) l from events group by 1), e as (select user_id, unnest(range(1, len(l) + 1)) k, unnest(l) v from r) select user_id, k::bigint k, round(v, 4) ema from e")
def ema_series(spark: SparkSession, d: str) -> DataFrame:
    s = sequence.ema(samples(spark, d).select("user_id", "sample", "value"), U, ["sample"], "value", 0.8)
    return s.select("user_id", (F.col("sample") + 1).alias("k"), F.round("ema", 4).alias("ema"))


@register("with a as (select user_id, event_id as tick, 0 as kind from events where event_type = 'click'), b as (select user_id, event_id - event_id % 10 as tick, 1 as kind from events where event_type = 'purchase'), u as (select * from a union all select * from b) select user_id, tick, kind::bigint kind, row_number() over (partition by user_id order by tick, kind)::bigint place from u")
def union_events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("at"))
    b = e.where("event_type = 'purchase'").select("user_id", (F.col("event_id") - F.col("event_id") % 10).alias("at"))
    return sequence.event_order(a, b, U).withColumn("kind", long("kind")).withColumnRenamed("at", "tick")


@register(f"with {STREAM}, ev as (select user_id, sample as tick from s where event_type = 'purchase'), j as (select s.user_id, ev.tick, s.sample - ev.tick as off, s.value, avg(case when s.sample < ev.tick then s.value end) over (partition by s.user_id, ev.tick) base from s join ev on s.user_id = ev.user_id and s.sample between ev.tick - 5 and ev.tick + 4) select user_id, tick::bigint tick, off::bigint as offset_, round(value - base, 6) v from j")
def baseline_epochs(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    ev = s.where("event_type = 'purchase'").select("user_id", F.col("sample").alias("at"))
    e = sequence.baseline_epochs(s, ev, U, "value", 5, 5)
    return e.select("user_id", F.col("at").alias("tick"), long("offset").alias("offset_"), r6("value").alias("v"))


@register("with p as (select o_orderkey k, o_custkey, o_orderstatus from orders), l as (select l_orderkey k, count(*) n, round(sum(l_quantity), 2) q from lineitem group by 1) select p.k, p.o_custkey, p.o_orderstatus, l.n::bigint n, l.q from p join l using (k)")
def inner_dump(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus")
    dump = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))
    return p.join(dump, "k")


@register("select c_custkey, round(max(o_totalprice), 2) top_price, count(o_orderkey)::bigint n from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P' group by 1")
def left_reindex(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("top_price"), F.count("*").alias("n"))
    return read(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@register("select f.n_nationkey::bigint fold, count(*)::bigint n, round(sum(round(s_acctbal * 100)::bigint)::double / count(*) / 100, 8) m from nation f join supplier on s_nationkey <> f.n_nationkey group by 1")
def loso_anti(spark: SparkSession, d: str) -> DataFrame:
    # Leave one out from per-subject sums: total less own, so no fold copies the rows.
    s = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.sum(long(F.round(F.col("s_acctbal") * 100))).alias("s"), F.count("*").alias("n"))
    every = s.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    f = read(spark, d, "nation").select("n_nationkey").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").crossJoin(F.broadcast(every))
    n = F.col("tn") - F.coalesce("n", F.lit(0))
    return f.select(long("n_nationkey").alias("fold"), n.alias("n"), F.round((F.col("ts") - F.coalesce("s", F.lit(0))) / n / 100, 8).alias("m"))


@register("select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P'")
def session_intersect(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))


@register("select c_custkey from customer except select o_custkey from orders where o_orderstatus = 'P'")
def session_difference(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey")
    return c.join(read(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").distinct()


@register("select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) r from orders) where r = 1")
def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    return sequence.last_per_key(read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@register("select n_regionkey::bigint region, n_nationkey::bigint nation from (select *, row_number() over (partition by n_regionkey order by n_name) r from nation) where r = 1")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return sequence.first_per_key(read(spark, d, "nation"), ["n_regionkey"], ["n_name"]).select(long("n_regionkey").alias("region"), long("n_nationkey").alias("nation"))


@register("select user_id, event_id, round(value, 6) v, r::bigint rank from (select *, row_number() over (partition by user_id order by value desc, event_id) r from events) where r <= 6")
def top_peaks(spark: SparkSession, d: str) -> DataFrame:
    t = sequence.top_k(read(spark, d, "events"), U, [F.desc("value"), "event_id"], 6)
    return t.select("user_id", "event_id", r6("value").alias("v"), "rank")


@register("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_scores(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(25)


@register("with n as (select c_custkey, row_number() over (order by c_custkey) - 1 k from customer) select c_custkey from n where k % 4 = 1")
def shard_of_files(spark: SparkSession, d: str) -> DataFrame:
    # The list of recordings is short; numbers come from its sorted order.
    c = read(spark, d, "customer").select("c_custkey").withColumn("k", F.row_number().over(Window.orderBy("c_custkey")) - 1)
    return sequence.shard(c, "k", 1, 4).select("c_custkey")


@register("select c_custkey, split_part(c_name, '#', 2) subject from customer")
def subject_of(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", S.subject_of("c_name", "#").alias("subject"))


@register("select user_id, round(median(value), 6) med, round(quantile_cont(value, 0.025), 6) q0025, round(quantile_cont(value, 0.25), 6) q0250, round(quantile_cont(value, 0.75), 6) q0750, round(quantile_cont(value, 0.975), 6) q0975 from events group by 1")
def quantiles_by_user(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "events").groupBy("user_id").agg(F.median("value").alias("med"), *stats.quantiles("value", [0.025, 0.25, 0.75, 0.975]))
    return q.select("user_id", *[r6(c).alias(c) for c in q.columns[1:]])


@register("select user_id, round(avg(case when value < 50 then 1 else 0 end), 6) share, count(distinct event_type)::bigint kinds from events group by 1")
def share_where(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(r6(stats.share_where(F.col("value") < 50)).alias("share"), F.countDistinct("event_type").alias("kinds"))


@register("select event_type, round(avg(value), 6) mean, round(avg(value) - 1.96 * stddev_pop(value) / sqrt(count(value)), 6) low, round(avg(value) + 1.96 * stddev_pop(value) / sqrt(count(value)), 6) high from events group by 1")
def mean_band(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "events").groupBy("event_type").agg(*stats.mean_band("value"))
    return b.select("event_type", *[r6(c).alias(c) for c in ("mean", "low", "high")])


@register("with x as (select vec_id, unnest(range(64))::bigint i, unnest(embedding)::double v from embeddings) select x.i, y.i j, round(covar_pop(x.v, y.v), 6) c from x join x y using (vec_id) where x.i <= y.i group by all")
def embedding_covariance(spark: SparkSession, d: str) -> DataFrame:
    """All components. A vector gives its products once, summed up before the shuffle; no rows are paired."""
    x = read(spark, d, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 1, F.size("x")), lambda b, k: F.struct(i.cast("long").alias("i"), (i + k).cast("long").alias("j"), a.alias("a"), b.alias("b")))))
    return x.select(F.explode(pairs).alias("p")).groupBy("p.i", "p.j").agg(r6(F.covar_pop("p.a", "p.b")).alias("c"))


@register("with x as (select vec_id, list_sum(list_transform(embedding, lambda v: v::double)) s, (label >= 5)::int p from embeddings), r as (select p, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 k from x) select round((sum(k * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * sum(1 - p)), 6)::double auc, sum(p)::bigint n_pos, sum(1 - p)::bigint n_neg from r")
def rank_auc(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("s", S.asum(F.transform("embedding", lambda v: v.cast("double"))))
    a = stats.rank_auc(e, "s", F.col("label") >= 5)
    return a.select(r6("auc").alias("auc"), long("n_pos").alias("n_pos"), long("n_neg").alias("n_neg"))


@register("with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 b from part) select round(corr(a, b), 6) rho, count(*)::bigint n from r")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(read(spark, d, "part"), "p_size", "p_retailprice").select(r6("rho").alias("rho"), "n")


@register("select round(regr_slope(p_retailprice, p_size), 6) slope, round(regr_intercept(p_retailprice, p_size), 4) intercept, round(regr_r2(p_retailprice, p_size), 6) r2, count(*)::bigint n from part")
def ols(spark: SparkSession, d: str) -> DataFrame:
    o = stats.ols(read(spark, d, "part"), "p_size", "p_retailprice")
    return o.select(r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), r6("r2").alias("r2"), "n")


@register("select round(corr(p_size, p_retailprice), 6) r, count(*)::bigint n from part")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return stats.pearson(read(spark, d, "part"), "p_size", "p_retailprice").select(r6("r").alias("r"), "n")


@register(f"with {STREAM} select user_id, round(stddev_pop(value) / stddev_pop(sample), 6) alpha, round(covar_pop(value, sample) / var_pop(sample), 6) beta from s group by 1 having count(*) >= 10")
def gsr_beta(spark: SparkSession, d: str) -> DataFrame:
    g = samples(spark, d).groupBy("user_id").agg((F.stddev_pop("value") / F.stddev_pop("sample")).alias("a"), (F.covar_pop("value", "sample") / F.var_pop("sample")).alias("b"), F.count("*").alias("n"))
    return g.where("n >= 10").select("user_id", r6("a").alias("alpha"), r6("b").alias("beta"))


#: Every sixth component of a vector from the k-th on, added up: six numbers that all components enter.
SIXTH = "list_sum(list_transform(embedding[{0}:64:6], lambda x: x::double))"
TRIPLE = f"p as (select vec_id, label, [{', '.join(SIXTH.format(k) for k in (1, 2, 3))}] a, [{', '.join(SIXTH.format(k) for k in (4, 5, 6))}] b from embeddings)"
LS = "list_transform({0}, lambda x: x - list_max({0}) - ln(list_sum(list_transform({0}, lambda y: exp(y - list_max({0}))))))"


def triples(spark: SparkSession, d: str) -> DataFrame:
    """Two triples from each vector, its 64 components dealt out in turn and added up."""
    e = read(spark, d, "embeddings")
    sixth = lambda k: S.asum(F.transform(F.filter("embedding", lambda x, i: i % 6 == k - 1), lambda x: x.cast("double")))
    return e.select("vec_id", "label", F.array(*map(sixth, (1, 2, 3))).alias("a"), F.array(*map(sixth, (4, 5, 6))).alias("b"))


def spread(df: DataFrame, array: str, names: tuple, *keep: str) -> DataFrame:
    return df.select(*keep, *[r6(F.element_at(array, k + 1)).alias(n) for k, n in enumerate(names)])


def spread_sql(array: str, names: tuple) -> str:
    return ", ".join(f"round({array}[{k + 1}], 6) {n}" for k, n in enumerate(names))


LP = ("lp1", "lp2", "lp3")


@register(f"with {TRIPLE}, l as (select vec_id, {LS.format('a')} v from p) select vec_id, {spread_sql('v', LP)} from l")
def log_softmax(spark: SparkSession, d: str) -> DataFrame:
    return spread(triples(spark, d).withColumn("v", S.log_softmax("a")), "v", LP, "vec_id")


@register(f"with {TRIPLE} select vec_id, round(ln(exp(a[1]) + exp(a[2])), 6) v from p")
def logaddexp(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).select("vec_id", r6(S.logaddexp(F.element_at("a", 1), F.element_at("a", 2))).alias("v"))


@register(f"with {TRIPLE}, l as (select vec_id, {LS.format('a')} a, {LS.format('b')} b from p), w as (select vec_id, [0.8 * a[1] + 0.2 * b[1], 0.8 * a[2] + 0.2 * b[2], 0.8 * a[3] + 0.2 * b[3]] c from l), f as (select vec_id, {LS.format('c')} v from w) select vec_id, {spread_sql('v', LP)}, list_position(v, list_max(v))::bigint y from f")
def fuse_loglinear(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d).select("vec_id", S.log_softmax("a").alias("a"), S.log_softmax("b").alias("b"))
    t = t.withColumn("v", fusion.log_linear("a", "b", 0.8)).withColumn("y", long(S.argmax_first("v")))
    return spread(t, "v", LP, "vec_id", "y")


@register(f"with {TRIPLE}, l as (select vec_id, {LS.format('a')} a, {LS.format('b')} b from p), f as (select vec_id, [ln(0.5 * (exp(a[1]) + exp(b[1])) + 1e-12), ln(0.5 * (exp(a[2]) + exp(b[2])) + 1e-12), ln(0.5 * (exp(a[3]) + exp(b[3])) + 1e-12)] v from l) select vec_id, {spread_sql('v', LP)} from f")
def fuse_average(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d).select("vec_id", S.log_softmax("a").alias("a"), S.log_softmax("b").alias("b"))
    return spread(t.withColumn("v", fusion.average("a", "b")), "v", LP, "vec_id")


@register(f"with {TRIPLE}, l as (select vec_id, label, {LS.format('a')} a, {LS.format('b')} b from p), w as (select vec_id, 2.0 / (2 + label % 7) k, a, b from l), m as (select vec_id, [(1 - k) * a[1] + k * b[1], (1 - k) * a[2] + k * b[2], (1 - k) * a[3] + k * b[3]] c from w), f as (select vec_id, {LS.format('c')} v from m) select vec_id, {spread_sql('v', LP)} from f")
def global_mix(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d).select("vec_id", "label", S.log_softmax("a").alias("a"), S.log_softmax("b").alias("b"))
    return spread(t.withColumn("v", fusion.mixed("a", "b", F.col("label") % 7, 2.0)), "v", LP, "vec_id")


@register(f"with {TRIPLE}, z as (select vec_id, [(a[1] - 0.1) / 0.5, (a[2] + 0.2) / 0.4, a[3] / 0.3] z from p), g as (select vec_id, [z[1] - 0.5 * z[2] + 0.1, 0.25 * z[1] + z[3], z[2] - z[3] - 0.2] c from z), f as (select vec_id, {LS.format('c')} v from g) select vec_id, {spread_sql('v', LP)} from f")
def linear_score(spark: SparkSession, d: str) -> DataFrame:
    model = {"mu": [0.1, -0.2, 0.0], "sd": [0.5, 0.4, 0.3], "w": [[1.0, -0.5, 0.0], [0.25, 0.0, 1.0], [0.0, 1.0, -1.0]], "b": [0.1, 0.0, -0.2]}
    return spread(triples(spark, d).withColumn("v", fusion.linear_log_prob("a", model)), "v", LP, "vec_id")


NEAR = "x as (select vec_id, label % 3 c, unnest(range(64)) k, unnest(embedding)::double v from embeddings), m as (select c, k, avg(v) m from x group by all), q as (select x.vec_id, x.c truth, m.c, sum((v - m) * (v - m)) d2 from x join m using (k) group by all)"


def class_means(e: DataFrame) -> DataFrame:
    """`e` (label, x) with `means`, the mean vectors of its classes in order: one row of numbers, broadcast."""
    means = e.select("label", F.posexplode("x").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("m"))
    means = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("ms")).agg(F.array_sort(F.collect_list(F.struct("label", F.transform("ms", lambda r: r["m"]).alias("m")))).alias("means"))
    return e.crossJoin(F.broadcast(means.select(F.transform("means", lambda r: r["m"]).alias("means"))))


@register(f"with {NEAR}, r as (select *, row_number() over (partition by vec_id order by d2, c) n from q) select vec_id, truth::bigint truth, (c + 1)::bigint y, round(d2, 5) d2 from r where n = 1")
def nearest_mean(spark: SparkSession, d: str) -> DataFrame:
    e = class_means(_vectors(spark, d).withColumn("label", F.col("label") - 1))
    e = e.withColumn("d2", F.transform("means", lambda m: S.asum(F.zip_with("x", m, lambda a, b: (a - b) * (a - b)))))
    return e.select("vec_id", long("label").alias("truth"), long(F.array_position("d2", F.array_min("d2"))).alias("y"), F.round(F.array_min("d2"), 5).alias("d2"))


@register(f"with {TRIPLE.replace('p as', 'q as', 1)}, p as (select vec_id, label % 3 + 1 t, label // 4 g, a[1] a, a[2] b, a[3] c from q), k as (select unnest(range(31)) k), j as (select k, g, t, case when a >= b + (-1.5 + 0.1 * k) and a >= c then 1 when b + (-1.5 + 0.1 * k) >= c then 2 else 3 end y from p, k), m as (select k, g, " + ", ".join(f"count(*) filter (where y = {c} and t = {c}) tp{c}, count(*) filter (where y = {c}) r{c}, count(*) filter (where t = {c}) c{c}" for c in (1, 2, 3)) + " from j group by k, g) select k::bigint k, round(avg(least(" + ", ".join(f"case when r{c} + c{c} > 0 then 2.0::double * tp{c} / (r{c} + c{c}) else 0 end" for c in (1, 2, 3)) + ")), 6) v from m group by k")
def bias_grid(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d).select((F.col("label") % 3 + 1).alias("t"), F.floor(F.col("label") / 4).alias("g"), "a")
    cand = spark.createDataFrame([(k, [0.0, -1.5 + 0.1 * k, 0.0]) for k in range(31)], "k long, bias array<double>")
    s = fusion.bias_scores(t, cand, "a", "t", ["g"])
    return s.select("k", r6("value").alias("v"))


@register("with s as (select event_id, user_id, props, props->>'$.k' k from events) select event_id, k, substr(md5('{\"u\":' || user_id || ',\"k\":\"' || k || '\"}'), 1, 10) h from s")
def json_hash(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))
    return e.select("event_id", "k", S.config_hash(F.col("user_id").alias("u"), F.col("k")).alias("h"))


@register("select event_id, round_even(value * 0.25, 0)::bigint step from events")
def banker_step(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", S.step_of("value").alias("step"))


@register("select event_id, case when value >= 1 and value < 2.5 then 0 when value >= 2.5 and value < 5 then 1 when value >= 5 and value < 9.1 then 2 end::bigint bin, case when value < 2 then 'weak' when value > 6 then 'strong' else 'middle' end grp from events")
def time_bins(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", long(S.time_bin("value")).alias("bin"), S.strength_group("value").alias("grp"))


@register(f"with {TRUTH}, e as (select l_suppkey % 7 fold_subject, l_suppkey, c.c, case when (case when l_quantity < c.a then 1 when l_quantity < c.b then 2 else 3 end) = t then 1.0 else 0.0 end ok from q, (values ('a', 10, 20), ('b', 17, 34), ('c', 25, 40)) c(c, a, b)), v as (select l_suppkey s, c, avg(ok) v from e group by all), f as (select s, (dense_rank() over (order by s) - 1) % 5 fold, c, v from v), g as (select fold, c, sum(v) sv, count(*) n from f group by all), i as (select fold, c, (sum(sv) over (partition by c) - sv) / (sum(n) over (partition by c) - n) inn, sv / n outr from g), r as (select *, row_number() over (partition by fold order by round(inn, 9) desc, c) k from i) select fold::bigint fold, c candidate, round(inn, 6)::double inner_v, round(outr, 6)::double outer_v from r where k = 1")
def nested_selection(spark: SparkSession, d: str) -> DataFrame:
    li = truth3(spark, d, "l_suppkey", "l_quantity")
    cand = F.broadcast(spark.createDataFrame([("a", 10, 20), ("b", 17, 34), ("c", 25, 40)], "c string, a int, b int"))
    y = F.when(F.col("l_quantity") < F.col("a"), 1).when(F.col("l_quantity") < F.col("b"), 2).otherwise(3)
    per = li.crossJoin(cand).groupBy("l_suppkey", "c").agg(F.avg((y == F.col("t")).cast("double")).alias("v"))
    n = stats.nested_selection(per, "l_suppkey", "c", "v", 5)
    return n.select(long("fold").alias("fold"), F.col("c").alias("candidate"), r6("inner").alias("inner_v"), r6("outer").alias("outer_v"))


@register("select case when o_orderpriority is null then 'all' else o_orderpriority end p, coalesce(o_orderstatus, 'all') st, count(*)::bigint n, round(avg(o_totalprice), 4) m from orders group by rollup (o_orderpriority, o_orderstatus)")
def rollup_means(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("m"))
    return g.select(F.coalesce("o_orderpriority", F.lit("all")).alias("p"), F.coalesce("o_orderstatus", F.lit("all")).alias("st"), "n", "m")


@register("with d as (select l_orderkey, sum(l_extendedprice) - sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) - 0.01 * l_orderkey x from lineitem group by 1), z as (select x, rank() over (order by abs(x)) + (count(*) over (partition by abs(x)) - 1) / 2.0 k from d where x <> 0) select round(least(sum(case when x > 0 then k else 0 end), sum(case when x < 0 then k else 0 end)), 2)::double w, count(*)::bigint n from z")
def signed_rank(spark: SparkSession, d: str) -> DataFrame:
    """Differences that are ties but for their last digits count as the table's order leaves them: an order's lines are added up in
    the order of their rows, and a hundredth of the key is the double next to it, as in the SQL on one thread."""
    at = F.struct("_metadata.file_path", "_metadata.row_index", F.col("l_extendedprice").alias("s"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("c"))
    li = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(at)).alias("rows"))
    total = lambda c: F.when(F.exists("rows", lambda r: r[c].isNotNull()), S.asum(F.filter(F.transform("rows", lambda r: r[c]), lambda v: v.isNotNull())))
    w = stats.wilcoxon(li.select((total("s") - total("c") - F.col("l_orderkey") / 100).alias("a"), F.lit(0.0).alias("b")), "a", "b")
    return w.select(F.round("w", 2).alias("w"), "n")


# Kernel queries: no SQL gives an infinite impulse response or a fitted discriminant, so these have tests instead.


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Labelled vectors cut into sessions of up to 400 and dealt to five subjects; the products of a vector's 16 rows of 4 stand for
    its covariance matrix."""
    session_id = F.concat(F.lit("s"), F.floor(F.col("vec_id") / 400))
    e = read(spark, d, "embeddings").select("*", session_id.alias("session_id"), F.concat(F.lit("N"), F.col("vec_id") % 5).alias("subject"))
    return e.select("session_id", "subject", "vec_id", (F.col("label") % 3 + 1).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


SOS = filters.butterworth(2, 0.1, 1.0, "lowpass")
(B0, B1, B2, _, A1, A2), (Z1, Z2) = SOS[0].tolist(), filters.steady_state(SOS)[0].tolist()


@register(
    f"with recursive {STREAM}, f as (select user_id, sample, {B0!r} * value + {Z1!r} * value y, {B1!r} * value - {A1!r} * ({B0!r} * value + {Z1!r} * value) + {Z2!r} * value z1, {B2!r} * value - {A2!r} * ({B0!r} * value + {Z1!r} * value) z2 from s where sample = 0"
    f" union all select s.user_id, s.sample, {B0!r} * value + z1, {B1!r} * value - {A1!r} * ({B0!r} * value + z1) + z2, {B2!r} * value - {A2!r} * ({B0!r} * value + z1) from f join s on s.user_id = f.user_id and s.sample = f.sample + 1) select user_id, sample::bigint sample, round(y, 6) filtered from f"
)
def iir_filter(spark: SparkSession, d: str) -> DataFrame:
    f = signal.filtered(samples(spark, d).select("user_id", "sample", "value"), U, ["sample"], "value", SOS)
    return f.select("user_id", "sample", r6("filtered").alias("filtered"))


@register()
def spd_tangent(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).reshape(len(x), -1, 4)
        return pd.Series(list(spd.tangent(spd.estimate(np.einsum("nti,ntj->nij", m, m) / m.shape[1], m.shape[1]))))

    return _vectors(spark, d).select("vec_id", "label", run("x").alias("tangent"))


@register()
def slda_predict(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    models = fusion.grouped_fit(v, ["session_id"], "x", "label", classify.fit_slda)
    out = fusion.applied(v, models, ["session_id"], "x")
    return out.select("session_id", "vec_id", long("label").alias("truth"), long(S.argmax_first("lp")).alias("y"))


@register()
def lr_predict(spark: SparkSession, d: str) -> DataFrame:
    """All vectors by one logistic regression of all of them: the fold that leaves nobody out."""
    v = _vectors(spark, d)
    models = crossfit.leave_one_out(v.select("subject", "label", F.col("x").alias("feature")), ["nobody"])
    out = fusion.applied(v.withColumn("left_out", F.lit("nobody")), models.withColumnRenamed("subject", "left_out"), ["left_out"], "x")
    return out.select("session_id", "vec_id", long("label").alias("truth"), long(S.argmax_first("lp")).alias("y"))


@register()
def lr_left_out(spark: SparkSession, d: str) -> DataFrame:
    """Each subject's vectors by the logistic regression of all other subjects."""
    v = _vectors(spark, d)
    models = crossfit.leave_one_out(v.select("subject", "label", F.col("x").alias("feature")), [f"N{k}" for k in range(5)])
    return fusion.applied(v, models, ["subject"], "x").select("subject", "vec_id", long("label").alias("truth"), long(S.argmax_first("lp")).alias("y"))


def _products(v: DataFrame, ridge: float = 0.0) -> DataFrame:
    """Adds `moments`, the flattened mean products of a vector's 16 rows of 4."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).reshape(len(x), -1, 4)
        c = np.einsum("nti,ntj->nij", m, m) / m.shape[1]
        return pd.Series(list((spd.ridge(c, ridge) if ridge else spd.estimate(c, m.shape[1])).reshape(len(x), -1)))

    return v.withColumn("moments", run("x"))


FOUR, ASYMMETRY = ("c3", "c4", "f3", "f4"), {"use_csp": True, "use_power": True, "use_asym": True, "symmetry": (("c3", "c4"), ("f3", "f4"))}


@register()
def csp_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of spatial filters that were trained on all subjects but a vector's own."""
    v = _products(_vectors(spark, d), 1e-3)
    trained = spatial.train(v.withColumn("prep", F.lit("raw")), FOUR, 16, most=3)
    own = trained.select("subject", F.array("filters").alias("filters"))
    return spatial.applied(v, own, ["subject"], FOUR, ASYMMETRY, column="moments", name="feature").select("subject", "vec_id", "feature")


@register()
def mdm_riemann(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's nearest class by affine-invariant distance to the Riemannian means of all classes' matrices."""
    v = _products(_vectors(spark, d))
    centres = riemann.means(v, ["label"], "moments", 4)
    out = riemann.distances(v.select("vec_id", "label", "moments"), centres, "label", "moments", 4)
    return out.select("vec_id", long("label").alias("truth"), long(F.array_position("d2", F.array_min("d2"))).alias("y"), "d2")


def _student_sql(r: str, n: str) -> str:
    """p of a correlation by Simpson's rule: the incomplete beta as an integral of powers of the sine."""
    steps = 4000
    return f"(select sum((case when i in (0, {steps}) then 1 when i % 2 = 1 then 4 else 2 end) * pow(sin(asin(sqrt(1 - {r} * {r})) * i / {steps}), {n} - 3)) * asin(sqrt(1 - {r} * {r})) / {steps} / 3 * 2 / exp(lgamma(({n} - 2) / 2.0) + lgamma(0.5) - lgamma(({n} - 1) / 2.0)) from range({steps} + 1) t(i))"


@register(f"with g as (select c_nationkey k, corr(c_acctbal, c_custkey) r, count(*) n from customer group by 1) select k::bigint k, round(r, 9) r, n::bigint n, round({_student_sql('g.r', 'g.n')}, 8) p from g where n > 3")
def correlation_p(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "customer").groupBy(long("c_nationkey").alias("k")).agg(F.corr("c_acctbal", F.col("c_custkey").cast("double")).alias("r"), F.count("*").alias("n")).where("n > 3")
    return g.select("k", F.round("r", 9).alias("r"), "n", F.round(stats.correlation_p(F.col("r"), F.col("n")), 8).alias("p"))


DRAW = "(('0x' || substr(md5({1}), 1, 8))::bigint % {0})"


@register(
    f"with {TRUTH}, {cells_sql('l_suppkey')}, x as (select l_suppkey % 10 o, least(f1, f2, f3) v from f), j as (select o, v, row_number() over (partition by o order by v) - 1 j, count(*) over (partition by o) m from x),"
    f" u as (select o, m, row_number() over (order by o) - 1 i, count(*) over () n from (select distinct o, m from j)), p as (select rep, k, {DRAW.format('n', chr(39) + '0|' + chr(39) + ' || rep || ' + chr(39) + '|' + chr(39) + ' || k')} i from range(2000) t(rep), (select distinct n from u) c, unnest(range(n)) s(k)),"
    f" h as (select rep, k, o, m, unnest(range(m)) l from p join u using (i)), w as (select rep, k, o, {DRAW.format('m', chr(39) + '0|' + chr(39) + ' || rep || ' + chr(39) + '|' + chr(39) + ' || k || ' + chr(39) + '|' + chr(39) + ' || l')} j from h), g as (select rep, k, avg(v) v from w join j using (o, j) group by all), z as (select rep, avg(v) v from g group by 1)"
    " select round(quantile_cont(v, 0.025), 6) low, round(quantile_cont(v, 0.5), 6) middle, round(quantile_cont(v, 0.975), 6) high from z"
)
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    m = scoring.metrics(truth3(spark, d, "l_suppkey"), ["l_suppkey"]).withColumn("subject", F.col("l_suppkey") % 10)
    b = stats.bootstrap(m, "subject", "min_f1", 2000)
    return b.agg(*[r6(q).alias(n) for q, n in zip(stats.quantiles("value", [0.025, 0.5, 0.975]), ("low", "middle", "high"), strict=True)])


#: Order keys of a session, samples of a segment (of which the first are a pause) and of a block.
SESSION_KEYS, SEGMENT, PAUSE, BLOCK = 18_750, 2_000, 375, 16_000
CARRIER = 2 * math.pi * 10 / 250


def table_recordings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, eeg, nirs) made of `lineitem`: each line is a sample of 21 channels, whose background follows from its columns and
    whose 10 Hz rhythm is weaker over the side away from a movement; every twentieth line is one of the slow stream. A session is a
    range of order keys, two sessions a subject; segments and blocks follow from a line's place in its session. The numbered lines
    are kept, a tenth of the samples' size and a session in one file; channels are made of them wherever they are read, so groups by
    session need no shuffle of samples."""
    n = (F.row_number().over(Window.partitionBy("session_id").orderBy("l_orderkey", "l_linenumber")) - 1).alias("sample")
    li = read(spark, d, "lineitem").withColumn("session", F.floor(F.col("l_orderkey") / SESSION_KEYS))
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * li.select("session").distinct().count() + 1)
    li = li.withColumn("session_id", F.format_string("s%05d", "session")).repartition(buckets, "session_id").select("session", "session_id", n, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    seg = F.floor(F.col("sample") / SEGMENT)
    state = F.when(F.col("sample") % SEGMENT < PAUSE, 0).when(seg % 2 == 0, 1).otherwise(2 + F.floor(seg / 2) % 2).cast("int")
    rows = li.select("*", state.alias("state"), (F.floor(F.col("sample") / BLOCK) + 1).cast("int").alias("block"))
    rows = files.landed(rows, buckets, "session_id", "sample")

    def channel(c: int, name: str) -> Column:
        ground = ((F.col("l_partkey") * (2 * c + 3) + F.col("l_suppkey") * (c + 1)) % 997) / 120.0 + (F.col("l_quantity") - 25) * ((c % 5) / 20.0) + F.col("l_extendedprice") * ((c % 3) / 40_000.0)
        away = {"c4": 2, "c3": 3}.get(name)
        size = F.lit(2.5) if away is None else F.when(F.col("state") == away, 1.0).otherwise(5.0)
        return ground + size * F.sin(F.col("sample") * CARRIER * (1 + 0.005 * c) + c)

    eeg = rows.sortWithinPartitions("session_id", "sample").select("session_id", F.col("sample").cast("long").alias("sample"), F.array(*[channel(c, name) for c, name in enumerate(CHANNELS)]).alias("x"), "state", "block")

    def slow(c: int) -> Column:
        side = 2 if c in NIRS_REGIONS["right"] else 3 if c in NIRS_REGIONS["left"] else 0
        noise = (F.col("l_discount") - 0.05) * ((c % 4) + 1) + (F.col("l_tax") - 0.04) * ((c % 3) + 1)
        return noise + F.when((F.col("state") == side) & (side > 0), (F.col("sample") % SEGMENT) / (2.0 * SEGMENT)).otherwise(0.0)

    every = rows.where(F.col("sample") % 20 == 0)
    hbo = F.array(*[slow(c) for c in range(18)])
    nirs = every.select("session_id", F.floor(F.col("sample") / 20).cast("long").alias("seq"), F.col("sample").cast("int").alias("frame"), hbo.alias("hbo"), F.transform(hbo, lambda v: -0.4 * v).alias("hbr"), "state", "block")
    sessions = rows.groupBy("session_id", "session").agg(F.count("*").alias("n_samples"))
    sessions = sessions.select("session_id", F.format_string("N%05d", F.floor(F.col("session") / 2)).alias("subject"), F.lit(250.0).alias("fs_eeg"), F.lit(12.5).alias("fs_nirs"), F.lit(True).alias("has_nirs"), F.lit(18).alias("n_nirs_ch"), "n_samples")
    return sessions, eeg, nirs


@register()
def session_plan(spark: SparkSession, d: str) -> DataFrame:
    """The final configuration over recordings made of the table of lines: about 75,000 samples a session."""
    s, eeg, nirs = table_recordings(spark, d)
    return session.scored(session.run(s, eeg, nirs, config.build(preset="final")), s)


@register()
def physiology(spark: SparkSession, d: str) -> DataFrame:
    """Side contrast and early drop of band power per session, and the drop by artefact stratum, of recordings made of `lineitem`."""
    from . import analysis

    _, eeg, _ = table_recordings(spark, d)
    segs = sequence.segments(eeg, ["session_id"], ["sample"], "state")
    return analysis.physiology(eeg, segs).join(analysis.power_by_stratum(eeg, segs), "session_id")


@register(f"with {TRUTH}, {cells_sql('l_suppkey')}, g as (select least(f1, f2, f3) a, (p1 + p2 + p3) / 3 b from f), r as (select rank() over (order by round(a, 12)) + (count(*) over (partition by round(a, 12)) - 1) / 2.0 x, rank() over (order by round(b, 12)) + (count(*) over (partition by round(b, 12)) - 1) / 2.0 y from g) select round(corr(x, y), 6) rho, count(*)::bigint n from r")
def metric_correlations(spark: SparkSession, d: str) -> DataFrame:
    m = scoring.metrics(truth3(spark, d, "l_suppkey"), ["l_suppkey"]).select(*[F.round(c, 12).alias(c) for c in ("min_f1", "macro_recall")])
    return stats.spearman(m, "min_f1", "macro_recall").select(r6("rho").alias("rho"), "n")


from . import more  # noqa: E402, F401 (registers further queries)

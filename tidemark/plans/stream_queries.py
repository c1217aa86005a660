"""Streaming and model queries: streams run over what is there and must equal their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market, models
from ..sources import sinks
from ..streaming import streams
from . import market_queries
from . import roles as R
from .insight_queries import folder
from .market_queries import filled
from .roles import E, FILLED, HISTORY

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _run(s, stream, mode="complete"):
    return streams.run_available(stream, folder(s), mode)


@query(f"with {E} select event_type as origin, cast(date_trunc('hour', ts) as timestamp) as bucket, count(*) as n from e group by 1, 2")
def streamed_hourly_counts(s, d):
    return _run(s, streams.tumbling(streams.events(s, d)))


@query(f"with {E} select event_type as origin, cast(date_trunc('hour', ts) as timestamp) + to_hours(j) as until, count(*) as n from e, (select unnest(range(1, 7)) as j) group by 1, 2")
def streamed_sliding_counts(s, d):
    return _run(s, streams.sliding(streams.events(s, d), "6 hours", "1 hour"))


@query(f"with {E} select count(distinct user_id) as n from e")
def streamed_dedup(s, d):
    return _run(s, streams.distinct(streams.events(s, d), "user_id", "60 days"), "append").groupBy().agg(F.count("*").alias("n"))


@query(market_queries.ORACLES["alert_cooldown"])
def streamed_cooldown(s, d):
    e = streams.events(s, d)
    a = e.select("event_id", F.col("event_type").alias("symbol"), "ts", (F.col("value") / 10).alias("move"), F.get_json_object("props", "$.k").cast("double").alias("volume")).where("move >= 7 and volume >= 10")
    return streams.run_cooled(a, folder(s), 30, 2.0).select("symbol", "event_id")


def _label_pairs(s, d):
    def part(kind, ts, key, id_):
        e = streams.events(s, d).where(F.col("event_type") == kind)
        return e.select(F.concat(F.lit("o"), F.col("user_id") % 3).alias(key), F.col("ts").alias(ts), F.col("event_id").alias(id_))

    return _run(s, streams.labels_with_decisions(part("purchase", "ts", "origin", "event_id"), part("click", "r_ts", "r_origin", "h_id")), "append")


@query(f"with {HISTORY} select f.event_id, h.event_id as h_id from feedback f join history h on f.origin = h.origin and abs(epoch_us(f.ts) - epoch_us(h.ts)) <= 300000000")
def streamed_label_join(s, d):
    return _label_pairs(s, d).select("event_id", "h_id")


@query(f"with {HISTORY} select event_id, h_id from matched")
def streamed_nearest_label(s, d):
    """Each label's nearest decision, answered as the watermark passes; a row of a later time ends the input."""
    end, out = folder(s), folder(s)

    def stream():
        raw = s.readStream.schema(streams.EVENTS).parquet(end)
        e = streams.events(s, d).unionByName(raw.withColumn("ts", F.col("ts").cast("timestamp")))
        part = lambda kind, name: e.where(F.col("event_type").isin(kind, "end")).select(F.when(F.col("event_type") == "end", "end").otherwise(F.concat(F.lit("o"), F.col("user_id") % 3)).alias("origin"), "ts", F.col("event_id").alias(name))
        return streams.nearest_labels(part("purchase", "event_id"), part("click", "h_id"))

    s.createDataFrame([], streams.EVENTS).write.parquet(end)
    streams.run_available(stream(), out)
    last = s.read.parquet(f"{d}/events.parquet").agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    marker = last.select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(0).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    marker.write.mode("append").parquet(end)
    return streams.run_available(stream(), out)


@query(f"with {E} select event_id, event_type from e where event_id % 2 = 1")
def idempotent_append(s, d):
    e = R.events(s, d).select("event_id", "event_type")
    return sinks.append_new(e.unionAll(e), e.where("event_id % 2 = 0"), ["event_id"])


@query(f"with {E} select event_id, case when event_id % 2 = 0 then -value else value end as value from e")
def snapshot_merge(s, d):
    e = R.events(s, d).select("event_id", "value")
    return sinks.merged(e, e.where("event_id % 2 = 0").withColumn("value", -F.col("value")), "event_id")


@query(f"""with {E} select 'sig_' || ts || '_' || upper(event_type) || '_long' as id, upper(event_type) as symbol, value as price from e where k % 10 <> 0""".replace("|| ts ||", "|| event_id ||"))
def validated_signals(s, d):
    e = R.events(s, d)
    raw = e.select(F.col("event_id").cast("string").alias("ts"), F.col("event_type").alias("symbol"), F.lit(" LONG").alias("direction"), F.lit("0.5").alias("confidence"), F.when(F.col("k") % 10 == 0, "bad").otherwise(F.col("value").cast("string")).alias("price"), F.lit("x").alias("source"), F.lit("v1").alias("model_version"))
    return sinks.valid_signals(raw)[0].select("id", "symbol", "price")


def _examples(s, d):
    x = market.returns(market.rolling_vol(market.returns(filled(s, d), 1)), 3, 6)
    return market.labelled(x, 3).withColumn("label", F.col("label").cast("double"))


@query()
def trained_direction_model(s, d):
    """p of the last bar of each symbol by a logistic regression on the labelled bars of the first four fifths of the time."""
    first, rest = models.early(_examples(s, d))
    p = models.probability(models.train(first, ["ret_1", "ret_3", "ret_6", "vol"], "lr"), rest)
    return p.groupBy("symbol").agg(F.max_by("p", "ts").alias("p_long"), F.max("ts").alias("ts"))


WEIGHT = " + ".join(f"(u > '{c}')::int" for c in models.SHARES)


BOOTSTRAP = f"""with {HISTORY}, w as (select t, power(score - label::int, 2) as e, substr(md5(event_id || ':' || t), 1, 8) as u from matched, (select unnest(range(1, 31)) as t)),
b as (select t, sum(({WEIGHT}) * e) / nullif(sum({WEIGHT}), 0) as brier from w group by 1)
select 30 as resamples, (select count(*) from matched) as n, (select round(avg(power(score - label::int, 2)), 6) from matched) as brier, round(avg(brier), 6) as mean, round(stddev_samp(brier), 6) as std from b"""


@query(BOOTSTRAP)
def bootstrap_brier(s, d):
    """The plain Brier score, and its mean and deviation over 30 resamples."""
    from .quality_queries import pairs

    p = pairs(s, d).select(F.col("event_id").alias("row"), "score", "label")
    plain = p.groupBy().agg(F.count("*").alias("n"), F.avg((F.col("score") - F.col("label").cast("int")) ** 2).alias("brier"))
    b = models.bootstrap(p, 30, "score")
    return plain.join(b).select(F.lit(30).alias("resamples"), "n", *[F.round(c, 6).alias(c) for c in ("brier", "mean", "std")])


@query(BOOTSTRAP)
def bootstrap_brier_deviation(s, d):
    """As bootstrap_brier."""
    return bootstrap_brier(s, d)

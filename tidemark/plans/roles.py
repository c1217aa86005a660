"""The driver's tables in the roles that operators want, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, NOW = "2024-01-24 00:00:00", "2024-01-31 00:00:00"


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def flags(spark, d):
    return events(spark, d).select(F.col("event_type").alias("origin"), "ts")


def triggers(spark, d):
    return events(spark, d).where("value >= 80").select(F.col("event_type").alias("origin"), "ts")


def _of(spark, d, kind: str) -> DataFrame:
    return events(spark, d).where(F.col("event_type") == kind).withColumn("origin", F.concat(F.lit("o"), F.col("user_id") % 3))


def history(spark, d):
    """Scored decisions."""
    h = _of(spark, d, "click").withColumn("score", F.least(F.col("value") / 250, F.lit(1.0)))
    return h.select("event_id", "origin", "ts", "score", (F.col("score") >= 0.2).alias("decision"), F.concat(F.lit("v"), F.col("k") % 4).alias("version"), (F.col("k") % 3 == 0).alias("drifted"))


def feedback(spark, d):
    """Labels."""
    f = _of(spark, d, "purchase")
    return f.select("event_id", "origin", "ts", (F.col("k") % 2 == 0).alias("label"), F.when(F.col("k") % 5 == 0, F.concat(F.lit("v"), F.col("k") % 4)).alias("own_version"))


def candidates(spark, d):
    return _of(spark, d, "view").select("event_id", "origin", "ts")


def ticks(spark, d):
    return events(spark, d).select("event_id", F.col("event_type").alias("symbol"), "ts", (100 + F.col("value")).alias("price"))


E = "e as (select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as int) as k from events)"
FLAGS = f"{E}, flags as (select event_type as origin, ts from e), triggers as (select event_type as origin, ts from e where value >= 80)"
DENSE = f"""{FLAGS}, g as (select origin, bucket from (select distinct origin from flags), (select unnest(generate_series(timestamp '{START}', timestamp '{NOW}' - interval 1 hour, interval 1 hour)) as bucket)),
c as (select origin, date_trunc('hour', ts) as bucket, count(*) as n from flags group by all),
dense as (select origin, bucket, coalesce(n, 0) as n from g left join c using (origin, bucket))"""
HISTORY = f"""{E}, h0 as (select event_id, 'o' || (user_id % 3) as origin, ts, least(value / 250, 1.0) as score, k from e where event_type = 'click'),
history as (select event_id, origin, ts, score, score >= 0.2 as decision, 'v' || (k % 4) as version, k % 3 = 0 as drifted from h0),
feedback as (select event_id, 'o' || (user_id % 3) as origin, ts, k % 2 = 0 as label, case when k % 5 = 0 then 'v' || (k % 4) end as own_version from e where event_type = 'purchase'),
candidates as (select event_id, 'o' || (user_id % 3) as origin, ts from e where event_type = 'view'),
m0 as (select f.event_id, f.origin, f.ts, label, own_version, h.event_id as h_id, h.ts as h_ts, score, decision, version, drifted,
       row_number() over (partition by f.event_id order by abs(epoch_us(f.ts) - epoch_us(h.ts)), h.ts, h.event_id) as i
       from feedback f join history h on f.origin = h.origin and abs(epoch_us(f.ts) - epoch_us(h.ts)) <= 300000000),
matched as (select * from m0 where i = 1)"""
TICKS = f"{E}, ticks as (select event_id, event_type as symbol, ts, 100 + value as price from e)"
BARS = f"""{TICKS}, bars as (select symbol, date_trunc('hour', ts) as ts, arg_min(price, (ts, event_id)) as open, max(price) as high, min(price) as low,
       arg_max(price, (ts, event_id)) as close, count(*) as volume from ticks group by 1, 2)"""
FILLED = f"""{BARS}, hours as (select symbol, unnest(generate_series(a, b, interval 1 hour)) as ts from (select symbol, min(ts) as a, max(ts) as b from bars group by symbol)),
f0 as (select h.symbol, h.ts, last_value(close ignore nulls) over (partition by h.symbol order by h.ts) as close, coalesce(volume, 0) as volume
       from hours h left join bars b on h.symbol = b.symbol and h.ts = b.ts),
f1 as (select *, coalesce(lag(close) over (partition by symbol order by ts), close) as before from f0),
filled as (select symbol, ts, before as open, greatest(before, close) as high, least(before, close) as low, close, volume from f1)"""

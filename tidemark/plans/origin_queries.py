"""Queries and SQL for tidemark.operators.origins and the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grid, origins
from . import roles as R
from .roles import DENSE, FLAGS, NOW, START

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"with {FLAGS}, n as (select origin, count(*) as n from (select origin from flags union all select origin from triggers) group by 1) select origin, n, round(100 * n / sum(n) over (), 2) as pct from n")
def origin_breakdown(s, d):
    return origins.breakdown(R.flags(s, d), R.triggers(s, d))


TRENDS = "select origin, date_trunc('{i}', ts) as bucket, cast(sum(f) as bigint) as flags_count, cast(sum(1 - f) as bigint) as triggers_count from (select origin, ts, 1 as f from flags union all select origin, ts, 0 from triggers) group by 1, 2"


@query(f"with {FLAGS} select origin, cast(bucket as timestamp) as bucket, flags_count, triggers_count from (" + TRENDS.format(i="hour") + ")")
def origin_trends_hourly(s, d):
    return origins.trends(R.flags(s, d), R.triggers(s, d), "hour")


@query(f"with {FLAGS} select origin, cast(max(bucket) as timestamp) as bucket, cast(sum(flags_count) as bigint) as flags_count, cast(sum(triggers_count) as bigint) as triggers_count from (" + TRENDS.format(i="day") + ") group by 1")
def origin_trends_collapsed(s, d):
    return origins.collapsed(origins.trends(R.flags(s, d), R.triggers(s, d), "day"))


PER = "p as (select origin, cast(sum(f) as bigint) as flags, cast(sum(1 - f) as bigint) as triggers from (select origin, 1 as f from flags union all select origin, 0 from triggers) group by 1)"


@query(f"with {FLAGS}, {PER} select origin, flags, triggers, round(triggers / flags, 2) as precision, round(triggers / sum(triggers) over (), 2) as recall from p where flags + triggers >= 10")
def source_metrics(s, d):
    return origins.source_metrics(R.flags(s, d), R.triggers(s, d), 10)


@query(f"""with {FLAGS}, {PER}, y as (select *, .7 * triggers / greatest(flags, 1) + (1 - .7) * flags / sum(flags) over () as y from p)
select origin, flags, triggers, round(y, 6) as yield_score, flags >= 20 as eligible, case when flags >= 20 then round(100 * y / sum(y) filter (flags >= 20) over (), 1) else 0.0 end as budget_pct from y""")
def source_yield(s, d):
    return origins.source_yield(R.flags(s, d), R.triggers(s, d), 20, 0.7)


BURST = f"with {DENSE}, z as (select *, (n - avg(n) over (partition by origin)) / nullif(stddev_pop(n) over (partition by origin), 0) as z from dense)"


@query(BURST + " select origin, cast(bucket as timestamp) as bucket, n, round(z, 6) as z from z where z >= 2")
def burst_detection(s, d):
    return origins.bursts(R.flags(s, d), START, NOW, "hour", 2.0)


@query(BURST + " select f.origin, count(z.origin) as bursts, max(round(z, 6)) as top from (select distinct origin from flags) f left join (select * from z where z >= 2) z using (origin) group by 1")
def burst_lists(s, d):
    return origins.burst_lists(R.flags(s, d), START, NOW, "hour", 2.0)


REGIME = f"""with {DENSE}, v as (select origin, stddev_pop(n) as vol from (select *, row_number() over (partition by origin order by bucket desc) as i from dense) where i <= 72 group by 1),
cuts as (select list_sort(list(vol)) as l, cast(round_even(.33 * (count(*) - 1), 0) as int) + 1 as a, cast(round_even(.66 * (count(*) - 1), 0) as int) + 1 as b from v),
r as (select origin, round(vol, 6) as vol, case when round(vol, 6) <= l[a] then 'calm' when round(vol, 6) >= l[b] then 'turbulent' else 'normal' end as regime from v, cuts)"""


@query(REGIME + " select *, cast(case regime when 'calm' then 2.2 when 'turbulent' then 3.0 else 2.5 end as double) as threshold from r")
def volatility_regimes(s, d):
    return origins.volatility_regimes(R.flags(s, d), START, NOW, "hour", 72)


CORR = "case when count(*) < 2 then 0.0 else coalesce((count(*) * sum(x * y) - sum(x) * sum(y)) / nullif(sqrt(greatest(count(*) * sum(x * x) - sum(x) * sum(x), 0)) * sqrt(greatest(count(*) * sum(y * y) - sum(y) * sum(y), 0)), 0), 0.0) end"
COUNTS = "c as (select origin, date_trunc('{i}', ts) as bucket, cast(count(*) as double) as n from flags group by all)"


@query(f"with {FLAGS}, {COUNTS.format(i='day')}, g as (select origin, bucket, coalesce(n, 0) as n from (select distinct origin from c) cross join (select distinct bucket from c) left join c using (origin, bucket)) select a.origin as a, b.origin as b, round({CORR.replace('x', 'a.n').replace('y', 'b.n').replace('ma.n', 'max')}, 3) as r from g a join g b on a.bucket = b.bucket and a.origin < b.origin group by 1, 2")
def origin_correlations(s, d):
    return origins.correlations(R.flags(s, d), "day")


LEAD = f"""l as (select a.origin as a, b.origin as b, lag, count(*) as n, round({CORR.replace('x', 'a.n').replace('y', 'b.n')}, 6) as r
  from c a cross join (select unnest(range(-6, 7)) as lag) join c b on b.bucket = a.bucket + to_hours(lag) and a.origin <> b.origin group by 1, 2, 3 having count(*) >= 3),
best as (select *, row_number() over (partition by a, b order by abs(r) desc, lag) as i from l),
lead as (select a, b, cast(lag as int) as best_lag, r, case when lag > 0 then a when lag < 0 then b else 'tie' end as leader from best where i = 1 and r <> 0)"""


@query(f"with {FLAGS}, {COUNTS.format(i='hour')}, {LEAD} select * from lead")
def lead_lag(s, d):
    return origins.lead_lag(R.flags(s, d), "hour", 6)


@query(f"""{REGIME}, hc as (select origin, bucket, cast(n as double) as n from c), {LEAD.replace('from c a', 'from hc a').replace('join c b', 'join hc b')}, {PER},
z as (select origin, (n - avg(n) over (partition by origin)) / nullif(stddev_pop(n) over (partition by origin), 0) as z, bucket from dense),
zl as (select origin, arg_max(z, bucket) as z from z group by 1), ll as (select a as origin, max(abs(r)) as lead from lead where leader = a group by 1),
sc as (select origin, round(100 * (.5 * greatest(0, least(1, coalesce(z, 0) / 5)) + .25 * coalesce(round(triggers / flags, 2), 0) + .15 * coalesce(lead, 0)
      + .1 * (case regime when 'calm' then .95 when 'turbulent' then 1.05 else 1.0 end - .9) / .2), 6) as score from zl left join p using (origin) left join ll using (origin) left join r using (origin))
select origin, score, cast(row_number() over (order by score desc, origin) as int) as rank from sc""")
def nowcast_attention(s, d):
    return origins.nowcast(R.flags(s, d), R.triggers(s, d), START, NOW)


@query(f"with {DENSE} select origin, cast(bucket as timestamp) as bucket, cast(n as bigint) as n from dense")
def densified_grid(s, d):
    return grid.densified(R.flags(s, d), START, NOW, "hour")


@query(f"with {R.E} select origin, count(*) as n from (select case when event_type = 'view' then 'unknown' when event_type = 'click' then 'twitter' when event_type = 'error' then 'rss_news' when event_type = 'signup' then 'reddit' else 'foobar' end as origin from e) group by 1")
def origin_normalisation(s, d):
    raw = F.create_map(*[F.lit(x) for x in ("view", "  ", "click", " twitter_api", "error", "rss ", "signup", "Reddit", "purchase", "FooBar")])
    return R.events(s, d).groupBy(S.normal_origin(F.element_at(raw, F.col("event_type"))).alias("origin")).agg(F.count("*").alias("n"))


@query(f"with {R.E} select coalesce(nullif(case when k % 3 = 0 then '' else event_type end, ''), 'u' || user_id) as origin, count(*) as n from e group by 1")
def truthy_origin(s, d):
    return R.events(s, d).groupBy(S.first_truthy(F.when(F.col("k") % 3 == 0, "").otherwise(F.col("event_type")), F.concat(F.lit("u"), "user_id")).alias("origin")).agg(F.count("*").alias("n"))


@query(f"""with {R.E} select event_id, case event_id % 4 when 0 then cast(ts as timestamp) when 1 then date_trunc('second', ts) when 2 then ts end as parsed,
case event_id % 4 when 0 then ts when 1 then date_trunc('second', ts) when 2 then date_trunc('second', ts) end as parsed_z,
case event_id % 4 when 0 then ts when 1 then date_trunc('second', ts) when 2 then ts end as parsed_ms from e""")
def tolerant_timestamps(s, d):
    m = F.unix_micros("ts")
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(F.col("event_id") % 4 == 1, F.floor(m / 1_000_000).cast("string"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .otherwise("bad")
    )
    ms = F.when(F.col("event_id") % 4 == 1, (F.floor(m / 1_000_000) * 1000).cast("string")).otherwise(raw)
    return R.events(s, d).select("event_id", S.parse_ts(raw).alias("parsed"), S.parse_ts_z(raw).alias("parsed_z"), S.parse_ts_ms(ms).alias("parsed_ms"))


@query(f"""with {R.E}, x as (select event_id, value, k, least(value / 100, 1.5) - .5 as a, k / 50.0 - 1 as b, k / 100.0 as c, case when k % 7 = 0 then null else k / 100.0 end as q from e)
select event_id, cast(case when q is null then 1.0 when q >= .75 then 1.25 when q >= .5 then 1.0 else .75 end as double) as w1, cast(case when q is null then 1.0 when q >= .75 then 1.25 when q <= .5 then .75 else 1.0 end as double) as w2,
cast(case when coalesce(q, 0) >= .75 then 1.25 when coalesce(q, 0) >= .5 then 1.0 else .75 end as double) as w3,
cast(case when c >= .85 then .4 when c <= .3 then .8 else .7 end as double) as other,
round(case when (a >= 0) <> (b >= 0) then (.6 * a + .4 * b) * .5 else .6 * a + .4 * b end, 6) as blend,
case when greatest(abs(a), abs(b)) >= .6 and (a >= 0) = (b >= 0) then 'high' when greatest(abs(a), abs(b)) >= .4 then 'medium' else 'low' end as conf,
case when a >= .6 then 'positive' when a <= -.6 then 'negative' else 'neutral' end as label,
case when value / 10 - 5 > 10 then 'Surging' when value / 10 - 5 > 5 then 'Rising' when value / 10 - 5 > 2 then 'Up' when value / 10 - 5 > -2 then 'Stable' when value / 10 - 5 > -5 then 'Down' else 'Falling' end as move,
round(1 / (1 + exp(-.1 * value)), 6) as logit,
round(greatest(c, 1e-9) * ln(greatest(c, 1e-9) / .5) + (1 - greatest(c, 1e-9)) * ln((1 - greatest(c, 1e-9)) / .5), 6) as kl from x""")
def scalar_bands(s, d):
    x = R.events(s, d).withColumn("a", F.least(F.col("value") / 100, F.lit(1.5)) - 0.5).withColumn("b", F.col("k") / 50.0 - 1).withColumn("c", F.col("k") / 100.0)
    q = F.when(F.col("k") % 7 != 0, F.col("c"))
    a, b, c, move = F.col("a"), F.col("b"), F.col("c"), F.col("value") / 10 - 5
    other = F.when(c >= 0.85, 0.4).when(c <= 0.3, 0.8).otherwise(0.7)
    return x.select(
        "event_id", S.weight_band(q).alias("w1"), S.weight_band_open(q).alias("w2"), S.weight_band_zero(q).alias("w3"), other.alias("other"), F.round(S.blended(a, b), 6).alias("blend"),
        S.confidence_band(a, b).alias("conf"), S.direction_label(a).alias("label"), S.movement(move).alias("move"), F.round(S.logistic(F.col("value")), 6).alias("logit"), F.round(S.bernoulli_kl(c, F.lit(0.5)), 6).alias("kl"),
    )


@query(f"with {R.E} select event_id, k from e where ts between timestamp '2024-01-10' and timestamp '2024-01-12'")
def windowed_scan(s, d):
    from ..sources import ledgers

    return ledgers.window(R.events(s, d), "2024-01-10", "2024-01-12").select("event_id", "k")


@query(f"with {R.E} select event_id, ts, value from e order by ts desc, event_id desc limit 10")
def tail_scan(s, d):
    from ..sources import ledgers

    return ledgers.tail(R.events(s, d), 10, "ts", "event_id").select("event_id", "ts", "value")


@query(f"with {R.E} select event_type, max_by(value, (ts, event_id)) as value, max(ts) as ts from e group by 1".replace("max_by(value, (ts, event_id))", "arg_max(value, (ts, event_id))"))
def latest_per_key(s, d):
    from ..sources import ledgers

    return ledgers.latest(R.events(s, d), ["event_type"], "ts", "event_id").select("event_type", "value", "ts")

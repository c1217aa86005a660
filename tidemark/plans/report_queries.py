"""Queries and SQL for tidemark.operators.reports and the remaining scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grid, models, quality, reports, social
from . import roles as R
from .market_queries import SIG, filled
from .quality_queries import CAL, pairs
from .roles import E, FILLED, FLAGS, HISTORY, NOW

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


VL = f"""{FILLED}, vr as (select symbol, ts, close / lag(close) over (partition by symbol order by ts) - 1 as ret from filled),
vv as (select symbol, ts, round(stddev_samp(ret) over (partition by symbol order by ts rows 5 preceding), 9) as vol from vr),
vc as (select symbol, list_sort(list(vol))[cast(floor(.75 * (count(*) - 1)) as int) + 1] as cut from vv where vol > 0 group by 1),
vl as (select v.symbol, ts, vol, case when vol is null or cut is null then 'n/a' when vol >= cut then 'high' else 'low' end as label from vv v left join vc using (symbol))"""


@query(f"with {VL} select symbol, ts, vol, label from vl")
def volatility_labels(s, d):
    return reports.volatility_labels(filled(s, d))


@query(f"""with {HISTORY}, matched2 as (select *, date_trunc('day', ts) + to_minutes(120 * cast(floor((hour(ts) * 60 + minute(ts)) / 120) as bigint)) as bucket from matched){CAL.format(k='origin, bucket').replace('from matched', 'from matched2')},
{VL[len(E) + 2:]}, bu as (select distinct date_trunc('hour', ts) as bucket from e where value >= 150)
select c.origin, c.bucket, n, ece, brier, n < 30 as low_n, ece > .06 as high_ece, coalesce(label, 'n/a') as volatility_regime,
case when ece > .06 then case when bu.bucket is not null then 'high_ece,social_burst_overlap' else 'high_ece' end else '' end as alerts
from cal c left join (select * from vl where symbol = 'click') v on v.ts = c.bucket left join bu on bu.bucket = c.bucket""")
def calibration_with_market(s, d):
    trend = quality.calibration(pairs(s, d).withColumn("bucket", quality.trend_bucket(F.col("ts"), 120)), ["origin", "bucket"])
    bursts = R.events(s, d).where("value >= 150").select(F.date_trunc("hour", "ts").alias("bucket"))
    return reports.enriched_trend(trend, reports.volatility_labels(filled(s, d)).where("symbol = 'click'"), bursts)


@query(f"""with {FILLED}, g as (select h.symbol, h.ts, b.close as v from hours h left join bars b on h.symbol = b.symbol and h.ts = b.ts),
w as (select *, last_value(case when v is not null then epoch(ts) end ignore nulls) over p as ta, last_value(v ignore nulls) over p as va, first_value(case when v is not null then epoch(ts) end ignore nulls) over f as tb, first_value(v ignore nulls) over f as vb
from g window p as (partition by symbol order by ts), f as (partition by symbol order by ts rows between current row and unbounded following))
select symbol, ts, round(coalesce(v, va + (vb - va) * (epoch(ts) - ta) / nullif(tb - ta, 0)), 6) as close from w""")
def interpolated_prices(s, d):
    b = grid.hourly_bars(R.ticks(s, d))
    hours = filled(s, d).select("symbol", "ts")
    return reports.interpolated(hours.join(b.select("symbol", "ts", "close"), ["symbol", "ts"], "left"), "symbol", "ts", "close").select("symbol", "ts", F.round("close", 6).alias("close"))


@query(f"""with {FLAGS}, a as (select date_trunc('hour', ts) as bucket, count(*) as x from flags where origin = 'click' group by 1), b as (select date_trunc('hour', ts) as bucket, count(*) as y from flags where origin = 'view' group by 1),
l as (select lag, round(case when count(*) < 2 then 0.0 else coalesce((count(*) * sum(x * y) - sum(x) * sum(y)) / nullif(sqrt(greatest(count(*) * sum(x * x) - sum(x) * sum(x), 0)) * sqrt(greatest(count(*) * sum(y * y) - sum(y) * sum(y), 0)), 0), 0.0) end, 6) as r
from a, (select unnest(range(-6, 7)) as lag) join b on b.bucket = a.bucket + to_hours(lag) group by 1) select cast(lag as int) as lag, r from l order by r desc, lag limit 1""")
def signed_lead_lag(s, d):
    def of(origin, name):
        return grid.counts(R.flags(s, d).where(F.col("origin") == origin), "hour").select("bucket", F.col("n").alias(name))

    return reports.signed_lead_lag(of("click", "x"), of("view", "y"), 6)


@query()
def correlation_permutation_test(s, d):
    dense = grid.densified(R.flags(s, d), R.START, NOW, "hour").groupBy("origin").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: x["n"]).alias("v"))
    a, b = dense.select(F.col("origin").alias("a"), F.col("v").alias("x")), dense.select(F.col("origin").alias("b"), F.col("v").alias("y"))
    return reports.permutation_test(a.join(b, F.col("a") < F.col("b")), 12, 99)


@query(f"with {FLAGS}, h as (select origin, cast(floor((epoch(timestamp '{NOW}') - epoch(date_trunc('second', ts))) / 3600) as bigint) as hours_ago from flags) select origin, hours_ago, count(*) as n from h where hours_ago between 0 and 71 group by 1, 2")
def relative_hour_counts(s, d):
    return reports.relative_hours(R.flags(s, d), NOW, 72)


@query(f"""with {FLAGS}, c as (select origin, date_trunc('hour', ts) as bucket, count(*) as n from flags group by 1, 2), i as (select *, row_number() over (partition by origin order by bucket desc) as i from c)
select origin, {', '.join(f'cast(sum(case when i <= {k} then n else 0 end) as bigint) as n_{k}h' for k in (1, 6, 24, 72))} from i where i <= 72 group by 1""")
def origin_feature_pack(s, d):
    return reports.feature_pack(grid.counts(R.flags(s, d), "hour"))


@query(f"""with {HISTORY}, p as (select version, date_trunc('day', ts) as day, avg(label::int) as v from matched group by 1, 2), n as (select *, row_number() over (partition by version order by day) - 1 as i from p),
s as (select version, round(coalesce((count(*) * sum(i * v) - sum(i) * sum(v)) / nullif(count(*) * sum(i * i) - sum(i) * sum(i), 0), 0), 6) as slope from n group by 1)
select version, slope, case when slope >= .001 then 'improving' when slope <= -.001 then 'declining' else 'stable' end as trend from s""")
def performance_trend(s, d):
    p = pairs(s, d).groupBy("version", F.date_trunc("day", "ts").alias("day")).agg(F.avg(F.col("label").cast("int")).alias("v"))
    return reports.trend_labels(p, "version", "day", "v", 0.001)


@query(f"""with {HISTORY}, t as (select * from history order by ts desc, event_id desc limit 64), i as (select *, row_number() over (partition by origin, version, decision, drifted order by ts desc, event_id desc) as i from t) select event_id, origin, version from i where i = 1 order by ts desc, event_id desc limit 3""")
def trigger_history_tail(s, d):
    return reports.distinct_tail(R.history(s, d), ["origin", "version", "decision", "drifted"], 64, 3, "ts", "event_id").select("event_id", "origin", "version")


@query(f"with {HISTORY}, x as (select *, event_id % 15 as df from history) select event_id, round(score * (1 - least(.5, .05 * df)), 6) as penalised from x")
def drift_penalty(s, d):
    return reports.drift_penalty(R.history(s, d).withColumn("drifted", F.col("event_id") % 15)).select("event_id", "penalised")


@query(f"""with {HISTORY}, n as (select coalesce(m.version, 'unknown') as version, count(*) filter (f.label) as tp, count(*) filter (not f.label) as fp from feedback f left join matched m using (event_id) group by 1)
select version, tp, fp, round(tp / (tp + fp), 4) as precision, cast(case when tp > 0 then 1 else 0 end as double) as recall from n""")
def quality_per_version(s, d):
    return reports.version_quality(R.feedback(s, d), pairs(s, d))


@query(f"with {HISTORY} select label, count(*) as n, max(ts) as latest from feedback group by 1")
def label_summary(s, d):
    return R.feedback(s, d).groupBy("label").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


@query(f"with {E} select case when event_id % 3 <> 0 then event_type else 'u' || user_id end as author, cast(event_id as varchar) as id from e")
def schema_alternatives(s, d):
    e = R.events(s, d)
    raw = e.select(F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise("").alias("author"), F.concat(F.lit("u"), "user_id").alias("author_id"), F.col("event_id").alias("tweet_id"))
    return reports.normal_schema(raw, {"author": ["author", "user", "author_id"], "id": ["post_id", "tweet_id"]})


@query(f"with {HISTORY} select event_id, case when score >= .5 then 'long' else 'short' end as direction, cast(case when score >= .4 then .75 when score >= .2 then .5 else .3 end as double) as confidence from history")
def shadow_conversion(s, d):
    label = F.when(F.col("score") >= 0.4, "High conf").when(F.col("score") >= 0.2, "medium").otherwise("low")
    return reports.shadow_rows(R.history(s, d), label, F.col("score")).select("event_id", "direction", "confidence")


@query(f"with {SIG} select symbol, reason, count(*) as n from (select *, case event_id % 4 when 0 then 'flip' when 1 then 'deadband' else 'other' end as reason from sig) where reason in ('flip', 'deadband') and conf >= .6 group by 1, 2")
def paper_intents(s, d):
    from .market_queries import signals

    reason = F.when(F.col("event_id") % 4 == 0, "flip").when(F.col("event_id") % 4 == 1, "deadband").otherwise("other")
    return signals(s, d).withColumn("reason", reason).where("reason in ('flip', 'deadband') and conf >= 0.6").groupBy("symbol", "reason").agg(F.count("*").alias("n"))


@query(f"""with {SIG}, p as (select symbol, ts as r_ts, min(price) as price from ticks group by 1, 2), z as (select symbol, arg_max(price, (ts, price)) as price from ticks group by 1), en as (select symbol, event_id, ts, case direction when 'long' then 1 else -1 end as side from sig),
q as (select symbol, event_id, side, i, make_timestamp(cast(epoch_us(ts) + i * 720000000 as bigint)) as at from en, (select unnest(range(0, 11)) as i)),
x as (select q.*, coalesce(p.price, z.price) as price from q asof left join p on p.symbol = q.symbol and q.at <= p.r_ts left join z on z.symbol = q.symbol),
m as (select *, side * (price / first_value(price) over (partition by event_id order by i) - 1) as move from x)
select symbol, event_id, round(coalesce(arg_min(move, i) filter (move <= -.2), arg_max(move, i)) - .001, 6) as pnl_pct, count(*) filter (move <= -.2) > 0 as stopped from m group by 1, 2""")
def paper_trades(s, d):
    """Every signal."""
    from .market_queries import signals

    entries = signals(s, d).withColumn("side", F.when(F.col("direction") == "long", 1).otherwise(-1))
    return reports.paper_trades(entries, R.ticks(s, d).select("symbol", F.col("ts").alias("r_ts"), "price"), 2, 0.001, 0.2).drop("ts")


@query()
def paper_trades_equity(s, d):
    """Every signal simulated, and each symbol's compounded equity."""
    from .market_queries import signals

    entries = signals(s, d).withColumn("side", F.when(F.col("direction") == "long", 1).otherwise(-1))
    trades = reports.paper_trades(entries, R.ticks(s, d).select("symbol", F.col("ts").alias("r_ts"), "price"), 2, 0.001, 0.2)
    return reports.paper_equity(trades, ["ts", "event_id"], entries.select("ts"))


@query(f"""with {E}, x as (select event_id, least(floor(value) / 100, 1) as trust, case k % 4 when 0 then 'low_confidence' when 1 then 'missing_agreement' when 2 then 'asset_spike' end as hint, case when k % 5 > 0 then k / 2.0 end as age, user_id % 8 as n, k % 2 = 0 as flagged from e)
select event_id, round(.4 * (1 - greatest(0, least(1, trust))) + .25 * case hint when 'low_confidence' then .6 when 'missing_agreement' then .8 when 'asset_spike' then 1 else 0 end + .2 * coalesce(greatest(0, least(1, 1 - age / 24)), .5) + .1 * least(n / 5, 1) + .05 * flagged::int, 4) as priority from x""")
def priority_scores(s, d):
    k = F.col("k")
    hint = F.when(k % 4 == 0, "low_confidence").when(k % 4 == 1, "missing_agreement").when(k % 4 == 2, "asset_spike")
    p = S.priority_score(F.least(F.floor("value") / 100, F.lit(1.0)), hint, F.when(k % 5 > 0, k / 2.0), F.col("user_id") % 8, k % 2 == 0)
    return R.events(s, d).select("event_id", p.alias("priority"))


@query(f"""with {E}, c as (select event_id, unnest([struct_pack(feature := 0, value := .1 * value), struct_pack(feature := 1, value := -.5 * k), struct_pack(feature := 2, value := .2 * user_id)]) as c from e),
o as (select event_id, c.feature as feature, c.value as value, row_number() over (partition by event_id order by abs(c.value) desc, c.feature) - 1 as place from c)
select event_id, cast(place as int) as place, feature, round(value, 6) as value from o where place < 2""")
def coefficient_contributions(s, d):
    e = R.events(s, d)
    c = S.top_contributions(F.array(F.col("value"), F.col("k").cast("double"), F.col("user_id").cast("double")), F.array(F.lit(0.1), F.lit(-0.5), F.lit(0.2)), 2)
    return e.select("event_id", F.posexplode(c).alias("place", "c")).select("event_id", "place", "c.feature", F.round("c.value", 6).alias("value"))


@query(f"with {E} select event_id, round(.6 * value / 500 + .4 * k / 100, 6) as mean, round(least(value / 500, k / 100), 6) as low, round(greatest(value / 500, k / 100), 6) as high from e")
def hybrid_ensemble(s, d):
    e = R.events(s, d).select("event_id", (F.col("value") / 500).alias("a"), (F.col("k") / 100).alias("b"))
    return models.ensemble(e, {"a": 0.6, "b": 0.4}).select("event_id", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(f"with {E} select event_id as id, round((k / 100.0 + coalesce(case when event_id % 3 = 0 then value / 500 end, k / 100.0)) / 2, 6) as score from e")
def blended_sentiment(s, d):
    e = R.events(s, d)
    return social.blended_sentiment(e.select(F.col("event_id").alias("id"), (F.col("k") / 100).alias("score")), e.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), (F.col("value") / 500).alias("score")))


@query(f"with {HISTORY}, g as (select origin, event_id, h_id, count(*) over (partition by origin) as n from matched where decision <> label) select * from g")
def disagreement_lists(s, d):
    """Each feedback that a decision disagrees with, and how many its origin has."""
    p = pairs(s, d).where("decision <> label").select("origin", "event_id", "h_id")
    n = p.groupBy(F.col("origin").alias("o")).agg(F.count("*").alias("n"))
    return p.join(n, F.col("origin").eqNullSafe(F.col("o"))).drop("o")

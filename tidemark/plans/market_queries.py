"""Queries and SQL for tidemark.operators.market on hourly bars made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, joins, market
from . import roles as R
from .roles import BARS, DENSE, FILLED, NOW, START, TICKS

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def bars(s, d):
    return grid.hourly_bars(R.ticks(s, d))


def filled(s, d):
    return grid.resampled(bars(s, d))


def predicted(s, d):
    """Bars with a score in [0, 1] that stands for a model's."""
    return filled(s, d).withColumn("p", F.try_divide(F.col("close") - F.col("low"), F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))) * 0.5 + 0.25)


def signals(s, d):
    return R.ticks(s, d).withColumn("direction", F.when(F.col("event_id") % 3 == 0, "short").otherwise("long")).withColumn("conf", (F.col("event_id") % 100) / 100.0).withColumn("own_min", F.when(F.col("event_id") % 4 == 0, 0.7))


W1 = "over (partition by symbol order by ts)"
FEAT = f"""{FILLED}, r as (select *, coalesce(close / nullif(lag(close, 1) {W1}, 0) - 1, 0.0) as ret_1, lag(close) {W1} as prev,
  coalesce((close - lag(close, 1) {W1}) / lag(close, 1) {W1}, 0.0) as x1, coalesce((close - lag(close, 3) {W1}) / lag(close, 3) {W1}, 0.0) as x3, coalesce((close - lag(close, 6) {W1}) / lag(close, 6) {W1}, 0.0) as x6 from filled)"""


@query(f"with {BARS} select symbol, ts, open, high, low, close, volume from bars")
def hourly_bars(s, d):
    return bars(s, d)


@query(f"with {FILLED} select * from filled")
def resampled_bars(s, d):
    return filled(s, d)


@query(f"with {FEAT} select symbol, ts, round(x1, 6) as ret_1, round(x3, 6) as ret_3, round(x6, 6) as ret_6 from r")
def price_returns(s, d):
    return market.returns(filled(s, d), 1, 3, 6).select("symbol", "ts", *[F.round(c, 6).alias(c) for c in ("ret_1", "ret_3", "ret_6")])


@query(f"""with {FEAT}, t as (select *, greatest(high - low, abs(high - coalesce(prev, close)), abs(low - coalesce(prev, close))) as tr from r),
a as (select *, case when count(*) over (partition by symbol order by ts rows 13 preceding) >= 14 then avg(tr) over (partition by symbol order by ts rows 13 preceding) end as a from t)
select symbol, ts, round(first_value(a ignore nulls) over (partition by symbol order by ts rows between current row and unbounded following), 6) as atr from a""")
def atr_feature(s, d):
    return market.atr(filled(s, d)).select("symbol", "ts", F.round("atr", 6).alias("atr"))


@query(f"""with {FEAT}, g as (select *, case when count(*) over w >= 12 then avg(close) over w end as sma from filled window w as (partition by symbol order by ts rows 23 preceding))
select symbol, ts, round(coalesce((close - sma) / sma, 0.0), 6) as sma_gap from g""")
def sma_gap_feature(s, d):
    return market.sma_gap(filled(s, d)).select("symbol", "ts", F.round("sma_gap", 6).alias("sma_gap"))


VOL = f"{FEAT}, v as (select *, coalesce(case when count(*) over w >= 3 then stddev_samp(x1) over w end, 0.0) as vol from r window w as (partition by symbol order by ts rows 5 preceding))"


@query(f"with {VOL} select symbol, ts, round(vol, 6) as vol, cast(vol >= quantile_cont(vol, .9) over (partition by symbol) as int) as high_vol from v")
def volatility_feature(s, d):
    return market.high_vol(market.rolling_vol(market.returns(filled(s, d), 1))).select("symbol", "ts", F.round("vol", 6).alias("vol"), "high_vol")


@query(f"""with {FILLED}, g as (select *, avg(close) over (partition by symbol order by ts rows 5 preceding) - avg(close) over (partition by symbol order by ts rows 47 preceding) as gap from filled)
select symbol, ts, cast(coalesce((gap - avg(gap) over (partition by symbol)) / nullif(stddev_samp(gap) over (partition by symbol), 0), 0) > 2 as int) as price_burst from g""")
def price_burst_feature(s, d):
    return market.price_burst(filled(s, d)).select("symbol", "ts", "price_burst")


@query(f"""with {FILLED}, a as (select *, avg(volume) over (partition by symbol order by ts rows 5 preceding) as rate, avg(volume) over (partition by symbol order by ts rows 2 preceding) as short from filled),
z as (select *, (rate - avg(rate) over p) / nullif(stddev_samp(rate) over p, 0) as z6, (short - avg(short) over p) / nullif(stddev_samp(short) over p, 0) as z3 from a window p as (partition by symbol))
select symbol, ts, round(1 / (1 + exp(-greatest(-5, least(5, coalesce(z6, 0))))), 6) as score, cast(coalesce(z3, 0) > 2 as int) as burst from z""")
def social_rate_feature(s, d):
    return market.social_rate(filled(s, d))


REG = f"""{FILLED}, g as (select *, coalesce(stddev_samp(close) over w / avg(close) over w < .06 and abs((close - lag(close, 30) over (partition by symbol order by ts)) / lag(close, 30) over (partition by symbol order by ts)) > .08, false) as t from filled window w as (partition by symbol order by ts rows 13 preceding)),
regimes as (select symbol, ts, case when t then 'trending' else 'choppy' end as regime from g)"""


@query(f"with {REG} select symbol, ts, regime from regimes")
def market_regimes(s, d):
    return market.market_regime(filled(s, d)).select("symbol", "ts", "regime")


@query(f"with {REG} select regime, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 2) as pct from regimes group by 1")
def market_regime_stats(s, d):
    return market.regime_stats(market.market_regime(filled(s, d)))


@query(f"with {FILLED}, l as (select symbol, ts, close, lead(close, 3) over (partition by symbol order by ts) as ahead from filled) select symbol, ts, cast(ahead > close as int) as label from l where ahead is not null")
def horizon_labels(s, d):
    return market.labelled(filled(s, d), 3).select("symbol", "ts", "label")


@query(f"""with {FILLED}, p as (select *, epoch(ts) - epoch(lag(ts) over (partition by symbol order by ts)) as step from filled)
select symbol, count(*) as n, min(ts) as first, max(ts) as last, coalesce(min(step), 0) >= 0 as monotonic, min(close) as low, max(close) as high, round(var_pop(close), 6) as var from p group by 1""")
def price_provenance(s, d):
    return market.provenance(filled(s, d))


@query(f"""with {FILLED}, c as (select symbol, ts, close, round((close - lag(close, 24) over (partition by symbol order by ts)) / lag(close, 24) over (partition by symbol order by ts), 6) as change, row_number() over (partition by symbol order by ts desc) as i from filled)
select symbol, ts, close, change from c where i = 1""")
def market_context(s, d):
    return market.market_context(filled(s, d), 24)


FOLDS = f"""{FILLED}, nb as (select symbol, ts, close, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) - 1 as top, lead(close) over (partition by symbol order by ts) / close - 1 as ret,
  (close - low) / greatest(high - low, 1e-9) * .5 + .25 as p from filled),
fo as (select cast(fold as int) as fold, symbol, ts, ret, p, case when i - fold * 24 < 240 then 'train' else 'test' end as part from nb, (select unnest(range(0, 5)) as fold) where i - fold * 24 >= 0 and i - fold * 24 < 360 and fold * 24 + 360 <= top + 1)"""


@query(f"with {FOLDS} select fold, symbol, ts, part from fo")
def walkforward_folds(s, d):
    return market.folds(filled(s, d), 240, 120, 5)


@query(f"""with {FOLDS}, t as (select fold, case when p >= .5 then ret else -ret end as r from fo where part = 'test' and ret is not null and greatest(p, 1 - p) >= .6)
select fold, count(*) as trades, round(avg((r > 0)::int), 6) as win_rate, round(sum(greatest(r, 0)) / nullif(sum(greatest(-r, 0)), 0), 6) as profit_factor from t group by 1""")
def fold_metrics(s, d):
    from pyspark.sql import Window as W

    b = predicted(s, d).withColumn("ret", F.lead("close").over(W.partitionBy("symbol").orderBy("ts")) / F.col("close") - 1)
    test = market.folds(filled(s, d), 240, 120, 5).where("part = 'test'").join(b, ["symbol", "ts"]).where("ret is not null")
    return market.fold_metrics(test, 0.6)


SIG = f"{TICKS}, sig as (select *, case when event_id % 3 = 0 then 'short' else 'long' end as direction, (event_id % 100) / 100.0 as conf, case when event_id % 4 = 0 then .7 end as own_min from ticks)"
PAIR = f"{SIG}, pr as (select symbol, event_id, ts, case direction when 'long' then 1 else -1 end * (lead(price) over (partition by symbol order by ts, event_id) / price - 1) as ret from sig), pw as (select * from pr where ret is not null)"
AGG = "count(*) as n, round(avg(ret), 6) as mean, round(avg(ret) / nullif(stddev_samp(ret), 0), 6) as sharpe, round(avg((ret > 0)::int), 6) as win_rate"


@query(f"with {PAIR} select symbol, {AGG} from pw group by 1 union all select 'total', {AGG} from pw")
def pairwise_backtest(s, d):
    return market.pairwise_backtest(signals(s, d))


def _returns(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("symbol").orderBy("ts", "event_id")
    side = F.when(F.col("direction") == "long", 1).otherwise(-1)
    return signals(s, d).withColumn("ret", side * (F.lead("price").over(w) / F.col("price") - 1)).where("ret is not null")


@query(f"""with {PAIR}, pf as (select symbol, count(*) as n, case when count(*) > 2 then avg(ret) / nullif(stddev_pop(ret), 0) end as sh, case when count(*) filter (ret < 0) >= 2 then avg(ret) / nullif(stddev_pop(ret) filter (ret < 0), 0) end as so,
round(avg((ret >= 0)::int), 6) as win_rate, sum(greatest(ret, 0)) / nullif(sum(greatest(-ret, 0)), 0) as f from pw group by 1)
select symbol, n, round(case when abs(sh) <= 5 then sh end, 6) as sharpe, round(case when abs(so) <= 5 then so end, 6) as sortino, win_rate, round(case when abs(f) <= 5 then f end, 6) as profit_factor from pf""")
def performance_metrics(s, d):
    return market.performance(_returns(s, d).withColumn("pnl_pct", F.col("ret")), "symbol")


@query(f"with {FILLED}, q as (select symbol, close, max(close) over (partition by symbol order by ts) as top from filled) select symbol, round(min((close - top) / top), 6) as max_drawdown from q group by 1")
def max_drawdown(s, d):
    return market.drawdown(filled(s, d), "symbol", ["ts"], "close")


@query(f"""with {PAIR}, w as (select cast(fold as int) as fold, ret from pw, (select unnest(range(0, 4)) as fold) where epoch_us(ts) / 1e6 - epoch(timestamp '{NOW}') + 14 * 86400 between fold * 302400 and (fold + 1) * 302400)
select fold, count(*) as n, round(avg(ret), 6) as mean, round(case when count(*) > 2 then avg(ret) / nullif(stddev_pop(ret), 0) end, 6) as sharpe from w group by 1""")
def walkforward_audit(s, d):
    return market.walkforward_audit(_returns(s, d), NOW, 14, 4)


@query(f"with {SIG} select event_id, symbol, direction from sig where symbol in ('click', 'view') and ts between timestamp '{START}' and timestamp '{NOW}' and conf >= coalesce(own_min, .6) and abs(conf - .5) >= .05")
def shadow_qualification(s, d):
    return market.qualified(signals(s, d), ["click", "view"], START, NOW, 0.6, 0.05).select("event_id", "symbol", "direction")


@query(f"""with recursive {SIG}, o as (select symbol, ts, event_id, direction, row_number() over (partition by symbol order by ts, event_id) as i from sig),
f as (select symbol, i, ts as kts, direction as kdir, event_id, true as kept from o where i = 1
union all select o.symbol, o.i, case when drop_it then kts else o.ts end, case when drop_it then kdir else o.direction end, o.event_id, not drop_it
from f join o on o.symbol = f.symbol and o.i = f.i + 1, lateral (select f.kdir <> o.direction and epoch_us(o.ts) - epoch_us(f.kts) < 7200000000 as drop_it))
select symbol, event_id from f where kept""")
def min_flip_gate(s, d):
    return market.min_flip(signals(s, d), 120).select("symbol", "event_id")


def alerts(s, d):
    return R.events(s, d).select("event_id", F.col("event_type").alias("symbol"), "ts", (F.col("value") / 10).alias("move"), F.col("k").cast("double").alias("volume"))


@query(f"""with recursive {R.E}, o as (select event_type as symbol, ts, event_id, value / 10 as move, row_number() over (partition by event_type order by ts, event_id) as i from e where value / 10 >= 7 and k >= 10),
f as (select symbol, i, ts as kts, move as km, event_id, true as kept from o where i = 1
union all select o.symbol, o.i, case when ok then o.ts else kts end, case when ok then o.move else km end, o.event_id, ok
from f join o on o.symbol = f.symbol and o.i = f.i + 1, lateral (select epoch_us(o.ts) - epoch_us(f.kts) >= 1800000000 or abs(o.move - f.km) >= 2 as ok))
select symbol, event_id from f where kept""")
def alert_cooldown(s, d):
    return market.cooldown(alerts(s, d)).select("symbol", "event_id")


LOOKUP = f"""with {TICKS}, z as (select symbol, max(ts) as last, arg_max(price, (ts, price)) as price from ticks group by 1), p as (select symbol, ts as r_ts, min(price) as price from ticks group by 1, 2),
l as (select event_id, event_type as symbol, ts from e)
select event_id, coalesce(p.price, z.price) as price from l asof left join p on l.symbol = p.symbol and l.ts <= p.r_ts left join z on l.symbol = z.symbol"""


@query(LOOKUP)
def forward_price_lookup(s, d):
    """Every event against every tick."""
    left = R.events(s, d).select("event_id", F.col("event_type").alias("symbol"), "ts")
    right = R.ticks(s, d).select("symbol", F.col("ts").alias("r_ts"), "price")
    return joins.forward_asof(left, right, "symbol", "price").select("event_id", "price")


@query(LOOKUP)
def forward_price_lookup_all(s, d):
    """As forward_price_lookup."""
    return forward_price_lookup(s, d)


#: Trades of a run at each point of g (conf, deb, hor), one after the other; nxt is the first bar from i on that is sure enough.
TRADES = f"""{FILLED}, x as (select symbol, ts, close, (close - low) / greatest(high - low, 1e-9) * .5 + .25 as p, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as n from filled),
nx as (select symbol, conf, deb, hor, i, n, min(case when p >= conf and i < n - 1 then i end) over (partition by symbol, conf, deb, hor order by i rows between current row and unbounded following) as nxt from x, g),
f as (select symbol, conf, deb, hor, n, nxt as sig from nx where i = 0 and nxt is not null union all
select f.symbol, f.conf, f.deb, f.hor, f.n, nx.nxt from f join nx on nx.symbol = f.symbol and nx.conf = f.conf and nx.deb = f.deb and nx.hor = f.hor and nx.i = least(f.sig + 1 + f.hor, f.n - 1) + f.deb where nx.nxt is not null),
r as (select f.symbol, f.conf, f.deb, f.hor, sig, b.close / a.close - 1 - .0006 as r from f join x a on a.symbol = f.symbol and a.i = sig + 1 join x b on b.symbol = f.symbol and b.i = least(sig + 1 + f.hor, f.n - 1)),
q as (select *, product(1 + r) over (partition by symbol, conf, deb, hor order by sig) as eq from r),
m as (select *, eq / greatest(1, max(eq) over (partition by symbol, conf, deb, hor order by sig)) - 1 as dd from q),
t as (select symbol, conf, deb, hor, count(*) as trades, avg((r > 0)::int) as win_rate, coalesce(sum(r) filter (r > 0), 0) / coalesce(nullif(-sum(r) filter (r < 0), 0), 1) as profit_factor, least(0, min(dd)) as max_drawdown, arg_max(eq, sig) as equity from m group by 1, 2, 3, 4),
o as (select s.symbol, g.conf, g.deb, g.hor, coalesce(trades, 0) as trades, coalesce(win_rate, 0) as win_rate, coalesce(profit_factor, 0) as profit_factor, coalesce(max_drawdown, 0) as max_drawdown, coalesce(equity, 1) as equity
from (select distinct symbol from x) s, g left join t on t.symbol = s.symbol and t.conf = g.conf and t.deb = g.deb and t.hor = g.hor)"""
FIGURES = ("win_rate", "profit_factor", "max_drawdown", "equity")


@query(f"with recursive g as (select .7 as conf, 10 as deb, 3 as hor), {TRADES} select symbol, trades, {', '.join(f'round({c}, 6) as {c}' for c in FIGURES)} from o")
def stateful_backtest(s, d):
    return market.backtest(predicted(s, d), 0.7, 10, 3).select("symbol", "trades", *[F.round(c, 6).alias(c) for c in FIGURES])


@query(f"""with recursive g as (select * from (values (.6), (.7)) a(conf), (values (5), (10)) b(deb), (values (2), (3)) c(hor)), {TRADES},
w as (select cast(conf as double) as conf, deb as debounce, hor as horizon, cast(sum(trades) as bigint) as trades, round(coalesce(sum(win_rate * trades) / nullif(sum(trades), 0), 0), 6) as win_rate, round(coalesce(sum(profit_factor * trades) / nullif(sum(trades), 0), 0), 6) as profit_factor, round(min(max_drawdown), 6) as max_drawdown from o group by 1, 2, 3)
select *, row_number() over (order by trades >= 50 desc, profit_factor desc, max_drawdown, conf, debounce, horizon) as place from w""")
def threshold_grid_search(s, d):
    return market.tuned(market.grid_search(predicted(s, d), [(c, b, h) for c in (0.6, 0.7) for b in (5, 10) for h in (2, 3)]), 50)


@query(f"""with recursive {FILLED}, o as (select symbol, ts, cast(volume as double) as v, row_number() over (partition by symbol order by ts) as i from filled),
f as (select symbol, ts, i, v as ema from o where i = 1 union all select o.symbol, o.ts, o.i, 2 / 7 * o.v + (1 - 2 / 7) * f.ema from f join o on o.symbol = f.symbol and o.i = f.i + 1)
select symbol, ts, round(ema, 6) as ema from f""")
def ema_feature(s, d):
    return market.ema(filled(s, d).withColumn("volume", F.col("volume").cast("double")), "volume", 6)


@query(f"""with {DENSE}, t as (select origin, date_trunc('hour', ts) as bucket, count(*) as t from triggers group by 1, 2),
x as (select d.origin, d.bucket, n, coalesce(t, 0) as t from dense d left join t on d.origin = t.origin and d.bucket = t.bucket),
y as (select origin, cast(bucket as timestamp) as bucket, cast(sum(n) over (w rows 0 preceding) as bigint) as n_1h, cast(sum(n) over (w rows 5 preceding) as bigint) as n_6h, cast(sum(n) over (w rows 23 preceding) as bigint) as n_24h, cast(sum(n) over (w rows 71 preceding) as bigint) as n_72h,
round(coalesce((n - avg(n) over (w rows between unbounded preceding and 1 preceding)) / nullif(stddev_pop(n) over (w rows between unbounded preceding and 1 preceding), 0), 0.0), 6) as z,
round(coalesce(stddev_pop(n) over (w rows between 72 preceding and 1 preceding), 0.0), 6) as vol, cast(coalesce(max(t) over (w rows between 1 following and 6 following), 0) > 0 as int) as label,
row_number() over w as i, count(*) over (partition by origin) as m from x window w as (partition by origin order by bucket))
select * exclude (i, m) from y where i > 6 and i <= m - 6""")
def trailing_examples(s, d):
    return market.trailing_examples(grid.densified(R.flags(s, d), START, NOW, "hour"), R.triggers(s, d))

"""Queries and SQL for tidemark.operators.insight, the scalar functions and the ledgers on disk."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import shared
from ..functions import scalars as S
from ..operators import governance, grid, insight, market, models, quality, reports
from ..sources import ledgers, sinks
from . import market_queries, quality_queries
from . import roles as R
from .market_queries import filled
from .review_queries import Q, queue
from .roles import BARS, DENSE, E, FILLED, HISTORY, NOW, START

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def folder(s) -> str:
    """A new folder in the one that driver and executors share; shared.drop_written() deletes it."""
    return shared.folder(s, "ledger")


SCORES = f"""{E}, sc as (select event_id as seq, event_type as asset, ts, case when k % 6 = 0 then 0.0 when k % 6 = 1 then null else value / 500 end as score, case when k % 5 = 0 then null else k / 100 end as confidence from e),
sv as (select *, case when score <> 0 then score else coalesce(confidence, 0) end as v, epoch_us(timestamp '{NOW}') - epoch_us(ts) as age from sc)"""


@query(f"""with {SCORES}, a as (select asset, arg_max(v, (ts, seq)) as l, arg_min(v, (abs(age - 21600000000), ts, seq)) as a, arg_min(v, (abs(age - 86400000000), ts, seq)) as b from sv group by 1)
select asset, round(l - a, 4) as trend_6h, round(l - b, 4) as trend_24h from a""")
def trend_deltas(s, d):
    e, k = R.events(s, d), F.col("k")
    score = F.when(k % 6 == 0, 0.0).when(k % 6 != 1, F.col("value") / 500)
    rows = e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("asset"), "ts", score.alias("score"), F.when(k % 5 != 0, k / 100).alias("confidence"))
    return insight.trend_deltas(rows, NOW)


FEEDBACK = f"{E}, fb as (select event_type as asset, user_id % 50 as signal, k / 100 as confidence, case when k % 7 = 0 then null else k % 2 = 0 end as agree from e)"


def user_feedback(s, d):
    k = F.col("k")
    return R.events(s, d).select(F.col("event_type").alias("asset"), (F.col("user_id") % 50).alias("signal"), (k / 100).alias("confidence"), F.when(k % 7 != 0, k % 2 == 0).alias("agree"))


@query(f"with {FEEDBACK} select asset, count(*) as total_feedback, count(*) filter (confidence >= .8 and not agree) as adjusted_signals, round(avg(confidence), 3) as avg_confidence from fb group by 1")
def threshold_simulation(s, d):
    return insight.simulate_threshold(user_feedback(s, d), 0.8)


@query(f"""with {FEEDBACK} select signal, count(agree) as num_feedback, count(*) filter (agree) as num_agree, count(*) filter (not agree) as num_disagree, round(count(*) filter (agree) / nullif(count(agree), 0), 6) as agreement_rate from fb group by 1""")
def agreement_per_signal(s, d):
    return insight.agreement(user_feedback(s, d), "signal")


@query(f"with {Q} select asset, round(sum(impact), 6) as total from q where status = 'P' group by 1 order by total desc, asset limit 5")
def top_assets_by_impact(s, d):
    return insight.top_by_sum(queue(s, d).where("status = 'P'"), "asset", "impact", 5)


@query(f"with {Q} select status, hint, count(*) as n, round(avg(impact), 4) as mean_impact from q group by 1, 2")
def review_status_by_hint(s, d):
    return queue(s, d).groupBy("status", "hint").agg(F.count("*").alias("n"), F.round(F.avg("impact"), 4).alias("mean_impact"))


BOARD = f"{E}, bd as (select event_type as asset, arg_max(value, (ts, event_id)) as price_change, arg_max(case when k % 2 = 0 then k end, (ts, event_id)) as sentiment from e group by 1)"


def board(s, d):
    at = F.struct("ts", "event_id")
    return R.events(s, d).groupBy(F.col("event_type").alias("asset")).agg(F.max_by("value", at).alias("price_change"), F.max_by(F.when(F.col("k") % 2 == 0, F.col("k")), F.when(F.col("k") % 2 == 0, at)).alias("sentiment"))


@query(f"""with {BOARD}, o as (select 'price_change' as by, *, row_number() over (order by coalesce(price_change, 0) desc, asset) as place from bd union all
select 'sentiment', *, row_number() over (order by coalesce(sentiment, 0), asset) from bd) select * from o""")
def leaderboard_orders(s, d):
    b = board(s, d)
    down = insight.ordered_by(b, "price_change", True, "asset").withColumn("by", F.lit("price_change"))
    return down.unionByName(insight.ordered_by(b, "sentiment", False, "asset").withColumn("by", F.lit("sentiment")))


@query(f"""with {HISTORY}, l as (select f.event_id, f.ts, f.label, m.score from feedback f left join matched m using (event_id)),
t as (select string_agg(event_id, ',' order by ts desc, event_id desc) as latest from (select * from l order by ts desc, event_id desc limit 3))
select label, count(*) as n, round(avg(coalesce(score, 0)), 4) as mean_score, any_value(latest) as latest from l, t group by 1""")
def label_feedback(s, d):
    m = quality_queries.pairs(s, d).select("event_id", "score")
    return insight.feedback_digest(R.feedback(s, d).join(m, "event_id", "left"))


HOURLY = f"""{DENSE}, h as (select origin, date_trunc('hour', ts) as hb, min(ts) as first, max(ts) as last from triggers group by 1, 2),
y as (select distinct d.origin, d.bucket from dense d join h on h.origin = d.origin and h.hb between d.bucket and d.bucket + interval 6 hour and h.last > d.bucket and h.first <= d.bucket + interval 6 hour),
p as (select d.origin, d.bucket, n / (n + 5) as p, y.origin is not null as label from dense d left join y on y.origin = d.origin and y.bucket = d.bucket)"""


def hourly_scores(s, d):
    """A score of each origin and hour that stands for a model's."""
    return grid.densified(R.flags(s, d), START, NOW, "hour").select("origin", "bucket", (F.col("n") / (F.col("n") + 5)).alias("p"))


@query(f"""with {HOURLY}, cf as (select origin, count(*) filter (p >= .4 and label) as tp, count(*) filter (p >= .4 and not label) as fp, count(*) filter (p < .4 and label) as fn, count(*) filter (p < .4 and not label) as tn
from p where bucket >= timestamp '{NOW}' - interval 24 hour group by 1), a as (select * from cf union all select 'overall', sum(tp), sum(fp), sum(fn), sum(tn) from cf)
select origin, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tn as bigint) as tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 3) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) as recall from a""")
def live_backtest(s, d):
    last = hourly_scores(s, d).where(F.col("bucket") >= F.expr(f"timestamp '{NOW}' - interval 24 hour"))
    return insight.live_backtest(last, R.triggers(s, d), 0.4)


@query(f"""with {HOURLY}, n as (select origin from p group by 1 having count(*) >= 40 and count(*) filter (label) >= 3 and count(*) filter (not label) >= 3),
cf as (select origin, p as cut, count(*) filter (label) as t, count(*) as m from p group by 1, 2), w as (select *, sum(t) over (partition by origin order by cut desc) / sum(m) over (partition by origin order by cut desc) as pr from cf)
select origin, round(min(cut) filter (pr >= .7), 6) as p70, round(min(cut) filter (pr >= .8), 6) as p80 from w where origin in (select origin from n) group by 1""")
def fitted_thresholds(s, d):
    return insight.fitted_thresholds(hourly_scores(s, d), R.triggers(s, d), {"p70": 0.7, "p80": 0.8})


@query(f"""with {E}, t as (select user_id as id, event_id, ts from e where event_type = 'click' and ts between timestamp '{START}' and timestamp '{NOW}'),
l as (select user_id as id, arg_max(k % 2 = 0, (ts, event_id)) as label from e where event_type = 'purchase' and ts between timestamp '{START}' and timestamp '{NOW}' group by 1) select id, event_id, label from t join l using (id)""")
def last_label_join(s, d):
    e = R.events(s, d).withColumn("id", F.col("user_id"))
    l = e.where("event_type = 'purchase'").withColumn("label", F.col("k") % 2 == 0)
    return insight.last_label_join(e.where("event_type = 'click'").select("id", "event_id", "ts"), l, "id", START, NOW).select("id", "event_id", "label")


@query(f"with {E}, l as (select distinct unnest(regexp_extract_all('seen sig' || user_id || ' and sig' || (user_id + 7), 'sig[0-9]+')) as id from e where k < 3) select event_id, 'sig' || event_id as id from e where 'sig' || event_id in (select id from l)")
def mentioned_signals(s, d):
    e = R.events(s, d)
    lines = e.where("k < 3").select(F.concat(F.lit("seen sig"), F.col("user_id"), F.lit(" and sig"), F.col("user_id") + 7).alias("line"))
    return insight.mentioned(e.select("event_id", F.concat(F.lit("sig"), "event_id").alias("id")), lines, "id", "line", "sig[0-9]+")


@query(f"""with {DENSE}, i as (select bucket, n, row_number() over (partition by bucket order by n, origin) as i, count(*) over (partition by bucket) as m from dense)
select cast(bucket as timestamp) as bucket, n as cut from i where i = floor(.75 * (m - 1)) + 1""")
def cross_origin_cut(s, d):
    return insight.cross_origin_cut(grid.densified(R.flags(s, d), START, NOW, "hour"), 0.75)


SOCIAL = f"""{DENSE}, z0 as (select *, case when count(*) over w >= 24 then (n - avg(n) over w) / nullif(stddev_pop(n) over w, 0) end as z from dense window w as (partition by origin order by bucket rows 719 preceding)),
z1 as (select *, case when z is not null then round(greatest(-3, least(3, z)), 9) end as c from z0),
z2 as (select *, min(c) over (partition by origin) as a, max(c) over (partition by origin) as b, min(n) over (partition by origin) as na, max(n) over (partition by origin) as nb from z1),
z3 as (select bucket, case when coalesce(a = b, true) then coalesce((n - na) / nullif(nb - na, 0), .5) else (c - a) / (b - a) end * .8 + .1 as s from z2),
m as (select bucket, coalesce(avg(s), .5) as s from z3 group by 1),
social as (select cast(m.bucket as timestamp) as bucket, round(o.s, 6) as social_score from m left join m o on o.bucket = m.bucket - interval 1 hour)"""


@query(f"with {SOCIAL} select * from social")
def social_series(s, d):
    return insight.social_series(grid.densified(R.flags(s, d), START, NOW, "hour"))


@query(f"with {SOCIAL}, {FILLED.replace(E + ', ', '')} select symbol, f.ts, close, coalesce(social_score, 0) as social_score from filled f left join social on social.bucket = f.ts")
def social_joined_to_prices(s, d):
    social = insight.social_series(grid.densified(R.flags(s, d), START, NOW, "hour")).withColumnRenamed("bucket", "ts")
    return filled(s, d).select("symbol", "ts", "close").join(social, "ts", "left").fillna(0.0, ["social_score"])


@query(f"""with {BARS}, c as (select symbol, ts, close from bars where symbol <> 'click' or ts >= timestamp '{START}'),
fresh as (select symbol from c group by 1 having min(ts) <= timestamp '{NOW}' - interval 15 day),
syn as (select symbol, ts, round(100 + 10 * sin(epoch(ts) / 86400.0) + cast('0x' || substr(md5(symbol || '|' || cast(epoch(ts) as bigint)), 1, 6) as bigint) / 16777215, 6) as close
from (select distinct symbol from c), (select unnest(generate_series(timestamp '{NOW}' - interval 15 day, timestamp '{NOW}', interval 1 hour)) as ts))
select symbol, ts, round(close, 6) as close from c where symbol in (select symbol from fresh) and ts >= timestamp '{NOW}' - interval 14 day
union all select symbol, cast(ts as timestamp), close from syn where symbol not in (select symbol from fresh) and ts >= timestamp '{NOW}' - interval 14 day""")
def fresh_prices(s, d):
    """Prices written to Parquet and read back; one symbol's do not reach back far enough and are made up."""
    path = folder(s)
    market_queries.bars(s, d).select("symbol", "ts", "close").where(f"symbol <> 'click' or ts >= timestamp '{START}'").write.parquet(path)
    cached = s.read.parquet(path)
    return insight.fresh_or(cached, insight.synthetic_prices(cached, NOW, 15), NOW, 14).select("symbol", "ts", F.round("close", 6).alias("close"))


@query(f"""with {FILLED}, x as (select symbol, ts, round(.5 + (close - open) / close, 6) as score from filled where date_part('hour', ts) % 2 = 1)
select symbol, ts, score, case when score >= .5 then 'long' else 'short' end as direction, 'v2' as tag, greatest(score, 1 - score) >= .6 as kept from x""")
def shadow_backfill(s, d):
    b = filled(s, d)
    return insight.backfilled(b, b.where(F.hour("ts") % 2 == 0), ["symbol", "ts"], 0.5 + (F.col("close") - F.col("open")) / F.col("close"), "v2", 0.6)


@query(f"with {E}, n as (select event_type as component, event_id, row_number() over (partition by event_type order by ts, event_id) as n from e where k < 20) select component, event_id, n from n where n % 10 = 0")
def failure_alerts(s, d):
    return insight.failure_alerts(R.events(s, d).where("k < 20").select(F.col("event_type").alias("component"), "event_id", "ts"))


@query(f"""with {HISTORY}, x as (select origin, score as p, label::int as y from matched), c as (select origin, p, sum(y) as t, count(*) as m, sum(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) as loss, sum((p - y) ** 2) as sq from x group by 1, 2),
w as (select *, sum(t) over v as tp, sum(m) over v as k, sum(t) over (partition by origin) as pos, sum(m) over (partition by origin) as n from c window v as (partition by origin order by p desc))
select origin, round(case when any_value(pos) > 0 and any_value(pos) < any_value(n) then sum((m - t) * (tp - t / 2)) / any_value(pos * (n - pos)) else .5 end, 6) as roc_auc,
round(case when any_value(pos) > 0 and any_value(pos) < any_value(n) then sum(t / pos * tp / k) else sum(t) / sum(m) end, 6) as pr_auc, round(sum(loss) / sum(m), 6) as log_loss, round(sum(sq) / sum(m), 6) as brier from w group by 1""")
def ranking_metrics(s, d):
    return insight.ranking_metrics(quality_queries.pairs(s, d), "origin", "score")


@query(f"""with {E}, x as (select event_id, value, k, k / 100 as c, case when k % 3 = 0 then .75 when k % 3 = 1 then 1.0 else 1.25 end as w, case k % 4 when 0 then 'turbulent' when 1 then 'calm' when 2 then 'normal' end as regime, case when k % 7 <> 0 then k / 100 end as agree from e)
select event_id, cast(round(.7 * case regime when 'turbulent' then {{turbulent}} when 'calm' then {{calm}} when 'normal' then {{normal}} else 1.0 end, 6) as double) as scaled,
cast(case when w >= 1.25 then .4 when w <= .85 then .8 else .7 end as double) as adaptive, w * c >= case when w >= 1.25 then .4 when w <= .85 then .8 else .7 end as overrides,
round(.6 * coalesce(agree, .5) + .4 * (1 - c), 3) as trust, case when round(.6 * coalesce(agree, .5) + .4 * (1 - c), 3) >= .75 then 'Trusted' when round(.6 * coalesce(agree, .5) + .4 * (1 - c), 3) <= .35 then 'Untrusted' else 'Uncertain' end as trust_label,
case when c < .5 then 'low_confidence' when agree is null then 'missing_agreement' when k % 5 >= 2 then 'asset_spike' end as hint,
round(greatest(0, least(1, (value / 50 / 10 + (c - .5)) / 2)), 6) as heuristic, case when c > .66 then 'high' when c > .33 then 'medium' else 'low' end as third, cast(round(c * .9 + .1, 3) as double) as reliability from x""".format(**S.REGIME_FACTOR))
def scalar_rules(s, d):
    k = F.col("k")
    c, w = k / 100, F.when(k % 3 == 0, 0.75).when(k % 3 == 1, 1.0).otherwise(1.25)
    regime = F.when(k % 4 == 0, "turbulent").when(k % 4 == 1, "calm").when(k % 4 == 2, "normal")
    agree = F.when(k % 7 != 0, c)
    trust = S.trust_score(agree, c)
    return R.events(s, d).select(
        "event_id", F.round(S.regime_scaled(F.lit(0.7), regime), 6).alias("scaled"), S.adaptive_threshold(w).alias("adaptive"), S.overrides(w, c).alias("overrides"), trust.alias("trust"), S.trust_label(trust).alias("trust_label"),
        S.retrain_hint(c, agree, k % 5).alias("hint"), F.round(S.heuristic_confidence(F.col("value") / 50, c - 0.5), 6).alias("heuristic"), S.third_band(c).alias("third"), S.reliability(c).alias("reliability"),
    )


@query(f"""with {E}, x as (select event_id, case when k % 10 <> 0 then ts end as t from e)
select count(*) filter (t >= timestamp '{NOW}' - interval 7 day) as dropped, count(*) filter (coalesce(t, timestamp '{NOW}') >= timestamp '{NOW}' - interval 7 day) as as_now from x""")
def time_window_rules(s, d):
    x = R.events(s, d).withColumn("ts", F.when(F.col("k") % 10 != 0, F.col("ts")))
    n = lambda rule, name: ledgers.since(x, NOW, 7, rule).agg(F.count("*").alias(name))
    return n("drop", "dropped").join(n("now", "as_now"))


@query(f"""with {E} select event_id, event_type, value from e where k % 9 <> 0""")
def ledger_round_trip(s, d):
    """Appended twice, with malformed and blank lines between, and read back without them."""
    path, e = folder(s), R.events(s, d)
    good = e.where("k % 9 <> 0").select("event_id", "event_type", "value")
    for part in (good.where("event_id % 2 = 0"), good.where("event_id % 2 = 1")):
        sinks.append_json(part, path)
    e.where("k % 9 = 0").select(F.when(F.col("k") % 2 == 0, F.lit("{broken")).otherwise(F.lit(" ")).alias("value")).write.mode("append").text(path)
    return ledgers.read(s, path, "event_id bigint, event_type string, value double")


@query(f"with {E} select 0 as all_or_nothing, count(*) filter (k % 9 <> 0) as clean from e")
def ledger_all_or_nothing(s, d):
    """One malformed line empties a ledger; without it all rows are there."""
    paths, e = (folder(s), folder(s)), R.events(s, d)
    for path in paths:
        sinks.append_json(e.where("k % 9 <> 0").select("event_id"), path)
    e.where("k % 9 = 0").select(F.lit("{broken").alias("value")).write.mode("append").text(paths[0])
    n = lambda path, name: ledgers.read(s, path, "event_id bigint", "all_or_nothing").agg(F.count("*").alias(name))
    return n(paths[0], "all_or_nothing").select(F.col("all_or_nothing").cast("int").alias("all_or_nothing")).join(n(paths[1], "clean"))


@query(f"with {Q} select asset, status, hint from q where asset = 'BUILDING'")
def csv_export(s, d):
    path = folder(s)
    sinks.export_csv(queue(s, d), path, ["asset", "status", "hint"], F.col("asset") == "BUILDING")
    return s.read.schema("asset string, status string, hint string").option("header", True).csv(path)


@query(f"with {E} select 1 as files, max(length(c)) as size, sha256(max(c)) as sha256 from (select string_agg(event_type, chr(10) order by event_type) || chr(10) as c from (select distinct event_type from e))")
def artefact_manifest(s, d):
    path = folder(s)
    R.events(s, d).select("event_type").distinct().coalesce(1).sortWithinPartitions("event_type").write.text(path)
    files = sinks.manifest(s, path).where("path like '%.txt'")
    return files.agg(F.count("*").cast("int").alias("files"), F.max("size").alias("size"), F.max("sha256").alias("sha256"))


@query("""with a as (select case when l_linenumber % 3 = 0 then 'rollback' else 'keep' end as action, 'v' || l_suppkey as version, l_discount * 10 as confidence from lineitem),
c as (select 's' || s_suppkey as origin, s_acctbal / 50000 as ece from supplier), f as (select 'c' || c_custkey as version, c_acctbal / 10000 as f1 from customer)
select 'action' as kind, version as subject, case when confidence >= .8 then 'critical' else 'warning' end as level from a where action = 'rollback'
union all select 'calibration', origin, case when ece > .15 then 'critical' else 'warning' end from c where ece > .1 union all select 'accuracy', version, 'info' from f where f1 < .5""")
def notifications(s, d):
    l, sup, c = (s.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "supplier", "customer"))
    a = l.select(F.when(F.col("l_linenumber") % 3 == 0, "rollback").otherwise("keep").alias("action"), F.concat(F.lit("v"), "l_suppkey").alias("version"), (F.col("l_discount") * 10).alias("confidence"))
    ece = F.col("s_acctbal") / 50000
    return reports.notifications(a, sup.select(F.concat(F.lit("s"), "s_suppkey").alias("origin"), ece.alias("ece"), (ece > 0.1).alias("high_ece")), c.select(F.concat(F.lit("c"), "c_custkey").alias("version"), (F.col("c_acctbal") / 10000).alias("f1")))


def _examples(s, d):
    x = market.labelled(market.market_regime(market.returns(filled(s, d), 1, 3, 6)), 3)
    return x.withColumn("label", F.col("label").cast("double"))


@query()
def per_regime_model(s, d):
    """p of each symbol's last bar by the model of its regime, of bars in the first four fifths of the time."""
    first, rest = models.early(_examples(s, d))
    p = models.by_regime(first, ["ret_1", "ret_3", "ret_6"], rest)
    return p.groupBy("symbol").agg(F.max_by("p", "ts").alias("p_long"), F.max_by("regime", "ts").alias("regime"), F.max("ts").alias("ts"))


@query()
def retrained_from_log(s, d):
    """Ledger rows whose features are maps with keys of their own, as columns for training; p and label of the rows that are held out."""
    e = R.events(s, d).where("event_type = 'click'")
    log = e.select(F.col("event_id").alias("id"), (F.col("value") >= 50).cast("double").alias("label"), F.when(F.col("k") % 3 == 0, F.create_map(F.lit("k"), F.col("k").cast("double"))).otherwise(F.create_map(F.lit("k"), F.col("k").cast("double"), F.lit("user"), (F.col("user_id") % 10).cast("double"))).alias("features"))
    rows, names = models.from_maps(log, "id", "features", ["label"])
    first, rest = models.apart(rows, "id")
    return models.probability(models.train(first, names), rest).select("id", "label", F.round("p", 4).alias("p"))


@query()
def disagreement_model(s, d):
    """Probability that feedback disagrees with a decision: a weighted forest on score, confidence and label, for the rows after those that it was fitted on."""
    m = quality_queries.pairs(s, d).select("event_id", "ts", "score", (F.col("label") != F.col("decision")).cast("double").alias("disagrees"), F.col("label").cast("string").alias("kind"), (0.5 + F.col("score")).alias("own"))
    first, rest = models.early(shared.written(m, "disagreements"))
    return models.weighted_forest(first, ["score"], "kind", "disagrees", "own", rest).select("event_id", "disagrees", F.round("p", 4).alias("p"))


@query()
def text_disagreement(s, d):
    """Probability that a labelled document is of good quality, by TF-IDF and a forest, for documents held out."""
    docs, labels = (s.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.col("quality").cast("double").alias("label")).dropna()
    first, rest = models.apart(rows, "doc_id")
    return models.probability(models.text_classifier(first), rest).select("doc_id", "label", F.round("p", 4).alias("p"))

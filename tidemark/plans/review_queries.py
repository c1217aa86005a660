"""Queries and SQL for reviewers, social text and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as G
from ..operators import quality, quantiles, reviewers, social
from . import roles as R
from .roles import E, HISTORY
from .quality_queries import CAL, pairs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def actions(s, d):
    l = s.read.parquet(f"{d}/lineitem.parquet")
    return l.select(F.col("l_orderkey").alias("signal"), F.col("l_suppkey").alias("reviewer"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
                    F.when(F.col("l_tax") > 0, F.col("l_tax") * 20).alias("weight"), (F.col("l_discount") - 0.05).alias("delta"), F.col("l_returnflag").alias("action"))


def supplier_scores(s, d):
    return s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("reviewer"), (F.col("s_acctbal") / 10000).alias("score"))


def score_log(s, d):
    return actions(s, d).select("reviewer", "ts", "seq", (F.col("delta") + 0.5).alias("score"))


def queue(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").join(s.read.parquet(f"{d}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    trust = F.col("o_totalprice") / 500000
    return o.select(F.col("o_orderkey").alias("seq"), F.col("c_mktsegment").alias("asset"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("label"), F.col("o_orderdate").cast("timestamp").alias("ts"), trust.alias("trust"),
                    F.when(trust < 0.3, "low_confidence").when(trust < 0.5, "missing_agreement").otherwise("none").alias("hint"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.5).alias("action_weight"), (1 - trust).alias("impact"))


A = """a as (select l_orderkey as signal, l_suppkey as reviewer, l_shipdate as ts, l_orderkey * 10 + l_linenumber as seq, case when l_tax > 0 then l_tax * 20 end as weight, l_discount - .05 as delta, l_returnflag as action from lineitem),
sl as (select reviewer, ts, seq, delta + .5 as score from a)"""
Q = """q as (select o_orderkey as seq, c_mktsegment as asset, o_orderstatus as status, o_orderpriority as label, cast(o_orderdate as timestamp) as ts, o_totalprice / 500000 as trust,
case when o_totalprice / 500000 < .3 then 'low_confidence' when o_totalprice / 500000 < .5 then 'missing_agreement' else 'none' end as hint, case when o_orderstatus = 'F' then 1.0 else .5 end as action_weight, 1 - o_totalprice / 500000 as impact
from orders join customer on o_custkey = c_custkey)"""


@query(f"with {A} select reviewer, count(*) as actions, round(avg(delta), 4) as mean_delta, round(100 * avg((delta > 0)::int), 2) as pct_positive from a group by 1")
def reviewer_scoring(s, d):
    return reviewers.scoring(actions(s, d))


WB = "case when {x} is null then 1.0 when {x} >= .75 then 1.25 when {x} >= .5 then 1.0 else .75 end"


@query(f"""with {A}, w as (select a.*, coalesce(a.weight, {WB.format(x='(s_acctbal / 10000)')}) as wt from a left join supplier on reviewer = s_suppkey), f as (select *, row_number() over (partition by signal, reviewer order by ts, seq) as i from w)
select signal, round(sum(wt) filter (i = 1), 6) as total_weight, count(*) filter (i = 1) as reviewers, cast(max(ts) as timestamp) as last_flagged, round(sum(wt) filter (i = 1), 6) >= 2.5 as triggered from f group by 1""")
def consensus(s, d):
    return reviewers.consensus(reviewers.weighted(actions(s, d), supplier_scores(s, d)))


@query(f"with {A}, l as (select reviewer, arg_max(score, (ts, seq)) as score from sl group by 1) select reviewer, score, cast({WB.format(x='score')} as double) as weight from l order by weight desc, coalesce(score, -1) desc, reviewer limit 20")
def reviewer_leaderboard(s, d):
    return reviewers.leaderboard(score_log(s, d), 20)


@query(f"with {A}, l as (select *, round(score - lag(score) over (partition by reviewer order by ts, seq), 6) as change, row_number() over (partition by reviewer order by ts desc, seq desc) as i from sl) select reviewer, score, change from l where i = 1 and (score < .47 or change <= -.05)")
def reviewer_anomalies(s, d):
    return reviewers.anomalies(score_log(s, d), 0.47, -0.05)


@query(f"with {A} select reviewer, count(*) as points, round(arg_max(score, (ts, seq)) - arg_min(score, (ts, seq)), 6) as trend from sl group by 1")
def reviewer_trend(s, d):
    return reviewers.score_trend(score_log(s, d))


@query(f"with {A}, l as (select *, row_number() over (partition by signal, reviewer, action order by ts desc, seq desc) as i from a where weight is not null) select signal, reviewer, action, round(-(weight * delta), 6) as inverse_delta from l where i = 1")
def rollback_deltas(s, d):
    return reviewers.last_action(actions(s, d).where("weight is not null"))


@query(f"with {Q} select status, hint, count(*) as n, round(avg(impact), 4) as mean_impact, cast(grouping(status) * 2 + grouping(hint) as int) as level from q group by grouping sets ((status), (hint), ())")
def review_status_summary(s, d):
    return reviewers.status_summary(queue(s, d))


@query(f"with {Q}, g as (select label, status, hint, count(*) as n, round(avg(trust), 6) as avg_trust, round(avg(impact), 6) as avg_impact from q group by 1, 2, 3) select *, round((1 - avg_trust) * avg_impact, 6) as priority from g order by priority desc, label, status, hint limit 10")
def suppression_patterns(s, d):
    return reviewers.patterns(queue(s, d), 10)


@query(f"""with {Q}, n as (select cast(ts as date) as day, count(*) as n, count(*) filter (trust < .4) as suppressed, round(avg(trust), 6) as avg_trust from q group by 1),
b as (select *, row_number() over (partition by day order by c desc, label) as i from (select cast(ts as date) as day, label, count(*) as c from q group by 1, 2))
select day, n, suppressed, avg_trust, (select string_agg(label, ',' order by i) from b where b.day = n.day and i <= 3) as top_labels from n""")
def trust_timeline(s, d):
    return reviewers.timeline(queue(s, d))


@query(f"with {Q} select seq, round(action_weight * (1 - trust) + case when count(*) over (partition by asset order by epoch(ts) range between 86400 preceding and current row) - 1 >= 2 then .1 else 0 end, 3) as impact_score from q")
def impact_scores(s, d):
    return reviewers.impact(queue(s, d)).select("seq", "impact_score")


@query(f"with {Q}, g as (select asset, count(*) as n, round(avg(trust), 6) as avg_trust, arg_max(trust, (ts, seq)) - arg_min(trust, (ts, seq)) as c from q group by 1) select asset, n, avg_trust, case when c > 0 then 'up' when c < 0 then 'down' else 'flat' end as trend from g")
def trust_asset_pulse(s, d):
    return reviewers.asset_pulse(queue(s, d))


@query(f"""with {Q}, g as (select asset, coalesce(avg(trust) filter (ts <= timestamp '1997-01-01'), 0) as x, coalesce(avg(trust) filter (ts >= timestamp '1997-01-01'), 0) as y from q where ts between timestamp '1996-01-01' and timestamp '1998-01-02' group by 1)
select asset, round(x, 6) as first_half, round(y, 6) as second_half from g where abs(y - x) >= .001""")
def trust_volatility_spikes(s, d):
    return reviewers.trust_spikes(queue(s, d), "1996-01-01", "1998-01-02", 0.001)


@query(f"with {HISTORY} select origin, count(*) as n, round(avg(1 - label::int), 6) as disagree_rate, round(avg(label::int), 6) as mean, round(stddev_samp(label::int), 6) as stdev from feedback group by 1")
def feedback_volatility(s, d):
    return reviewers.feedback_volatility(R.feedback(s, d))


@query(f"with {HISTORY}, g as (select origin, count(*) as total, count(*) filter (not label) as disagree from feedback group by 1) select origin, total, disagree, round(100 * (total - disagree) / total, 2) as agree_pct from g order by disagree desc, origin limit 2")
def feedback_summary(s, d):
    return reviewers.feedback_summary(R.feedback(s, d), 2)


@query(f"with {Q} select asset, hint, count(*) as n from q group by 1, 2")
def retrain_summary(s, d):
    return reviewers.retrain_summary(queue(s, d))


@query(f"with {Q} select asset, count(*) as history, count(*) filter (trust < .4) as suppressed, count(*) filter (hint <> 'none') as retrains from q group by 1")
def asset_enrichment(s, d):
    q = queue(s, d)
    return reviewers.enriched(q, suppressed=q.where("trust < 0.4"), retrains=q.where("hint <> 'none'"))


@query(f"with {Q} select seq, round(case when trust > .7 then greatest(impact - .1, 0) else impact end, 9) as less, round(case when trust > .7 then impact * .9 else impact end, 9) as scaled from q")
def disagreement_adjustment(s, d):
    return reviewers.adjusted(queue(s, d).withColumn("p", F.col("trust")).withColumn("confidence", F.col("impact"))).select("seq", "less", "scaled")


def posts(s, d):
    return s.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")


STOPS = ", ".join(f"'{w}'" for w in social.STOP_WORDS)
TOK = f"t as (select role, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2 and x not in ({STOPS}))) as term from conversations)"


@query(f"with {TOK}, f as (select role, term, count(*) as tf from t group by 1, 2), r as (select *, cast(row_number() over (partition by role order by tf desc, term) as int) as rank from f) select * from r where rank <= 10")
def top_terms(s, d):
    return social.top_terms(posts(s, d), "role", 10)


@query(f"""with t as (select conv_id * 1000 + turn as id, list_filter(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', '', 'g'), '[^a-z0-9_#]', ' ', 'g'), '\\s+'), lambda x: x <> '' and x not in ({STOPS})), lambda x: regexp_replace(x, '^#+', '')), lambda x: x <> '') as l from conversations)
select id, cast(len(l) as int) as n, md5(array_to_string(l, ' ')) as digest from t""")
def tagged_tokens(s, d):
    t = social.tagged_tokens(F.col("text"))
    return posts(s, d).select("id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"with {E} select event_type as origin, cast(date_trunc('hour', ts) as timestamp) as bucket, count(*) as n, count(distinct user_id) as authors from e group by 1, 2")
def hourly_authors(s, d):
    return social.hourly_authors(R.events(s, d).select(F.col("event_type").alias("origin"), "ts", F.col("user_id").alias("author")))


@query(f"""with {E}, h as (select event_type as origin, cast(date_trunc('hour', ts) as timestamp) as bucket, count(*) as n from e group by 1, 2), z as (select *, round((n - avg(n) over (partition by origin)) / nullif(stddev_samp(n) over (partition by origin), 0), 6) as z from h),
r as (select *, cast(row_number() over (partition by origin order by z desc, bucket) as int) as rank from z where z >= 2) select * from r where rank <= 3""")
def observed_bursts(s, d):
    return social.observed_bursts(R.flags(s, d), 2.0, 3)


@query(f"with {E} select user_id, arg_min(event_id, (ts, event_id)) as event_id from e group by 1")
def first_wins_dedup(s, d):
    return social.first_wins(R.events(s, d), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("""with p as (select conv_id * 1000 + turn as id, lower(text) as t from conversations) select id, 'AA' as symbol from p where contains(t, 'tion') union all select id, 'BB' from p where contains(t, 'ung') or contains(t, 'heit')""")
def keyword_hits(s, d):
    return social.keyword_hits(posts(s, d), {"AA": ("tion",), "BB": ("ung", "heit")})


LEX = (("this", 1.5), ("that", -0.5), ("une", 1.0), ("les", -1.0), ("und", 0.5), ("que", -1.5))


BOOSTERS, NEGATIONS, CONTRAST = {"the": 1.0, "der": -1.0}, ("and", "nicht", "de"), "is"


def _compound_sql() -> str:
    weight = "case y " + " ".join(f"when '{w}' then cast({x} as double)" for w, x in LEX) + " else 0 end"
    up = lambda k: f"case when i > {k} then case l[i - {k}] " + " ".join(f"when '{w}' then {x} * {social.BOOST}" for w, x in BOOSTERS.items()) + " else 0 end else 0 end"
    no = " or ".join(f"(i > {k} and coalesce(l[i - {k}] in {NEGATIONS} or l[i - {k}] like '%n''t', false))" for k in (1, 2, 3))
    return f"""with c as (select conv_id * 1000 + turn as id, coalesce(text, '') as t from conversations),
a as (select id, t, list_filter(list_transform(string_split_regex(t, '\\s+'), lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda x: x <> '') as w from c),
b as (select *, list_transform(w, lambda x: lower(x)) as l, len(list_filter(w, lambda x: x = upper(x) and x <> lower(x))) as n from a),
u as (select id, l, n > 0 and n < len(w) as mixed, coalesce(list_position(l, '{CONTRAST}'), 0) as turn, w, unnest(range(1, len(w) + 1)) as i from b),
v as (select *, w[i] as x, l[i] as y from u), z as (select *, {weight} as g from v),
s as (select id, sum((g + case when mixed and x = upper(x) and x <> lower(x) then sign(g) * {social.CAPITALS} else 0 end + sign(g) * ({" + ".join(f"{f} * {up(k)}" for k, f in enumerate(social.FADES, 1))}))
  * case when {no} then {social.NEGATED} else 1 end * case when turn = 0 or i = turn then 1 when i < turn then {social.BEFORE} else {social.AFTER} end) as s from z group by 1),
m as (select id, least(length(t) - length(replace(t, '!', '')), 4) * {social.EXCLAIM} + case when length(t) - length(replace(t, '?', '')) <= 1 then 0 when length(t) - length(replace(t, '?', '')) <= 3 then (length(t) - length(replace(t, '?', ''))) * {social.ASK} else {social.ASK_MOST} end as m from c),
r as (select id, coalesce(s, 0) + sign(coalesce(s, 0)) * m as s from m left join s using (id)) select id, round(s / sqrt(s * s + {social.NORM}), 4) as compound from r"""


@query(_compound_sql())
def compound_sentiment(s, d):
    """Rule-based sentiment of every turn, on a small lexicon."""
    weights = s.createDataFrame(list(LEX), "word string, weight double")
    return social.compound(posts(s, d), "text", weights, BOOSTERS, list(NEGATIONS), CONTRAST).select("id", "compound")


@query(f"""with l(word, weight) as (values {', '.join(f"('{w}', cast({x} as double))" for w, x in LEX)}), t as (select conv_id * 1000 + turn as id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from conversations),
s as (select id, sum(weight) as s from t join l using (word) group by 1) select c.id, round(coalesce(s / sqrt(s * s + 15), 0.0), 6) as score from (select conv_id * 1000 + turn as id from conversations) c left join s on c.id = s.id""")
def lexicon_sentiment(s, d):
    return social.lexicon_score(posts(s, d), s.createDataFrame(list(LEX), "word string, weight double"))


@query(f"""with {Q}, m as (select asset as version, avg(trust) as win_rate, avg(trust) * 2 - 1 as sharpe, -max(trust) / 4 as max_drawdown from q group by 1) select version, cast(.6 as double) + case when win_rate < .5 then .03 else 0 end + case when sharpe < 0 then .03 else 0 end + case when abs(max_drawdown) > .2 then .05 else 0 end as x from m""".replace("select version, cast(.6 as double) +", "select version, round(cast(.6 as double) +").replace("else 0 end as x from m", "else 0 end, 2) as conf_min from m"))
def confidence_adjustment(s, d):
    m = queue(s, d).groupBy(F.col("asset").alias("version")).agg(F.avg("trust").alias("win_rate"), (F.avg("trust") * 2 - 1).alias("sharpe"), (-F.max("trust") / 4).alias("max_drawdown"))
    return G.adjusted_confidence(m).select("version", "conf_min")


@query(f"""with {HISTORY}{CAL.format(k='version')}, m as (select version, count(*) as labels, avg(label::int) as precision from matched group by 1), a as (select version, max(ts) as last from history where drifted group by 1),
j as (select m.version, list_filter([case when labels < 20 then 'labels' end, case when precision < .5 then 'precision' end, case when ece > .2 then 'ece' end, case when last > timestamp '2024-01-30' then 'cooldown' end], lambda x: x is not null) as r from m join cal using (version) left join a using (version))
select version, 'promote' as action, array_to_string(r, ',') as reasons, len(r) = 0 as applied from j""")
def governance_guardrails(s, d):
    p = pairs(s, d)
    m = p.groupBy("version").agg(F.count("*").alias("labels"), F.avg(F.col("label").cast("int")).alias("precision")).join(quality.calibration(p, ["version"]).select("version", "ece"), "version").withColumn("action", F.lit("promote"))
    return G.guardrails(m, R.history(s, d).where("drifted"), R.NOW, 20, 0.5, 0.2)


@query(f"with {HISTORY}, v as (select version, round(avg(label::int), 6) as precision from matched group by 1) select version, lag(version) over (order by version) as parent, round(precision - lag(precision) over (order by version), 6) as precision_delta from v")
def model_lineage(s, d):
    v = pairs(s, d).groupBy("version").agg(F.round(F.avg(F.col("label").cast("int")), 6).alias("precision")).withColumn("pos", F.col("version"))
    return G.parents(v)


@query(f"""with {E}, t as (select 'v' || (k % 10) as version, case k % 3 when 0 then 'declining' when 1 then 'improving' else 'stable' end as p, case user_id % 3 when 0 then 'worsening' when 1 then 'improving' else 'stable' end as c from e),
a as (select version, case when p = 'declining' and c = 'worsening' then 'rollback' when p = 'improving' and c = 'improving' then 'promote' else 'observe' end as action,
least(1.0, .5 + .2 * ((p in ('declining', 'improving'))::int + (c in ('worsening', 'improving'))::int)) as confidence from t) select version, action, cast(max(confidence) as double) as confidence from a group by 1, 2""")
def governance_actions(s, d):
    names = lambda c, x, y: F.when(c % 3 == 0, x).when(c % 3 == 1, y).otherwise("stable")
    t = R.events(s, d).select(F.concat(F.lit("v"), F.col("k") % 10).alias("version"), names(F.col("k"), "declining", "improving").alias("precision_trend"), names(F.col("user_id"), "worsening", "improving").alias("ece_trend"))
    return G.actions(t)


@query(f"""with {E}, v as (select 'v' || (k % 10) as version, avg(value) filter (user_id % 2 = 0) / 100 as a, avg(value) filter (user_id % 2 = 1) / 100 as b, avg(k) filter (user_id % 2 = 0) / 1000 as c, avg(k) filter (user_id % 2 = 1) / 1000 as d from e group by 1)
select version, round(b - a, 6) as d_f1, round(d - c, 6) as d_ece, case when b - a < -.02 or d - c > .01 then 'rollback_risk' when b - a >= .02 then 'promote_ready' else 'observe' end as kind from v""")
def blue_green(s, d):
    side = lambda c, i, n: F.avg(F.when(F.col("user_id") % 2 == i, F.col(c))) / n
    v = R.events(s, d).groupBy(F.concat(F.lit("v"), F.col("k") % 10).alias("version")).agg(side("value", 0, 100).alias("f1_old"), side("value", 1, 100).alias("f1_new"), side("k", 0, 1000).alias("ece_old"), side("k", 1, 1000).alias("ece_new"), F.lit(0.9).alias("confidence"))
    return G.blue_green(v)


@query(f"""with {HISTORY}, matched2 as (select *, date_trunc('day', ts) as bucket from matched){CAL.format(k='origin, bucket').replace('from matched', 'from matched2')}, b as (select origin, bucket, ece > .06 and n >= 3 as bad from cal)
select origin, count(*) filter (bad) as bad, arg_max(bad, bucket) as retrain from b group by 1 having count(*) filter (bad) >= 3""")
def drift_and_retrain(s, d):
    trend = quality.calibration(pairs(s, d).withColumn("bucket", F.date_trunc("day", "ts")), ["origin", "bucket"])
    return G.drift_candidates(trend, "origin", 0.06, 3)


EDGES = f"""{E}, pr as (select event_type as a, 'u' || (user_id % 5) as b, avg(value) / 100 as r, avg(k) / 1000 as p, max(k) % 3 - 1 as lag from e group by 1, 2),
ed as (select case when lag < 0 then b else a end as src, case when lag < 0 then a else b end as dst, round(abs(r) * (1 - p), 6) as w from pr where abs(r) >= .3 and p < .05)"""


def edges(s, d):
    g = R.events(s, d).groupBy(F.col("event_type").alias("a"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("b")).agg((F.avg("value") / 100).alias("r"), (F.avg("k") / 1000).alias("p"), (F.max("k") % 3 - 1).alias("lag"), F.lit(True).alias("significant"))
    return G.influence_edges(g)


@query(f"with {EDGES} select * from ed")
def influence_edges(s, d):
    return edges(s, d)


@query(f"with {EDGES}, n as (select node, sum(o) as o, sum(i) as i from (select src as node, w as o, 0 as i from ed union all select dst, 0, w from ed) group by 1) select node, round(o / nullif(sum(o) over (), 0), 6) as influence, round(i / nullif(sum(i) over (), 0), 6) as sensitivity from n")
def influence_graph(s, d):
    return G.influence(edges(s, d))


COV = "select {f} as feature, round(100 * avg(({x} <> 0)::int), 6) as nonzero_pct, round(avg({x}), 9) as mean, round(stddev_pop({x}), 9) as std, min({x}) as low, max({x}) as high from li where {w}"
LI = "li as (select l_orderkey, l_quantity as quantity, l_discount as discount, l_tax as tax from lineitem)"


@query(f"with {LI} " + " union all ".join(COV.format(f=f"'{x}'", x=x, w="true") for x in ("quantity", "discount", "tax")))
def feature_coverage(s, d):
    return G.coverage(_items(s, d), ["quantity", "discount", "tax"])


def _items(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


@query(f"""with {LI}, a as ({' union all '.join(COV.format(f=f"'{x}'", x=x, w='l_orderkey % 2 = 0') for x in ('quantity', 'discount', 'tax'))}), b as ({' union all '.join(COV.format(f=f"'{x}'", x=x, w='l_orderkey % 2 = 1') for x in ('quantity', 'discount', 'tax'))}),
j as (select a.feature, abs(b.mean - a.mean) / case when a.high - a.low <= 1e-6 then abs(a.mean) + 1 else a.high - a.low end as m, least(greatest(b.nonzero_pct / 100, 1e-9), 1 - 1e-9) as p, least(greatest(a.nonzero_pct / 100, 1e-9), 1 - 1e-9) as q from a join b using (feature))
select feature, round(m + .5 * abs(p * ln(p / q) + (1 - p) * ln((1 - p) / (1 - q))), 6) as score from j""")
def feature_drift(s, d):
    f, i = ["quantity", "discount", "tax"], _items(s, d)
    return G.drift(G.coverage(i.where("l_orderkey % 2 = 0"), f), G.coverage(i.where("l_orderkey % 2 = 1"), f), 3)


@query(f"with {E}, v as (select k % 3 || '.' || k % 7 || '.' || k % 5 as version, count(*) as n from e group by 1) select version, n, cast(row_number() over (order by n desc, cast(split_part(version, '.', 1) as int) desc, cast(split_part(version, '.', 2) as int) desc, cast(split_part(version, '.', 3) as int) desc, version) as int) as place from v")
def version_order(s, d):
    k = F.col("k")
    return G.semver_order(R.events(s, d).groupBy(F.concat_ws(".", k % 3, k % 7, k % 5).alias("version")).agg(F.count("*").alias("n")))


@query(f"""with {E}, x as (select event_type as origin, unnest(['f' || k % 4, 'f' || user_id % 5, 'f' || event_id % 3]) as feature from e where value >= 80), n as (select origin, feature, count(*) as n from x group by 1, 2),
r as (select *, cast(row_number() over (partition by origin order by n desc, feature) as int) as rank from n) select * from r where rank <= 3""")
def top_explanations(s, d):
    f = lambda c, m: F.concat(F.lit("f"), F.col(c) % m)
    fired = R.events(s, d).where("value >= 80").select(F.col("event_type").alias("origin"), F.array(f("k", 4), f("user_id", 5), f("event_id", 3), F.lit("f9")).alias("explanation"))
    return G.top_explanations(fired, 3, 3)


@query(f"with {E}, r as (select event_id, value >= 100 as label, row_number() over (partition by value >= 100 order by md5(cast(event_id as varchar)), event_id) as i, count(*) over (partition by value >= 100) as c from e), m as (select min(c) as least from r) select event_id, label from r, m where i <= 4 * least")
def class_balance(s, d):
    return G.balanced(R.events(s, d).select("event_id", (F.col("value") >= 100).alias("label")), 4, "event_id", "label")


@query(f"with {HISTORY} select event_id, case when row_number() over (partition by origin order by ts, event_id) <= floor(count(*) over (partition by origin) * .8) then 'train' else 'test' end as part from history")
def chronological_split(s, d):
    return G.chronological(R.history(s, d), 0.8, "ts", "event_id").select("event_id", "part")


@query(f"""with {HISTORY}, cur as (select distinct origin, .2 as threshold from history where origin <> 'o2'), sup as (select origin, count(*) as labels, avg(label::int) as precision from matched group by 1), pro as (select origin, round(quantile_cont(score, .8), 6) as recommended from history group by 1)
select origin, case when threshold is null or recommended is null then 'missing' when labels < 50 then 'labels' when precision < .4 then 'precision' when abs(recommended - threshold) > .3 then 'delta' else 'applied' end as decision,
cast(case when threshold is not null and recommended is not null and labels >= 50 and precision >= .4 and abs(recommended - threshold) <= .3 then recommended else threshold end as double) as threshold from cur full join pro using (origin) full join sup using (origin)""")
def threshold_auto_apply(s, d):
    h = R.history(s, d)
    cur = h.where("origin <> 'o2'").select("origin").distinct().withColumn("threshold", F.lit(0.2))
    cuts = quantiles.exact(h, ["origin"], "score", {"recommended": 0.8})
    pro = quantiles.joined(h.select("origin").distinct(), cuts, ["origin"]).withColumn("recommended", F.round("recommended", 6))
    sup = pairs(s, d).groupBy("origin").agg(F.count("*").alias("labels"), F.avg(F.col("label").cast("int")).alias("precision"))
    return G.threshold_decisions(cur, pro, sup, 50, 0.4, 0.3)

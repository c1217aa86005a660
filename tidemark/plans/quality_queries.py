"""Queries and SQL for tidemark.operators.quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, quality
from . import roles as R
from .roles import HISTORY, NOW

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pairs(s, d):
    return quality.matched(R.feedback(s, d), R.history(s, d))


CONF = "count(*) filter (decision and label) as tp, count(*) filter (decision and not label) as fp, count(*) filter (not decision and label) as fn"
PRF = """round(coalesce(tp / nullif(tp + fp, 0), 0.0), 4) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 4) as recall,
round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0.0) * coalesce(tp / nullif(tp + fn, 0), 0.0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0), 0), 0.0), 4) as f1"""


@query(f"with {HISTORY} select event_id, h_id, label, decision, version from matched")
def nearest_label_join(s, d):
    return pairs(s, d).select("event_id", "h_id", "label", "decision", "version")


@query(f"with {HISTORY} select f.event_id, exists (select 1 from history h where h.origin = f.origin and h.ts > f.ts and h.ts <= f.ts + interval 6 hour) as found from feedback f")
def trigger_within_six_hours(s, d):
    right = R.history(s, d).select("origin", F.col("ts").alias("r_ts"))
    return joins.exists_after(R.feedback(s, d), right, "origin", 21600, "event_id").select("event_id", "found")


@query(f"""with {HISTORY}, first as (select *, coalesce(own_version, version, 'unknown') as v from (select *, row_number() over (partition by h_id order by ts, event_id) as j from matched) where j = 1),
each as (select v as version, {CONF} from first group by 1),
un as (select * from each union all select 'micro', cast(coalesce(sum(tp), 0) as bigint), cast(coalesce(sum(fp), 0) as bigint), cast(coalesce(sum(fn), 0) as bigint) from each),
sc as (select version, tp, fp, fn, {PRF} from un)
select * from sc union all select 'macro', cast(sum(tp) as bigint), cast(sum(fp) as bigint), cast(sum(fn) as bigint), round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4) from sc where version <> 'micro'""")
def accuracy_by_version(s, d):
    return quality.accuracy_by_version(R.feedback(s, d), R.history(s, d))


@query(f"""with {HISTORY}, first as (select * from (select *, row_number() over (partition by h_id order by ts, event_id) as j from matched) where j = 1), n as (select {CONF} from first) select tp, fp, fn, {PRF} from n""")
def precision_recall_snapshot(s, d):
    return quality.accuracy_by_version(R.feedback(s, d), R.history(s, d)).where("version = 'micro'").drop("version")


@query(f"""with {HISTORY}, a as (select origin, date_trunc('hour', ts) as hour, arg_max(label, (ts, event_id)) as label from feedback group by 1, 2),
b as (select origin, date_trunc('hour', ts) as hour, arg_max(decision, (ts, event_id)) as decision from history group by 1, 2),
each as (select origin, {CONF} from a join b using (origin, hour) group by 1), un as (select * from each union all select 'all', cast(sum(tp) as bigint), cast(sum(fp) as bigint), cast(sum(fn) as bigint) from each)
select origin, tp, fp, fn, {PRF} from un""")
def hourly_accuracy(s, d):
    return quality.hourly_accuracy(R.feedback(s, d), R.history(s, d))


CAL = """, bins as (select {k}, least(cast(floor(score * 10) as bigint), 9) as bin, count(*) as n, sum(score) as s, sum(label::int) as y, sum(power(score - label::int, 2)) as b from matched group by all),
cal as (select {k}, cast(sum(n) as bigint) as n, round(sum(abs(y - s)) / sum(n), 6) as ece, round(sum(b) / sum(n), 6) as brier from bins group by all)"""


@query(f"with {HISTORY}{CAL.format(k='origin')} select *, n < 30 as low_n, ece > .06 as high_ece from cal")
def calibration_per_origin(s, d):
    return quality.calibration(pairs(s, d), ["origin"])


@query(f"with {HISTORY}{CAL.format(k='version')} select *, n < 30 as low_n, ece > .06 as high_ece from cal")
def calibration_per_version(s, d):
    return quality.calibration(pairs(s, d), ["version"])


@query(f"""with {HISTORY}, matched2 as (select *, date_trunc('day', ts) + to_minutes(120 * cast(floor((hour(ts) * 60 + minute(ts)) / 120) as bigint)) as bucket from matched){CAL.format(k='origin, bucket').replace('from matched', 'from matched2')}
select *, n < 30 as low_n, ece > .06 as high_ece from cal""")
def calibration_trend(s, d):
    return quality.calibration(pairs(s, d).withColumn("bucket", quality.trend_bucket(F.col("ts"), 120)), ["origin", "bucket"])


@query(f"""with {HISTORY}, h as (select origin, least(cast(floor(score * 10) as bigint), 9) as bin, count(*) as n, round(avg(score), 6) as conf, round(avg(label::int), 6) as acc from matched group by all)
select origin, bin, coalesce(n, 0) as n, conf, acc from (select origin, bin from (select distinct origin from matched), (select unnest(range(0, 10)) as bin)) left join h using (origin, bin)""")
def reliability_bins(s, d):
    return quality.reliability(pairs(s, d), ["origin"])


@query(f"""with {HISTORY}, n as (select origin, count(*) filter (label) as true_n, count(*) filter (not label) as false_n from matched group by 1)
select origin, true_n, false_n, round(true_n / (true_n + false_n), 4) as precision, case when true_n / (true_n + false_n) >= .75 then 'Strong' when true_n / (true_n + false_n) >= .4 then 'Mixed' else 'Weak' end as quality from n""")
def label_precision_per_origin(s, d):
    return quality.origin_quality(pairs(s, d), 0.75, 0.4)


@query(f"""with {HISTORY}, n as (select cast(floor((epoch(date_trunc('second', h_ts)) - epoch(timestamp '2024-01-10')) / 10800) as bigint) as batch, count(*) filter (label) as tp, count(*) filter (not label) as fp from matched where h_ts >= timestamp '2024-01-10' group by 1)
select batch, tp, fp, round(tp / (tp + fp), 4) as precision, case when tp / (tp + fp) >= .75 then 'Strong' when tp / (tp + fp) >= .4 then 'Mixed' else 'Weak' end as quality from n""")
def quality_batches(s, d):
    return quality.quality_batches(pairs(s, d), "2024-01-10", 3)


@query(f"""with {HISTORY}, t as (select h.origin, count(*) as triggers from history h where decision and exists (select 1 from candidates c where c.origin = h.origin and abs(epoch_us(c.ts) - epoch_us(h.ts)) <= 300000000) group by 1),
n as (select origin, count(*) as candidates, coalesce(any_value(triggers), 0) as triggers from candidates left join t using (origin) group by 1)
select origin, candidates, triggers, round(greatest(candidates - triggers, 0) / candidates, 4) as rate, case when candidates < 3 then 'Insufficient' when greatest(candidates - triggers, 0) / candidates >= .8 then 'High' when greatest(candidates - triggers, 0) / candidates >= .5 then 'Medium' else 'Low' end as level from n""")
def suppression_rate(s, d):
    return quality.suppression(R.candidates(s, d), R.history(s, d).where("decision"))


@query(f"""with {HISTORY}, b as (select origin, date_trunc('day', ts) + to_hours(3 * cast(floor(hour(ts) / 3) as bigint)) as bucket, 1 as c from candidates union all select origin, date_trunc('day', ts) + to_hours(3 * cast(floor(hour(ts) / 3) as bigint)), 0 from history where decision),
n as (select origin, bucket, cast(sum(c) as bigint) as candidates, cast(sum(1 - c) as bigint) as triggers from b group by 1, 2)
select origin, bucket, candidates, triggers, round(triggers / greatest(candidates, 1), 4) as coverage, round(greatest(candidates - triggers, 0) / greatest(candidates, 1), 4) as suppressed from n""")
def coverage_and_suppression_trend(s, d):
    return quality.coverage_trend(R.candidates(s, d), R.history(s, d).where("decision"))


DIST = "count(*) as n, round(avg(score), 6) as mean, round(quantile_cont(score, .5), 6) as median, round(quantile_cont(score, .9), 6) as p90"


@query(f"with {HISTORY} select drifted, {DIST} from history group by 1")
def score_distribution(s, d):
    return quality.score_distribution(R.history(s, d), ["drifted"])


@query(f"with {HISTORY} select origin, drifted, {DIST} from history group by 1, 2")
def score_distribution_per_origin(s, d):
    return quality.score_distribution(R.history(s, d), ["origin", "drifted"])


@query(f"with {HISTORY} select origin, least(cast(floor(score * 10) as bigint), 9) as bin, count(*) as n from history group by all")
def score_histogram(s, d):
    return quality.score_bins(R.history(s, d), ["origin"])


@query(f"with {HISTORY}, n as (select origin, {CONF.replace('not decision', 'score < .25').replace('decision', 'score >= .25')} from matched group by 1) select origin, cast(.25 as double) as threshold, tp, fp, fn, {PRF} from n")
def threshold_quality(s, d):
    return quality.threshold_quality(pairs(s, d), default=0.25)


SWEEP = f"""with {HISTORY}, c0 as (select origin, score as cut, count(*) filter (label) as t, count(*) filter (not label) as f from matched group by 1, 2),
c1 as (select *, sum(t) over w as tp, sum(f) over w as fp, sum(t) over (partition by origin) - sum(t) over w as fn from c0 window w as (partition by origin order by cut desc)),
c2 as (select *, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) as p, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) as r,
       round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 9) as f1 from c1)"""


@query(SWEEP + """, b as (select *, p >= .6 as ok, row_number() over (partition by origin order by p >= .6 desc, case when p >= .6 then r else f1 end desc, case when p >= .6 then f1 else r end desc, case when p >= .6 then 0 else p end desc, cut) as i from c2)
select origin, round(cut, 6) as best, round(least(greatest(cut, .2 - .1), .2 + .1), 6) as recommended, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1, ok from b where i = 1""")
def threshold_sweep(s, d):
    return quality.threshold_sweep(pairs(s, d), 0.6, 0.2)


@query(SWEEP + " select origin, round(min(cut) filter (tp / (tp + fp) >= .6), 6) as threshold from c2 group by 1")
def precision_threshold(s, d):
    return quality.precision_threshold(pairs(s, d), 0.6)


def _at(t: float) -> str:
    return CONF.replace("not decision", f"score < {t}").replace("decision", f"score >= {t}")


@query(f"""with {HISTORY}, a as (select origin, {PRF}, labels from (select origin, count(*) as labels, {_at(.2)} from matched group by 1)), n as (
select a.origin, labels, b.* exclude (origin) from a join (select origin, tp, fp, fn from (select origin, {_at(.3)} from matched group by 1)) b using (origin)),
raw as (select origin, count(*) as labels, {_at(.2)} from matched group by 1), raw2 as (select origin, {_at(.3)} from matched group by 1),
s1 as (select origin, labels, {PRF.replace(', 4)', ', 15)')} from raw), s2 as (select origin, {PRF.replace(', 4)', ', 15)')} from raw2)
select origin, labels, round(s2.precision - s1.precision, 4) as d_precision, round(s2.recall - s1.recall, 4) as d_recall, round(s2.f1 - s1.f1, 4) as d_f1 from s1 join s2 using (origin)""")
def threshold_what_if(s, d):
    return quality.what_if(pairs(s, d), 0.2, 0.3)


@query(f"with {HISTORY} select origin, count(*) as n, round(case when count(*) >= 30 then quantile_cont(score, .9) end, 6) as threshold from history where ts >= timestamp '{NOW}' - interval 48 hour group by 1")
def dynamic_threshold(s, d):
    return quality.dynamic_threshold(R.history(s, d), NOW, 48, 0.9, 30)


def _chains(right: str) -> str:
    """SQL: rows of both sides numbered within stretches that no gap of over 300 seconds cuts; kind 0 is feedback or a candidate."""
    return f"""{HISTORY}, b0 as (select origin, epoch_us(ts) as t, 0 as kind, event_id as id from {right} union all select origin, epoch_us(ts), 1, event_id from history {"where decision" if right == "candidates" else ""}),
b1 as (select *, t - lag(t) over (partition by origin order by t, kind, id) > 300000000 as gap from b0), b2 as (select *, sum(coalesce(gap, false)::int) over (partition by origin order by t, kind, id) as c from b1),
b as (select origin, c, t, kind, id, row_number() over (partition by origin, c, kind order by t, id) as i from b2)"""


def _greedy(mine: int, near: str) -> str:
    """SQL: mine's rows of a chain take others one after the other; near orders the others x that row a may take."""
    return f"""with recursive {_chains("feedback")}, o as (select origin, c, list(struct_pack(i := i, t := t, id := id) order by i) as xs from b where kind = {1 - mine} group by 1, 2),
m as (select b.origin, b.c, b.i, b.t, b.id, xs, len(list_filter(xs, lambda x: x.t < b.t)) as below from b join o on b.origin = o.origin and b.c = o.c where kind = {mine}),
f as (select origin, c, 0 as i, cast([] as bigint[]) as used, cast(null as bigint) as id, cast(null as bigint) as other from (select distinct origin, c from m) union all
select f.origin, f.c, m.i, case when best is null then used else list_append(used, best.i) end, m.id, best.id from f join m on m.origin = f.origin and m.c = f.c and m.i = f.i + 1,
lateral (select list_sort(list_transform(list_filter(xs, lambda x: not list_contains(used, x.i) and abs(x.t - m.t) <= 300000000 {near}),
lambda x: struct_pack(d := abs(x.t - m.t), s := case when x.i <= below then 0 else 1 end, k := case when x.i <= below then -x.i else x.i end, i := x.i, id := x.id)))[1] as best))
select origin, {"id as label_id, other as decision_id" if mine == 0 else "other as label_id, id as decision_id"} from f where other is not null"""


@query(_greedy(1, ""))
def greedy_match_by_trigger(s, d):
    return quality.greedy_by_trigger(R.feedback(s, d), R.history(s, d))


@query(_greedy(0, "and x.i between below and below + 1"))
def greedy_match_by_label(s, d):
    return quality.greedy_by_label(R.feedback(s, d), R.history(s, d))


@query(f"""with recursive {_chains("candidates")}, f as (select distinct origin, c, 1 as i, 1 as j, 0 as n from b union all
select f.origin, f.c, case when abs(x.t - y.t) <= 300000000 or x.t < y.t then f.i + 1 else f.i end, case when abs(x.t - y.t) <= 300000000 or x.t >= y.t then f.j + 1 else f.j end, f.n + (abs(x.t - y.t) <= 300000000)::int
from f join b x on x.origin = f.origin and x.c = f.c and x.kind = 0 and x.i = f.i join b y on y.origin = f.origin and y.c = f.c and y.kind = 1 and y.i = f.j),
m as (select origin, sum(n) as matched from (select origin, c, max(n) as n from f group by 1, 2) group by 1), k as (select origin, count(*) filter (kind = 0) as candidates from b group by 1)
select origin, candidates, cast(matched as bigint) as matched, round(coalesce(matched / nullif(candidates, 0), 0), 4) as coverage, case when coalesce(matched / nullif(candidates, 0), 0) >= .15 then 'High' when coalesce(matched / nullif(candidates, 0), 0) >= .05 then 'Medium' else 'Low' end as level from m join k using (origin)""")
def coverage_summary(s, d):
    return quality.two_pointer_matches(R.candidates(s, d), R.history(s, d).where("decision"))


@query(f"with {HISTORY} select f.event_id, h.event_id as h_id, f.label, h.decision from feedback f join history h on f.origin = h.origin and abs(epoch_us(f.ts) - epoch_us(h.ts)) <= 1800000000 where f.label <> h.decision and score >= .1")
def disagreeing_pairs(s, d):
    right = R.history(s, d).select("origin", F.col("ts").alias("r_ts"), F.col("event_id").alias("h_id"), "decision", "score")
    return joins.within(R.feedback(s, d), right, "origin", 1800).where("label <> decision and score >= 0.1").select("event_id", "h_id", "label", "decision")

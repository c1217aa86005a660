"""Queries of models that are judged on rows they were not fitted on, and SQL for what follows from their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..operators import folds, grid, insight, market, models
from ..sources import ledgers
from . import quality_queries
from . import roles as R
from .market_queries import filled
from .roles import E, NOW

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FEATURES = ["ret_1", "ret_3", "ret_6", "vol", "sma_gap"]


def _bars(s, d) -> DataFrame:
    return market.sma_gap(market.returns(market.rolling_vol(market.returns(filled(s, d), 1)), 3, 6))


@query()
def cross_validated_folds(s, d):
    """Trades of each symbol's walk-forward folds by models of the fold's own training bars."""
    each, _ = folds.cross_validated(_bars(s, d), FEATURES, 240, 120, 5, 3, 0.52)
    return each


@query()
def cross_validated_summary(s, d):
    """Mean and sample deviation over each symbol's folds."""
    _, over = folds.cross_validated(_bars(s, d), FEATURES, 240, 120, 5, 3, 0.52)
    return over.select("symbol", "folds", "trades", *[F.round(c, 6).alias(c) for c in over.columns[3:]])


def _triggers(s, d) -> tuple[DataFrame, DataFrame, list[str]]:
    """(examples of the first four fifths of the time, the rest, features) of hourly counts by origin."""
    dense = grid.densified(R.flags(s, d), "2024-01-01 00:00:00", NOW, "hour")
    x = shared.written(market.trailing_examples(dense, R.triggers(s, d).where("origin <> 'click' or hour(ts) % 6 = 0")), "examples")
    first, rest = models.early(x, 0.8, "bucket")
    return first, rest, ["n_1h", "n_6h", "n_24h", "n_72h", "z", "vol"]


@query()
def trained_ensemble(s, d):
    """Area under precision and recall of three models on hours they were not fitted on, and their weights from it."""
    first, rest, features = _triggers(s, d)
    stacked = None
    for kind in ("lr", "rf", "gb"):
        model = models.train(first.withColumn("label", F.col("label").cast("double")), features, kind, trees=20, rounds=10)
        one = models.probability(model, rest).select("origin", "bucket", F.lit(kind).alias("model"), "p", "label")
        stacked = one if stacked is None else stacked.unionByName(one)
    return folds.area_weights(shared.written(stacked, "stacked")).select("model", "pr_auc", F.round("weight", 6).alias("weight"))


STACK = f"""{E}, st as (select event_id, model, case model when 'a' then value / (value + 60) when 'b' then k / 100.0 else (value + k) / (value + k + 150) end as p, (value + k) >= 120 as label
from e, (select unnest(['a', 'b', 'c']) as model)),
cu as (select model, p, count(*) filter (label) as t, count(*) as m from st group by 1, 2),
rk as (select model, t, sum(t) over w as tp, sum(m) over w as n, sum(t) over (partition by model) as pos from cu window w as (partition by model order by p desc)),
ar as (select model, round(sum(t / pos * tp / n), 6) as pr_auc from rk group by 1), we as (select model, pr_auc, pr_auc / sum(pr_auc) over () as weight from ar)"""


def _stacked(s, d) -> DataFrame:
    e, v, k = R.events(s, d), F.col("value"), F.col("k")
    scores = {"a": v / (v + 60), "b": k / 100, "c": (v + k) / (v + k + 150)}
    parts = F.array(*[F.struct(F.lit(n).alias("model"), p.alias("p")) for n, p in scores.items()])
    return e.select("event_id", (v + k >= 120).alias("label"), F.explode(parts).alias("m")).select("event_id", "m.model", "m.p", "label")


@query(f"with {STACK} select model, pr_auc, round(weight, 6) as weight from we")
def area_weights(s, d):
    """Weights of three scores by their areas, from one ranking of all of them."""
    return folds.area_weights(_stacked(s, d)).select("model", "pr_auc", F.round("weight", 6).alias("weight"))


@query(f"with {STACK} select event_id, round(sum(p * weight), 6) as mean, round(min(p), 6) as low, round(max(p), 6) as high from st join we using (model) group by 1")
def area_weighted_scores(s, d):
    """The three scores blended by those weights, with their range."""
    x = _stacked(s, d)
    return folds.blended(x, folds.area_weights(x), ["event_id"]).select("event_id", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query()
def held_out_calibration(s, d):
    """Calibration error and Brier score of scores before and after, calibrated on the other folds."""
    p = quality_queries.pairs(s, d).select("event_id", F.col("score").alias("p"), "label")
    across = folds.calibrated_across(p, F.crc32(F.col("event_id").cast("string")) % 4, 4)
    return folds.calibration_gain(across)


def _model_scores(s, d) -> DataFrame:
    """p of each origin and hour after the first four fifths of the time, by a logistic model of the hours before."""
    first, rest, features = _triggers(s, d)
    model = folds.logistic(first.withColumn("fold", F.lit(0)), "fold", features)
    return shared.written(folds.scored(rest.withColumn("fold", F.lit(0)), model, "fold", features).select("origin", "bucket", "p"), "model-scores")


@query()
def live_backtest_model(s, d):
    """Precision and recall over the last 24 hours of a fitted model's scores."""
    last = _model_scores(s, d).where(F.col("bucket") >= F.expr(f"timestamp '{NOW}' - interval 30 hour"))
    return insight.live_backtest(last, R.triggers(s, d), 0.5)


@query()
def fitted_thresholds_model(s, d):
    """The smallest cutoffs of a fitted model's scores that reach each precision."""
    return insight.fitted_thresholds(_model_scores(s, d), R.triggers(s, d), {"p70": 0.7, "p80": 0.8})


@query(f"with {E} select event_id, ts, value from e order by ts desc, event_id desc limit 50")
def ledger_tail(s, d):
    """The last 50 rows of a ledger written by time, from its newest files."""
    path = shared.folder(s, "ledger-by-time")
    ledgers.write_by_time(R.events(s, d).select("event_id", "ts", "value"), path, 16)
    return ledgers.tail_by_time(s, path, "event_id bigint, ts timestamp, value double", 50, "ts", "event_id")

"""Column functions shared by the operators: normalisation, tolerant parsing, bands, maps and small formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Origin aliases.
ALIASES = {"twitter_api": "twitter", "Twitter": "twitter", "rss": "rss_news", "Reddit": "reddit"}
# Thresholds and multipliers by volatility regime.
REGIME_THRESHOLD, DEFAULT_THRESHOLD = {"calm": 2.2, "normal": 2.5, "turbulent": 3.0}, 2.5
REGIME_FACTOR = {"calm": 0.9, "normal": 1.0, "turbulent": 1.1}
# Share of a priority score by retrain hint.
HINT_WEIGHT = {"low_confidence": 0.6, "missing_agreement": 0.8, "asset_spike": 1.0}


def lookup(values: dict, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def normal_origin(x: Column) -> Column:
    """Aliases, else lower case; null and blank are 'unknown'."""
    t = F.trim(x)
    return F.coalesce(lookup(ALIASES, t, None), F.nullif(F.lower(t), F.lit("")), F.lit("unknown"))


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def parse_ts(x: Column) -> Column:
    """Epoch seconds as a number or numeric string, or ISO-8601 with or without zone (then UTC); else null."""
    s = x.cast("string")
    number = F.timestamp_micros((s.try_cast("double") * 1_000_000).cast("long"))
    return F.when(s.rlike(r"^\d+\.?\d*$"), number).otherwise(F.try_to_timestamp(s))


def parse_ts_ms(x: Column) -> Column:
    """As parse_ts, but numbers beyond the year 3000 are milliseconds."""
    n = x.cast("string").try_cast("double")
    seconds = F.when(n > 32503680000, n / 1000).otherwise(n)
    return F.when(n.isNotNull(), F.timestamp_micros((seconds * 1_000_000).cast("long"))).otherwise(F.try_to_timestamp(x.cast("string")))


def parse_ts_z(x: Column) -> Column:
    """As parse_ts; strings that end in Z lose their fraction of a second."""
    t = parse_ts(x)
    return F.when(x.cast("string").endswith("Z"), F.date_trunc("second", t)).otherwise(t)


def bucket(ts: Column, interval: str) -> Column:
    if interval not in ("hour", "day"):
        raise ValueError(f"interval must be hour or day, not {interval!r}")
    return F.date_trunc(interval, ts)


def regime_threshold(regime: Column) -> Column:
    return lookup(REGIME_THRESHOLD, regime, DEFAULT_THRESHOLD)


def regime_scaled(threshold: Column, regime: Column) -> Column:
    return threshold * lookup(REGIME_FACTOR, regime, 1.0)


def weight_band(score: Column) -> Column:
    return F.when(score.isNull(), 1.0).when(score >= 0.75, 1.25).when(score >= 0.5, 1.0).otherwise(0.75)


def weight_band_open(score: Column) -> Column:
    """At 0.5 exactly the low weight."""
    return F.when(score.isNull(), 1.0).when(score >= 0.75, 1.25).when(score <= 0.5, 0.75).otherwise(1.0)


def weight_band_zero(score: Column) -> Column:
    """A missing score counts as 0."""
    return weight_band(F.coalesce(score, F.lit(0.0)))


def adaptive_threshold(weight: Column) -> Column:
    return F.when(weight >= 1.25, 0.4).when(weight <= 0.85, 0.8).otherwise(0.7)


def overrides(weight: Column, delta: Column) -> Column:
    return weight * delta >= adaptive_threshold(weight)


def blended(social: Column, news: Column) -> Column:
    mean = 0.6 * social + 0.4 * news
    return F.when((social >= 0) != (news >= 0), mean * 0.5).otherwise(mean)


def confidence_band(social: Column, news: Column) -> Column:
    top = F.greatest(F.abs(social), F.abs(news))
    return F.when((top >= 0.6) & ((social >= 0) == (news >= 0)), "high").when(top >= 0.4, "medium").otherwise("low")


def direction_label(score: Column) -> Column:
    return F.when(score >= 0.6, "positive").when(score <= -0.6, "negative").otherwise("neutral")


def trust_score(agree: Column, p_disagree: Column) -> Column:
    return F.round(0.6 * F.coalesce(agree, F.lit(0.5)) + 0.4 * (1 - p_disagree), 3)


def trust_label(score: Column) -> Column:
    return F.when(score >= 0.75, "Trusted").when(score <= 0.35, "Untrusted").otherwise("Uncertain")


def retrain_hint(confidence: Column, agreement: Column, suppressed_24h: Column) -> Column:
    return F.when(confidence < 0.5, "low_confidence").when(agreement.isNull(), "missing_agreement").when(suppressed_24h >= 2, "asset_spike")


def priority_score(trust: Column, hint: Column, age_h: Column, n: Column, flagged: Column) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), trust))
    recent = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age_h / 24)), F.lit(0.5))
    return F.round(0.40 * (1 - clamped) + 0.25 * lookup(HINT_WEIGHT, F.coalesce(hint, F.lit("")), 0.0) + 0.20 * recent + 0.10 * F.least(n / 5, F.lit(1.0)) + 0.05 * flagged.cast("int"), 4)


def heuristic_confidence(change: Column, sentiment: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (change / 10 + sentiment) / 2))


def third_band(confidence: Column) -> Column:
    return F.when(confidence > 0.66, "high").when(confidence > 0.33, "medium").otherwise("low")


def movement(change: Column) -> Column:
    return F.when(change > 10, "Surging").when(change > 5, "Rising").when(change > 2, "Up").when(change > -2, "Stable").when(change > -5, "Down").otherwise("Falling")


def reliability(confidence: Column) -> Column:
    return F.round(confidence * 0.9 + 0.1, 3)


def logistic(z: Column, k: float = 0.1) -> Column:
    return 1 / (1 + F.exp(-k * z))


def bernoulli_kl(p: Column, q: Column) -> Column:
    p, q = (F.least(F.greatest(x, F.lit(1e-9)), F.lit(1 - 1e-9)) for x in (p, q))
    return p * F.ln(p / q) + (1 - p) * F.ln((1 - p) / (1 - q))


def top_contributions(features: Column, weights: Column, n: int) -> Column:
    """The n largest |weight * feature| of two arrays, with their places."""
    parts = F.zip_with(features, weights, lambda x, w: x * w)
    named = F.transform(parts, lambda c, i: F.struct((-F.abs(c)).alias("order"), i.alias("feature"), c.alias("value")))
    return F.slice(F.array_sort(named), 1, n)


def banded(x: Column, bands: list[tuple[float, str]], other: str) -> Column:
    """The name of the first band whose lower bound x reaches."""
    out = F.lit(other)
    for low, name in reversed(bands):
        out = F.when(x >= low, name).otherwise(out)
    return out

"""Models on pyspark.ml: training, calibration, ensembles, evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """weight: rows of each class weigh as much together as those of the other."""
    n = rows.groupBy(label).agg(F.count("*").alias("__c"))
    total = rows.count()
    return rows.join(n, label).withColumn("weight", F.lit(total) / (2 * F.col("__c"))).drop("__c")


def classifier(kind: str, features: str = "features", label: str = "label", trees: int = 200, rounds: int = 300):
    common = {"featuresCol": features, "labelCol": label, "weightCol": "weight"}
    if kind == "lr":
        return LogisticRegression(maxIter=50, regParam=1e-3, **common)
    if kind == "rf":
        return RandomForestClassifier(numTrees=trees, maxDepth=8, seed=7, **common)
    if kind == "gb":
        return GBTClassifier(maxIter=rounds, stepSize=0.05, maxDepth=3, seed=7, **common)
    raise ValueError(f"no model {kind!r}")


def train(rows: DataFrame, features: list[str], kind: str = "lr", label: str = "label", **sizes: int) -> PipelineModel:
    """A model over named double columns, classes balanced by weight; sizes: trees of a forest, rounds of boosting."""
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), classifier(kind, label=label, **sizes)]
    return Pipeline(stages=stages).fit(balanced_weights(rows, label))


def probability(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def calibrated(scored: DataFrame, p: str = "p", label: str = "label", kind: str = "isotonic") -> PipelineModel:
    """A model that gives scores (column p) a column calibrated: shares of true labels by steps, or by a sigmoid."""
    rows = scored.withColumn("__y", F.col(label).cast("double"))
    vector = VectorAssembler(inputCols=[p], outputCol="__v")
    if kind == "isotonic":
        return Pipeline(stages=[vector, IsotonicRegression(featuresCol="__v", labelCol="__y", predictionCol="calibrated")]).fit(rows)
    if kind == "sigmoid":
        fit = LogisticRegression(featuresCol="__v", labelCol="__y", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c")
        return Pipeline(stages=[vector, fit]).fit(rows)
    raise ValueError(f"no calibration {kind!r}")


def calibrate(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """scored with the column calibrated."""
    out = model.transform(scored)
    if "calibrated" not in out.columns:
        out = out.withColumn("calibrated", vector_to_array("__p")[1])
    return out.select(*scored.columns, "calibrated")


def by_regime(rows: DataFrame, features: list[str], scored: DataFrame, least: int = 10, label: str = "label") -> DataFrame:
    """scored with p by the model of its regime; a regime with fewer rows than least, or of one class, has the model of all rows."""
    n = {r["regime"]: (r["n"], r["k"]) for r in rows.groupBy("regime").agg(F.count("*").alias("n"), F.count_distinct(label).alias("k")).collect()}
    own = [x for x, (m, k) in n.items() if m >= least and k > 1]
    rest = F.coalesce(~F.col("regime").isin(own), F.lit(True)) if own else F.lit(True)
    parts = [probability(train(rows.where(F.col("regime") == x), features, label=label), scored.where(F.col("regime") == x)) for x in own]
    parts.append(probability(train(rows, features, label=label), scored.where(rest)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def from_maps(log: DataFrame, key: str, features: str, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """(log with a column for each key of its feature maps, 0 where a row has none; the keys, sorted). Feature names are few by nature."""
    names = sorted(r[0] for r in log.select(F.explode(F.map_keys(features))).distinct().collect())
    return log.select(key, *keep, *[F.coalesce(F.col(features)[n], F.lit(0.0)).alias(n) for n in names]), names


def early(rows: DataFrame, share: float = 0.8, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(rows of the first share of the time between the first and the last, the rows after it)."""
    a, b = rows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    first = F.unix_micros(ts) <= (a or 0) + int(share * ((b or 0) - (a or 0)))
    return rows.where(first), rows.where(~first)


def apart(rows: DataFrame, key: str, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(four fifths of the rows by a hash of their key, the others)."""
    held = F.crc32(F.col(key).cast("string")) % folds == 0
    return rows.where(~held), rows.where(held)


def weighted_forest(rows: DataFrame, features: list[str], category: str, label: str, weight: str, scored: DataFrame) -> DataFrame:
    """scored with p: a random forest on features and the index of a category of rows, each with its own weight."""
    stages = [
        StringIndexer(inputCol=category, outputCol="__i", handleInvalid="keep"), VectorAssembler(inputCols=[*features, "__i"], outputCol="features"),
        RandomForestClassifier(labelCol=label, weightCol=weight, numTrees=50, seed=7),
    ]
    return probability(Pipeline(stages=stages).fit(rows), scored).drop("__i")


def pr_weights(scores: dict[str, float]) -> dict[str, float]:
    """Weights of an ensemble's models in proportion to their areas under precision and recall; equal if all are 0."""
    total = sum(scores.values())
    return {k: v / total if total else 1 / len(scores) for k, v in scores.items()}


def ensemble(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """mean, low and high of several models' columns by their weights."""
    total = sum(weights.values())
    mean = sum((F.col(c) * (w / total) for c, w in weights.items()), F.lit(0.0))
    cols = list(weights)
    return rows.withColumn("mean", mean).withColumn("low", F.least(*cols) if len(cols) > 1 else F.col(cols[0])).withColumn("high", F.greatest(*cols) if len(cols) > 1 else F.col(cols[0]))


def evaluated(scored: DataFrame, p: str = "p", label: str = "label") -> dict[str, float]:
    """AUCs, log-loss and Brier score; 0.5 and the base rate where a class is missing."""
    y = F.col(label).cast("double")
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    n = scored.agg(F.avg(y).alias("rate"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"), F.avg((F.col(p) - y) ** 2).alias("brier")).first()
    rate = n["rate"] or 0.0
    out = {"roc_auc": 0.5, "pr_auc": rate, "log_loss": n["log_loss"], "brier": n["brier"]}
    if 0 < rate < 1:
        for name, metric in (("roc_auc", "areaUnderROC"), ("pr_auc", "areaUnderPR")):
            out[name] = BinaryClassificationEvaluator(rawPredictionCol=p, labelCol=label, metricName=metric).evaluate(scored.withColumn(label, y))
    return out


#: Rows of a partition that a forest of text is fitted on; a row there holds a bin of 4 bytes for each of TERMS features.
FOREST_ROWS, TERMS = 2048, 4096


def spread(rows: DataFrame, per: int) -> DataFrame:
    """rows dealt to partitions of so many each."""
    return rows.repartition(max(1, -(-rows.count() // per)))


def text_classifier(rows: DataFrame, text: str = "text", label: str = "label", per: int = FOREST_ROWS) -> PipelineModel:
    """TF-IDF of lower-case words and a random forest, fitted on term counts that are written once and dealt by number."""
    words = [RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\W+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=TERMS)]
    counts = PipelineModel(words).transform(balanced_weights(rows, label)).select("tf", label, "weight")
    fit = [IDF(inputCol="tf", outputCol="features"), RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=50, seed=7)]
    return PipelineModel([*words, *Pipeline(stages=fit).fit(spread(shared.written(counts, "term-counts"), per)).stages])


#: A Poisson weight counts how many of these shares a hash exceeds, as 32-bit numbers in hex.
SHARES = ("5e2d58d8", "bc5ab1b1", "eb715e1d", "fb239797", "ff1025f5", "ffd90f3b")


def bootstrap(scored: DataFrame, times: int, p: str = "p", label: str = "label") -> DataFrame:
    """Mean and deviation of the Brier score over resamples with Poisson weights from hashes of row and resample: one pass, no shuffle of copies. Resamples without a row are left out."""
    u = F.substring(F.md5(F.concat_ws(":", F.col("row").cast("string"), F.col("t").cast("string"))), 1, 8)
    weight = sum(((u > c).cast("int") for c in SHARES), F.lit(0))
    every = scored.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("w", weight)
    each = every.groupBy("t").agg(F.try_divide(F.sum(F.col("w") * (F.col(p) - F.col(label).cast("double")) ** 2), F.sum("w")).alias("brier"))
    return each.agg(F.avg("brier").alias("mean"), F.stddev_samp("brier").alias("std"))

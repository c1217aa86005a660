"""The forest of text: what it is fitted on lies in partitions of a bounded number of rows, whatever the input's are."""

from pyspark.sql import functions as F

from tidemark.operators import models


def test_forest_of_text_is_fitted_on_small_partitions(spark, monkeypatch):
    sizes, fit = [], models.RandomForestClassifier.fit

    def seen(self, rows, *params):
        sizes.extend(x["count"] for x in rows.groupBy(F.spark_partition_id()).count().collect())
        return fit(self, rows, *params)

    monkeypatch.setattr(models.RandomForestClassifier, "fit", seen)
    rows = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad poor'} word{i % 7}", float(i % 2)) for i in range(200)], "id long, text string, label double").coalesce(1)
    got = models.probability(models.text_classifier(rows, per=20), rows)
    assert all((x["p"] > 0.5) == (x["label"] == 1.0) for x in got.collect())
    assert sum(sizes) == 200 and max(sizes) <= 24

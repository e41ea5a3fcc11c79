"""The tactic classifier on cells of equal bins: the same whatever the layout of the rows, the regression as on rows, bags as of rows."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from skillspark.operators import models as ML


def _rows(spark, n):
    x = spark.range(n).withColumn("h", F.xxhash64("id"))
    x = x.select("id", F.pmod("h", F.lit(7)).cast("double").alias("a"), F.pmod(F.shiftright("h", 8), F.lit(900)).cast("double").alias("b"), F.pmod(F.shiftright("h", 20), F.lit(11)).cast("double").alias("c"), (F.pmod(F.shiftright("h", 30), F.lit(500)) / 7).alias("noise"))
    kind = F.when(F.col("noise") < 9, "Pin").when(F.col("a") + F.col("b") / 150 > 6, "Fork").when(F.col("c") > 5, "Skewer").otherwise("Pin")
    return x.withColumns({"category": kind, "rating": 900 + 40 * F.col("a") - 13 * F.col("c") + F.col("b") / 9 + F.col("noise")})


def test_rows_in_other_partitions_give_the_same(spark):
    rows = _rows(spark, 1000)  # few enough for exact quantiles
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0").select("id", "a", "b", "c")
    test = test.unionByName(test.where("id < 40"))
    found = []
    for n in (1, 5):
        out = ML.tactic_classifier(train.repartition(n), test, ("a", "b", "c"), trees=4)
        assert out.columns == ["id", "a", "b", "c", "predicted", "confidence", "predicted_rating"]
        found.append(sorted((r.id, r.predicted, round(r.confidence, 9), round(r.predicted_rating, 6)) for r in out.collect()))
    assert found[0] == found[1] and len(found[0]) == test.count()
    right = {r.id: r.category for r in rows.collect()}
    assert np.mean([right[i] == p for i, p, _, _ in found[0]]) > 0.8


def test_regression_equals_that_of_rows(spark):
    rows = _rows(spark, 2000)
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    assemble = VectorAssembler(inputCols=["a", "c"], outputCol="features")
    want = GBTRegressor(featuresCol="features", labelCol="rating", maxIter=10, seed=7).fit(assemble.transform(train)).transform(assemble.transform(test))
    want = {r.id: r.prediction for r in want.select("id", "prediction").collect()}
    got = {r.id: r.predicted_rating for r in ML.tactic_classifier(train, test, ("a", "c"), trees=1).select("id", "predicted_rating").collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_bags_are_as_of_rows(spark):
    cells = spark.range(400).select("id", F.when(F.col("id") < 200, 1).otherwise(900).cast("long").alias("n"))
    drawn = {r.id: r._bag for r in ML.bags(cells, ("id",), "n", 20, 7).collect()}
    for ids, n in ((range(200), 1), (range(200, 400), 900)):
        x = np.array([drawn[i] for i in ids])
        assert abs(x.mean() / n - 1) < 0.06 and abs(x.var() / n - 1) < 0.15
    again = {r.id: r._bag for r in ML.bags(cells.repartition(3), ("id",), "n", 20, 7).collect()}
    assert again == drawn

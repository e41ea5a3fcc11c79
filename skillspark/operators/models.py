"""Learned models with Spark ML, over long tables of players, categories and features."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.games import logit, sigmoid
from .store import Store

#: Strengths of shrinkage that are tried.
STRENGTHS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0)
#: Rows of means and cuts that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 20_000
#: Bins of a feature, as many as Spark's trees take.
BINS = 32
#: Predicted cells that are broadcast at most; more are joined by a shuffle.
MOST_CELLS = 200_000
#: Rows of permutations that a task makes.
TASK = 100_000


def baselines(stats: DataFrame) -> DataFrame:
    """(player_id, category, model, p): the miss probabilities of the simple models side by side, from base_rates with a player's shrunk hit rates (column rate, null where there is none; overall).

    `empirical` is one less the rate of the category that is shrunk to the player's own, or to the overall rate where the player hasn't met it.
    """
    empirical = 1 - F.coalesce("rate", F.nullif("overall", F.lit(0.0)), F.lit(0.5))
    kinds = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("p")) for n, c in (("global", "g"), ("category", "cat"), ("player", "player"))], F.struct(F.lit("empirical").alias("model"), empirical.alias("p")))
    return stats.select("player_id", "category", F.explode(kinds).alias("x")).select("player_id", "category", "x.model", "x.p")


def base_rates(counts: DataFrame) -> DataFrame:
    """Adds g, cat and player miss rates to (player_id, category, misses, n): global, smoothed by 2 and by 4 global pseudo-counts."""
    everyone = counts.agg((F.sum("misses") / F.sum("n")).alias("g"))
    rows = counts.crossJoin(F.broadcast(everyone))
    smooth = lambda k: (F.sum("misses") + k * F.any_value("g")) / (F.sum("n") + k)
    # Sums by category are few, whatever the rows; a window by category would put all rows into as many tasks.
    by_category = rows.groupBy("category").agg(smooth(2).alias("cat"))
    by_player = rows.groupBy("player_id").agg(smooth(4).alias("player"))
    return rows.join(by_category, "category").join(by_player, "player_id").select(*counts.columns, "g", "cat", "player")


def shrunk_losses(rated: DataFrame, keys: tuple[str, ...], strengths: tuple[float, ...] = STRENGTHS) -> DataFrame:
    """(keys, s, loss, n): summed log loss of (test_misses, test_n) under rates shrunk to sigmoid(logit(player) + logit(cat) - logit(g)) by each strength s, all tried in one aggregate."""
    prior = sigmoid(logit(F.col("player")) + logit(F.col("cat")) - logit(F.col("g")))
    tried = rated.withColumn("s", F.explode(F.array(*map(F.lit, strengths))))
    p = F.least(F.greatest((F.col("misses") + F.col("s") * prior) / (F.col("n") + F.col("s")), F.lit(1e-4)), F.lit(1 - 1e-4))
    loss = -(F.col("test_misses") * F.log(p) + (F.col("test_n") - F.col("test_misses")) * F.log(1 - p))
    return tried.groupBy(*keys, "s").agg(F.sum(loss).alias("loss"), F.sum("test_n").alias("n"))


def strength_by_fold(rated: DataFrame, fold: str = "fold", strengths: tuple[float, ...] = STRENGTHS) -> DataFrame:
    """(fold, s, log_loss): for each fold of players the strength that is best on the other folds, and its log loss on this one."""
    own = shrunk_losses(rated, (fold,), strengths)
    every = own.groupBy("s").agg(F.sum("loss").alias("all_loss"), F.sum("n").alias("all_n"))
    others = (F.col("all_loss") - F.col("loss")) / (F.col("all_n") - F.col("n"))
    best = own.join(F.broadcast(every), "s").groupBy(fold).agg(F.min_by(F.struct("s", (F.col("loss") / F.col("n")).alias("log_loss")), F.struct(F.round(others, 9), "s")).alias("x"))
    return best.select(fold, "x.s", "x.log_loss")


def isotonic(df: DataFrame, score: str = "score", y: str = "y", weight: str = "w") -> DataFrame:
    """Adds p: the monotone map of score to y's rate, clipped away from 0 and 1."""
    model = IsotonicRegression(featuresCol=score, labelCol=y, weightCol=weight, predictionCol="_p").fit(df)
    return model.transform(df).withColumn("p", F.least(F.greatest("_p", F.lit(1e-4)), F.lit(1 - 1e-4))).drop("_p")


def miss_forest(train: DataFrame, test: DataFrame, features: tuple[str, ...], y: str = "rate", weight: str = "n", seed: int = 7) -> DataFrame:
    """Adds prediction to test from a weighted regression forest on train."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), RandomForestRegressor(featuresCol="features", labelCol=y, weightCol=weight, numTrees=20, maxDepth=6, seed=seed)]
    return Pipeline(stages=stages).fit(train).transform(test).drop("features")


def classify(train: DataFrame, test: DataFrame, vector: str, label: str, kind: str = "logistic", seed: int = 7) -> DataFrame:
    """Adds prediction and probability to test from standardised features (an array column)."""
    ready = lambda df: df.withColumn("raw", array_to_vector(F.col(vector).cast("array<double>")))
    model = LogisticRegression(featuresCol="features", labelCol=label, regParam=0.01, maxIter=50) if kind == "logistic" else RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=20, seed=seed)
    fitted = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), model]).fit(ready(train))
    return fitted.transform(ready(test)).withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("raw", "features", "rawPrediction", "probability")


def regress(train: DataFrame, test: DataFrame, features: tuple[str, ...], y: str, kind: str = "ridge", seed: int = 7) -> DataFrame:
    model = {"ridge": lambda: LinearRegression(labelCol=y, regParam=1.0), "boosted": lambda: GBTRegressor(labelCol=y, maxIter=10, seed=seed), "forest": lambda: RandomForestRegressor(labelCol=y, numTrees=20, seed=seed)}[kind]()
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), model]).fit(train).transform(test).drop("features")


def temperature(df: DataFrame, logit_col: str = "z", y: str = "y", low: float = 0.1, high: float = 10.0, steps: int = 41) -> DataFrame:
    """One row: the temperature with the smallest log loss on a grid in log space, all tried in one aggregate."""
    grid = [math.exp(math.log(low) + (math.log(high) - math.log(low)) * i / (steps - 1)) for i in range(steps)]
    p = F.least(F.greatest(sigmoid(F.col(logit_col) / F.col("t")), F.lit(1e-12)), F.lit(1 - 1e-12))
    tried = df.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    t = F.col(y).cast("double")
    return tried.groupBy("t").agg(F.avg(-(t * F.log(p) + (1 - t) * F.log(1 - p))).alias("nll")).orderBy("nll", "t").limit(1)


def standardise(df: DataFrame, column: str, keys: tuple[str, ...] = (), floor: float = 1e-3) -> DataFrame:
    """Adds <column>_z by mean and population sd, the sd at least `floor`."""
    stats = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.greatest(F.stddev_pop(column), F.lit(floor)).alias("_s"))
    out = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))
    return out.withColumn(f"{column}_z", (F.col(column) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def importances(train: DataFrame, features: tuple[str, ...], label: str, seed: int = 7) -> DataFrame:
    """(rank, feature, importance) of a forest's features; ties by name."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=20, maxDepth=6, seed=seed)]
    found = Pipeline(stages=stages).fit(train).stages[-1].featureImportances.toArray().tolist()
    order = sorted(zip(features, found), key=lambda x: (-x[1], x[0]))  # as many as there are features
    return train.sparkSession.createDataFrame([(i + 1, f, float(x)) for i, (f, x) in enumerate(order)], "rank int, feature string, importance double")


def permuted_labels(df: DataFrame, unit: str, label: str, times: int, seed: int = 0, part: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """(unit, rep, label, columns of keep): the labels at rep 0, and `times` permutations of them; each has every label as often as the data.

    A permutation orders units by a hash and hands labels out in order, as many of each as there are. So a row's label follows from its hash and the hashes at which labels begin. These are found in two steps: rows are
    counted by ranges of the hash, and only those of a range in which a label begins are ordered. No row of a permutation is sent to another task but these.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(unit).isNotNull()).withColumn("copy", F.row_number().over(Window.partitionBy(unit).orderBy(label))).select(unit, "copy", label, *keep)
    store = Store(df.sparkSession)
    rows, _ = store.put(rows)
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    n, labels = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    small = F.broadcast if times * labels <= MOST_BROADCAST else lambda x: x
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * times // TASK + 1)
    rows = rows.repartition(parts, unit, "copy")  # few and short rows, of which each makes `times`
    # A row for each label: those before it have places below `begin`.
    begins = counts.select(F.col(label).alias("_label"), (F.sum("n").over(Window.orderBy(label)) - F.col("n")).alias("begin"))
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("h", F.xxhash64(unit, "rep", F.lit(seed)))
    drawn = drawn.withColumn("range", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * max(1, n // part)))
    sums = drawn.groupBy("rep", "range").agg(F.count("*").alias("k"))
    sums = sums.withColumn("before", F.sum("k").over(Window.partitionBy("rep").orderBy("range")) - F.col("k"))
    wanted = sums.crossJoin(F.broadcast(begins)).where("begin >= before and begin < before + k").select("rep", "range", "_label", (F.col("begin") - F.col("before") + 1).alias("place"))
    wanted = wanted.groupBy("rep", "range").agg(F.collect_list(F.struct("place", F.col("_label").alias("label"))).alias("wanted"))
    place = F.row_number().over(Window.partitionBy("rep", "range").orderBy("h", unit, "copy"))
    found = drawn.join(small(wanted), ["rep", "range"]).select("rep", "h", unit, "copy", "wanted", place.alias("place")).select("rep", "h", unit, "copy", F.explode(F.filter("wanted", lambda x: x["place"] == F.col("place"))).alias("x"))
    cuts = found.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("h", F.col(unit).alias("unit"), "copy", "x.label"))).alias("cuts"))
    cuts, _ = store.put(cuts)
    here = F.struct("h", F.col(unit).alias("unit"), "copy")
    own = F.element_at(F.filter("cuts", lambda c: F.struct(c["h"].alias("h"), c["unit"].alias("unit"), c["copy"].alias("copy")) <= here), -1)["label"]
    drawn = drawn.join(small(cuts), "rep").select(unit, "rep", own.alias(label), *keep)
    return drawn.unionByName(rows.select(unit, F.lit(0).alias("rep"), label, *keep))


def permutation_scores(df: DataFrame, unit: str, features: tuple[str, ...], label: str, times: int = 500, folds: int = 5, seed: int = 0) -> DataFrame:
    """(rep, score): the cross-validated accuracy of the nearest class mean of standardised features, at rep 0 with the labels and then with each permutation of them.

    The class means of a fold's training rows are sums of all folds less its own, so that each permutation is summed once. Rows of permutations are summed and scored where they are made; only sums and means are sent.
    """
    good = df.where(F.expr(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in features))).select(unit, label, *features)
    good, _ = Store(df.sparkSession).put(good)
    stats = good.agg(*[x for i, c in enumerate(features) for x in (F.avg(c).alias(f"m{i}"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"s{i}"))])
    z = F.array(*[(F.col(c).cast("double") - F.col(f"m{i}")) / F.col(f"s{i}") for i, c in enumerate(features)])
    rows = good.crossJoin(F.broadcast(stats)).select(unit, label, z.alias("z"), F.pmod(F.xxhash64(unit, F.lit(seed + 1)), F.lit(folds)).alias("fold"))
    rows = permuted_labels(rows, unit, label, times, seed, keep=("z", "fold")).withColumnRenamed(label, "y")
    sums = rows.groupBy("rep", "fold", "y").agg(F.count("*").alias("n"), *[F.sum(F.col("z")[i]).alias(f"z{i}") for i in range(len(features))])
    names = ["n", *[f"z{i}" for i in range(len(features))]]
    whole = sums.groupBy("rep", "y").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    every = whole.crossJoin(F.broadcast(sums.sparkSession.range(folds).select(F.col("id").alias("fold")))).join(sums, ["rep", "fold", "y"], "left")
    rest = lambda c: F.col(f"all_{c}") - F.coalesce(F.col(c), F.lit(0))
    means = every.where(rest("n") > 0).select("rep", "fold", F.struct("y", F.array(*[rest(f"z{i}") / rest("n") for i in range(len(features))]).alias("mean")).alias("x"))
    means = means.groupBy("rep", "fold").agg(F.collect_list("x").alias("means"))
    far = lambda m: F.aggregate(F.zip_with("z", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    nearest = F.array_min(F.transform("means", lambda m: F.struct(far(m["mean"]).alias("d"), m["y"].alias("y"))))["y"]
    return rows.join(F.broadcast(means) if times * folds <= MOST_BROADCAST else means, ["rep", "fold"]).groupBy("rep").agg(F.avg((nearest == F.col("y")).cast("double")).alias("score"))


def permutation_test(df: DataFrame, unit: str, features: tuple[str, ...], label: str, times: int = 500, folds: int = 5, seed: int = 0) -> DataFrame:
    """One row (score, null_mean, p): the classifier's score, that of `times` permutations of the labels on average, and the share (1 + as good or better) / (1 + times) of them."""
    scores = permutation_scores(df, unit, features, label, times, folds, seed)
    real = scores.where("rep = 0").select(F.col("score").alias("real"))
    return scores.where("rep > 0").crossJoin(F.broadcast(real)).groupBy(F.col("real").alias("score")).agg(F.avg("score").alias("null_mean"), ((1 + F.count_if(F.col("score") >= F.col("real"))) / (1 + F.count("*"))).alias("p"))


def weakness_forest(features: DataFrame, scores: DataFrame, columns: tuple[str, ...], folds: int = 3, seed: int = 7) -> DataFrame:
    """(player_id, category, fold, score, prediction, mean): held-out predictions in [0, 1] of one forest over players' features and arms, beside the arm's mean in training.

    features: player_id and columns; scores: player_id, category, score. A row for each player and arm stands for one of the forest's outputs.
    """
    arms = [r.category for r in scores.select("category").distinct().orderBy("category").collect()]  # the arms, a fixed number
    one_hot = [F.when(F.col("category") == a, 1.0).otherwise(0.0).alias(f"is_{i}") for i, a in enumerate(arms)]
    rows = scores.join(features.select("player_id", *columns), "player_id").select("*", *one_hot, F.pmod(F.xxhash64("player_id", F.lit(seed)), F.lit(folds)).alias("fold"))
    out = None
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        stages = [VectorAssembler(inputCols=[*columns, *(f"is_{i}" for i in range(len(arms)))], outputCol="features"), RandomForestRegressor(featuresCol="features", labelCol="score", numTrees=20, maxDepth=6, seed=seed)]
        mean = train.groupBy("category").agg(F.avg("score").alias("mean"))
        p = Pipeline(stages=stages).fit(train).transform(test).join(mean, "category", "left")
        p = p.select("player_id", "category", "fold", "score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")).alias("prediction"), "mean")
        out = p if out is None else out.unionByName(p)
    return out


def weakness_scores(predicted: DataFrame, top: int = 3) -> DataFrame:
    """(fold, players, mae, baseline_mae, top_hit) of weakness_forest: errors beside the mean's, and how often the weakest arm is among the predicted `top`."""
    place = lambda c: F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc(c), "category"))
    rows = predicted.withColumns({"_t": place("score"), "_p": place("prediction")})
    return rows.groupBy("fold").agg(F.countDistinct("player_id").alias("players"), F.avg(F.abs(F.col("prediction") - F.col("score"))).alias("mae"), F.avg(F.abs(F.col("mean") - F.col("score"))).alias("baseline_mae"), (F.count_if((F.col("_t") == 1) & (F.col("_p") <= top)) / F.count_if(F.col("_t") == 1)).alias("top_hit"))


def human_difficulty(train: DataFrame, test: DataFrame, levels: tuple[str, ...], seed: int = 7) -> DataFrame:
    """(row columns, model, p): the chance that a position's best move is found, by six predictors fitted on train (rating, category, difficulty, found and the log odds `levels`).

    `rating`: logistic in the rating; `category`: the category's rate, where it is new that of all; `gap`: the logistic of (rating - difficulty) / 173.7; `calibrated`: a logistic in that gap; `levels`:
    all log odds and the rating; `network`: a small network over the same.
    """
    y = F.col("found").cast("double")
    both = lambda df: df.withColumns({"label": y, "gap": (F.col("rating") - F.col("difficulty")) / 173.7})
    train, test = both(train), both(test)
    overall = train.agg(F.avg("label").alias("_all"))
    rates = train.groupBy("category").agg(F.avg("label").alias("_rate"))
    keep = test.columns
    parts = [
        test.join(rates, "category", "left").crossJoin(F.broadcast(overall)).select(*keep, F.lit("category").alias("model"), F.coalesce("_rate", "_all").alias("p")),
        test.select(*keep, F.lit("gap").alias("model"), sigmoid(F.col("gap")).alias("p")),
    ]
    for name, columns in (("rating", ["rating"]), ("calibrated", ["gap"]), ("levels", [*levels, "rating"]), ("network", [*levels, "rating"])):
        if name == "network":
            model = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[len(columns), 8, 2], maxIter=30, seed=seed)
        else:
            model = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.001, maxIter=50)
        stages = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), model]
        done = Pipeline(stages=stages).fit(train).transform(test)
        parts.append(done.select(*keep, F.lit(name).alias("model"), vector_to_array("probability")[1].alias("p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _bins(train: DataFrame, features: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    """What adds the bins _x0, _x1, ... of the features to a table: the value itself where train has fewer than BINS, else the place among BINS quantiles of train."""
    x = [F.col(c).cast("double") for c in features]
    cuts = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    seen = train.agg(*[y for i, c in enumerate(x) for y in (F.approx_count_distinct(c, 0.02).alias(f"n{i}"), F.percentile_approx(c, cuts, 1_000).alias(f"q{i}"))]).first()
    many = [i for i in range(len(x)) if seen[f"n{i}"] >= BINS]
    place = Bucketizer(inputCols=[f"_v{i}" for i in many], outputCols=[f"_x{i}" for i in many], splitsArray=[[-math.inf, *sorted(set(seen[f"q{i}"])), math.inf] for i in many]) if many else None

    def add(df: DataFrame) -> DataFrame:
        out = df.withColumns({f"_v{i}" if i in many else f"_x{i}": c for i, c in enumerate(x)})
        return place.transform(out).drop(*(f"_v{i}" for i in many)) if place else out

    return add


def bags(cells: DataFrame, keys: tuple[str, ...], n: str, trees: int, seed: int) -> DataFrame:
    """Adds _bag: how often each tree's bag takes the n rows of a cell. One row is taken as often as a Poisson draw of mean 1 says, so n rows as often as one of mean n. The draws follow from the keys, wherever the cell lies."""

    def draw(at: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(h) & (2**64 - 1)]).poisson(m, trees) for h, m in zip(at, rows)])

    return cells.withColumn("_bag", F.pandas_udf(draw, "array<bigint>")(F.xxhash64(*keys), F.col(n)))


def tactic_classifier(train: DataFrame, test: DataFrame, features: tuple[str, ...], label: str = "category", rating: str = "rating", seed: int = 7, trees: int = 20) -> DataFrame:
    """Adds predicted, confidence and predicted_rating to test: a forest over the categories that train has, and a boosted regression of the rating.

    Trees see no more of a feature than its bin. So rows with equal bins are one cell with a weight: it is fitted and predicted once, and rows are only read to be put into cells. A tree of the forest is fitted to its own bag of each cell's rows.
    The regression is fitted to the cells' means: rows of a cell are never parted, so gains and leaves are those of the rows.
    """
    store, add, keys = Store(train.sparkSession), _bins(train, features), [f"_x{i}" for i in range(len(features))]
    total = F.sum(F.coalesce(F.col(rating).cast("double"), F.lit(math.nan)))  # a missing rating is an error in the fit
    cells = add(train).groupBy(*keys, label).agg(F.count("*").alias("_n"), total.alias("_total"))
    cells, _, _ = store.few(bags(cells, (*keys, label), "_n", trees, seed))
    asked, _, n_asked = store.few(add(test).select(*keys).distinct())
    assemble = VectorAssembler(inputCols=keys, outputCol="features")
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip", stringOrderType="alphabetAsc").fit(cells)
    bagged, done = assemble.transform(index.transform(cells)), assemble.transform(asked)

    def fit(t: int) -> RandomForestClassificationModel:
        tree = RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", featuresCol="features", labelCol="_label", weightCol="_weight", maxDepth=8, seed=seed + t, probabilityCol=f"_p{t}")
        return tree.fit(bagged.withColumn("_weight", F.col("_bag")[t].cast("double")).where("_weight > 0"))

    # Cells are few, so that a fit is mostly waiting: some go side by side.
    with ThreadPool(4) as pool:
        forest = pool.map(inheritable_thread_target(train.sparkSession)(fit), range(trees))
    for tree in forest:
        done = tree.transform(done).drop("prediction", "rawPrediction")
    votes = [vector_to_array(f"_p{t}") for t in range(trees)]
    rated, _, _ = store.few(cells.groupBy(*keys).agg((F.sum("_total") / F.sum("_n")).alias("_rating"), F.sum("_n").cast("double").alias("_weight")))
    head = GBTRegressor(featuresCol="features", labelCol="_rating", weightCol="_weight", maxIter=10, seed=seed, predictionCol="predicted_rating").fit(assemble.transform(rated))
    done = head.transform(done).withColumn("_votes", reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), votes))
    best = F.array_position("_votes", F.array_max("_votes")).cast("int")
    found, _ = store.put(done.select(*keys, F.element_at(F.array(*map(F.lit, index.labels)), best).alias("predicted"), (F.array_max("_votes") / trees).alias("confidence"), "predicted_rating"))
    return add(test).join(F.broadcast(found) if n_asked <= MOST_CELLS else found, keys).select(*test.columns, "predicted", "confidence", "predicted_rating")

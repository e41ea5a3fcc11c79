"""Scoring rules, calibration and agreement, from tables of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def proper_scores(df: DataFrame, keys: tuple[str, ...], y: str = "y", p: str = "p", clip: float = 1e-6) -> DataFrame:
    """Log loss, Brier score and mean prediction of each group."""
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    t = F.col(y).cast("double")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("log_loss"), F.avg((F.col(p) - t) ** 2).alias("brier"), F.avg(p).alias("mean_p"))


#: Ranges that values are cut into before anything is summed in order.
RANGES = 128


def running(df: DataFrame, keys: tuple[str, ...], order: str, sums: dict[str, str], ranges: int = RANGES, descending: bool = False) -> DataFrame:
    """Adds, for each name: column of `sums`, the column's sum over the rows of the same keys that come before by `order`, whose values differ.

    Values are cut into ranges at their quantiles, ranges are summed, and only rows of one range are ordered together, so that no task gets all rows of a key.
    """
    probabilities = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = df.agg(F.array_sort(F.array_distinct(F.percentile_approx(F.col(order).cast("double"), probabilities, 10 * ranges))).alias("_bounds"))
    rows = df.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col(order)))).drop("_bounds")
    first = F.desc if descending else F.asc
    whole = rows.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    of_key = Window.partitionBy(*keys).orderBy(first("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*keys, "_range", *[F.coalesce(F.sum(f"_{n}").over(of_key), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(first(order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(whole, [*keys, "_range"])
    return rows.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def roc_auc(df: DataFrame, keys: tuple[str, ...], y: str = "y", p: str = "p") -> DataFrame:
    """Area under the ROC curve with half a win for ties; null where a group has one class. Rows are summed by score before anything is ordered."""
    t = F.col(y).cast("double")
    by = df.groupBy(*keys, p).agg(F.sum(t).alias("pos"), F.sum(1 - t).alias("neg"))
    by = running(by, keys, p, {"neg_below": "neg"})
    return by.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def average_precision(df: DataFrame, keys: tuple[str, ...], y: str = "y", p: str = "p", least: int = 1) -> DataFrame:
    """(keys, positives, ap) of groups with `least` positives: the mean precision at the positives, ties together."""
    by = df.groupBy(*keys, p).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count("*").alias("n"))
    by = running(by, keys, p, {"tp": "pos", "k": "n"}, descending=True)
    at = (F.col("tp") + F.col("pos")) / (F.col("k") + F.col("n"))
    return by.groupBy(*keys).agg(F.sum("pos").cast("long").alias("positives"), (F.sum(F.col("pos") * at) / F.sum("pos")).alias("ap")).where(F.col("positives") >= least)


def multilabel(df: DataFrame, label: str, y: str = "y", p: str = "p", least: int = 20, clip: float = 1e-6) -> DataFrame:
    """One row from (row, label, y, p): cross entropy summed over labels, micro-F1 at one half, and the mean average precision of labels with `least` positives."""
    q, t, said = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip)), F.col(y).cast("double"), F.col(p) >= 0.5
    by = df.groupBy(label).agg(F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("bce"), F.sum(F.when(said, t).otherwise(0.0)).alias("tp"), F.count_if(said).alias("said"), F.sum(t).alias("true"))
    ap = average_precision(df, (label,), y, p, least)
    sums = by.agg(F.sum("bce").alias("bce"), F.try_divide(2 * F.sum("tp"), F.sum("said") + F.sum("true")).alias("micro_f1"))
    return sums.crossJoin(F.broadcast(ap.agg(F.avg("ap").alias("macro_ap"), F.count("*").alias("labels"))))


def calibration_curve(df: DataFrame, keys: tuple[str, ...], y: str = "y", p: str = "p", bins: int = 5, least: int = 3) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate")).where(F.col("n") >= least)


def reliability(df: DataFrame, keys: tuple[str, ...], y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Bins (lo, hi] of the confidence; 0 is in none."""
    b = F.ceil(F.col(p) * bins).cast("int")
    return df.where(F.col(p) > 0).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def expected_calibration_error(df: DataFrame, keys: tuple[str, ...], y: str = "y", p: str = "p", bins: int = 15) -> DataFrame:
    total = df.groupBy(*keys).agg(F.count("*").alias("total"))
    bin_ = reliability(df, keys, y, p, bins)
    return bin_.join(total, list(keys)).groupBy(*keys).agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("ece"))


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    n = df.groupBy(true, pred).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(true)))


def agreement(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: n, share of equal labels and Cohen's kappa, from the table of counts."""
    cells = df.groupBy(true, pred).agg(F.count("*").alias("n"))
    long = cells.select(F.explode(F.array(F.struct(F.col(true).alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x")).select("x.*")
    chance = long.groupBy("label").agg((F.sum("t").cast("double") * F.sum("p")).alias("tp")).agg(F.sum("tp").alias("tp"))
    same = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0)).alias("same"))
    both = same.crossJoin(F.broadcast(chance))
    po, pe = F.col("same") / F.col("n"), F.col("tp") / (F.col("n").cast("double") * F.col("n"))
    return both.select("n", po.alias("accuracy"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def classification(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Recall, precision and F1 of each label; a label that isn't predicted, or isn't true anywhere, has 0."""
    cells = df.groupBy(true, pred).agg(F.count("*").alias("n"))
    a = cells.groupBy(F.col(true).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0)).alias("hit"))
    b = cells.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("predicted"))
    out = a.join(b, "label", "full").na.fill(0)
    ratio = lambda x, y: F.coalesce(F.try_divide(F.col(x), y), F.lit(0.0))
    return out.select("label", "support", "predicted", ratio("hit", F.col("support")).alias("recall"), ratio("hit", F.col("predicted")).alias("precision"), F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("support") + F.col("predicted")), F.lit(0.0)).alias("f1"))


def average_rank(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds <column>_rank: 1-based, ties averaged. Counts of values come first; only those are ordered."""
    n = running(df.groupBy(*keys, column).agg(F.count("*").alias("_n")), keys, column, {"_below": "_n"})
    n = n.select(*keys, column, (F.col("_below") + (F.col("_n") + 1) / 2).alias(f"{column}_rank"))
    return df.join(n, [*keys, column])


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r; null where either has no variance."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def regression(df: DataFrame, keys: tuple[str, ...], y: str = "y", mu: str = "mu") -> DataFrame:
    e = F.col(mu) - F.col(y)
    ranked = average_rank(average_rank(df, y, keys), mu, keys)
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count("*"))).alias("r2"),
        correlation(F.col(y), F.col(mu)).alias("pearson"), correlation(F.col(f"{y}_rank"), F.col(f"{mu}_rank")).alias("spearman"),
    )


def holm(df: DataFrame, family: str, p: str) -> DataFrame:
    """Adds `adjusted`: step-down p values of each family.

    Of equal p values the first in line counts, so all have one adjusted value; it follows from the distinct values and how many rows come before each.
    """
    n = running(df.groupBy(family, p).agg(F.count("*").alias("_n")), (family,), p, {"_before": "_n"})
    total = n.groupBy(family).agg(F.sum("_n").alias("_m"))
    n = n.join(total, family).withColumn("_raw", (F.col("_m") - F.col("_before")) * F.col(p))
    # The largest so far, by ranges: within each, and over those before.
    bounds = n.agg(F.array_sort(F.array_distinct(F.percentile_approx(F.col(p).cast("double"), F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), 10 * RANGES))).alias("_bounds"))
    n = n.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col(p)))).drop("_bounds")
    most = n.groupBy(family, "_range").agg(F.max("_raw").alias("_most"))
    most = most.select(family, "_range", F.max("_most").over(Window.partitionBy(family).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_most"))
    here = F.max("_raw").over(Window.partitionBy(family, "_range").orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("_here", here).join(most, [family, "_range"]).select(family, p, F.least(F.lit(1.0), F.greatest("_here", F.coalesce("_most", F.lit(0.0)))).alias("adjusted"))
    return df.join(n, [family, p])


def bootstrap(units: DataFrame, keys: tuple[str, ...], total: str, count: str, unit: str, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Point value and 95 % interval of sum(total) / sum(count) of each group, resampling units.

    Each unit (a row or a pre-summed group) gets a Poisson(1) weight in each replicate, drawn from a hash of unit and replicate; so replicates are sums
    that Spark reduces before the shuffle.
    """
    point = units.groupBy(*keys).agg(F.try_divide(F.sum(total), F.sum(count)).alias("value"), F.count("*").alias("units"))
    u = F.pmod(F.xxhash64(unit, "rep", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight, cumulative, mass = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):  # inverse of the Poisson distribution function
        cumulative += mass
        weight = weight + F.when(u >= cumulative, 1).otherwise(0)
        mass /= k + 1
    drawn = units.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", weight)
    stats = drawn.groupBy(*keys, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col(total)), F.sum(F.col("w") * F.col(count))).alias("x"))
    ci = stats.groupBy(*keys).agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))
    return point.join(ci, list(keys))


def bootstrap_difference(cells: DataFrame, unit: str, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Point value and 95 % interval of the difference of two predictors (b less a) in accuracy, kappa, macro recall and RMSE, resampling units.

    cells: a row for each unit (a group, or a row) and true and predicted label, with counts and squared errors of both predictors: true, label, n_a, n_b (rows of that true
    label that a, b give this label), se_a, se_b. What is resampled are those sums, so replicates are sums that Spark reduces before the shuffle.
    """
    u = F.pmod(F.xxhash64(unit, "rep", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight, cumulative, mass = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):  # inverse of the Poisson distribution function
        cumulative += mass
        weight = weight + F.when(u >= cumulative, 1).otherwise(0)
        mass /= k + 1
    # Replicate 0 is the data as they are.
    drawn = cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).withColumn("w", F.when(F.col("rep") == 0, 1).otherwise(weight))
    table = drawn.groupBy("rep", "true", "label").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n_a", "n_b", "se_a", "se_b")])
    parts = []
    for x in "ab":
        n = F.col(f"n_{x}")
        true = table.groupBy("rep", "true").agg(F.sum(n).alias("t"), F.sum(F.when(F.col("true") == F.col("label"), n).otherwise(0)).alias("hit"), F.sum(f"se_{x}").alias("se"))
        said = table.groupBy("rep", "label").agg(F.sum(n).alias("s"))
        both = true.join(said.withColumnRenamed("label", "true"), ["rep", "true"], "left").na.fill(0)
        s = both.groupBy("rep").agg(F.sum("t").alias("n"), F.sum("hit").alias("hit"), F.sum(F.col("t").cast("double") * F.col("s")).alias("chance"), F.avg(F.when(F.col("t") > 0, F.col("hit") / F.col("t"))).alias("macro_recall"), F.sum("se").alias("se"))
        po, pe = F.col("hit") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
        parts.append(s.select("rep", F.create_map(F.lit("accuracy"), po, F.lit("kappa"), F.try_divide(po - pe, 1 - pe), F.lit("macro_recall"), F.col("macro_recall"), F.lit("rmse"), F.sqrt(F.col("se") / F.col("n"))).alias(x)))
    both = parts[0].join(parts[1], "rep").select("rep", F.explode("a").alias("metric", "va"), F.col("b")).select("rep", "metric", (F.try_element_at("b", F.col("metric")) - F.col("va")).alias("d"))
    ci = both.where("rep > 0").groupBy("metric").agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
    return both.where("rep = 0").select("metric", F.col("d").alias("difference")).join(ci, "metric")


def selection_score(nll: Column | None = None, themes: Column | None = None, rating_nll: Column | None = None, theme_weight: float = 0.1) -> Column:
    """The loss that a checkpoint is chosen by: of the heads that were trained, category loss, a tenth of the themes' summed cross entropy, and the standardised rating's loss."""
    parts = [x for x in (nll, themes * theme_weight if themes is not None else None, rating_nll) if x is not None]
    if not parts:
        raise ValueError("no head was trained")
    return sum(parts[1:], parts[0])


def gaussian_nll(mu: Column, sd: Column, y: Column) -> Column:
    return 0.5 * F.log(2 * 3.141592653589793 * sd * sd) + (y - mu) ** 2 / (2 * sd * sd)


def within_group_rank(df: DataFrame, group: str, arm: str, predicted: str, observed: str, n: str, least: int = 3, arms: int = 4, top: int = 3) -> DataFrame:
    """One row from (group, arm, predicted, observed, n): over groups with `arms` arms of `least` rows each, the mean correlation of the two orders (ties by arm) and the mean share of the observed `top` among the predicted."""
    rows = df.where(F.col(n) >= least).withColumn("_k", F.count("*").over(Window.partitionBy(group))).where(F.col("_k") >= arms)
    place = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(F.desc(c), arm))
    rows = rows.withColumns({"_p": place(predicted), "_o": place(observed)})
    by = rows.groupBy(group).agg(correlation(F.col("_p"), F.col("_o")).alias("r"), (F.count_if((F.col("_p") <= top) & (F.col("_o") <= top)) / top).alias("hit"))
    return by.agg(F.count("*").alias("groups"), F.avg("r").alias("rank_correlation"), F.avg("hit").alias("top_recall"))

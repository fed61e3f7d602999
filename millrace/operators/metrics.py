"""Errors, accuracy, confusion tables, precision and recall, likelihoods: one aggregation each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .splits import value_rank


def rss(df: DataFrame, prediction: Column, actual: str) -> DataFrame:
    error = F.col(actual) - prediction
    return df.agg(F.sum(error * error).alias("rss"))


def accuracy(df: DataFrame, prediction: Column, label: str) -> DataFrame:
    return df.agg(F.avg((prediction == F.col(label)).cast("double")).alias("accuracy"))


def classification_error(df: DataFrame, prediction: Column, label: str) -> DataFrame:
    return accuracy(df, prediction, label).select((1 - F.col("accuracy")).alias("error"))


def majority_baseline(df: DataFrame, label: str, positive=1) -> DataFrame:
    return df.agg(F.avg((F.col(label) == positive).cast("double")).alias("baseline"))


def confusion(df: DataFrame, label: str, prediction: Column, classes: Sequence = (-1, 1)) -> DataFrame:
    """target_label, predicted_label, count for every pair of classes, those without rows too."""
    spark = df.sparkSession
    kind = df.schema[label].dataType
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], "target_label int, predicted_label int").select(F.col("target_label").cast(kind), F.col("predicted_label").cast(kind))
    counts = df.groupBy(F.col(label).alias("target_label"), prediction.cast(kind).alias("predicted_label")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["target_label", "predicted_label"], "left").select("target_label", "predicted_label", F.coalesce("n", F.lit(0)).alias("count"))


def precision_recall(df: DataFrame, label: str, prediction: Column, positive=1) -> DataFrame:
    """NULL where nothing is predicted positive, or nothing is."""
    said, true = (prediction == positive).cast("int"), (F.col(label) == positive).cast("int")
    return df.agg(F.try_divide(F.sum(said * true), F.sum(said)).alias("precision"), F.try_divide(F.sum(said * true), F.sum(true)).alias("recall"))


def _level(score: Column, ordered: Sequence[float], low: int, high: int) -> Column:
    """How many of the thresholds lie below the score, by bisection; 0 for null."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(score > F.lit(ordered[middle]), _level(score, ordered, middle + 1, high)).otherwise(_level(score, ordered, low, middle))


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float], positive=1) -> DataFrame:
    """threshold, precision, recall of score > threshold, for all thresholds from one pass.

    Rows are counted by the number of thresholds below them, found by bisection in one generated expression;
    suffix sums over that many counts give every threshold, so no row is multiplied. A score that is an
    expression is worked out once a row.
    """
    ordered = sorted(thresholds)
    spark = df.sparkSession
    # The value stands in an array of one element, so that the optimiser cannot copy its expression into every branch.
    level = F.transform(F.array(F.col(score).cast("double")), lambda s: _level(s, [float(t) for t in ordered], 0, len(ordered)))[0]
    true = (F.col(label) == positive).cast("bigint")
    counts = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("said"), F.sum(true).alias("hit"))
    grid = spark.createDataFrame([(i, float(t)) for i, t in enumerate(ordered, 1)], "level int, threshold double").unionByName(spark.createDataFrame([(0, None)], "level int, threshold double"))
    full = grid.join(counts, "level", "left").na.fill({"said": 0, "hit": 0})
    above = W.orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, 0)
    summed = full.withColumns({"said": F.sum("said").over(above), "hit": F.sum("hit").over(above), "all": F.sum("hit").over(W.partitionBy())})
    return summed.where("threshold is not null").select("threshold", F.try_divide("hit", "said").alias("precision"), F.try_divide("hit", "all").alias("recall"))


def log_likelihood(df: DataFrame, score: Column, label: str, positive=1, penalty: float = 0.0, average: bool = False) -> DataFrame:
    """Sum (or mean) of (1[y=+1] - 1) s - log(1 + exp(-s)), less a penalty known on the driver.

    log(1 + exp(-s)) is written so that no exponent overflows.
    """
    indicator = (F.col(label) == positive).cast("double")
    soft = F.when(score > 0, F.log1p(F.exp(-score))).otherwise(-score + F.log1p(F.exp(score)))
    total = F.sum((indicator - 1) * score - soft) - F.lit(float(penalty))
    return df.agg((total / F.count(F.lit(1)) if average else total).alias("log_likelihood"))


def histogram(df: DataFrame, value: Column, bins: int, density: bool = False) -> DataFrame:
    """bin (from 0), low, high and count (or density) over equal bins; the last one is closed. All bins are listed."""
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).first()
    if not ends["n"]:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, amount double")
    lo, hi = (ends["lo"], ends["hi"]) if ends["hi"] > ends["lo"] else (ends["lo"] - 0.5, ends["hi"] + 0.5)
    width = (hi - lo) / bins
    which = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = v.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    grid = df.sparkSession.createDataFrame([(i, lo + i * width, lo + (i + 1) * width if i < bins - 1 else hi) for i in range(bins)], "bin int, low double, high double")
    scale = 1 / (ends["n"] * width) if density else 1.0
    return grid.join(counts, "bin", "left").select("bin", "low", "high", (F.coalesce("c", F.lit(0.0)) * scale).alias("amount"))


#: Rows of one ordered history that a task averages at a time.
CHUNK_ROWS = 1 << 16


def moving_average(df: DataFrame, order: str, value: str, window: int, by: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """order and the mean of the last window values, from the first full window on.

    by splits the history into runs that are averaged apart, a run a task. Without it the rows are ranked and
    dealt in chunks, each with the window - 1 rows before it, so no task orders the whole history.
    """
    if by is None:
        size = max(chunk_rows, window)
        ranked = value_rank(df.select(order, value), [order], "__rank")
        chunk = F.expr(f"__rank div {size}")
        copies = ranked.withColumn("__chunk", F.explode(F.array_distinct(F.array(chunk, F.expr(f"(__rank + {window - 1}) div {size}")))))
        inside = W.partitionBy("__chunk").orderBy("__rank").rowsBetween(-(window - 1), 0)
        averaged = copies.withColumn("moving_average", F.avg(value).over(inside))
        return averaged.where((F.col("__chunk") == chunk) & (F.col("__rank") >= window - 1)).select(order, "moving_average")
    base = W.partitionBy(by).orderBy(order)
    full = df.withColumn("moving_average", F.avg(value).over(base.rowsBetween(-(window - 1), 0))).withColumn("__n", F.row_number().over(base))
    return full.where(F.col("__n") >= window).select(by, order, "moving_average")

"""Online learning: a Structured Streaming trainer that takes one ascent step for each micro-batch.

The state is the weight vector on the driver and, if a path is given, a Parquet table with one row a
batch, from which a restarted trainer goes on. A batch that is delivered again after a failure is
told by its number and not learned twice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logistic import _step


class OnlineLogistic:
    def __init__(self, spark: SparkSession, features: Column, label: str, dimension: int, step: float, penalty: float = 0.0, store: str | None = None):
        self.spark, self.features, self.label, self.step, self.penalty, self.store = spark, features, label, step, penalty, store
        self.weights, self.last, self.history = np.zeros(dimension), -1, []
        if store:
            self._resume()

    def _resume(self) -> None:
        try:
            rows = self.spark.read.parquet(self.store).orderBy(F.desc("batch_id")).limit(1).collect()
        except AnalysisException:
            return
        if rows:
            self.weights, self.last = np.array(rows[0]["weights"]), rows[0]["batch_id"]

    def learn(self, batch: DataFrame, batch_id: int) -> None:
        """One step on the mean gradient of a batch; for foreachBatch."""
        if batch_id <= self.last:
            return
        data = batch.select(F.transform(self.features, lambda v: v.cast("double")).alias("x"), F.col(self.label).cast("int").alias("y")).where("y is not null")
        g, _, ll, n = _step(data, self.weights[None, :])
        if n:
            pull = 2 * self.penalty * self.weights
            pull[0] = 0.0
            self.history.append((batch_id, float(ll[0]) / n))
            self.weights = self.weights + self.step / n * (g[0] - pull)
        self.last = batch_id
        if self.store:
            self.spark.createDataFrame([(batch_id, n, self.weights.tolist())], "batch_id bigint, n bigint, weights array<double>").write.mode("append").parquet(self.store)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Train on all that the stream has now, then return."""
        query = stream.writeStream.foreachBatch(self.learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def loss_curve(self) -> DataFrame:
        return self.spark.createDataFrame(self.history, "iteration bigint, log_likelihood double")


def replay(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, time: str, by: Sequence[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each event-time window and key; rows later than the watermark are dropped, windows are final once it passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"))

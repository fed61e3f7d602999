"""Nearest neighbours: brute force, regression on them, and random-hyperplane hashing for cosine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.distance import METRICS, cosine, dot
from ..session import scratch, stored
from .splits import value_rank

#: Queries that are compared with all items in one job: bounds what the driver and each task hold.
QUERY_BLOCK = 4096
#: Differences of components that are held at once.
_CELLS = 1 << 22


def distances_to(items: DataFrame, vector: str, query: Sequence[float], metric: str = "euclidean") -> DataFrame:
    """items with the distance of each row to one query vector."""
    return items.withColumn("distance", METRICS[metric](F.col(vector), F.lit([float(x) for x in query])))


def nearest_to(items: DataFrame, item_id: str, vector: str, query: Sequence[float], k: int, metric: str = "euclidean") -> DataFrame:
    """The k nearest rows to one query, ties by id: a top-k over partitions, no full sort."""
    return distances_to(items, vector, query, metric).orderBy("distance", item_id).limit(k)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _table(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each query (row) to each item (column)."""
    if metric == "cosine":
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.where(size > 0, 1 - q @ x.T / np.where(size > 0, size, 1), 1.0)
    out = np.empty((len(q), len(x)))
    rows = max(1, _CELLS // max(1, x.size))
    for i in range(0, len(q), rows):
        gap = q[i : i + rows, None, :] - x[None]
        out[i : i + rows] = np.abs(gap).sum(2) if metric == "manhattan" else (gap * gap).sum(2)
    return np.sqrt(out) if metric == "euclidean" else out


def _near(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int, metric: str, skip: bool) -> Iterator[pa.RecordBatch]:
    """The k least distances of each query among the items of each batch, ties by item."""
    for whole in batches:
        for i in range(0, whole.num_rows, 1024):
            batch = whole.slice(i, 1024)
            item = batch.column(0).to_numpy(zero_copy_only=False)
            d = _table(q, _rows(batch.column(1)), metric)
            if skip:
                d[ids[:, None] == item[None, :]] = np.inf
            # What is no farther than the kth, then in order: only those few are sorted.
            kth = np.partition(d, min(k, len(item)) - 1, axis=1)[:, min(k, len(item)) - 1]
            rows, cols = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
            order = np.lexsort((item[cols], d[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cols = rows[place < k], cols[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(item[cols]), pa.array(d[rows, cols])], ["q", "item", "distance"])


_FOUND = "q bigint, item bigint, distance double"


def k_nearest(queries: DataFrame, query_id: str, query_vector: str, items: DataFrame, item_id: str, item_vector: str, k: int, metric: str = "manhattan", skip_same_id: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, item_id, distance, rank (from 1) of the k nearest items of each query, ties by item_id.

    The queries are a stated set: block of them at most meet all items in one job, and every task passes on
    only k candidates a query and batch. The driver holds one block at a time; each block's candidates are
    written before the next one is read.
    """
    ready = lambda df, key, vector, name: df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(name), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    numbered = value_rank(ready(queries, query_id, query_vector, "q"), ["q"], "number")
    rows = stored(ready(items, item_id, item_vector, "item"), "items")
    spark, folder, total = rows.sparkSession, scratch(rows.sparkSession, "nearest"), numbered.count()
    for first in range(0, total, block):
        part = numbered.where((F.col("number") >= first) & (F.col("number") < first + block)).orderBy("number").select("q", "v").toArrow().combine_chunks()
        ids, q = part.column(0).to_numpy().astype(np.int64), _rows(part.column(1).combine_chunks())
        rows.mapInArrow(lambda it, ids=ids, q=q: _near(it, ids, q, k, metric, skip_same_id), _FOUND).write.mode("append").parquet(folder)
    every = spark.read.schema(_FOUND).parquet(folder) if total else spark.createDataFrame([], _FOUND)
    order = W.partitionBy("q").orderBy("distance", "item")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("item").alias("item_id"), "distance", "rank")


# ---------------------------------------------------------------- pivots

#: Pivots, and rows of a cell that one task holds.
PIVOTS, CELL_ROWS = 128, 4096
#: Metrics with a triangle inequality, which the pivots need.
_BOUNDED = ("manhattan", "euclidean")
_SLACK = 1e-9


def _celled(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, metric: str) -> Iterator[pa.RecordBatch]:
    """The nearest pivot of each item, and the distance to it."""
    for whole in batches:
        for i in range(0, whole.num_rows, 1024):
            batch = whole.slice(i, 1024)
            far = _table(_rows(batch.column("v")), pivots, metric)
            own = far.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], ["item", "v", "cell", "radius"])


def _visits(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, metric: str, low: np.ndarray, high: np.ndarray, slices: np.ndarray, near: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The slices that may hold one of the k nearest of each query, with its distance to the pivot and the bound of its kth neighbour.

    near has the k least radii of each cell: an item at radius r from a pivot is no farther than the pivot and r.
    """
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            batch = whole.slice(i, 256)
            far = _table(_rows(batch.column("v")), pivots, metric)
            most = (far[:, :, None] + near[None]).reshape(len(far), -1)
            bound = np.partition(most, min(k, most.shape[1]) - 1, axis=1)[:, min(k, most.shape[1]) - 1] if most.shape[1] >= k else np.full(len(far), np.inf)
            bound = bound * (1 + _SLACK) + _SLACK
            row, cell = np.nonzero((far - high <= bound[:, None]) & (low - far <= bound[:, None]) & (slices > 0))
            n = slices[cell]
            row, cell = np.repeat(row, n), np.repeat(cell, n)
            part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("q").take(at), batch.column("v").take(at), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(far[row, cell]), pa.array(bound[row])], ["q", "v", "cell", "part", "radius", "bound"])


_MET = ["q", "item", "distance", "looked"]


def _met(batches: Iterator[pa.RecordBatch], k: int, metric: str, skip: bool) -> Iterator[pa.RecordBatch]:
    """The k nearest items of each visit inside its slice; a slice's items come before its visits, in order of radius. A row without an item tells how many distances that took."""
    held, items = None, []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(c) for c in zip(*items, strict=True))

    ready: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for batch in batches:
        cell, part, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "visit"))
        names = np.stack([cell, part, kind])
        cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            own, rows = (int(cell[i]), int(part[i])), batch.slice(i, j - i)
            if own != held:
                held, items, ready = own, [], None
            ids, radius, v = (rows.column("id").to_numpy(zero_copy_only=False), rows.column("radius").to_numpy(zero_copy_only=False), _rows(rows.column("v")))
            if not kind[i]:
                items.append((ids, radius, v))
                continue
            if not items:
                continue
            ready = ready or block()
            item, from_pivot, x = ready
            bound = rows.column("bound").to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(from_pivot, radius - bound, "left"), np.searchsorted(from_pivot, radius + bound, "right")
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for n, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
                d = _table(v[n : n + 1], x[a:b], metric)[0]
                ok = d <= bound[n]
                if skip:
                    ok &= item[a:b] != ids[n]
                at = np.flatnonzero(ok)
                at = at[np.lexsort((item[a:b][at], d[at]))[:k]]
                out.append((np.full(len(at), ids[n]), item[a:b][at], d[at]))
            found = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found] + [pa.nulls(len(found[0]), pa.int64())], _MET)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.float64()), pa.array([int((last - first).sum())])], _MET)


def pivot_met(queries: DataFrame, query_id: str, query_vector: str, items: DataFrame, item_id: str, item_vector: str, k: int, metric: str = "manhattan", skip_same_id: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """The candidates of pivot_nearest: q, item, distance of the k nearest of every slice that a query visits, and rows with looked, how many distances were taken, whose sum is all of them."""
    if metric not in _BOUNDED:
        raise ValueError(f"{metric} has no triangle inequality")
    ready = lambda df, key, vector, name: df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(name), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = stored(ready(items, item_id, item_vector, "item"), "items")
    chosen = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    spark = rows.sparkSession
    if not chosen:
        return spark.createDataFrame([], "q bigint, item bigint, distance double, looked bigint")
    centres = np.array([r["v"] for r in chosen], float)
    celled = stored(rows.mapInArrow(lambda it: _celled(it, centres, metric), "item bigint, v array<double>, cell int, radius double"), "cells")
    # Rows of a query's own id are passed over, so the bound needs as many more.
    extra = (celled.groupBy("item").count().agg(F.max("count")).first()[0] or 0) if skip_same_id else 0
    need = k + extra
    order = W.partitionBy("cell").orderBy("radius")
    least = celled.select("cell", "radius").withColumn("place", F.row_number().over(order)).where(F.col("place") <= need).groupBy("cell").agg(F.sort_array(F.collect_list("radius")).alias("near"))
    told = celled.groupBy("cell").agg(F.min("radius").alias("low"), F.max("radius").alias("high"), F.count(F.lit(1)).alias("n")).join(least, "cell").collect()
    low, high, slices, near = np.full(len(centres), np.inf), np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64), np.full((len(centres), need), np.inf)
    for r in told:
        low[r["cell"]], high[r["cell"]], slices[r["cell"]] = r["low"], r["high"], -(-r["n"] // CELL_ROWS)
        near[r["cell"], : len(r["near"])] = r["near"]
    parts = F.lit(slices.tolist()).cast("array<int>")
    dealt = celled.select("cell", F.pmod(F.xxhash64("item", "v"), parts[F.col("cell")]).cast("int").alias("part"), F.lit(0).alias("visit"), F.col("item").alias("id"), "v", "radius", F.lit(0.0).alias("bound"))
    visits = ready(queries, query_id, query_vector, "q").mapInArrow(lambda it: _visits(it, centres, metric, low, high, slices, near, need), "q bigint, v array<double>, cell int, part int, radius double, bound double")
    both = dealt.unionByName(visits.select("cell", "part", F.lit(1).alias("visit"), F.col("q").alias("id"), "v", "radius", "bound"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "visit", "radius").mapInArrow(lambda it: _met(it, k, metric, skip_same_id), "q bigint, item bigint, distance double, looked bigint")


def pivot_nearest(queries: DataFrame, query_id: str, query_vector: str, items: DataFrame, item_id: str, item_vector: str, k: int, metric: str = "manhattan", skip_same_id: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """query_id, item_id, distance, rank (from 1): what k_nearest gives, for metrics with a triangle inequality, without comparing all with all.

    Items go to the cell of their nearest pivot. The radii of the cells bound the distance of each query's kth neighbour; a
    query visits only cells that reach into that ball, and inside a cell only the items whose radius does. Cells are cut
    into slices of about CELL_ROWS items, so a common cell is many tasks, and a task holds one slice while visits stream by.
    The pivots are a sample by hash: they decide how much is pruned, never what is found. The driver holds the
    pivots and k radii of each. Rows without an id or a vector take no part.
    """
    met = pivot_met(queries, query_id, query_vector, items, item_id, item_vector, k, metric, skip_same_id, pivots).where("item is not null")
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "item"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("item").alias("item_id"), "distance", "rank")


def _nearest(queries: DataFrame, query_id: str, query_vector: str, items: DataFrame, item_id: str, item_vector: str, k: int, metric: str) -> DataFrame:
    """By pivots where the metric allows it, else by comparing all with all."""
    find = pivot_nearest if metric in _BOUNDED else k_nearest
    return find(queries, query_id, query_vector, items, item_id, item_vector, k, metric).select(query_id, "item_id", "distance", "rank")


def knn_regression(queries: DataFrame, query_id: str, query_vector: str, items: DataFrame, item_id: str, item_vector: str, target: str, k: int, metric: str = "manhattan") -> DataFrame:
    """query_id and the mean target of its k nearest items."""
    near = _nearest(queries, query_id, query_vector, items, item_id, item_vector, k, metric)
    values = items.select(F.col(item_id).alias("item_id"), F.col(target).cast("double").alias("__y"))
    return near.join(values, "item_id").groupBy(query_id).agg(F.avg("__y").alias("prediction"))


def choose_k(valid: DataFrame, query_id: str, query_vector: str, actual: str, items: DataFrame, item_id: str, item_vector: str, target: str, most: int = 15, metric: str = "manhattan") -> DataFrame:
    """k and the validation RSS for k = 1..most: ranks are made once, prefix means serve every k."""
    near = _nearest(valid, query_id, query_vector, items, item_id, item_vector, most, metric)
    values = items.select(F.col(item_id).alias("item_id"), F.col(target).cast("double").alias("__y"))
    prefix = W.partitionBy(query_id).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    predicted = near.join(values, "item_id").withColumn("prediction", F.avg("__y").over(prefix))
    truth = valid.select(query_id, F.col(actual).cast("double").alias("__t"))
    error = F.col("__t") - F.col("prediction")
    return predicted.join(truth, query_id).groupBy(F.col("rank").alias("k")).agg(F.sum(error * error).alias("rss"))


# ---------------------------------------------------------------- hyperplanes

@dataclass(frozen=True)
class Hyperplanes:
    """Random directions, one a row, the first for the most significant bit."""

    vectors: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.vectors)

    @classmethod
    def random(cls, dimension: int, bits: int = 16, seed: int = 143) -> Hyperplanes:
        return cls(np.random.RandomState(seed).randn(dimension, bits).T)

    def code(self, vector: Column) -> Column:
        """Bits of the sides a vector lies on (on the plane counts as 1), as one number."""
        planes = F.lit([[float(x) for x in v] for v in self.vectors])
        return F.aggregate(planes, F.lit(0).cast("bigint"), lambda acc, p: acc * 2 + F.when(dot(vector, p) >= 0, 1).otherwise(0))

    def code_of(self, vector: Sequence[float]) -> int:
        out = 0
        for side in self.vectors @ np.asarray(vector, float) >= 0:
            out = out * 2 + int(side)
        return out


def hashed(items: DataFrame, vector: str, planes: Hyperplanes) -> DataFrame:
    """items with their code: the index, usable as it is, cached, or written partitioned by code."""
    return items.where(F.col(vector).isNotNull()).withColumn("code", planes.code(F.col(vector)))


def hamming(code: Column, other: int | Column) -> Column:
    return F.bit_count(code.bitwiseXOR(F.lit(other) if isinstance(other, int) else other))


def bins(index: DataFrame, item_id: str) -> DataFrame:
    """code and number of rows in it."""
    return index.groupBy("code").agg(F.count(item_id).alias("size"))


def probe(index: DataFrame, code: int, radius: int) -> DataFrame:
    """Rows whose code differs in at most radius bits; radius = bits gives all."""
    return index.where(hamming(F.col("code"), code) <= radius)


def probe_many(index: DataFrame, queries: DataFrame, bits: int, radius: int) -> DataFrame:
    """Pairs of queries (query_id, query_code) and rows within radius bits, as an equi-join.

    Each query is filed under every code within the radius, so no row meets a query that is farther.
    """
    masks = [0]
    for i in range(bits):
        masks += [m | 1 << i for m in masks if bin(m).count("1") < radius]
    flipped = queries.withColumn("code", F.explode(F.transform(F.lit(masks).cast("array<bigint>"), lambda m: m.bitwiseXOR(F.col("query_code")))))
    return index.join(flipped, "code")


def lsh_query(index: DataFrame, item_id: str, vector: str, planes: Hyperplanes, query: Sequence[float], k: int, radius: int) -> tuple[DataFrame, int]:
    """The k candidates of least cosine distance, and how many candidates there were."""
    found = probe(index, planes.code_of(query), radius)
    near = found.withColumn("distance", cosine(F.col(vector), F.lit([float(x) for x in query]))).orderBy("distance", item_id).limit(k)
    return near, found.count()


def radius_study(index: DataFrame, item_id: str, vector: str, planes: Hyperplanes, query: Sequence[float], k: int) -> DataFrame:
    """radius, candidates, and mean, least and greatest cosine distance of neighbours 2..k, from one scan.

    A candidate counts for its Hamming distance and every greater radius; only its k nearest
    of each Hamming distance can be among the k nearest of a radius.
    """
    target = F.lit([float(x) for x in query])
    scored = index.select(item_id, cosine(F.col(vector), target).alias("distance"), hamming(F.col("code"), planes.code_of(query)).alias("h"))
    radii = index.sparkSession.range(planes.bits + 1).select(F.col("id").cast("int").alias("radius"))
    counts = scored.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("distance", item_id))).where(F.col("r") <= k).drop("r")
    # Both tables are bounded: at most bits + 1 counts, and k rows for each Hamming distance.
    within = radii.join(F.broadcast(counts), F.col("h") <= F.col("radius"), "left").groupBy("radius").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))
    ranked = radii.join(F.broadcast(best), F.col("h") <= F.col("radius")).withColumn("rank", F.row_number().over(W.partitionBy("radius").orderBy("distance", item_id)))
    stats = ranked.where((F.col("rank") > 1) & (F.col("rank") <= k)).groupBy("radius").agg(F.avg("distance").alias("mean_distance"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))
    return within.join(stats, "radius", "left")

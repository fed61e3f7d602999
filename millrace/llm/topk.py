"""Exact top-k search by distributed histogram selection.

The quantised vectors are written once, each row with a number of its own. Every candidate is scored
against every query of a block by one integer matrix product. No score of a query lies beyond the product of
its length and the greatest length; that range is cut into bins. Tasks count their scores from the top bin
down, only as far as k of their own, and the summed counts show the bin with the global kth score. That bin
is cut again until it is one score wide. A last pass keeps what lies above the kth score, and of those that
equal it the least ids that are still needed.

The queries are a stated set, judged against all rows block by block: a block of QUERY_BLOCK vectors at most
is what the driver and each task hold, whatever the number of queries. A block's winners are written before
the next block begins.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part; vectors
of unequal length are compared as if the shorter ended in zeros. Equal scores go to the smaller id. With
fewer than k candidates all are returned. Rows of one id are queries and candidates each, and a query only
does not meet its own row, so an id that several query rows share has the rows of each in the result. Scores
beyond 62 bits are not supported. An empty table gives no rows. Columns of the input other than the id and
the vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.splits import value_rank
from .common import scratch, stored

QUERY_BLOCK = 4096
BINS = 512
#: Candidates scored at once.
ROWS = 512
#: Doubles hold integers up to here; larger products are summed as 64-bit integers.
EXACT = 1 << 53

_LEAST = -(1 << 63)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of integers, padded with zeros to the longest."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    width = max(int(lengths.max(initial=0)), width or 0)
    out = np.zeros((len(lengths), width), np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    at = np.arange(len(flat)) - np.repeat(offsets[:-1], lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    return out


class Block:
    """Queries of one block, in order of their rows, sent to each task."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows, self.vectors = ids, rows, vectors
        self.peak = int(np.abs(vectors).max(initial=0))

    def scores(self, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """One row for each query, one column for each candidate; _LEAST where both are one row of the table."""
        width = max(rows.shape[1], self.vectors.shape[1])
        q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (self.vectors, rows))
        if self.peak * int(np.abs(c).max(initial=0)) * max(width, 1) < EXACT:
            out = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
        else:
            out = q @ c.T
        at = np.minimum(np.searchsorted(self.rows, own), len(self.rows) - 1)
        same = np.flatnonzero(self.rows[at] == own)
        out[at[same], same] = _LEAST
        return out


def _scored(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            ids, own = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            yield ids, block.scores(own, _matrix(part.column("v")))


def _histogram(batches: Iterator[pa.RecordBatch], block: Block, low: np.ndarray, span: np.ndarray, width: np.ndarray, need: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of each query's bins over [low, low + span) from the top down, as far as need of this task's own scores."""
    n = len(block.ids)
    counts = np.zeros((n, BINS + 1), np.int64)
    for _, scores in _scored(batches, block):
        bins = np.clip((scores - low[:, None]) // width[:, None], -1, BINS - 1)
        inside = (scores >= low[:, None]) & (scores < (low + span)[:, None]) & (need[:, None] > 0) & (scores != _LEAST)
        q, _ = np.nonzero(inside)
        counts += np.bincount(q * (BINS + 1) + bins[inside], minlength=counts.size).reshape(counts.shape)
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    q, b = np.nonzero((counts > 0) & (above < need[:, None]))
    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], ["q", "bin", "n"])


def _winners(batches: Iterator[pa.RecordBatch], block: Block, kth: np.ndarray, ties: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All scores above the kth, and of each batch's equal ones no more than are needed, by least id."""
    for ids, scores in _scored(batches, block):
        q, c = np.nonzero((scores >= kth[:, None]) & (scores != _LEAST))
        found = scores[q, c]
        order = np.lexsort((ids[c], -found, q))
        q, c, found = q[order], c[order], found[order]
        tied = found == kth[q]
        running = np.cumsum(tied)
        first = np.searchsorted(q, np.arange(len(block.ids)))
        before = np.concatenate(([0], running))[first]
        keep = ~tied | (running - before[q] <= ties[q])
        yield pa.RecordBatch.from_arrays([pa.array(block.rows[q[keep]]), pa.array(block.ids[q[keep]]), pa.array(ids[c[keep]]), pa.array(found[keep])], ["query_row", "query_id", "vec_id", "score"])


def _collected(df: DataFrame, n: int, names: tuple[str, ...]) -> list[np.ndarray]:
    rows = df.toPandas()
    out = [np.zeros(n, np.int64) for _ in names]
    for values, name in zip(out, names, strict=True):
        values[rows["q"].to_numpy(np.int64)] = rows[name].to_numpy(np.int64)
    return out


def _block_top(rows: DataFrame, block: Block, k: int, candidates: int, longest: float) -> DataFrame:
    """query_row, query_id, vec_id, score of the k best of each query, and of some more that equal the kth."""
    n = len(block.ids)
    bound = np.minimum(np.ceil(np.sqrt((block.vectors.astype(float) ** 2).sum(1)) * longest * (1 + 1e-9)) + 1, float(1 << 62) - 1024).astype(np.int64)
    # need: how many of the k lie in the range that is still cut; low becomes the kth score.
    low, span, need = -bound, 2 * bound + 1, np.full(n, min(candidates, k), np.int64)
    width = np.maximum(-(-span // BINS), 1)
    while (need > 0).any():
        args = block, low.copy(), span.copy(), width.copy(), need.copy()
        counts = rows.mapInArrow(lambda it, args=args: _histogram(it, *args), "q bigint, bin bigint, n bigint")
        over = W.partitionBy("q").orderBy(F.desc("bin"))
        ranked = counts.groupBy("q", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(over))
        goal = F.element_at(F.lit(need.tolist()), (F.col("q") + 1).cast("int"))
        hit = ranked.where((F.col("upto") >= goal) & (F.col("upto") - F.col("n") < goal)).withColumn("above", F.col("upto") - F.col("n"))
        bins, above = _collected(hit, n, ("bin", "above"))
        low_before, low_span = low, span
        low, need = low + np.where(need > 0, bins, 0) * width, need - above
        if (width == 1).all():
            break
        span = np.minimum(width, low_span - (low - low_before))
        width = np.maximum(-(-span // BINS), 1)
    kth = low if candidates else np.full(n, np.iinfo(np.int64).max)
    return rows.mapInArrow(lambda it: _winners(it, block, kth, need), _WINNERS)


_WINNERS = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def top_k(vectors: DataFrame, is_query: Column | str, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query, exactly.

    is_query is a condition on the column id.
    """
    usable_rows = vectors.where(usable(F.col(vector)) & F.col(id_column).isNotNull())
    rows = stored(usable_rows.select(F.col(id_column).cast("bigint").alias("id"), quantised(F.col(vector), scale).alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("longest")).first()
    queries = value_rank(rows.where(is_query), ["row"], "number")
    folder, spark = scratch(rows.sparkSession, "winners"), rows.sparkSession
    for first in range(0, queries.count(), query_block):
        own = queries.where((F.col("number") >= first) & (F.col("number") < first + query_block)).orderBy("number").select("id", "row", "v").toArrow()
        block = Block(own.column("id").to_numpy(), own.column("row").to_numpy(), _matrix(own.column("v").combine_chunks()))
        _block_top(rows, block, k, known["n"] - 1, known["longest"]).write.mode("append").parquet(folder)
    if not known["n"] or queries.isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    best = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = spark.read.schema(_WINNERS).parquet(folder).withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Logistic regression on sparse text: a learned vocabulary, L-BFGS, and gradients added on the executors.

Terms are numbered by one range exchange, and rows are written once as blocks of bytes, the numbers and the values of
their terms. A pass sends the weights to the executors (8 bytes a term, checked against a bound), and every task
returns its part of the gradient in pieces of PIECE terms, which are added on the executors. L-BFGS keeps
2 * MEMORY vectors of that size on the driver; nothing there grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_ids
from ..session import in_tasks, stored
from .reduce import collected, task_number, tasks_of

#: Terms of one piece of a gradient.
PIECE = 1 << 16
#: Terms up to which weights are sent: 8 bytes each, and 2 * MEMORY + 4 vectors on the driver. A larger vocabulary is to be cut first.
MOST_TERMS = 1 << 24
#: Steps that L-BFGS remembers.
MEMORY = 10
#: Rows and entries that a task of a pass reads at least, if there are as many.
TASK_ENTRIES = 1 << 20


@dataclass
class SparseModel:
    """vocabulary (term, term_id), a weight for each term_id, and the intercept."""

    vocabulary: DataFrame
    weights: np.ndarray
    intercept: float
    objective: float
    #: The objective after each accepted step.
    history: list[float] = field(default_factory=list)

    def table(self) -> DataFrame:
        """term and weight."""
        spark = self.vocabulary.sparkSession
        rows = pa.table({"term_id": pa.array(np.arange(len(self.weights))), "weight": pa.array(self.weights)})
        return self.vocabulary.join(spark.createDataFrame(rows, "term_id bigint, weight double"), "term_id").select("term", "weight")

    def score(self, bag: DataFrame, doc_id: str, value: str = "value") -> DataFrame:
        """doc_id and score of the rows of a long table; terms that the vocabulary lacks are passed over."""
        met = bag.select(doc_id, "term", value).join(self.table(), "term", "left")
        return met.groupBy(doc_id).agg((F.coalesce(F.sum(F.col(value) * F.col("weight")), F.lit(0.0)) + F.lit(self.intercept)).alias("score"))


def vocabulary_of(bag: DataFrame, least_rows: int = 1) -> DataFrame:
    """term and term_id (in alphabetical order, from 0) of the terms that least_rows rows have at least."""
    frequent = bag.groupBy("term").agg(F.count(F.lit(1)).alias("tf")).where(F.col("tf") >= least_rows)
    return term_ids(frequent.where(F.col("term").isNotNull()))


def sparse_rows(bag: DataFrame, doc_id: str, labels: DataFrame, label: str, vocabulary: DataFrame, value: str = "value") -> DataFrame:
    """y (+1 or -1), ids, vals of each labelled row, those without a term of the vocabulary too. An entry is bounded by the terms of a row."""
    known = bag.join(vocabulary, "term").groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct(F.col("term_id").cast("int").alias("i"), F.col(value).cast("double").alias("v")))).alias("e"))
    y = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(doc_id, F.col(label).cast("int").alias("y"))
    both = y.join(known, doc_id, "left")
    return both.select("y", F.coalesce("e.i", F.array().cast("array<int>")).alias("ids"), F.coalesce("e.v", F.array().cast("array<double>")).alias("vals"))


#: Columns of a block of rows, as bytes: labels, sizes of the rows, and the numbers and values of all their terms.
_BLOCK = {"y": np.float64, "sizes": np.int32, "ids": np.int32, "vals": np.float64}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            lists = batch.column("ids")
            columns = batch.column("y"), lists.value_lengths(), lists.flatten(), batch.column("vals").flatten()
            made = [v.to_numpy(zero_copy_only=False).astype(t) for v, t in zip(columns, _BLOCK.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows + len(made[2])], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in made)], ["n", *_BLOCK])


def packed(rows: DataFrame) -> DataFrame:
    """The rows of sparse_rows as written blocks, read by as many tasks as their entries are worth: a pass copies bytes to Python."""
    made = stored(rows.mapInArrow(_blocks, "n bigint, " + ", ".join(f"{c} binary" for c in _BLOCK)), "rows")
    return in_tasks(made, -(-(made.agg(F.sum("n")).first()[0] or 0) // TASK_ENTRIES))


def _losses(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The gradient and the loss of a task's rows at w, whose last entry is the intercept. The rows' products come from one flat sum over all terms."""
    grad, loss, rows = np.zeros(len(w)), 0.0, 0
    for block in (b for batch in batches for b in batch.to_pylist()):
        y, sizes, ids, vals = (np.frombuffer(block[c], t) for c, t in _BLOCK.items())
        row = np.repeat(np.arange(len(y)), sizes)
        margin = y * (np.bincount(row, vals * w[ids], len(y)) + w[-1])
        loss += float(np.logaddexp(0, -margin).sum())
        pull = -y * np.exp(-np.logaddexp(0, margin))
        grad += np.bincount(ids, vals * pull[row], len(w))
        grad[-1] += pull.sum()
        rows += len(y)
    at = [*range(0, len(grad), PIECE)]
    told = [grad[i : i + PIECE] for i in at] + [np.array([loss, rows])]
    yield pa.RecordBatch.from_arrays([pa.array([*range(len(at)), -1], pa.int32()), pa.array([task_number()] * len(told), pa.int32()), pa.array(told, pa.list_(pa.float64()))], ["piece", "part", "sums"])


class Objective:
    """|w|^2 / 2 + strength * sum of log(1 + exp(-y s)), the intercept penalised too: value and gradient by one pass over packed rows."""

    def __init__(self, rows: DataFrame, terms: int, strength: float):
        if terms > MOST_TERMS:
            raise ValueError(f"{terms} terms; cut the vocabulary to {MOST_TERMS} (least_rows)")
        self.rows, self.size, self.strength, self.tasks, self.passes = rows, terms + 1, strength, tasks_of(rows), 0

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        self.passes += 1
        sent = self.rows.sparkSession.sparkContext.broadcast(w)
        made = self.rows.mapInArrow(lambda it: _losses(it, sent.value), "piece int, part int, sums array<double>")
        found = collected(made, ("piece",), ("sums",), self.tasks, self.size)
        sent.destroy()
        loss = found.pop((-1,), [np.zeros(2)])[0][0]
        grad = np.concatenate([found[k][0] for k in sorted(found)]) if found else np.zeros(self.size)
        return float(w @ w / 2 + self.strength * loss), w + self.strength * grad


def lbfgs(objective, start: np.ndarray, max_iter: int = 200, tolerance: float = 1e-6, memory: int = MEMORY) -> tuple[np.ndarray, list[float]]:
    """The minimum of a convex objective, from value and gradient: two-loop recursion, steps by backtracking.

    It ends when no component of the gradient is above tolerance times that of the start, or nothing improves.
    """
    x = start.copy()
    value, grad = objective(x)
    first, history = float(np.abs(grad).max(initial=0)), [value]
    steps: list[np.ndarray] = []
    turns: list[np.ndarray] = []
    for _ in range(max_iter):
        if float(np.abs(grad).max(initial=0)) <= tolerance * max(first, 1e-300):
            break
        way, parts = grad.copy(), []
        for s, t in zip(reversed(steps), reversed(turns), strict=True):
            a = (s @ way) / (s @ t)
            parts.append(a)
            way -= a * t
        way *= (steps[-1] @ turns[-1]) / (turns[-1] @ turns[-1]) if steps else 1.0 / max(float(np.linalg.norm(grad)), 1.0)
        for s, t, a in zip(steps, turns, reversed(parts), strict=True):
            way += (a - (t @ way) / (s @ t)) * s
        slope, length = -float(grad @ way), 1.0
        while True:
            new = x - length * way
            found, after = objective(new)
            if found <= value + 1e-4 * length * slope or length < 1e-10:
                break
            # The least of the parabola through both values and the slope, within bounds.
            bend = found - value - length * slope
            length = float(np.clip(-slope * length * length / (2 * bend), 0.1 * length, 0.5 * length)) if np.isfinite(bend) and bend > 0 else length / 10
        if not found < value:
            break
        s, t = new - x, after - grad
        if s @ t > 1e-12 * (t @ t):
            steps, turns = [*steps, s][-memory:], [*turns, t][-memory:]
        x, value, grad = new, found, after
        history.append(value)
    return x, history


def fit(bag: DataFrame, doc_id: str, labels: DataFrame, label: str, strength: float = 1.0, least_rows: int = 1, value: str = "value", max_iter: int = 200, tolerance: float = 1e-6) -> SparseModel:
    """The library form of logistic regression on a long table (doc_id, term, value) and labels (doc_id, +1 or -1).

    The vocabulary is that of the labelled rows. Rows of several labels count once for each. Rows without a term
    count by the intercept alone; rows without a label are left out.
    """
    own = bag.join(labels.where(F.col(label).isNotNull()).select(doc_id).distinct(), doc_id, "left_semi")
    vocabulary = stored(vocabulary_of(own, least_rows), "vocabulary")
    # The numbers run from 0 without a gap.
    terms = vocabulary.count()
    rows = packed(sparse_rows(own, doc_id, labels, label, vocabulary, value))
    w, history = lbfgs(Objective(rows, terms, strength), np.zeros(terms + 1), max_iter, tolerance)
    return SparseModel(vocabulary, w[:-1], float(w[-1]), history[-1], history)

"""Whitening of embeddings by a matrix-free block Lanczos method.

Every component of a vector becomes an integer, so means and deviations are exact. The principal components
are fitted on the distinct vectors. The covariance is never built: each step multiplies it with a block of
vectors in one pass, X'(Xv) over the centred rows of every task, and the blocks of the tasks are added on the
executors. Each new block is made orthogonal to all earlier ones, twice. The Ritz pairs of the basis are accepted
when their true residuals are at the level of rounding. Where a block breaks down, because the basis has closed
on an invariant subspace, a random one takes its place, so that no component is missed. The trace follows from the
exact deviations and gives the explained shares.

The driver holds the basis: `dimension` numbers for each of its vectors, of which there are `dimension` at most. Nothing there
grows with the rows.

Defined results: a vector that is null or empty, holds a null or non-finite component, or one whose integer does not
fit 62 bits takes no part. Where vectors differ in length, those of the most common length count (of equals the
shortest). Null ids, repeated ids and repeated rows come back as often as they are there; repeated vectors count
once in the fit. A deviation beyond 64 bits is null. Components whose eigenvalue is below RANK of the first are not
told from zero and left out, so constant columns, or fewer rows than components, give fewer components, and one
distinct vector or an empty table gives no rows. Columns of the input other than the id and the vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reduce import collected, task_number, tasks_of
from .common import stored
from .topk import usable

#: Share of the greatest eigenvalue below which one counts as zero: doubles do not tell them apart.
RANK = 1e-11
#: Residual of an accepted pair, as a share of the greatest eigenvalue.
RESIDUAL = 1e-14
#: Rows multiplied at once.
ROWS = 4096
_LIMIT = 1 << 62
_LOW = (1 << 32) - 1


def integers(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * x) + offset of each component as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")) + F.lit(offset).cast("bigint"))


def _fitting(vector: Column, scale: int, offset: int) -> Column:
    small = lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < float(_LIMIT - abs(offset))
    # One after the other: what is not finite is never turned into an integer.
    return F.when(usable(vector), (F.size(vector) > 0) & F.forall(vector, small)).otherwise(False)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _partial(kind: pa.DataType, **sums) -> pa.RecordBatch:
    """The arrays of a task in one row, with its number."""
    schema = pa.schema([("part", pa.int32()), *((c, pa.list_(kind)) for c in sums)])
    return pa.RecordBatch.from_pydict({"part": [task_number()], **{c: [v] for c, v in sums.items()}}, schema=schema)


def _counted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows, bits of the greatest size and the sums of a task; sums in two halves of 32 bits, so that they are exact."""
    n, peak, high, low = 0, 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
    for part, x in _rows(batches):
        n, peak = n + len(x), max(peak, int(np.abs(x).max()))
        high += (x >> 32).sum(0)
        low += (x & _LOW).sum(0)
    bits = np.zeros(64, np.int64)
    bits[peak.bit_length()] = 1
    yield _partial(pa.int64(), n=[n], bits=bits, high=high, low=low)


@dataclass(frozen=True)
class Centre:
    """What it takes to centre an integer vector exactly: n rows of the fit with the sums s."""

    n: int
    sums: tuple[int, ...]
    #: No component of the fit is greater in size.
    peak: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - s; Python integers where 64 bits might not hold it."""
        if self.n * max(self.peak, int(np.abs(x).max(initial=0))) < _LIMIT:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def squares(self, x: np.ndarray) -> list[int]:
        """Exact sums of the squared deviations of each row."""
        d = self.deviations(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= _LIMIT:
            d = d.astype(object)
        return (d * d).sum(1).tolist()


def _product(batches: Iterator[pa.RecordBatch], centre: Centre, block: np.ndarray, with_trace: bool) -> Iterator[pa.RecordBatch]:
    """X'(X block) and the sum of squares of a task's centred rows."""
    out, trace = np.zeros_like(block), 0.0
    for part, x in _rows(batches):
        y = centre.centred(x)
        out += y.T @ (y @ block)
        if with_trace:
            trace += float(sum(centre.squares(x))) / centre.n / centre.n
    yield _partial(pa.float64(), out=out.ravel(), trace=[trace])


def _outer(batches: Iterator[pa.RecordBatch], centre: Centre, whitener: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums and products of the whitened rows of a task."""
    k = whitener.shape[1]
    sums, products = np.zeros(k), np.zeros((k, k))
    for part, x in _rows(batches):
        w = centre.centred(x) @ whitener
        sums += w.sum(0)
        products += w.T @ w
    yield _partial(pa.float64(), sums=sums, products=products.ravel())


# ---------------------------------------------------------------- the eigenvectors

def _against(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What of a block lies outside the basis; twice, as rounding leaves a rest after once."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def _independent(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal columns that span the part of a block outside the basis, without directions no longer than least."""
    rest = _against(block, basis)
    u, size, _ = np.linalg.svd(rest, full_matrices=False)
    u = u[:, size > least]
    if not u.shape[1]:
        return u
    # Short directions carry rounding along the basis: once more against it, then orthonormal again.
    return np.linalg.qr(_against(u, basis))[0]


def leading_pairs(multiply: Callable[[np.ndarray], np.ndarray], dimension: int, k: int, seed: int = 7, residual: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues and unit eigenvectors (columns) of a symmetric matrix known by its products with blocks of k columns at most."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = min(k, dimension)
    basis, image = np.zeros((dimension, 0)), np.zeros((dimension, 0))
    block = _independent(rng.standard_normal((dimension, k)), basis, 0.0)
    while True:
        made = multiply(block)
        basis, image = np.hstack([basis, block]), np.hstack([image, made])
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        vectors = basis @ turn
        scale = max(float(np.abs(values).max()), np.finfo(float).tiny)
        if basis.shape[1] == dimension:
            break
        open_pairs = np.linalg.norm(image @ turn - vectors * values, axis=0) > residual * scale
        room = dimension - basis.shape[1]
        block = _independent(made, basis, 1e-13 * scale)[:, :room]
        whole = block.shape[1] == min(made.shape[1], room)
        if whole and not open_pairs.any():
            break
        if not whole:
            # Breakdown: the rest of the block starts anew at random, and is judged by its own product.
            fresh = _independent(rng.standard_normal((dimension, min(k, room) - block.shape[1])), np.hstack([basis, block]), 1e-8)
            block = np.hstack([block, fresh])
    return values, vectors / np.linalg.norm(vectors, axis=0)


# ---------------------------------------------------------------- the operator

@dataclass(frozen=True)
class Whitening:
    """A fitted transform: components are the columns of vectors."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def whitener(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def prepared(table: DataFrame, vector: str, scale: int, offset: int, *keep: Column) -> tuple[DataFrame, int]:
    """The kept columns and the integers x of the vectors that take part, and their length (0 without any)."""
    fit = table.where(_fitting(F.col(vector), scale, offset))
    common = fit.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = common["width"] if common else 0
    return fit.where(F.size(vector) == width).select(*keep, integers(F.col(vector), scale, offset).alias("x")), width


def fit(rows: DataFrame, width: int, components: int = 16) -> Whitening | None:
    """The transform of the distinct vectors x of rows; None where they do not vary."""
    if not width:
        return None
    data = stored(rows.select("x").distinct(), "distinct-vectors")
    tasks = tasks_of(data)
    counted = data.mapInArrow(lambda it: _counted(it, width), "part int, n array<bigint>, bits array<bigint>, high array<bigint>, low array<bigint>")
    n, bits, high, low = collected(counted, (), ("n", "bits", "high", "low"), tasks)[()]
    centre = Centre(int(n[0]), tuple((int(h) << 32) + int(v) for h, v in zip(high, low, strict=True)), 1 << int(np.flatnonzero(bits).max()))
    if centre.n < 2:
        return None
    trace: list[float] = []

    def multiply(block: np.ndarray) -> np.ndarray:
        first = not trace
        made = data.mapInArrow(lambda it: _product(it, centre, block, first), "part int, out array<double>, trace array<double>")
        out, total = collected(made, (), ("out", "trace"), tasks)[()]
        if first:
            trace.append(float(total[0]) / centre.n)
        return out.reshape(block.shape) / centre.n

    values, vectors = leading_pairs(multiply, width, components)
    varied = values > RANK * max(values[0], 0.0)
    values, vectors = values[varied], vectors[:, varied]
    if not len(values):
        return None
    whitener = vectors / np.sqrt(values)
    made = data.mapInArrow(lambda it: _outer(it, centre, whitener), "part int, sums array<double>, products array<double>")
    sums, products = collected(made, (), ("sums", "products"), tasks)[()]
    mean = sums / centre.n
    error = np.abs(products.reshape(len(values), -1) / centre.n - np.outer(mean, mean) - np.eye(len(values))).max()
    return Whitening(centre, values, vectors, values / trace[0], float(error))


def _applied(batches: Iterator[pa.RecordBatch], model: Whitening, key: str) -> Iterator[pa.RecordBatch]:
    whitener = model.whitener
    for part, x in _rows(batches):
        deviation = [d if d < 1 << 63 else None for d in model.centre.squares(x)]
        w = model.centre.centred(x) @ whitener
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
        yield pa.RecordBatch.from_arrays([part.column(key), pa.array(deviation, pa.int64()), flat], [key, "deviation", "whitened"])


def transform(rows: DataFrame, model: Whitening, key: str) -> DataFrame:
    """key, deviation (exact sum over dimensions of (n * x - s)^2) and whitened, an array of a number for each component."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "x").mapInArrow(lambda it: _applied(it, model, key), f"`{key}` {kind}, deviation bigint, whitened array<double>")


_RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows, width = prepared(table, vector, scale, offset, F.col(vec_id).cast("bigint").alias("vec_id"))
    model = fit(rows, width, components)
    if model is None:
        return table.sparkSession.createDataFrame([], _RESULT)
    spread = transform(rows, model, "vec_id").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.lit([float(x) for x in model.explained])
    return spread.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.centre.n).cast("bigint").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))

"""Linear models from one pass: sums of products come to the driver, every iteration runs on those.

A Gram table of D features is D * D numbers however many rows there are, so gradient descent, ridge,
lasso, cross-validation over folds and penalties, and degree selection each read the data once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reduce import folded, task_number, tasks_of


# ---------------------------------------------------------------- one variable

def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """intercept and slope of least squares; NULL where x does not vary."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.where(xs.isNotNull() & ys.isNotNull()).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(xs).alias("sx"), F.sum(ys).alias("sy"), F.sum(xs * ys).alias("sxy"), F.sum(xs * xs).alias("sxx"))
    slope = F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n")), F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n")))
    return sums.withColumn("slope", slope).select((F.try_divide("sy", "n") - F.col("slope") * F.try_divide("sx", "n")).alias("intercept"), "slope")


def predict_simple(x: Column, intercept: float, slope: float) -> Column:
    return F.lit(float(intercept)) + F.lit(float(slope)) * x


def inverse_predict(y: Column, intercept: float, slope: float) -> Column:
    return F.try_divide(y - F.lit(float(intercept)), F.lit(float(slope)))


# ---------------------------------------------------------------- the Gram table

@dataclass(frozen=True)
class Gram:
    """Row count and sums of products of the features (a constant first, if asked for) and the target."""

    names: tuple[str, ...]
    n: int
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.names, self.n - other.n, self.xx - other.xx, self.xy - other.xy, self.yy - other.yy)

    def rss(self, w: np.ndarray) -> float:
        return float(max(self.yy - 2 * w @ self.xy + w @ self.xx @ w, 0.0))

    def gradient(self, w: np.ndarray) -> np.ndarray:
        """-2 X'(y - Xw)."""
        return -2 * (self.xy - self.xx @ w)

    def subset(self, names: Sequence[str]) -> Gram:
        at = [self.names.index(n) for n in names]
        return Gram(tuple(names), self.n, self.xx[np.ix_(at, at)], self.xy[at], self.yy)


def _products(features: dict[str, Column], y: Column) -> list[Column]:
    cols = [*features.values(), y]
    return [F.coalesce(F.sum(a * b), F.lit(0.0)).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]


def _unpack(row, names: tuple[str, ...]) -> Gram:
    d = len(names) + 1
    full = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            full[i, j] = full[j, i] = row[f"p{i}_{j}"]
    return Gram(names, row["n"], full[:-1, :-1], full[:-1, -1], float(full[-1, -1]))


def _columns(features: Sequence[str] | dict[str, Column], constant: bool) -> dict[str, Column]:
    named = features if isinstance(features, dict) else {f: F.col(f) for f in features}
    return ({"constant": F.lit(1.0)} if constant else {}) | {k: v.cast("double") for k, v in named.items()}


def gram(df: DataFrame, features: Sequence[str] | dict[str, Column], y: str, constant: bool = True) -> Gram:
    """One aggregation; rows with a null feature or target take no part."""
    cols, target = _columns(features, constant), F.col(y).cast("double")
    whole = df.where(_complete(cols, target))
    return _unpack(whole.agg(F.count(F.lit(1)).alias("n"), *_products(cols, target)).first(), tuple(cols))


def grams_by(df: DataFrame, by: str, features: Sequence[str] | dict[str, Column], y: str, constant: bool = True) -> dict[int, Gram]:
    """The same for each value of by (a fold), from one pass."""
    cols, target = _columns(features, constant), F.col(y).cast("double")
    rows = df.where(_complete(cols, target)).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *_products(cols, target)).collect()
    return {r[by]: _unpack(r, tuple(cols)) for r in rows}


def _complete(cols: dict[str, Column], target: Column) -> Column:
    ok = target.isNotNull()
    for c in cols.values():
        ok = ok & c.isNotNull()
    return ok


def total(parts: Iterable[Gram]) -> Gram:
    parts = list(parts)
    return Gram(parts[0].names, sum(p.n for p in parts), sum(p.xx for p in parts), sum(p.xy for p in parts), sum(p.yy for p in parts))


def predict(features: Sequence[str] | dict[str, Column], w: Sequence[float], constant: bool = True) -> Column:
    """Dot product of the row's features with the weights."""
    terms = [c * F.lit(float(x)) for c, x in zip(_columns(features, constant).values(), w, strict=True)]
    return sum(terms[1:], terms[0])


# ---------------------------------------------------------------- fits

def ols(g: Gram) -> np.ndarray:
    """Least squares; of collinear features the smallest weights after scaling to unit diagonal."""
    scale = np.sqrt(np.where(np.diag(g.xx) > 0, np.diag(g.xx), 1.0))
    return np.linalg.lstsq(g.xx / np.outer(scale, scale), g.xy / scale, rcond=1e-13)[0] / scale


def gradient_descent(g: Gram, start: Sequence[float], step: float, tolerance: float, max_iter: int = 100_000) -> tuple[np.ndarray, int]:
    """Steps against the gradient until its length before a step is under the tolerance; the step still counts."""
    w = np.array(start, float)
    for i in range(1, max_iter + 1):
        slope = g.gradient(w)
        w = w - step * slope
        if not np.isfinite(w).all():
            raise ArithmeticError(f"gradient descent diverged after {i} steps of {step}")
        if np.sqrt(slope @ slope) < tolerance:
            return w, i
    return w, max_iter


def ridge_gradient(g: Gram, w: np.ndarray, penalty: float, free: int | None = 0) -> np.ndarray:
    """Least squares gradient plus 2 * penalty * w, without the penalty for the feature free."""
    pull = 2 * penalty * w
    if free is not None:
        pull[free] = 0.0
    return g.gradient(w) + pull


def ridge_descent(g: Gram, start: Sequence[float], step: float, penalty: float, max_iter: int = 100) -> np.ndarray:
    w = np.array(start, float)
    for _ in range(max_iter):
        w = w - step * ridge_gradient(g, w, penalty)
    return w


def _centred(g: Gram) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """Centred and norm-scaled products of the features after the constant; means and norms."""
    mean, ymean = g.xx[0, 1:] / g.n, g.xy[0] / g.n
    xx = g.xx[1:, 1:] - g.n * np.outer(mean, mean)
    xy = g.xy[1:] - g.n * mean * ymean
    norm = np.sqrt(np.maximum(np.diag(xx), 0))
    norm = np.where(norm > 0, norm, 1.0)
    return xx / np.outer(norm, norm), xy / norm, mean, ymean, norm


def ridge(g: Gram, alpha: float) -> np.ndarray:
    """Squared error plus alpha * |w|^2 on centred features of length 1, free intercept; weights in raw units."""
    xx, xy, mean, ymean, norm = _centred(g)
    w = np.linalg.solve(xx + alpha * np.eye(len(xy)), xy) / norm
    return np.concatenate(([ymean - mean @ w], w))


def soft_threshold(rho: float, penalty: float) -> float:
    return rho + penalty / 2 if rho < -penalty / 2 else rho - penalty / 2 if rho > penalty / 2 else 0.0


def lasso(g: Gram, alpha: float, max_iter: int = 10_000, tolerance: float = 1e-10) -> np.ndarray:
    """Squared error / 2n plus alpha * |w|_1 on centred features of length 1, free intercept; weights in raw units."""
    xx, xy, mean, ymean, norm = _centred(g)
    w = np.zeros(len(xy))
    for _ in range(max_iter):
        most = 0.0
        for i in range(len(w)):
            new = soft_threshold(xy[i] - xx[i] @ w + xx[i, i] * w[i], 2 * alpha * g.n) / max(xx[i, i], 1e-300)
            most, w[i] = max(most, abs(new - w[i])), new
        if most < tolerance * max(1.0, np.abs(w).max(initial=0)):
            break
    w = w / norm
    return np.concatenate(([ymean - mean @ w], w))


def norms(g: Gram) -> np.ndarray:
    """2-norms of the feature columns; 1 for a column of zeros."""
    out = np.sqrt(np.diag(g.xx))
    return np.where(out > 0, out, 1.0)


def normalised(g: Gram) -> tuple[Gram, np.ndarray]:
    length = norms(g)
    return Gram(g.names, g.n, g.xx / np.outer(length, length), g.xy / length, g.yy), length


def lasso_step(g: Gram, i: int, w: np.ndarray, penalty: float) -> float:
    """Best weight i of squared error plus penalty * |w|_1 on features of length 1; the first is not penalised."""
    rho = float(g.xy[i] - g.xx[i] @ w + w[i])
    return rho if i == 0 else soft_threshold(rho, penalty)


def lasso_cyclic(g: Gram, start: Sequence[float], penalty: float, tolerance: float, max_iter: int = 100_000) -> tuple[np.ndarray, int]:
    """Weights in turn, each seeing those before it, until no step of a round reaches the tolerance."""
    w = np.array(start, float)
    for k in range(1, max_iter + 1):
        most = 0.0
        for i in range(len(w)):
            new = lasso_step(g, i, w, penalty)
            most, w[i] = max(most, abs(new - w[i])), new
        if most < tolerance:
            return w, k
    return w, max_iter


# ---------------------------------------------------------------- selection

def cross_validate(folds: dict[int, Gram], penalties: Sequence[float], fit=ridge) -> list[tuple[float, float]]:
    """Mean validation RSS of each penalty, from the Gram tables of the folds alone."""
    whole = total(folds.values())
    return [(p, float(np.mean([f.rss(fit(whole - f, p)) for f in folds.values()]))) for p in penalties]


def best(scores: Sequence[tuple]) -> tuple:
    """The first of the least."""
    return min(scores, key=lambda s: s[1])


def powers(x: str, degree: int) -> dict[str, Column]:
    return {f"power_{d}": F.pow(F.col(x).cast("double"), F.lit(float(d))) if d > 1 else F.col(x).cast("double") for d in range(1, degree + 1)}


def chebyshev(x: str, degree: int) -> dict[str, Column]:
    """Polynomials of degree 1 to degree in an x between -1 and 1: they span what the powers span, but stay apart from each other."""
    return {f"power_{d}": F.cos(F.lit(float(d)) * F.acos(F.greatest(F.least(F.col(x), F.lit(1.0)), F.lit(-1.0)))) for d in range(1, degree + 1)}


def select_degree(train: DataFrame, valid: DataFrame, x: str, y: str, degrees: Sequence[int] = range(1, 16)) -> list[tuple[int, float]]:
    """Validation RSS of each polynomial degree, from one pass over each part (and one for the range of x, which both share)."""
    value = F.col(x).cast("double")
    ends = train.select(value.alias("v")).unionByName(valid.select(value.alias("v"))).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    middle, half = ((ends["hi"] + ends["lo"]) / 2, (ends["hi"] - ends["lo"]) / 2 or 1.0) if ends["lo"] is not None else (0.0, 1.0)
    scaled = lambda df: df.withColumn("__x", (value - F.lit(middle)) / F.lit(half))
    most = max(degrees)
    a, b = (gram(scaled(df), chebyshev("__x", most), y) for df in (train, valid))
    names = lambda d: ["constant", *(f"power_{i}" for i in range(1, d + 1))]
    return [(d, b.subset(names(d)).rss(ols(a.subset(names(d))))) for d in degrees]


# ---------------------------------------------------------------- least squares without products

@dataclass(frozen=True)
class Triangle:
    """R of a QR decomposition of the columns [X y]: what least squares need, without the products that square the condition."""

    names: tuple[str, ...]
    n: int
    r: np.ndarray

    def fit(self, first: int | None = None) -> np.ndarray:
        """Weights of the first columns (all by default): any leading part of the columns is solved from the one R. Of collinear columns the smallest after scaling to unit length."""
        k = len(self.names) if first is None else first
        scale = np.linalg.norm(self.r[:, :k], axis=0)
        scale = np.where(scale > 0, scale, 1.0)
        return np.linalg.lstsq(self.r[:, :k] / scale, self.r[:, -1], rcond=1e-14)[0] / scale

    def rss(self, w: np.ndarray) -> float:
        """Of the rows behind R, for weights of its first columns."""
        return float(np.sum((self.r[:, : len(w)] @ w - self.r[:, -1]) ** 2))


#: Rows of one block of a decomposition.
_BLOCK = 4096


def _squared_off(top: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """R of two stacked tables, with as many rows as columns."""
    r = np.linalg.qr(np.vstack([top, rows]), mode="r")
    return np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))]) if len(r) < r.shape[1] else r


def _triangles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    r, n = np.zeros((width, width)), 0
    for batch in batches:
        for i in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(i, _BLOCK)
            r = _squared_off(r, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width))
            n += part.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([task_number()], pa.int32()), pa.array([np.append(r.ravel(), n)], pa.list_(pa.float64()))], ["part", "r"])


def triangle(df: DataFrame, features: Sequence[str] | dict[str, Column], y: str, constant: bool = True, tasks: int | None = None) -> Triangle:
    """R of all rows in one pass: each task decomposes its rows block by block and keeps one small triangle, and the triangles are
    stacked and decomposed again in a tree. Rows with a null feature or target take no part.

    No products of columns are made, so what is lost to rounding goes with the condition of X, not with its square: raw powers to degree 15
    are no trouble. tasks: how many partitions df has, where the caller knows it.
    """
    cols, target = _columns(features, constant), F.col(y).cast("double")
    rows = df.where(_complete(cols, target)).select(F.array(*cols.values(), target).alias("x"))
    width = len(cols) + 1

    def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.append(_squared_off(a[:-1].reshape(width, width), b[:-1].reshape(width, width)).ravel(), a[-1] + b[-1])

    made = rows.mapInArrow(lambda it: _triangles(it, width), "part int, r array<double>")
    found = folded(made, "r", fold, tasks_of(rows) if tasks is None else tasks)
    found = np.zeros(width * width + 1) if found is None else found
    return Triangle(tuple(cols), int(found[-1]), found[:-1].reshape(width, width))


def select_degree_of_powers(train: DataFrame, valid: DataFrame, x: str, y: str, degrees: Sequence[int] = range(1, 16)) -> list[tuple[int, float]]:
    """Validation RSS of each polynomial degree on raw powers: one pass over each part gives the fits of all degrees."""
    a, b = (triangle(df, powers(x, max(degrees)), y) for df in (train, valid))
    return [(d, b.rss(a.fit(d + 1))) for d in degrees]


def lasso_by_validation(train: Gram, valid: Gram, penalties: Sequence[float]) -> list[tuple[float, float, int]]:
    """(penalty, validation RSS, non-zero weights with the intercept)."""
    out = []
    for p in penalties:
        w = lasso(train, p)
        out.append((p, valid.rss(w), int(np.count_nonzero(w))))
    return out


def lasso_for_sparsity(train: Gram, valid: Gram, low: float, high: float, max_nonzeros: int, max_pass: int = 2, points: int = 20) -> tuple[float, float, tuple[float, float]]:
    """Penalty of least validation RSS among those with max_nonzeros weights, over ever finer log grids.

    Each pass narrows [low, high] to the largest penalty with too many and the smallest with too few.
    """
    found: tuple[float, float] | None = None
    for _ in range(max_pass + 1):
        grid = np.logspace(np.log10(low), np.log10(high), points)
        tried = lasso_by_validation(train, valid, grid)
        many, few = [p for p, _, k in tried if k > max_nonzeros], [p for p, _, k in tried if k < max_nonzeros]
        exact = [(p, r) for p, r, k in tried if k == max_nonzeros]
        low, high = max(many, default=low), min(few, default=high)
        if exact:
            candidate = best(exact)
            found = candidate if found is None or candidate[1] < found[1] else found
        if low >= high:
            break
    return (*(found or (float("nan"), float("nan"))), (float(low), float(high)))


def weights_table(spark, names: Sequence[str], w: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(n, float(x)) for n, x in zip(names, w, strict=True)], "feature string, weight double")

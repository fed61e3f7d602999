import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import features
from millrace.operators import linear, metrics, splits


@pytest.fixture
def line(spark):
    return spark.createDataFrame([(float(i), 1.0 + i) for i in range(5)], "x double, y double")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) * [1, 5, 20] + [0, 3, -7]
    y = x @ [2.0, -1.0, 0.3] + 4 + rng.normal(size=60)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, y double").persist(), np.column_stack([np.ones(60), x]), y


def test_simple_regression_and_inverse(line, spark):
    r = linear.simple_regression(line, "x", "y").first()
    assert (r["intercept"], r["slope"]) == pytest.approx((1, 1))
    assert metrics.rss(line, linear.predict_simple(F.col("x"), 1, 1), "y").first()["rss"] == 0
    assert line.select(linear.inverse_predict(F.col("y"), 1, 2).alias("v")).first()["v"] == 0
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "x double, y double")
    assert linear.simple_regression(flat, "x", "y").first()["slope"] is None
    assert linear.simple_regression(flat.limit(0), "x", "y").first()["intercept"] is None


def test_hand_computed_steps(line):
    g = linear.gram(line, ["x"], "y")
    assert g.gradient(np.zeros(2)) == pytest.approx([-30, -80])
    w, _ = linear.gradient_descent(g, [0, 0], 0.02, 0.0, max_iter=1)
    assert w == pytest.approx([0.6, 1.6])
    assert linear.ridge_gradient(g, w, 1.0) == pytest.approx([8, 31.2])
    assert [linear.soft_threshold(r, 4) for r in (5, -5, 1)] == [3, -3, 0]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_ols_and_descent_agree_with_numpy(cloud, parts):
    df, x, y = cloud
    g = linear.gram(df.repartition(parts), ["a", "b", "c"], "y")
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert linear.ols(g) == pytest.approx(want, rel=1e-9)
    w, _ = linear.gradient_descent(g, [0] * 4, 1e-5, 1e-7)
    assert w == pytest.approx(want, rel=1e-5) and g.rss(want) == pytest.approx(((y - x @ want) ** 2).sum())
    with pytest.raises(ArithmeticError):
        linear.gradient_descent(g, [0] * 4, 1.0, 1e-7)


def test_collinear_features_predict_alike(cloud):
    df, x, y = cloud
    g = linear.gram(df.withColumn("ab", F.col("a") + F.col("b")), ["a", "b", "ab", "c"], "y")
    assert g.rss(linear.ols(g)) == pytest.approx(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum(), rel=1e-9)


def test_ridge_and_lasso_objectives(cloud):
    df, x, y = cloud
    g, alpha = linear.gram(df, ["a", "b", "c"], "y"), 0.7
    centred = x[:, 1:] - x[:, 1:].mean(0)
    unit, yc = centred / np.linalg.norm(centred, axis=0), y - y.mean()
    want = np.linalg.solve(unit.T @ unit + alpha * np.eye(3), unit.T @ yc) / np.linalg.norm(centred, axis=0)
    assert linear.ridge(g, alpha)[1:] == pytest.approx(want)
    w = linear.lasso(g, 0.05)[1:] * np.linalg.norm(centred, axis=0)
    slope = unit.T @ (yc - unit @ w)
    assert all(abs(s) <= 60 * 0.05 + 1e-6 if v == 0 else s == pytest.approx(np.sign(v) * 60 * 0.05, rel=1e-6) for s, v in zip(slope, w, strict=True))


def test_cyclic_lasso_reaches_its_optimum(cloud):
    df, x, y = cloud
    g, length = linear.normalised(linear.gram(df, ["a", "b", "c"], "y"))
    w, _ = linear.lasso_cyclic(g, [0] * 4, 5.0, 1e-12)
    unit = x / length
    slope = -2 * unit.T @ (y - unit @ w)
    assert slope[0] == pytest.approx(0, abs=1e-6)
    assert all(abs(s) <= 5 + 1e-6 if v == 0 else s == pytest.approx(-5 * np.sign(v), rel=1e-6) for s, v in zip(slope[1:], w[1:], strict=True))


def test_cross_validation_from_fold_tables(cloud):
    df, x, y = cloud
    folds = splits.contiguous_folds(df, ["id"], 7)
    got = linear.cross_validate(linear.grams_by(folds, "fold", ["a", "b", "c"], "y"), [0.1, 10.0])
    edges = [60 * i // 7 for i in range(8)]
    for penalty, score in got:
        errors = []
        for i in range(7):
            out = np.arange(edges[i], edges[i + 1])
            keep = np.setdiff1d(np.arange(60), out)
            mean, ym = x[keep, 1:].mean(0), y[keep].mean()
            c = x[keep, 1:] - mean
            norm = np.linalg.norm(c, axis=0)
            w = np.linalg.solve((c / norm).T @ (c / norm) + penalty * np.eye(3), (c / norm).T @ (y[keep] - ym)) / norm
            errors.append((((y[out] - ym) - (x[out, 1:] - mean) @ w) ** 2).sum())
        assert score == pytest.approx(np.mean(errors))


def test_degree_and_sparsity_search(spark, cloud):
    rng = np.random.default_rng(1)
    rows = [(i, float(v), float(v**3 - v + rng.normal() * 0.01)) for i, v in enumerate(rng.uniform(-1, 1, 300))]
    train, valid = splits.train_test_split(spark.createDataFrame(rows, "id int, x double, y double"), "id", 0.3)
    scores = dict(linear.select_degree(train, valid, "x", "y", range(1, 7)))
    assert scores[3] < scores[2] / 10 and min(scores.values()) > 0
    df, *_ = cloud
    g = linear.gram(df, ["a", "b", "c"], "y")
    penalty, rss, (low, high) = linear.lasso_for_sparsity(g, g, 1e-4, 1e2, max_nonzeros=3)
    assert np.count_nonzero(linear.lasso(g, penalty)) == 3 and low <= penalty <= high and rss > 0


def test_feature_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0), (2, -3.0, 0.0), (3, None, 0.0)], "id int, v double, zero double")
    made = features.powers(features.derived(df, squares=["v"], logs=["v"], roots=["v"]), "v", 3).orderBy("id").collect()
    assert made[0]["power_3"] == 8 and made[1]["v_squared"] == 9 and made[1]["log_v"] is None and made[1]["v_sqrt"] is None and made[2]["power_2"] is None
    _, norms = features.normalise(df, ["v", "zero"])
    assert norms["v"] == pytest.approx(13**0.5) and norms["zero"] == 0
    assert features.drop_constant(df).columns == ["id", "v"]
    assert df.select(features.matrix("id", "zero").alias("m")).first()["m"] == [1.0, 1.0, 0.0]


# ---------------------------------------------------------------- decompositions

def solved_in_long_doubles(x, y):
    """Least squares by Householder reflections on 80-bit numbers."""
    a = np.concatenate((x, y[:, None]), axis=1).astype(np.longdouble)
    k = x.shape[1]
    for j in range(k):
        v = a[j:, j].copy()
        v[0] += np.sign(v[0] or 1) * np.sqrt((v * v).sum())
        v /= np.sqrt((v * v).sum())
        a[j:] -= 2 * np.outer(v, v @ a[j:])
    w = np.zeros(k, np.longdouble)
    for j in reversed(range(k)):
        w[j] = (a[j, -1] - a[j, j + 1 : k] @ w[j + 1 :]) / a[j, j]
    return w


@pytest.mark.parametrize("parts", [1, 7, 100])
def test_raw_powers_to_degree_15(spark, parts):
    """Condition 1e27 unscaled: fits of every degree agree with an 80-bit solve, from one triangle."""
    rng = np.random.default_rng(8)
    x = rng.uniform(1, 50, 3000)
    y = np.sin(x / 6) * 300 + x * 4 + rng.standard_normal(3000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, None)], "x double, y double").repartition(parts)
    t = linear.triangle(df, linear.powers("x", 15), "y")
    assert t.n == 3000
    table = x[:, None] ** np.arange(16)
    for degree in (1, 5, 10, 15):
        w = solved_in_long_doubles(table[:, : degree + 1], y)
        fitted = table[:, : degree + 1] @ t.fit(degree + 1)
        exact = (table[:, : degree + 1].astype(np.longdouble) @ w).astype(float)
        assert np.abs(fitted - exact).max() < 1e-5
        assert t.rss(t.fit(degree + 1)) == pytest.approx(float(((y - exact) ** 2).sum()), rel=1e-7)


def test_triangle_of_collinear_and_of_no_rows(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i + 1) for i in range(20)], "a double, b double, y double")
    t = linear.triangle(df, ["a", "b"], "y")
    w = t.fit()
    assert t.rss(w) == pytest.approx(0, abs=1e-16) and w[0] == pytest.approx(1) and w[1] + 2 * w[2] == pytest.approx(3)
    assert w == pytest.approx(linear.ols(linear.gram(df, ["a", "b"], "y")), abs=1e-6)
    none = linear.triangle(df.limit(0), ["a", "b"], "y")
    assert none.n == 0 and none.fit().tolist() == [0, 0, 0]

"""Deep trees and long ensembles on wide one-hot rows, dense and sparse, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import features
from millrace.operators import neighbors, trees


def rows_of(n, width, seed, nulls=False):
    r = random.Random(seed)
    x = [[int(r.random() < 0.3) for _ in range(width)] for _ in range(n)]
    y = [1 if v[0] + v[1] * v[2] + v[3] + r.random() > 1.4 else -1 for v in x]
    if nulls:
        x = [[None if r.random() < 0.05 else b for b in v] for v in x]
    return x, y


def tables(spark, x, y):
    dense = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(zip(x, y, strict=True))] + [(-1, x[0], None)], "id bigint, x array<int>, y int")
    sparse = dense.withColumn("x", F.filter(F.transform("x", lambda b, i: F.when(b != 0, i)), lambda i: i.isNotNull()))
    return dense.repartition(5), sparse.repartition(3)


def tree_by_loops(x, y, w, depth, weighted):
    def node(rows, used, d):
        p, n = (sum(w[i] for i in rows if y[i] == t) for t in (1, -1))
        out = {"p": p, "n": n}
        left = [f for f in range(len(x[0])) if f not in used]
        if min(p, n) <= (1e-15 * (p + n) if weighted else 0) or not left or d >= depth:
            return out
        keys = {}
        for f in left:
            p1, n1 = (sum(w[i] for i in rows if y[i] == t and x[i][f]) for t in (1, -1))
            wrong = min(p - p1, n - n1) + min(p1, n1)
            keys[f] = round(wrong / (p + n), 12) if weighted else (round(wrong, 12), abs((p + n) - 2 * (p1 + n1)))
        if weighted and len(set(keys.values())) < 2:
            return out
        f = min(left, key=keys.__getitem__)
        on, off = [i for i in rows if x[i][f]], [i for i in rows if not x[i][f]]
        if on and off:
            out |= {"f": f, "0": node(off, used | {f}, d + 1), "1": node(on, used | {f}, d + 1)}
        return out

    return node(range(len(x)), frozenset(), 0)


def same(tree, want, i=0):
    n = tree.nodes[i]
    assert (n.positive, n.negative) == pytest.approx((want["p"], want["n"])) and n.feature == want.get("f")
    if not n.leaf:
        same(tree, want["0"], n.left)
        same(tree, want["1"], n.right)


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("cells", [1 << 17, 1500])
def test_deep_trees(spark, monkeypatch, weighted, cells):
    """Dense and sparse rows give the tree of the loops, also when a level takes several passes."""
    monkeypatch.setattr(trees, "CELLS", cells)
    x, y = rows_of(400, 40, 1)
    weight = (1 + F.col("id") % 4).cast("double") if weighted else None
    want = tree_by_loops(x, y, [1 + i % 4 if weighted else 1 for i in range(len(x))], 10, weighted)
    names = [f"f{i}" for i in range(40)]
    for df, sparse in zip(tables(spark, x, y), (False, True), strict=True):
        tree = trees.grow(df, "x", "y", names, 10, weight, sparse=sparse)
        same(tree, want)
        assert tree.depth() > 5
        told = {r["id"]: (r["p"], r["node"]) for r in df.where("id >= 0").select("id", tree.predict(F.col("x"), sparse).alias("p"), tree.node_of(F.col("x"), sparse).alias("node")).collect()}
        assert sum(told[i][0] != y[i] for i in told) == sum(min(tree.nodes[i].positive, tree.nodes[i].negative) for i in tree.reachable() if tree.nodes[i].leaf) or weighted


def test_null_features_go_where_prediction_takes_them(spark):
    """A null counts as not set, and stands right of a split, in growing as in predicting."""
    x, y = rows_of(300, 6, 2, nulls=True)
    df, _ = tables(spark, x, y)
    tree = trees.grow(df, "x", "y", [f"f{i}" for i in range(6)], 5)
    ends = {r["node"]: (r["p"], r["n"]) for r in df.where("y is not null").groupBy(tree.node_of(F.col("x")).alias("node")).agg(F.sum((F.col("y") == 1).cast("int")).alias("p"), F.sum((F.col("y") != 1).cast("int")).alias("n")).collect()}
    assert ends == {i: (tree.nodes[i].positive, tree.nodes[i].negative) for i in tree.reachable() if tree.nodes[i].leaf and tree.nodes[i].positive + tree.nodes[i].negative}


def boosted_by_loops(x, y, rounds):
    s, out, left = np.zeros(len(y)), [], list(range(len(x[0])))
    x, y = np.array(x) != 0, np.array(y)
    for _ in range(rounds):
        w = np.exp(-y * s)
        p, n = w[y == 1].sum(), w[y != 1].sum()
        side = {f: (w[(y == 1) & x[:, f]].sum(), w[(y != 1) & x[:, f]].sum()) for f in left}
        errors = {f: round((min(p - a, n - b) + min(a, b)) / (p + n), 12) for f, (a, b) in side.items()}
        if len(set(errors.values())) < 2:
            break
        f = min(left, key=errors.__getitem__)
        a, b = side[f]
        e = (min(p - a, n - b) + min(a, b)) / (p + n)
        c, l, r = 0.5 * np.log((1 - e) / e), 1 if p - a >= n - b else -1, 1 if a >= b else -1
        s += c * np.where(x[:, f], r, l)
        out.append((f, l, r, c))
        left.remove(f)
    return out


def test_long_ensembles(spark):
    x, y = rows_of(500, 160, 3)
    want = boosted_by_loops(x, y, 120)
    assert len(want) == 120
    votes = np.cumsum([np.where(np.array(x)[:, f] != 0, r, l) for f, l, r, _ in want], axis=0)
    for df, sparse, rounds in zip(tables(spark, x, y), (False, True), (20, 120), strict=True):
        stumps = trees.adaboost(df, "x", "y", [str(i) for i in range(160)], rounds, sparse=sparse)
        assert [(s.feature, s.left, s.right) for s in stumps] == [v[:3] for v in want[:rounds]]
        assert [s.coefficient for s in stumps] == pytest.approx([v[3] for v in want[:rounds]], abs=1e-9)
        errors = {r["stage"]: r["error"] for r in trees.staged_error(df, stumps, "x", "y", sparse=sparse, width=160).collect()}
        assert [errors[t + 1] for t in range(rounds)] == pytest.approx([(np.where(v > 0, 1, -1) != y).mean() for v in votes[:rounds]])
        said = {r["id"]: r["p"] for r in df.where("id >= 0").select("id", trees.ensemble_predict(stumps, F.col("x"), sparse=sparse).alias("p")).collect()}
        assert [said[i] for i in range(500)] == np.where(votes[rounds - 1] > 0, 1, -1).tolist()


def test_boosting_counts_rows_that_are_alike_once(spark, monkeypatch):
    """3,000 rows of 40 kinds: the rounds and the stages read kinds, and agree with loops over all rows."""
    x, y = rows_of(20, 6, 5)
    x, y = np.tile(np.array(x), (150, 1)), np.where(np.arange(3000) % 7 < 2, -1, 1) * np.tile(np.array(y), 150)
    want = boosted_by_loops(x.tolist(), y.tolist(), 6)
    votes = np.cumsum([np.where(x[:, f] != 0, r, l) for f, l, r, _ in want], axis=0)
    read = []
    real = trees._voters
    monkeypatch.setattr(trees, "_voters", lambda *a: read.append(made := real(*a)) or made)
    for df, sparse in zip(tables(spark, x.tolist(), y.tolist()), (False, True), strict=True):
        stumps = trees.adaboost(df, "x", "y", list("abcdef"), 6, sparse=sparse)
        assert [(s.feature, s.left, s.right) for s in stumps] == [v[:3] for v in want] and want
        errors = {r["stage"]: r["error"] for r in trees.staged_error(df, stumps, "x", "y", sparse=sparse, width=6).collect()}
        assert [errors[t + 1] for t in range(len(want))] == pytest.approx([(np.where(v > 0, 1, -1) != y).mean() for v in votes])
    assert len(read) == 4 and all(made.count() <= 40 for made in read)


def test_rounds_of_boosting_take_no_more_tasks_than_the_kinds_are_worth(spark, monkeypatch):
    """With 200 shuffle partitions a round over a few rows is one task, not 200; rows without a feature take part."""
    x, y = rows_of(300, 12, 7)
    x[0] = x[1] = [0] * 12
    asked = []
    real = trees._boosted_counts
    monkeypatch.setattr(trees, "_boosted_counts", lambda *a: asked.append((a[-1], a[0].rdd.getNumPartitions())) or real(*a))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for df, sparse in zip(tables(spark, x, y), (False, True), strict=True):
                stumps = trees.adaboost(df, "x", "y", [str(i) for i in range(12)], 6, sparse=sparse)
                assert [(s.feature, s.left, s.right) for s in stumps] == [v[:3] for v in boosted_by_loops(x, y, 6)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(asked) == {(1, 1)}


def test_one_hot_of_many_values(spark, monkeypatch):
    """A column of 100,000 values: numbered without a value on the driver."""
    df = spark.range(100_000).select("id", F.concat(F.lit("v"), F.col("id")).alias("many"), F.when(F.col("id") % 3 == 1, F.lit("x")).alias("few"))
    taken = []
    real = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: taken.append(rows := real(self)) or rows)
    ids, dictionary = features.one_hot_sparse(df, "id", ["many", "few"])
    assert sum(len(t) for t in taken) <= 64
    assert dictionary.count() == 100_001 and dictionary.agg(F.max("feature_id")).first()[0] == 100_000
    sizes = {r["n"]: r["count"] for r in ids.groupBy(F.size("ids").alias("n")).count().collect()}
    assert sizes == {1: 66_667, 2: 33_333}
    names = {r["feature_id"]: r["feature"] for r in dictionary.where("feature in ('few=x', 'many=v1', 'many=v99999')").collect()}
    assert list(names.values())[0] == "few=x" and sorted(names) == sorted(names, key=names.get)
    own = ids.where("id = 1").first()["ids"]
    assert {names[i] for i in own} == {"few=x", "many=v1"} and own == sorted(own)


def test_one_hot_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id bigint, c string")
    ids, dictionary = features.one_hot_sparse(df, "id", ["c"])
    assert dictionary.count() == 0 and [r["ids"] for r in ids.collect()] == [[], []]
    empty = trees.grow(df.limit(0).select(F.array().cast("array<int>").alias("x"), F.lit(1).alias("y")), "x", "y", [], sparse=True)
    assert empty.count_nodes() == 1


# ---------------------------------------------------------------- neighbours by pivots

@pytest.mark.parametrize("metric", ["manhattan", "euclidean"])
@pytest.mark.parametrize("k, skip, rows", [(5, False, 4096), (3, True, 50), (700, False, 64)])
def test_pivots_find_what_brute_force_finds(spark, monkeypatch, metric, k, skip, rows):
    """Ties, repeated rows and ids, a hot vector, and more neighbours than there are."""
    monkeypatch.setattr(neighbors, "CELL_ROWS", rows)
    rng = np.random.default_rng(6)
    x = np.round(rng.standard_normal((500, 3)) * 4, 1).tolist() + [[1.0, 1.0, 1.0]] * 150
    items = spark.createDataFrame([(i % 640, v) for i, v in enumerate(x)] + [(9999, None)], "id bigint, v array<double>")
    queries = items.where("id % 9 = 0").dropDuplicates(["id"]).unionByName(spark.createDataFrame([(-1, [100.0, 0.0, 0.0])], "id bigint, v array<double>"))
    args = (queries, "id", "v", items, "id", "v", k, metric, skip)
    order = lambda df: sorted((r["id"], r["rank"], r["item_id"], r["distance"]) for r in df.collect())
    assert order(neighbors.pivot_nearest(*args, pivots=16)) == order(neighbors.k_nearest(*args))


@pytest.mark.parametrize("metric", ["manhattan", "euclidean"])
def test_pivots_take_few_distances(spark, metric):
    rng = np.random.default_rng(7)
    items = spark.createDataFrame([(i, v) for i, v in enumerate(rng.uniform(0, 100, (6000, 2)).tolist())], "id bigint, v array<double>")
    queries = items.where("id % 10 = 0")
    met = neighbors.pivot_met(queries, "id", "v", items, "id", "v", 5, metric)
    looked = met.agg(F.sum("looked")).first()[0]
    assert 600 * 5 < looked < 600 * 6000 / 20


def test_pivots_without_rows(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "id bigint, v array<double>")
    assert neighbors.pivot_nearest(df, "id", "v", df.limit(0), "id", "v", 3).collect() == []
    assert neighbors.pivot_nearest(df.limit(0), "id", "v", df, "id", "v", 3).collect() == []
    with pytest.raises(ValueError, match="triangle"):
        neighbors.pivot_nearest(df, "id", "v", df, "id", "v", 3, metric="cosine")

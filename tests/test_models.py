import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import features, text
from millrace.operators import kmeans, logistic, metrics, trees
from millrace.plans import models, registry
from millrace.session import stored

F7 = [(1, [1, 0], 1), (2, [1, 1], 1), (3, [0, 0], -1), (4, [0, 1], 1)]
F9 = [(1, [1, 0], 1), (2, [1, 1], 1), (3, [1, 0], -1), (4, [0, 1], -1), (5, [0, 0], -1)]


def rows(spark, data):
    return spark.createDataFrame(data, "id int, x array<int>, y int")


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_greedy_tree_by_hand(spark, parts):
    df = rows(spark, F7).repartition(parts)
    tree = trees.grow(df, "x", "y", ["a", "b"])
    assert (tree.count_nodes(), tree.count_leaves(), tree.names[tree.nodes[0].feature]) == (5, 3, "a")
    assert trees.tree_error(df, tree, "x", "y").first()["error"] == 0
    assert tree.trace([0, 1]) == ["split on a = 0", "split on b = 1", "leaf, predicting 1"] and "digraph" in tree.dot()
    assert tree.table(spark).count() == 5


def test_tree_stops(spark):
    tie = trees.grow(rows(spark, [(1, [0], 1), (2, [0], -1)]), "x", "y", ["a"])
    assert tie.count_nodes() == 1 and tie.nodes[0].prediction == -1
    assert trees.grow(rows(spark, F7), "x", "y", ["a", "b"], max_depth=1).count_nodes() == 3
    empty = trees.grow(rows(spark, F7).limit(0), "x", "y", ["a", "b"])
    assert empty.count_nodes() == 1 and empty.nodes[0].prediction == -1


def test_deep_tree_scores_every_row(spark):
    bits = 10
    data = [(i, [i >> b & 1 for b in range(bits)], 1 if bin(i * 2654435761 % 2**32).count("1") % 2 else -1) for i in range(1 << bits)]
    df = rows(spark, data)
    tree = trees.grow(df, "x", "y", [f"b{i}" for i in range(bits)], max_depth=bits)
    got = {r["id"]: r["p"] for r in df.select("id", tree.predict(F.col("x")).alias("p")).collect()}

    def walk(x):
        i = 0
        while not tree.nodes[i].leaf:
            i = tree.nodes[i].left if x[tree.nodes[i].feature] == 0 else tree.nodes[i].right
        return tree.nodes[i].prediction

    assert got == {i: walk(x) for i, x, _ in data} and sum(got[i] != y for i, _, y in data) / len(data) < 0.4


def test_gini_tree_takes_the_purest_split(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2, (500, 5))
    y = np.where(x[:, 0] & x[:, 1] | (rng.random(500) < 0.2) & x[:, 3], 1, -1)
    df = rows(spark, [(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))])

    def gini(mask):
        p = (y[mask] == 1).mean() if mask.any() else 0
        return mask.sum() * 2 * p * (1 - p)

    def predict(mask, depth):
        """The majority in each leaf of an exhaustive tree."""
        best = min(range(5), key=lambda f: gini(mask & (x[:, f] == 0)) + gini(mask & (x[:, f] == 1)))
        parts = [mask & (x[:, best] == v) for v in (0, 1)]
        if not depth or not all(p.any() for p in parts) or gini(mask) - sum(map(gini, parts)) <= 1e-9:
            return np.where(mask, 1 if (y[mask] == 1).mean() > 0.5 else -1, 0)
        return sum(predict(p, depth - 1) for p in parts)

    for depth in (1, 2, 4):
        model = trees.gini_tree(df, "x", "y", list("abcde"), depth)
        assert model.depth <= depth and trees.gini_accuracy(model, df, "x", "y") == pytest.approx((predict(np.ones(500, bool), depth) == y).mean())
    rare = rows(spark, [(i, [int(i == 7), 0], 1 if i == 7 else -1) for i in range(40_000)])
    assert trees.gini_accuracy(trees.gini_tree(rare, "x", "y", ["a", "b"], 2), rare, "x", "y") == 1


def test_library_boosting_goes_beyond_one_tree(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (600, 6))
    y = np.where(x.sum(1) + rng.normal(0, 0.3, 600) > 3, 1, -1)
    df = rows(spark, [(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))])
    one, many = (trees.gini_accuracy(trees.boosted_trees(df, "x", "y", list("abcdef"), rounds=r, max_depth=2, step=0.5), df, "x", "y") for r in (1, 12))
    assert many > one > 0.5


def test_gini_query_has_the_three_depths(spark):
    got = {r["max_depth"]: r for r in registry.QUERIES["gini_tree_depths"](spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got) == [2, 6, 10] and all(0 < r["valid_accuracy"] <= 1 for r in got.values())
    assert got[2]["train_accuracy"] <= got[6]["train_accuracy"] <= got[10]["train_accuracy"]


def test_pruning_never_raises_the_cost(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (400, 6))
    y = np.where(rng.random(400) < 0.25, -1, 1) * np.where(x[:, 0] | x[:, 1], 1, -1)
    df = rows(spark, [(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))])
    tree = trees.grow(df, "x", "y", list("abcdef"))
    cost = lambda t, p: trees.tree_error(df, t, "x", "y").first()["error"] + p * t.count_leaves()
    for penalty in (0.0, 0.005, 0.5):
        pruned = trees.prune(tree, df, "x", "y", penalty)
        assert cost(pruned, penalty) <= cost(tree, penalty) + 1e-12 and pruned.count_leaves() <= tree.count_leaves()
    assert trees.prune(tree, df, "x", "y", 0.5).count_leaves() == 1


def test_boosting_by_hand(spark):
    df = rows(spark, F9)
    s = trees.adaboost(df, "x", "y", ["a", "b"], 1)[0]
    assert (s.feature, s.left, s.right) == (0, -1, 1) and s.error == pytest.approx(0.2) and s.coefficient == pytest.approx(0.6931471805599453)
    alpha = {r["id"]: r["alpha"] for r in trees.row_weights(df, [s], "x", "y").collect()}
    assert alpha[3] == pytest.approx(0.5) and all(alpha[i] == pytest.approx(0.125) for i in (1, 2, 4, 5))
    assert trees.adaboost(rows(spark, F7), "x", "y", ["a", "b"], 3) == []
    assert trees.adaboost(df, "x", "y", ["a", "b"], 3, exclude=[1]) == []
    perfect = trees.adaboost(rows(spark, [r for r in F9 if r[0] != 3]), "x", "y", ["a", "b"], 2)
    assert math.isfinite(perfect[0].coefficient) and perfect[0].coefficient > 5


def test_boosting_against_stored_weights(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (300, 5))
    y = np.where(x[:, 0] + x[:, 1] + x[:, 2] + (rng.random(300) < 0.2) > 1.5, 1, -1)
    df = rows(spark, [(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))])
    stumps = trees.adaboost(df, "x", "y", list("abcde"), 4)
    alpha, left = np.full(300, 1 / 300), list(range(5))
    for s in stumps:
        errors = [round(sum(min(alpha[(x[:, f] == v) & (y == 1)].sum(), alpha[(x[:, f] == v) & (y == -1)].sum()) for v in (0, 1)), 12) for f in left]
        f = left[int(np.argmin(errors))]
        vote = np.where(x[:, f] == 0, s.left, s.right)
        assert f == s.feature and min(errors) == pytest.approx(s.error, abs=1e-9)
        alpha = alpha * np.exp(-s.coefficient * y * vote)
        alpha, left = alpha / alpha.sum(), [i for i in left if i != f]
    curve = {r["stage"]: r["error"] for r in trees.staged_error(df, stumps, "x", "y").collect()}
    votes = np.cumsum([np.where(x[:, s.feature] == 0, s.left, s.right) for s in stumps], axis=0)
    assert curve == {i + 1: pytest.approx((np.where(v > 0, 1, -1) != y).mean()) for i, v in enumerate(votes)}
    both = [df.agg(F.avg((trees.ensemble_predict(stumps, F.col("x"), v) == F.col("y")).cast("double")).alias("a")).first()["a"] for v in ("unweighted", "weighted")]
    assert both[0] == pytest.approx(1 - curve[len(stumps)]) and both[1] > 0.5


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 2))
    y = np.where(rng.random(80) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1]))), 1, -1)
    df = spark.createDataFrame([(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, y int").persist()
    return df, np.column_stack([np.ones(80), x]), y


def test_ascent_step_by_step(points):
    df, x, y = points
    data = logistic.prepared(df, features.matrix("a", "b"), "y")
    w, history = logistic.ascent(data, [0, 0, 0], 0.01, 25, penalties=(0.0, 3.0))
    for k, l2 in enumerate((0.0, 3.0)):
        v = np.zeros(3)
        for _ in range(25):
            g = x.T @ ((y == 1) - 1 / (1 + np.exp(-x @ v)))
            g[1:] -= 2 * l2 * v[1:]
            v = v + 0.01 * g
        assert w[k] == pytest.approx(v)
    assert [h[0] for h in history] == sorted(h[0] for h in history) and history[0][0] == pytest.approx(-80 * math.log(2))


def test_an_iteration_takes_no_more_tasks_than_the_rows_are_worth(points, monkeypatch):
    """Eighty rows over 70 partitions: the data are read by one task, and nothing is exchanged to add its gradient."""
    df, x, y = points
    asked = []
    real = logistic.collected
    monkeypatch.setattr(logistic, "collected", lambda made, keys, sums, tasks, *a: asked.append((tasks, made.rdd.getNumPartitions())) or real(made, keys, sums, tasks, *a))
    many, few = (logistic.ascent(logistic.prepared(d, features.matrix("a", "b"), "y"), [0, 0, 0], 0.01, 2)[0] for d in (df.repartition(70), df.coalesce(1)))
    assert many == pytest.approx(few) and set(asked) == {(1, 1)}


def test_newton_is_stationary(points):
    df, x, y = points
    w = logistic.newton(logistic.prepared(df, features.matrix("a", "b"), "y"), 3)
    assert x.T @ ((y == 1) - 1 / (1 + np.exp(-x @ w))) - w == pytest.approx(np.zeros(3), abs=1e-7)


def test_batches(points):
    assert logistic.batch_starts(6, 2, 4) == [(0, 0), (0, 2), (1, 0), (1, 2)]
    assert logistic.batch_starts(7, 2, 4) == [(0, 0), (0, 2), (0, 4), (1, 0)]
    df, x, y = points
    out = logistic.mini_batch(df, "id", features.matrix("a", "b"), "y", [0.1, 1.0], 80, 3).collect()
    w = np.zeros(3)
    for _ in range(3):
        w = w + 0.1 / 80 * (x.T @ ((y == 1) - 1 / (1 + np.exp(-x @ w))))
    got = next(r["weights"] for r in out if r["step_size"] == 0.1 and r["iteration"] == 3)
    assert got == pytest.approx(w) and len(out) == 6


@pytest.mark.parametrize(("n", "batch", "at_once"), [(350, 20, 3), (350, 20, 512), (100, 20, 2), (15, 20, 2)])
def test_batches_run_over_all_rows(spark, monkeypatch, n, batch, at_once):
    monkeypatch.setattr(logistic, "BATCHES_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    a, y = rng.normal(size=n), np.where(rng.random(n) < 0.5, 1, -1)
    df = spark.createDataFrame([(i, float(a[i]), int(y[i])) for i in range(n)] + [(n, 1.0, None)], "id int, a double, y int")
    steps, total, w, want, seen = [0.01, 1.0, 100.0], 10 * n // batch, np.zeros((3, 2)), {}, set()
    for i, (turn, at) in enumerate(logistic.batch_starts(n, batch, total)):
        order = sorted(range(n), key=lambda k: hashlib.md5(f"{1000 + turn}:{k}".encode()).hexdigest())[at : at + batch]
        seen.update(order)
        x, good = np.column_stack([np.ones(len(order)), a[order]]), y[order] == 1
        for k, step in enumerate(steps):
            pull = 2 * 0.5 * w[k] * [0, 1]
            w[k] = w[k] + step / batch * (x.T @ (good - np.exp(-np.logaddexp(0, -x @ w[k]))) - pull)
            s = x @ w[k]
            want[step, i + 1] = (((good - 1) * s - np.logaddexp(0, -s)).sum() - 0.5 * w[k][1] ** 2) / len(order)
    out = logistic.mini_batch(df, "id", features.matrix("a"), "y", steps, batch, penalty=0.5).collect()
    assert {(r["step_size"], r["iteration"]): pytest.approx(r["log_likelihood"], rel=1e-6) for r in out} == want and len(out) == len(want) and len(seen) == n
    last = {r["step_size"]: r["weights"] for r in out if r["weights"] is not None}
    assert [last[s] for s in steps] == [pytest.approx(v, rel=1e-6) for v in w.tolist()]


def test_step_sweep_grows_with_the_labels(spark, tmp_path):
    n = 1500
    spark.range(n).selectExpr("id as doc_id", "concat('text ', id, if(id % 3 = 0, ' !!!', '')) as text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).selectExpr("id as doc_id", "cast(id % 3 > 0 as int) as quality").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.QUERIES["mini_batch_step_sweep"](spark, str(tmp_path)).groupBy("step_size").count().collect()
    assert {round(math.log10(r["step_size"])): r["count"] for r in got} == {k: 10 * n // 100 for k in range(-4, 3)}


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.6), (-1, 0.7), (-1, 0.2)], "y int, p double")
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in metrics.threshold_sweep(df, "y", "p", [0.5, 0.65, 0.9]).collect()}
    assert got == {0.5: (pytest.approx(2 / 3), 1.0), 0.65: (0.5, 0.5), 0.9: (None, 0.0)}
    rng = np.random.default_rng(2)
    p, y = rng.random(200), np.where(rng.random(200) < 0.5, 1, -1)
    cuts = np.linspace(0, 1, 37).tolist()
    swept = metrics.threshold_sweep(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)] + [(1, None)], "y int, p double"), "y", "p", cuts)
    for r in swept.collect():
        said = p > r["threshold"]
        assert r["precision"] == (pytest.approx((y[said] == 1).mean()) if said.any() else None) and r["recall"] == pytest.approx((said & (y == 1)).sum() / ((y == 1).sum() + 1))
    table = {(r["target_label"], r["predicted_label"]): r["count"] for r in metrics.confusion(df, "y", F.lit(1)).collect()}
    assert table == {(1, 1): 2, (-1, 1): 2, (1, -1): 0, (-1, -1): 0}
    assert metrics.log_likelihood(df, F.lit(0.0), "y").first()[0] == pytest.approx(-4 * math.log(2))
    assert metrics.log_likelihood(df, F.lit(800.0), "y", average=True).first()[0] == pytest.approx(-400)
    loss = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 5.0)], "i int, v double")
    assert [r[1] for r in metrics.moving_average(loss, "i", "v", 2).orderBy("i").collect()] == [2, 4]
    long = spark.createDataFrame([(i, float(i * i % 17)) for i in range(100)], "i int, v double")
    for chunk in (7, 10, 1000):
        got = [r[1] for r in metrics.moving_average(long, "i", "v", 7, chunk_rows=chunk).orderBy("i").collect()]
        assert got == pytest.approx(np.convolve([i * i % 17 for i in range(100)], np.ones(7) / 7, "valid"))
    assert {r["bin"]: r["amount"] for r in metrics.histogram(spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double"), F.col("v"), 10).where("amount > 0").collect()} == {0: 1, 5: 1, 9: 1}


def test_kmeans_by_hand(spark):
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate((0.0, 1.0, 10.0, 11.0))], "id int, v array<double>")
    out = kmeans.lloyd(df, "v", [[0.0], [10.0]])
    assert out.centroids.tolist() == [[0.5], [10.5]] and out.heterogeneity == pytest.approx(1.0) and out.history == sorted(out.history, reverse=True)
    far = kmeans.lloyd(df, "v", [[0.0], [10.0], [1000.0]])
    assert far.empty == [2] and far.centroids[2].tolist() == [1000.0]
    assert sorted(np.ravel(kmeans.careful_start(df, "id", "v", 9))) == [0, 1, 10, 11]
    assert [(r["cluster"], r["size"]) for r in kmeans.cluster_sizes(kmeans.assign(df, "v", [[0.0], [99.0]]), 2).orderBy("cluster").collect()] == [(0, 4), (1, 0)]


def test_restarts_converge_for_seven_seeds(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.exponential(size=(3000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    ends = {}
    for seed in range(0, 140_000, 20_000):
        c, own, rounds = kmeans.careful_start(df, "vec_id", "embedding", 3, seed), None, 0
        while True:
            new, rounds = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1), rounds + 1
            c = np.array([x[new == k].mean(0) for k in range(3)])
            if own is not None and (own == new).all():
                break
            own = new
        ends[seed] = (((x[:, None] - c[None]) ** 2).sum(2).min(1).sum(), rounds)
    assert max(r for _, r in ends.values()) > 20
    got = registry.QUERIES["kmeans_restarts"](spark, str(tmp_path)).first()
    least = min(e for e, _ in ends.values())
    assert got["heterogeneity"] == pytest.approx(least) and ends[got["seed"]][0] == pytest.approx(least)


def test_careful_starts_follow_their_distribution(spark):
    """Over many seeds, each row is the second centre as often as its squared distance to the first says."""
    x = [0.0, 1.0, 2.0, 5.0]
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate(x)], "id bigint, v array<double>")
    seeds = range(600)
    picks = [c.ravel().tolist() for c in kmeans.careful_starts(df, "id", "v", 2, seeds)]
    for first in x:
        later = [p[1] for p in picks if p[0] == first]
        whole = sum((v - first) ** 2 for v in x)
        for v in x:
            share = (v - first) ** 2 / whole
            assert abs(later.count(v) / len(later) - share) < 4 * (share * (1 - share) / len(later)) ** 0.5 + 1e-9
    assert all(kmeans.careful_start(df, "id", "v", 2, s).ravel().tolist() == picks[s] for s in (0, 7))


def test_row_weights_move_no_rows(spark):
    df = rows(spark, F9)
    stump = trees.adaboost(df, "x", "y", ["a", "b"], 1)
    assert "Exchange" not in trees.row_weights(df, stump, "x", "y")._jdf.queryExecution().executedPlan().toString()


def test_sparse_and_dense_clusters_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.random((30, 6)) * (rng.random((30, 6)) < 0.5)
    c = rng.random((3, 6))
    bag = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v or j == 0], "doc_id int, term int, value double")
    cents = spark.createDataFrame([(k, j, float(v)) for k, r in enumerate(c) for j, v in enumerate(r)], "cluster int, term int, value double")
    assigned = kmeans.sparse_assign(bag, "doc_id", cents)
    want = ((x[:, None] - c[None]) ** 2).sum(2)
    assert {r["doc_id"]: (r["cluster"], pytest.approx(r["squared_distance"])) for r in assigned.collect()} == {i: (int(d.argmin()), d.min()) for i, d in enumerate(want)}
    means = {(r["cluster"], r["term"]): r["value"] for r in kmeans.sparse_revise(bag, "doc_id", assigned).collect()}
    for (k, j), v in means.items():
        assert v == pytest.approx(x[want.argmin(1) == k][:, j].mean())
    assert kmeans.top_terms(cents, 2).count() == 6


@pytest.mark.parametrize("off", [0.0, 1e7, 1e12])
def test_nearest_by_one_product_is_that_of_differences(off):
    """Ties, vectors far from zero, and such as are not finite."""
    rng = np.random.default_rng(8)
    x = off + np.vstack([rng.integers(-2, 3, (300, 3)), rng.normal(size=(300, 3))])
    x[5, 1], x[6, 2], x[7, 0] = np.nan, np.inf, 1e200
    runs = [off + np.array([[-1.0, 0, 0], [1, 0, 0], [1, 0, 0]]), off + rng.normal(size=(2, 3)), x[:1]]
    with np.errstate(all="ignore"):
        for centroids, own in zip(runs, kmeans._own(x, runs), strict=True):
            assert own.tolist() == np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1).argmin(1).tolist()


def test_a_pass_reads_blocks_of_vectors(spark):
    """Not a row for each vector; one that is not finite spoils the sum of its own cluster only."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2500, 4))
    x[:, 0] += np.where(np.arange(2500) % 2, 50, -50)
    x[1, 3] = np.nan
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").coalesce(1)
    data = kmeans._prepared(df, "v")
    assert [r["n"] for r in data.select("n").collect()] == [1024, 1024, 452]
    runs = [np.array([[50.0, 0, 0, 0], [-50, 0, 0, 0]]), np.array([[-50.0, 0, 0, 0], [50, 0, 0, 0], [900, 0, 0, 0]])]
    two, three = kmeans._sums_of(data, runs)
    left, right = x[::2], x[1::2]
    assert sorted(two) == [0, 1] and sorted(three) == [0, 1] and (two[1][0], three[0][0]) == (1250, 1251)
    assert two[1][1] == pytest.approx(((left - runs[0][1]) ** 2).sum()) and two[1][3] == pytest.approx(left.sum(0))
    assert np.isnan(two[0][3]).tolist() == [False, False, False, True] and two[0][3][:3] == pytest.approx(right.sum(0)[:3])


ODD_TEXTS = ["", None, "ÀB c", "ab", "cd", "12 34", "x", "a-A a\n\u212Aelvin", "é", "İstanbul a", "z" * 5000, " b ", "日本 tea日tea", "the the of"]


@pytest.mark.parametrize("again", [0, 3])
def test_letters_are_cut_from_bytes(spark, again):
    """As words made by a regular expression are, with ids on several rows too."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)] + [(i, t) for i, t in enumerate(ODD_TEXTS[-again:] if again else [])], "id bigint, t string").coalesce(1)
    want = sorted(tuple(r) for r in text.bag_of_words(df, "id", text.letters_only(F.col("t"))).collect())
    assert sorted(tuple(r) for r in text.bag_of_letters(df, "id", F.col("t")).collect()) == want and len(want) >= 15
    rows = text.letter_counts(df, "id", F.col("t")).collect()
    assert sorted((r["id"], w, n) for r in rows for w, n in zip(r["terms"], r["tfs"], strict=True)) == want and all(r["terms"] for r in rows)


@pytest.mark.parametrize("sent", [0, 100, 1 << 20])
def test_a_step_over_counts_is_that_of_long_rows(spark, monkeypatch, sent):
    """Whatever part of the vocabulary is broadcast, and however few entries a task holds."""
    monkeypatch.setattr(kmeans, "HELD", 50)
    rng = np.random.default_rng(2)
    docs = [(i, " ".join("w" + chr(97 + min(int(j), 25)) for j in rng.geometric(0.12, 30))) for i in range(60)]
    df = spark.createDataFrame(docs, "id bigint, t string").repartition(3, "id")
    ids = [3, 17, 29]
    assigned, means = kmeans.tf_idf_step(stored(text.letter_counts(df, "id", F.col("t")), "counts"), "id", ids, broadcast_bytes=sent)
    long = text.tf_idf(text.bag_of_letters(df, "id", F.col("t")), "id")
    want = stored(kmeans.sparse_assign(long, "id", kmeans.sparse_rows(long, "id", ids)), "want")
    assert {r["id"]: (r["cluster"], pytest.approx(r["squared_distance"], abs=1e-9)) for r in want.collect()} == {r["id"]: (r["cluster"], r["squared_distance"]) for r in assigned.collect()}
    assert {(r["cluster"], r["term"]): pytest.approx(r["value"]) for r in kmeans.sparse_revise(long, "id", want).collect()} == {(r["cluster"], r["term"]): r["value"] for r in means.collect()}


def test_text_clusters_exchange_no_rows(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, means = models._text_clusters(spark, "/root/testdata/sf0.001")
        assert "hashpartitioning(doc_id" not in means._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("texts", [[None, "12"], ["a b", None], ["a b", "a b", "c"], ["a a b", "c", "c d"]])
def test_text_clusters_of_few_documents(spark, tmp_path, texts):
    """None, one that is both first and last, and equal ones: as the SQL has them."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("cluster_terms", "described_clusters"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = db.execute(registry.ORACLE_SQL[name])
        assert sorted(map(tuple, got.select(*(d[0] for d in want.description)).collect())) == sorted(want.fetchall())


def test_cluster_terms_write_one_row_a_term(spark, monkeypatch):
    """Neither documents nor their distances are written where only means are asked for."""
    written = []

    def seen(df, name):
        written.append((name, df.columns))
        return stored(df, name)

    for module in (kmeans, models, text):
        monkeypatch.setattr(module, "stored", seen)
    registry.QUERIES["cluster_terms"](spark, "/root/testdata/sf0.001").collect()
    assert written == [("sums", ["term", "df", "tfs"])]


@pytest.mark.parametrize("texts", [
    [(0, "a b b c"), (None, "a c d d"), (1, "b d e"), (2, "12"), (3, "e e a"), (4, None)],
    [(None, "a c d d"), (0, "a b"), (0, "b c"), (1, "b d e"), (2, ""), (3, "e e"), (3, "a")]])
def test_cluster_terms_of_odd_ids(spark, tmp_path, texts):
    """A document without an id has terms and a cluster, but no part in a mean; one id on several rows is one document."""
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("cluster_terms", "described_clusters") if len({i for i, _ in texts}) == len(texts) else ("cluster_terms",):
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = db.execute(registry.ORACLE_SQL[name])
        assert sorted(map(tuple, got.select(*(d[0] for d in want.description)).collect())) == sorted(want.fetchall())


def test_which_texts_have_words(spark):
    """By the first characters or by all, in letters that are lower-cased to those of a to z too."""
    texts = [None, "", "12", "7" * 70 + "A", "7" * 70, "\u212a", "\u0130", "\u0410\u0444", "7" * 64 + "\u212a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.has_letter_words(F.col("t")).alias("has"), (F.size(text.letters_only(F.col("t"))) > 0).alias("want")).collect()
    assert [r["has"] for r in rows] == [bool(r["want"]) for r in rows] == [False, False, False, True, False, True, True, False, True]


def test_online_halves_are_read_by_several_tasks(spark, monkeypatch):
    """Each half is one micro-batch, in whatever number of files it lies."""
    met, files, learn, replay = [], [], models.online.OnlineLogistic.learn, models.online.replay
    labelled = registry.labelled
    monkeypatch.setattr(registry, "labelled", lambda *a: labelled(*a).repartition(3))

    def seen(self, batch, number):
        met.append(number)
        learn(self, batch, number)

    def counted(spark, path, *args, **options):
        files.append(len(spark.read.parquet(path).inputFiles()))
        return replay(spark, path, *args, **options)

    monkeypatch.setattr(models.online.OnlineLogistic, "learn", seen)
    monkeypatch.setattr(models.online, "replay", counted)
    registry.QUERIES["online_logistic"](spark, "/root/testdata/sf0.001").collect()
    assert met == [0, 1] and files == [3, 6]

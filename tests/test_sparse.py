"""Sparse rows against plain loops: neighbours, hashing, clusters, logistic regression, and sums of many tasks."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import kmeans, logistic, neighbors, reduce, sparse, sparse_logistic
from millrace.session import discard, stored

LONG = "id bigint, term string, value double"


def made(n, terms, seed, common=("the", "of")):
    """Rows of a few terms of very unequal frequency; some are repeated, some hold only common terms."""
    r = random.Random(seed)
    rows = {}
    for i in range(n):
        own = {f"t{min(int(r.paretovariate(0.7)), terms)}": float(r.randint(1, 5)) for _ in range(r.randint(1, 8))}
        if i % 3:
            own |= {c: float(r.randint(1, 3)) for c in common}
        rows[i] = own
    rows |= {n: dict(rows[1]), n + 1: dict(rows[1]), n + 2: {common[0]: 2.0}, n + 3: {"alone": 1.0}}
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, v) for i, own in rows.items() for t, v in own.items()], LONG)


# ---------------------------------------------------------------- neighbours

def brute(queries, items, k, metric, skip=True):
    dot = lambda a, b: sum(v * b.get(t, 0.0) for t, v in a.items())
    out = {}
    for q, x in queries.items():
        far = []
        for i, y in items.items():
            if skip and i == q:
                continue
            xx, yy, xy = dot(x, x), dot(y, y), dot(x, y)
            far.append((round(1 - xy / math.sqrt(xx * yy), 9) if metric == "cosine" else math.sqrt(round(max(xx + yy - 2 * xy, 0), 6)), i))
        out[q] = [(i, d) for d, i in sorted(far)[:k]]
    return out


def found(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r[0]][r["rank"]] = (r["item_id"], r["distance"])
    return {q: [own[i + 1] for i in range(len(own))] for q, own in out.items()}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("k, budget", [(5, 4096), (3, 4), (400, 0)])
def test_nearest_against_brute_force(spark, monkeypatch, metric, k, budget):
    monkeypatch.setattr(sparse, "SEED_ROWS", budget)
    items = made(300, 60, 1)
    queries = {i: items[i] for i in (0, 1, 2, 50, 300, 302, 303)} | {900: {"the": 1.0, "nowhere": 3.0}, 901: {"nowhere": 1.0}}
    got = found(sparse.sparse_nearest(table(spark, queries), "id", table(spark, items), "id", k, metric))
    want = brute(queries, items, k, metric)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and [d for _, d in got[q]] == pytest.approx([d for _, d in want[q]], abs=1e-9)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_common_terms_are_not_looked_up(spark, metric):
    """Two terms that nearly every row holds: the bound rules them out, and few pairs are made of all there are."""
    items = {i: {"the": 1.0, "of": 1.0, f"a{i % 40}": 6.0, f"b{i % 80}": 6.0} for i in range(2000)}
    queries = {i: items[i] for i in range(0, 2000, 100)}
    search = sparse.Search(table(spark, queries), "id", table(spark, items), "id", 3, metric)
    essential = search.split(search.bounds())
    assert {r["term"] for r in essential.where("skipped").select("term").distinct().collect()} >= {"the", "of"}
    pairs = search.candidates(essential).count()
    assert pairs < 20 * 2000 / 15
    got, want = found(search.run().select(F.col("q"), F.col("item").alias("item_id"), "distance", "rank")), brute(queries, items, 3, metric)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_nearest_of_odd_rows(spark):
    """Nulls, zeros and empty tables; ids may be text; a query may meet its own row."""
    items = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.0), ("b", "x", 2.0), ("b", None, 3.0), (None, "x", 1.0), ("c", "z", None), ("d", "z", 4.0)], "id string, term string, value double")
    got = found(sparse.sparse_nearest(items, "id", items, "id", 3, skip_same_id=False))
    assert got == {"a": [("a", 0.0), ("b", 0.0), ("d", 1.0)], "b": [("a", 0.0), ("b", 0.0), ("d", 1.0)], "d": [("d", 0.0), ("a", 1.0), ("b", 1.0)]}
    none = items.limit(0)
    for q, i in ((none, items), (items, none), (none, none)):
        assert sparse.sparse_nearest(q, "id", i, "id", 3).collect() == []


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_in_small_blocks(spark, monkeypatch, metric):
    """Several turns, blocks and pieces of products; no exchange holds pairs of queries and items."""
    for name, size in (("BLOCK_TERMS", 40), ("BLOCK_QUERIES", 5), ("BLOCK_ITEMS", 7), ("DENSE_TERMS", 2), ("_AT_ONCE", 9)):
        monkeypatch.setattr(sparse, name, size)
    items = made(120, 40, 9)
    queries = {i: x for i, x in items.items() if i % 3 == 0}
    got, want = found(sparse.sparse_nearest(table(spark, queries), "id", table(spark, items), "id", 4, metric)), brute(queries, items, 4, metric)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_tasks_pass_on_k_rows_a_query(spark):
    """All pairs share a term and tie; the table of pairs has 90,000 rows."""
    items = table(spark, {i: {"the": 1.0, f"a{i % 2}": 1.0} for i in range(300)})
    made_of = sparse._block_nearest(items, "id", items, "id", 2, "cosine", "value", True)
    assert [r["item"] for r in made_of.where("q = 4").orderBy("rank").collect()] == [0, 2]
    assert " Join " not in made_of._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


# ---------------------------------------------------------------- hashing

def code_of(row, bits, seed):
    out = 0
    for b in range(bits):
        side = sum(-v if int(hashlib.md5(f"{seed}:{t}".encode()).hexdigest()[:15], 16) >> b & 1 else v for t, v in row.items())
        out = out * 2 + (round(side, 9) >= 0)
    return out


@pytest.mark.parametrize("bits, seed", [(16, 143), (1, 0), (60, 7)])
def test_codes(spark, bits, seed):
    rows = made(80, 30, 2)
    got = {r["id"]: r["code"] for r in sparse.sparse_codes(table(spark, rows), "id", bits, seed).collect()}
    assert got == {i: code_of(x, bits, seed) for i, x in rows.items()}


def test_codes_follow_the_angle(spark):
    """The share of differing bits is the angle over pi, as with any random hyperplanes."""
    rng = np.random.default_rng(1)
    a, noise = rng.random(400), rng.random(400)
    rows = {j: {f"w{i}": float(x) for i, x in enumerate(v)} for j, v in enumerate((a, a + 0.3 * noise, rng.permutation(a), noise))}
    codes = {r["id"]: r["code"] for r in sparse.sparse_codes(table(spark, rows), "id", 60, 3).collect()}
    dense = {j: np.array(list(v.values())) for j, v in rows.items()}
    for j in (1, 2, 3):
        angle = math.acos(dense[0] @ dense[j] / np.linalg.norm(dense[0]) / np.linalg.norm(dense[j]))
        assert abs(bin(codes[0] ^ codes[j]).count("1") / 60 - angle / math.pi) < 0.2
    with pytest.raises(ValueError):
        sparse.sparse_codes(table(spark, rows), "id", 61)


@pytest.mark.parametrize("radius", [0, 2, 8])
def test_lsh_neighbours(spark, radius):
    rows = made(150, 30, 4)
    bits = 8
    codes = {i: code_of(x, bits, 143) for i, x in rows.items()}
    queries = {i: rows[i] for i in range(0, 150, 10)}
    got = sparse.sparse_lsh_nearest(table(spark, queries), "id", table(spark, rows), "id", 4, bits, radius).collect()
    out = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        out[r["id"]].append((r["item_id"], r["distance"], r["candidates"]))
    for q, x in queries.items():
        near = {i: rows[i] for i in rows if i != q and bin(codes[i] ^ codes[q]).count("1") <= radius}
        want = brute({q: x}, near, 4, "cosine")[q]
        assert [(i, pytest.approx(d, abs=1e-9)) for i, d, _ in out.get(q, [])] == want and all(n == len(near) for _, _, n in out.get(q, []))


# ---------------------------------------------------------------- clusters

def lloyd(rows, centres, rounds=500):
    dot = lambda a, b: sum(v * b.get(t, 0.0) for t, v in a.items())
    before, history = None, []
    for _ in range(rounds + 1):
        own = {i: min((max(dot(x, x) - 2 * dot(x, c) + dot(c, c), 0.0), k) for k, c in enumerate(centres)) for i, x in rows.items()}
        history.append(sum(d for d, _ in own.values()))
        members = {i: k for i, (_, k) in own.items()}
        if members == before:
            break
        before = members
        for k in range(len(centres)):
            mine = [rows[i] for i in rows if members[i] == k]
            if mine:
                total = defaultdict(float)
                for x in mine:
                    for t, v in x.items():
                        total[t] += v
                centres[k] = {t: v / len(mine) for t, v in total.items()}
    return centres, own, history


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_sparse_lloyd(spark, limit):
    rows = made(120, 25, 6)
    starts = [dict(rows[i]) for i in (0, 1, 2, 121, 60)]
    # Cluster 3 equals cluster 1, so it is empty at first; cluster 5 lies far from all rows and stays so.
    starts.append({"nobody": 900.0})
    start = spark.createDataFrame([(k, t, v) for k, c in enumerate(starts) for t, v in c.items()], "cluster int, term string, value double")
    got = kmeans.sparse_lloyd(table(spark, rows), "id", start, 6, broadcast_bytes=limit)
    centres, own, history = lloyd(rows, [dict(c) for c in starts])
    assert {r["id"]: r["cluster"] for r in got.assigned.collect()} == {i: k for i, (_, k) in own.items()}
    made_of = defaultdict(dict)
    for r in got.centroids.collect():
        made_of[r["cluster"]][r["term"]] = r["value"]
    assert {k: pytest.approx(c) for k, c in enumerate(centres)} == dict(made_of)
    assert got.history == pytest.approx(history) and got.heterogeneity == got.history[-1] and set(got.empty) == set(range(6)) - {k for _, k in own.values()} == {5}


def test_sparse_lloyd_stops_at_the_cap_and_starts_are_rows(spark):
    rows = made(60, 25, 8)
    bag = table(spark, rows)
    start = kmeans.sparse_start(bag, "id", 4, seed=2)
    picked = sorted(rows, key=lambda i: (hashlib.md5(f"2:{i}".encode()).hexdigest(), i))[:4]
    assert {(r["cluster"], r["term"], r["value"]) for r in start.collect()} == {(k, t, v) for k, i in enumerate(picked) for t, v in rows[i].items()}
    got = kmeans.sparse_lloyd(bag, "id", start, 4, max_iter=1)
    _, own, history = lloyd(rows, [dict(rows[i]) for i in picked], 1)
    assert got.history == pytest.approx(history) and len(history) == 2


def test_sparse_assign_makes_no_row_for_clusters_that_share_nothing(spark):
    """Of a thousand rows and fifty clusters only pairs with a common term are joined."""
    rows = {i: {f"t{i % 50}": 1.0} for i in range(1000)}
    centroids = spark.createDataFrame([(k, f"t{k}", 1.0 + k) for k in range(50)], "cluster int, term string, value double")
    got = kmeans.sparse_assign(table(spark, rows), "id", centroids)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    out = {r["id"]: (r["cluster"], r["squared_distance"]) for r in got.collect()}
    for i in rows:
        k = i % 50
        assert out[i] == min(((1.0 - (1.0 + k)) ** 2, k), (2.0, 0) if k else (0.0, 0))[::-1]


def test_hundred_centres_in_few_passes(spark, monkeypatch):
    """k-means||: 100 centres in 7 passes, at no more than 1.2 times the cost of k-means++, which takes 100."""
    rng = np.random.default_rng(4)
    homes = rng.standard_normal((100, 6)) * 8
    x = np.concatenate([h + rng.standard_normal((30, 6)) for h in homes])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(9000, None)], "id bigint, v array<double>")
    passes = []
    kind = type(df)
    real, agg = kind.mapInArrow, kind.agg
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: passes.append(1) or real(self, *a, **b))
    monkeypatch.setattr(kind, "agg", lambda self, *a, **b: passes.append(1) or agg(self, *a, **b))
    found = kmeans.parallel_start(df, "id", "v", 100, seed=1)
    assert len(found) == 100 and len(passes) == 7
    cost = lambda c: kmeans._nearest(x, c)[1].sum()
    careful = x[[0]]
    while len(careful) < 100:
        d2 = kmeans._nearest(x, careful)[1]
        careful = np.vstack([careful, x[rng.choice(len(x), p=d2 / d2.sum())]])
    assert cost(found) < 1.2 * cost(careful)


def test_oversampling_of_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i % 3)]) for i in range(9)], "id bigint, v array<double>")
    points, sizes = kmeans.oversampled(df, "id", "v", 4, rounds=2)
    assert sorted({p for (p,) in points.tolist()}) == [0.0, 1.0, 2.0] and sizes.sum() == 9
    assert sorted(kmeans.parallel_start(df, "id", "v", 5)[:, 0].tolist()) == [0.0, 1.0, 2.0]
    assert len(kmeans.parallel_start(df.limit(0), "id", "v", 5)) == 0


# ---------------------------------------------------------------- logistic regression

def newton(x, y, strength):
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = w - strength * x.T @ ((y > 0) - p)
        step = np.linalg.solve(np.eye(len(w)) + strength * (x.T * (p * (1 - p))) @ x, g)
        w -= step
    s = y * (x @ w)
    return w, w @ w / 2 + strength * np.logaddexp(0, -s).sum()


@pytest.mark.parametrize("strength, piece", [(1.0, 1 << 16), (5.0, 7)])
def test_sparse_logistic_is_the_full_solve(spark, monkeypatch, strength, piece):
    monkeypatch.setattr(sparse_logistic, "PIECE", piece)
    rows = made(200, 40, 9)
    r = random.Random(3)
    y = {i: 1 if sum(v for t, v in x.items() if t in ("t2", "t5", "the")) + r.gauss(0, 2) > 3 else -1 for i, x in rows.items()}
    labels = spark.createDataFrame([*y.items(), (7000, 1), (7001, None), (None, 1)], "id bigint, y int")
    model = sparse_logistic.fit(table(spark, rows), "id", labels, "y", strength, tolerance=1e-9)
    terms = sorted({t for x in rows.values() for t in x})
    assert [r["term"] for r in model.vocabulary.orderBy("term_id").collect()] == terms
    ids = [*rows, 7000]
    x = np.array([[*(rows.get(i, {}).get(t, 0.0) for t in terms), 1.0] for i in ids])
    w, value = newton(x, np.array([y.get(i, 1) for i in ids]), strength)
    assert model.objective == pytest.approx(value, rel=1e-9)
    assert model.weights == pytest.approx(w[:-1], abs=1e-5) and model.intercept == pytest.approx(w[-1], abs=1e-5)
    assert all(b <= a for a, b in zip(model.history, model.history[1:], strict=False))
    best = [t.term for t in model.table().orderBy(F.desc("weight"), "term").limit(5).collect()]
    assert best == [terms[i] for i in np.argsort(-w[:-1])[:5]]
    scores = {r["id"]: r["score"] for r in model.score(table(spark, rows | {8000: {"unheard": 3.0}}), "id").collect()}
    assert scores[8000] == pytest.approx(model.intercept)
    assert [scores[i] for i in rows] == pytest.approx((x[:-1] @ w).tolist(), abs=1e-4)


def test_sparse_logistic_vocabulary_and_bounds(spark, monkeypatch):
    rows = made(100, 40, 10)
    labels = spark.createDataFrame([(i, 1 if i % 2 else -1) for i in rows], "id bigint, y int")
    model = sparse_logistic.fit(table(spark, rows), "id", labels, "y", least_rows=30)
    assert {r["term"] for r in model.vocabulary.collect()} == {t for t in {t for x in rows.values() for t in x} if sum(t in x for x in rows.values()) >= 30}
    empty = sparse_logistic.fit(table(spark, rows).limit(0), "id", labels, "y")
    assert len(empty.weights) == 0 and math.isfinite(empty.intercept)
    monkeypatch.setattr(sparse_logistic, "MOST_TERMS", 10)
    with pytest.raises(ValueError, match="cut the vocabulary"):
        sparse_logistic.fit(table(spark, rows), "id", labels, "y")


def test_lbfgs_on_a_bent_valley():
    """A convex function of very unequal curvature."""
    scale = np.geomspace(1, 1e4, 30)
    f = lambda x: (float((scale * (x - 1) ** 2).sum() + ((x - 1) ** 4).sum()), 2 * scale * (x - 1) + 4 * (x - 1) ** 3)
    x, history = sparse_logistic.lbfgs(f, np.zeros(30), 500, 1e-12)
    assert x == pytest.approx(np.ones(30), abs=1e-4) and history[-1] < 1e-9


# ---------------------------------------------------------------- sums of many tasks

def test_ten_thousand_partitions_send_one_row_a_model(spark):
    parts = spark.range(0, 20_000, 1, 10_000).select((F.col("id") % 2).cast("int").alias("model"), F.spark_partition_id().alias("part"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("sums"), F.array("id").alias("whole"))
    out = reduce.added(parts, ["model"], ["sums", "whole"], 10_000).collect()
    assert len(out) == 2
    for r in out:
        own = range(r["model"], 20_000, 2)
        assert r["sums"] == [float(sum(own)), float(len(own))] and r["whole"] == [sum(own)]


def test_long_sums_of_few_tasks_are_added_on_the_executors(spark):
    """Seven tasks of 5,000 numbers: one row of the sum comes back, not seven."""
    parts = spark.range(7).select(F.lit(0).alias("piece"), F.col("id").cast("int").alias("part"), F.sequence(F.lit(1), F.lit(5000)).cast("array<double>").alias("sums"))
    long, short = (reduce.added(parts, ["piece"], ["sums"], 7, width) for width in (5000, 10))
    assert (long.count(), short.count()) == (1, 7)
    assert reduce.collected(parts, ("piece",), ("sums",), 7, 5000)[0,][0].tolist() == [7.0 * i for i in range(1, 5001)]


def test_long_sums_of_few_tasks_take_few_tasks(spark):
    """Seven tasks of 5,000 numbers are added by one task, with keys or without; a pass of sparse regression over 60 partitions of few rows is one task, and gives the same."""
    parts = spark.range(7).select(F.lit(0).alias("piece"), F.col("id").cast("int").alias("part"), F.sequence(F.lit(1), F.lit(5000)).cast("array<double>").alias("sums"))
    for keys in (["piece"], []):
        out = reduce.added(parts, keys, ["sums"], 7, 5000)
        assert out.rdd.getNumPartitions() == 1 and [r["sums"] for r in out.collect()] == [[7.0 * i for i in range(1, 5001)]]
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, 1).otherwise(-1).alias("y"), F.when(F.col("id") > 4, F.array((F.col("id") % 7).cast("int"), F.lit(8))).otherwise(F.array().cast("array<int>")).alias("ids"), F.when(F.col("id") > 4, F.array(F.lit(1.0), F.col("id") / 300)).otherwise(F.array().cast("array<double>")).alias("vals"))
    w = np.linspace(-1, 1, 10)
    packed = sparse_logistic.packed(rows.repartition(60))
    objective = sparse_logistic.Objective(packed, 9, 2.0)
    value, slope = objective(w)
    x, y = np.zeros((300, 10)), np.where(np.arange(300) % 3 == 0, 1, -1)
    x[:, 9] = 1
    x[np.arange(5, 300), np.arange(5, 300) % 7], x[5:, 8] = 1, np.arange(5, 300) / 300
    assert objective.tasks == 1 and value == pytest.approx(w @ w / 2 + 2 * np.logaddexp(0, -y * (x @ w)).sum())
    assert slope == pytest.approx(w - 2 * x.T @ (y / (1 + np.exp(y * (x @ w)))))


def test_sums_are_the_same_in_one_level_and_two(spark):
    rng = np.random.default_rng(2)
    rows = [(int(m), p, rng.random(3).tolist()) for m in range(3) for p in range(200)]
    df = spark.createDataFrame(rows, "model int, part int, sums array<double>").repartition(9)
    few, many = (reduce.collected(df, ("model",), ("sums",), t) for t in (1, 200))
    want = {(m,): np.sum([s for x, _, s in rows if x == m], axis=0) for m in range(3)}
    assert set(few) == set(many) == set(want)
    for m in want:
        assert few[m][0] == pytest.approx(want[m]) and many[m][0] == pytest.approx(want[m])
    again = reduce.collected(df.repartition(4), ("model",), ("sums",), 200)
    assert all((again[m][0] == many[m][0]).all() for m in want)
    whole = reduce.collected(df.drop("model"), (), ("sums",), 600)[()][0]
    assert whole == pytest.approx(sum(want.values()))
    assert reduce.collected(df.limit(0), ("model",), ("sums",), 200) == {}


def test_wrapping_integers():
    batch = pa.RecordBatch.from_pydict({"k": [1, 1], "h": [[2**63 - 1], [5]]}, schema=pa.schema([("k", pa.int32()), ("h", pa.list_(pa.int64()))]))
    (out,) = reduce._added(iter([batch]), ["k"], ["h"])
    assert out.column("h")[0].as_py() == [-(2**63) + 4]


def test_ascent_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [([1.0, float(a), float(b)], 1 if a + b > 0 else -1) for a, b in rng.standard_normal((400, 2))]
    df = spark.createDataFrame(rows, "f array<double>, y int")
    few = logistic.ascent(logistic.prepared(df.coalesce(2), F.col("f"), "y"), [0.0] * 3, 0.01, 3)[0]
    many = logistic.ascent(logistic.prepared(df.repartition(100), F.col("f"), "y"), [0.0] * 3, 0.01, 3)[0]
    assert few == pytest.approx(many)


def test_discard(spark):
    a = stored(spark.range(5), "here")
    discard(a, None, spark.range(3))
    with pytest.raises(Exception, match="(?i)not.exist|no such|PATH_NOT_FOUND"):
        spark.read.parquet(a._stored_at).count()


def test_bins_of_sparse_codes(spark):
    rows = made(80, 30, 2)
    got = {r["code"]: r["size"] for r in neighbors.bins(sparse.sparse_codes(table(spark, rows), "id", 4), "id").collect()}
    assert sum(got.values()) == len(rows)


@pytest.mark.parametrize("cells", [1 << 20, 12])
def test_sparse_lloyd_joins_no_rows_in_its_rounds(spark, monkeypatch, cells):
    """Rows are packed once, and a round is one pass; terms beyond the dense ones, zeros and emptied clusters count like others."""
    monkeypatch.setattr(kmeans, "DENSE_CELLS", cells)
    monkeypatch.setattr(kmeans, "sparse_assign", lambda *a, **b: pytest.fail("rows were joined"))
    rows = made(120, 25, 9)
    for i in rows:
        rows[i]["zero"] = 0.0
    starts = [dict(rows[i]) for i in (0, 1, 2, 1)] + [{"nobody": 900.0}]
    start = spark.createDataFrame([(k, t, v) for k, c in enumerate(starts) for t, v in c.items()], "cluster int, term string, value double")
    got = kmeans.sparse_lloyd(table(spark, rows), "id", start, 5)
    centres, own, history = lloyd(rows, [dict(c) for c in starts])
    assert {r["id"]: r["cluster"] for r in got.assigned.collect()} == {i: k for i, (_, k) in own.items()}
    made_of = defaultdict(dict)
    for r in got.centroids.collect():
        made_of[r["cluster"]][r["term"]] = r["value"]
    assert {k: pytest.approx(c) for k, c in enumerate(centres)} == dict(made_of)
    assert got.history == pytest.approx(history) and set(got.empty) == set(range(5)) - {k for _, k in own.values()}

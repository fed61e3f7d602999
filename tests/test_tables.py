import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import distance, features, text
from millrace.operators import neighbors, splits
from millrace.sources import io
from millrace.streaming import online


@pytest.mark.parametrize("parts", [1, 7])
def test_splits_are_exact_and_repeatable(spark, parts):
    df = spark.range(101).repartition(parts)
    train, test = splits.train_test_split(df, "id", 0.2, seed=4)
    assert (train.count(), test.count()) == (80, 21) and train.intersect(test).count() == 0
    again = splits.train_test_split(spark.range(101), "id", 0.2, seed=4)[1]
    assert {r[0] for r in test.collect()} == {r[0] for r in again.collect()}
    assert [r["fold"] for r in splits.contiguous_folds(spark.range(7).repartition(parts), ["id"], 3).orderBy("id").collect()] == [0, 0, 1, 1, 2, 2, 2]
    assert sorted(r["shuffle_rank"] for r in splits.shuffle_rank(df, "id").collect()) == list(range(101))
    assert [r["row_rank"] for r in splits.value_rank(df, ["id"]).orderBy("id").collect()] == list(range(101))


@pytest.mark.parametrize("parts", [1, 4])
def test_ranks_of_null_string_and_equal_keys(spark, parts):
    rows = [(i if i % 3 else None, ["b", "a", "é", None][i % 4], i) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, s string, n int").repartition(parts)
    train, test = splits.train_test_split(df, "id", 0.4)
    assert (train.count(), test.count()) == (36, 24) and sorted(r["n"] for r in train.unionByName(test).collect()) == list(range(60))
    ranked = splits.value_rank(df, ["s", "n"], "place").collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[2]))
    assert {r["n"]: r["place"] for r in ranked} == {n: k for k, (_, _, n) in enumerate(want)}
    same = splits.value_rank(spark.createDataFrame([("x",)] * 50, "s string").repartition(parts), ["s"], "place")
    assert sorted(r["place"] for r in same.collect()) == list(range(50))
    assert sorted(r["place"] for r in io.with_row_id(df.where("id is null"), ["id"], "place").collect()) == list(range(20))
    assert [splits.balanced(df.withColumn("y", (F.col("n") % 5 == 0).cast("int")), "id", "y", 1).where(f"y = {y}").count() for y in (0, 1)] == [12, 12]
    assert splits.value_rank(df.limit(0), ["s"]).collect() == []


def test_balance_and_index_split(spark):
    df = spark.createDataFrame([(i, 1 if i % 5 else -1) for i in range(50)], "id int, y int")
    assert {r["y"]: r["count"] for r in splits.balanced(df, "id", "y", -1).groupBy("y").count().collect()} == {1: 10, -1: 10}
    a, b = splits.index_split(df, "id", spark.createDataFrame([(3,), (4,), (99,)], "value int"))
    assert (a.count(), b.count()) == (2, 48)
    assert splits.contiguous_folds(df.limit(0), ["id"], 3).count() == 0 and splits.train_test_split(df.limit(0), "id", 0.5)[0].count() == 0


def test_distances(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0]), ([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(*(f(F.col("a"), F.col("b")).alias(n) for n, f in distance.METRICS.items())).collect()
    assert (rows[0]["manhattan"], rows[0]["euclidean"], rows[0]["cosine"]) == (7, 5, 1.0)
    assert rows[1]["cosine"] == pytest.approx(0.2928932188134525, abs=1e-15)


@pytest.mark.parametrize("metric", list(distance.METRICS))
def test_neighbours_against_numpy(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(i)) for i, v in enumerate(x)], "id bigint, v array<double>, y double")
    q = df.where("id < 7")
    got = {(r["id"], r["rank"]): (r["item_id"], r["distance"]) for r in neighbors.k_nearest(q, "id", "v", df, "id", "v", 4, metric, skip_same_id=True).collect()}
    for i in range(7):
        near = neighbors.nearest_to(df.where(F.col("id") != i), "id", "v", x[i].tolist(), 4, metric).collect()
        assert [got[i, k + 1][1] for k in range(4)] == pytest.approx([r["distance"] for r in near])
        if metric != "cosine":
            assert [got[i, k + 1][0] for k in range(4)] == [r["id"] for r in near]
    assert neighbors.k_nearest(q, "id", "v", df.limit(2), "id", "v", 9).count() == 14 and neighbors.k_nearest(q.limit(0), "id", "v", df, "id", "v", 2).count() == 0
    blocks = {(r["id"], r["rank"]): (r["item_id"], r["distance"]) for r in neighbors.k_nearest(q, "id", "v", df, "id", "v", 4, metric, skip_same_id=True, block=3).collect()}
    assert blocks == got
    scores = neighbors.choose_k(q, "id", "v", "y", df.where("id >= 7"), "id", "v", "y", most=5, metric=metric).collect()
    assert sorted(r["k"] for r in scores) == [1, 2, 3, 4, 5]


def test_hashing(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    planes = neighbors.Hyperplanes.random(8, 6, 1)
    index = neighbors.hashed(df, "v", planes)
    assert {r["id"]: r["code"] for r in index.collect()} == {i: planes.code_of(v) for i, v in enumerate(x)}
    assert neighbors.Hyperplanes(np.array([[1.0], [-1.0], [1.0]])).code_of([1.0]) == 5
    assert spark.range(1).select(neighbors.hamming(F.lit(5).cast("bigint"), 6).alias("h")).first()["h"] == 2
    counts = [neighbors.lsh_query(index, "id", "v", planes, x[0].tolist(), 5, r)[1] for r in range(7)]
    assert counts == sorted(counts) and counts[-1] == 200
    study = {r["radius"]: r for r in neighbors.radius_study(index, "id", "v", planes, x[0].tolist(), 5).collect()}
    assert [study[r]["candidates"] for r in range(7)] == counts
    near = neighbors.lsh_query(index, "id", "v", planes, x[0].tolist(), 5, 6)[0].collect()
    assert study[6]["max_distance"] == pytest.approx(near[-1]["distance"])
    pairs = neighbors.probe_many(index, index.select(F.col("id").alias("q"), F.col("code").alias("query_code")), 6, 2)
    codes = [planes.code_of(v) for v in x]
    assert pairs.count() == sum(bin(a ^ b).count("1") <= 2 for a in codes for b in codes)


def test_words(spark):
    df = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, None), (3, "It's; fine! Fine")], "doc_id int, text string")
    bag = text.bag_of_words(df.where("doc_id < 2"), "doc_id", text.split_words(F.col("text")))
    raw = {(r["doc_id"], r["term"]): r["value"] for r in text.tf_idf(bag, "doc_id").collect()}
    assert raw[0, "a"] == pytest.approx(1.3862943611198906) and raw[0, "b"] == 0
    smooth = {(r["doc_id"], r["term"]): r["value"] for r in text.tf_idf(bag, "doc_id", "smooth").collect()}
    assert sum(v * v for (d, _), v in smooth.items() if d == 0) == pytest.approx(1)
    assert {(r["term"]): r["value"] for r in text.tf_idf(bag, "doc_id", "ml").collect()}["c"] == pytest.approx(math.log(3 / 2))
    row = df.select(text.remove_punctuation(F.col("text")).alias("clean"), text.count_word(F.col("text"), "a").alias("n"), text.length_in_words(F.lit("a  b")).alias("l"), text.tokens(F.col("text"), min_length=2).alias("t")).collect()
    assert row[3]["clean"] == "Its fine Fine" and [r["n"] for r in row] == [2, 0, 0, 0] and row[0]["l"] == 3 and row[3]["t"] == ["it", "fine", "fine"]
    assert text.common_terms(bag, "doc_id", 0, 1).first()["term"] == "b"
    assert {r["doc_id"]: r["terms"] for r in text.as_maps(bag, "doc_id", "tf").collect()}[0] == {"a": 2, "b": 1}
    assert [r["term"] for r in text.top_terms(bag, "doc_id", "tf", 1).orderBy("doc_id").collect()] == ["a", "b"]
    assert text.map_terms(text.as_maps(bag, "doc_id", "tf"), "doc_id").count() == 4 and text.within_vocabulary(bag, bag.where("term = 'c'")).count() == 1


def test_bags_of_repeated_ids_nulls_and_many_rows(spark):
    df = spark.createDataFrame([(1, "b a b"), (None, "a"), (2, None), (3, ""), (1, "a c"), (None, "a d")], "doc_id int, text string").repartition(4)
    got = sorted(((r["doc_id"] or 0, r["term"], r["tf"]) for r in text.bag_of_words(df, "doc_id", text.split_words(F.col("text"))).collect()))
    assert got == [(0, "a", 2), (0, "d", 1), (1, "a", 2), (1, "b", 2), (1, "c", 1)]
    once = text.bag_of_words(df.where("doc_id > 1 or text = 'a c'"), "doc_id", text.split_words(F.col("text")))
    assert "Exchange hashpartitioning" not in once._jdf.queryExecution().executedPlan().toString()
    # Equal words in several documents of one batch stay apart.
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("x x y z"), F.col("id") % 3).alias("text"))
    assert text.bag_of_words(many, "doc_id", text.split_words(F.col("text"))).groupBy("tf").count().orderBy("tf").collect() == [(1, 1000), (2, 500)]


@pytest.mark.parametrize("room", [1 << 20, 60, 0])
def test_only_rows_of_rare_terms_are_exchanged(spark, room):
    """The vocabulary may exceed what is broadcast: its commonest terms still are."""
    bag = spark.createDataFrame([(d, t, 1 + d % 2) for d in range(32) for t in ("all", f"pair{d // 2}", f"own{d}")], "doc_id int, term string, tf bigint")
    got = {(r["doc_id"], r["term"]): r["value"] for r in text.tf_idf(bag, "doc_id", broadcast_bytes=room).collect()}
    df = {"all": 32, "pair": 2, "own": 1}
    assert len(got) == 96 and all(v == pytest.approx((1 + d % 2) * math.log(32 / df[t.rstrip("0123456789")])) for (d, t), v in got.items())
    plan = text.with_df(session.stored(bag, "bag"), session.stored(text.vocabulary(bag).select("term", "df"), "vocabulary"), room)._jdf.queryExecution().optimizedPlan().toString()
    assert ("rightHint=(strategy=merge)" in plan, "LeftAnti" in plan) == ((False, False) if room > 60 else (True, True))


def test_encodings(spark):
    df = spark.createDataFrame([(1, "x", 0.0), (2, "y", 5.0), (3, None, 10.0)], "id int, c string, v double")
    wide, names = features.one_hot(df, ["c"])
    assert names == ["c=x", "c=y"] and [tuple(r)[2:] for r in wide.orderBy("id").collect()] == [(1, 0), (0, 1), (0, 0)]
    edges = features.bin_edges(df, "v")
    assert [r[0] for r in df.orderBy("id").select(features.bin_of(F.col("v"), edges)).collect()] == [1, 6, 10]
    assert features.bin_names("v", edges)[-1][3] == "9.0 <= v <= 10.0" and len(features.one_hot_binned(df, "v")[1]) == 10
    assert features.one_hot_long(df, "id", ["c"]).count() == 2
    labels = features.label_from_flag(spark.createDataFrame([(0,), (1,), (None,)], "bad int"), "bad", "safe")
    assert [r["safe"] for r in labels.collect()] == [1, -1, -1]


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text('name,review,rating\n"a","say ""hi""\nthere",5\nb,,2\n')
    df = io.read_csv(spark, f"{tmp_path}/r.csv", {"name": str, "review": str, "rating": "int"})
    assert df.orderBy("name").first()["review"] == 'say "hi"\nthere' and df.na.fill({"review": ""}).where("review = ''").count() == 1
    (tmp_path / "n.csv").write_text("v\n1.5\nNaN\n")
    assert [r[0] for r in io.read_csv(spark, f"{tmp_path}/n.csv", {"v": float}).collect()] == [1.5, None]
    assert io.read_csv(spark, f"{tmp_path}/n.csv").count() == 2
    (tmp_path / "l.json").write_text(json.dumps([3, 1, 2]))
    (tmp_path / "m.json").write_text(json.dumps({"b": 1, "a": 0}))
    assert sorted(r[0] for r in io.read_json_list(spark, f"{tmp_path}/l.json").collect()) == [1, 2, 3]
    assert {tuple(r) for r in io.read_json_map(spark, f"{tmp_path}/m.json").collect()} == {("a", 0), ("b", 1)}
    np.savez(tmp_path / "s.npz", data=[1.0, 2.0, 3.0], indices=[0, 2, 1], indptr=[0, 2, 2, 3], shape=[3, 3])
    assert {tuple(r) for r in io.read_sparse_npz(spark, f"{tmp_path}/s.npz").collect()} == {(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.0)}
    assert io.read_arrays(spark, f"{tmp_path}/none") is None
    io.write_arrays(spark, {"c": np.arange(6.0).reshape(2, 3)}, f"{tmp_path}/model")
    assert io.read_arrays(spark, f"{tmp_path}/model")["c"].tolist() == [[0, 1, 2], [3, 4, 5]]
    assert [r["row_id"] for r in io.with_row_id(df.select("rating"), ["rating"]).orderBy("rating").collect()] == [0, 1]


def test_online_trainer_replays_and_resumes(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 1))
    y = np.where(x[:, 0] + 0.2 * rng.normal(size=120) > 0, 1, -1)
    for k in range(4):
        part = slice(30 * k, 30 * k + 30)
        spark.createDataFrame([(float(a[0]), int(b)) for a, b in zip(x[part], y[part], strict=True)], "a double, y int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    trainer = online.OnlineLogistic(spark, features.matrix("a"), "y", 2, step=1.0, store=f"{tmp_path}/model")
    trainer.run(online.replay(spark, f"{tmp_path}/in/*", "a double, y int"), f"{tmp_path}/checkpoint")
    assert trainer.weights[1] > 0.5 and len(trainer.history) == 4 and trainer.loss_curve().count() == 4
    again = online.OnlineLogistic(spark, features.matrix("a"), "y", 2, step=1.0, store=f"{tmp_path}/model")
    assert again.last == trainer.last and again.weights.tolist() == trainer.weights.tolist()
    again.learn(spark.createDataFrame([(1.0, 1)], "a double, y int"), 0)
    assert again.weights.tolist() == trainer.weights.tolist()


def test_intermediate_tables_go_with_the_application(tmp_path):
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {session.ROOT!r})
from pyspark.sql import SparkSession
from millrace.session import stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
print("rows", stored(spark.range(5), "numbers").count(), any(x.startswith("numbers-") for x in __import__("os").listdir("{tmp_path}/shared")))
"""
    told = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120).stdout
    assert "rows 5 True" in told
    for _ in range(60):  # the JVM ends a little later
        if not list((tmp_path / "shared").glob("numbers-*")):
            return
        time.sleep(0.5)
    raise AssertionError("the table is still there")

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import topk


def brute(rows, k, is_query):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, a) in enumerate(ok):
        if is_query(q):
            scored = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for other, (i, b) in enumerate(ok) if other != own))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, k=5, **options):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "score": F.lit(3)})
    return sorted(tuple(r) for r in topk.top_k(table.repartition(3), F.col("id") % 10 == 0, k, **options).collect())


@pytest.mark.parametrize("block", [4096, 3])
def test_against_brute_force(spark, block):
    r = random.Random(1)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 0.125, r.uniform(-1, 1)]) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]
    rows += [(300, None), (310, [None, 1.0, 1.0, 1.0]), (320, [float("nan"), 1.0, 1.0, 1.0]), (330, [float("inf"), 1.0, 1.0, 1.0]), (340, [0.0] * 4), (350, [0.5, 0.5]), (None, [1.0] * 4)]
    rows = [(i, v and [x if x is None or not math.isfinite(x) else float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows, query_block=block) == brute(rows, 5, lambda q: q % 10 == 0)


def test_fewer_candidates_than_k_large_scores_and_no_rows(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [-3.0])]
    assert run(spark, rows) == brute(rows, 5, lambda q: q % 10 == 0)
    big = [(i, [float(1 << (18 + i)), 1.0]) for i in range(8)]
    assert run(spark, big) == brute(big, 5, lambda q: q % 10 == 0)
    assert run(spark, [(1, [1.0])]) == [] and run(spark, [(0, [1.0])]) == [] and run(spark, [(0, None)]) == []


def test_rows_of_one_id_are_queries_and_candidates_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (10, [0.5, 0.5]), (1, [0.25, 1.0]), (1, [0.25, 1.0]), (7, [1.0, -1.0])]
    want = brute(rows, 3, lambda q: q % 10 == 0)
    for _ in range(3):
        random.shuffle(rows)
        assert run(spark, rows, 3, query_block=2) == want

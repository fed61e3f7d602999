import math

import numpy as np
import pytest

from millrace.llm import whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_numpy(rows, components=16, scale=64, offset=1_000_000):
    """Exact deviations by Python integers, pairs by a dense eigensolver."""
    fit = [(i, [math.floor(scale * float(np.float32(c))) + offset for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in fit})
    n, d = len(distinct), len(distinct[0])
    s = [sum(x[j] for x in distinct) for j in range(d)]
    y = np.array([[(n * x[j] - s[j]) / n for j in range(d)] for x in distinct])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = [(i, sum((n * x[j] - s[j]) ** 2 for j in range(d)), np.array([(n * x[j] - s[j]) / n for j in range(d)]) @ (vectors / np.sqrt(values))) for i, x in fit]
    return n, out, values / (y * y).sum() * n


def agree(got, want, components):
    n, rows, explained = want
    made = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-6
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        made.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    assert sum(len(v) for m in made.values() for v in m.values()) == len(rows) * components
    sign = {}
    for i, deviation, w in rows:
        own = made[(i, deviation)]
        assert sorted(own) == list(range(1, components + 1))
        for c in range(components):
            for value in own[c + 1]:
                if abs(w[c]) > 1e-3:
                    s = sign.setdefault(c, np.sign(value) * np.sign(w[c]))
                    assert value == pytest.approx(s * w[c], rel=1e-6, abs=1e-8)


@pytest.fixture
def vectors():
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((24, 24)) * np.geomspace(3, 0.05, 24)[:, None]
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((300, 24)) @ mix).astype(np.float32).tolist())]
    # Copies, a hot vector, repeated and null ids.
    return rows + [(1000 + i, rows[5][1]) for i in range(150)] + [(7, rows[7][1]), (None, rows[8][1]), (None, rows[8][1]), (7, rows[9][1])]


def test_against_numpy(spark, vectors):
    odd = [(2000, None), (2001, []), (2002, [None] * 24), (2003, [float("nan")] * 24), (2004, [float("inf")] + [0.0] * 23), (2005, [1.0] * 5)]
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors + odd], SCHEMA).repartition(5)
    got = whiten.whiten(table)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    agree(got.collect(), by_numpy(vectors), 16)


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((50, 3)).astype(np.float32).tolist())]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).selectExpr("vec_id", "embedding", "'a' x", "1 n", "2 deviation", "3 part")
    agree(whiten.whiten(table).collect(), by_numpy(rows, 3), 3)


def test_rank_below_dimension(spark):
    """Constant and repeated columns: only what varies is a component."""
    rng = np.random.default_rng(5)
    base = rng.integers(-9, 9, (60, 4)) / 4
    rows = [(i, [*map(float, v), 2.5, float(v[0]), 0.0]) for i, v in enumerate(base)]
    got = whiten.whiten(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)).collect()
    agree(got, by_numpy(rows, 4), 4)
    assert sum({r["component"]: r["explained"] for r in got}.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_varies(spark, rows):
    got = whiten.whiten(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA))
    assert got.collect() == [] and got.columns[:2] == ["vec_id", "component"]


def test_beyond_64_bits(spark):
    """Sizes whose deviations do not fit 64 bits: exact where they fit, else null; the components stand."""
    rows = [(i, [float(i) * 2.0**40, float(i % 3)]) for i in range(9)] + [(9, [4.0 * 2.0**40, 0.0])]
    got = whiten.whiten(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)).collect()
    n, want, _ = by_numpy(rows, 2)
    exact = {i: d if d < 1 << 63 else None for i, d, _ in want}
    assert {r["vec_id"]: r["deviation"] for r in got} == exact and None in exact.values()
    assert all(math.isfinite(r["whitened"]) for r in got)


@pytest.mark.parametrize("d, k", [(8, 8), (40, 5), (200, 16), (60, 1)])
def test_leading_pairs(d, k):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.sort(rng.uniform(0, 1, d) ** 3)[::-1] * 1e6
    m = (q * values) @ q.T
    passes = []

    def multiply(block):
        assert block.shape[1] <= k and np.allclose(block.T @ block, np.eye(block.shape[1]), atol=1e-12)
        passes.append(block.shape[1])
        return m @ block

    got, vectors = whiten.leading_pairs(multiply, d, k)
    assert got == pytest.approx(values[:k], rel=1e-9)
    assert np.linalg.norm(m @ vectors - vectors * got, axis=0).max() < 1e-12 * values[0]
    assert sum(passes) <= d


def test_breakdown_restarts():
    """The identity on 12 of 30 dimensions closes each Krylov space at once; restarts find all of it."""
    m = np.diag([5.0] * 12 + [0.0] * 18)
    values, vectors = whiten.leading_pairs(lambda b: m @ b, 30, 4)
    assert values == pytest.approx([5.0] * 4) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-10)
    values, _ = whiten.leading_pairs(lambda b: m @ b, 30, 14)
    assert values == pytest.approx([5.0] * 12 + [0.0] * 2, abs=1e-9)

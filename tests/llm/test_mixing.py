import re
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, budget, out = set(order), share * sum(sizes.values()), {}
    while left:
        over = [s for s in left if budget * w[s] / sum(w[x] for x in left) > cap * sizes[s]]
        if not over:
            return out | {s: budget * w[s] / sum(w[x] for x in left) for s in left}
        for s in over:
            out[s] = cap * sizes[s]
        budget -= sum(out[s] for s in over)
        left -= set(over)
    return out


def rows_of(words):
    sources = ["b", "a", "Z", None, "é", "hot"]
    return [(i, words(1 + i % 23, i) if i % 29 else (None if i % 2 else ""), "en", sources[i % 6] if i % 3 else "hot") for i in range(400)]


def test_targets_and_taken_words(docs, words):
    rows = rows_of(words)
    sizes, per = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}, defaultdict(int)
    for i, _, _, s in rows:
        per[s] += sizes[i]
    want = brute_targets(per)
    out = mixing.plan(docs(rows), schedules=mixing.tilted(), range_rows=10).collect()
    taken = defaultdict(int)
    for r in out:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == per[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and 0 <= r["position"] <= 1
        taken[r["source"]] += r["taken"]
    assert len(out) == len(rows) and all(abs(taken[s] - int(t + 1e-9)) <= 1 for s, t in want.items())
    again = mixing.plan(docs(rows[::-1]).repartition(7), schedules=mixing.tilted(), range_rows=10)
    assert {(r["doc_id"], r["taken"], r["position"]) for r in again.collect()} == {(r["doc_id"], r["taken"], r["position"]) for r in out}


def test_position_inverts_the_integrated_schedule(spark):
    knots = ((0.0, 1.0), (0.25, 3.0), (0.5, 0.0), (1.0, 2.0))

    def integral(t):
        total = 0.0
        for (a, x), (b, y) in zip(knots, knots[1:], strict=False):
            e = min(max(t, a), b)
            at = x + (y - x) * (e - a) / (b - a)
            total += (e - a) * (x + at) / 2
        return total

    rows = spark.createDataFrame([(i / 50,) for i in range(51)], "d double").select("d", mixing.position(F.col("d"), knots).alias("t")).collect()
    for r in rows:
        assert abs(integral(r["t"]) - r["d"] * integral(1.0)) < 1e-9


def test_order_and_edges(clashing, docs, words):
    placed = mixing.sorted_by_position(mixing.plan(clashing([(i, words(5, i)) for i in range(50)] + [(3, words(5, 3)), (None, "a b")])))
    found = [r["position"] for r in placed.collect()]
    assert found == sorted(found) and len(found) == 52
    assert mixing.plan(docs([]).limit(0)).collect() == []
    assert [(r["target"], r["taken"]) for r in mixing.plan(docs([(1, None), (2, "")])).collect()] == [(0.0, 0)] * 2


def test_reruns_agree_for_one_id_with_several_texts(docs, words):
    rows = [(1, "a b c"), (1, "d e f g"), (1, "h i j"), (1, "a b c"), (2, words(7, 1)), (None, "k l"), (None, "m n o"), (None, None), (3, words(30, 2), "en", "t"), (1, "p q", "en", "t")]
    deals = [mixing.plan(docs(list(reversed(rows)) if n % 2 else rows).repartition(n).select("*"), schedules=mixing.tilted(), range_rows=2, keep=("text",)).collect() for n in (1, 2, 3, 5)]
    seen = [sorted((r["doc_id"] or -1, r["text"] or "", r["source"], r["taken"], r["position"]) for r in d) for d in deals]
    assert seen[0] == seen[1] == seen[2] == seen[3] and len(seen[0]) == len(rows)

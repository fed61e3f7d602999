import hashlib
import math
import re
import zlib

import pytest

from millrace.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, least, most):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def by_loops(docs, target, percent=10, least_words=20, seed=2024, least=1, most=1, buckets=10000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, wanted = [0] * buckets, [0] * buckets
    for texts, counts in ((docs, raw), (target, wanted)):
        for _, text in texts:
            for f in features(text, least, most):
                counts[bucket(f)] += 1
    s, t = sum(raw), sum(wanted)
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text, least, most)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    fit = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = len(fit) * percent // 100
    out = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(fit)]
    return out + [(*r[:4], None) for r in rows if r[4] < least_words]


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture
def corpus(docs, words):
    rows = [(i, words(5 + i % 60, seed=i) + ("" if i % 3 else " Straße ÉCOLE 日本語 a1_b2")) for i in range(80)]
    rows += [(None, words(40, seed=3)), (None, words(40, seed=3)), (None, None), (90, None), (91, ""), (92, " \n .,"), (7, words(30, seed=70)), (7, words(30, seed=70)), (93, "Ka lo " * 30000)]
    return rows


@pytest.mark.parametrize("least, most, buckets", [(1, 1, 10000), (1, 2, 500), (2, 3, 97)])
def test_against_loops(spark, docs, words, corpus, least, most, buckets):
    target = [(i, words(30, seed=i)) for i in range(0, 40, 3)] + [(None, None)]
    items = spark.createDataFrame(target, "item_id bigint, text string")
    got = resample.resample(docs(corpus), items, percent=30, least=least, most=most, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert order(got.collect()) == order(by_loops(corpus, target, percent=30, least=least, most=most, buckets=buckets))


def test_reruns_and_partitions_agree(spark, docs, corpus):
    items = spark.createDataFrame([(1, "ka lo mi")], "item_id bigint, text string")
    a = resample.resample(docs(corpus).repartition(7), items, percent=50)
    b = resample.resample(docs(corpus[::-1]).coalesce(1), items, percent=50)
    assert order(a.collect()) == order(b.collect())


def test_empty_tables(spark, docs, words):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert resample.resample(docs([]), none).collect() == []
    rows = [(i, words(25, seed=i)) for i in range(20)]
    assert order(resample.resample(docs(rows), none).collect()) == order(by_loops(rows, []))


def test_clashing_columns_and_drawn_rows(spark, clashing, words):
    rows = [(i, words(25, seed=i)) for i in range(40)]
    items = spark.createDataFrame([(1, words(25, seed=3), 5)], "item_id bigint, text string, bucket int")
    made = clashing(rows)
    got = resample.resample(made, items)
    assert order(got.collect()) == order(by_loops(rows, [(1, words(25, seed=3))]))
    kept = resample.drawn_documents(made, got)
    assert kept.columns == made.columns and kept.count() == 4


def test_native_plan(spark, docs, corpus):
    """No Python worker on the way, and one row a document in the shuffle after the sum."""
    items = spark.createDataFrame([(1, "ka lo mi")], "item_id bigint, text string")
    gain = resample.gains(resample.bucket_counts(docs(corpus), items).cache())
    plan = resample.weights(docs(corpus), gain)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "BroadcastHashJoin" in plan

import random

import numpy as np
import pytest

from millrace.llm import graph, neardup, quality


def shingles(text):
    w = [x for x in (text or "").encode().lower().decode("utf-8", "ignore").split()] if text is None or text.isascii() else text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                home[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(text, n, r):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("square", [512, 4])
def test_against_brute_force(docs, words, monkeypatch, square):
    monkeypatch.setattr(neardup, "SQUARE", square)
    r = random.Random(4)
    rows = [(i, words(r.randint(1, 90), i)) for i in range(40)]
    for base in range(0, 40, 4):
        for k in range(6):
            rows.append((100 + base * 10 + k, edited(rows[base][1], k, r)))
    chain = words(80, 77)
    for k in range(12):
        rows.append((900 + k, chain))
        chain = edited(chain, 2, r)
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE two"), (2005, "two one"), (2006, rows[0][1].upper()), (2007, rows[4][1])]
    out = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(docs(rows)).collect()}
    want = brute([(i, t.lower() if t else t) for i, t in rows])
    assert out == want
    kept = {x["doc_id"] for x in neardup.near_duplicates(docs(rows)).where("kept").collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_signature_distance_follows_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 800).astype(np.uint64)
    b = np.concatenate((a[:700], rng.integers(0, 1 << 63, 100).astype(np.uint64)))
    same = (neardup.signature(a) == neardup.signature(b)).mean()
    assert abs(same - 700 / 900) < 0.2 and (neardup.signature(a) == neardup.signature(a[::-1].copy())).all()


def test_keys_meet_every_pair_up_to_the_threshold(spark):
    r = random.Random(6)
    base = [r.randrange(1 << 16) for _ in range(neardup.SYMBOLS)]
    rows = [(0, base)]
    for distance in range(1, neardup.TOLERANCE + 1):
        # At random, and spread as evenly over the chunks as can be.
        spread = [c * neardup.CHUNK + k for k in range(neardup.CHUNK) for c in range(neardup.SYMBOLS // neardup.CHUNK)][:distance]
        for at in (r.sample(range(neardup.SYMBOLS), distance), spread):
            other = list(base)
            for i in at:
                other[i] ^= 1
            rows.append((len(rows), other))
    keys = neardup._keys(spark.createDataFrame(rows, "rep bigint, sig array<int>"))
    first = keys.where("rep = 0").select("key")
    assert keys.join(first, "key").select("rep").distinct().count() == len(rows)


def test_exact_mode_agrees(docs, words):
    r = random.Random(9)
    rows = [(i, words(r.randint(5, 60), i)) for i in range(12)]
    rows += [(50 + i, edited(t, 1 + i % 3, r)) for i, t in rows]
    got = [sorted(tuple(x) for x in neardup.near_duplicates(docs(rows), exact=e).collect()) for e in (False, True)]
    assert got[0] == got[1] and {x[0]: (x[1], x[2]) for x in got[1]} == brute(rows)


def replaced(text, similarity, r):
    """A copy with a run of words replaced, so that the sets have about the wanted similarity: (n - m) / (n + m) of n shingles."""
    w = text.split()
    m = int(len(w) * (1 - similarity) / (1 + similarity)) - 5
    at = r.randrange(0, len(w) - m)
    return " ".join(w[:at] + [f"n{r.randrange(10**9)}" for _ in range(m)] + w[at + m :])


def test_recall_of_long_near_copies(docs, words):
    """Sets of 300 to 5,000 shingles with copies of similarity 0.75 to 0.80: every link of the brute force is there."""
    r = random.Random(12)
    rows, linked = [], 0
    for k in range(48):
        base = words(r.choice([300, 700, 1500, 5000]), 3000 + k)
        rows.append((10 * k, base))
        # Two copies that differ from the first in other places: the group has more than a star of its least id.
        rows += [(10 * k + j, replaced(base, r.uniform(0.755, 0.80), r)) for j in (1, 2)]
    want = brute(rows)
    linked = sum(1 for i, (_, c) in want.items() if c != i)
    assert linked > 90
    out = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(docs(rows)).collect()}
    assert out == want


def test_bounds_of_large_sets_never_drop_a_link():
    """Counts of classes rule out what cannot be a link, and nothing else, also between a small and a large set and with full classes."""
    rng = np.random.default_rng(5)
    ruled_out = 0
    for n in (240, 300, 1200, 6000, 60000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets = [np.unique(base)]
        for share in (0.95, 0.87, 0.86, 0.855, 0.8, 0.7, 0.6):
            m = int(n * share)
            sets.append(np.unique(np.concatenate((base[:m], rng.integers(0, 1 << 63, n - m + n // 50).astype(np.uint64)))))
        sets.append(np.arange(n, dtype=np.uint64) * np.uint64(neardup.CELLS))
        sets.append(np.arange(n + n // 10, dtype=np.uint64) * np.uint64(neardup.CELLS))
        size = np.array([len(s) for s in sets])
        sketches = [s if len(s) <= neardup.SKETCH else neardup._cells(s) for s in sets]
        cells = np.stack([neardup._cells(s) for s in sets])
        for i in range(len(sets)):
            others = np.array([j for j in range(len(sets)) if j != i])
            may = neardup._may_link(i, others, size, sketches, cells, 75)
            for j, ok in zip(others.tolist(), may.tolist(), strict=True):
                linked = neardup._linked(sets[i], sets[j], 75)
                assert ok or not linked
                ruled_out += not ok
                if n < 256 * 0.9:
                    assert ok == linked
    assert ruled_out > 150


def test_one_id_with_different_texts(spark, docs, words):
    a, b, c = (words(60, k) for k in (1, 2, 3))
    rows = [(1, a), (1, b), (3, b + " more"), (7, c), (7, a), (2, c), (9, c.upper()), (4, words(60, 4))]
    want = sorted([(1, 1), (1, 1), (3, 1), (7, 2), (7, 1), (2, 2), (9, 2), (4, 4)])
    for parts in (1, 2, 3, 5):
        out = neardup.near_duplicates(docs(rows).repartition(parts)).collect()
        assert sorted((x["doc_id"], x["component_id"]) for x in out) == want
        first = sorted((x["doc_id"], x["component_id"]) for x in out if x["first"])
        assert first == [(1, 1), (1, 1), (2, 2), (4, 4)]


def test_pieces_of_a_long_text_give_the_same_set(monkeypatch, words):
    texts = [words(3000, 5), "one two", "  \n ", "", "x" * 5000, "a b c d e f " * 400 + "yz" * 999]
    sets = lambda t: next(neardup._shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])))
    whole = [sets(t).tolist() for t in texts]
    for size in (7, 64, 1000):
        monkeypatch.setattr(neardup.common, "BLOCK_BYTES", size)
        assert [sets(t).tolist() for t in texts] == whole


def test_memory_of_a_very_long_text():
    import tracemalloc

    data = np.frombuffer(b" ".join(b"%d" % (i * 7919 % 1000003) for i in range(3_000_000)), np.uint8)
    assert len(data) > 20_000_000
    for count in (lambda: neardup.signature(next(neardup._shingle_sets(data, np.array([0, len(data)])))), lambda: list(quality._counts(data, np.array([0, len(data)])))):
        tracemalloc.start()
        count()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 160 << 20


def test_repeated_rows_nulls_and_clashing_columns(clashing, words):
    t = words(30, 1)
    out = neardup.near_duplicates(clashing([(5, t), (5, t), (3, t), (None, t), (9, words(30, 2))])).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0, x["kept"]) for x in out) == [(0, 0, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]
    assert neardup.near_duplicates(clashing([]).limit(0)).collect() == []


def test_long_texts(docs, words):
    t = words(40_000, 3)
    out = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs([(2, t), (1, edited(t, 800, random.Random(1))), (3, words(40_000, 4))])).collect()}
    assert out == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (20, 20), (30, 31), (31, 30)]
    out = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 9: 1, **{i: 10 for i in range(10, 16)}, 30: 30, 31: 30}

import hashlib
import re

import numpy as np
import pytest

from millrace.llm import common, decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_loops(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    lengths, out = {len(w) for w in windows}, []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def table(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


@pytest.fixture
def corpus(words):
    shared = words(60, seed=1000)
    items = [(i, words(12 + i, seed=500 + i)) for i in range(12)] + [(20, shared), (21, "Intro. " + shared), (100, shared)]
    items += [(30, words(4, seed=77)), (31, words(1, seed=78)), (None, words(15, seed=90)), (None, None), (32, ""), (33, " .\n"), (20, words(11, seed=91)), (20, shared)]
    some = lambda i, a, b: " ".join(words(12 + i, seed=500 + i).split()[a:b])
    docs = [(i, words(30, seed=i)) for i in range(20)]
    # Whole passages, nine and ten words of one, two that meet, capitals and marks between.
    docs += [(50, words(20, seed=1) + " " + shared + " " + words(20, seed=2)), (51, words(9, seed=3) + " " + some(5, 2, 11)), (52, words(9, seed=4) + " " + some(5, 2, 12) + " end")]
    docs += [(53, some(3, 0, 10) + " " + some(4, 1, 12) + " x"), (54, "«" + some(6, 0, 14).upper().replace(" ", " -- \n\t") + "»"), (55, words(4, seed=77)), (56, f"a {words(1, seed=78)} b {words(1, seed=78)}")]
    docs += [(57, words(5, seed=6) + " " + words(15, seed=90)), (58, None), (59, ""), (60, ". ,"), (None, shared), (None, shared), (50, shared), (61, shared + " " + shared)]
    return docs, items


def test_against_loops(spark, docs, corpus):
    rows, items = corpus
    got = decontaminate.decontaminate(docs(rows), table(spark, items))
    assert got.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")]
    want = by_loops(rows, items)
    assert order(got.collect()) == order(want)
    # The planted cases are what they are meant to be (the marks « and » are part of the words beside them).
    hit = {r[0]: r[2] for r in want if r[0] is not None}
    assert hit[51] == 0 and hit[52] == 10 and hit[54] == 12 and hit[56] == 2


def test_narrower_windows(spark, docs, corpus):
    rows, items = corpus
    got = decontaminate.decontaminate(docs(rows).repartition(5), table(spark, items), width=6)
    assert order(got.collect()) == order(by_loops(rows, items, 6))


def test_long_texts_in_pieces(spark, docs, words, monkeypatch):
    """Every shared span is found wherever the cuts fall, also beside words longer than a piece."""
    shared = words(40, seed=9)
    text = " ".join((words(50, seed=i) if i % 4 else shared) + (" " + "q" * 700 if i % 7 == 0 else "") for i in range(40))
    items = [(1, shared), (2, " ".join(shared.split()[10:13])), (3, words(50, seed=5))]
    want = by_loops([(1, text)], items)[0]
    data = np.frombuffer(text.encode(), np.uint8)
    for size in (64, 257, 1000, 1 << 18):
        monkeypatch.setattr(common, "BLOCK_BYTES", size)
        bitmap = np.full(1 << 21, 0xFF, np.uint8)
        found = set()
        count = 0
        for piece in decontaminate._pieces(data, np.array([0, len(data)]), 10):
            count = piece[5] + len(piece[2])
            found |= {w[1:] for w in decontaminate._found(piece, [3, 10], 10, bitmap)}
        assert count == want[1]
        assert len(found) == 2 * count - 2 - 9 and {f[0] for f in found if f[1] == 10} == set(range(count - 9))
    monkeypatch.setattr(common, "BLOCK_BYTES", 1 << 18)
    big = text + " " + words(60000, seed=4) + " " + text
    got = decontaminate.decontaminate(docs([(1, big), (2, text)]), table(spark, items))
    assert order(got.collect()) == order(by_loops([(1, big), (2, text)], items))


def test_many_copies_and_common_windows(spark, docs, words):
    """A passage of half the items in half the documents: one class, one list."""
    shared = words(30, seed=1)
    items = [(i, shared + " " + words(12, seed=100 + i)) for i in range(60)]
    rows = [(i, (shared if i % 2 else words(20, seed=1000 + i)) + " tail" * (i % 3)) for i in range(200)]
    read, met, held = decontaminate.hits(docs(rows), table(spark, items))
    assert met.select("class").distinct().count() <= 2 and met.count() < 100 * 32
    assert order(decontaminate.decontaminate(docs(rows), table(spark, items)).collect()) == order(by_loops(rows, items))
    spans = decontaminate.hit_spans(docs([(7, shared)]), table(spark, items[:2])).collect()
    assert {(r["item"], r["first"], r["length"]) for r in spans} == {(str(i), k, 10) for i in (0, 1) for k in range(21)}


def test_empty_tables(spark, docs, words):
    assert decontaminate.decontaminate(docs([]), table(spark, [(1, words(20))])).collect() == []
    rows = [(1, words(20, seed=1)), (2, None)]
    for items in ([], [(1, None), (2, " . ")]):
        assert order(decontaminate.decontaminate(docs(rows), table(spark, items)).collect()) == order(by_loops(rows, items))


def test_clashing_columns(spark, clashing, words):
    shared = words(20, seed=5)
    items = table(spark, [(1, shared)]).selectExpr("item_id", "text", "1 name", "2 item", "3 length")
    rows = [(1, shared), (2, words(20, seed=6))]
    assert order(decontaminate.decontaminate(clashing(rows), items).collect()) == order(by_loops(rows, [(1, shared)]))


def test_equal_windows_have_equal_fingerprints(words):
    """The guarantee: a window's fingerprint depends on its words alone, and is a gram that both sides hold."""
    a, b = words(50, seed=1), words(50, seed=2)
    whole = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    starts, ends, _ = common.word_spans(whole, np.array([0, len(whole)]), decontaminate.BETWEEN)
    prints = decontaminate._fingerprints(common.span_hashes(whole, starts, ends), 10)
    assert (prints[:41] == prints[100:141]).all() and len(np.unique(prints[:41])) < 30

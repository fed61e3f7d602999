import random
from collections import Counter

import numpy as np

from millrace.llm import quality


def brute(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    cover = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_counts_against_brute_force(clashing):
    rnd = random.Random(2)
    parts = ["a", "b", "é", "漢字", "#", "|x|", "\n", "\n\n", " ", "\t", "\x0b", " ", "a b c a b", "line one\n", "\r\n"]
    texts = [None, "", " \n ", "a b c d e " * 9, "one\none\none", "x" * 70_000, *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 80))) for _ in range(200))]
    out = {r["doc_id"]: r for r in quality.rule_counts(clashing(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), t


def test_pieces_of_a_long_text_give_the_same_counts(monkeypatch):
    rnd = random.Random(3)
    parts = ["a", "é", "漢", "#", "\n", " ", "a b c d e ", "line one\n", "xyz" * 40]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 80))) for _ in range(60)]
    for size in (5, 17, 300):
        monkeypatch.setattr(quality.common, "BLOCK_BYTES", size)
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            assert tuple(quality._long_counts(data)[:5]) == brute(t)


def naive_anomaly(forest, row):
    """The path lengths of one row, tree by tree and node by node."""
    total = 0.0
    for tree in forest["trees"]:
        node = 0
        while tree["feature"][node] >= 0:
            node = tree["left"][node] + (row[tree["feature"][node]] >= tree["cut"][node])
        total += tree["value"][node]
    return 2 ** (-total / len(forest["trees"]) / forest["norm"])


def naive_features(text):
    n_words, _, symbols, dup, repeat = brute(text)
    lines = sum(bool(x.strip(" \t\r\x0b\x0c")) for x in text.split("\n"))
    raw = text.encode()
    upper, alpha = sum(65 <= b <= 90 for b in raw), sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 for b in raw)
    part = lambda a, b: min(a / max(b, 1), 1)
    return [part(symbols, n_words), part(dup, lines), part(repeat, n_words), part(upper, alpha), part(sum(b in b"!?" for b in raw), n_words)]


def test_verdicts_against_brute_force(docs, spark, words):
    table, labels = _model(docs, spark, words)
    model = quality.fit(table, labels)
    texts = {r["doc_id"]: r["text"] for r in table.collect()} | {5000: "LOUD WORDS EVERYWHERE! " * 3 + words(30, 1), 5001: "é ü " + words(40, 2), 5002: "a b", 5003: ""}
    out = {r["doc_id"]: r for r in quality.judge(docs(list(texts.items())), model).collect()}
    for i, t in texts.items():
        n, *_, repeat = brute(t)
        failed, score = n < 10 or 100 * repeat > 20 * n, naive_anomaly(model["forest"], naive_features(t))
        assert abs(out[i]["anomaly"] - score) < 1e-9 and out[i]["base_failed"] == failed
        assert out[i]["kept"] == (not failed and out[i]["anomaly"] <= model["threshold"])


def test_threshold_takes_both_labels():
    good, bad = np.array([0.2, 0.3, 0.4, 0.5]), np.array([0.1, 0.7, 0.9])
    both, label = np.concatenate((good, bad)), np.array([1] * 4 + [0] * 3)
    cut = quality.threshold(both, label, 0.0)
    assert 0.5 < cut < 0.7
    # One good row in four may go, but that catches no more bad rows: it stays.
    assert 0.5 < quality.threshold(both, label, 0.25) < 0.7
    assert 0.4 < quality.threshold(np.append(both, 0.45), np.append(label, 0), 0.25) < 0.45
    assert quality.threshold(good, np.ones(4), 0.0) == 0.5 and quality.threshold(bad, np.zeros(3)) == 2.0


def test_forest_isolates_what_no_good_row_is_like():
    rng = np.random.default_rng(1)
    good = rng.uniform(0, 0.05, (600, 5))
    forest = quality.grow(good)
    odd = np.array([[0.8, 0.01, 0.01, 0.02, 0.0], [0.01, 0.0, 0.0, 0.9, 0.9]])
    assert quality.anomaly(forest, odd).min() > np.quantile(quality.anomaly(forest, good), 0.99)
    assert quality.grow(good) == quality.grow(good)
    assert (quality.anomaly(quality.grow(good[:0]), odd) == 0).all()


def _model(docs, spark, words, n=120):
    rows = [(i, words(30 + i % 40, i)) for i in range(n)] + [(1000 + i, " ".join(w + "$$$" for w in words(40, i).split())) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)] + [(1000 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    return docs(rows), labels


def test_good_rows_stay_and_odd_ones_go(docs, spark, words):
    table, labels = _model(docs, spark, words)
    model = quality.fit(table, labels)
    kept = {r["doc_id"] for r in quality.judge(table, model).where("kept").collect()}
    assert len([i for i in kept if i < 1000]) >= 118 and not [i for i in kept if i >= 1000]


def test_edges(docs, spark, words):
    table, labels = _model(docs, spark, words)
    none = quality.fit(table, labels.limit(0))
    judged = {r["doc_id"]: r for r in quality.judge(docs([(1, None), (2, ""), (3, words(40)), (4, "same " * 40), (3, words(40))]), none).collect()}
    assert judged[1]["base_failed"] and judged[2]["base_failed"] and judged[4]["base_failed"] and judged[3]["kept"]
    assert quality.judge(table.limit(0), none).collect() == []
    assert quality.fit(table.limit(0), labels)["threshold"] == 2.0

import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import runindex


def brute(raw, length):
    """Kept bytes, removed bytes and spans of each text."""
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out.append((len(t), int(cover.sum()), spans, np.frombuffer(t, np.uint8)[~cover].tobytes()))
    return out


def test_index_against_brute_force():
    rnd = random.Random(3)
    for _ in range(150):
        length, letters = rnd.choice([3, 8, 20]), rnd.choice([b"ab", b"abcd", b"a\x00"])
        base = bytes(rnd.choice(letters) for _ in range(60))
        texts = []
        for _ in range(rnd.randint(1, 8)):
            t = bytearray()
            for _ in range(rnd.randint(0, 3)):
                a = rnd.randint(0, 50)
                t += base[a : a + rnd.randint(0, 30)] + bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 10)))
            texts.append(bytes(t))
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for t, runs in zip(texts, runindex.repeated_windows(texts, length), strict=True):
            got = {i for lo, hi in runs for i in range(lo, hi)}
            assert got == {i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1}


def test_index_is_smaller_on_repetitive_text():
    text = np.frombuffer(b"the same line again and again \xff" * 400, np.uint8)
    index = runindex.RunIndex(text)
    assert len(index.heads) < len(text) / 50
    assert len(index.chars) == len(index.first) == len(index.last) == len(index.heads)


def test_anchors_own_every_window_once():
    rnd = random.Random(1)
    raw = bytes(rnd.choice(b"abc ") for _ in range(5000))
    offs = np.array([0, 10, 1500, 1500, 5000])
    row, first, windows, anchor, _ = runindex.anchors(np.frombuffer(raw, np.uint8), offs, 50, 16)
    owned = Counter((r, f + i) for r, f, w in zip(row.tolist(), first.tolist(), windows.tolist(), strict=True) for i in range(w))
    assert set(owned) == {(r, i) for r in (1, 3) for i in range(offs[r + 1] - offs[r] - 49)} and set(owned.values()) == {1}


@pytest.mark.parametrize("most", [8192, 2])
def test_corpus_against_brute_force(docs, words, most):
    shared, line = words(60, 1), words(25, 2)
    rows = [(i, f"{words(10 + i)} {shared if i % 3 == 0 else ''} {line[: 90 + i]} {words(5)}") for i in range(24)]
    rows += [(100, rows[4][1]), (101, "é" * 300), (102, "é" * 250), (103, None), (104, ""), (105, "x" * 1000), (None, words(30, 9)), (106, words(30, 9))]
    out = runindex.remove_repeats(docs(rows), length=120, anchor=40, most=most).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in out}
    want = brute([(t or "").encode() for _, t in rows], 120)
    assert len(out) == len(rows) and got == {i: w for (i, _), w in zip(rows, want, strict=True)}
    assert got[4][1] > 0 and got[105][1] == 1000


def test_repeated_rows_long_texts_and_clashing_columns(clashing, words):
    long = words(40_000, 4)
    rows = [(1, long), (1, long), (2, words(50, 6))]
    out = {(r["doc_id"], r["n_removed"]) for r in runindex.remove_repeats(clashing(rows), as_text=True).collect()}
    assert out == {(1, len(long)), (2, 0)}


def test_block_edges_do_not_matter(words, monkeypatch):
    """A long row in pieces has the windows, anchors and contexts that it has as a whole, at every size of a piece."""
    data = np.frombuffer(words(3000, 8).encode(), np.uint8)
    offs = np.array([0, len(data)])

    def owned():
        out = {}
        for _, shift, part, part_offs in runindex._pieces(data, offs, 200):
            _, first, windows, anchor, _ = runindex.anchors(part, part_offs, 200, 64)
            for f, w, a in zip(first.tolist(), windows.tolist(), anchor.tolist(), strict=True):
                for i in range(w):
                    assert out.setdefault(shift + f + i, a) == a
        return out

    whole = owned()
    assert set(whole) == set(range(len(data) - 199))
    for size in (64, 333, 4096):
        monkeypatch.setattr(runindex, "BLOCK_BYTES", size)
        assert owned() == whole


def test_passage_of_a_long_row(docs, words):
    text = words(3000, 8)
    rows = [(1, text), (2, words(40, 9) + text[4000:9000])]
    whole = runindex.remove_repeats(docs(rows)).select("doc_id", "n_removed", "n_spans").collect()
    assert {r["n_removed"] for r in whole} == {5000}


def test_many_equal_rows_share_one_list_of_spans(docs, words):
    """Spans and contexts of rows equal in id and text do not multiply with the rows."""
    shared = words(40, 21)
    text = words(60, 20) + " " + shared
    rows = [(None, text)] * 2000 + [(1, words(30, 22) + shared), (2, words(30, 23) + shared)]
    spans = {(r["doc_id"], len(r["spans"])) for r in runindex.repeats(docs(rows).repartition(4)).select("doc_id", "spans").collect()}
    assert {i for i, _ in spans} == {None, 1, 2} and max(n for _, n in spans) < len(text)
    out = runindex.remove_repeats(docs(rows)).select("doc_id", "n_bytes", "n_removed").collect()
    assert len(out) == 2002 and all(r["n_removed"] == len(text) for r in out if r["doc_id"] is None)
    assert {r["doc_id"]: r["n_removed"] for r in out if r["doc_id"]} == {1: len(shared), 2: len(shared)}


def test_cut_characters_are_lost_whole(docs):
    """The shared 200 bytes end in the first byte of a character whose second byte differs: both lose that character."""
    shared = "k" * 199
    rows = [(1, "x" + shared + "\u00e9" + "tail"), (2, "y" + shared + "\u00e8" + "rest")]
    out = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in runindex.remove_repeats(docs(rows), as_text=True).collect()}
    assert out == {1: (200, "xtail"), 2: (200, "yrest")}


def test_empty_table(docs):
    assert runindex.remove_repeats(docs([]).limit(0)).collect() == []

import random

import numpy as np
import pytest

from millrace.llm import common, neardup, quality, runindex


def thue_morse(n, a="a", b="b"):
    """The sequence and its complement: any polynomial hash modulo 2^64 with an odd base takes them for one from some length on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)]


def bytes_of(text):
    return np.frombuffer(text.encode(), np.uint8)


def hashes(texts):
    data = bytes_of("".join(texts))
    ends = np.cumsum([len(t.encode()) for t in texts])
    return common.span_hashes(data, ends - [len(t.encode()) for t in texts], ends)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 256, 336, 512, 513, 1024, 4096])
def test_regular_texts_stay_apart(n):
    x, y = hashes(thue_morse(n))
    assert x != y
    assert hashes(thue_morse(n, "z" * 3, "z")).tolist()[0] not in (x, y)


def test_equal_bytes_equal_hashes_wherever_they_stand():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab é日") for _ in range(rnd.choice([0, 1, 5, 8, 30, 600]))) for _ in range(300)] * 2
    got = hashes(texts).tolist()
    named = {}
    for t, h in zip(texts, got, strict=True):
        assert named.setdefault(t, h) == h
    assert len(set(named.values())) == len(named)


@pytest.mark.parametrize("size", [3, 64, 700])
def test_open_spans(size):
    """Words and lines in pieces have the hashes they have as a whole, on both sides of the length that is hashed at once."""
    text = "one " + "x" * 511 + " " + "y" * 512 + "  " + "z" * 513 + " end " + "w" * 2000
    data = bytes_of(text)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    block, common.BLOCK_BYTES = common.BLOCK_BYTES, size
    try:
        assert common.word_hashes(data).tolist() == common.span_hashes(data, starts, ends).tolist()
    finally:
        common.BLOCK_BYTES = block


def test_near_duplicates_of_regular_words(docs):
    x, y = thue_morse(1024)
    rows = [(1, x), (2, y), (3, f"{x} b c d e f"), (4, f"{y} b c d e f")]
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(rows)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    # The same with words in place of letters: no windows of the two sequences are taken for each other.
    rows = [(i + 1, t) for i, t in enumerate(thue_morse(2048, "tick ", "tock "))]
    out = neardup.near_duplicates(docs(rows)).collect()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(2044)} for _, t in rows]
    assert {r["n_shingles"] for r in out} == {len(s) for s in sets} and sets[0] == sets[1]


def test_duplicate_lines_of_regular_text():
    for text, lines in (("\n".join(thue_morse(1024)), 0), ("\n".join([*thue_morse(1024), *thue_morse(1024)]), 2)):
        data = bytes_of(text)
        for counts in (quality._block_counts(data, np.array([0, len(data)]))[0], quality._long_counts(data)):
            assert counts[3] == lines


def test_repeats_of_regular_text(docs):
    """Two texts of the same letters in complement share only what byte comparison finds."""
    rows = [(1, thue_morse(4096)[0][:1500]), (2, "c" + thue_morse(4096)[1][:1500])]
    raw = [t.encode() for _, t in rows]
    out = {r["doc_id"]: bytes(r["kept_bytes"]) for r in runindex.remove_repeats(docs(rows)).collect()}
    count = {}
    for t in raw:
        for i in range(len(t) - 199):
            count[t[i : i + 200]] = count.get(t[i : i + 200], 0) + 1
    for (i, _), t in zip(rows, raw, strict=True):
        cover = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                cover[k : k + 200] = True
        assert out[i] == np.frombuffer(t, np.uint8)[~cover].tobytes()


def test_lines_of_several_rows():
    """Lines are those of their own row, with empty rows and breaks at the ends."""
    texts = ["a\nb\na", "", "a", "\n\n", "b\n", "x y\n \nx y\nx y\n", "a\na"]
    data, offs = bytes_of("".join(texts)), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = quality._block_counts(data, offs)
    for t, row in zip(texts, got, strict=True):
        lines = [x for x in t.split("\n") if x.split()]
        assert (row[5], row[3]) == (len(lines), len(lines) - len(set(lines)))

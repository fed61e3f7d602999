import random

import numpy as np
import pytest

from millrace.llm import langid

LETTERS = {"aa": "abcdé ", "bb": "mnopq ", "cc": "жзик "}


@pytest.fixture
def rows():
    r = random.Random(3)
    text = lambda lang, n: "".join(r.choice(LETTERS[lang]) for _ in range(n)) + LETTERS[lang][0]
    return [(i, text(lang, r.randint(20, 400)), lang) for i, lang in enumerate(sorted(LETTERS) * 20)]


def test_held_out_accuracy_and_order(docs, rows):
    table = docs(rows)
    learned = langid.prototypes(table.where(~langid.held_out()))
    assert learned == langid.prototypes(table.repartition(5).where(~langid.held_out()))
    out = langid.predict(table, learned, keep=("doc_id", "lang")).withColumn("held_out", langid.held_out()).where("held_out").collect()
    assert len(out) > 5 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in out)


def test_profiles_are_bundles_of_bound_permuted_letters():
    d = 64
    letters = langid._letters(d)
    code = langid._classes()
    a, b, gap = letters[code[ord("a")]].astype(int), letters[code[ord("b")]].astype(int), letters[0].astype(int)
    want = np.roll(gap, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * gap
    assert (langid.profiles(["AB", None, "1 ,", "ab ab"], d) == np.stack([want, 0 * want, 0 * want, 2 * want])).all()


def test_edges(clashing, docs, rows):
    learned = langid.prototypes(docs(rows))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(clashing([(1, None), (2, ""), (3, "12 !?"), (4, "abcd " * 60_000), (5, "漢"), (6, "abcd"), (6, "abcd")]), learned).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] == out[6][0] == "aa" and out[5][0] in learned
    assert langid.prototypes(docs([(1, None), (2, "1")])) == {} and langid.predict(docs([(1, "abc")]), {}).first()["lang_pred"] == "und"
    assert langid.predict(docs([]).limit(0), learned).collect() == []


def test_predictions_against_loops(docs):
    """Languages that share their letters and differ in how these follow each other, judged again with plain loops."""
    r, d = random.Random(5), 256
    follow = {lang: {c: r.sample("abcdefgh", 3) for c in "abcdefgh"} for lang in ("p", "q", "s")}

    def text(lang, n):
        out = ["a"]
        while len(out) < n:
            out.append(" " if r.random() < 0.15 and out[-1] != " " else r.choice(follow[lang][out[-1] if out[-1] != " " else "a"]))
        return "".join(out)

    rows = [(i, text(lang, r.randint(60, 300)), lang) for i, lang in enumerate(["p", "q", "s"] * 40)] + [(900, "Ab, ba!", "p"), (901, "x", "q"), (902, "", "q")]
    table = docs(rows)
    learned = langid.prototypes(table.where(~langid.held_out()), d)
    held = {x["doc_id"]: x["h"] for x in table.select("doc_id", langid.held_out().alias("h")).collect()}
    letters = langid._letters(d).astype(int)

    def profile(t):
        codes, total = [int(c) for c in langid._classes()[[ord(x) for x in f" {t.lower()} "]]], np.zeros(d, int)
        codes = [c for i, c in enumerate(codes) if c or not i or codes[i - 1]]
        for x, y, z in zip(codes, codes[1:], codes[2:], strict=False):
            if y:
                total += np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z]
        return total

    sums = {lang: sum(profile(t) for i, t, own in rows if own == lang and not held[i]) for lang in follow}
    assert {k: v.tolist() for k, v in sums.items()} == learned
    right = 0
    for x in langid.predict(table, learned, keep=("doc_id", "text", "lang")).collect():
        v = profile(x["text"])
        if not v.any():
            assert x["lang_pred"] == "und" or x["text"] == "x"
            continue
        cosine = {lang: v @ s / np.sqrt((v @ v) * (s @ s)) for lang, s in sums.items()}
        best = max(sorted(cosine), key=lambda lang: round(cosine[lang], 9))
        assert x["lang_pred"] == best and x["score"] == pytest.approx((1 + cosine[best]) / 2, abs=2e-6)
        right += held[x["doc_id"]] and best == x["lang"]
    assert right >= 0.9 * sum(held[i] for i, *_ in rows if i < 900)

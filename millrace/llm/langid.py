"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters: the first permuted
(rotated) twice, the second once, multiplied. A text's profile bundles (adds) the vectors of its
trigrams, word ends included, and a language's prototype bundles those of its training texts. The
prediction is the language whose prototype has the greatest cosine with the profile, and the score is
(1 + cosine) / 2.

Sums of trigram vectors are whole numbers, so prototypes do not depend on how rows are dealt. Only one
vector for each language and task is moved.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every text
if there is nothing to learn from. Equal cosines go to the first language in order. Repeated rows are judged
alike, and learned from each. An empty table gives no rows. Columns of the input other than those named
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
#: Letters below this code point have a class of their own; others share as many classes by hash.
OWN_CLASSES = 1024
#: Rows and distinct trigrams multiplied at once.
ROWS, GRAMS = 256, 8192
#: Distinct trigrams a task counts before it adds them up.
HELD = 1 << 19


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point, 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint16)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    shared = OWN_CLASSES + (letters.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(12)) % np.uint64(OWN_CLASSES)
    out[letters] = np.where(letters < OWN_CLASSES, letters, shared)
    return out


@lru_cache(maxsize=2)
def _letters(dimensions: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).integers(0, 2, (2 * OWN_CLASSES, dimensions), dtype=np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of packed trigrams."""
    letters = _letters(dimensions)
    low = np.int64(2 * OWN_CLASSES - 1)
    first, second, third = grams >> 22, grams >> 11 & low, grams & low
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and packed trigram of each trigram; none crosses the gap between two words."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\n" + "\n".join(lowered) + "\n"
    codes = _classes()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in lowered]) + 1
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    at = np.flatnonzero(keep)
    s = codes[at]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    middle = np.flatnonzero(s[1:-1] != 0) + 1
    return np.searchsorted(ends, at[middle], "right"), s[middle - 1] << 22 | s[middle] << 11 | s[middle + 1]


def _counts(row: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the distinct trigrams: these, and row, place in the slice and count of each pair."""
    distinct, place = np.unique(gram, return_inverse=True)
    pairs, count = np.unique(row * len(distinct) + place, return_counts=True) if len(distinct) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    r, p = np.divmod(pairs, max(len(distinct), 1))
    for i in range(0, len(distinct), GRAMS):
        inside = (p >= i) & (p < i + GRAMS)
        yield distinct[i : i + GRAMS], r[inside], p[inside] - i, count[inside]


def profiles(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row for each text; zeros for a text without letters."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for grams, r, p, n in _counts(*grams_of(texts)):
        table = np.zeros((len(texts), len(grams)), np.float32)
        table[r, p] = n
        out += table @ gram_vectors(grams, dimensions).astype(np.float32)
    return out


def _bundled(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    held: dict[str, list] = {}

    def add_up(lang: str) -> None:
        grams = np.concatenate([g for g, _ in held[lang]])
        distinct, place = np.unique(grams, return_inverse=True)
        count = np.bincount(place, np.concatenate([n for _, n in held.pop(lang)]), len(distinct))
        total = sums.setdefault(lang, np.zeros(dimensions, np.int64))
        for i in range(0, len(distinct), GRAMS):
            total += count[i : i + GRAMS].astype(np.int64) @ gram_vectors(distinct[i : i + GRAMS], dimensions).astype(np.int64)

    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            row, gram = grams_of(part.column("text").to_pylist())
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for k, lang in enumerate(names):
                parts = held.setdefault(lang, [])
                parts.append(np.unique(gram[number[row] == k], return_counts=True))
                if sum(len(g) for g, _ in parts) > HELD:
                    add_up(lang)
    for lang in sorted(held):
        add_up(lang)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "sum"])


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, list[int]]:
    """The bundle of each language over all rows with a text and a language; one vector a language comes to the driver."""
    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(lambda it: _bundled(it, dimensions), "lang string, sum array<bigint>").select("lang", F.posexplode("sum").alias("i", "x"))
    found: dict[str, list[int]] = {}
    for r in sums.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["lang"], [0] * dimensions)[r["i"]] = r["x"]
    return {lang: v for lang, v in sorted(found.items()) if any(v)}


def _predicted(batches: Iterator[pa.RecordBatch], names: list[str], langs: list[str], unit: np.ndarray) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            texts = batch.column("__text").to_pylist()
            if langs:
                v = profiles(texts, unit.shape[1]).astype(np.float64)
                size = np.linalg.norm(v, axis=1)
                cosine = np.round(v @ unit.T / np.maximum(size, 1e-12)[:, None], 9)
                best = cosine.argmax(1)
                lang = [langs[b] if s > 0 else "und" for b, s in zip(best, size, strict=True)]
                score = np.where(size > 0, np.round((1 + np.clip(cosine[np.arange(len(best)), best], -1, 1)) / 2, 6), 0.0)
            else:
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])


def predict(docs: DataFrame, learned: dict[str, list[int]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred and score of each row, from its text alone; nothing is shuffled."""
    names, langs = list(keep), list(learned)
    table = np.array([learned[x] for x in langs], np.float64).reshape(len(langs), -1 if langs else DIMENSIONS)
    unit = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12) if langs else table
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "lang_pred string, score double"])
    return docs.select(*names, F.col("text").cast("string").alias("__text")).mapInArrow(lambda it: _predicted(it, names, langs, unit), schema)


def held_out(id_column: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds == fold

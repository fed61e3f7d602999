import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text[, lang, source]) rows, with extra columns that clash with operators' names."""

    def make(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def clashing(docs):
    """The same with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ["n_words", "kept", "anomaly", "ids", "decoded", "size", "target", "position", "n_bytes", "kept_bytes", "anchor", "context", "rep", "component_id", "start", "score", "host", "path", "__key", "__text"]
    return lambda rows: docs(rows).select("*", *(F.lit(7).alias(n) for n in names))


@pytest.fixture
def words():
    """Pseudo-random texts of made-up words."""
    rnd = random.Random(5)
    syllables = "ka lo mi ter an es on ra vu pe do si".split()

    def make(n, seed=None):
        r = random.Random(seed) if seed is not None else rnd
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make

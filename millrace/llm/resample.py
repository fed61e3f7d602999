"""Importance resampling of documents towards the word distribution of a target, in DataFrame functions only.

Features are runs of consecutive lower-cased words. Each is filed in one of `buckets` buckets by its CRC-32,
and the buckets of all documents and of all target texts are counted, pre-aggregated in every task. A
bucket's gain is the log ratio of its smoothed shares, in thousandths; the table of gains has `buckets` rows,
which bounds what is broadcast. A document's weight is the sum of the gains of its features: texts are exploded
and summed again inside the task that reads them, so only one row a document is shuffled. With
Gumbel noise from a seeded hash of the id added, the highest scores are a draw without replacement in
proportion to the weights. Places come from one range exchange; the counts of the ranges are added on, and no
task orders all documents.

Defined results: a null text has no words, no features and weight 0. A null doc_id counts as an empty one in
the noise and stands behind all others of its score. Repeated rows, and rows of one id, are judged each on its
own; among rows equal in score and id the one with fewer features is placed first, and rows equal in all
columns are interchangeable. Without target texts or documents the gains follow from the smoothing alone; an empty
table of documents gives no rows. Texts are taken whole, however long. Columns of the inputs other than doc_id and
text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.splits import value_rank
from .common import stored

#: Fixed value: what a word is made of, after lower-casing A to Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_RESULT = ("doc_id", "n_features", "weight", "score")


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def runs(words: Column, least: int, most: int) -> Column:
    """All runs of least to most consecutive words, joined by a space, with repeats."""
    if (least, most) == (1, 1):
        return words
    # The words are bound by a lambda variable, so that a text is split once and not for each run.
    of_size = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(words), lambda w: F.concat(*(of_size(w, n) for n in range(least, most + 1)))), 1)


def bucket_of(feature: Column, buckets: int) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes, modulo the number of buckets."""
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets).cast("bigint"))


def _features(df: DataFrame, least: int, most: int, *keep: Column) -> DataFrame:
    """The kept columns, n_words and the array of features of each row."""
    split = df.select(*keep, words_of(F.col("text")).alias("__words"))
    names = [c for c in split.columns if c != "__words"]
    return split.select(*names, F.size("__words").cast("bigint").alias("n_words"), runs(F.col("__words"), least, most).alias("__features"))


def bucket_counts(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10000) -> DataFrame:
    """bucket, raw (features of all documents in it) and wanted (of all target texts)."""
    one = lambda df, raw: _features(df, least, most).select(F.explode("__features").alias("f")).select(bucket_of(F.col("f"), buckets).alias("bucket"), F.lit(raw).alias("raw"))
    both = one(docs, 1).unionByName(one(target, 0))
    return both.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum(1 - F.col("raw")).alias("wanted"))


def gains(counts: DataFrame, buckets: int = 10000) -> DataFrame:
    """bucket and gain, floor(1000 * ln of the ratio of the smoothed shares), for every bucket; counts is written first, as it is read twice."""
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("s"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("t")).first()
    every = counts.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left")
    up = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1.0
    ratio = up("wanted") * F.lit(float(total["s"] + buckets)) / (up("raw") * F.lit(float(total["t"] + buckets)))
    return every.select("bucket", F.floor(1000.0 * F.ln(ratio)).cast("bigint").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256 of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")


def weights(docs: DataFrame, gain: DataFrame, least: int = 1, most: int = 1, buckets: int = 10000) -> DataFrame:
    """doc_id, n_words, n_features, weight: one row for each row of docs."""
    rows = _features(docs, least, most, F.monotonically_increasing_id().alias("__row"), F.col("doc_id").cast("bigint").alias("doc_id"))
    spread = rows.select("__row", "doc_id", "n_words", F.explode_outer("__features").alias("f")).withColumn("bucket", bucket_of(F.col("f"), buckets))
    added = spread.join(F.broadcast(gain), "bucket", "left").groupBy("__row", "doc_id", "n_words").agg(F.count("f").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return added.drop("__row")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, least: int = 1, most: int = 1, buckets: int = 10000) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn.

    Of the N documents with at least least_words words, floor(percent * N / 100) of the highest score are drawn.
    """
    gain = gains(stored(bucket_counts(docs, target, least, most, buckets), "bucket-counts"), buckets)
    scored = weights(docs, gain, least, most, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored, "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    keyed = fit.select(*_RESULT, (-F.col("score")).alias("__down"), F.col("doc_id").isNull().alias("__nameless"))
    placed = value_rank(keyed, ["__down", "__nameless", "doc_id", "n_features"], "__place")
    ranked = placed.select(*_RESULT, F.when(F.col("__place") < drawn, F.col("__place") + 1).alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).select(*_RESULT, F.lit(None).cast("bigint").alias("rank")))


def drawn_documents(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The rows of docs whose id was drawn, with all their columns."""
    ids = resampled.where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("bigint").eqNullSafe(F.col("__drawn")), "left_semi")

"""From raw documents to token ids: the stages of a training corpus, each written as Parquet and read again.

Every stage but the last returns the columns of its input. Rows with a null doc_id pass all stages:
they are judged where a text is enough, and never taken for near-duplicates of others. Of rows equal in id
and text one goes on past the near-duplicates, and reruns keep the same. Empty tables give empty tables, null texts
count as empty, texts are taken whole however long, and columns of any other name pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm import bpe, mixing, neardup, quality, runindex
from millrace.session import ready, scratch, table


def _shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with doc_id and text, and every other column under a name that no operator uses."""
    other = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(name) for c, name in other.items())), other


def _restored(df: DataFrame, docs: DataFrame, other: dict[str, str], **made) -> DataFrame:
    """The columns of docs in their order and types, some of them made anew."""
    return df.select(*(made.get(c, F.col(other.get(c, c))).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def _settled(other: dict[str, str]):
    """An order among rows of equal id and text that reruns repeat: by a hash of their other columns. Rows equal in all columns are interchangeable."""
    return F.xxhash64(F.to_json(F.struct(*other.values()))) if other else F.lit(1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail the base rules, and anomalies of the isolation forest."""
    ready(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    safe, other = _shielded(docs)
    judged = quality.judge(safe, model, keep=("doc_id", "text", *other.values()))
    return _restored(judged.where("kept"), docs, other)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least id; of rows of equal id and text, one."""
    ready(spark)
    safe, other = _shielded(docs)
    named = safe.where("doc_id is not null")
    keys = {"__id": F.col("doc_id").cast("bigint"), "__text_key": neardup.text_key(F.col("text").cast("string"))}
    kept = neardup.near_duplicates(named).where("first").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text_key")).distinct()
    once = W.partitionBy(*keys).orderBy(_settled(other))
    chosen = named.withColumns(keys).join(kept, list(keys)).withColumn("__row", F.row_number().over(once)).where("__row = 1").drop("__row", *keys)
    return _restored(chosen.unionByName(safe.where("doc_id is null")), docs, other)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long repeated passages are cut out of every text; a character that a cut goes through is lost whole."""
    ready(spark)
    safe, other = _shielded(docs)
    cut = runindex.remove_repeats(safe, keep=("doc_id", *other.values()), as_text=True)
    return _restored(cut, docs, other, text=F.col("kept_text"), n_chars=F.char_length("kept_text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in order of training position.

    A copy that the mix takes in part stays whole if at least half of it is taken, so a source's words
    differ from its target by half a document at most for each pass.
    """
    ready(spark)
    safe, other = _shielded(docs)
    # Two keys that are never null: the window and the join below then share one shuffle of the texts.
    keys = {"__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))), "__text_key": F.xxhash64("text")}
    safe = safe.withColumns(keys)
    source = F.col(other["source"]) if "source" in other else F.lit(None).cast("string")
    planned = mixing.plan(safe.select("doc_id", "text", source.alias("source"), *keys), schedules=mixing.tilted(), keep=tuple(keys))
    copies = planned.select(*keys, "size", F.explode("copies").alias("copy")).where("copy.words > 0 and 2 * copy.words >= size").select(*keys, F.col("copy.position").alias("__position"))
    once = safe.withColumn("__row", F.row_number().over(W.partitionBy(*keys).orderBy(_settled(other)))).where("__row = 1").drop("__row")
    placed = copies.join(once, list(keys))
    ordered = placed.repartitionByRange("__position", "doc_id").sortWithinPartitions("__position", "doc_id")
    return _restored(ordered, docs, other)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit integers) of each text, with digests of them and of what they decode to."""
    ready(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("mixing_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Isolation forest, run index and BPE have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Words of texts: cleaning, counting, vocabularies, TF-IDF in three forms, top words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.splits import value_rank
from ..session import stored

#: The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def split_words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def count_word(text: Column, word: str) -> Column:
    """How often a word occurs between white space, case counts; 0 for null."""
    return F.coalesce(F.size(F.filter(split_words(text), lambda w: w == word)), F.lit(0))


def count_words(text: Column, words: Sequence[str]) -> Column:
    """Counts of the given words as one array, from one split of the text."""
    return vectorised(split_words(F.coalesce(text, F.lit(""))), words)


def tokens(text: Column, lowercase: bool = True, min_length: int = 1) -> Column:
    """Runs of letters, digits and underscores in any script."""
    base = F.lower(text) if lowercase else text
    return F.regexp_extract_all(base, F.lit(rf"(?U)(\w{{{min_length},}})"), F.lit(1))


def letters_only(text: Column) -> Column:
    """Lower-cased runs of a to z: the same in every SQL engine."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def length_in_words(text: Column) -> Column:
    """Pieces between single spaces; repeated spaces count."""
    return F.size(F.split(text, " "))


def snippet(text: Column, words: int = 25, width: int = 90, lines: int = 2) -> Column:
    """The first words, cut into lines of a width."""
    head = F.concat_ws(" ", F.slice(split_words(text), 1, words))
    return F.array(*(F.substring(head, 1 + i * width, width) for i in range(lines)))


# ---------------------------------------------------------------- bags of words

def _tallied(words: pa.Array, row: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Row, term and number of the distinct words of each row, in order of the row, told apart by one sort of numbers a batch."""
    told = words.dictionary_encode(null_encoding="encode")
    kinds = max(1, len(told.dictionary))
    met, tf = np.unique(row.astype(np.int64) * kinds + told.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return met // kinds, pa.DictionaryArray.from_arrays(pa.array(met % kinds, told.indices.type), told.dictionary), tf


def _letter_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of a to z in lower-cased texts and the row of each, cut from the bytes of a batch at once."""
    texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = (data - np.uint8(ord("a"))) < 26
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts = ends[ends < len(data)]
    first[starts] = letter[starts]  # a word ends with its row
    at = np.flatnonzero(first)
    offsets = np.append(np.cumsum(letter, dtype=np.int32)[at] - 1, np.count_nonzero(letter)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[letter]))
    return words, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, ends)))


def letter_entries(texts: pa.Array, tally: bool = True) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Row, term and number of the words of a to z in lower-cased texts, once for each row and term; without tally, each word as it comes, in order of the row too."""
    words, row = _letter_runs(texts)
    return _tallied(words, row) if tally else (row, words.dictionary_encode(), np.ones(len(row), np.int64))


def _counted(batches: Iterator[pa.RecordBatch], names: list[str], letters: bool = False) -> Iterator[pa.RecordBatch]:
    """The distinct words of each row with their number; rows hold lists of words, or lower-cased texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if letters:
            words, row = _letter_runs(batch.column(1))
        else:
            words, row = batch.column(1).flatten(), np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        if len(words):
            met, terms, tf = _tallied(words, row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(met)), terms.dictionary_decode(), pa.array(tf, pa.int64())], names)


def _counted_rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each lower-cased text with a word: its distinct words and how often each occurs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row, terms, tf = _tallied(*_letter_runs(batch.column(1)))
        kept, starts = np.unique(row, return_index=True)
        if len(kept):
            offsets = pa.array(np.append(starts, len(row)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.ListArray.from_arrays(offsets, terms.dictionary_decode()), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], names)


def _repeats(df: DataFrame, doc_id: str) -> bool:
    """Whether some id is on several rows."""
    return not df.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _bag(df: DataFrame, doc_id: str, words: Column, letters: bool) -> DataFrame:
    rows = df.select(doc_id, words.alias("__words"))
    kind = rows.schema[doc_id].dataType.simpleString()
    bag = rows.mapInArrow(lambda it: _counted(it, [doc_id, "term", "tf"], letters), f"`{doc_id}` {kind}, term string, tf bigint")
    return bag.groupBy(doc_id, "term").agg(F.sum("tf").alias("tf")) if _repeats(df, doc_id) else bag


def bag_of_words(df: DataFrame, doc_id: str, words: Column) -> DataFrame:
    """doc_id, term, tf: how often each document has each term.

    Words are counted in the task that reads the row. Only if some id is on several rows are their counts added by an exchange.
    """
    return _bag(df, doc_id, words, False)


def bag_of_letters(df: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """bag_of_words of letters_only(text), which are cut from the bytes of lower-cased texts where they are counted."""
    return _bag(df, doc_id, F.lower(text), True)


def letter_counts(df: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """doc_id, terms, tfs: bag_of_letters with one row a document, for passes that look at whole documents."""
    if _repeats(df, doc_id):
        entries = bag_of_letters(df, doc_id, text).groupBy(doc_id).agg(F.collect_list(F.struct("term", "tf")).alias("e"))
        return entries.select(doc_id, F.col("e.term").alias("terms"), F.col("e.tf").alias("tfs"))
    rows = df.select(doc_id, F.lower(text).alias("__text"))
    kind = rows.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(lambda it: _counted_rows(it, [doc_id, "terms", "tfs"]), f"`{doc_id}` {kind}, terms array<string>, tfs array<bigint>")


def letter_rows(df: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """One row a document whose words a pass cuts itself (letter_entries): doc_id and the lower-cased text; if some id is on several rows, written letter_counts."""
    return stored(letter_counts(df, doc_id, text), "counts") if _repeats(df, doc_id) else df.select(doc_id, F.lower(text).alias("text"))


def has_letter_words(text: Column) -> Column:
    """Whether letters_only(text) has a word. Most texts tell it by their first characters, so few are lower-cased as a whole."""
    return F.when(F.lower(F.substring(text, 1, 64)).rlike("[a-z]"), True).otherwise(F.coalesce(F.lower(text).rlike("[a-z]"), F.lit(False)))


def vocabulary(bag: DataFrame) -> DataFrame:
    """term, df (documents that have it), total; joined by term, never by position."""
    return bag.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def term_ids(bag: DataFrame) -> DataFrame:
    """term, term_id in alphabetical order (from 0), by one range exchange of the distinct terms."""
    return value_rank(bag.select("term").distinct(), ["term"], "term_id")


def inverted(ids: DataFrame) -> DataFrame:
    """The inverse map of term_ids as a table (term_id, term), whatever its size."""
    return ids.select("term_id", "term")


def term_of(ids: DataFrame) -> dict[int, str]:
    """The inverse map, for a vocabulary that fits on the driver."""
    return {r["term_id"]: r["term"] for r in ids.collect()}


def within_vocabulary(bag: DataFrame, vocab: DataFrame) -> DataFrame:
    """Only the terms of a learned or given vocabulary; unseen words are dropped."""
    return bag.join(vocab.select("term").distinct(), "term", "left_semi")


#: Bytes of a vocabulary up to which it is broadcast.
BROADCAST_BYTES = 16 << 20


def _octave() -> Column:
    return F.floor(F.log2("df")).cast("int")


def common_octave(counts: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[int, bool]:
    """The least octave of df from which on the terms of a vocabulary (term, df) fit into broadcast_bytes, and whether these are all terms."""
    told = counts.groupBy(_octave().alias("o")).agg(F.sum(F.octet_length("term") + 16).alias("bytes")).orderBy(F.desc("o")).collect()
    least, room = 64, broadcast_bytes
    for r in told:
        room -= r["bytes"] or 0
        if room < 0:
            break
        least = r["o"]
    return least, all(r["o"] >= least for r in told)


def common_terms_of(counts: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> pa.Table:
    """The commonest terms of a vocabulary with their df, as many as broadcast_bytes hold, on the driver."""
    return counts.where(_octave() >= common_octave(counts, broadcast_bytes)[0]).select("term", "df").toArrow()


def with_df(bag: DataFrame, counts: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """bag with the df of its terms, from a written vocabulary (term, df).

    The commonest terms, as many as broadcast_bytes hold, are broadcast, and their rows stay where they are. Only the
    rows of the rarer terms, few for each term and few in all, are joined by an exchange.
    """
    least, whole = common_octave(counts, broadcast_bytes)
    near = bag.join(F.broadcast(counts.where(_octave() >= least)), "term")
    if whole:
        return near
    rest = bag.join(F.broadcast(counts.where(_octave() >= least).select("term")), "term", "left_anti").join(counts.where(_octave() < least).hint("merge"), "term")
    return near.unionByName(rest)


def term_weights(bag: DataFrame, doc_id: str, forms: Sequence[str], documents: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, term, tf, and a column for each form, as tf_idf has it but for the length of rows.

    The bag is written once, for the counts and for the rows, and so is the vocabulary.
    """
    bag = stored(bag, "bag")
    n = F.lit(documents if documents is not None else bag.select(doc_id).distinct().count()).cast("double")
    made = {
        "raw": F.col("tf") * F.log(n / F.col("df")),
        "smooth": F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1),
        "ml": F.col("tf") * F.log((n + 1) / (F.col("df") + 1)),
    }
    for form in forms:
        if form not in made:
            raise ValueError(f"no such form: {form}")
    both = with_df(bag, stored(vocabulary(bag).select("term", "df"), "vocabulary"), broadcast_bytes)
    return both.select(doc_id, "term", "tf", *(made[f].alias(f) for f in forms))


def tf_idf(bag: DataFrame, doc_id: str, form: str = "raw", documents: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, term, tf, value.

    raw: tf * ln(N / df). smooth: tf * (ln((1 + N) / (1 + df)) + 1), rows scaled to length 1.
    ml: tf * ln((N + 1) / (df + 1)). N is the number of documents; without it, of those with a term.
    """
    out = term_weights(bag, doc_id, [form], documents, broadcast_bytes).withColumnRenamed(form, "value")
    return row_normalised(out, doc_id) if form == "smooth" else out


def row_normalised(bag: DataFrame, doc_id: str, value: str = "value") -> DataFrame:
    """Rows of a long table scaled to length 1; zero rows stay."""
    length = F.sqrt(F.sum(F.col(value) * F.col(value)).over(W.partitionBy(doc_id)))
    return bag.withColumn(value, F.coalesce(F.try_divide(F.col(value), length), F.lit(0.0)))


def top_terms(bag: DataFrame, doc_id: str, value: str, k: int) -> DataFrame:
    """The k terms of the highest value in each document, ties in order of the term."""
    order = W.partitionBy(doc_id).orderBy(F.desc(value), "term")
    return bag.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def as_maps(bag: DataFrame, doc_id: str, value: str) -> DataFrame:
    """doc_id and a map from term to value: bounded by the terms of one document."""
    return bag.groupBy(doc_id).agg(F.map_from_entries(F.collect_list(F.struct("term", value))).alias("terms"))


def map_terms(df: DataFrame, doc_id: str, terms: str = "terms") -> DataFrame:
    return df.select(doc_id, F.explode(terms).alias("term", "value"))


def common_terms(bag: DataFrame, doc_id: str, first, second, value: str = "tf") -> DataFrame:
    """Terms that two documents share, with the value in each, the highest of the first on top."""
    a = bag.where(F.col(doc_id) == first).select("term", F.col(value).alias(f"{value}_first"))
    b = bag.where(F.col(doc_id) == second).select("term", F.col(value).alias(f"{value}_second"))
    return a.join(b, "term")


def vectorised(words: Column, vocab: Sequence[str]) -> Column:
    """Counts of a fixed vocabulary in an array of words, in the vocabulary's order; other words are passed over.

    The words are bound by a lambda variable: an expression inside a lambda would be made again for every vocabulary word.
    """
    counted = lambda own: F.transform(F.lit(list(vocab)), lambda w: F.size(F.filter(own, lambda x: x == w)))
    return F.element_at(F.transform(F.array(words), counted), 1)


def sparse_row(terms: Column, vocab: Sequence[str]) -> Column:
    """The values of a map from term to value, in the order of a fixed vocabulary; 0 where a term is missing."""
    return F.transform(F.lit(list(vocab)), lambda w: F.coalesce(F.try_element_at(terms, w).cast("double"), F.lit(0.0)))


def has_all(words: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.lit(list(wanted)), words)) == 0

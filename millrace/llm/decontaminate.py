"""Benchmark decontamination by winnowing.

Words of documents and benchmark items become hashes of GRAM consecutive words. Of the grams inside a window of
`width` words the least hash is kept: the window's fingerprint. Equal windows have equal fingerprints, so every span
of width words that both sides share is met under the fingerprint it has on both. An item of fewer words is
one window of its own length.

The items' fingerprints go to every task as a bitmap of 2^BITS bits, which bounds what is sent whatever the
benchmark's size. A document's fingerprints that are in it are extended to the windows they stand for; these, and
nothing else of the document, are joined with the windows of the items, by fingerprint and by a 128-bit name of
the window's words. A common gram therefore meets only the windows that go on alike on both sides. Windows that the
same items hold are one class, and documents that meet the same classes are one set, so that item lists are made
once for each set however many documents and items share a passage.

Defined results: null and blank texts have no words and hit nothing; an item without words has no window. A null
item_id counts as an empty id, and an id stands once in a document's list however many rows and windows it has.
Each row of documents is judged on its own, with null and repeated ids too. Without items, or without
hits, n_hit and n_items are 0 and the digest is that of an empty list. Very long texts are read in pieces that
overlap by a window. Columns other than doc_id, item_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .common import lower_ascii, mixed, row_blocks, span_hashes, stored, text_bytes, window_hashes, word_spans

#: Words of an item's window, and of a gram.
WIDTH, GRAM = 10, 5
#: The bitmap of fingerprints has 2^BITS bits (2 MB).
BITS = 24
#: Windows of a document in one row of the intermediate table.
_AT_ONCE = 2048

#: The bytes that stand between words, 0x00 to 0x2F, 0x3A to 0x60 and 0x7B to 0x7F; capitals are lower-cased before.
BETWEEN = np.zeros(256, bool)
BETWEEN[0x00:0x30] = BETWEEN[0x3A:0x61] = BETWEEN[0x7B:0x80] = True


def _fingerprints(words: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of every run of length words: the least hash among its grams, apart from those of other lengths."""
    gram = min(GRAM, length)
    grams = window_hashes(words, gram)
    n = max(len(words) - length + 1, 0)
    least = grams[:n].copy()
    for i in range(1, length - gram + 1):
        np.minimum(least, grams[i : i + n], out=least)
    return mixed(least + np.uint64(length))


def _name(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """128 bits that stand for the words of a window, whatever is between them."""
    return hashlib.blake2b(b" ".join(data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), digest_size=16).digest()


def _pieces(data: np.ndarray, offs: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, bool]]:
    """Blocks of rows as (first row, lower-cased bytes, starts, ends, word offsets of the rows, number of the first word, whether the row ends here).

    A row beyond the block size comes in pieces; the last width - 1 words of each come again in the next.
    """
    for i, j in row_blocks(offs):
        part = lower_ascii(data[offs[i] : offs[j]])
        if j > i + 1 or len(part) <= common.BLOCK_BYTES:
            yield i, part, *word_spans(part, offs[i : j + 1] - offs[i], BETWEEN), 0, True
            continue
        at, number, size = 0, 0, common.BLOCK_BYTES
        while True:
            piece = part[at : at + size]
            last = at + size >= len(part)
            if not last:
                # Cut between words; a piece without a gap, or with too few words to go on, grows.
                gaps = np.flatnonzero(BETWEEN[piece])
                piece = piece[: int(gaps[-1]) + 1] if len(gaps) else piece[:0]
            starts, ends, words = word_spans(piece, np.array([0, len(piece)]), BETWEEN)
            if not last and len(starts) < 2 * width:
                size *= 2
                continue
            yield i, piece, starts, ends, words, number, last
            if last:
                break
            number += len(starts) - width + 1
            at, size = at + int(starts[-width + 1] if width > 1 else len(piece)), common.BLOCK_BYTES


def _found(piece: tuple, lengths: list[int], width: int, bitmap: np.ndarray) -> list[tuple[int, int, int, int, bytes]]:
    """(row, first word, length, fingerprint, name) of the windows of a piece whose fingerprint is in the bitmap."""
    first, data, starts, ends, words, number, last = piece
    out, hashes = [], span_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(words) - 1), np.diff(words))
    for length in lengths:
        prints = _fingerprints(hashes, length)
        n = len(prints)
        if not n:
            continue
        at = prints & np.uint64((1 << BITS) - 1)
        likely = (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        likely &= row[:n] == row[length - 1 :]
        if not last:
            # What starts in the words that come again belongs to the next piece.
            likely[max(len(starts) - width + 1, 0) :] = False
        for k in np.flatnonzero(likely).tolist():
            own = int(row[k])
            out.append((first + own, number + k - int(words[own]), length, int(prints[k : k + 1].view(np.int64)[0]), _name(data, starts[k : k + length], ends[k : k + length])))
    return out


_WINDOW = pa.struct([("first", pa.int64()), ("length", pa.int32()), ("print", pa.int64()), ("name", pa.binary())])
_READ = "row bigint, doc_id bigint, n_words bigint, windows array<struct<first: bigint, length: int, print: bigint, name: binary>>"


def _read(batches: Iterator[pa.RecordBatch], lengths: list[int], width: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each document with its number of words, and rows with windows, _AT_ONCE at most in each, where it has any."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("windows", pa.list_(_WINDOW))])

    def told(rows: list, ids: list, counts: list, windows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(windows, pa.list_(_WINDOW))], schema=schema)

    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        rows, ids = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
        sizes = np.zeros(len(rows), np.int64)
        for piece in _pieces(data, offs, width):
            first, words, number = piece[0], piece[4], piece[5]
            many = len(words) - 1
            # A piece of a long row says how many words the row has so far.
            sizes[first : first + many] = np.diff(words) + number
            held: dict[int, list] = {}
            for row, *window in _found(piece, lengths, width, bitmap):
                own = held.setdefault(row, [])
                own.append(tuple(window))
                if len(own) == _AT_ONCE:
                    yield told([rows[row]], [ids[row]], [None], [held.pop(row)])
            if held:
                yield told([rows[r] for r in held], [ids[r] for r in held], [None] * len(held), list(held.values()))
        yield told(rows, ids, sizes.tolist(), [None] * len(rows))


def _item_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """item, length, print, name of every window of every item."""
    everything = np.full(1 << (BITS - 3), 0xFF, np.uint8)
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        items = batch.column("item").to_pylist()
        for piece in _pieces(data, offs, width):
            out = _found(piece, [width], width, everything)
            first, part, starts, ends, words, number, last = piece
            for r in np.flatnonzero((np.diff(words) > 0) & (np.diff(words) < width)).tolist() if last and not number else []:
                a, b = int(words[r]), int(words[r + 1])
                prints = _fingerprints(span_hashes(part, starts[a:b], ends[a:b]), b - a)
                out.append((first + r, 0, b - a, int(prints.view(np.int64)[0]), _name(part, starts[a:b], ends[a:b])))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([items[r] for r in columns[0]], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.binary())], ["item", "length", "print", "name"])


def benchmark_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item (the id as text), length, print, name: the distinct windows of each item."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(lambda it: _item_windows(it, width), "item string, length int, print bigint, name binary").distinct()


def fingerprint_bitmap(windows: DataFrame) -> np.ndarray:
    """The low BITS bits of all fingerprints as a bitmap: 32768 bits a row, so 2^BITS / 32768 rows at most reach the driver."""
    cell = F.col("print").bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    rows = windows.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _set_name(member: Column) -> list[Column]:
    """Aggregates that name a set of distinct members, whatever their order: pre-aggregated in every task."""
    return [F.bit_xor(F.xxhash64(member)).alias("set_a"), F.bit_xor(F.xxhash64(F.lit(1), member)).alias("set_b"), F.count(F.lit(1)).alias("members")]


_SET = ["set_a", "set_b", "members"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, n_items, items_sha256 of each run of rows of one rep, the items in order."""
    held, state, n = None, None, 0
    schema = pa.schema([("rep", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())])
    for batch in batches:
        done = []
        for rep, item in zip(batch.column("rep").to_pylist(), batch.column("item").to_pylist(), strict=True):
            if rep != held:
                if state is not None:
                    done.append((held, n, state.hexdigest()))
                held, state, n = rep, hashlib.sha256(), 0
            state.update((("," if n else "") + item).encode())
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((held, n, state.hexdigest()), schema, strict=True)], schema=schema)


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: documents (row, doc_id, n_words), hits (row, first, length, class) and classes (class, item).

    A hit is a window of a document that some item has; a class stands for the items that have it.
    """
    windows = stored(benchmark_windows(items, width), "item-windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    bitmap = fingerprint_bitmap(windows)
    # The number of a row is made once, here: the table is written.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = stored(rows.mapInArrow(lambda it: _read(it, lengths, width, bitmap), _READ), "document-windows")
    of_name = windows.groupBy("name", "print").agg(*_set_name(F.col("item")))
    classes = of_name.groupBy(*_SET).agg(F.min("name").alias("class"))
    named = stored(of_name.join(classes, _SET).select("name", "print", "class"), "window-classes")
    held = stored(windows.join(named.where("name = class").select("name").distinct(), "name", "left_semi").select(F.col("name").alias("class"), "item").distinct(), "class-items")
    likely = read.where("windows is not null").select("row", F.explode("windows").alias("w")).select("row", "w.first", "w.length", "w.print", "w.name")
    met = stored(likely.join(named, ["print", "name"]).select("row", "first", "length", "class"), "hits")
    return read.where("n_words is not null").select("row", "doc_id", "n_words"), met, held


def _item_lists(met: DataFrame, held: DataFrame) -> DataFrame:
    """row, n_items, items_sha256 of the documents with hits: a list is made once for each set of classes."""
    classes = stored(met.select("row", "class").distinct(), "row-classes")
    sets = stored(classes.groupBy("row").agg(*_set_name(F.col("class"))), "row-sets")
    reps = stored(sets.groupBy(*_SET).agg(F.min("row").alias("rep")), "sets")
    wanted = classes.join(reps.select(F.col("rep").alias("row")), "row").join(held, "class").select(F.col("row").alias("rep"), "item").distinct()
    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = wanted.repartition(n, "rep").sortWithinPartitions("rep", "item").mapInArrow(_digests, "rep bigint, n_items bigint, items_sha256 string")
    listed = stored(reps.join(lists, "rep").drop("rep"), "item-lists")
    return sets.join(listed, _SET).select("row", "n_items", "items_sha256")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a window of some item), n_items, items_sha256 (of the sorted ids, comma-joined), contaminated."""
    read, met, held = hits(docs, items, width)
    before = W.partitionBy("row").orderBy("first", "length").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("first") + F.col("length")
    new = F.greatest(end - F.greatest("first", F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    covered = met.withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"))
    judged = covered.join(_item_lists(met, held), "row")
    none = hashlib.sha256(b"").hexdigest()
    whole = read.join(judged, "row", "left")
    return whole.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def hit_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, item, first, length: every window of a document that an item has, for a look at what was found."""
    read, met, held = hits(docs, items, width)
    return met.join(held, "class").join(read.select("row", "doc_id"), "row").select("doc_id", "item", "first", "length")

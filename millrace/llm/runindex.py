"""Exact removal of long repeats by a run-length index.

The index of some text is its Burrows-Wheeler transform kept as runs, with the suffix positions at both
ends of every run sampled. Inside a run, neighbours in suffix order move along the text together, so
the longest match of a position with the suffix above (or below) it is that of the nearest sampled
position before it, less the distance: matching statistics stream over the text from the samples
alone. A position whose statistic reaches the wanted length starts a repeat.

A corpus is cut for that into small indexes which lose no repeat. Among the K-byte strings inside a
window of the wanted length, the one of the least hash is the window's anchor. Equal windows have equal
anchors, so a window's repeats all lie in the group of its anchor. An anchor's context holds all
windows that it is the anchor of. Anchors that occur once are dropped unseen; equal contexts are one
entry with a count (a count above 1 repeats throughout); groups of several contexts are indexed, many
small groups in one index. A group of more than GROUP_CONTEXTS contexts is dealt again by
longer anchors: windows with more text right of the anchor go by its right half, others by the left
half, and so on, up to the window itself; so no task ever holds an unbounded group, and none is cut short.

Defined results: null texts have no bytes. Matches never cross rows; repeated rows repeat each other, so
rows of at least the wanted length that occur twice are removed whole. Rows with a null id are judged
too. Rows of equal id and text are read once for their contexts, and share one list of spans. An empty table gives no rows. Columns of the input other than doc_id and text are not looked at,
unless kept by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, mixed, powers, prefix_sums, row_blocks, span_hashes, stored, text_bytes

LENGTH, ANCHOR = 200, 64
#: Contexts of one group that one index takes.
GROUP_CONTEXTS = 2048
#: Bytes of contexts in one index: bounds the memory of a task.
INDEX_BYTES = 1 << 20
#: Never part of UTF-8: ends each context inside an index.
_END = 0xFF


# ---------------------------------------------------------------- anchors

def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values."""
    n = len(x)
    if width == 1:
        return x
    pad = -n % width
    full = np.concatenate((x, np.full(pad, x.dtype.type(np.iinfo(x.dtype).max)))) if pad else x
    table = full.reshape(-1, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """For each anchor of each row: row, first window, windows, hash of the anchor, hash of the context.

    The windows of one anchor are a run of starts, because the leftmost least hash never moves back.
    """
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = prefix_sums(data)
    inverse = powers(len(sums))[1]
    k = len(data) - anchor + 1
    hashes = mixed((sums[anchor:] - sums[:-anchor]) * inverse[:k])
    bits = np.uint64(max(int(k).bit_length(), 1))
    ranked = (hashes >> bits << bits) | np.arange(k, dtype=np.uint64)
    owner = (_sliding_least(ranked, length - anchor + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    inside = np.arange(n) + length <= offs[row + 1]
    new = np.ones(n, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new & inside)
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    ends = last + length
    context = span_hashes(data, first, ends)
    return row[first], first - offs[row[first]], last - first + 1, hashes[owner[first]], context


def _pieces(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows as (first row, shift of starts, data, offsets); a row beyond the block size comes in overlapping parts."""
    for i, j in row_blocks(offs):
        lo, hi = int(offs[i]), int(offs[j])
        if hi - lo <= 2 * BLOCK_BYTES:
            yield i, 0, data[lo:hi], offs[i : j + 1] - lo
            continue
        for at in range(lo, hi - length + 1, BLOCK_BYTES):
            part = data[at : min(at + BLOCK_BYTES + length - 1, hi)]
            yield i, at - lo, part, np.array([0, len(part)])


def _anchored(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column(2))
        for i, shift, part, part_offs in _pieces(data, offs, length):
            row, first, windows, a, c = anchors(part, part_offs, length, anchor)
            at = pa.array(row + i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(first + shift), pa.array(windows.astype(np.int32))], ["doc_id", "text_key", "anchor", "context", "start", "windows"])


# ---------------------------------------------------------------- the index

class RunIndex:
    """The run-compressed transform of some bytes, with sampled run ends.

    heads, chars: where each run of the transform starts, and its byte. first, last: text positions of
    the suffixes at both ends of each run. above: common prefix of a run's first suffix with the one
    before it, which is that of the run before's last suffix with the one after it.
    """

    def __init__(self, text: np.ndarray):
        self.size = n = len(text)
        words = _words(text)
        order = _suffix_order(words[:n])
        char = text[order - 1]
        head = np.ones(n, bool)
        head[1:] = char[1:] != char[:-1]
        # The suffix that is the whole text has no byte before it: a run of its own.
        whole = int(np.flatnonzero(order == 0)[0])
        head[whole : whole + 2] = True
        self.heads = np.flatnonzero(head)
        self.chars = char[self.heads]
        self.first = order[self.heads]
        self.last = order[np.append(self.heads[1:], n) - 1]
        self.above = np.zeros(len(self.heads), np.int64)
        if len(self.heads) > 1:
            self.above[1:] = _common(words, n, self.first[1:], self.last[:-1])

    def statistics(self) -> np.ndarray:
        """For each text position, the longest match with another position."""
        up = self._stream(self.first, self.above)
        return np.maximum(up, self._stream(self.last, np.append(self.above[1:], 0)))

    def _stream(self, samples: np.ndarray, values: np.ndarray) -> np.ndarray:
        order = np.argsort(samples)
        at = samples[order]
        span = np.diff(np.append(at, self.size))
        return np.maximum(np.repeat((values[order] + at), span) - np.arange(self.size), 0)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros beyond the end (and eight words more)."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    out = np.zeros(n + 8, np.uint64)
    for b in range(8):
        out |= padded[b : b + n + 8].astype(np.uint64) << np.uint64(56 - 8 * b)
    return out


def _suffix_order(words: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling from eight bytes on; only ties are sorted again."""
    n = len(words)
    order = np.argsort(words)
    sorted_words = words[order]
    new = np.ones(n, bool)
    new[1:] = sorted_words[1:] != sorted_words[:-1]
    del sorted_words
    rank = np.zeros(n + 1, np.int64)
    slots = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    depth = 8
    while True:
        alone = new & np.append(new[1:], True)
        slots, new = slots[~alone], None
        if not len(slots):
            return order
        held = order[slots]
        after = np.minimum(held + depth, n)
        key = rank[held] << 32 | np.where(after < n, rank[after] + 1, 0)
        sub = np.argsort(key)
        order[slots] = held = held[sub]
        key = key[sub]
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[held] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        depth *= 2


def _common(words: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and b, eight bytes at a step."""
    out = np.zeros(len(a), np.int64)
    live, step = np.arange(len(a)), 0
    while len(live):
        p, q = a[live] + step, b[live] + step
        room = n - np.maximum(p, q)
        x = words[np.minimum(p, n)] ^ words[np.minimum(q, n)]
        low = np.zeros(len(live), np.int64)
        for bit in (32, 16, 8):
            zero = x >> np.uint64(64 - bit) == 0
            low += np.where(zero, bit // 8, 0)
            x = np.where(zero, x << np.uint64(bit), x)
        same = np.where(x == 0, 8, np.minimum(low, 7))
        out[live] = step + np.minimum(same, np.maximum(room, 0))
        live = live[(same == 8) & (room > 8)]
        step += 8
    return out


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each text, the runs [from, to) of window starts whose window also starts elsewhere in texts."""
    joined = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    hit = RunIndex(joined).statistics() >= length if len(joined) else np.zeros(0, bool)
    # A match may run over end bytes, which are all alike; a window that holds one is none.
    ends = np.repeat(starts + sizes - 1, sizes)
    hit &= np.arange(len(joined)) + length <= ends
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(starts, lo, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for t, x, y in zip(owner.tolist(), (lo - starts[owner]).tolist(), (hi - starts[owner]).tolist(), strict=True):
        out[t].append((x, y))
    return out


def _indexed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Whole groups (the input is sorted by anchor) are gathered into indexes of INDEX_BYTES and matched."""
    rows, size, last = [], 0, None
    for batch in batches:
        for anchor, context, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "body")), strict=True):
            if anchor != last and size >= INDEX_BYTES:
                yield _matched(rows, length)
                rows, size = [], 0
            last = anchor
            rows.append((anchor, context, body))
            size += len(body) + 1
    if rows:
        yield _matched(rows, length)


def _matched(rows: list[tuple[int, int, bytes]], length: int) -> pa.RecordBatch:
    out = [(a, c, lo, hi) for (a, c, _), found in zip(rows, repeated_windows([r[2] for r in rows], length), strict=True) for lo, hi in found]
    columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["anchor", "context", "lo", "hi"])


def _anchored_again(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = batch.column("body")
        data, offs = text_bytes(_as_text(bodies))
        for i, j in row_blocks(offs, BLOCK_BYTES // 4):
            part, part_offs = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            row, first, windows, a, c = anchors(part, part_offs, length, anchor)
            at = pa.array(row + i)
            cut = [part[s : s + w + length - 1].tobytes() for s, w in zip((part_offs[row] + first).tolist(), windows.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(at), batch.column("context").take(at), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(first), pa.array(windows.astype(np.int32)), pa.array(cut, pa.binary())], ["anchor", "context", "anchor2", "context2", "first", "windows", "body"])


def _as_text(bodies: pa.Array) -> pa.Array:
    """The same buffers seen as text: contexts may begin or end inside a character, so nothing is decoded."""
    wide = bodies.cast(pa.large_binary())
    return pa.Array.from_buffers(pa.large_string(), len(wide), wide.buffers(), offset=wide.offset)


def _resolve(contexts: DataFrame, length: int, anchor: int, most: int) -> DataFrame:
    """anchor, context, lo, hi: runs of repeated windows of each context (anchor, context, body) with others."""
    sizes = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > most).select("anchor"), "large-groups")
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = not large.isEmpty()
    small = contexts.join(large, "anchor", "left_anti") if some else contexts
    dealt = small.select("anchor", "context", "body").repartition(n, "anchor").sortWithinPartitions("anchor", "context")
    found = dealt.mapInArrow(lambda it: _indexed(it, length), "anchor bigint, context bigint, lo bigint, hi bigint")
    if not some:
        return found
    longer = (anchor + length + 1) // 2
    again = contexts.join(large, "anchor", "left_semi").select("anchor", "context", "body")
    subs = stored(again.mapInArrow(lambda it: _anchored_again(it, length, longer), "anchor bigint, context bigint, anchor2 bigint, context2 bigint, first bigint, windows int, body binary"), "sub-contexts")
    entries = subs.groupBy(F.col("anchor2").alias("anchor"), F.col("context2").alias("context")).agg(F.count(F.lit(1)).alias("copies"), F.min("windows").alias("windows"), F.min("body").alias("body"))
    entries = stored(entries, "contexts")
    several = entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    inner = _resolve(entries.join(several, "anchor", "left_semi"), length, longer, most).unionByName(_copied(entries))
    marks = subs.drop("body").join(inner.select(F.col("anchor").alias("anchor2"), F.col("context").alias("context2"), "lo", "hi"), ["anchor2", "context2"])
    return found.unionByName(marks.select("anchor", "context", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi")))


def _copied(entries: DataFrame) -> DataFrame:
    """Contexts that the corpus holds more than once repeat throughout."""
    return entries.where("copies > 1").select("anchor", "context", F.lit(0).cast("bigint").alias("lo"), F.col("windows").cast("bigint").alias("hi"))


# ---------------------------------------------------------------- the corpus

def _keyed(docs: DataFrame) -> DataFrame:
    """The text and its hash beside the id: rows of one id and different texts stay apart."""
    text = F.col("text").cast("string")
    return docs.withColumn("text_key", F.xxhash64(text)).select("doc_id", "text_key", text.alias("text"))


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            raw = (text or "").encode()
            rows += [(w["anchor"], w["context"], raw[w["start"] : w["start"] + w["windows"] + length - 1]) for w in wanted]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["anchor", "context", "body"])


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most: int = GROUP_CONTEXTS) -> DataFrame:
    """doc_id, text_key, spans: the byte spans [lo, hi) of each text that repeat, unmerged; texts without any are left out."""
    texts = _keyed(docs)
    found = texts.where(F.octet_length("text") >= length).mapInArrow(lambda it: _anchored(it, length, anchor), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, anchor bigint, context bigint, start bigint, windows int")
    # Written first: a join of two plain exchanges can be split where one anchor is very common.
    twice = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    places = stored(found.join(twice, "anchor"), "places")
    entries = stored(places.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"), F.min("windows").alias("windows"), F.min(F.struct("doc_id", "text_key", "start")).alias("at")), "entries")
    several = stored(entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "several")
    # Keys that are never null: rows of equal id and text are made one by the exchange of this join.
    row = lambda key, text_key: {"id_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "nameless": F.col(key).isNull(), "key": F.col(text_key)}
    wanted = entries.join(several, "anchor").withColumns(row("at.doc_id", "at.text_key")).groupBy("id_key", "nameless", "key").agg(F.collect_list(F.struct("anchor", "context", F.col("at.start").alias("start"), "windows")).alias("wanted"))
    met = texts.withColumns(row("doc_id", "text_key")).join(wanted.hint("merge"), ["id_key", "nameless", "key"]).dropDuplicates(["id_key", "nameless", "key"])
    fetched = met.select("text", "wanted").mapInArrow(lambda it: _cut_out(it, length), "anchor bigint, context bigint, body binary")
    contexts = stored(fetched, "contexts")
    marks = _resolve(contexts, length, anchor, most).unionByName(_copied(entries))
    spans = places.join(marks, ["anchor", "context"]).select("doc_id", "text_key", F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") - 1 + length).alias("hi")).alias("span"))
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def _removed(batches: Iterator[pa.RecordBatch], names: list[str], as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, gone, cuts, kept = [], [], [], []
        for text, spans in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
            raw, runs = (text or "").encode(), merged(spans or [])
            parts, at = [], 0
            for lo, hi in runs:
                parts.append(raw[at:lo])
                at = hi
            parts.append(raw[at:])
            sizes.append(len(raw)), gone.append(sum(hi - lo for lo, hi in runs)), cuts.append(len(runs)), kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, pa.int64()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], [*names, "n_bytes", "n_removed", "n_spans", "kept_text" if as_text else "kept_bytes"])


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, anchor: int = ANCHOR, most: int = GROUP_CONTEXTS, as_text: bool = False) -> DataFrame:
    """keep, n_bytes, n_removed, n_spans and kept_bytes (the text without every repeated span) of each row.

    as_text gives kept_text instead, without characters that a cut goes through.
    """
    names = list(keep)
    spans = repeats(docs, length, anchor, most).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans"))
    text = F.col("text").cast("string")
    rows = docs.select(*names, F.col("doc_id").alias("__doc"), text.alias("__text"), F.xxhash64(text).alias("__text_key"))
    both = rows.join(spans, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left").select(*names, "__text", "__spans")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_text string" if as_text else "kept_bytes binary")])
    return both.mapInArrow(lambda it: _removed(it, names, as_text), schema)

"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token that is no token itself starts as a linked list of bytes. Every adjacent pair that the
vocabulary ranks is queued: a bucket for each rank holds list positions, and two levels of words mark
the ranks with a bucket, so the next rank takes two find-first-set steps however long the pre-token is.
Entries whose pair has changed since are skipped when met. The leftmost of equal ranks goes first, so
the ids are those of a scan for the least rank.

Defined results: null and empty texts have no ids and decode to no bytes. Repeated rows are encoded
alike. Whole texts are encoded, whatever their length; only pre-tokens of up to CACHED characters are
remembered, in two generations of CACHE_SIZE each at most. Columns of the input other than those kept are not looked at.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED, CACHE_SIZE = 48, 350_000
#: Texts above this many characters are split as a stream instead of as a list.
STREAM_CHARS = 1 << 21
#: Rows of a batch that goes back to Spark.
BATCH_ROWS = 512


class Encoder:
    """Encodes by a vocabulary of ranks.

    The queue lies in buckets (positions by rank), words (one bit for each rank with a bucket,
    2^SHIFT of them in a word) and top (one bit for each word that is not 0). It is empty between calls.
    """

    SHIFT = 8

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.words = [0] * ((max(ranks.values(), default=0) >> self.SHIFT) + 1)
        self.buckets: dict[int, list[int]] = {}
        self.longest = max(map(len, ranks), default=0)
        self.bits = [1 << i for i in range(max(1 << self.SHIFT, len(self.words)))]
        self.pairs = [ranks.get(bytes((i, j)), -1) for i in range(256) for j in range(256)]
        self.cache = _Cache(self)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        rank_of, whole = self.ranks.get, self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, longest = len(piece), self.longest
        buckets, words, bits, pairs, shift = self.buckets, self.words, self.bits, self.pairs, self.SHIFT
        low, top = (1 << shift) - 1, 0
        following, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        last = piece[0]
        for i in range(n - 1):
            code = last << 8
            last = piece[i + 1]
            r = pair[i] = pairs[code | last]
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    words[r >> shift] |= bits[r & low]
                    top |= bits[r >> shift]
        while top:
            at = (top & -top).bit_length() - 1
            word = words[at]
            rank = at << shift | (word & -word).bit_length() - 1
            queue = buckets.pop(rank)
            words[at] = word = word & (word - 1)
            if not word:
                top &= top - 1
            if len(queue) > 1:
                queue.sort()
            least = rank
            for step, i in enumerate(queue):
                if pair[i] != rank:
                    continue
                j = following[i]
                following[i] = k = following[j]
                pair[j] = pair[i] = -1
                p = before[i]
                if k < n:
                    before[k] = i
                    end = following[k]
                    if end - i <= longest and (r := rank_of(piece[i:end], -1)) >= 0:
                        pair[i] = r
                        if r < least:
                            least = r
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            words[r >> shift] |= bits[r & low]
                            top |= bits[r >> shift]
                if p >= 0:
                    if k - p <= longest and (r := rank_of(piece[p:k], -1)) >= 0:
                        pair[p] = r
                        if r < least:
                            least = r
                        if r in buckets:
                            buckets[r].append(p)
                        else:
                            buckets[r] = [p]
                            words[r >> shift] |= bits[r & low]
                            top |= bits[r >> shift]
                    else:
                        pair[p] = -1
                if least < rank:
                    # A lesser rank has appeared: it goes first, the rest of this bucket waits.
                    if step + 1 < len(queue):
                        buckets[rank] = queue[step + 1 :] + buckets.get(rank, [])
                        words[rank >> shift] |= bits[rank & low]
                        top |= bits[rank >> shift]
                    break
        out, i = [], 0
        while i < n:
            j = following[i]
            out.append(rank_of(piece[i:j]))
            i = j
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        pieces = self.split.findall(text) if len(text) <= STREAM_CHARS else (m[0] for m in self.split.finditer(text))
        out = b"".join(map(self.cache.__getitem__, pieces))
        if len(self.cache) > CACHE_SIZE:
            self.cache = _Cache(self, dict(self.cache))
        return out


class _Cache(dict):
    def __init__(self, encoder: Encoder, older: dict[str, bytes] | None = None):
        super().__init__()
        self.encoder, self.older = encoder, older or {}

    def __missing__(self, piece: str) -> bytes:
        known = self.older.get(piece)
        if known is not None:
            self[piece] = known
            return known
        ids = self.encoder.merge(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED:
            self[piece] = packed
        return packed


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode_ids(ids: bytes, path: str) -> bytes:
    vocabulary = _vocabulary(path)
    return b"".join([vocabulary[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _mapped(df: DataFrame, read: str, made: tuple[str, ...], f: Callable[[], Callable]) -> DataFrame:
    """df with the binary columns made: the results of f()(value of the column read); nulls count as empty."""
    names = [c for c in df.columns if c not in made]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), *(f"`{m}` binary" for m in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = f()
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH_ROWS):
                part = whole.slice(i, BATCH_ROWS)
                done = [one(x) if x is not None else (b"",) * len(made) for x in part.column(read).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array([d[k] for d in done], pa.binary()) for k in range(len(made)))], [*names, *made])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column ids: binary, little-endian unsigned 32-bit integers."""
    return _mapped(df, text, (ids,), lambda: lambda x: (encoder(path, pattern).encode(x),))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for."""
    return _mapped(df, ids, (decoded,), lambda: lambda x: (decode_ids(x, path),))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with ids, as encode makes them, and decoded, as decode makes that of them, from one pass through one Python worker a task."""

    def both(x: str) -> tuple[bytes, bytes]:
        made = encoder(path, pattern).encode(x)
        return made, decode_ids(made, path)

    return _mapped(df, text, (ids, decoded), lambda: both)


def digest(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """id_column, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    coded = round_trip(df.select(id_column, "text"), path, pattern).drop("text")
    return coded.select(id_column, F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Token ids as length-delimited binary records with a separate offset index.

A shard is a row of frames: the payload's length (8 bytes, little-endian), the masked checksum of
those 8 bytes (4 bytes), the payload, the masked checksum of the payload (4 bytes). The payload is the
document id (8 bytes, signed), the width of an id (1 byte) and the ids, unsigned and little-endian, of 2
bytes each where all of the record's fit into that and of 4 bytes else. The checksum is CRC-32, masked
by a rotation and a constant so that a checksum of data which holds checksums stays sound. Beside each
shard, an index of unsigned 64-bit offsets gives each frame's place, so single records can be read in
any order. Shards are written under a temporary name and renamed, so a lost executor leaves none half
done, and a task that runs twice writes the same bytes.

Defined results: null and empty texts give records with the end id alone. Shards follow each other in
ascending document id, nulls first; rows with equal ids follow in order of their texts. An empty table
gives no shard. Columns of the input other than id and text are not looked at.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import scratch

_HEAD, _CRC, _ID = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qB")
#: Written in place of a null id.
_NO_ID = -(1 << 63)
CACHE_SIZE = 350_000
#: Text bytes that a shard has on average.
SHARD_BYTES = 32 << 20
#: Records read before a batch goes back to Spark.
BATCH_ROWS = 4096


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, _CRC.pack(masked(size)), payload, _CRC.pack(masked(payload))))


def payload_of(doc_id: int | None, ids: bytes) -> bytes:
    """A record's payload from 32-bit ids."""
    numbers = np.frombuffer(ids, "<u4")
    width = 2 if not len(numbers) or int(numbers.max()) < 1 << 16 else 4
    return _ID.pack(_NO_ID if doc_id is None else doc_id, width) + (numbers.astype("<u2").tobytes() if width == 2 else ids)


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and 32-bit ids of a payload."""
    doc_id, width = _ID.unpack_from(payload)
    return (None if doc_id == _NO_ID else doc_id), np.frombuffer(payload, f"<u{width}", offset=_ID.size).astype("<u4")


def read_frame(stream, offset: int | None = None) -> bytes:
    """The payload at offset (or where the stream stands); ValueError if a checksum does not fit."""
    if offset is not None:
        stream.seek(offset)
    head = stream.read(12)
    if len(head) < 12:
        raise ValueError("record cut short in its head")
    size, crc = _HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise ValueError("length checksum differs")
    payload, tail = stream.read(size), stream.read(4)
    if len(payload) < size or len(tail) < 4:
        raise ValueError("record cut short")
    if masked(payload) != _CRC.unpack(tail)[0]:
        raise ValueError("payload checksum differs")
    return payload


#: ASCII marks that end a word as a pre-token of their own; the apostrophe starts contractions and is not among them.
_MARKS = "!\"#$%&()*+,-./:;=?@[]^_`{|}~"


#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


#: The normalizer and pre-tokenizer, as tokenizer files state them, on which _Words rests: lower case, words
#: parted by white space that is dropped, letters apart from marks.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def goes_by_words(path: str) -> bool:
    """Whether a tokenizer file is of the kind whose words can be encoded one by one; any other file is used as the library does."""
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    added = [t["content"] for t in stated.get("added_tokens") or []]
    return stated.get("normalizer") == _NORMALIZER and stated.get("pre_tokenizer") == _PRE_TOKENIZER and not any(t.split() != [t] for t in added)


class _Whole:
    """Packed ids of whole texts by the library alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Words(dict):
    """Packed ids of words without white space: the tokenizer drops white space and never merges over it (see goes_by_words).

    A word of Latin letters with marks after it goes by its letters in lower case and its marks, which are
    pre-tokens of their own; such letters are one pre-token, which the library's model takes directly.
    Words are remembered in two generations of CACHE_SIZE each at most.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            text = word.decode()
            core = text.rstrip(_MARKS)
            latin = core.isalpha() and max(core) < "\u0250" and "\u0130" not in core
            low = core.lower() if latin else text
            if low != text:
                packed = self[low.encode()]
                if len(core) < len(text):
                    packed += self[text[len(core) :].encode()]
            else:
                if latin:
                    ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_ALPHABET))]
                else:
                    ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self[word] = packed
        return packed

    def ids(self, text: str) -> bytes:
        out = b"".join(map(self.__getitem__, text.encode().split()))
        if len(self) > CACHE_SIZE:
            self.older = dict(self)
            self.clear()
        return out


@lru_cache(maxsize=2)
def _words(path: str) -> _Words | _Whole:
    return _Words(path) if goes_by_words(path) else _Whole(path)


def token_ids(text: str | None, path: str, end_id: int | None) -> bytes:
    """Little-endian unsigned 32-bit ids of a whole text, and the end id."""
    return _words(path).ids(text or "") + (b"" if end_id is None else struct.pack("<I", end_id))


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    store, root = fs.FileSystem.from_uri(folder)
    name, attempt = f"shard-{part:06d}", uuid.uuid4().hex
    out, offsets, place, first, last, ids = None, [], 0, None, None, 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out = out or store.open_output_stream(f"{root}/_{attempt}.rec")
            packed = token_ids(text, path, end_id)
            record = frame(payload_of(doc_id, packed))
            out.write(record)
            offsets.append(place)
            place += len(record)
            ids += len(packed) // 4
            first, last = (doc_id if len(offsets) == 1 else first), doc_id
    if out is None:
        return
    out.close()
    with store.open_output_stream(f"{root}/_{attempt}.idx") as index:
        index.write(np.asarray(offsets, "<u8").tobytes())
    for end in ("rec", "idx"):
        store.move(f"{root}/_{attempt}.{end}", f"{root}/{name}.{end}")
    yield pa.RecordBatch.from_pydict({"part": [part], "shard": [name], "records": [len(offsets)], "ids": [ids], "bytes": [place], "first_id": [first], "last_id": [last]}, schema=_MANIFEST)


_MANIFEST = pa.schema([("part", pa.int64()), ("shard", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def write(docs: DataFrame, path: str, end_id: int | None = 2, folder: str | None = None, shards: int | None = None) -> str:
    """Encode and write all rows of docs in ascending doc_id order; the folder, with its manifest in Parquet.

    Texts are dealt by ranges of doc_id before they are encoded, so each is encoded once.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "records")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if shards is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-total // SHARD_BYTES), min(spark.sparkContext.defaultParallelism, total >> 20))
    dealt = rows.repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(lambda it: _write_shard(it, folder, path, end_id), "part bigint, shard string, records bigint, ids bigint, bytes bigint, first_id bigint, last_id bigint").write.parquet(f"{folder}/manifest")
    return folder


def _read_shards(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for shard, base, count in zip(*(batch.column(c).to_pylist() for c in ("shard", "base", "records")), strict=True):
            with store.open_input_stream(f"{root}/{shard}.rec", buffer_size=1 << 20) as stream:
                rows = []
                for _ in range(count):
                    doc_id, ids = parsed(read_frame(stream))
                    rows.append((doc_id, base, len(ids), ids.tobytes()))
                    base += len(ids)
                    if len(rows) == BATCH_ROWS or sum(len(r[3]) for r in rows[-1:]) > 1 << 22:
                        yield _record_batch(rows)
                        rows = []
                if stream.read(1):
                    raise ValueError(f"{shard} holds more than its manifest says")
                if rows:
                    yield _record_batch(rows)


def _record_batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids of each record, checksums verified."""
    shards = spark.read.schema("part bigint, shard string, records bigint, ids bigint").parquet(f"{folder}/manifest")
    placed = shards.select("shard", "records", F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # One row for each shard: they are dealt out again, to be read side by side.
    spread = placed.repartition(max(1, spark.sparkContext.defaultParallelism), "shard")
    return spread.mapInArrow(lambda it: _read_shards(it, folder), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_at(folder: str, shard: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number in a shard, through the offset index."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{shard}.idx") as index:
        index.seek(8 * number)
        offset = struct.unpack("<Q", index.read(8))[0]
    with store.open_input_file(f"{root}/{shard}.rec") as stream:
        return parsed(read_frame(stream, offset))

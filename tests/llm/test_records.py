import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from millrace.llm import records

PATH = P.path("word_bpe_49k.json")


def test_words_as_whole_texts():
    rnd, whole = random.Random(1), Tokenizer.from_file(PATH)
    letters = [*"abcdefgh ABC  \t\n'sé漢字0123٣ \x1c\x0b\x85́🙂ßΣσİ!?#.", "<|endoftext|>", "the ", "ing", " 's", "Word. "]
    for _ in range(1500):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert np.frombuffer(records.token_ids(text, PATH, None), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_frames_are_checked(tmp_path):
    data = records.frame(b"some payload") + records.frame(b"")
    path = tmp_path / "x.rec"
    for at in (0, 9, 15, len(data) - 1):
        path.write_bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        with path.open("rb") as f, pytest.raises(ValueError):
            records.read_frame(f), records.read_frame(f)
    path.write_bytes(data[:-3])
    with path.open("rb") as f, pytest.raises(ValueError):
        records.read_frame(f), records.read_frame(f)
    path.write_bytes(data)
    with path.open("rb") as f:
        assert (records.read_frame(f), records.read_frame(f)) == (b"some payload", b"")


@pytest.mark.parametrize("ids", [[], [2], [65535, 1], [65536, 1, 0]])
def test_payload_round_trip(ids):
    packed = np.array(ids, "<u4").tobytes()
    for doc_id in (None, -5, 7):
        got, numbers = records.parsed(records.payload_of(doc_id, packed))
        assert got == doc_id and numbers.tolist() == ids


def test_table_round_trip_and_index(spark, clashing, words):
    rows = [(i, words(20 + i)) for i in (5, 3, 9, 1, 40, 7)] + [(2, None), (4, ""), (None, "no id"), (6, words(3000, 1)), (7, "same id")]
    folder = records.write(clashing(rows), PATH, end_id=2, shards=3)
    out = records.read(spark, folder).collect()
    tokenizer, start = Tokenizer.from_file(PATH), 0
    assert len(out) == len(rows)
    for r in sorted(out, key=lambda r: r["start"]):
        text = next(t for i, t in rows if i == r["doc_id"] and (i != 7 or len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 == r["n_tokens"]))
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert r["start"] == start and r["n_tokens"] == len(want) and zlib.crc32(bytes(r["ids"])) == zlib.crc32(want.tobytes())
        start += len(want)
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    shard = spark.read.parquet(f"{folder}/manifest").orderBy("part").first()
    doc_id, ids = records.read_at(folder, shard["shard"], shard["records"] - 1)
    assert doc_id == shard["last_id"] and ids[-1] == 2


def test_empty_table(spark, docs):
    folder = records.write(docs([]).limit(0), PATH)
    assert records.read(spark, folder).collect() == []


def test_other_tokenizer_files_are_used_as_they_are(tmp_path):
    assert records.goes_by_words(PATH)
    stated = json.load(open(PATH))
    for name, change in (("case", {"normalizer": {"type": "NFC"}}), ("pre", {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}})):
        other = tmp_path / f"{name}.json"
        other.write_text(json.dumps(stated | change))
        whole = Tokenizer.from_file(str(other))
        assert not records.goes_by_words(str(other))
        for text in ("Some Words, and  MORE.", "", "été\n the End"):
            assert np.frombuffer(records.token_ids(text, str(other), None), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids

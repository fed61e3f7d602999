import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from millrace.llm import bpe


@pytest.fixture
def corpus(spark, docs, words, tmp_path):
    r = random.Random(8)
    passage = words(70, 500)
    rows = [(i, f"{words(60 + i, i)}\n{passage if i % 7 == 0 else words(20, 900 + i)}", "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(5)]
    rows += [(200, " ".join(w + "$$$" for w in words(50, 3).split()), "en", "s1"), (201, "same words " * 40, "en", "s1"), (202, "short", "en", None), (203, None, None, None), (None, words(40, 77), "en", "s2")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs(rows).selectExpr("*", "1 as kept", "'x' as anomaly", "2 as `size`").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return rows, str(tmp_path), r, passage


def test_stages(spark, corpus, tmp_path):
    rows, sf_dir, _, passage = corpus
    table, texts, results = spark.read.parquet(f"{sf_dir}/documents.parquet"), dict((i, t) for i, t, *_ in rows), {}
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, sf_dir).write.parquet(f"{tmp_path}/out-{name}")
        table = spark.read.parquet(f"{tmp_path}/out-{name}")
        results[name] = table.collect()
        assert name == "byte_bpe" or table.columns == columns
    kept = {r["doc_id"] for r in results["quality_rules"]}
    assert kept == {i for i in texts if i is None or i < 200}
    assert {r["doc_id"] for r in results["minhash_near_dedup"]} == {i for i in kept if i is None or i < 100}
    cut = {r["doc_id"]: r for r in results["suffix_array_dedup"]}
    own = {i: texts[i] for i in cut}
    count = Counter(t[k : k + 200] for t in own.values() for k in range(len(t) - 199))
    for i, t in own.items():
        gone = {j for k in range(len(t) - 199) if count[t[k : k + 200]] > 1 for j in range(k, k + 200)}
        assert cut[i]["text"] == "".join(c for j, c in enumerate(t) if j not in gone) and cut[i]["n_chars"] == len(t) - len(gone)
    assert not any(passage in r["text"] for r in results["suffix_array_dedup"])
    size = {i: len(r["text"].split()) for i, r in cut.items()}
    copies = Counter(r["doc_id"] for r in results["mixing_sources"])
    assert max(copies.values()) <= 2 and all(r["text"] == cut[r["doc_id"]]["text"] for r in results["mixing_sources"])
    mixed, whole = sum(size[i] * n for i, n in copies.items()), sum(size.values())
    assert abs(mixed - 1.5 * whole) < 8 * max(size.values())
    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in results["byte_bpe"]:
        text = cut[r["doc_id"]]["text"]
        assert r["n_tokens"] == len(oracle.encode_ordinary(text)) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert Counter(r["doc_id"] for r in results["byte_bpe"]) == copies


def test_near_dedup_of_one_id_with_several_texts(spark, docs, words):
    a, b, c, d, e = (words(80, k) for k in range(5))
    rows = [(5, a), (5, a), (5, b), (3, b + " end"), (9, c), (9, d), (9, d), (7, e), (8, e), (8, c), (None, a), (None, a), (6, None), (6, "")]
    kept = corpus_pipeline.near_dedup(spark, docs(rows), "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(5, a), (3, b + " end"), (9, d), (7, e), (8, c), (None, a), (None, a), (6, None), (6, "")])


def test_which_of_equal_rows_stays_is_settled(spark, docs, words):
    """Of rows equal in id and text but not in source, reruns and other partitions keep the same one, also with a map beside them."""
    a, b = words(60, 1), words(60, 2)
    rows = [(1, a, "en", f"s{i}") for i in range(8)] + [(2, b, "de", f"s{i}") for i in range(8)]
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.mix_sources):
        kept = []
        for made in (docs(rows).repartition(1), docs(rows[::-1]).repartition(5)):
            beside = made.selectExpr("*", "map('k', source) as notes")
            kept.append(sorted({(r["doc_id"], r["source"], r["notes"]["k"]) for r in stage(spark, beside, "").collect()}))
        assert kept[0] == kept[1] and len({i for i, *_ in kept[0]}) == len(kept[0])


def test_empty_tables(spark, docs, tmp_path):
    docs([]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

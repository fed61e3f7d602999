"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, ready
from . import bpe, decontaminate, htmlmain, langid, mixing, neardup, quality, records, resample, runindex, topk, urlrules, whiten


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = runindex.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


#: The host rules of the contract.
HOST_RULES = (
    urlrules.host_rule("com", "/en/", block=True),
    urlrules.host_rule("example.com", "/en/7", block=False),
    urlrules.host_rule("net", "/de/", block=False),
    urlrules.host_rule("example.net", "/de/8", block=True),
    urlrules.host_rule("org", "/es/", block=True),
)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), (*HOST_RULES, *urlrules.DEFAULT_PATTERNS))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"), keep=("page_id", "url"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0, schedules=mixing.tilted())
    placed = planned.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))
    return mixing.sorted_by_position(placed)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.prototypes(docs.where(~langid.held_out()))
    predicted = langid.predict(docs, learned)
    return predicted.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=75).select("doc_id", "n_shingles", "component_id", "kept")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = records.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return records.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed=2024, buckets=10000)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64, offset=1_000_000)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def _ready(f: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _ready(f) for f in (op1_suffix_dedup, op2_url_filters, op3_byte_bpe, op4_html_extraction, op5_mixing, op6_language_id, op7_topk_search, op8_quality_rules, op9_minhash_near_dedup, op10_token_records, op11_importance_resampling, op12_embedding_whitening, op13_decontamination)}

_PATTERNS = ", ".join(f"('{r.name}', '{r.pattern}', {str(r.block).lower()})" for r in urlrules.DEFAULT_PATTERNS)

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": f"""
        with parts as (
            select page_id,
                translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
            from pages),
        host_rules(h, p, block) as (values ('com', '/en/', true), ('example.com', '/en/7', false), ('net', '/de/', true), ('example.net', '/de/8', false), ('org', '/es/', true)),
        patterns(name, pattern, block) as (values {_PATTERNS}),
        hosted as (
            select page_id, host, path,
                (select max_by(h || p, length(h || p)) from host_rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as rule,
                (select max(name) from patterns where regexp_matches(host || path, pattern)) as pattern
            from parts)
        select page_id, host, path, rule, case when rule is null then pattern end as pattern,
            case when rule is not null then (select case when block then 'block' else 'allow' end from host_rules where h || p = rule)
                 when pattern is not null then 'block' else 'allow' end as verdict
        from hosted""",
    "op5_mixing": r"""
        with sizes as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))) as k from documents),
        per as (select source, sum(size)::bigint as source_size from sizes group by source),
        ranked as (select *, row_number() over (order by source nulls last) - 1 as rank from per),
        weighted as (select *, [3, 1, 2][(rank % 3)::int + 1]::double as weight, 2.0::double * source_size as cap from ranked),
        levels as (
            select *, coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as before,
                sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as after,
                1.5::double * (sum(source_size) over ())::double as total from weighted),
        goals as (select source, rank, source_size, least(cap, weight * max((total - before) / after) over ()) as target from levels),
        placed as (select *, coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as place from sizes),
        mixed as (
            select doc_id, size, g.source_size, target, place, rank,
                (greatest(least(floor(target)::bigint - place, size), 0) + greatest(least(floor(target)::bigint - place - g.source_size, size), 0))::bigint as taken,
                case when target > 0 then place / target else 1.0 end as demand
            from placed p join goals g on p.source is not distinct from g.source)
        select doc_id, size, source_size, target, taken,
            round(case when rank % 2 = 0 then least(2.0 * demand / (1.5 + sqrt(greatest(2.25 - 2.0 * demand, 0))), 1.0)
                       else least(2.0 * demand / (0.5 + sqrt(greatest(0.25 + 2.0 * demand, 0))), 1.0) end, 6) as position
        from mixed""",
    "op7_topk_search": """
        with rows as materialized (
            select vec_id, row_number() over () as own, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
            from rows q join rows c on q.own <> c.own where q.vec_id % 50 = 0),
        ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op9_minhash_near_dedup": r"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        shingles as (
            select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        common as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
        links as (select c.a, c.b from common c join sizes x on x.doc_id = c.a join sizes y on y.doc_id = c.b where 100 * c.n >= 75 * (x.n + y.n - c.n)),
        reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a),
        least as (select a as doc_id, min(b) as component_id from reach group by a)
        select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
        from documents d join least using (doc_id) left join sizes using (doc_id)""",
    "op11_importance_resampling": r"""
        with crc_table as materialized (
            select list(list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, n) order by n) as steps from range(256) r(n)),
        words as (
            select 1 as raw, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
            union all
            select 0, null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
        numbered as materialized (select row_number() over () as own, * from words),
        spread as materialized (select own, raw, unnest(w) as f from numbered),
        hexed as (select f, hex(f) as h from (select distinct f from spread)),
        buckets as materialized (
            select f, xor(list_reduce(list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint),
                lambda c, b: xor(steps[xor(c, b) % 256 + 1], c // 256), 4294967295), 4294967295) % 10000 as bucket from hexed, crc_table),
        counted as (select bucket, sum(raw) as s, sum(1 - raw) as t from spread join buckets using (f) group by bucket),
        gains as (select bucket, floor(1000 * ln((t + 1)::double * ((sum(s) over ()) + 10000)::double / ((s + 1)::double * ((sum(t) over ()) + 10000)::double)))::bigint as gain from counted),
        weighed as (select own, sum(gain)::bigint as weight from spread join buckets using (f) join gains using (bucket) where raw = 1 group by own),
        scored as (
            select own, doc_id, len(w) as n_features, coalesce(weight, 0)::bigint as weight,
                coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
            from numbered left join weighed using (own) where raw = 1),
        placed as (select own, row_number() over (order by score desc, doc_id nulls last, n_features) as place, count(*) over () as n from scored where n_features >= 20)
        select doc_id, n_features, weight, score, case when place <= n * 10 // 100 then place end as rank from scored left join placed using (own)""",
    "op13_decontamination": r"""
        with texts as (
            select 'doc' as kind, doc_id as id, row_number() over () as own, text from documents
            union all select 'item', item_id, null, text from benchmark),
        words as materialized (select kind, id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
        items as (select coalesce(id::varchar, '') as item, w, least(len(w), 10) as n from words where kind = 'item' and len(w) > 0),
        windows as materialized (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as s from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from items)),
        lengths as (select distinct n from windows),
        places as (select own, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where kind = 'doc' and len(w) >= n),
        hits as materialized (select own, n, i, item from (select own, n, i, array_to_string(w[i:i + n - 1], ' ') as s from places) join windows using (n, s)),
        hit_words as (select own, count(*) as n_hit from (select distinct own, unnest(range(i, i + n)) as p from (select distinct own, i, n from hits)) group by own),
        lists as (select own, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as digest from (select distinct own, item from hits) group by own)
        select id as doc_id, len(w) as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(digest, sha256('')) as items_sha256, n_hit is not null as contaminated
        from words left join hit_words using (own) left join lists using (own) where kind = 'doc'""",
}

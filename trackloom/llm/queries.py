"""The queries of the text operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, fingerprints, pieces, pii, quality, simhash, spelling, substrings, token_counts, toxicity, warc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.deduplicate(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir), reach=pii.REACH)  # as OP4_SQL has it
    counts = [pii.count_of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    digest = F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated")
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir), errors=True))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.summaries(conversations.damage(convs), convs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_fingerprints, op3_toxicity, op4_pii, op5_byte_bpe, op6_decontaminate, op7_warc, op8_quality, op9_simhash,
        op10_token_counts, op11_spelling_variants, op12_sentencepiece, op13_conversation_repair
    )}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op4_pii": OP4_SQL, "op6_decontaminate": OP6_SQL, "op7_warc": OP7_SQL}


#: Every window of twenty words that is not the first of its kind.
OP1_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
     r as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
     l as (select doc_id, i from (select doc_id, i, row_number() over (partition by run order by doc_id, i) as k from r) where k > 1),
     g as (select distinct doc_id, unnest(range(i, i + 20)) as k from l),
     n as (select doc_id, count(*) as n_removed from g group by doc_id),
     x as (select d.doc_id, string_agg(word, ' ' order by x.k) as kept from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as k from d) x
           join d using (doc_id) left join g on g.doc_id = x.doc_id and g.k = x.k where g.k is null group by d.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join n using (doc_id) left join x using (doc_id)
"""

#: The base patterns as they stand, places as running sums of what is split off, and all counts over different texts.
OP4_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
     k(kind, rank, pattern) as (values ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
                                        ('card', 2, '[0-9]([\x20-]?[0-9])+'), ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]')),
     f as (select r, doc_id, t, kind, rank, regexp_extract_all(t, pattern) as m, string_split_regex(t, pattern) as p from d, k),
     u as (select *, unnest(range(1, len(m) + 1)) as i from f),
     v as (select r, t, kind, rank, m[i] as value, regexp_replace(m[i], '[^0-9]', '', 'g') as digits, right(p[i], 80) as a, left(p[i + 1], 80) as b,
                  list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) as e from u),
     base as (select *, e - length(value) as s from v where case kind when 'email' then true
                when 'ip' then len(list_filter(string_split(value, '.'), lambda x: try_cast(x as double) > 255)) = 0
                when 'card' then length(digits) between 14 and 19 and list_sum(list_transform(range(length(digits)), lambda i:
                    case when i % 2 = 0 then cast(substr(digits, length(digits) - i, 1) as int)
                         else cast(substr(digits, length(digits) - i, 1) as int) * 2 - case when substr(digits, length(digits) - i, 1) > '4' then 9 else 0 end end)) % 10 = 0
                else length(digits) between 10 and 15 end),
     c as (select r, t, kind, case when kind in ('card', 'phone') then digits else lower(value) end as entity, s, e,
                  case when length(a) < 80 then a else regexp_replace(a, '^[\p{L}\p{N}]+', '') end as a,
                  case when length(b) < 80 then b else regexp_replace(b, '[\p{L}\p{N}]+$', '') end as b from base),
     sides as (select r, t, kind, entity, lower(a) as ca, lower(b) as cb, s - length(a) as origin, a as side from c
               union all select r, t, kind, entity, lower(a), lower(b), e, b from c),
     w as (select *, regexp_extract_all(side, '[\p{L}\p{N}]+') as m, string_split_regex(side, '[\p{L}\p{N}]+') as p from sides),
     x as (select *, unnest(range(1, len(m) + 1)) as i from w),
     terms as (select r, t, kind, entity, ca, cb, lower(m[i]) as term, length(m[i]) as n,
                      origin + list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) as e
               from x where length(m[i]) >= 3 and regexp_matches(m[i], '^\p{L}')),
     total as (select count(distinct t) as n from d),
     held as (select term, count(*) as n_t from (select distinct t, lower(unnest(regexp_extract_all(t, '[\p{L}\p{N}]+'))) as term from d) where length(term) >= 3 group by term),
     pairs as (select kind, entity, term, count(distinct t) as n_et from terms group by all having count(distinct (ca, cb)) >= 3),
     entities as (select kind, entity, count(distinct t) as n_e from terms group by all having count(distinct (ca, cb)) >= 3),
     strong as (select kind, entity, term from pairs join entities using (kind, entity) join held using (term), total
                where n > n_e and log2(n_et * cast(n as double) / (n_e * cast(greatest(n_t, n_et) as double))) / log2(cast(n as double) / n_e) >= 0.7),
     places as (select distinct r, e - n as s, e from terms join strong using (kind, entity, term)),
     added as (select * from places q where not exists (select 1 from base b where b.r = q.r and b.s < q.e and q.s < b.e)),
     spans as (select r, kind, rank, s, e from base union all select r, 'term', 4, s, e from added),
     told as (select r, string_agg(concat(kind, ':', s, ':', e), ',' order by s, rank) as spans, count(*) as n_spans,
                     string_agg(concat(kind, ':', s, ':', e), ',' order by s, rank) filter (rank < 4) as base, count(*) filter (rank = 0) as n_email,
                     count(*) filter (rank = 1) as n_ip, count(*) filter (rank = 2) as n_card, count(*) filter (rank = 3) as n_phone from spans group by r)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_spans, 0) as n_spans
from d left join told using (r)
"""

#: The windows of every item, of its own length, against all runs of as many words of every document.
OP6_SQL = r"""
with letters as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as u, 'abcdefghijklmnopqrstuvwxyz' as l),
     d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents, letters),
     b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark, letters),
     p as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as run
           from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
     r as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as run
           from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from p) where len(w) >= n)),
     h as (select doc_id, item_id, i, r.n from r join p on r.n = p.n and r.run = p.run),
     c as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from h) group by doc_id),
     t as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""

OP7_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
     f as (select payload_digest, max(page_id) as first from p where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, p.payload_digest, case when page_id < first then 'revisit' else 'response' end as record_type,
       case when page_id < first then first end as refers_to
from p left join f using (payload_digest)
"""

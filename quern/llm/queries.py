"""The operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_dedup, decontaminate, embeddings, exact_dedup, hard_negatives, minhash, packing, quality, spelling, substring, token_files, toxicity, warc
from .common import read
from .tokenizing import vocabulary


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(spark, read(spark, sf, "documents"), read(spark, sf, "labels"))


def op2_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_vectors(spark, read(spark, sf, "embeddings"))


def op3_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(spark, read(spark, sf, "documents")))


def op4_suffix_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return byte_dedup.digest(byte_dedup.remove_repeated_bytes(spark, read(spark, sf, "documents")))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity_scores(spark, read(spark, sf, "documents"), read(spark, sf, "labels"))


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    manifest = token_files.write_tokens(spark, read(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))
    return token_files.read_tokens(spark, manifest)


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(spark, read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    files = warc.write_pages(spark, read(spark, sf, "pages"))
    return warc.digest(warc.read_captures(spark, [f["uri"] for f in files], with_payload=False))


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(spark, read(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op10_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(spark, read(spark, sf, "documents"))


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(spark, read(spark, sf, "documents"))


def op12_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.duplicates(spark, read(spark, sf, "documents"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    turned = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(spark, read(spark, sf, "embeddings"), vec_id % 50 == 0, turned)


_ALL = [op1_quality, op2_embeddings, op3_substrings, op4_suffix_arrays, op5_toxicity, op6_token_files, op7_decontamination, op8_warc, op9_packing, op10_minhash, op11_spelling_variants, op12_exact_dedup, op13_hard_negatives]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op3_substrings": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
win as (
  select doc_id, i, list_aggregate(words[i : i + 19], 'string_agg', ' ') as win
  from (select doc_id, words, unnest(range(1, len(words) - 18)) as i from w)
),
firsts as (select win, min((doc_id, i)) as f from win group by win),
gone as (select doc_id, i from win join firsts using (win) where (doc_id, i) > f),
edges as (
  select doc_id, p, sum(d) as d from (select doc_id, i as p, 1 as d from gone union all select doc_id, i + 20, -1 from gone) group by all
),
pos as (select doc_id, unnest(range(1, len(words) + 1)) as p, unnest(words) as word from w),
cover as (
  select doc_id, p, word, sum(coalesce(d, 0)) over (partition by doc_id order by p) > 0 as cut from pos left join edges using (doc_id, p)
),
kept as (
  select doc_id, count(*) filter (where cut) as n_removed, coalesce(string_agg(word, ' ' order by p) filter (where not cut), '') as kept from cover group by doc_id
)
select w.doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)""",
    "op8_warc": r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select html, min(page_id) as first from p group by html),
d as (
  select page_id, html, list_aggregate(list_transform(range(40), lambda k: format('{:04b}', strpos('0123456789abcdef', h[k + 1]) - 1)), 'string_agg', '') as bits from p
)
select page_id, strlen(html)::bigint as payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda b: bits[5 * k + b + 1]::int * (16 >> b::int)))::int]), 'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from d join f using (html)""",
    "op11_spelling_variants": r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: case when (a & 1) = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t
),
runs as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents)
),
told as (select low, doc_id || ':' || low as s, count(*) as c from runs where length(low) >= 7 group by all),
hashed as (
  select low, c, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(s)), lambda k: ('0x' || substr(hex(encode(s)), (2 * k + 1)::int, 2))::bigint)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) as h
  from told, crc
),
cut as (select c, case when h % 31 = 0 then substr(low, 1, h % length(low)) || substr(low, h % length(low) + 2) else low end as word from hashed),
v as (select word, sum(c)::bigint as n from cut where length(word) >= 7 group by word having sum(c) >= 2),
dels as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as d from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
pairs as (
  select a.word as a, b.word as b from dels a join dels b on a.i = b.i and a.d = b.d and a.word <> b.word
  union select dels.word, v.word from dels join v on dels.d = v.word
  union select v.word, dels.word from dels join v on dels.d = v.word
),
near as (select a as word, count(*) as n_near, arg_min(b, (-v.n, b)) as best, max(v.n) as best_n from pairs join v on b = v.word group by a),
forms as (
  select word, n, case when best_n >= 10 * n then best end as form, coalesce(n_near, 0) as n_near, case when best_n >= 10 * n then best_n end as form_n from v left join near using (word)
),
steps as (
  select word, coalesce(form, word) as head, form is null as done from forms
  union all select steps.word, coalesce(forms.form, steps.head), forms.form is null from steps join forms on forms.word = steps.head where not done
)
select forms.word, n, form, head as root, n_near, form_n from forms join steps on steps.word = forms.word and done""",
    "op12_exact_dedup": r"""
with t as (select doc_id, coalesce(length(text), 0) as size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select norm, count(*) as group_size, arg_min(doc_id, (-size, doc_id)) as keep_id from t group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from t join g using (norm)""",
    "op13_hard_negatives": r"""
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from r a join r b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 3""",
}

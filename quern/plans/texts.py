"""Text scalars, similarity, quality, chunking and pages as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import rules as W
from ..functions import text as X
from ..operators import chunking as C
from ..operators import prefix_join as J
from ..operators import quality as G
from ..operators import relational as R
from ..sources import readers as S
from ..sources.scratch import scratch_path
from .base import query

_TOK = r"regexp_extract_all(lower(text), '([\p{L}\p{M}\p{N}]+)', 1)"
_NORM = r"trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))"


@query(f"select doc_id, sha256({_NORM}) as norm, len({_TOK}) as n_tokens from documents")
def normalised_text(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "documents").select("doc_id", F.sha2(X.normalise(F.col("text")), 256).alias("norm"), F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"with t as (select item_id, {_TOK} as t from benchmark) select item_id, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) as bigrams from t")
def word_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "benchmark").select("item_id", X.bigrams(X.tokens(F.col("text"))).alias("bigrams"))


_FLAT = r"regexp_replace(lower(text), '\s+', '', 'g')"


_GRAMS = f"g as (select item_id, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) as g from (select item_id, {_FLAT} as t from benchmark))"


@query(
    f"""with {_GRAMS}, c as (select item_id, g, count(*) as n from g group by 1, 2), s as (select item_id, sum(n) as n from c group by 1),
b as (select x.item_id as a, y.item_id as b, sum(least(x.n, y.n)) as shared from c x join c y using (g) where x.item_id < y.item_id group by 1, 2)
select a, b, round(2.0::double * shared / (p.n + q.n), 5) as dice from b join s p on p.item_id = a join s q on q.item_id = b"""
)
def dice_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of questions that share a letter pair: Dice over multisets of letter pairs."""
    g = S.table(spark, sf, "benchmark").select("item_id", F.explode(X.char_bigrams(F.lower("text"))).alias("g"))
    return X.shared_counts(g, "item_id", "g").select("a", "b", F.round(F.lit(2.0) * F.col("shared") / (F.col("na") + F.col("nb")), 5).alias("dice"))


@query(
    f"""with t as (select distinct item_id, unnest({_TOK}) as t from benchmark), s as (select item_id, count(*) as n from t group by 1),
b as (select x.item_id as a, y.item_id as b, count(*) as shared from t x join t y using (t) where x.item_id < y.item_id group by 1, 2)
select a, b, round(shared / (p.n + q.n - shared)::double, 5) as jaccard from b join s p on p.item_id = a join s q on q.item_id = b"""
)
def jaccard_similarity(spark: SparkSession, sf: str) -> DataFrame:
    t = S.table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("t"))
    return X.shared_counts(t, "item_id", "t").select("a", "b", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 5).alias("jaccard"))


@query(
    f"""with t as (select item_id, unnest({W.search_terms_sql("text")}) as t from benchmark), u as (select distinct item_id, unnest({_TOK}) as u from benchmark),
w as (select distinct t as w from t union select u from u), g as (select w, unnest(list_transform(range(1, length(w)), lambda i: substr(w, i, 2))) as g from w),
c as (select w, g, count(*) as n from g group by 1, 2), z as (select w, sum(n) as n from c group by 1),
d as (select x.w as t, y.w as u, sum(least(x.n, y.n)) as shared from c x join c y using (g) group by 1, 2),
f as (select t, u, 2.0::double * shared / (p.n + q.n) as dice from d join z p on p.w = t join z q on q.w = u where 2.0::double * shared / (p.n + q.n) >= 0.72::double),
m as (select t.item_id as a, u.item_id as b, t.t, max(dice) as best from t join f using (t) join u using (u) where t.item_id <> u.item_id group by all)
select a, b, sum(case when best >= 0.92::double then 12 when best >= 0.82::double then 7 else 3 end)::bigint as score from m group by 1, 2"""
)
def fuzzy_token_score(spark: SparkSession, sf: str) -> DataFrame:
    """For each two questions: 12, 7 or 3 points for each search term of the first whose best Dice with a token of the second is
    at least .92, .82 or .72. Distinct tokens are compared once, and only with tokens that share a rare letter pair (prefix filter)."""
    q = S.table(spark, sf, "benchmark")
    t = q.select("item_id", F.explode(W.search_terms(F.col("text"))).alias("t"))
    u = q.select("item_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("u"))
    words = t.select(F.col("t").alias("w")).union(u.select("u")).distinct()
    pairs = J.near_sets(words.select(F.col("w").alias("id"), J.occurrences(X.char_bigrams(F.col("w"))).alias("items")), "dice", 0.72)
    one = pairs.select("a", "b", (F.lit(2.0) * F.col("common") / (F.col("na") + F.col("nb"))).alias("dice"))
    near = one.union(one.select("b", "a", "dice")).union(words.where(F.length("w") > 1).select("w", "w", F.lit(1.0))).toDF("t", "u", "dice")
    met = t.select(F.col("item_id").alias("a"), "t").join(near, "t").join(u.select(F.col("item_id").alias("b"), "u"), "u").where("a != b")
    best = met.groupBy("a", "b", "t").agg(F.max("dice").alias("best"))
    points = F.when(F.col("best") >= 0.92, 12).when(F.col("best") >= 0.82, 7).otherwise(3)
    return best.groupBy("a", "b").agg(F.sum(points).alias("score"))


#: Distinct tokens of a line that is compared with others, and the share of the shorter line's tokens that near lines have in common.
LINE, SHARED = 8, 0.8


@query(
    f"""with l as (select doc_id, unnest(regexp_split_to_array(text, '\\n+')) as line, generate_subscripts(regexp_split_to_array(text, '\\n+'), 1) as k from documents),
t as (select doc_id, k, list_sort(list_distinct({_TOK.replace('text', 'line')})) as items from l), s as (select * from t where len(items) >= {LINE}),
c as (select items, min(format('{{:012d}}:{{:06d}}', doc_id, k)) as id, count(*) as lines from s group by items),
x as (select id, len(items) as n, unnest(items) as item from c),
p as (select a.id as a, b.id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common from x a join x b using (item) where a.n < b.n or (a.n = b.n and a.id < b.id) group by 1, 2 having count(*) >= {SHARED}::double * any_value(a.n))
select a, b, common::int as common, na::int as na, nb::int as nb from p"""
)
def similar_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all texts that share four fifths of the shorter one's tokens. Lines with equal tokens are one class, named by its first line; b is the longer one."""
    d = S.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\n+")).alias("k", "line"))
    t = d.select(F.format_string("%012d:%06d", "doc_id", F.col("k") + 1).alias("id"), F.array_sort(F.array_distinct(X.tokens(F.col("line")))).alias("items"))
    classes = t.where(F.size("items") >= LINE).groupBy(F.array_join("items", " ").alias("line")).agg(F.min("id").alias("id"))  # no token holds a blank
    return J.near_sets(classes.select("id", F.split("line", " ").alias("items")), "overlap", SHARED)


@query(f"select item_id, sha256('all::' || 'law' || '::' || {_NORM}) as key from benchmark")
def question_hash(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "benchmark").select("item_id", X.question_key(F.lit("all"), F.lit("law"), F.col("text")).alias("key"))


@query("select event_id, translate(event_id::varchar, '0123456789', '๐๑๒๓๔๕๖๗๘๙') as thai, event_id::varchar as back from events")
def thai_digits(spark: SparkSession, sf: str) -> DataFrame:
    thai = X.ascii_digits_to_thai(F.col("event_id").cast("string"))
    return S.table(spark, sf, "events").select("event_id", thai.alias("thai"), X.thai_digits_to_ascii(thai).alias("back"))


@query("select event_id, json_extract(props, '$.k')::bigint as k, floor((greatest(10, least(90, json_extract(props, '$.k')::double)) - 10) / 80 * 28 + 0.5)::bigint as scaled from events")
def scaled_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return S.table(spark, sf, "events").select("event_id", k.alias("k"), X.scale_to(k, 10, 90, 28).alias("scaled"))


@query(r"""select doc_id, list_distinct(regexp_extract_all(lower(text), '(?:section|clause|article|item|มาตรา|ข้อ)\s*(\d+(?:/\d+)?)', 1)) as refs from documents where regexp_matches(text, '\d')""")
def reference_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "documents").where(F.rlike("text", F.lit(r"\d")))
    return d.select("doc_id", X.reference_numbers(F.col("text")).alias("refs"))


@query(r"select item_id, case when length(text) <= 60 then text else regexp_replace(substr(text, 1, 60), '\s+\S*\z', '') || '...' end as short from benchmark")
def word_safe_truncation(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "benchmark").select("item_id", X.truncate_words(F.col("text"), 60).alias("short"))


_SHARE = r"case when length(text) > 0 then len(regexp_extract_all(text, '{}')) / length(text)::double else 0 end"


@query(rf"select doc_id from documents where length(trim(text)) < 20 or regexp_matches(trim(text), '^https?://\S+$') or regexp_matches(trim(text), '^[\d\s.,/-]+$') or {_SHARE.format(r'[^\p{L}\p{M}\p{N}\s]')} > 0.5")
def garbage_filter(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "documents").where(G.is_garbage(F.col("text"))).select("doc_id")


_NOTES = rf"""n as (select doc_id, list_filter([case when length(trim(text)) = 0 then 'empty' end, case when length(text) < 80 then 'short' end, case when len({_TOK}) < 12 then 'few_words' end,
  case when {_SHARE.format(r'[^\p{L}\p{M}\p{N}\s]')} > 0.15 then 'signs' end, case when {_SHARE.format(r'\p{N}')} > 0.3 then 'digits' end, case when contains(text, '�') then 'glyphs' end,
  case when len({_TOK}) > 0 and len(list_distinct({_TOK})) / len({_TOK})::double < 0.3 then 'repeats' end, case when {_SHARE.format(r'\p{Lu}')} > 0.4 then 'shouting' end], lambda x: x is not null) as notes from documents),
c as (select doc_id, notes, list_sum(list_transform(notes, lambda x: case x when 'empty' then 100 when 'short' then 20 when 'few_words' then 15 when 'signs' then 25 when 'digits' then 15 when 'glyphs' then 20 when 'repeats' then 20 else 10 end)) as cost from n),
s as (select doc_id, notes, greatest(0, 100 - coalesce(cost, 0))::bigint as score from c)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "documents").select("doc_id", *G.measures(F.col("text"))).select("doc_id", G.notes().alias("notes"))
    return d.withColumn("score", G.score(F.col("notes")).cast("long"))


@query(f"with {_NOTES} select doc_id, notes, score from s")
def extraction_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)


@query(f"with {_NOTES} select case when score >= 60 then 'accepted' when score >= 45 then 'low' else 'rejected' end as band, count(*) as n, round(avg(score), 4) as mean, count(*) filter (where score < 80) as suspicious from s group by 1")
def quality_bands(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    return s.groupBy(G.band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.count_if(F.col("score") < 80).alias("suspicious"))


@query(f"with {_NOTES}, f as (select unnest(notes) as flag, score from s) select flag, count(*) as n, min(score) as low, max(score) as high, round(avg(score), 4) as mean from f group by 1")
def flag_histogram(spark: SparkSession, sf: str) -> DataFrame:
    f = _scored(spark, sf).select(F.explode("notes").alias("flag"), "score")
    return f.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.avg("score"), 4).alias("mean"))


@query("select doc_id, i::int as part, substr(text, i * 1400 + 1, 1400) as chunk from (select doc_id, text, unnest(range(greatest(ceil(length(text) / 1400.0), 1)::int)) as i from documents)")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return C.fixed(S.table(spark, sf, "documents").select("doc_id", "text"), "text", 1400).select("doc_id", "part", "chunk")


@query()
def chunk_structured(spark: SparkSession, sf: str) -> DataFrame:
    """Sections at markers, sentences packed to 350 signs, small neighbours merged; the section's type and an ordinal."""
    d = S.table(spark, sf, "documents").select("doc_id", F.posexplode(C.sections(F.col("text"))).alias("section", "body"))
    packed = C.merge_small(C.pack(C.sentences(F.col("body")), 350), 80, 350)
    return d.select("doc_id", "section", C.section_type(F.col("body")).alias("kind"), F.posexplode(packed).alias("part", "chunk"))


@query(r"select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x)), lambda x: x <> '') as lines from documents where contains(text, chr(10))")
def split_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "documents").where(F.contains("text", F.lit("\n"))).select("doc_id", C.pieces(F.col("text"), r"\n+").alias("lines"))


@query()
def distinct_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy fuzzy distinct over a text's sentences, in order."""
    d = S.table(spark, sf, "benchmark").select("item_id", C.sentences(F.col("text")).alias("s"))
    return d.select("item_id", F.size("s").alias("n"), C.distinct_lines(F.col("s")).alias("kept"))


@query(r"select doc_id, unnest(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?')) as amount from documents")
def amount_highlights(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1)).alias("amount"))


_LINK = '<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>'
_LINKS = f"""l as (select page_id, url, unnest(list_zip(regexp_extract_all(html, '{_LINK}', 1), regexp_extract_all(html, '{_LINK}', 2), range(len(regexp_extract_all(html, '{_LINK}', 1))))) as x from pages),
s as (select page_id, url, x[3]::int as pos, x[1] as link, trim(regexp_replace(x[2], '<[^>]+>', '', 'g')) as title from l)"""


@query(f"with {_LINKS} select page_id, pos, link, title from s")
def page_scrape(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "pages").select("page_id", F.posexplode(S.links(F.col("html"))).alias("pos", "x"))
    return p.select("page_id", "pos", F.col("x.url").alias("link"), F.col("x.title").alias("title"))


@query(
    """with d as (select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') as domain, html from pages)
select page_id, domain, 20 * (case when contains(domain, '.net') then 1 else 0 end) + 8 * (case when contains(lower(html), 'that') then 1 else 0 end) + 5 * (case when contains(lower(html), '<title>') then 1 else 0 end) as score from d"""
)
def web_score(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda c, w: F.when(c, w).otherwise(0)
    dom, low = S.domain(F.col("url")), F.lower("html")
    return S.table(spark, sf, "pages").select("page_id", dom.alias("domain"), (one(F.contains(dom, F.lit(".net")), 20) + one(F.contains(low, F.lit("that")), 8) + one(F.contains(low, F.lit("<title>")), 5)).alias("score"))


@query("select doc_id, nfc_normalize(text) as composed from documents")
def composed_text(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "documents").select("doc_id", A.nfc("text").alias("composed"))


@query("select vec_id, (4 * len(embedding))::bigint as n_bytes, embedding[1] as first, embedding[-1] as last from embeddings")
def vector_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors to little-endian bytes and back."""
    v = S.table(spark, sf, "embeddings").select("vec_id", A.floats_to_bytes("embedding").alias("b"))
    back = v.select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), A.floats_from_bytes("b").alias("v"))
    return back.select("vec_id", "n_bytes", F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"))


_BODY = """rtrim(translate(to_base64(encode('{"v":1,"target":"all","expires_ms":' || (conv_id * 1000 + turn) || ',"at":' || turn || '}')), '+/', '-_'), '=')"""


@query(
    f"""with b as (select conv_id, turn, {_BODY} as body from conversations)
select conv_id, turn, body || '.' || sha256(unhex('{bytes(x ^ 0x5C for x in b"key".ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(x ^ 0x36 for x in b"key".ljust(64, bytes(1))).hex()}') || encode(body)))) as token, conv_id > 10 as valid from b"""
)
def signed_cursors(spark: SparkSession, sf: str) -> DataFrame:
    """Signed cursors of each turn, and which of them are still valid at a time."""
    c = S.table(spark, sf, "conversations")
    state = F.struct(F.lit(1).alias("v"), F.lit("all").alias("target"), (F.col("conv_id") * 1000 + F.col("turn")).alias("expires_ms"), F.col("turn").alias("at"))
    t = c.select("conv_id", "turn", A.sign(state, b"key").alias("token"))
    seen = A.verify(F.col("token"), b"key", "v int, target string, expires_ms long, at long", F.lit("all"), F.lit(10_999))
    return t.select("conv_id", "turn", "token", seen.isNotNull().alias("valid"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def polymorphic_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of JSON documents that are arrays, objects with items, or single objects."""
    items = S.table(spark, sf, "events").select("event_id", F.explode(S.json_items(F.col("props"))).alias("v"))
    return items.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("select doc_id, null::varchar as keyword, text as chunk_text, null::int as quality_score, lang from documents")
def adapted_projection(spark: SparkSession, sf: str) -> DataFrame:
    """The columns that a search wants, null where a table lacks them."""
    wanted = {"doc_id": "bigint", "keyword": "string", "chunk_text": "string", "quality_score": "int", "lang": "string"}
    return R.adapt(S.table(spark, sf, "documents").withColumnRenamed("text", "chunk_text"), wanted)


@query("select user_id, event_type as query, count(*) as n from events where event_type <> 'view' group by all")
def query_log_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON-lines log appended in the shared folder, rid of one query's records and read back tolerantly."""
    path = scratch_path(spark, "query-log")
    S.append_json(S.table(spark, sf, "events").select("user_id", F.col("event_type").alias("query")), path)
    rest = S.without_query(spark.read.text(path), "view")
    kept = S.json_lines_checked(rest, "user_id bigint, query string").where("valid").select("record.*")
    return kept.groupBy("user_id", "query").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, n, n > 200 as is_blocked from (select user_id, count(*) as n from events group by 1)")
def usage_export(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV export with all fields quoted and a derived flag, read back."""
    path = scratch_path(spark, "usage-csv")
    n = S.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    S.write_csv(n.withColumn("is_blocked", F.col("n") > 200), path)
    return spark.read.option("header", True).schema("user_id bigint, n bigint, is_blocked boolean").csv(path)

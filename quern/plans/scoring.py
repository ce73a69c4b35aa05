"""Two-phase retrieval, full scores, relevance gates and rule tables over question and document candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as W
from ..functions import text as X
from ..operators import relational as R
from ..sources.readers import table
from .base import query
from .search import _HITS, _NORM, MOST, questions, token_hits

#: Candidates that the cheap score leaves for the full one; questions that a text meets at one go, at most.
FIRST, ASKED = 300, 1000
# Points of the full score.
PHRASE, TOKEN, BIGRAM, SOURCE, COVER, KEYWORD, NO_KEYWORD = 30, 8, 10, 6, 20, 12, -18

_BIGRAMS = "list_transform(range(1, len(terms)), lambda i: terms[i] || ' ' || terms[i + 1])"
_FIRST = f"""{_HITS},
cheap as (select item_id, doc_id, hits, n_terms, 7 * hits + case when source in ('src0', 'src1') then 5 else 0 end as cheap from hits join nq using (item_id) join documents using (doc_id)),
ranked as (select *, row_number() over (partition by item_id order by cheap desc, doc_id) as k from cheap),
near as (select r.item_id, r.doc_id, r.hits, r.n_terms, d.source, {_NORM.format('d.text')} as body, d.text, q.norm, q.terms, {_BIGRAMS.replace('terms', 'q.terms')} as pairs from ranked r join q using (item_id) join documents d using (doc_id) where k <= {FIRST}),
parts as (select *, contains(body, norm) as phrase, len(list_filter(pairs, lambda p: contains(body, p))) as bigrams from near)"""


def near(spark: SparkSession, sf: str) -> DataFrame:
    """First phase: the cheap score keeps FIRST candidates of each question; only their texts are read for the second."""
    d = table(spark, sf, "documents")
    cheap = token_hits(spark, sf).join(d.select("doc_id", "source"), "doc_id")
    cheap = cheap.withColumn("cheap", 7 * F.col("hits") + F.when(F.col("source").isin("src0", "src1"), 5).otherwise(0))
    kept = R.top(cheap, ["item_id"], [F.desc("cheap"), F.asc("doc_id")], FIRST, "k").drop("k", "cheap", "source")
    q = questions(spark, sf).withColumn("pairs", X.bigrams(F.col("terms")))
    # a text meets its questions once, in blocks of them, and is scored where it is
    wanted = kept.join(R.small(q), "item_id").groupBy("doc_id", F.floor(F.col("item_id") / ASKED)).agg(F.collect_list(F.struct("item_id", "hits", "n_terms", "terms", "norm", "pairs")).alias("asked"))
    body = d.select("doc_id", "source", "text", X.normalise(F.col("text")).alias("body"))
    rows = body.join(wanted.select("doc_id", "asked"), "doc_id").select("doc_id", "source", "text", "body", F.inline("asked"))
    return rows.withColumns({"phrase": F.contains("body", "norm"), "bigrams": F.size(F.filter("pairs", lambda p: F.contains(F.col("body"), p)))})


@query(
    f"""with {_FIRST}, s as (select item_id, doc_id, {TOKEN} * hits + {BIGRAM} * bigrams + {COVER} * hits / n_terms::double + case when phrase then {PHRASE} else 0 end
  + case when contains(body, terms[1]) then {KEYWORD} else {NO_KEYWORD} end + case when source = 'src0' then {SOURCE} else 0 end
  - least(20, 2 * len(regexp_extract_all(text, '�'))) - case when length(text) < 80 then 10 else 0 end as score from parts),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id desc) as rank from s where score > 0)
select item_id, doc_id, round(score, 4) as score, rank from r where rank <= 10"""
)
def two_phase_topk(spark: SparkSession, sf: str) -> DataFrame:
    cover = COVER * F.col("hits") / F.col("n_terms")
    rules = W.points(
        (F.col("phrase"), PHRASE), (F.contains("body", F.get("terms", F.lit(0))), KEYWORD), (~F.contains("body", F.get("terms", F.lit(0))), NO_KEYWORD), (F.col("source") == "src0", SOURCE), (F.length("text") < 80, -10)
    )
    score = TOKEN * F.col("hits") + BIGRAM * F.col("bigrams") + cover + rules - F.least(F.lit(20), 2 * F.regexp_count("text", F.lit("�")))
    s = near(spark, sf).select("item_id", "doc_id", score.alias("score")).where("score > 0")
    return R.top(s, ["item_id"], [F.desc("score"), F.desc("doc_id")], 10).select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(
    f"""with {_FIRST}, s as (select item_id, doc_id, 35 * phrase::int + 8 * hits + 12 * bigrams + 25 * hits / n_terms::double + case when hits = n_terms then 18 else 0 end + case when contains(terms[1], substr(source, 1, 3)) then 20 else 0 end as score from parts),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s)
select item_id, doc_id, round(score, 4) as score, rank from r where rank <= 10"""
)
def structured_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The score of structured rows: phrase, tokens, bigrams, label, all terms, coverage."""
    score = 35 * F.col("phrase").cast("int") + 8 * F.col("hits") + 12 * F.col("bigrams") + 25 * F.col("hits") / F.col("n_terms")
    score = score + W.points((F.col("hits") == F.col("n_terms"), 18), (F.contains(F.get("terms", F.lit(0)), F.substring("source", 1, 3)), 20))
    return R.top(near(spark, sf).withColumn("score", score), ["item_id"], [F.desc("score"), F.asc("doc_id")], 10).select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(
    f"""with {_FIRST}, s as (select item_id, doc_id, case when phrase then 1000 + length(norm) else 100 * hits / n_terms::double + length(norm) end as score from parts),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) select item_id, doc_id, round(score, 4) as score from r where rank = 1"""
)
def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    """The best text for each phrase: whole phrase 1000 and its length, else share of its words and its length; the first wins ties."""
    score = F.when(F.col("phrase"), 1000 + F.length("norm")).otherwise(100 * F.col("hits") / F.col("n_terms") + F.length("norm"))
    return R.top(near(spark, sf).withColumn("score", score), ["item_id"], [F.desc("score"), F.asc("doc_id")], 1).select("item_id", "doc_id", F.round("score", 4).alias("score"))


# Thai words that ask for a count or kind. English ones are own.
THAI_COUNTS = "กี่|จำนวน|ประเภท|ชนิด|แบบ|ลักษณะ|เท่าไร|เท่าไหร่"
_COUNTS = THAI_COUNTS + "|how many|how much"


@query(
    f"""with {_HITS}, c as (select item_id, doc_id, hits, n_terms, norm, terms, regexp_matches(norm, '{_COUNTS}') as counts from hits join nq using (item_id) join q using (item_id) where hits >= least(2, n_terms) or regexp_matches(norm, '{_COUNTS}')),
g as (select c.*, contains({_NORM.format('d.text')}, norm) or len(list_filter({_BIGRAMS}, lambda p: contains({_NORM.format('d.text')}, p))) > 0 as exact from c join documents d using (doc_id)),
r as (select *, row_number() over (partition by item_id order by hits desc, doc_id) as k from g where n_terms = 1 or exact or counts or hits = n_terms)
select item_id, doc_id, exact, hits from r where k <= {MOST}"""
)
def relevance_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with all terms of a question, or with a pair of neighbouring ones (or the whole), or any term where it asks for a count.
    A pair needs two hits, so texts with fewer aren't looked at."""
    q = questions(spark, sf).withColumns({"pairs": X.bigrams(F.col("terms")), "counts": F.rlike("norm", F.lit(_COUNTS))})
    c = token_hits(spark, sf).join(R.small(q), "item_id").where("hits >= least(2, n_terms) or counts")
    d = table(spark, sf, "documents").select("doc_id", X.normalise(F.col("text")).alias("body"))
    g = c.join(d, "doc_id").withColumn("exact", F.contains("body", "norm") | F.exists("pairs", lambda p: F.contains(F.col("body"), p)))
    g = g.where("n_terms = 1 or exact or counts or hits = n_terms")
    return R.top(g, ["item_id"], [F.desc("hits"), F.asc("doc_id")], MOST, "k").select("item_id", "doc_id", "exact", "hits")


@query(
    f"""with {_HITS}, s as (select item_id, doc_id, 8 * hits as score from hits), t as (select *, max(score) over (partition by item_id) as best from s),
g as (select t.*, len(regexp_extract_all(d.text, '[◊Ë‡∫≈¡¥�]')) as glyphs from t join documents d using (doc_id) where score >= greatest(0.7::double * best, 40)),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as k from g where glyphs <= 2) select item_id, doc_id, score from r where k <= 4"""
)
def relative_quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Sources within 0.7 of the best score (and above a floor), without garbled signs; at most four."""
    s = token_hits(spark, sf).select("item_id", "doc_id", (8 * F.col("hits")).alias("score"))
    best = s.groupBy("item_id").agg(F.max("score").alias("best"))
    g = s.join(R.small(best), "item_id").where(F.col("score") >= F.greatest(F.lit(0.7) * F.col("best"), F.lit(40)))
    clean = table(spark, sf, "documents").where(F.regexp_count("text", F.lit("[◊Ë‡∫≈¡¥�]")) <= 2).select("doc_id")
    return R.top(g.join(clean, "doc_id"), ["item_id"], [F.desc("score"), F.asc("doc_id")], 4, "k").select("item_id", "doc_id", "score")


_REFS = r"list_distinct(regexp_extract_all(lower({}), '(?:section|clause|article|item|มาตรา|ข้อ)\s*(\d+(?:/\d+)?)', 1))"


@query(
    f"""with {_HITS}, top as (select *, row_number() over (partition by item_id order by hits desc, doc_id) as k from hits),
x as (select item_id, doc_id, {_REFS.format('b.text')} as wanted, regexp_extract(d.text, '(\\d+)', 1) as main, d.text from top join benchmark b using (item_id) join documents d using (doc_id) where k <= {MOST})
select item_id, doc_id, case when len(wanted) > 0 then case when main <> '' and list_contains(wanted, main) then 42 when len(list_filter(wanted, lambda w: contains(text, w))) > 0 then 28 when main <> '' then -20 else 0 end when main <> '' then 4 else 0 end as points from x"""
)
def section_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Points for numbers that a question asks for: a text's first number 42, any mention 28, another number -20; 4 if none is asked for."""
    top = R.top(token_hits(spark, sf), ["item_id"], [F.desc("hits"), F.asc("doc_id")], MOST, "k")
    q = table(spark, sf, "benchmark").select("item_id", X.reference_numbers(F.col("text")).alias("wanted"))
    d = table(spark, sf, "documents").select("doc_id", "text", F.regexp_extract("text", r"(\d+)", 1).alias("main"))
    x = top.join(R.small(q), "item_id").join(d, "doc_id")
    has = F.col("main") != ""
    asked = F.when(has & F.array_contains("wanted", F.col("main")), 42).when(F.exists("wanted", lambda w: F.contains(F.col("text"), w)), 28).when(has, -20).otherwise(0)
    return x.select("item_id", "doc_id", F.when(F.size("wanted") > 0, asked).otherwise(F.when(has, 4).otherwise(0)).alias("points"))


@query("select doc_id, contains(lower(text), 'that the') and not contains(lower(text), 'the that') as asks_a, contains(lower(text), 'of the') and not contains(lower(text), 'that the') as about_b from documents where contains(lower(text), 'the')")
def opposing_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Two opposed topics: which of them a text is about, by a phrase that the other excludes."""
    t = F.lower("text")
    has = lambda w: F.contains(t, F.lit(w))
    return table(spark, sf, "documents").where(has("the")).select("doc_id", (has("that the") & ~has("the that")).alias("asks_a"), (has("of the") & ~has("that the")).alias("about_b"))


@query(f"select item_id, {W.search_terms_sql('text')}[1:8] as keywords from benchmark")
def draft_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight distinct tokens that aren't generic."""
    return table(spark, sf, "benchmark").select("item_id", F.slice(W.search_terms(F.col("text")), 1, 8).alias("keywords"))


_KEYS = r"list_filter(list_transform(regexp_split_to_array(source || ', ' || lang || '|' || upper(lang) || '/Docs', '[,\n|/]+'), lambda x: trim(regexp_replace(lower(x), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))), lambda x: x <> '')"


@query(f"with k as (select doc_id, {_KEYS} as k from documents) select doc_id, list_filter(k, lambda x, i: list_position(k, x) = i) as keywords from k")
def keyword_column_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A delimited keyword column as its distinct normalised terms, in order."""
    raw = F.concat("source", F.lit(", "), "lang", F.lit("|"), F.upper("lang"), F.lit("/Docs"))
    terms = F.transform(F.split(raw, r"[,\n|/]+"), lambda x: X.normalise(x))
    return table(spark, sf, "documents").select("doc_id", F.array_distinct(F.filter(terms, lambda x: x != "")).alias("keywords"))


@query("select p_partkey, case when lower(p_name) = 'red widget' then 0 when contains(lower(p_name), 'widget') then 1 else 2 end as place from part where contains(lower(p_name), 'red') or contains(lower(p_name), 'widget') order by place, p_partkey limit 200")
def exact_phrase_first(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose keyword column holds a term, the exact phrase before the rest."""
    n = F.lower("p_name")
    place = F.when(n == "red widget", 0).when(F.contains(n, F.lit("widget")), 1).otherwise(2)
    return table(spark, sf, "part").where(X.any_contains(n, ["red", "widget"])).select("p_partkey", place.alias("place")).orderBy("place", "p_partkey").limit(200)


@query("select p_partkey, p_brand from part where (trim(p_brand) in ('Brand#2', 'Brand#17') or replace(trim(p_name), ' ', '') in ('smallring', 'redwidget')) and not starts_with(p_type, 'TEST')")
def exact_section_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A trimmed value in a list, or one without blanks in a list; fixture rows are left out."""
    p = table(spark, sf, "part")
    return p.where((F.trim("p_brand").isin("Brand#2", "Brand#17") | F.replace(F.trim("p_name"), F.lit(" "), F.lit("")).isin("smallring", "redwidget")) & ~F.startswith("p_type", F.lit("TEST"))).select("p_partkey", "p_brand")


@query("select * from (select 'customer' as kind, c_custkey as id, c_name as label from customer union all select 'part', p_partkey, p_name from part union all select 'supplier', s_suppkey, s_name from supplier) where kind = 'part' and id = 7 or kind = 'customer' and id = 12 or kind = 'supplier' and id = 3")
def lookup_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as one long table with their name; a lookup is a filter on name and id that reaches each scan."""
    one = lambda t, k, n: table(spark, sf, t).select(F.lit(t).alias("kind"), F.col(k).alias("id"), F.col(n).alias("label"))
    rows = one("customer", "c_custkey", "c_name").unionByName(one("part", "p_partkey", "p_name")).unionByName(one("supplier", "s_suppkey", "s_name"))
    return rows.where("kind = 'part' and id = 7 or kind = 'customer' and id = 12 or kind = 'supplier' and id = 3")


@query(
    """with s as (select c_custkey, 8 * contains(lower(c_name), '12')::int + 6 * contains(lower(c_mktsegment), 'auto')::int + 4 * contains(c_acctbal::bigint::varchar, '12')::int as score, case when lower(c_mktsegment) = 'automobile' then 0 when lower(c_mktsegment) = 'building' then 1 else 2 end as target from customer where lower(c_mktsegment) in ('automobile', 'building', 'household'))
select c_custkey, target, score from s where score > 0 order by target, score desc, c_custkey limit 60"""
)
def knowledge_search(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a target or of the general ones, scored over their columns; the target's own rows first."""
    seg = F.lower("c_mktsegment")
    target = F.when(seg == "automobile", 0).when(seg == "building", 1).otherwise(2)
    score = W.points((F.contains(F.lower("c_name"), F.lit("12")), 8), (F.contains(seg, F.lit("auto")), 6), (F.contains(F.round("c_acctbal").cast("bigint").cast("string"), F.lit("12")), 4))
    s = table(spark, sf, "customer").where(seg.isin("automobile", "building", "household")).select("c_custkey", target.alias("target"), score.alias("score"))
    return s.where("score > 0").orderBy("target", F.desc("score"), "c_custkey").limit(60)


@query(
    f"""with {_HITS}, e as (select q.item_id, d.doc_id, 998 as score from q join documents d on d.doc_id in (1, 2, 3) and contains(q.norm, 'that')),
u as (select item_id, doc_id, 8 * hits as score from hits union all select * from e), g as (select item_id, doc_id, max(score) as score from u group by 1, 2), r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from g)
select item_id, doc_id, score from r where place <= 10"""
)
def forced_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a rule forces for a topic come before what the search found; each row once."""
    q = table(spark, sf, "benchmark").where(F.contains(X.normalise(F.col("text")), F.lit("that"))).select("item_id")
    rules = F.broadcast(spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"))
    forced = q.crossJoin(rules.join(table(spark, sf, "documents").select("doc_id"), "doc_id")).select("item_id", "doc_id", F.lit(998).cast("long").alias("score"))
    g = token_hits(spark, sf).select("item_id", "doc_id", (8 * F.col("hits")).alias("score")).unionByName(forced).groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    return R.top(g, ["item_id"], [F.desc("score"), F.asc("doc_id")], 10, "place").select("item_id", "doc_id", "score")


@query(
    """select o_orderkey, case when age <= 30 then 10 when age <= 180 then 6 when age <= 365 then 2 when age <= 1095 then 0 else -4 end as points
from (select o_orderkey, date_diff('day', o_orderdate::date, date '1998-12-01') as age from orders)"""
)
def freshness_band(spark: SparkSession, sf: str) -> DataFrame:
    """Points by age in days at a stated date."""
    age = F.datediff(F.lit("1998-12-01").cast("date"), F.to_date("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", F.when(age <= 30, 10).when(age <= 180, 6).when(age <= 365, 2).when(age <= 1095, 0).otherwise(-4).alias("points"))


@query(
    f"""with {_HITS}, o as (select item_id, doc_id, hits, source, n_chars, nullif(trim(text), '') as body, row_number() over (partition by item_id order by hits desc, doc_id) as k from hits join documents using (doc_id))
select item_id, arg_min(doc_id, k) filter (where body is not null) as doc_id, arg_min(coalesce(nullif(source, ''), 'none'), k) filter (where body is not null) as label from o where k <= {MOST} group by 1"""
)
def best_answer(spark: SparkSession, sf: str) -> DataFrame:
    """The first of the ranked rows with any text, and its label or a stand-in."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(F.nullif("source", F.lit("")), F.lit("none")).alias("label"), (F.trim("text") != "").alias("some"))
    top = R.top(token_hits(spark, sf).join(d, "doc_id"), ["item_id"], [F.desc("hits"), F.asc("doc_id")], MOST, "k").withColumn("k", F.when(F.col("some"), F.col("k")))
    return top.groupBy("item_id").agg(F.min_by("doc_id", "k").alias("doc_id"), F.min_by("label", "k").alias("label"))


@query(
    f"""with {_HITS}, k as (select item_id, doc_id, hits, source, row_number() over (partition by item_id order by hits desc, doc_id) as k from hits join documents using (doc_id)),
p as (select *, case source when 'src0' then 3 when 'src1' then 2 when 'src2' then 2 else 1 end as quota from k where k <= 120),
s as (select *, row_number() over (partition by item_id, source order by k) as own from p),
t as (select *, row_number() over (partition by item_id order by case when own <= quota then 0 else 1 end, k) as place from s)
select item_id, doc_id, own <= quota as within_quota, place from t where place <= 12"""
)
def quota_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's quota first, then what is left in order until the total is full."""
    c = R.top(token_hits(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id"), ["item_id"], [F.desc("hits"), F.asc("doc_id")], 120, "k")
    quota = F.when(F.col("source") == "src0", 3).when(F.col("source").isin("src1", "src2"), 2).otherwise(1)
    own = F.row_number().over(Window.partitionBy("item_id", "source").orderBy("k"))
    t = c.withColumn("within_quota", own <= quota)
    return R.top(t, ["item_id"], [F.desc("within_quota"), F.asc("k")], 12, "place").select("item_id", "doc_id", "within_quota", "place")

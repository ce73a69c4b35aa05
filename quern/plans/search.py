"""Batches of questions (benchmark) against a corpus (documents): filters, scores and top-k.

Candidates come from an equi-join on tokens (an inverted index), never from all question-document pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as W
from ..functions import text as X
from ..operators.relational import contains_cnf, small, top
from ..operators.similarity import nearest
from ..sources.readers import table
from .base import query

#: Additive weights of a hit, of covering the question, of holding it word for word; candidates of a question kept at most.
TOKEN, COVER, PHRASE, MOST = 8, 20, 30, 30

_TOK = r"regexp_extract_all(lower({}), '([\p{{L}}\p{{M}}\p{{N}}]+)', 1)"
DT, QT = _TOK.format("text"), _TOK.format("text")
_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
_HITS = rf"""
q as (select item_id, {W.search_terms_sql("text")} as terms, {_NORM.format("text")} as norm from benchmark),
qt as (select item_id, unnest(terms) as term from q),
nq as (select item_id, count(*) as n_terms from qt group by item_id),
dt as (select distinct doc_id, unnest({DT}) as term from documents),
hits as (select item_id, doc_id, count(*) as hits from qt join dt using (term) group by item_id, doc_id)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", W.search_terms(F.col("text")).alias("terms"), X.normalise(F.col("text")).alias("norm"))


def token_hits(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, doc_id, hits, n_terms for pairs that share a search term."""
    qt = questions(spark, sf).select("item_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    dt = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    # tokens that no question has go before anything is counted; counts combine before the shuffle
    return dt.join(small(qt), "term").groupBy("item_id", "doc_id", "n_terms").agg(F.count(F.lit(1)).alias("hits"))


@query(
    f"""with {_HITS},
s as (select item_id, doc_id, hits, {TOKEN} * hits + {COVER} * hits / n_terms::double as score from hits join nq using (item_id)),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s)
select item_id, doc_id, hits, round(score, 4) as score, rank from r where rank <= 10"""
)
def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    s = token_hits(spark, sf).withColumn("score", TOKEN * F.col("hits") + COVER * F.col("hits") / F.col("n_terms"))
    return top(s, ["item_id"], [F.desc("score"), F.asc("doc_id")], 10).select("item_id", "doc_id", "hits", F.round("score", 4).alias("score"), "rank")


@query(
    f"""with {_HITS},
s as (select h.item_id, h.doc_id, {TOKEN} * hits + {COVER} * hits / n_terms::double
    + case when contains({_NORM.format("d.text")}, q.norm) then {PHRASE} else 0 end as score
  from hits h join nq using (item_id) join q using (item_id) join documents d using (doc_id) where hits >= least(3, n_terms)),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id desc) as rank from s)
select item_id, doc_id, round(score, 4) as score, rank from r where rank <= 5"""
)
def phrase_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Token hits gate the phrase test: a text with the whole question has all its terms, so none is missed."""
    h = token_hits(spark, sf).where("hits >= least(3, n_terms)").join(small(questions(spark, sf).select("item_id", "norm")), "item_id")
    d = table(spark, sf, "documents").select("doc_id", X.normalise(F.col("text")).alias("doc"))
    s = h.join(d, "doc_id").withColumn("score", TOKEN * F.col("hits") + COVER * F.col("hits") / F.col("n_terms") + F.when(F.contains("doc", "norm"), PHRASE).otherwise(0))
    return top(s, ["item_id"], [F.desc("score"), F.desc("doc_id")], 5).select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query("select doc_id, lang from documents where contains(lower(text), 'idiot') or contains(lower(text), 'moron') or contains(lower(source), 'src7')")
def contains_any(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.where(X.any_contains(F.lower("text"), ["idiot", "moron"]) | F.contains(F.lower("source"), F.lit("src7"))).select("doc_id", "lang")


@query("select doc_id, source from documents where (contains(lower(text), 'the ') or contains(lower(text), 'der ')) and (contains(lower(text), 'that') or contains(lower(text), 'nicht')) and contains(lower(text), 'an')")
def contains_cnf_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.where(contains_cnf(F.lower("text"), [["the ", "der "], ["that", "nicht"], ["an"]])).select("doc_id", "source")


@query(f"select doc_id from documents where len(list_filter({DT}, lambda t: starts_with(t, 'thi') or starts_with(t, 'ung'))) > 0")
def prefix_or(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.where(F.exists("t", lambda t: F.startswith(t, F.lit("thi")) | F.startswith(t, F.lit("ung")))).select("doc_id")


@query(f"select doc_id from (select doc_id, {DT} as t from documents) where len(list_filter(t, lambda x: starts_with(x, 'thi'))) > 0 and len(list_filter(t, lambda x: starts_with(x, 'ed'))) > 0")
def prefix_and(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    has = lambda p: F.exists("t", lambda t: F.startswith(t, F.lit(p)))
    return d.where(has("thi") & has("ed")).select("doc_id")


@query(
    """with s as (select doc_id, 12 * (case when contains(lower(source), 'src1') then 1 else 0 end) + 7 * (case when contains(lower(text), 'that') then 1 else 0 end)
  + 11 * (case when lang = 'en' then 1 else 0 end) + 9 * (case when contains(lower(text), 'that the') then 1 else 0 end) as score from documents)
select doc_id, score from s where score > 0 order by score desc, doc_id desc limit 300"""
)
def weighted_case_score(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda c, w: F.when(c, w).otherwise(0)
    t = F.lower("text")
    score = one(F.contains(F.lower("source"), F.lit("src1")), 12) + one(F.contains(t, F.lit("that")), 7) + one(F.col("lang") == "en", 11) + one(F.contains(t, F.lit("that the")), 9)
    return table(spark, sf, "documents").select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("doc_id")).limit(300)


@query(
    f"""with {_HITS},
c as (select item_id, doc_id, 9 * hits as tokens, case when source in ('src0', 'src1') then 18 else 0 end as kind,
    least(20, 4 * hits) as cover, case when n_chars > 2000 then -6 else 0 end as length
  from hits join documents using (doc_id)),
s as (select *, tokens + kind + cover + length as score from c), r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s)
select item_id, doc_id, tokens, kind, cover, length, score, rank from r where rank <= {MOST}"""
)
def hybrid_component_score(spark: SparkSession, sf: str) -> DataFrame:
    """Named components that add up to the score; the best candidates of each question."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    c = token_hits(spark, sf).join(d, "doc_id").select(
        "item_id", "doc_id", (9 * F.col("hits")).alias("tokens"), F.when(F.col("source").isin("src0", "src1"), 18).otherwise(0).alias("kind"),
        F.least(F.lit(20), 4 * F.col("hits")).alias("cover"), F.when(F.col("n_chars") > 2000, -6).otherwise(0).alias("length"),
    )
    s = c.withColumn("score", F.col("tokens") + F.col("kind") + F.col("cover") + F.col("length"))
    return top(s, ["item_id"], [F.desc("score"), F.asc("doc_id")], MOST)


@query(
    """with v as (select vec_id, embedding::double[] as e, label from embeddings), q as (select * from v where vec_id % 100 = 0),
s as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.e, v.e) as sim from q join v on v.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from s)
select query_id, vec_id, round(sim, 5) as sim, floor(sim * 200 + 0.5)::bigint as score, rank from r where rank <= 5"""
)
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A stated query set (ids divisible by 100) against all rows, by products of blocks."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    s = nearest(v.where("vec_id % 100 = 0"), v, 5)
    return s.select("query_id", F.col("id").alias("vec_id"), F.round("sim", 5).alias("sim"), X.half_up(F.col("sim") * 200).alias("score"), "rank")


@query(
    f"""with {_HITS},
kr as (select item_id, doc_id as id, {TOKEN} * hits as kw, row_number() over (partition by item_id order by hits desc, doc_id) as k from hits),
v as (select vec_id, embedding::double[] as e from embeddings), p as (select item_id, e from benchmark join v on vec_id = item_id),
sr as (select item_id, vec_id as id, list_cosine_similarity(p.e, v.e) as sim from p join v on vec_id <> item_id),
sk as (select item_id, id, floor(200 * sim + 0.5)::bigint as sem, row_number() over (partition by item_id order by sim desc, id) as k from sr),
f as (select item_id, id, kr.kw, sk.sem from (select * from kr where k <= {MOST}) kr full outer join (select * from sk where k <= {MOST}) sk using (item_id, id))
select item_id, id, kw, sem, case when kw is null then sem when sem is null then kw else kw + floor(0.3::double * sem + 0.5) end::double as score from f"""
)
def full_outer_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """For each question the best keyword and vector hits merged (its vector is the one of its own id); both: keyword score and 0.3 of the vector's."""
    kw = top(token_hits(spark, sf), ["item_id"], [F.desc("hits"), F.asc("doc_id")], MOST).select("item_id", F.col("doc_id").alias("id"), (TOKEN * F.col("hits")).alias("kw"))
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    p = v.join(small(table(spark, sf, "benchmark").select("item_id")), F.col("vec_id") == F.col("item_id")).select("item_id", "embedding")
    sem = nearest(p, v, MOST).select(F.col("query_id").alias("item_id"), "id", X.half_up(200 * F.col("sim")).alias("sem"))
    both = F.col("kw") + X.half_up(F.lit(0.3) * F.col("sem"))
    return kw.join(sem, ["item_id", "id"], "full_outer").select("item_id", "id", "kw", "sem", F.when(F.col("kw").isNull(), F.col("sem")).when(F.col("sem").isNull(), F.col("kw")).otherwise(both).cast("double").alias("score"))


@query(
    f"""with {_HITS},
m as (select item_id, doc_id, hits, max(hits) over (partition by item_id) as best from hits),
r as (select *, row_number() over (partition by item_id order by hits desc, doc_id) as rank from m where best < 8 or hits >= 8)
select item_id, doc_id, hits from r where rank <= {MOST}"""
)
def semantic_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A stage that runs only for weak questions: a gate column instead of a data-dependent branch."""
    hits = token_hits(spark, sf)
    best = hits.groupBy("item_id").agg(F.max("hits").alias("best"))
    m = hits.join(small(best), "item_id").where("best < 8 or hits >= 8")
    return top(m, ["item_id"], [F.desc("hits"), F.asc("doc_id")], MOST).select("item_id", "doc_id", "hits")


@query(
    rf"""with t as (select item_id, {DT} as t from benchmark),
x as (select distinct item_id, unnest(t) as term from t), n as (select item_id, count(*) as n from x group by 1),
p as (select a.item_id as a, b.item_id as b, count(*) as shared from x a join x b using (term) where a.item_id < b.item_id group by 1, 2),
s as (select p.*, x.n as nx, y.n as ny from p join n x on x.item_id = a join n y on y.item_id = b)
select a, b, round(shared / (nx + ny - shared)::double, 5) as jaccard, round(shared / nx::double, 5) as cover,
  round(0.55::double * shared / (nx + ny - shared) + 0.35::double * shared / nx, 4) as similarity from s"""
)
def qa_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that share a token: weighted Jaccard and coverage of their token sets, counted by an equi-join on tokens."""
    x = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    s = X.shared_counts(x, "item_id", "term")
    j, c = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), F.col("shared") / F.col("na")
    return s.select("a", "b", F.round(j, 5).alias("jaccard"), F.round(c, 5).alias("cover"), F.round(0.55 * j + 0.35 * c, 4).alias("similarity"))

"""Rerank of candidates over all kinds of sources, and the row score of passages: every term named, and their sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as W
from ..functions import text as X
from ..operators import relational as R
from ..sources.readers import table
from .base import ORACLE_SQL, query
from .passages import knowledge_chunks
from .routing import _NORM as _ASKED_NORM
from .routing import _intent_sql, _values, intent, norm
from .scoring import _REFS
from .search import _NORM, MOST, questions, token_hits
from .topics import _BOOSTED, boosted

# What each kind of source weighs, and what it gains or loses by the question's intent.
AUTHORITY = {"knowledge": 12, "suggestion": 11, "ruling": 10, "law": 9, "group_law": 8, "document": 5, "chunk": 4, "base": 1}
BY_INTENT = {
    "law_section": {"law": 8, "group_law": 8, "ruling": 2, "document": -1, "chunk": -1}, "qa": {"knowledge": 9, "suggestion": 7, "ruling": 4},
    "document": {"document": 7, "chunk": 7, "law": 1, "group_law": 1}, "explain": {"law": 5, "group_law": 5, "knowledge": 4, "document": 3, "chunk": 3},
}
# Points of the further terms.
CARRY, OFF_TOPIC, LEAST_FOCUS, LEGAL_SOURCE, LEGAL_TEXT, OVERVIEW, OVERVIEW_TITLE, CLOSING_TITLE, GENERAL_TITLE = 6, -18, 18, -120, -70, 18, 14, -36, 12
#: The tables' sources by kind, in turn, with the priority of each; an order's date stands for that of the text with its number.
KINDS = list(AUTHORITY)
PRIORITY = {"knowledge": 10, "suggestion": 9, "ruling": 8, "law": 7, "group_law": 6, "document": 4, "chunk": 3, "base": 1}
AS_OF = "2001-09-01"
#: Own patterns for the tables' texts: questions for an overview, legal wording, texts that give one, titles about an end, general titles.
ASKS_OVERVIEW, ASKS_LEGAL, LEGALISH, FRIENDLY, CLOSING, GENERAL = r"\bthe\b|\bdie\b", r"section|\bof\b", r"section|\bthat the\b|\bder\b", r"\bof the\b|\bund\b|\bde la\b", r"\bin\b", r"\bthe\b"

_KIND = "case (regexp_extract(source, '([0-9]+)', 1)::int) % 8 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
_POINTS = lambda of, c: f"case {c} " + " ".join(f"when '{k}' then {n}" for k, n in of.items()) + " else 0 end"
_ADJUSTED = [(i, k, n) for i, own in BY_INTENT.items() for k, n in own.items()]
_TERMS = ["base", "retrieval", "authority", "section", "focus", "freshness", "helpful", "context", "off_topic", "legal", "overview", "overview_title", "closing_title", "general_title"]


@query(
    rf"""with {_BOOSTED}, r as (select *, row_number() over (partition by item_id order by hits desc, doc_id) as k from c),
aq as (select item_id, {_ASKED_NORM.format('text')} as t, {_REFS.format('text')} as wanted from benchmark), ai2 as (select *, {_intent_sql('t')} as intent from aq),
st as (select *, intent in ('general', 'short_answer') and regexp_matches(t, '{ASKS_OVERVIEW}') and not regexp_matches(t, '{ASKS_LEGAL}') as strict from ai2),
x as (select r.item_id, r.doc_id, r.hits, r.focus as raw, r.k, st.t, st.wanted, st.intent, st.strict, d.text, d.source, {_KIND} as kind, {_NORM.format('d.text')} as plain, {_NORM.format('substr(d.text, 1, 60)')} as title,
    regexp_extract(d.text, '(\d+)', 1) as main, date_diff('day', o_orderdate, date '{AS_OF}') as age from r join st using (item_id) join documents d using (doc_id) left join orders on o_orderkey = doc_id),
votes as (select hits.item_id, source, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as bad from hits join nq using (item_id) join labels using (doc_id) join documents using (doc_id) where hits.hits >= 0.3::double * n_terms group by all),
t as (select x.item_id, x.doc_id, 8 * hits as base, floor(1.2::double * {_POINTS(PRIORITY, 'kind')} + 0.5)::bigint as retrieval, {_POINTS(AUTHORITY, 'kind')} + coalesce(adj.points, 0) as authority,
    case when len(wanted) > 0 then case when main <> '' and list_contains(wanted, main) then 42 when len(list_filter(wanted, lambda w: contains(text, w))) > 0 then 28 when main <> '' then -20 else 0 end when main <> '' then 4 else 0 end as section,
    greatest(-40, least(40, raw)) as focus, case when age is null then 0 when age <= 30 then 10 when age <= 180 then 6 when age <= 365 then 2 when age <= 1095 then 0 else -4 end as freshness,
    least(6, greatest(0, 2 * (coalesce(good, 0) - coalesce(bad, 0)))) as helpful, case when b.doc_id is not null then {CARRY} else 0 end as context,
    case when kind in ('document', 'chunk', 'base') and raw < {LEAST_FOCUS} then {OFF_TOPIC} else 0 end as off_topic,
    case when strict and kind in ('law', 'group_law', 'ruling') then {LEGAL_SOURCE} when strict and regexp_matches(plain, '{LEGALISH}') and not (kind in ('document', 'chunk') and regexp_matches(plain, '{FRIENDLY}')) then {LEGAL_TEXT} else 0 end as legal,
    case when strict and regexp_matches(plain, '{FRIENDLY}') then {OVERVIEW} else 0 end as overview, case when strict and regexp_matches(title, '{FRIENDLY}') then {OVERVIEW_TITLE} else 0 end as overview_title,
    case when strict and regexp_matches(title, '{CLOSING}') then {CLOSING_TITLE} else 0 end as closing_title, case when strict and regexp_matches(t, '{GENERAL}') and regexp_matches(title, '{GENERAL}') then {GENERAL_TITLE} else 0 end as general_title
  from x left join votes using (item_id, source) left join {_values(_ADJUSTED, 'adj(by_intent, of_kind, points)')} on by_intent = x.intent and of_kind = x.kind left join (select item_id, doc_id from r where k <= 3) b on b.item_id = x.item_id - 1 and b.doc_id = x.doc_id),
s as (select *, {' + '.join(_TERMS)} as score from t), p as (select *, row_number() over (partition by item_id order by score desc, base desc, doc_id) as place from s)
select item_id, doc_id, {', '.join(f'{c}::bigint as {c}' for c in _TERMS)}, score::bigint as score, place from p where place <= 10"""
)
def cross_source_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each question by fourteen named terms: hits, retrieval priority, authority by kind and intent, the section asked for, topic focus, age, helpful
    votes, carry-over from the question before, and what an overview question gains or loses by its text and title."""
    own = boosted(spark, sf).select("item_id", "doc_id", "hits", F.col("focus").alias("raw"))
    own = R.top(own, ["item_id"], [F.desc("hits"), F.asc("doc_id")], MOST, "k")
    q = table(spark, sf, "benchmark").select("item_id", norm(F.col("text")).alias("t"), X.reference_numbers(F.col("text")).alias("wanted"))
    q = q.withColumn("intent", intent(F.col("t")))
    strict = F.col("intent").isin("general", "short_answer") & F.rlike("t", F.lit(ASKS_OVERVIEW)) & ~F.rlike("t", F.lit(ASKS_LEGAL))
    q = q.withColumn("strict", strict)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.regexp_extract("source", r"([0-9]+)", 1).cast("int") % 8 + 1))
    d = table(spark, sf, "documents").select(
        "doc_id", "text", "source", kind.alias("kind"), X.normalise(F.col("text")).alias("plain"), X.normalise(F.substring("text", 1, 60)).alias("title"), F.regexp_extract("text", r"(\d+)", 1).alias("main")
    )
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_diff(F.lit(AS_OF).cast("date"), F.to_date("o_orderdate")).alias("age"))
    h = token_hits(spark, sf).where("hits >= cast(0.3 as double) * n_terms").join(table(spark, sf, "labels"), "doc_id").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    votes = h.groupBy("item_id", "source").agg((2 * (F.count_if(F.col("quality") == 1) - F.count_if(F.col("toxic") == 1))).alias("net"))
    adjusted = F.broadcast(spark.createDataFrame(_ADJUSTED, "intent string, kind string, points int"))
    before = own.where("k <= 3").select((F.col("item_id") + 1).alias("item_id"), "doc_id", F.lit(True).alias("carried"))
    x = own.join(R.small(q), "item_id").join(d, "doc_id").join(dates, "doc_id", "left").join(votes, ["item_id", "source"], "left").join(adjusted, ["intent", "kind"], "left").join(before, ["item_id", "doc_id"], "left")

    def points(of: dict[str, int]) -> Column:
        return F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in of.items()], F.lit(0))

    when = lambda cond, n: F.when(cond, n).otherwise(0)
    has = lambda c, p: F.rlike(c, F.lit(p))
    strict, age, raw, main = F.col("strict"), F.col("age"), F.col("raw"), F.col("main") != ""
    wanted = F.when(main & F.array_contains("wanted", F.col("main")), 42).when(F.exists("wanted", lambda w: F.contains(F.col("text"), w)), 28).when(main, -20).otherwise(0)
    friendly = has("plain", FRIENDLY)
    terms = {
        "base": 8 * F.col("hits"), "retrieval": X.half_up(F.lit(1.2) * points(PRIORITY)), "authority": points(AUTHORITY) + F.coalesce("points", F.lit(0)),
        "section": F.when(F.size("wanted") > 0, wanted).otherwise(when(main, 4)), "focus": F.greatest(F.lit(-40), F.least(F.lit(40), raw)),
        "freshness": F.when(age.isNull(), 0).when(age <= 30, 10).when(age <= 180, 6).when(age <= 365, 2).when(age <= 1095, 0).otherwise(-4),
        "helpful": F.least(F.lit(6), F.greatest(F.lit(0), F.coalesce("net", F.lit(0)))), "context": when(F.col("carried").isNotNull(), CARRY),
        "off_topic": when(F.col("kind").isin("document", "chunk", "base") & (raw < LEAST_FOCUS), OFF_TOPIC),
        "legal": F.when(strict & F.col("kind").isin("law", "group_law", "ruling"), LEGAL_SOURCE).otherwise(when(strict & has("plain", LEGALISH) & ~(F.col("kind").isin("document", "chunk") & friendly), LEGAL_TEXT)),
        "overview": when(strict & friendly, OVERVIEW), "overview_title": when(strict & has("title", FRIENDLY), OVERVIEW_TITLE),
        "closing_title": when(strict & has("title", CLOSING), CLOSING_TITLE), "general_title": when(strict & has("t", GENERAL) & has("title", GENERAL), GENERAL_TITLE),
    }
    s = x.select("item_id", "doc_id", *[c.cast("long").alias(n) for n, c in terms.items()]).withColumn("score", sum((F.col(n) for n in _TERMS[1:]), F.col("base")))
    return R.top(s, ["item_id"], [F.desc("score"), F.desc("base"), F.asc("doc_id")], 10, "place")


# Points of a passage's terms, and of a question that names the passage's type.
ROW = {"faq": 18, "exact_question": 35, "exact_title": 18, "exact_keyword": 14, "question_hits": 9, "keyword_hits": 8, "title_hits": 7, "answer_hits": 6, "chunk_hits": 5, "clean_hits": 4, "fulltext": 10}
TYPES = {"faq": 10, "summary": 8, "note": 8, "process": 8}
#: What makes a passage of a type, and a question that asks for it (own patterns; the first that fits).
TYPE_OF = [("faq", r"\?"), ("process", r"^[^a-z]*(first|then|[0-9]+[.)])"), ("note", r"!"), ("summary", r":")]
ASKS_TYPE = {"faq": r"\bthat\b|\bque\b", "summary": r"\ball\b|\bund\b", "note": r"\bnot\b|\bnicht\b", "process": r"\bto\b|\bzu\b"}
#: Passages that the full-text score leaves for the full one, at least: eight times what is returned, or thirty.
BEST = 5
FIRST = max(8 * BEST, 30)
_ROW_TERMS = ["faq", "exact_question", "exact_title", "exact_keyword", "question_hits", "keyword_hits", "title_hits", "answer_hits", "chunk_hits", "clean_hits", "type_intent", "fulltext"]
_HIT = lambda c: f"len(list_filter(terms, lambda t: contains({c}, t)))"


@query(
    rf"""with kc as ({ORACLE_SQL['knowledge_chunks']}),
p as (select doc_id, ordinal, keyword, {_NORM.format('chunk')} as clean, lower(chunk) as chunk, {_NORM.format("case when contains(chunk, '?') then split_part(chunk, '?', 1) else '' end")} as question,
    {_NORM.format("case when contains(chunk, '?') then substr(chunk, strpos(chunk, '?') + 1) else '' end")} as answer, case {' '.join(f"when regexp_matches(lower(chunk), '{p}') then '{t}'" for t, p in TYPE_OF)} else 'chunk' end as type from kc),
d as (select doc_id, {_NORM.format('substr(text, 1, 60)')} as title from documents),
q as (select item_id, {W.search_terms_sql('text')} as terms, {_NORM.format('text')} as norm from benchmark), qt as (select item_id, len(terms) as n_terms, unnest(terms) as term from q),
pt as (select distinct doc_id, ordinal, unnest(string_split(clean, ' ')) as term from p),
h as (select item_id, doc_id, ordinal, count(*) / any_value(n_terms)::double as ft from qt join pt using (term) group by all),
f as (select * from h qualify row_number() over (partition by item_id order by ft desc, doc_id desc, ordinal desc) <= {FIRST}),
x as (select f.*, q.terms, q.norm, p.keyword, p.clean, p.chunk, p.question, p.answer, p.type, d.title from f join q using (item_id) join p using (doc_id, ordinal) join d using (doc_id)),
t as (select item_id, doc_id, ordinal, type, case when type = 'faq' then {ROW['faq']} else 0 end as faq, case when question <> '' and contains(question, norm) then {ROW['exact_question']} else 0 end as exact_question,
    case when title <> '' and contains(title, norm) then {ROW['exact_title']} else 0 end as exact_title, case when keyword <> '' and contains(keyword, norm) then {ROW['exact_keyword']} else 0 end as exact_keyword,
    {', '.join(f"{ROW[n]} * {_HIT(c)} as {n}" for n, c in (('question_hits', 'question'), ('keyword_hits', 'keyword'), ('title_hits', 'title'), ('answer_hits', 'answer'), ('chunk_hits', 'chunk'), ('clean_hits', 'clean')))},
    case {' '.join(f"when type = '{t}' and regexp_matches(norm, '{p}') then {TYPES[t]}" for t, p in ASKS_TYPE.items())} else 0 end as type_intent, {ROW['fulltext']} * ft as fulltext from x),
s as (select *, ({' + '.join(_ROW_TERMS)})::double as score from t)
select item_id, doc_id, ordinal, type, {', '.join(f'{c}::bigint as {c}' for c in _ROW_TERMS[:-1])}, round(fulltext, 6) as fulltext, round(score, 6) as score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id desc, ordinal desc) as rank from s) where rank <= {BEST}"""
)
def hybrid_components(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of all texts for each question by twelve named terms. The share of the question's terms that a passage has as words (its full-text score) leaves FIRST
    candidates; their columns (keyword, title, question, answer, passage, plain form) are then searched for each term."""
    kc = knowledge_chunks(spark, sf)
    chunk = F.lower("chunk")
    asks = F.contains("chunk", F.lit("?"))
    kind = F.when(F.rlike(chunk, F.lit(TYPE_OF[0][1])), TYPE_OF[0][0])
    for name, pattern in TYPE_OF[1:]:
        kind = kind.when(F.rlike(chunk, F.lit(pattern)), name)
    p = kc.select(
        "doc_id", "ordinal", "keyword", X.normalise(F.col("chunk")).alias("clean"), chunk.alias("chunk"), X.normalise(F.when(asks, F.substring_index("chunk", "?", 1)).otherwise("")).alias("question"),
        X.normalise(F.when(asks, F.expr("substring(chunk, instr(chunk, '?') + 1)")).otherwise("")).alias("answer"), kind.otherwise("chunk").alias("type"),
    )
    q = questions(spark, sf)
    qt = q.select("item_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    pt = p.select("doc_id", "ordinal", F.explode(F.array_distinct(F.split("clean", " "))).alias("term"))
    h = pt.join(R.small(qt), "term").groupBy("item_id", "doc_id", "ordinal").agg((F.count(F.lit(1)) / F.any_value("n_terms")).alias("ft"))
    f = R.top(h, ["item_id"], [F.desc("ft"), F.desc("doc_id"), F.desc("ordinal")], FIRST, "k").drop("k")
    title = table(spark, sf, "documents").select("doc_id", X.normalise(F.substring("text", 1, 60)).alias("title"))
    x = f.join(p, ["doc_id", "ordinal"]).join(title, "doc_id").join(R.small(q), "item_id")
    hits = lambda c: F.size(F.filter("terms", lambda t: F.contains(F.col(c), t)))
    exact = lambda c: (F.col(c) != "") & F.contains(c, "norm")
    when = lambda cond, n: F.when(cond, n).otherwise(0)
    asked = sum((when((F.col("type") == t) & F.rlike("norm", F.lit(pattern)), TYPES[t]) for t, pattern in ASKS_TYPE.items()), F.lit(0))
    terms = {
        "faq": when(F.col("type") == "faq", ROW["faq"]), **{f"exact_{c}": when(exact(c), ROW[f"exact_{c}"]) for c in ("question", "title", "keyword")},
        **{f"{c}_hits": ROW[f"{c}_hits"] * hits(c) for c in ("question", "keyword", "title", "answer", "chunk", "clean")}, "type_intent": asked,
    }
    s = x.select("item_id", "doc_id", "ordinal", "type", *[c.cast("long").alias(n) for n, c in terms.items()], (ROW["fulltext"] * F.col("ft")).alias("fulltext"))
    s = s.withColumn("score", sum((F.col(n) for n in _ROW_TERMS[:-1]), F.lit(0)) + F.col("fulltext"))
    out = R.top(s, ["item_id"], [F.desc("score"), F.desc("doc_id"), F.desc("ordinal")], BEST)
    return out.withColumns({"fulltext": F.round("fulltext", 6), "score": F.round("score", 6)})

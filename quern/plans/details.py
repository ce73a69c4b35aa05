"""Smaller parts of search and display: columns, labels, orders, number forms, further scores, drafts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import rules as W
from ..functions import text as X
from ..operators import relational as R
from ..operators import segmentation as D
from ..sources.readers import table
from .base import query
from .scoring import _FIRST, near
from .search import _HITS, token_hits

TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "part", "customer")
#: Columns that a search would use, best first.
WANTED = ("text", "html", "p_name", "c_name", "url", "source", "title")
_PLACE = " ".join(f"when '{c}' then {k}" for k, c in enumerate(WANTED))


@query(f"select table_name as name, column_name as col, case column_name {_PLACE} end as place from information_schema.columns where table_name in ({W.quoted(TABLES)}) and column_name in ({W.quoted(WANTED)})")
def search_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the wanted columns each table has, from their schemas alone."""
    rows = [(t, c, WANTED.index(c)) for t in TABLES for c in table(spark, sf, t).columns if c in WANTED]
    return spark.createDataFrame(rows, "name string, col string, place int")


@query("select page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), nullif(url, ''), 'page ' || page_id) as label, coalesce(nullif(regexp_extract(url, '/([a-z]{2})/', 1), ''), 'none') as lang from pages")
def presentation(spark: SparkSession, sf: str) -> DataFrame:
    """The first label that isn't empty."""
    some = lambda c: F.nullif(c, F.lit(""))
    title = some(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    return table(spark, sf, "pages").select("page_id", F.coalesce(title, some(F.col("url")), F.concat(F.lit("page "), "page_id")).alias("label"), F.coalesce(some(F.regexp_extract("url", "/([a-z]{2})/", 1)), F.lit("none")).alias("lang"))


@query("select doc_id, case when lang = 'en' then ['en', 'general', 'all'] else [lang, 'en', 'general', 'all'] end as targets from documents where list_contains(case when lang = 'en' then ['en', 'general', 'all'] else [lang, 'en', 'general', 'all'] end, 'fr')")
def lookup_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that a row's question falls back to, in order; the rows among whose targets a given one is."""
    rest = F.array(F.lit("en"), F.lit("general"), F.lit("all"))
    targets = F.when(F.col("lang") == "en", rest).otherwise(F.concat(F.array("lang"), rest))
    return table(spark, sf, "documents").select("doc_id", targets.alias("targets")).where(F.array_contains("targets", "fr"))


@query(
    f"""with {_HITS}, d as (select doc_id, source, lang, nullif(regexp_extract(text, '(\\d+)', 1), '')::decimal(38, 0) as number from documents),
t as (select *, row_number() over (partition by item_id order by hits desc, doc_id) as k from hits),
r as (select item_id, doc_id, row_number() over (partition by item_id order by case source when 'src0' then 0 when 'src1' then 1 else 2 end, number asc nulls last, hits desc, doc_id) as place from t join d using (doc_id) where k <= 12)
select item_id, doc_id, place from r"""
)
def display_order(spark: SparkSession, sf: str) -> DataFrame:
    """Selected sources as they are shown: by kind, by their first number, by score."""
    number = F.nullif(F.regexp_extract("text", r"(\d+)", 1), F.lit("")).cast("decimal(38,0)")
    d = table(spark, sf, "documents").select("doc_id", "source", number.alias("number"))
    t = R.top(token_hits(spark, sf), ["item_id"], [F.desc("hits"), F.asc("doc_id")], 12, "k").join(d, "doc_id")
    kind = F.when(F.col("source") == "src0", 0).when(F.col("source") == "src1", 1).otherwise(2)
    return R.top(t, ["item_id"], [kind, F.asc_nulls_last("number"), F.desc("hits"), F.asc("doc_id")], 12, "place").select("item_id", "doc_id", "place")


@query(r"with a as (select item_id, list_filter(regexp_extract_all(lower(text), '([\p{L}\p{M}\p{N}]+)', 1), lambda x: regexp_matches(x, '^[a-z0-9]{2,4}$')) as a from benchmark) select item_id, list_filter(a, lambda x, i: list_position(a, x) = i) as abbreviations from a")
def abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    """Short words that may be abbreviations, each once."""
    short = F.filter(X.tokens(F.col("text")), lambda x: F.rlike(x, F.lit("^[a-z0-9]{2,4}$")))
    return table(spark, sf, "benchmark").select("item_id", F.array_distinct(short).alias("abbreviations"))


@query(
    r"""with n as (select doc_id, ltrim(regexp_extract(text, '(\d{1,9})', 1), '0') as n from documents where regexp_matches(text, '\d')),
t as (select doc_id, case when n = '' then '0' else n end as n from n)
select doc_id, n::bigint as clause, n as arabic, translate(n, '0123456789', '๐๑๒๓๔๕๖๗๘๙') as thai, n || ' (' || translate(n, '0123456789', '๐๑๒๓๔๕๖๗๘๙') || ')' as "both" from t"""
)
def number_display(spark: SparkSession, sf: str) -> DataFrame:
    """A text's first number as an integer and in the ways in which it may be shown and searched."""
    n = F.ltrim(F.regexp_extract("text", r"(\d{1,9})", 1), F.lit("0"))
    d = table(spark, sf, "documents").where(F.rlike("text", F.lit(r"\d"))).select("doc_id", F.when(n == "", "0").otherwise(n).alias("arabic"))
    thai = X.ascii_digits_to_thai(F.col("arabic"))
    return d.select("doc_id", F.col("arabic").cast("bigint").alias("clause"), "arabic", thai.alias("thai"), F.concat("arabic", F.lit(" ("), thai, F.lit(")")).alias("both"))


def _best(spark: SparkSession, sf: str, score, n: int = 10) -> DataFrame:
    return R.top(near(spark, sf).withColumn("score", score), ["item_id"], [F.desc("score"), F.asc("doc_id")], n).select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def _best_sql(score: str, n: int = 10) -> str:
    return f"""with {_FIRST}, s as (select item_id, doc_id, {score} as score from parts), r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s)
select item_id, doc_id, round(score, 4) as score, rank from r where rank <= {n}"""


@query(_best_sql("28 * phrase::int + 8 * hits + 10 * bigrams + 18 * hits / n_terms::double + case when source <> '' then 8 else 0 end"))
def knowledge_score(spark: SparkSession, sf: str) -> DataFrame:
    """Curated rows: phrase, tokens, pairs, coverage, a title."""
    return _best(spark, sf, 28 * F.col("phrase").cast("int") + 8 * F.col("hits") + 10 * F.col("bigrams") + 18 * F.col("hits") / F.col("n_terms") + F.when(F.col("source") != "", 8).otherwise(0))


@query(_best_sql("30 * phrase::int + 7 * hits + 9 * bigrams + case when hits >= 0.6::double * n_terms then 12 else 0 end + case when source in ('src1', 'src2') then 6 else 0 end"))
def suggestion_score(spark: SparkSession, sf: str) -> DataFrame:
    score = 30 * F.col("phrase").cast("int") + 7 * F.col("hits") + 9 * F.col("bigrams") + W.points((F.col("hits") >= F.lit(0.6) * F.col("n_terms"), 12), (F.col("source").isin("src1", "src2"), 6))
    return _best(spark, sf, score)


@query(_best_sql("case when phrase then 60 else 0 end + 6 * hits + case when len(list_filter(terms, lambda t: length(t) >= 5 and contains(body, t))) >= 3 then 15 else 0 end"))
def ruling_score(spark: SparkSession, sf: str) -> DataFrame:
    long = F.size(F.filter("terms", lambda t: (F.length(t) >= 5) & F.contains(F.col("body"), t)))
    return _best(spark, sf, W.points((F.col("phrase"), 60), (long >= 3, 15)) + 6 * F.col("hits"))


@query(_best_sql("case when phrase then 24 else least(20, 8 * hits) + case when hits / n_terms::double >= 0.75::double then 8 when hits / n_terms::double >= 0.5::double then 4 else 0 end end"))
def focus_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """A question without a topic of its own: the phrase, else hits up to a cap and two steps of coverage."""
    cover = F.col("hits") / F.col("n_terms")
    return _best(spark, sf, F.when(F.col("phrase"), 24).otherwise(F.least(F.lit(20), 8 * F.col("hits")) + F.when(cover >= 0.75, 8).when(cover >= 0.5, 4).otherwise(0)))


@query(f"with t as (select item_id, {W.search_terms_sql('text')} as t, regexp_extract_all(text, '(\\d+)', 1) as own from benchmark) select item_id, list_filter(t, lambda x: length(x) between 2 and 60 and (not regexp_matches(x, '\\d') or list_contains(own, x))) as kept from t")
def sanitised_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of a rewritten question: of a sensible length, and no number that the question itself hasn't got."""
    t = table(spark, sf, "benchmark").select("item_id", W.search_terms(F.col("text")).alias("t"), F.regexp_extract_all("text", F.lit(r"(\d+)"), 1).alias("own"))
    return t.select("item_id", F.filter("t", lambda x: F.length(x).between(2, 60) & (~F.rlike(x, F.lit(r"\d")) | F.array_contains("own", x))).alias("kept"))


@query(
    f"""with {_FIRST}, u as (select item_id, doc_id, 999 as score from parts where phrase union all select item_id, doc_id, 8 * hits + 90 from parts where hits = n_terms union all select item_id, doc_id, 8 * hits + 50 from parts where bigrams > 0
  union all select item_id, doc_id, 8 * hits from parts where hits >= 2), g as (select item_id, doc_id, max(score) as score from u group by 1, 2), r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from g)
select item_id, doc_id, score, place from r where place <= 8"""
)
def search_driver(spark: SparkSession, sf: str) -> DataFrame:
    """Exact, full, paired and broad hits with their bonuses, each row once with its best, in order."""
    n = near(spark, sf)
    stage = lambda cond, score: n.where(cond).select("item_id", "doc_id", score.cast("long").alias("score"))
    hits = 8 * F.col("hits")
    u = stage(F.col("phrase"), F.lit(999)).unionByName(stage(F.col("hits") == F.col("n_terms"), hits + 90)).unionByName(stage(F.col("bigrams") > 0, hits + 50)).unionByName(stage(F.col("hits") >= 2, hits))
    g = u.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    return R.top(g, ["item_id"], [F.desc("score"), F.asc("doc_id")], 8, "place").select("item_id", "doc_id", "score", "place")


@query(
    r"""with b as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x)), lambda x: x <> '')) as l from documents)
select doc_id, count(*) filter (where regexp_matches(l, '^(?:[-*•]|\d+[.)])\s')) as steps, count(*) filter (where regexp_matches(l, ':$')) as headings, count(*) filter (where regexp_matches(l, '\?$')) as questions, count(*) as lines from b group by 1"""
)
def typed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines of each kind a text has; counted within its row."""
    lines = F.filter(F.transform(F.split("text", r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    n = lambda p: F.size(F.filter("l", lambda x: F.rlike(x, F.lit(p)))).cast("long")
    d = table(spark, sf, "documents").select("doc_id", lines.alias("l")).where(F.size("l") > 0)
    return d.select("doc_id", n(r"^(?:[-*•]|\d+[.)])\s").alias("steps"), n(":$").alias("headings"), n(r"\?$").alias("questions"), F.size("l").cast("long").alias("lines"))


def drafts(rows: DataFrame, generator: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """doc_id, draft of rows (doc_id, text): by the given function of a batch of texts, else their beginnings."""
    make = generator or (lambda texts: texts.str.slice(0, 80) + "...")

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "draft": make(f["text"])})

    return rows.select("doc_id", "text").mapInPandas(run, "doc_id long, draft string")


@query("select doc_id, substr(text, 1, 80) || '...' as draft from documents where source = 'src0'")
def knowledge_drafts(spark: SparkSession, sf: str) -> DataFrame:
    return drafts(table(spark, sf, "documents").where("source = 'src0'"))


@query(
    r"""with x as (select conv_id, turn, case when role = 'user' then '{"content": ' || to_json(text) || '}' when turn % 5 = 0 then 'broken' else '{"chunk_text": ' || to_json(text) || ', "content": "other"}' end as j, role, text from conversations)
select conv_id, turn, case when j = 'broken' then null when role = 'user' then regexp_extract(text, '^([^\n]*)', 1) else text end as chunk, j <> 'broken' as valid from x"""
)
def json_chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """JSON items as chunks: an explicit chunk wins, else the first line of a free text; items that don't parse are told apart."""
    c = table(spark, sf, "conversations")
    own = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("content")))).when(F.col("turn") % 5 == 0, "broken").otherwise(F.to_json(F.struct(F.col("text").alias("chunk_text"), F.lit("other").alias("content"))))
    item = F.from_json("j", "chunk_text string, content string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = c.select("conv_id", "turn", own.alias("j")).select("conv_id", "turn", item.alias("i"))
    chunk = F.coalesce(F.col("i.chunk_text"), F.regexp_extract(F.col("i.content"), r"^([^\n]*)", 1))
    return rows.select("conv_id", "turn", chunk.alias("chunk"), F.col("i._bad").isNull().alias("valid"))


@query()
def segmented_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose blanks are taken out, and how many of their words' ends a dictionary of the table's words finds again: found of boundaries, by so many cuts."""
    d = table(spark, sf, "documents").select("doc_id", X.normalise(F.col("text")).alias("plain"))
    words = D.dictionary(d.select(F.explode(F.split("plain", " ")).alias("word")).where("word <> ''"), least=1)
    joined = d.select("doc_id", F.replace("plain", F.lit(" "), F.lit("")).alias("text"))
    true = d.select("doc_id", F.filter(F.split("plain", " "), lambda w: w != "").alias("true"))
    both = true.join(D.segmented(joined, words).withColumnRenamed("id", "doc_id"), "doc_id")
    return both.select("doc_id", F.size("true").alias("boundaries"), F.size("words").alias("cuts"), A.shared_ends("true", "words").alias("found"))


@query(r"select item_id, regexp_extract_all(text, '([\p{L}\p{M}\p{N}]+)', 1) as words from benchmark")
def word_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Words by the language's rules of word boundaries (Thai has no blanks between words), sentence by sentence."""
    words = F.flatten(F.sentences(F.col("text"), F.lit("th"), F.lit("TH")))
    return table(spark, sf, "benchmark").select("item_id", words.alias("words"))

"""Merging sources, quotas, reranking, evaluation and conversations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..sources.readers import table
from .base import query
from .search import _HITS, MOST, token_hits

#: Quotas by source.
QUOTA = {"src0": 3, "src1": 2, "src2": 2, "src3": 1}
_QUOTA = "case source when 'src0' then 3 when 'src1' then 2 when 'src2' then 2 when 'src3' then 1 else 0 end"
AS_OF = "2024-02-01"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return token_hits(spark, sf).join(d, "doc_id")


_CAND = f"{_HITS}, cand as (select item_id, doc_id, hits, n_terms, source, lang, n_chars from hits join nq using (item_id) join documents using (doc_id))"


@query(
    f"""with {_CAND}, r as (select *, row_number() over (partition by item_id, source order by hits desc, doc_id) as source_rank from cand),
s as (select *, row_number() over (partition by item_id order by hits desc, doc_id) as place from r where source_rank <= {_QUOTA})
select item_id, doc_id, source, source_rank, place from s where place <= 6"""
)
def quota_select(spark: SparkSession, sf: str) -> DataFrame:
    return R.quotas(candidates(spark, sf), "item_id", "source", [F.desc("hits"), F.asc("doc_id")], QUOTA, 6).select("item_id", "doc_id", "source", "source_rank", "place")


@query(
    f"""with {_CAND}, r as (select *, row_number() over (partition by item_id, source order by hits desc, doc_id) as source_rank from cand),
s as (select *, row_number() over (partition by item_id order by hits desc, doc_id) as place from r where source_rank <= {_QUOTA})
select c.item_id, c.source, count(*) as candidates, count(s.doc_id) as selected from cand c left join (select * from s where place <= 6) s on c.item_id = s.item_id and c.doc_id = s.doc_id group by 1, 2"""
)
def selection_trace(spark: SparkSession, sf: str) -> DataFrame:
    """For each question and source how many candidates there were and how many were taken."""
    got = quota_select(spark, sf).select("item_id", "doc_id", F.lit(1).alias("taken"))
    return candidates(spark, sf).join(got, ["item_id", "doc_id"], "left").groupBy("item_id", "source").agg(F.count(F.lit(1)).alias("candidates"), F.count("taken").alias("selected"))


@query(f"with {_CAND}, a as (select *, first_value(source) over (partition by item_id order by hits desc, doc_id) as anchor from cand), r as (select *, row_number() over (partition by item_id order by hits desc, doc_id) as k from a where source = anchor) select item_id, doc_id, anchor from r where k <= {MOST}")
def anchor_coherence(spark: SparkSession, sf: str) -> DataFrame:
    """Only rows of the source of the best row."""
    # the best rows of each source: those of the best row's source are then among them
    per = R.top(candidates(spark, sf), ["item_id", "source"], [F.desc("hits"), F.asc("doc_id")], MOST)
    anchor = F.first("source").over(Window.partitionBy("item_id").orderBy(F.desc("hits"), F.asc("doc_id")))
    return per.withColumn("anchor", anchor).where("source = anchor").select("item_id", "doc_id", "anchor")


@query(
    f"""with {_CAND}, u as (select item_id, doc_id, 8 * hits as score, 1 as tier from cand where source = 'src0' union all select item_id, doc_id, 6 * hits + 2, 2 from cand where lang = 'en'),
r as (select *, row_number() over (partition by item_id order by tier, score desc, doc_id) as place from u) select item_id, doc_id, tier, score, place from r where place <= 120"""
)
def union_top(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    a = c.where("source = 'src0'").select("item_id", "doc_id", (8 * F.col("hits")).alias("score"), F.lit(1).alias("tier"))
    b = c.where("lang = 'en'").select("item_id", "doc_id", (6 * F.col("hits") + 2).alias("score"), F.lit(2).alias("tier"))
    return R.top(a.unionByName(b), ["item_id"], [F.asc("tier"), F.desc("score"), F.asc("doc_id")], 120, "place")


@query("with k as (select *, row_number() over (partition by md5(text) order by doc_id) as rn from documents) select doc_id from k where rn = 1")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """First row of each identity; min_by combines before the shuffle."""
    return table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(
    f"""with {_CAND}, b as (select *, max(case when source = 'src0' then hits end) over (partition by item_id) as best from cand),
r as (select *, case when source = 'src0' then 1 else 2 end as stage from b where source = 'src0' or coalesce(best, 0) < 4),
k as (select *, row_number() over (partition by item_id order by stage, hits desc, doc_id) as k from r)
select item_id, doc_id, stage from k where k <= {MOST}"""
)
def staged_union(spark: SparkSession, sf: str) -> DataFrame:
    """A second stage joins in only for questions whose first stage is weak."""
    c = candidates(spark, sf)
    best = c.groupBy("item_id").agg(F.max(F.when(F.col("source") == "src0", F.col("hits"))).alias("best"))
    stage = F.when(F.col("source") == "src0", 1).otherwise(2)
    b = c.join(R.small(best), "item_id").withColumn("stage", stage).where("stage = 1 or coalesce(best, 0) < 4")
    return R.top(b, ["item_id"], [F.asc("stage"), F.desc("hits"), F.asc("doc_id")], MOST).select("item_id", "doc_id", "stage")


@query(
    """with d as (select doc_id, source, text, length(text) as n, substr(text, 1, 80) as head from documents where text <> '')
select distinct b.doc_id from d a join d b on a.source = b.source and a.head = b.head and a.doc_id < b.doc_id
where a.text = b.text or least(a.n, b.n) >= 80 and (starts_with(a.text, b.text) or starts_with(b.text, a.text)) and least(a.n, b.n) >= 0.92::double * greatest(a.n, b.n)"""
)
def prefix_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of one source that are equal, or from 80 signs on a prefix of one another at 0.92 of the length. Equal texts are one row
    before any texts meet. Lengths are put in steps of 1 / 0.92, so two near lengths are at most two steps apart, and
    both texts have all the signs that the lower step takes: they meet by a hash of these, not by a short common beginning."""
    ratio = 0.92
    d = table(spark, sf, "documents").where("text != ''").select("doc_id", "source", "text", F.sha2("text", 256).alias("h"))
    one = d.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id"), F.any_value("text").alias("text")).withColumn("n", F.length("text"))
    step = F.floor(F.log("n") / float(-np.log(ratio))).cast("int")
    keyed = one.where("n >= 80").withColumn("step", F.explode(F.sequence(step - 2, step)))
    keyed = keyed.withColumn("head", F.xxhash64(F.substr("text", F.lit(1), F.floor(F.pow(F.lit(1 / ratio), F.col("step"))).cast("int"))))
    a = keyed.select("source", "step", "head", F.col("text").alias("ta"), F.col("doc_id").alias("a"), F.col("n").alias("na"))
    pairs = a.join(keyed, ["source", "step", "head"]).where("a != doc_id and (startswith(ta, text) or startswith(text, ta)) and least(na, n) >= cast(0.92 as double) * greatest(na, n)")
    # the smallest id among a text's near texts, and its own: rows with a larger id have an earlier near copy
    low = pairs.groupBy("source", "h").agg(F.min("a").alias("low"))
    own = one.select("source", "h", F.col("doc_id").alias("own")).join(low, ["source", "h"], "left")
    return d.select("doc_id", "source", "h").join(own, ["source", "h"]).where("own < doc_id or low < doc_id").select("doc_id")


_RERANK = f"""{_CAND}, t as (select item_id, doc_id, 8 * hits as base, floor(1.2::double * case source when 'src0' then 10 when 'src1' then 6 else 2 end + 0.5)::int as priority,
  case when lang = 'en' then 12 else 4 end as authority, case when n_chars > 3000 then -18 else 0 end as off_topic,
  case when age is null then 0 when age <= 30 then 10 when age <= 180 then 6 when age <= 365 then 2 when age <= 1095 then 0 else -4 end as freshness from (select cand.*, date_diff('day', o_orderdate, date '2001-09-01') as age from cand left join orders on o_orderkey = doc_id))"""


def reranked(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with the parts of their score and its sum; the date of the order of the same number stands for a document's."""
    s, age = F.col("source"), F.col("age")
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_diff(F.lit("2001-09-01").cast("date"), F.to_date("o_orderdate")).alias("age"))
    t = candidates(spark, sf).join(dates, "doc_id", "left").select(
        "item_id", "doc_id", (8 * F.col("hits")).alias("base"), X.half_up(F.lit(1.2) * F.when(s == "src0", 10).when(s == "src1", 6).otherwise(2)).cast("int").alias("priority"),
        F.when(F.col("lang") == "en", 12).otherwise(4).alias("authority"), F.when(F.col("n_chars") > 3000, -18).otherwise(0).alias("off_topic"),
        F.when(age.isNull(), 0).when(age <= 30, 10).when(age <= 180, 6).when(age <= 365, 2).when(age <= 1095, 0).otherwise(-4).alias("freshness"),
    )
    return t.withColumn("score", sum((F.col(c) for c in ("priority", "authority", "off_topic", "freshness")), F.col("base")))


@query(f"with {_RERANK}, r as (select *, base + priority + authority + off_topic + freshness as score from t), k as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from r) select * from k where place <= 10")
def rerank(spark: SparkSession, sf: str) -> DataFrame:
    return R.top(reranked(spark, sf), ["item_id"], [F.desc("score"), F.asc("doc_id")], 10, "place")


_METRICS = f"""{_RERANK}, r as (select *, base + priority + authority + off_topic + freshness as score from t),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from r),
m as (select item_id, count(*) as n, max(case when place = 1 then score end) as top, coalesce(max(case when place = 2 then score end), 0) as second, count(*) filter (where freshness > 2) as fresh, max(authority) as authority from k where place <= 6 group by 1),
a as (select *, top + 0.35::double * second as set_score from m),
c as (select *, least(20, greatest(0, floor(greatest(top / 10.0::double, set_score / 8) + 0.5)))::bigint as confidence from a)"""


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = R.top(reranked(spark, sf), ["item_id"], [F.desc("score"), F.asc("doc_id")], 6, "place")
    at = lambda p: F.max(F.when(F.col("place") == p, F.col("score")))
    m = k.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), at(1).alias("top"), F.coalesce(at(2), F.lit(0)).alias("second"), F.count_if(F.col("freshness") > 2).alias("fresh"), F.max("authority").alias("authority"))
    m = m.withColumn("set_score", F.col("top") + F.lit(0.35) * F.col("second"))
    return m.withColumn("confidence", F.least(F.lit(20), F.greatest(F.lit(0), X.half_up(F.greatest(F.col("top") / 10, F.col("set_score") / 8)))))


@query(f"with {_METRICS} select item_id, n, top, second, fresh, round(set_score, 4) as set_score, confidence from c")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("item_id", "n", "top", "second", "fresh", F.round("set_score", 4).alias("set_score"), "confidence")


@query(
    f"""with {_METRICS}, s as (select *, floor((greatest(60, least(125, top::double)) - 60) / 65 * 28 + 0.5)::bigint + floor((greatest(70, least(150, set_score)) - 70) / 80 * 18 + 0.5)::bigint + confidence + least(12, authority) + (case when n >= 3 then 8 else 4 end) - (case when fresh = 0 then 6 else 0 end) as a from c)
select item_id, a as answerability, case when a >= 75 then 'high' when a >= 50 then 'medium' else 'low' end as level, case when a < 50 then 'no_answer' when n < 2 then 'clarify' else 'answer' end as policy,
  list_filter([case when top < 80 then 'weak_top' end, case when second < 60 then 'single_source' end, case when fresh = 0 then 'stale' end], lambda x: x is not null) as reasons from s"""
)
def answerability(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    a = X.scale_to(F.col("top"), 60, 125, 28) + X.scale_to(F.col("set_score"), 70, 150, 18) + F.col("confidence") + F.least(F.lit(12), F.col("authority")) + F.when(F.col("n") >= 3, 8).otherwise(4) - F.when(F.col("fresh") == 0, 6).otherwise(0)
    s = m.withColumn("answerability", a)
    a = F.col("answerability")
    return s.select(
        "item_id", "answerability", F.when(a >= 75, "high").when(a >= 50, "medium").otherwise("low").alias("level"),
        F.when(a < 50, "no_answer").when(F.col("n") < 2, "clarify").otherwise("answer").alias("policy"),
        X.flags(("weak_top", F.col("top") < 80), ("single_source", F.col("second") < 60), ("stale", F.col("fresh") == 0)).alias("reasons"),
    )


@query(f"with {_CAND}, g as (select *, count(*) filter (where lang = 'de') over (partition by item_id) as n from cand), r as (select *, row_number() over (partition by item_id order by hits desc, doc_id) as k from g where lang = 'de' or n = 0) select item_id, doc_id from r where k <= {MOST}")
def focus_pruning(spark: SparkSession, sf: str) -> DataFrame:
    kept = R.keep_or_all(candidates(spark, sf), "item_id", F.col("lang") == "de")
    return R.top(kept, ["item_id"], [F.desc("hits"), F.asc("doc_id")], MOST).select("item_id", "doc_id")


@query(f"with {_HITS}, m as (select item_id, count(*) as n, max(8 * hits) as best from hits where hits >= 4 group by 1) select q.item_id, case when n is null then 'none' when best < 45 then 'weak' when n = 1 and best < 70 then 'single_weak' end as reason from q left join m using (item_id)")
def search_miss_reason(spark: SparkSession, sf: str) -> DataFrame:
    m = token_hits(spark, sf).where("hits >= 4").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max(8 * F.col("hits")).alias("best"))
    j = table(spark, sf, "benchmark").select("item_id").join(m, "item_id", "left")
    return j.select("item_id", F.when(F.col("n").isNull(), "none").when(F.col("best") < 45, "weak").when((F.col("n") == 1) & (F.col("best") < 70), "single_weak").alias("reason"))


_DIST = "case when lang = 'en' then 0 when lang = 'fr' then 1 when lang = 'de' then 2 else 3 end"


@query(f"select doc_id, {_DIST} as distance from documents order by distance, n_chars desc, doc_id limit 60")
def target_distance(spark: SparkSession, sf: str) -> DataFrame:
    dist = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    return table(spark, sf, "documents").withColumn("distance", dist).orderBy("distance", F.desc("n_chars"), "doc_id").limit(60).select("doc_id", "distance")


@query("select count(*) as total, ceil(count(*) / 24.0)::bigint as pages, least(greatest(7, 1), ceil(count(*) / 24.0))::bigint as page, ((least(7, ceil(count(*) / 24.0)) - 1) * 24 + 1)::bigint as first, least(7 * 24, count(*))::bigint as last from benchmark")
def pagination_meta(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / 24))
    p = F.least(F.lit(7), F.col("pages"))
    return b.select("total", "pages", p.alias("page"), ((p - 1) * 24 + 1).alias("first"), F.least(F.lit(7 * 24), F.col("total")).cast("long").alias("last"))


@query(f"with {_HITS}, s as (select d.item_id, h.doc_id, 2 as stage, hits as score from q d join hits h using (item_id) union all select q.item_id, d.doc_id, 1, 100 from q join documents d on trim(regexp_replace(lower(d.text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')) = q.norm), r as (select *, row_number() over (partition by item_id order by stage, score desc, doc_id) as rn from s) select item_id, doc_id, stage from r where rn = 1")
def staged_match(spark: SparkSession, sf: str) -> DataFrame:
    """An exact match if there is one, else the best fuzzy one."""
    q = table(spark, sf, "benchmark").select("item_id", X.normalise(F.col("text")).alias("norm"))
    exact = table(spark, sf, "documents").select("doc_id", X.normalise(F.col("text")).alias("norm")).join(R.small(q), "norm").select("item_id", "doc_id", F.lit(1).alias("stage"), F.lit(100).cast("long").alias("score"))
    fuzzy = token_hits(spark, sf).select("item_id", "doc_id", F.lit(2).alias("stage"), F.col("hits").alias("score"))
    return R.top(exact.unionByName(fuzzy), ["item_id"], [F.asc("stage"), F.desc("score"), F.asc("doc_id")], 1).select("item_id", "doc_id", "stage")


@query("with s as (select conv_id, turn, length(text) as n, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as upto from conversations) select conv_id, turn, (floor((upto - n) / 1200.0) + 1)::int as page from s")
def running_budget_page(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return R.running_page(c, ["conv_id"], [F.asc("turn")], F.length("text"), 1200).select("conv_id", "turn", "page")


@query("select conv_id, turn, list(role || ':' || length(text)) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding) as history from conversations where true qualify turn > 0")
def last_three_turns(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.collect_list(F.concat("role", F.lit(":"), F.length("text"))).over(w).alias("history")).where("turn > 0")


@query("with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) - 1 as i, length(text) as n from conversations) select conv_id, turn, greatest(n % 100, 92 - 3 * i) as score from r where i < 3")
def carry_decay(spark: SparkSession, sf: str) -> DataFrame:
    c = R.top(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 3)
    return c.select("conv_id", "turn", F.greatest(F.length("text") % 100, 92 - 3 * (F.col("rank") - 1)).alias("score"))


_INTENT = r"case when regexp_matches(lower(text), '\?\s*$') then 'question' when regexp_matches(lower(text), '\d') then 'reference' when length(text) < 60 then 'short' else 'statement' end"


@query(f"select conv_id, turn, {_INTENT} as intent, turn > 0 and length(text) < 120 as follow_up from conversations where role = 'user'")
def intent_and_follow_up(spark: SparkSession, sf: str) -> DataFrame:
    t = F.lower("text")
    intent = F.when(F.rlike(t, F.lit(r"\?\s*$")), "question").when(F.rlike(t, F.lit(r"\d")), "reference").when(F.length("text") < 60, "short").otherwise("statement")
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", intent.alias("intent"), ((F.col("turn") > 0) & (F.length("text") < 120)).alias("follow_up"))

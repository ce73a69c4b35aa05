"""Topic families from a rule table, matched by one automaton: profiles of questions, tags of texts, boosts of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import topic_rules as T
from ..operators import patterns as P
from ..operators import relational as R
from ..sources.readers import table
from .base import query
from .search import _HITS, _NORM, MOST, token_hits

_ROWS = ", ".join(f"({k}, '{f}', '{kind}', '{p}', {n}, {up}, {down})" for k, f, kind, p, n, up, down in T.NUMBERED)


def _occurrences_sql(name: str, texts: str, key: str, kinds: str) -> str:
    """CTEs `name` (key, rule_id, s, outer: lies in no longer one). No phrase overlaps itself, so splitting at it finds all occurrences."""
    return f"""{name}_rules as (select rule_id, phrase from rules where kind in ({kinds})),
{name}_parts as (select {key}, rule_id, phrase, string_split(plain, phrase) as parts from {texts} join {name}_rules on contains(plain, phrase)),
{name}_occ as (select {key}, rule_id, unnest(list_transform(range(1, len(parts)), lambda x: (list_sum(list_transform(parts[1:x], lambda y: length(y))) + (x - 1) * length(phrase))::int)) as s from {name}_parts),
{name}_cover as (select a.rule_id as short, b.rule_id as long, unnest(list_filter(range(length(b.phrase)), lambda o: substr(b.phrase, (o + 1)::int, length(a.phrase)) = a.phrase)) as off
  from {name}_rules a join {name}_rules b on length(b.phrase) > length(a.phrase) and contains(b.phrase, a.phrase)),
{name}_hidden as (select distinct o.{key}, o.rule_id, o.s from {name}_occ o join {name}_cover c on c.short = o.rule_id join {name}_occ p on p.{key} = o.{key} and p.rule_id = c.long and p.s = o.s - c.off),
{name} as (select o.{key}, o.rule_id, o.s, h.s is null as outer_ from {name}_occ o left join {name}_hidden h on h.{key} = o.{key} and h.rule_id = o.rule_id and h.s = o.s)"""


_RULES = f"rules(rule_id, family, kind, phrase, points, cap_up, cap_down) as (values {_ROWS}), d as (select doc_id, {_NORM.format('text')} as plain from documents), b as (select item_id, {_NORM.format('text')} as plain from benchmark)"
_IN_TEXTS = _occurrences_sql("said", "d", "doc_id", "'context', 'conflict'")
_ASKED = _occurrences_sql("asked", "b", "item_id", "'ask'")


def rules(spark: SparkSession, *kinds: str) -> DataFrame:
    return spark.createDataFrame(T.NUMBERED, T.SCHEMA).where(F.col("kind").isin(*kinds))


def _found(spark: SparkSession, sf: str, name: str, key: str, kinds: tuple[str, ...], longest: bool = True) -> DataFrame:
    texts = table(spark, sf, name).select(key, X.normalise(F.col("text")))
    return P.occurrences(texts, rules(spark, *kinds).select("rule_id", "phrase"), longest)


@query(f"with {_RULES}, {_IN_TEXTS} select doc_id, phrase, count(*) as n, count(*) filter (where outer_) as n_outside from said join (select min(rule_id) as rule_id, phrase from said_rules group by phrase) using (rule_id) group by all")
def pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each phrase of the rule table stands in each text, and how often outside of longer ones."""
    texts = table(spark, sf, "documents").select("doc_id", X.normalise(F.col("text")))
    one = rules(spark, "context", "conflict").groupBy("phrase").agg(F.min("rule_id").alias("rule_id"))
    one = R.small(one)
    count = lambda longest, name: P.occurrences(texts, one.select("rule_id", "phrase"), longest).groupBy("id", "rule_id").agg(F.count(F.lit(1)).alias(name))
    n = count(False, "n").join(count(True, "n_outside"), ["id", "rule_id"], "left").join(one, "rule_id")
    return n.select(F.col("id").alias("doc_id"), "phrase", "n", F.coalesce("n_outside", F.lit(0)).cast("long").alias("n_outside"))


@query(
    f"""with {_RULES}, {_ASKED}, {_occurrences_sql('meant', 'b', 'item_id', "'intent'")},
a as (select item_id, family, list(distinct phrase order by phrase) as phrases from asked join rules using (rule_id) where outer_ group by all),
i as (select distinct item_id, family, phrase from meant join rules using (rule_id))
select item_id, family, phrases, list_sort(coalesce(list(phrase) filter (where phrase is not null), [])) as intents from a left join i using (item_id, family) group by all"""
)
def focus_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The families that a question asks for, by phrases outside of longer ones, and its intents of each."""
    a = _found(spark, sf, "benchmark", "item_id", ("ask",)).join(F.broadcast(rules(spark, "ask")), "rule_id")
    i = _found(spark, sf, "benchmark", "item_id", ("intent",), False).join(F.broadcast(rules(spark, "intent")), "rule_id")
    a = a.groupBy("id", "family").agg(F.array_sort(F.collect_set("phrase")).alias("phrases"))
    i = i.groupBy("id", "family").agg(F.array_sort(F.collect_set("phrase")).alias("intents"))
    none = F.array().cast("array<string>")
    return a.join(i, ["id", "family"], "left").select(F.col("id").alias("item_id"), "family", "phrases", F.coalesce("intents", none).alias("intents"))


@query(f"with {_RULES}, {_IN_TEXTS} select doc_id, family, arg_min(phrase, rule_id) as term from said join rules using (rule_id) where kind = 'context' and outer_ group by all")
def topic_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of each text: of each family the first context phrase, in the table's order, that stands outside of longer ones."""
    s = _found(spark, sf, "documents", "doc_id", ("context", "conflict")).join(F.broadcast(rules(spark, "context")), "rule_id")
    return s.groupBy(F.col("id").alias("doc_id"), "family").agg(F.min_by("phrase", "rule_id").alias("term"))


_BOOSTED = f"""{_HITS}, {_RULES}, {_IN_TEXTS}, {_ASKED}, {_occurrences_sql('meant', 'b', 'item_id', "'intent'")},
near as (select item_id, doc_id, hits from (select *, row_number() over (partition by item_id order by hits desc, doc_id) as k from hits) where k <= {MOST}),
af as (select distinct item_id, family from asked join rules using (rule_id) where outer_),
ai as (select item_id, family, sum(points) as intent from (select distinct item_id, rule_id from meant) join rules using (rule_id) group by all),
sd as (select distinct doc_id, rule_id from said where outer_),
pf as (select n.item_id, n.doc_id, af.family, r.cap_up, r.cap_down, coalesce(ai.intent, 0) as intent,
    sum(r.points) filter (where r.kind = 'context') as context, sum(r.points) filter (where r.kind = 'conflict' and not contains(b.plain, r.phrase)) as conflict
  from near n join af using (item_id) join sd using (doc_id) join rules r on r.rule_id = sd.rule_id and r.family = af.family join b using (item_id) left join ai on ai.item_id = n.item_id and ai.family = af.family group by all),
ff as (select item_id, doc_id, family, least(cap_up, coalesce(context + intent, 0))::bigint as up, least(cap_down, coalesce(conflict, 0))::bigint as down from pf),
c as (select n.item_id, n.doc_id, n.hits, coalesce(sum(up - down), 0)::bigint as focus, coalesce(list(family || ' +' || up || ' -' || down order by family) filter (where family is not null and (up > 0 or down > 0)), []) as families
  from near n left join ff using (item_id, doc_id) group by all)"""


def boosted(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with points of each family that their question asks for: context and intent up to the family's cap, less conflict that the question itself doesn't
    name, up to its own. Texts are matched once, whatever the number of questions that want them."""
    near = R.top(token_hits(spark, sf), ["item_id"], [F.desc("hits"), F.asc("doc_id")], MOST, "k").select("item_id", "doc_id", "hits")
    asked = _found(spark, sf, "benchmark", "item_id", ("ask",)).join(F.broadcast(rules(spark, "ask")), "rule_id").select(F.col("id").alias("item_id"), "family").distinct()
    meant = _found(spark, sf, "benchmark", "item_id", ("intent",), False).select("id", "rule_id").distinct().join(F.broadcast(rules(spark, "intent")), "rule_id")
    asked = asked.join(meant.groupBy(F.col("id").alias("item_id"), "family").agg(F.sum("points").alias("intent")), ["item_id", "family"], "left")
    plain = table(spark, sf, "benchmark").select("item_id", X.normalise(F.col("text")).alias("plain"))
    said = _found(spark, sf, "documents", "doc_id", ("context", "conflict")).select(F.col("id").alias("doc_id"), "rule_id").distinct()
    met = near.join(said, "doc_id").join(F.broadcast(rules(spark, "context", "conflict")), "rule_id").join(asked, ["item_id", "family"]).join(R.small(plain), "item_id")
    sum_of = lambda cond: F.sum(F.when(cond, F.col("points")))
    f = met.groupBy("item_id", "doc_id", "family", "cap_up", "cap_down", "intent").agg(
        sum_of(F.col("kind") == "context").alias("context"), sum_of((F.col("kind") == "conflict") & ~F.contains("plain", "phrase")).alias("conflict")
    )
    up = F.least("cap_up", F.coalesce(F.col("context") + F.coalesce("intent", F.lit(0)), F.lit(0)))
    f = f.select("item_id", "doc_id", "family", up.cast("long").alias("up"), F.least("cap_down", F.coalesce("conflict", F.lit(0))).cast("long").alias("down"))
    shown = F.array_sort(F.collect_list(F.when((F.col("up") > 0) | (F.col("down") > 0), F.concat("family", F.lit(" +"), "up", F.lit(" -"), "down"))))
    f = f.groupBy("item_id", "doc_id").agg(F.sum(F.col("up") - F.col("down")).alias("focus"), shown.alias("families"))
    none = F.array().cast("array<string>")
    return near.join(f, ["item_id", "doc_id"], "left").select("item_id", "doc_id", "hits", F.coalesce("focus", F.lit(0)).cast("long").alias("focus"), F.coalesce("families", none).alias("families"))


@query(f"with {_BOOSTED} select item_id, doc_id, focus, families from c")
def topic_boosts(spark: SparkSession, sf: str) -> DataFrame:
    return boosted(spark, sf).drop("hits")


@query(f"with {_BOOSTED}, r as (select *, row_number() over (partition by item_id order by focus desc, hits desc, doc_id) as place from c) select item_id, doc_id, place from r where place <= 10")
def focus_resort(spark: SparkSession, sf: str) -> DataFrame:
    """Sources ordered by their focus, then by their score."""
    return R.top(boosted(spark, sf), ["item_id"], [F.desc("focus"), F.desc("hits"), F.asc("doc_id")], 10, "place").select("item_id", "doc_id", "place")


@query(
    f"""with {_RULES}, {_IN_TEXTS}, s as (select doc_id, phrase, bool_or(outer_) as alone from said join said_rules using (rule_id) group by all)
select s.doc_id, s.phrase, list(l.phrase order by l.phrase) as instead from s join s l on l.doc_id = s.doc_id and length(l.phrase) > length(s.phrase) and contains(l.phrase, s.phrase) where not s.alone group by all"""
)
def exclusive_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases that a text holds only within longer ones of another meaning, and these: asked for the short one, the text isn't about it."""
    phrases = F.broadcast(rules(spark, "context", "conflict").select("rule_id", "phrase"))
    here = lambda longest: _found(spark, sf, "documents", "doc_id", ("context", "conflict"), longest).join(phrases, "rule_id").select(F.col("id").alias("doc_id"), "phrase").distinct()
    every = here(False)
    hidden = every.join(here(True), ["doc_id", "phrase"], "left_anti")
    longer = every.select("doc_id", F.col("phrase").alias("long"))
    met = hidden.join(longer, "doc_id").where((F.length("long") > F.length("phrase")) & F.contains("long", "phrase"))
    return met.groupBy("doc_id", "phrase").agg(F.array_sort(F.collect_list("long")).alias("instead"))

"""Classifying questions and planning what is searched for them: intents, targets, profiles, plans and gates.

Rules are data: lists of patterns for Columns, and small tables that are joined. Questions are the benchmark's items and the user
turns of conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..sources.readers import table
from .base import query
from .search import _HITS, token_hits
from .selection import _METRICS, _metrics

# Thai words and patterns that tell the kinds of questions, whole and in order.
THAI_SECTION = r"มาตรา\s*\d+|มาตรา|วรรค|อนุมาตรา|ข้อ\s*\d+"
THAI_LEGAL = r"นายทะเบียน|อำนาจหน้าที่|บทลงโทษ|โทษ|เพิกถอน|ถอนชื่อออกจากทะเบียน|อุทธรณ์|ร้องทุกข์|คำสั่ง|ระเบียบ|ข้อบังคับ|กฎกระทรวง|ประกาศ|พระราชบัญญัติ|พ\.ศ\."
THAI_OVERVIEW = r"ความรู้ทั่วไป|ความรู้เกี่ยวกับ|ทั่วไปเกี่ยวกับ|เกี่ยวกับสหกรณ์|เบื้องต้น|ภาพรวม|สรุป|นิยาม|ความหมาย|หมายถึง|คืออะไร|สหกรณ์คืออะไร|ประโยชน์|ข้อดี|ดีอย่างไร|ช่วยอะไร"
THAI_DOCUMENT = r"กฎกระทรวง|ประกาศ|หนังสือเวียน|ข้อหารือ|หนังสือสั่งการ|หนังสือกรม|เอกสาร|ฉบับ"
THAI_AMOUNT = r"ค่าบำรุง|สันนิบาต|อัตรา|ร้อยละ|เปอร์เซ็นต์|%|จำนวนเงิน|ต้องจ่าย|ชำระ|จ่าย"
THAI_RULING = r"แนววินิจฉัย|วินิจฉัย|ตีความ|ข้อหารือ|ถามตอบ|คำถามคำตอบ"
THAI_SHORT = r"คืออะไร|หมายถึง|เท่าไร|เท่าไหร่|กี่บาท|กี่เปอร์เซ็นต์|กี่ร้อยละ|เมื่อไร|เมื่อไหร่|ต้อง|ควร|ได้ไหม|ได้หรือไม่"
THAI_CURRENT = r"วันนี้|ตอนนี้|ล่าสุด|ปัจจุบัน|ข่าว|new|update|ประกาศใหม่|เว็บไซต์|ลิงก์|link|ออนไลน์|internet|web|google|facebook|line|โทร|เบอร์|ที่อยู่|map|แผนที่|ภายนอก|external"
#: The same with English words (own lists), and further own patterns.
SECTION, LEGAL, OVERVIEW = THAI_SECTION + r"|section\s*\d+|article\s*\d+", THAI_LEGAL + "|registrar|penalty", THAI_OVERVIEW + "|overview"
RULING, PAPER, SHORT = THAI_RULING + "|ruling", THAI_DOCUMENT + "|" + THAI_AMOUNT + r"|\brate\b|\bamount\b", THAI_SHORT + "|what is|how many|when"
CURRENT = THAI_CURRENT + "|today"
EXPLAIN = r"อธิบาย|ขยายความ|explain|\bwhy\b"
CLARIFY = r"^(?:แล้ว|แล้วล่ะ|กรณีนี้|เรื่องนี้|อันนี้|มาตราไหน|ข้อไหน|วรรคไหน|ยังไง|อย่างไร|and|so|this)(?: |$)"
GROUP, COOP = r"กลุ่มเกษตรกร|farmer group", r"สหกรณ์|cooperative"
SHORT_SIGNS, PROFILE_SHORT, PROFILE_LOW = 60, 28, 48
#: Least top score, set score and answerability for each intent; what is searched for it, in order, and how much of it.
PROFILES = {"law_section": (90, 110, 60), "explain": (80, 110, 55), "qa": (78, 105, 52), "document": (78, 105, 52), "short_answer": (80, 110, 50), "general": (85, 120, 50)}
ROUTES = {
    "law_section": [("src0", 4), ("src1", 3), ("src2", 2)], "explain": [("src1", 4), ("src0", 3), ("src3", 2)], "qa": [("src2", 5), ("src1", 2)],
    "document": [("src3", 5), ("src2", 2), ("src0", 1)], "short_answer": [("src2", 2), ("src0", 2)], "general": [("src1", 3), ("src2", 3), ("src3", 2), ("src0", 1)],
}
#: Sources left when a plan is free, and the share of a route's limit that a plan takes.
PLANS = {"free": (2, 0.5), "standard": (3, 1.0), "pro": (4, 1.5)}
# Other names of plans.
ALIASES = {"basic": "free", "trial": "free", "plus": "standard", "monthly": "standard", "premium": "pro", "business": "pro"}


def intent(c: Column) -> Column:
    """The first kind that fits: section, legal cue (unless an overview is asked for), explanation, ruling, paper or amount, short answer, else general."""
    has = lambda p: F.rlike(c, F.lit(p))
    return (
        F.when(has(SECTION), "law_section").when(has(LEGAL) & ~has(OVERVIEW), "law_section").when(has(EXPLAIN), "explain").when(has(RULING), "qa")
        .when(has(PAPER), "document").when((F.length(c) <= SHORT_SIGNS) & has(SHORT), "short_answer").otherwise("general")
    )


_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}%]+', ' ', 'g'))"


def norm(c: Column) -> Column:
    """As the search form, with percent signs kept."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}%]+", " "))


def _intent_sql(t: str) -> str:
    has = lambda p: f"regexp_matches({t}, '{p}')"
    return (
        f"case when {has(SECTION)} or {has(LEGAL)} and not {has(OVERVIEW)} then 'law_section' when {has(EXPLAIN)} then 'explain' when {has(RULING)} then 'qa' "
        f"when {has(PAPER)} then 'document' when length({t}) <= {SHORT_SIGNS} and {has(SHORT)} then 'short_answer' else 'general' end"
    )


def _values(rows, names: str) -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else "true" if v is True else "false" if v is False else f"{v}::double" if isinstance(v, float) else str(v)
    return "(values " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") as {names}"


_ROUTE_ROWS = [(k, s, p, n) for k, own in ROUTES.items() for p, (s, n) in enumerate(own, 1)]
_PLAN_ROWS = [(k, n, share) for k, (n, share) in PLANS.items()]
_PROFILE_ROWS = [(k, *v) for k, v in PROFILES.items()]

_TURNS = f"turns as (select conv_id, turn, text, {_NORM.format('text')} as t from conversations where role = 'user'), asked as (select *, {_intent_sql('t')} as intent from turns)"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with their normalised text and intent."""
    c = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text", norm(F.col("text")).alias("t"))
    return c.withColumn("intent", intent(F.col("t")))


@query(f"with {_TURNS} select conv_id, turn, intent from asked union all select -1, item_id, {_intent_sql(_NORM.format('text'))} from benchmark")
def question_intent(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select(F.lit(-1).cast("long").alias("conv_id"), F.col("item_id").alias("turn"), intent(norm(F.col("text"))).alias("intent"))
    return asked(spark, sf).select("conv_id", "turn", "intent").unionByName(b)


@query(
    f"""with {_TURNS}, w as (select conv_id, turn, target, regexp_matches(t, '{GROUP}') as g, regexp_matches(t, '{COOP}') as c from turns, {_values([('all',), ('coop',), ('group',)], 'x(target)')})
select conv_id, turn, target, case when g and not c then 'group' when c and not g then 'coop' when target = 'group' then 'group' else 'coop' end as resolved from w"""
)
def search_target(spark: SparkSession, sf: str) -> DataFrame:
    """A text that names one family of laws only overrides the target; an open target means cooperatives."""
    g, c = F.rlike("t", F.lit(GROUP)), F.rlike("t", F.lit(COOP))
    out = F.when(g & ~c, "group").when(c & ~g, "coop").when(F.col("target") == "group", "group").otherwise("coop")
    w = asked(spark, sf).withColumn("target", F.explode(F.array(*[F.lit(x) for x in ("all", "coop", "group")])))
    return w.select("conv_id", "turn", "target", out.alias("resolved"))


@query(
    f"""with q as (select item_id, {_intent_sql(_NORM.format('text'))} as intent from benchmark),
r as (select * from {_values(_ROUTE_ROWS, 'r(intent, source, priority, most)')}), p as (select * from {_values(_PLAN_ROWS, 'p(plan, sources, share)')})
select item_id, plan, source, priority, greatest(1, floor(most * share + 0.5))::bigint as quota from q join r using (intent), p where priority <= sources"""
)
def routing_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Sources in order with their quotas, for each question and plan: the intent's route, cut to what the plan has."""
    q = table(spark, sf, "benchmark").select("item_id", intent(norm(F.col("text"))).alias("intent"))
    r = F.broadcast(spark.createDataFrame(_ROUTE_ROWS, "intent string, source string, priority int, most int"))
    p = F.broadcast(spark.createDataFrame(_PLAN_ROWS, "plan string, sources int, share double"))
    return q.join(r, "intent").join(p, F.col("priority") <= F.col("sources")).select("item_id", "plan", "source", "priority", F.greatest(F.lit(1), X.half_up(F.col("most") * F.col("share"))).alias("quota"))


@query(
    f"""with {_TURNS}, p as (select * from {_values(_PROFILE_ROWS, 'p(intent, least_top, least_set, least_answer)')})
select conv_id, turn, intent, length(t) between 1 and {PROFILE_SHORT} as short_query, length(t) between 1 and {PROFILE_LOW} and not regexp_matches(t, '{SECTION}|{COOP}|{GROUP}') as low_context,
  regexp_matches(t, '{CLARIFY}') as clarify, regexp_matches(t, '{CURRENT}') as external, intent = 'short_answer' or length(t) <= {SHORT_SIGNS} and regexp_matches(t, '{SHORT}') as simple,
  least_top, least_set, least_answer + case when regexp_matches(t, '{CURRENT}') then 2 else 0 end as least_answer from asked join p using (intent)"""
)
def message_profile(spark: SparkSession, sf: str) -> DataFrame:
    """What a message looks like, and the thresholds of its intent."""
    has = lambda p: F.rlike("t", F.lit(p))
    n = F.length("t")
    p = F.broadcast(spark.createDataFrame(_PROFILE_ROWS, "intent string, least_top int, least_set int, least_answer int"))
    return asked(spark, sf).join(p, "intent").select(
        "conv_id", "turn", "intent", n.between(1, PROFILE_SHORT).alias("short_query"), (n.between(1, PROFILE_LOW) & ~has(f"{SECTION}|{COOP}|{GROUP}")).alias("low_context"),
        has(CLARIFY).alias("clarify"), has(CURRENT).alias("external"), ((F.col("intent") == "short_answer") | ((n <= SHORT_SIGNS) & has(SHORT))).alias("simple"),
        "least_top", "least_set", (F.col("least_answer") + F.when(has(CURRENT), 2).otherwise(0)).alias("least_answer"),
    )


_LOW = """case intent when 'law_section' then top < 90 when 'short_answer' then top < 80 and set_score < 110
  else top < 85 or n < 2 and top < 105 or set_score < 120 or second < 35 end"""
_GATES = f"""{_METRICS}, plain as (select item_id, {_NORM.format('text')} as t from benchmark), kinds as (select *, {_intent_sql('t')} as intent, regexp_matches(t, '{CURRENT}') as external, length(t) <= {SHORT_SIGNS} as brief from plain),
weak as (select item_id, intent, external, brief, coalesce(n, 0) as n, coalesce(top, 0) as top, coalesce(confidence, 0) as confidence, n is null or {_LOW} as low from kinds left join c using (item_id))"""


def gates(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with their metrics and whether the evidence is weak for their intent."""
    b = table(spark, sf, "benchmark").select("item_id", norm(F.col("text")).alias("t")).select("item_id", intent(F.col("t")).alias("intent"), F.rlike("t", F.lit(CURRENT)).alias("external"), (F.length("t") <= SHORT_SIGNS).alias("brief"))
    j = b.join(_metrics(spark, sf), "item_id", "left")
    top, total, n, second = (F.col(c) for c in ("top", "set_score", "n", "second"))
    weak = F.when(F.col("intent") == "law_section", top < 90).when(F.col("intent") == "short_answer", (top < 80) & (total < 110)).otherwise((top < 85) | ((n < 2) & (top < 105)) | (total < 120) | (second < 35))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("item_id", "intent", "external", "brief", zero("n"), zero("top"), zero("confidence"), (n.isNull() | weak).alias("low"))


@query(f"with {_GATES} select item_id, intent, low from weak")
def low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return gates(spark, sf).select("item_id", "intent", "low")


_OFFERS = [("free", False, False, "none"), ("standard", True, True, "assist"), ("pro", True, False, "full")]


@query(
    f"""with {_GATES}, p as (select * from {_values(_OFFERS, 'p(plan, ai, economy, web)')})
select item_id, plan, ai and (not economy or external or not (confidence >= 18 and intent <> 'explain' or brief and confidence >= 12) and (n < 2 or intent = 'explain' or confidence < 12)) as use_ai,
  web <> 'none' and (external or intent not in ('law_section', 'document', 'short_answer') and (low or web = 'full' and intent = 'general' and top < 78)) as use_web from weak, p"""
)
def plan_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a plan writes an answer by AI and searches the web for a question: economical plans don't where the evidence is strong
    (confidence 18, or 12 for a brief question)."""
    p = F.broadcast(spark.createDataFrame(_OFFERS, "plan string, ai boolean, economy boolean, web string"))
    c, explain = F.col("confidence"), F.col("intent") == "explain"
    enough = ((c >= 18) & ~explain) | (F.col("brief") & (c >= 12))
    ai = F.col("ai") & (~F.col("economy") | F.col("external") | (~enough & ((F.col("n") < 2) | explain | (c < 12))))
    web = (F.col("web") != "none") & (F.col("external") | (~F.col("intent").isin("law_section", "document", "short_answer") & (F.col("low") | ((F.col("web") == "full") & (F.col("intent") == "general") & (F.col("top") < 78)))))
    return gates(spark, sf).crossJoin(p).select("item_id", "plan", ai.alias("use_ai"), web.alias("use_web"))


_HINTS = "list_filter(regexp_extract_all(t, '([\\p{L}\\p{M}\\p{N}%]+)', 1), lambda w: length(w) >= 6)"


@query(
    f"""with turns as (select conv_id, turn, {_NORM.format('text')} as t from conversations where role = 'user'),
h as (select conv_id, turn, t, list_filter({_HINTS}, lambda w, i: list_position({_HINTS}, w) = i)[1:4] as hints from turns),
p as (select *, lag(hints) over (partition by conv_id order by turn) as before from h)
select conv_id, turn, hints, before is not null and len(hints) >= 2 and len(list_intersect(hints, before)) = 0 as new_topic,
  before is not null and (length(t) <= {PROFILE_SHORT} or regexp_matches(t, '{CLARIFY}')) and not regexp_matches(t, '{SECTION}') as ambiguous,
  case when before is not null and len(hints) < 2 then array_to_string(before, ' ') || ' ' || t else t end as rewritten from p"""
)
def follow_up_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Topic hints of each user turn (its first long words), whether it begins a new topic or is ambiguous, and the turn with
    the last topic put before it where it has too few hints of its own."""
    t = asked(spark, sf).select("conv_id", "turn", "t")
    h = t.withColumn("hints", F.slice(F.array_distinct(F.filter(F.regexp_extract_all("t", F.lit(r"([\p{L}\p{M}\p{N}%]+)"), 1), lambda w: F.length(w) >= 6)), 1, 4))
    p = h.withColumn("before", F.lag("hints").over(Window.partitionBy("conv_id").orderBy("turn")))
    later, few = F.col("before").isNotNull(), F.size("hints") < 2
    return p.select(
        "conv_id", "turn", "hints", (later & ~few & ~F.arrays_overlap("hints", F.coalesce("before", F.array().cast("array<string>")))).alias("new_topic"),
        (later & ((F.length("t") <= PROFILE_SHORT) | F.rlike("t", F.lit(CLARIFY))) & ~F.rlike("t", F.lit(SECTION))).alias("ambiguous"),
        F.when(later & few, F.concat(F.array_join("before", " "), F.lit(" "), F.col("t"))).otherwise(F.col("t")).alias("rewritten"),
    )


_CANDIDATES = f"""{_HITS.replace("hits as (select item_id", "direct as (select item_id")},
k as (select item_id, 'original' as kind, unnest(terms) as term from q union all select item_id, 'focused', unnest(list_filter(terms, lambda t: length(t) >= 6)) from q
  union all select item_id, 'head', unnest(terms[1:4]) from q union all select item_id, 'tail', unnest(terms[-4:]) from q),
g as (select item_id, kind, doc_id, 8 * count(*) as score from k join dt using (term) group by all),
o as (select *, row_number() over (partition by item_id, kind order by score desc, doc_id) as place from g),
s as (select item_id, kind, max(case when place = 1 then score end) as top, max(case when place = 1 then score end) + 0.35::double * coalesce(max(case when place = 2 then score end), 0) as total from o where place <= 2 group by 1, 2)"""


def plan_scores(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, kind, top, total of up to four forms of each question: as it is, its long terms, its first and its last four."""
    from .search import questions

    q = questions(spark, sf)
    forms = F.array(
        F.struct(F.lit("original").alias("kind"), F.col("terms").alias("terms")), F.struct(F.lit("focused").alias("kind"), F.filter("terms", lambda t: F.length(t) >= 6).alias("terms")),
        F.struct(F.lit("head").alias("kind"), F.slice("terms", 1, 4).alias("terms")), F.struct(F.lit("tail").alias("kind"), F.when(F.size("terms") >= 4, F.slice("terms", -4, 4)).otherwise(F.col("terms")).alias("terms")),
    )
    k = q.select("item_id", F.inline(forms)).select("item_id", "kind", F.explode("terms").alias("term"))
    dt = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    g = dt.join(R.small(k), "term").groupBy("item_id", "kind", "doc_id").agg((8 * F.count(F.lit(1))).alias("score"))
    o = R.top(g, ["item_id", "kind"], [F.desc("score"), F.asc("doc_id")], 2, "place")
    at = lambda p: F.max(F.when(F.col("place") == p, F.col("score")))
    return o.groupBy("item_id", "kind").agg(at(1).alias("top"), (at(1) + F.lit(0.35) * F.coalesce(at(2), F.lit(0))).alias("total"))


@query(f"with {_CANDIDATES} select item_id, kind, top, round(total, 4) as total from s")
def query_plan_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return plan_scores(spark, sf).select("item_id", "kind", "top", F.round("total", 4).alias("total"))


@query(
    f"""with {_CANDIDATES}, r as (select *, row_number() over (partition by item_id order by top desc, total desc, kind) as place from s where kind <> 'original'),
b as (select q.item_id, o.top as top0, o.total as total0, r.kind, r.top, r.total from q left join (select * from s where kind = 'original') o using (item_id) left join (select * from r where place = 1) r using (item_id))
select item_id, case when kind is not null and (top0 is null or top >= top0 + 8 or total >= total0 * 1.12::double) then kind else 'original' end as chosen from b"""
)
def query_plan_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The best rewritten form, if it has 8 points more at the top or 1.12 of the set's score; else the question as it is."""
    s = plan_scores(spark, sf)
    o = s.where("kind = 'original'").select("item_id", F.col("top").alias("top0"), F.col("total").alias("total0"))
    r = R.top(s.where("kind != 'original'"), ["item_id"], [F.desc("top"), F.desc("total"), F.asc("kind")], 1, "place").select("item_id", "kind", "top", "total")
    b = table(spark, sf, "benchmark").select("item_id").join(o, "item_id", "left").join(r, "item_id", "left")
    better = F.col("kind").isNotNull() & (F.col("top0").isNull() | (F.col("top") >= F.col("top0") + 8) | (F.col("total") >= F.col("total0") * F.lit(1.12)))
    return b.select("item_id", F.when(better, F.col("kind")).otherwise("original").alias("chosen"))


@query(f"select c_custkey, coalesce(a.plan, case when lower(c_mktsegment) in ('free', 'standard', 'pro') then lower(c_mktsegment) end, 'free') as plan from customer left join {_values([('automobile', 'standard'), ('building', 'pro'), *ALIASES.items()], 'a(name, plan)')} on a.name = lower(trim(c_mktsegment))")
def plan_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Other names of plans by a map; what is unknown is free."""
    pairs = {"automobile": "standard", "building": "pro", **ALIASES}
    known = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    name = F.lower(F.trim("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(F.try_element_at(known, name), F.when(name.isin(*PLANS), name), F.lit("free")).alias("plan"))


@query(
    """with q as (select item_id, text, lower(text) as t from benchmark), s as (select a, b from (
  select x.item_id as a, y.item_id as b from q x join q y on x.item_id <> y.item_id and trim(regexp_replace(x.t, '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) = trim(regexp_replace(y.t, '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'))))
select item_id, exists(select 1 from s where a = item_id) as has_equal, regexp_matches(t, 'section\\s*\\d+|clause\\s*\\d+|มาตรา\\s*\\d+|ข้อ\\s*\\d+') as skip_stored from q"""
)
def stored_answer_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether another stored question is the same, and whether stored answers are skipped as the question names a section."""
    q = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("t"), X.normalise(F.col("text")).alias("n"))
    same = q.groupBy("n").agg(F.count(F.lit(1)).alias("same"))
    return q.join(same, "n").select("item_id", (F.col("same") > 1).alias("has_equal"), F.rlike("t", F.lit(r"section\s*\d+|clause\s*\d+|มาตรา\s*\d+|ข้อ\s*\d+")).alias("skip_stored"))

"""Lists, queues and counters as an application's pages ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import rules as W
from ..functions import text as X
from ..operators import paging as P
from ..operators import relational as R
from ..sources.readers import table
from .base import query

_THAI = "case month(o_orderdate) " + " ".join(f"when {k} then '{m}'" for k, m in enumerate(X.THAI_MONTHS, 1)) + " end"


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus = 'O' order by o_orderdate desc, o_orderkey desc limit 100")
def target_status_list(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of some targets in one state, newest first."""
    o = R.where_all(table(spark, sf, "orders"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderstatus") == "O")
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_orderpriority")


@query("select o_orderkey, o_orderstatus from orders where o_custkey = 769 order by o_orderkey")
def child_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one parent; no state is asked for here, so that filter isn't there."""
    return R.where_all(table(spark, sf, "orders"), F.col("o_custkey") == 769, None).orderBy("o_orderkey").select("o_orderkey", "o_orderstatus")


@query("select d.doc_id, d.source from documents d left join labels l using (doc_id) where l.quality is null and d.source = 'src1' order by d.doc_id limit 200")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """What waits for a review, of one kind, oldest first."""
    d = table(spark, sf, "documents").where("source = 'src1'").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.where("quality is null").orderBy("doc_id").limit(200).select("doc_id", "source")


@query("select p_partkey, p_size from part where p_type in ('ECONOMY', 'STANDARD', 'PROMO') order by case p_type when 'PROMO' then 0 when 'STANDARD' then 1 else 2 end, p_size, p_partkey limit 50")
def case_then_display_order(spark: SparkSession, sf: str) -> DataFrame:
    place = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2)
    return table(spark, sf, "part").where(F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO")).orderBy(place, "p_size", "p_partkey").limit(50).select("p_partkey", "p_size")


@query(
    """with s as (select o_orderkey, o_orderdate, 3 * contains(o_orderpriority, 'URGENT')::int + 2 * (o_orderstatus = 'F')::int + (o_totalprice > 200000)::int as score from orders where o_totalprice > 100000)
select o_orderkey, score, (rank() over (order by score desc))::int as rank from s order by score desc, o_orderdate desc, o_orderkey limit 80"""
)
def ranked_list(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows, the newer one first among equals, with their rank; the rank is that of the counts of higher scores, not a window over all rows."""
    score = W.points((F.contains("o_orderpriority", F.lit("URGENT")), 3), (F.col("o_orderstatus") == "F", 2), (F.col("o_totalprice") > 200000, 1))
    s = table(spark, sf, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_orderdate", score.alias("score"))
    n = s.groupBy("score").agg(F.count(F.lit(1)).alias("n"))  # as many rows as there are scores
    ranks = n.withColumn("rank", (F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int")).select("score", "rank")
    best = s.orderBy(F.desc("score"), F.desc("o_orderdate"), "o_orderkey").limit(80)
    return best.join(F.broadcast(ranks), "score").select("o_orderkey", "score", "rank")


@query("with i as (select 'user' as kind, user_id::varchar as id, user_id as n from events union all select 'device', (user_id % 7)::varchar, user_id from events) select kind, id, max(n) as n from i group by 1, 2")
def upsert_identities(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each identity that a request carries; repeated identities are one, and the larger count stays."""
    e = table(spark, sf, "events").select("user_id")
    ids = F.array(F.struct(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("id")), F.struct(F.lit("device").alias("kind"), (F.col("user_id") % 7).cast("string").alias("id")))
    rows = e.select(F.explode(F.array_distinct(ids)).alias("i"), F.col("user_id").alias("n")).select("i.*", "n")
    return R.upsert_max(rows, rows.limit(0), ["kind", "id"], "n")


@query(
    """with u as (select user_id, event_id, ts, ts + interval 3 day as expires from events where event_type = 'purchase'),
r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from u where expires > timestamp '2024-01-10 00:00:00') select user_id, event_id, rank from r where rank <= 5"""
)
def unexpired_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest rows of each user that haven't expired."""
    u = table(spark, sf, "events").where("event_type = 'purchase'").withColumn("expires", F.col("ts") + F.expr("interval 3 days"))
    u = R.unexpired(u, "expires", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return R.top(u, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "rank")


_QT = W.search_terms_sql("text")


@query(
    f"""with q as (select item_id, unnest({_QT}) as term from benchmark), n as (select item_id, count(*) as n from q group by 1),
d as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{M}}\\p{{N}}]+)', 1)) as term from documents join labels using (doc_id)),
h as (select item_id, doc_id, count(*) as hits from q join d using (term) group by 1, 2),
g as (select item_id, sum(case when quality = 1 then 1 else 0 end) as helpful, sum(case when toxic = 1 then 1 else 0 end) as bad from h join n using (item_id) join labels using (doc_id) where hits >= 0.3::double * n group by 1)
select item_id, helpful::bigint as helpful, bad::bigint as bad, least(6, greatest(0, 2 * (helpful - bad)))::bigint as boost from g"""
)
def feedback_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback on texts that share enough of a question's terms: net helpful votes, doubled and capped."""
    q = table(spark, sf, "benchmark").select("item_id", W.search_terms(F.col("text")).alias("terms")).select("item_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    l = table(spark, sf, "labels")  # noqa: E741
    d = table(spark, sf, "documents").join(l, "doc_id").select("doc_id", "quality", "toxic", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    h = d.join(R.small(q), "term").groupBy("item_id", "n", "doc_id", "quality", "toxic").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= F.lit(0.3) * F.col("n"))
    g = h.groupBy("item_id").agg(F.count_if(F.col("quality") == 1).alias("helpful"), F.count_if(F.col("toxic") == 1).alias("bad"))
    return g.select("item_id", "helpful", "bad", F.least(F.lit(6), F.greatest(F.lit(0), 2 * (F.col("helpful") - F.col("bad")))).alias("boost"))


@query("select lang, count(*) as n, count(*) filter (where (contains(lower(text), 'the ') or contains(lower(text), 'der ')) and contains(lower(text), 'an')) as found from documents group by lang")
def count_by_filter(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows of each language there are, and how many pass a filter of word groups."""
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(R.contains_cnf(F.lower("text"), [["the ", "der "], ["an"]])).alias("found"))


@query(
    "select user_id, clicks, views, purchases, errors, clicks * 700 + views * 300 + purchases * 1200 + errors * 50 as tokens from (select user_id, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where event_type = 'view') as views, count(*) filter (where event_type = 'purchase') as purchases, count(*) filter (where event_type = 'error') as errors from events group by 1)"
)
def usage_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Four counters of each user and the tokens that they stand for."""
    c = R.increment(table(spark, sf, "events"), [F.col("user_id")], **{f"{k}s": F.col("event_type") == k for k in ("click", "view", "purchase", "error")})
    return c.select("user_id", "clicks", "views", "purchases", "errors", (700 * F.col("clicks") + 300 * F.col("views") + 1200 * F.col("purchases") + 50 * F.col("errors")).alias("tokens"))


@query(
    """with k as (select doc_id, source, coalesce(nullif(md5(text), md5('')), 'id:' || doc_id) as identity from documents), r as (select *, row_number() over (partition by identity order by doc_id) as f from k),
p as (select *, row_number() over (partition by source order by doc_id) as place from r where f = 1) select source, doc_id, place from p where place <= 6"""
)
def distinct_by_identity(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each identity (its text, or its id where it has none), and of these six of each source."""
    key = F.when(F.col("text") == "", F.concat(F.lit("id:"), "doc_id")).otherwise(F.md5(F.col("text").cast("binary")))
    first = table(spark, sf, "documents").groupBy(key.alias("identity")).agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("r")).select("r.*")
    return R.top(first, ["source"], [F.asc("doc_id")], 6, "place").select("source", "doc_id", "place")


@query(f"select o_orderkey, day(o_orderdate) || ' ' || {_THAI} || ' พ.ศ. ' || (year(o_orderdate) + 543) as spoken, o_orderdate::date as dated from orders")
def thai_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written out in Thai with the year of the Buddhist era, and read back."""
    names = F.array(*[F.lit(m) for m in X.THAI_MONTHS])
    o = table(spark, sf, "orders")
    spoken = F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(" "), F.element_at(names, F.month("o_orderdate")), F.lit(" พ.ศ. "), (F.year("o_orderdate") + 543).cast("string"))
    return o.select("o_orderkey", spoken.alias("spoken")).withColumn("dated", X.thai_date(F.col("spoken")))


@query(r"select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^0-9a-zก-๙\s]+', ' ', 'g'), '\s+', ' ', 'g')) as plain from documents")
def plain_text(spark: SparkSession, sf: str) -> DataFrame:
    """Lower case, of digits, a to z, Thai and blanks only."""
    plain = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^0-9a-zก-๙\s]+", " "), r"\s+", " ")
    return table(spark, sf, "documents").select("doc_id", F.trim(plain).alias("plain"))


_PAGES = """with recursive c as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn) as k from conversations),
g as (select conv_id, turn, k, n, 1 as page, n as used, 1 as held from c where k = {start}
  union all select c.conv_id, c.turn, c.k, c.n, case when g.used + c.n > 1200 or g.held >= 4 then g.page + 1 else g.page end,
    case when g.used + c.n > 1200 or g.held >= 4 then c.n else g.used + c.n end, case when g.used + c.n > 1200 or g.held >= 4 then 1 else g.held + 1 end from g join c on c.conv_id = g.conv_id and c.k = g.k + 1)
select conv_id, turn, page::bigint as page from g"""


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    return P.numbered(table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n")), "conv_id", ["turn"])


@query(_PAGES.format(start=1))
def greedy_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages filled in order: a page ends where the next row would pass 1200 signs, or holds four rows."""
    return P.pages(_lengths(spark, sf), "conv_id", "n", 1200, 4).select("conv_id", "turn", "page")


@query(_PAGES.format(start=3))
def resumed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages behind signed cursors that stand at each conversation's third row; a cursor that was altered or has run out resumes nothing."""
    rows = _lengths(spark, sf)
    secret, now = b"of the tables", F.lit(1_700_000_000_000)
    state = F.struct(F.lit(1).alias("v"), F.lit("pages").alias("target"), (now + 3_600_000).alias("expires_ms"), "conv_id", "k")
    tokens = rows.where("k = 3").select(A.sign(state, secret).alias("token"))
    opened = tokens.select(A.verify(F.col("token"), secret, "v int, target string, expires_ms long, conv_id long, k long", F.lit("pages"), now).alias("s")).where("s is not null")
    return P.pages(rows, "conv_id", "n", 1200, 4, opened.select("s.conv_id", "s.k")).select("conv_id", "turn", "page")


_DIGITS = "[" + ", ".join(f"'{w}'" for w in X.THAI_DIGIT_WORDS) + "]"
_POWERS = "[" + ", ".join(f"'{w}'" for w in X.THAI_POWER_WORDS) + "]"


@query(
    f"""with d as (select c_custkey as n, c_custkey::varchar as d, length(c_custkey::varchar) as len from customer),
w as (select n, case when n = 0 then 'ศูนย์' else array_to_string(list_transform(range(1, len + 1), lambda i: case when substr(d, i, 1) = '0' then '' else
  case when len - i = 1 and substr(d, i, 1) = '1' then '' when len - i = 1 and substr(d, i, 1) = '2' then 'ยี่' when i = len and substr(d, i, 1) = '1' and len > 1 then 'เอ็ด' else ({_DIGITS})[substr(d, i, 1)::int + 1] end
  || ({_POWERS})[(len - i + 1)::int] end), '') end as words from d)
select n, words, n as parsed, 'no. ' || n || ' of' as replaced from w"""
)
def thai_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in Thai words, read back alone and within a text."""
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("n"), X.thai_number_text(F.col("c_custkey")).alias("words"))
    return n.select("n", "words", A.thai_number_words("words").alias("parsed"), A.number_words_replaced(F.concat(F.lit("no. "), "words", F.lit(" of"))).alias("replaced"))

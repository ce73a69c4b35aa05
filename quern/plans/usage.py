"""Usage, log and feedback analytics on events, orders, customers and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.similarity import frequent_terms
from ..sources.readers import table
from .base import query

def N():
    return F.count(F.lit(1))



@query("select count(*) as n, count(*) filter (where lang = 'en') as n_en from documents")
def count_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(N().alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"))


@query("select coalesce(sum(case when o_orderstatus = 'F' then 1 else 0 end), 0)::bigint as done, coalesce(sum(case when o_orderstatus = 'O' then 1 else 0 end), 0)::bigint as open, coalesce(sum(case when o_orderstatus = 'P' then o_totalprice else 0 end), 0)::double as pending_amount from orders")
def conditional_sums(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda c, v: F.coalesce(F.sum(F.when(c, v).otherwise(0)), F.lit(0))
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").agg(one(s == "F", 1).alias("done"), one(s == "O", 1).alias("open"), one(s == "P", F.col("o_totalprice")).cast("double").alias("pending_amount"))


@query("with u as (select user_id, count(*) as n from events group by 1) select count(*) as users, count(*) filter (where n >= 105) as blocked, coalesce(max(n), 0) as most from u")
def threshold_stats(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "events").groupBy("user_id").agg(N().alias("n"))
    return u.agg(N().alias("users"), F.count_if(F.col("n") >= 105).alias("blocked"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


@query("select case when event_type in ('click', 'view') then event_type else 'other' end as bucket, count(*) as n, count(*) filter (where ts::date = date '2024-01-03') as today from events group by 1")
def grouped_buckets(spark: SparkSession, sf: str) -> DataFrame:
    b = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other")
    return table(spark, sf, "events").groupBy(b.alias("bucket")).agg(N().alias("n"), F.count_if(F.to_date("ts") == F.lit("2024-01-03").cast("date")).alias("today"))


@query("select user_id, count(*) as n, arg_max(event_type, (ts, event_id)) as last_type, max(ts) as last_ts from events group by user_id")
def latest_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(N().alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts"))


_K = "json_extract(props, '$.k')::bigint"


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf, "events").withColumn("k", k)
    return e.groupBy("user_id").agg(
        N().alias("n"), F.count_if(F.col("event_type") == "click").alias("used"), F.count_if(F.col("k") <= 12).alias("weak"),
        F.min("k").alias("low"), F.max("k").alias("high"), F.round(F.avg("k"), 4).alias("mean"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"),
    )


_REVIEW = f"""select user_id, count(*) as n, count(*) filter (where event_type = 'click') as used, count(*) filter (where {_K} <= 12) as weak,
  min({_K}) as low, max({_K}) as high, round(avg({_K}), 4) as mean, array_to_string(list_sort(list(distinct event_type)), ',') as kinds from events group by user_id"""


@query(_REVIEW)
def log_review(spark: SparkSession, sf: str) -> DataFrame:
    return _reviewed(spark, sf)


@query(f"with r as ({_REVIEW}) select user_id, n, weak, low from r where n >= 2 and weak > 0 order by weak desc, n desc, low asc nulls last, user_id limit 40")
def faq_candidates(spark: SparkSession, sf: str) -> DataFrame:
    r = _reviewed(spark, sf).where("n >= 2 and weak > 0")
    return r.orderBy(F.desc("weak"), F.desc("n"), F.asc_nulls_last("low"), "user_id").limit(40).select("user_id", "n", "weak", "low")


@query(
    r"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{M}\p{N}]+)', 1)) as term from documents),
c as (select doc_id, term, count(*) as n from t where length(term) >= 4 group by 1, 2),
r as (select *, row_number() over (partition by doc_id order by n desc, length(term) desc, term) as rank from c)
select doc_id, term, n, rank from r where rank <= 8"""
)
def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    long = F.filter(X.tokens(F.col("text")), lambda t: F.length(t) >= 4)
    return frequent_terms(table(spark, sf, "documents").select("doc_id", long.alias("terms")), 8).withColumnRenamed("id", "doc_id")


@query("select d.source, count(*) as n, count(*) filter (where quality = 1) as helpful, count(*) filter (where toxic = 1) as bad, least(6, greatest(0, 2 * (count(*) filter (where quality = 1) - count(*) filter (where toxic = 1)))) as boost from labels l join documents d using (doc_id) group by 1")
def net_helpful(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    h, b = F.count_if(F.col("quality") == 1), F.count_if(F.col("toxic") == 1)
    return j.groupBy("source").agg(N().alias("n"), h.alias("helpful"), b.alias("bad"), F.least(F.lit(6), F.greatest(F.lit(0), 2 * (h - b))).alias("boost"))


@query("with c as (select user_id, event_type, count(*) as n from events group by 1, 2) select user_id, max(n) as used, max(n) >= 25 as blocked from c group by 1")
def guest_quota(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(N().alias("n"))
    return c.groupBy("user_id").agg(F.max("n").alias("used"), (F.max("n") >= 25).alias("blocked"))


@query("with c as (select user_id, count(*) filter (where event_type = 'click') as calls from events group by 1) select user_id, calls, calls * 700 as tokens_in, calls * 250 as tokens_out, round(calls * 1.65::double / 1000, 6) as usd, round(calls * 1.65::double / 1000 * 32.69::double, 4) as thb from c")
def cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """1.65 USD for 1000 calls of 700 tokens in and 250 out; the rates are parameters of the caller in production."""
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("calls"))
    usd = F.col("calls") * F.lit(1.65) / 1000
    return c.select("user_id", "calls", (F.col("calls") * 700).alias("tokens_in"), (F.col("calls") * 250).alias("tokens_out"), F.round(usd, 6).alias("usd"), F.round(usd * 32.69, 4).alias("thb"))


_PLAN = "case when user_id % 3 = 0 then 'free' when user_id % 3 = 1 then 'standard' else 'premium' end"


@query(
    f"""with u as (select user_id, {_PLAN} as plan, count(*) as used, count(*) filter (where event_type = 'purchase') as approved from events group by 1, 2),
b as (select *, case plan when 'free' then 50 when 'standard' then 200 else 400 end as lim, case when plan = 'free' then approved else 0 end as bonus from u)
select user_id, plan, used, bonus, greatest(0, lim + bonus - used) as remaining, case when used >= lim + bonus then 'exhausted' when used * 10 >= (lim + bonus) * 8 then 'near' else 'ok' end as advice from b"""
)
def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    plan = F.when(F.col("user_id") % 3 == 0, "free").when(F.col("user_id") % 3 == 1, "standard").otherwise("premium")
    u = table(spark, sf, "events").groupBy("user_id", plan.alias("plan")).agg(N().alias("used"), F.count_if(F.col("event_type") == "purchase").alias("approved"))
    limit = F.when(F.col("plan") == "free", 50).when(F.col("plan") == "standard", 200).otherwise(400)
    bonus = F.when(F.col("plan") == "free", F.col("approved")).otherwise(0)
    all_, used = limit + F.col("bonus"), F.col("used")
    return u.withColumn("bonus", bonus).select("user_id", "plan", "used", "bonus", F.greatest(F.lit(0), all_ - used).alias("remaining"), F.when(used >= all_, "exhausted").when(used * 10 >= all_ * 8, "near").otherwise("ok").alias("advice"))


@query("select event_id, substr(sha256(user_id::varchar), 1, 4) || '...' || right(sha256(user_id::varchar), 4) as masked, strftime(ts, '%Y-%m') as month from events")
def masked_identity(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", X.mask(F.sha2(F.col("user_id").cast("string"), 256)).alias("masked"), F.date_format("ts", "yyyy-MM").alias("month"))


@query("with m as (select user_id, max(ts) as last from events group by 1) select user_id, case when last > timestamp '2024-01-14 00:00:00' then last + interval 30 day else timestamp '2024-01-14 00:00:00' + interval 30 day end as valid_until from m")
def plan_validity(spark: SparkSession, sf: str) -> DataFrame:
    """A plan still valid at as_of is extended from its end, else from as_of."""
    as_of = F.lit("2024-01-14 00:00:00").cast("timestamp_ntz")
    m = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return m.select("user_id", (F.greatest("last", as_of) + F.expr("interval 30 days")).alias("valid_until"))

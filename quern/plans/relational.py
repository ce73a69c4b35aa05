"""Lookups, lists, joins and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..sources.readers import table
from .base import query


@query("select d.doc_id, d.source, d.n_chars, l.quality from documents d left join labels l using (doc_id) where d.doc_id = 17 and (l.toxic is null or l.toxic = 0)")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.where("doc_id = 17").join(l.where("doc_id = 17"), "doc_id", "left").where("toxic is null or toxic = 0").select("doc_id", "source", "n_chars", "quality")


@query("select doc_id, n_chars from documents where source = 'src0' and doc_id > 100 order by doc_id limit 50")
def keyset_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("source = 'src0' and doc_id > 100").select("doc_id", "n_chars").orderBy("doc_id").limit(50)


@query("select d.doc_id from documents d left join labels l using (doc_id) where l.quality is null order by d.doc_id limit 500")
def pending_rows(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    return d.join(l, "doc_id", "left").where("quality is null").select("doc_id").orderBy("doc_id").limit(500)


@query(r"select doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) as clean_text from documents")
def clean_text_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """One derived-column pass instead of a batched read-modify-write loop."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.normalise(F.col("text")).alias("clean_text"))


@query("select count(*) as processed, count(*) filter (where n_chars > 200) as updated, count(*) filter (where n_chars <= 200) as skipped from documents")
def backfill_counters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("n_chars") > 200).alias("updated"), F.count_if(F.col("n_chars") <= 200).alias("skipped"))


@query("select o_orderkey, o_orderdate::varchar as day from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey desc limit 25 offset 50")
def status_list_paged(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'")
    p = R.page(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, 25)
    return p.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")) if dict(o.dtypes)["o_orderdate"] == "date" else p.select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"))


@query("select c_custkey, c_name from customer where contains(lower(c_name), '12') or contains(lower(c_mktsegment), 'auto') order by c_custkey limit 100")
def admin_search_list(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    hit = F.contains(F.lower("c_name"), F.lit("12")) | F.contains(F.lower("c_mktsegment"), F.lit("auto"))
    return c.where(hit).select("c_custkey", "c_name").orderBy("c_custkey").limit(100)


@query("select user_id, strftime(ts, '%Y-%m') as month, count(*) as n from events where event_type = 'click' and user_id >= 10 group by all")
def usage_list_filtered(spark: SparkSession, sf: str) -> DataFrame:
    e = R.where_all(table(spark, sf, "events"), F.col("event_type") == "click", None, F.col("user_id") >= 10)
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_totalprice from orders where o_custkey = 7 order by o_orderkey desc limit 20")
def user_payments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_custkey = 7").orderBy(F.desc("o_orderkey")).limit(20).select("o_orderkey", "o_totalprice")


@query("select d.doc_id, d.lang, l.quality from documents d left join labels l using (doc_id) where l.doc_id is null or l.quality = 1")
def left_join_searchable(spark: SparkSession, sf: str) -> DataFrame:
    """The filter on the nullable side stands after the join, so rows without a match stay."""
    d, l = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(R.small(l), "doc_id", "left").where("quality is null or quality = 1")


@query("select o_orderkey, c_name, o_totalprice from orders left join customer on o_custkey = c_custkey order by o_orderkey desc limit 50 offset 100")
def left_join_paged(spark: SparkSession, sf: str) -> DataFrame:
    """The page is cut before the join: an outer join on a unique key keeps the rows."""
    o = R.page(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_orderkey")], 3, 50)
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "c_name", "o_totalprice")


@query("select o_orderpriority, count(*) as n, sum(o_totalprice)::double as amount from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_name = 'FRANCE' or n_nationkey < 3 group by 1")
def payments_by_plan(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").where("n_name = 'FRANCE' or n_nationkey < 3").select("n_nationkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(R.small(n), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").cast("double").alias("amount"))


@query("select source, md5(text) as h, min(doc_id) as doc_id from documents d where not exists (select 1 from labels l join documents x using (doc_id) where x.source = d.source and md5(x.text) = md5(d.text)) group by source, md5(text)")
def anti_join_new_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose natural key isn't among the labelled ones, first of each key."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    have = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return R.new_rows(d, have, ["source", "h"], [F.asc("doc_id")]).select("source", "h", "doc_id")


@query("select doc_id, source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)")
def semi_join_pending(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")


#: Fixed rule pack: (rule, trigger, blocker, additions).
RULES = [("r1", "that", "idiot", "which these"), ("r2", "der", None, "den dem"), ("r3", "que", "para", "cual"), ("r4", "les", None, "des")]
_RULES = "(values ('r1','that','idiot','which these'),('r2','der',null,'den dem'),('r3','que','para','cual'),('r4','les',null,'des')) as r(rule, trigger, blocker, additions)"


@query(f"select item_id, rule, unnest(string_split(additions, ' ')) as term from benchmark join {_RULES} on contains(lower(text), trigger) and not coalesce(contains(lower(text), blocker), false)")
def expand_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Questions against a rule table: any trigger in, no blocker in. The rule table is a constant of a few rows."""
    rules = spark.createDataFrame(RULES, "rule string, trigger string, blocker string, additions string")
    q = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("t"))
    j = q.join(F.broadcast(rules), F.contains("t", "trigger") & ~F.coalesce(F.contains("t", "blocker"), F.lit(False)))
    return j.select("item_id", "rule", F.explode(F.split("additions", " ")).alias("term"))


@query(f"select item_id, arg_min(rule, rule) as family from benchmark join {_RULES} on contains(lower(text), trigger) group by item_id")
def first_match_family(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([r[:2] for r in RULES], "rule string, trigger string")
    q = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("t"))
    return q.join(F.broadcast(rules), F.contains("t", "trigger")).groupBy("item_id").agg(F.min_by("rule", "rule").alias("family"))


@query("select user_id, month, max(n) as n from (select user_id, strftime(ts, '%Y-%m') as month, count(*) as n from events group by all union all select user_id, strftime(ts, '%Y-%m'), count(*) from events where event_type = 'click' group by all) group by all")
def monotone_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    key = ["user_id", "month"]
    n = lambda df: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return R.upsert_max(n(e), n(e.where("event_type = 'click'")), key, "n")


@query("select user_id, strftime(ts, '%Y-%m') as usage_month, count(*) filter (where event_type = 'click') as question_count, count(*) filter (where event_type = 'view') as preview_count, count(*) filter (where event_type = 'purchase') as premium_count from events group by all")
def monthly_usage(spark: SparkSession, sf: str) -> DataFrame:
    is_ = lambda k: F.col("event_type") == k
    return R.increment(table(spark, sf, "events"), ["user_id", F.date_format("ts", "yyyy-MM").alias("usage_month")], question_count=is_("click"), preview_count=is_("view"), premium_count=is_("purchase"))


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value, arg_min(event_type, (ts, event_id)) as first_type from events group by user_id")
def last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    key = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", key).alias("event_type"), F.max_by("value", key).alias("value"), F.min_by("event_type", key).alias("first_type"))


@query("select o_orderkey, case when o_orderstatus = 'P' then 'approved' else o_orderstatus end as status from orders")
def compare_and_set(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "approved").otherwise(F.col("o_orderstatus")).alias("status"))


@query("select user_id, case when user_id = 8 then 0 else count(*) end as n from events group by user_id")
def reset_counter(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    return n.select("user_id", F.when(F.col("user_id") == 8, F.lit(0)).otherwise(F.col("c")).alias("n"))


@query("select event_id from events where not coalesce(event_type = 'error' and value < 50, false)")
def filtered_delete(spark: SparkSession, sf: str) -> DataFrame:
    return R.delete_where(table(spark, sf, "events"), (F.col("event_type") == "error") & (F.col("value") < 50)).select("event_id")


@query("select event_id from events where ts + interval 2 day > timestamp '2024-01-15 00:00:00'")
def ttl_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("expires_at", F.col("ts") + F.expr("interval 2 days"))
    return R.unexpired(e, "expires_at", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("select event_type, sum(coalesce(nullif(regexp_extract(props, '(\\d+)', 1), ''), '0')::bigint)::bigint as total from events group by 1")
def text_counter(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers held as text: an empty one counts as 0."""
    v = F.coalesce(F.nullif(F.regexp_extract("props", r"(\d+)", 1), F.lit("")), F.lit("0")).cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(v).alias("total"))


@query("select user_id, max(ts + case when user_id % 3 = 0 then interval 0 day when user_id % 3 = 1 then interval 15 day else interval 30 day end) as expires_at from events group by 1")
def history_expiry(spark: SparkSession, sf: str) -> DataFrame:
    days = F.when(F.col("user_id") % 3 == 0, 0).when(F.col("user_id") % 3 == 1, 15).otherwise(30)
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(F.col("ts") + F.make_dt_interval(days)).alias("expires_at"))

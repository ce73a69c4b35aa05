"""The streaming operators run over the events table, as a stream and in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.readers import table
from ..streaming import state as S
from ..streaming import usage as U
from .base import query


def _tail(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of the folder as a stream, be it a file or a folder of files."""
    flat = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    file = flat.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(flat).isFile()
    reader = spark.readStream.schema(table(spark, sf, name).schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf) if file else reader.parquet(f"{sf}/{name}.parquet")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return _tail(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select ts::date as day, event_type, count(*) as n from events group by all")
def daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    return U.daily_counts(table(spark, sf, "events"))


_KEPT = """with recursive k as (
  select user_id, event_type, min((ts, event_id)) as m from events group by 1, 2
  union all
  select k.user_id, k.event_type, min((e.ts, e.event_id)) from k join events e on e.user_id = k.user_id and e.event_type = k.event_type and e.ts >= k.m[1] + interval 10 minute group by 1, 2, k.m
) select user_id, event_type, m[2] as event_id from k"""


@query(_KEPT)
def throttle_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user and type that come ten minutes or more after the last one let through."""
    e = table(spark, sf, "events").select("ts", "event_id", "user_id", "event_type")
    return U.throttle(e, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query(_KEPT)
def stream_throttle(spark: SparkSession, sf: str) -> DataFrame:
    """The same rule with the last time as a stream's state."""
    e = _stream(spark, sf).select("ts", "event_id", "user_id", "event_type")
    return U.run_once(U.throttle(e, ["user_id", "event_type"], ["event_id"])).select("user_id", "event_type", "event_id")


@query("select ts::date as day, event_type, count(*) as n from events group by all")
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts through Structured Streaming, drained once in complete mode."""
    return U.run_once(U.daily_counts(_stream(spark, sf)), "complete")


#: Entries of a user's cache, and hours that an answer lives by its kind (the events of the tables are hours apart).
CAP, HOURS = 3, {"click": 5, "view": 10, "purchase": 30}
OTHERS = 15
_LIFE = f"case event_type {' '.join(f"when '{k}' then {h}" for k, h in HOURS.items())} else {OTHERS} end * 3600000"
_CACHED = f"""with e as (select user_id, {{'id': event_id, 'ms': epoch_ms(ts), 'key': event_type, 'life': {_LIFE}}} as e, ts, event_id from events),
l as (select user_id, list({{'held': []::struct(k varchar, ms bigint)[], 'out': []::struct(id bigint, hit boolean, gone varchar[])[], 'e': e}} order by ts, event_id) as l from e group by user_id),
f as (select user_id, list_reduce(list_prepend({{'held': []::struct(k varchar, ms bigint)[], 'out': []::struct(id bigint, hit boolean, gone varchar[])[], 'e': null}}, l), lambda a, x:
  case when len(list_filter(a.held, lambda h: h.k = x.e.key and x.e.ms <= h.ms + x.e.life)) > 0
  then {{'held': a.held, 'out': list_append(a.out, {{'id': x.e.id, 'hit': true, 'gone': []::varchar[]}}), 'e': x.e}}
  else {{'held': list_append(list_filter(a.held, lambda h: h.k <> x.e.key), {{'k': x.e.key, 'ms': x.e.ms}})[greatest(1, len(list_filter(a.held, lambda h: h.k <> x.e.key)) + 2 - {CAP}):],
    'out': list_append(a.out, {{'id': x.e.id, 'hit': false, 'gone': list_transform(list_filter(a.held, lambda h: h.k <> x.e.key)[1:greatest(0, len(list_filter(a.held, lambda h: h.k <> x.e.key)) + 1 - {CAP})], lambda h: h.k)}}), 'e': x.e}} end).out as out from l)
select user_id as cache, o.id as event_id, o.hit as hit, o.gone as evicted from (select user_id, unnest(out) as o from f)"""


def _reads(e: DataFrame) -> DataFrame:
    hours = F.lit(OTHERS)
    for kind, h in HOURS.items():
        hours = F.when(F.col("event_type") == kind, h).otherwise(hours)
    return e.select(F.col("user_id").alias("cache"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), (hours * 3_600_000).cast("long").alias("lifetime_ms"))


@query(_CACHED)
def cache_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of each user's answer cache: a hit leaves the entry's time alone, a miss stores anew and pushes out the oldest entry beyond the cap."""
    return S.cache_reads(_reads(table(spark, sf, "events")), CAP)


@query(_CACHED)
def stream_cache_reads(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the entries as a stream's map state, swept by a timer."""
    with S.state_store(spark):
        return U.run_once(S.cache_reads(_reads(_stream(spark, sf)), CAP))


@query(
    """with e as (select user_id, date_trunc('millisecond', ts) as ts, event_id from events),
g as (select user_id, ts, case when ts - lag(ts) over w < interval 15 minute then 0 else 1 end as fresh, event_id from e window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id) as k from g),
x as (select user_id, k, min(ts) as started, max(ts) + interval 15 minute as expires, count(*) as n from s group by user_id, k),
y as (select *, make_timestamp(((epoch_ms(expires) + 899999) // 900000 * 900000 * 1000)::bigint) as swept, lead(k) over (partition by user_id order by k) as later from x)
select user_id, started, expires, swept, n from y where later is not null or swept <= (select max(ts) from e) - interval 1 minute"""
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions swept every 15 minutes by an event-time timer; those that the watermark hasn't passed are still open."""
    with S.state_store(spark):
        return U.run_once(S.swept_sessions(_stream(spark, sf).select("user_id", "ts")))


_TOPIC = "case when contains(lower(text), 'that') then 'that' when contains(lower(text), 'der ') then 'der' when contains(lower(text), 'que') then 'que' end"
_CARRIED = f"""with t as (select conv_id, turn, role, {_TOPIC} as topic, row_number() over (partition by conv_id order by turn) as k from conversations)
select t.conv_id, t.turn, arg_max(p.topic, p.k) as topic from t left join t p on p.conv_id = t.conv_id and p.k between t.k - 8 and t.k - 1 and p.role = t.role and p.topic is not null group by t.conv_id, t.turn"""


def _turns(c: DataFrame) -> DataFrame:
    topic = X.first_match(F.lower("text"), [("that", "that"), ("der", "der "), ("que", "que")])
    return c.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").alias("target"), topic.alias("topic"))


@query(_CARRIED)
def last_turn_topic(spark: SparkSession, sf: str) -> DataFrame:
    """The last topic of the same target (here the role) among the eight entries before a turn."""
    return S.carried_topics(_turns(table(spark, sf, "conversations")))


@query(_CARRIED)
def stream_last_turn_topic(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the entries as a stream's list state."""
    with S.state_store(spark):
        return U.run_once(S.carried_topics(_turns(_tail(spark, sf, "conversations"))))

"""Filters, joins, upserts, de-duplication and ranking over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast only if Spark's estimate of it is at most this; else the planner chooses.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size allows one."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= limit else df


def adapt(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The named columns with their types; those that df lacks are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Conditions joined by and; None stands for a filter that isn't set."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def contains_cnf(c: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Every group must have a string that c contains."""
    one = lambda g: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in g])
    return reduce(lambda a, b: a & b, [one(g) for g in groups])


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group. Spark keeps n rows a group before the shuffle (window group limit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def distinct_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return top(df, key, order, 1, "_first").drop("_first")


def new_rows(df: DataFrame, existing: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows whose key doesn't exist yet, the first of each key."""
    return distinct_first(df.join(existing.select(*key).distinct(), list(key), "left_anti"), key, order)


def upsert_max(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Monotone upsert: the larger value stays."""
    return old.select(*key, value).unionByName(new.select(*key, value)).groupBy(*key).agg(F.max(value).alias(value))


def upsert_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins: the row with the largest order columns."""
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, "_last.*")


def increment(df: DataFrame, key: Sequence[Column], **counts: Column) -> DataFrame:
    """Counters from an event log: for each name the number of rows on which its condition holds."""
    return df.groupBy(*key).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def delete_where(df: DataFrame, condition: Column | None) -> DataFrame:
    """What stays; an empty filter is refused, and rows on which it is null stay."""
    if condition is None:
        raise ValueError("a delete needs a filter")
    return df.where(~F.coalesce(condition, F.lit(False)))


def unexpired(df: DataFrame, expires: str, as_of: Column) -> DataFrame:
    return df.where(F.col(expires).isNull() | (F.col(expires) > as_of))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(max(number - 1, 0) * size).limit(size)


def quotas(df: DataFrame, query: str, source: str, order: Sequence[Column], quota: dict[str, int], total: int) -> DataFrame:
    """At most quota[source] rows of each source by order, then at most `total` rows of a query."""
    limit = F.coalesce(*[F.when(F.col(source) == s, F.lit(n)) for s, n in quota.items()], F.lit(0))
    most = max(quota.values(), default=0)  # a literal limit lets Spark drop rows before the shuffle
    per = top(df.where(limit > 0), [query, source], order, most, "source_rank").where(F.col("source_rank") <= limit)
    return per.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("place") <= total)


def keep_or_all(df: DataFrame, query: str, passes: Column) -> DataFrame:
    """Rows that pass; all rows of a query of which none does."""
    some = df.groupBy(query).agg(F.max(passes).alias("_some"))  # a row for each query, combined before the shuffle
    return df.join(small(some), query).where(passes | ~F.coalesce("_some", F.lit(False))).drop("_some")


def running_page(df: DataFrame, by: Sequence[str], order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """A page number from the running sum of sizes: a page begins where the sum crosses a multiple of budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(size).over(w) - size
    return df.withColumn("page", (F.floor(before / budget) + 1).cast("int"))

"""Row numbers and pages within groups of any size, spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def numbered(rows: DataFrame, by: str, order: list[str], number: str = "k") -> DataFrame:
    """rows with their place (from 1) in their group. Rows are dealt by ranges and numbered within each range; a window only sees one row for each range
    that a group reaches into."""
    dealt = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    dealt = written(dealt.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "ranges")
    ranges = dealt.groupBy("_p", F.col(by).alias("_by")).agg(F.min("_i").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    met = dealt.join(ranges.withColumnRenamed("_p", "_q"), (F.col("_p") == F.col("_q")) & F.col(by).eqNullSafe(F.col("_by")))
    return met.withColumn(number, F.col("_i") - F.col("_lo") + F.col("_before") + 1).select(*rows.columns, number)


def pages(rows: DataFrame, by: str, size: str, budget: int, most: int, starts: DataFrame | None = None, k: str = "k") -> DataFrame:
    """Numbered rows -> rows with `page`: a page ends where the next row would pass the budget, or holds `most` rows. `starts` (by, k) says where each group's
    first page begins, by default at its first row; rows before it go.

    Each row knows where a page that begins with it would end, from the `most` rows behind it. Following that from the starts
    doubles its reach with each round (a jump of 2**r pages is two of 2**(r-1)), so a group of n pages takes log2(n) rounds of joins on (group, row),
    and no task ever holds a group."""
    own = rows.select(F.col(by).alias("g"), F.col(k).alias("k"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"))
    ahead = own.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    ahead = ahead.select("g", (F.col("k") - F.col("d")).alias("k"), "d", "n").where("k > 0")
    run = F.transform(F.array_sort(F.collect_list(F.struct("d", "n"))), lambda x: x["n"])
    # rows that fit behind the first one, in order, until one doesn't
    fold = F.aggregate("run", F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("rows"), F.lit(False).alias("full")), lambda a, n: F.when(
        a["full"] | ((a["rows"] > 0) & (a["used"] + n > budget)), F.struct(a["used"].alias("used"), a["rows"].alias("rows"), F.lit(True).alias("full"))
    ).otherwise(F.struct((a["used"] + n).alias("used"), (a["rows"] + 1).alias("rows"), F.lit(False).alias("full"))))
    reach = written(ahead.groupBy("g", "k").agg(run.alias("run")).select("g", "k", (F.col("k") + fold["rows"]).alias("to")), "reach")
    first = starts.select(F.col(by).alias("g"), F.col(k).cast("long").alias("k")) if starts is not None else reach.where("k = 1").select("g", "k")
    found = written(first.join(reach.select("g", "k"), ["g", "k"], "left_semi").withColumn("page", F.lit(1).cast("long")), "starts")
    jump, step = reach, 1
    while True:
        more = found.join(jump, ["g", "k"]).select("g", F.col("to").alias("k"), (F.col("page") + step).alias("page"))
        more = written(more.join(reach.select("g", "k"), ["g", "k"], "left_semi"), "starts")
        if more.isEmpty():
            break
        found, step = found.union(more), step * 2
        jump = written(jump.join(jump.toDF("g", "to", "further"), ["g", "to"]).select("g", "k", F.col("further").alias("to")), "jumps")
    ends = found.join(reach, ["g", "k"]).select("g", F.explode(F.sequence("k", F.col("to") - 1)).alias("k"), "page")
    return rows.join(ends.toDF(by, k, "page"), [by, k])

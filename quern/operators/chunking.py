"""One text to many rows: markers, fixed sizes, packing of sentences, and order-dependent folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What begins a section of its own.
MARKERS = [r"(?:section|article|clause|มาตรา|ข้อ)\s*\d+", r"(?:q|question|ถาม)\s*[:.]", r"(?:step|ขั้นตอนที่)\s*\d+", r"\d+[.)]\s"]


def fixed(df: DataFrame, text: str, size: int) -> DataFrame:
    """Pieces of `size` signs: adds part (from 0) and chunk."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(F.col(text), i * size + 1, F.lit(size)))
    return df.select("*", F.posexplode(parts).alias("part", "chunk"))


def pieces(c: Column, pattern: str) -> Column:
    """Trimmed, non-empty pieces between matches of the pattern."""
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def sections(c: Column) -> Column:
    """Pieces that begin at a line with a marker."""
    return pieces(c, r"(?im)(?=^\s*(?:" + "|".join(MARKERS) + "))")


def section_type(c: Column) -> Column:
    low = F.lower(c)
    names = ["legal_section", "faq", "process", "numbered"]
    out = F.when(F.rlike(low, F.lit(r"^\s*" + MARKERS[0])), F.lit(names[0]))
    for name, m in zip(names[1:], MARKERS[1:]):
        out = out.when(F.rlike(low, F.lit(r"^\s*" + m)), F.lit(name))
    return out.otherwise(F.lit("text"))


def sentences(c: Column) -> Column:
    return pieces(c, r"(?<=[.!?;:])\s+|\n+")


def _fold(items: Column, joins) -> Column:
    """Items joined to the one before them where joins(length of the last one, the item's length) holds. The fold sees lengths alone and keeps where each
    joined item begins; texts are cut and joined once, at the end."""

    def step(acc: Column, x: Column) -> Column:
        own = acc["last"].isNotNull() & joins(acc["last"], x["n"])
        starts = F.when(own, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(x["i"])))
        return F.struct(starts.alias("starts"), F.when(own, acc["last"] + 1 + x["n"]).otherwise(x["n"]).alias("last"))

    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(None).cast("int").alias("last"))
    # both arrays stand in one struct, so that the fold is done once and its result used for each item
    both = F.transform(F.array(F.struct(items.alias("items"))), lambda b: F.struct(
        b["items"].alias("items"), F.aggregate(F.transform(b["items"], lambda x, i: F.struct(F.length(x).alias("n"), i.cast("int").alias("i"))), start, step, lambda acc: acc["starts"]).alias("starts")
    ))
    joined = F.transform(both, lambda b: F.transform(b["starts"], lambda s, k: F.array_join(F.slice(b["items"], s + 1, F.coalesce(F.get(b["starts"], k + 1), F.size(b["items"])) - s), " ")))
    return F.get(joined, F.lit(0))


def pack(items: Column, most: int) -> Column:
    """Greedy: an item joins the last pack if that stays within `most` signs, else begins one."""
    return _fold(items, lambda last, n: last + n + 1 <= most)


def merge_small(items: Column, least: int, most: int) -> Column:
    """An item joins the one before it if one of both is shorter than `least` and both stay within `most`."""
    return _fold(items, lambda last, n: ((n < least) | (last < least)) & (last + n < most))


def distinct_lines(items: Column, least: int = 14, share: float = 0.8) -> Column:
    """Greedy: a line goes if a kept one contains it or is contained (from `least` signs), or shares `share` of
    the shorter one's tokens."""
    words = lambda x: F.array_distinct(F.split(F.lower(x), r"\s+"))

    def alike(a: Column, b: Column) -> Column:
        inside = (F.least(F.length(a), F.length(b)) >= least) & (F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a)))
        both = F.size(F.array_intersect(words(a), words(b)))
        return inside | (F.lower(a) == F.lower(b)) | (both >= share * F.least(F.size(words(a)), F.size(words(b))))

    return F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda k: alike(k, x)), acc).otherwise(F.concat(acc, F.array(x))))

"""Garbage filters and extraction quality as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import flags, tokens


def share(c: Column, pattern: str) -> Column:
    """Matches of the pattern for each sign of c; 0 for an empty text."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(pattern)) / F.length(c)).otherwise(F.lit(0.0))


def is_garbage(c: Column) -> Column:
    """Short, a bare address, only digits, mostly signs, or one sign repeated."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (
        (F.length(t) < 20)
        | F.rlike(t, F.lit(r"^https?://\S+$"))
        | F.rlike(t, F.lit(r"^[\d\s.,/-]+$"))
        | (share(t, r"[^\p{L}\p{M}\p{N}\s]") > 0.5)
        | F.rlike(t, F.lit(r"^(.)\1{7,}$"))
    )


def measures(c: Column) -> list[Column]:
    """The counts that notes need, to be taken once in a projection below."""
    words = tokens(c)
    count = lambda p: F.regexp_count(c, F.lit(p))
    return [
        F.length(c).alias("n"), (F.length(F.trim(c)) == 0).alias("blank"), F.size(words).alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct"),
        count(r"[^\p{L}\p{M}\p{N}\s]").alias("signs"), count(r"\p{N}").alias("digits"), count("�").alias("glyphs"), count(r"\p{Lu}").alias("capitals"),
    ]


def notes() -> Column:
    """What is wrong with an extracted text, from its measures."""
    n, words = F.col("n"), F.col("n_words")
    over = lambda name, limit: F.when(n > 0, F.col(name) / n > limit).otherwise(F.lit(False))
    return flags(
        ("empty", F.col("blank")), ("short", n < 80), ("few_words", words < 12), ("signs", over("signs", 0.15)), ("digits", over("digits", 0.3)), ("glyphs", F.col("glyphs") > 0),
        ("repeats", F.when(words > 0, F.col("n_distinct") / words < 0.3).otherwise(F.lit(False))), ("shouting", over("capitals", 0.4)),
    )


#: What each note costs.
COST = {"empty": 100, "short": 20, "few_words": 15, "signs": 25, "digits": 15, "glyphs": 20, "repeats": 20, "shouting": 10}


def score(found: Column) -> Column:
    """100 less the cost of each note, at least 0."""
    cost = F.create_map(*[F.lit(x) for kv in COST.items() for x in kv])
    return F.greatest(F.lit(0), F.lit(100) - F.aggregate(found, F.lit(0), lambda s, k: s + F.element_at(cost, k)))


def band(c: Column, accepted: int = 60, low: int = 45) -> Column:
    return F.when(c >= accepted, F.lit("accepted")).when(c >= low, F.lit("low")).otherwise(F.lit("rejected"))

"""Column functions over texts, tokens and numbers; all built in, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters, marks and digits of any script.
WORD = r"([\p{L}\p{M}\p{N}]+)"


def normalise(c: Column) -> Column:
    """Lower case; everything but letters, marks and digits becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 1)


def terms(c: Column, least: int = 4, most: int = 12) -> Column:
    """The first `most` distinct tokens of at least `least` letters."""
    return F.slice(F.filter(F.array_distinct(tokens(c)), lambda t: F.length(t) >= least), 1, most)


def bigrams(items: Column) -> Column:
    """Neighbouring items joined by a blank; none for fewer than two."""
    n = F.size(items)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.get(items, i - 1), F.lit(" "), F.get(items, i)))).otherwise(F.array().cast("array<string>"))


def char_bigrams(c: Column) -> Column:
    flat = F.regexp_replace(c, r"\s+", "")
    n = F.length(flat)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(flat, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _times(items: Column, x: Column) -> Column:
    return F.size(F.filter(items, lambda y: y == x))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two multisets: repeated items count as often as both have them."""
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(_times(a, x), _times(b, x)))
    n = F.size(a) + F.size(b)
    return F.when(n > 0, F.lit(2.0) * both / n).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def coverage(wanted: Column, there: Column) -> Column:
    n = F.size(F.array_distinct(wanted))
    return F.when(n > 0, F.size(F.array_intersect(wanted, there)) / n).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for other lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def shared_counts(rows: DataFrame, key: str, item: str) -> DataFrame:
    """a < b, na, nb, shared: how many items the multisets of two keys share, and their sizes. Items meet by an equi-join, each
    with its count."""
    n = rows.groupBy(key, item).agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy(key).agg(F.sum("n").alias("size"))
    left, right = n.select(F.col(key).alias("a"), item, F.col("n").alias("ia")), n.select(F.col(key).alias("b"), item, F.col("n").alias("ib"))
    both = left.join(right, item).where("a < b").groupBy("a", "b").agg(F.sum(F.least("ia", "ib")).alias("shared"))
    return both.join(size.select(F.col(key).alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col(key).alias("b"), F.col("size").alias("nb")), "b")


def any_contains(c: Column, words: Iterable[str]) -> Column:
    """Whether c contains any of the given strings."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def first_match(c: Column, rules: Iterable[tuple[str, str]], other: str | None = None) -> Column:
    """The name of the first (name, pattern) whose pattern c matches."""
    rules = list(rules)
    out = F.when(F.rlike(c, F.lit(rules[0][1])), F.lit(rules[0][0]))
    for name, pattern in rules[1:]:
        out = out.when(F.rlike(c, F.lit(pattern)), F.lit(name))
    return out.otherwise(F.lit(other))


def flags(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in named]))


def half_up(c: Column) -> Column:
    """Round halves towards plus infinity."""
    return F.floor(c + F.lit(0.5))


def scale_to(c: Column, low: float, high: float, top: float) -> Column:
    """Clamp to low..high and map to 0..top, rounded."""
    c = F.greatest(F.lit(low), F.least(F.lit(high), c.cast("double")))
    return half_up((c - low) / (high - low) * top)


# Decimal digits of Thai script and their ASCII counterparts, in order.
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
DIGITS = "0123456789"


def thai_digits_to_ascii(c: Column) -> Column:
    return F.translate(c, THAI_DIGITS, DIGITS)


def ascii_digits_to_thai(c: Column) -> Column:
    return F.translate(c, DIGITS, THAI_DIGITS)


# Thai month names, January to December.
THAI_MONTHS = "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม".split()


def thai_date(c: Column) -> Column:
    """day month year in Thai words -> date; years above 2400 are of the Buddhist era. Null if there is none."""
    c = thai_digits_to_ascii(c)
    pattern = r"(\d{1,2})\s+(" + "|".join(THAI_MONTHS) + r")\s+(?:พ\.ศ\.\s*)?(\d{4})"
    part = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    year = part(3).cast("int")
    month = F.array_position(F.array(*[F.lit(m) for m in THAI_MONTHS]), part(2)).cast("int")
    year = F.when(year > 2400, year - 543).otherwise(year)
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, part(1).cast("int"))).cast("date")


# Thai words of digits and of powers of ten, in order.
THAI_DIGIT_WORDS = "ศูนย์ หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด เก้า".split()
THAI_POWER_WORDS = ["", "สิบ", "ร้อย", "พัน", "หมื่น", "แสน"]


def thai_number_text(c: Column) -> Column:
    """A whole number below a million in Thai words: a two before ten and a last one have words of their own."""
    d = c.cast("string")
    n = F.length(d)
    words, powers = (F.array(*[F.lit(w) for w in own]) for own in (THAI_DIGIT_WORDS, THAI_POWER_WORDS))

    def word(i: Column) -> Column:
        digit, power = F.substr(d, i, F.lit(1)).cast("int"), n - i
        unit = F.when((power == 1) & (digit == 1), "").when((power == 1) & (digit == 2), "ยี่").when((power == 0) & (digit == 1) & (n > 1), "เอ็ด").otherwise(F.get(words, digit))
        return F.when(digit == 0, "").otherwise(F.concat(unit, F.get(powers, power)))

    return F.when(c == 0, THAI_DIGIT_WORDS[0]).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), n), word), ""))


def any_timestamp(c: Column) -> Column:
    """ISO time, else a Thai date, else a bare year, else null."""
    year = F.nullif(F.regexp_extract(thai_digits_to_ascii(c), r"^\s*(\d{4})\s*$", 1), F.lit("")).cast("int")
    year = F.when(year > 2400, year - 543).otherwise(year)
    iso = F.when(F.rlike(c, F.lit(r"^\s*\d{4}-\d{2}")), F.try_to_timestamp(c))
    return F.coalesce(iso, thai_date(c).cast("timestamp"), F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def reference_numbers(c: Column) -> Column:
    """Distinct numbers n or n/m after a word for clause, section or item; leading zeros are dropped."""
    found = F.regexp_extract_all(F.lower(thai_digits_to_ascii(c)), F.lit(r"(?:section|clause|article|item|มาตรา|ข้อ)\s*(\d+(?:/\d+)?)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"(^|/)0+(?=\d)", "$1")))


def truncate_words(c: Column, limit: int) -> Column:
    """At most `limit` signs, cut at a blank, with an ellipsis if anything went."""
    cut = F.regexp_replace(F.substring(c, 1, limit), r"\s+\S*\z", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("...")))


def question_key(target: Column, scope: Column, question: Column) -> Column:
    """Cache key: SHA-256 of target, scope and canonical question."""
    return F.sha2(F.concat_ws("::", target, scope, normalise(question)), 256)


def mask(c: Column, head: int = 4, tail: int = 4) -> Column:
    return F.when(F.length(c) <= head + tail, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit("..."), F.right(c, F.lit(tail))))

"""Rule packs: word lists as data, and Columns that apply them. First match wins in lists of (name, pattern)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD

# Words too common to be search terms (an own list for the languages of the tables).
GENERIC = (
    "the of and to in is that it for on was with as be are this from or by an at not but have has "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es "
    "de la que el en los del se las por un para con no una su al lo como "
    "le les des et est pour qui dans ce il au par sur pas plus"
).split()

#: Terms of a question at most, and letters of a term at least.
TERMS, LETTERS = 12, 2


def quoted(words) -> str:
    """Words as a list of SQL strings."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def search_terms(c: Column) -> Column:
    """The first TERMS distinct tokens of at least LETTERS letters that aren't generic, in order."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD), 1))
    kept = F.filter(words, lambda t: (F.length(t) >= LETTERS) & ~t.isin(*GENERIC))
    return F.slice(kept, 1, TERMS)


def search_words_sql(column: str) -> str:
    """All tokens that may be search terms, in DuckDB's SQL."""
    return rf"list_filter(regexp_extract_all(lower({column}), '([\p{{L}}\p{{M}}\p{{N}}]+)', 1), lambda t: length(t) >= {LETTERS} and t not in ({quoted(GENERIC)}))"


def first_distinct_sql(words: str, n: int = TERMS) -> str:
    """The first n distinct items of a list in order; DuckDB's list_distinct doesn't keep the order."""
    return f"list_filter({words}, lambda t, i: list_position({words}, t) = i)[1:{n}]"


def search_terms_sql(column: str) -> str:
    """The same as search_terms, for short texts."""
    return first_distinct_sql(search_words_sql(column))


def points(*rules: tuple[Column, float]) -> Column:
    """The sum of the points of the conditions that hold."""
    total = F.lit(0)
    for condition, n in rules:
        total = total + F.when(condition, n).otherwise(0)
    return total


# Phrases before which a Thai text is cut, with the signs by which each counts as nearer, in order.
THAI_BOUNDARIES = [
    ("ตามพระราชบัญญัติ", 100), ("ตามกฎหมาย", 95), ("ตามข้อบังคับ", 92), ("กำหนดให้มี", 90), ("มีอำนาจหน้าที่", 88), ("มีหน้าที่", 84), ("คณะกรรมการดำเนินการควร", 82),
    ("คณะกรรมการดำเนินการอาจ", 81), ("ผู้จัดการสหกรณ์", 80), ("ผู้จัดการควร", 79), ("และผู้จัดการอาจ", 78), ("เพื่อช่วยเหลือ", 77), ("เพื่อให้", 76), ("ตามความเหมาะสม", 75),
    ("จึงต้อง", 74), ("จึง", 68), ("แต่ทุกคน", 67), ("สมาชิกทุกคน", 66), ("โครงสร้างของสหกรณ์", 65), ("คณะกรรมการดำเนินการ", 62), ("ผู้จัดการอาจ", 60),
    ("เจ้าหน้าที่โดยความเห็นชอบ", 58), ("สมาชิกมีสิทธิ", 56), ("สมาชิกมีหน้าที่", 55), ("ประชาธิปไตย", 54),
]
# Thai words that tie a passage to the one before it, at its beginning and at that one's end.
THAI_BEGINS = "และ แต่ เพื่อ โดย ตาม จึง ซึ่ง ที่ ให้ แล้ว".split()
THAI_ENDS = "และ เพื่อ โดย ตาม จึง ซึ่ง ที่ ให้ แล้ว".split()

#: The same for the languages of the tables (own lists).
BOUNDARIES = [(" of the ", 55), (" in the ", 50), (" | ", 45), (" and ", 40), (" und ", 40), (" que ", 35), (" les ", 30), (" der ", 30), (" that ", 25)]
TIES = ["and", "that", "und", "der", "que", "les"]
#: What a passage is described by: the first pattern in its plain text that matches.
DESCRIPTORS = [(r"[0-9]{4}", "year"), (r"https?", "link"), ("ung ", "matter"), ("tion ", "action"), ("able ", "able"), ("[0-9]", "number")]

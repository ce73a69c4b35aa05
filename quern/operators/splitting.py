"""Passages of a text: paragraphs, sentences, spans between marker phrases, halves cut at the best boundary, small neighbours merged; a keyword for each."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import LIMIT, automaton, matches

_BLANKS = r"[ \t\x0B\f\u00A0\u2000-\u200A\u202F\u205F\u3000]"


def tidy_lines(c: Column) -> Column:
    """Line ends as \\n, no zero-width signs, blanks of each line collapsed and none at its ends, at most one empty line in a row."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), r"[\u200B-\u200D\uFEFF]", "")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, _BLANKS + "+", " "), " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return F.trim(c, F.lit(" \n"))


@dataclass(frozen=True)
class Rules:
    """Least, wanted and most signs of a passage; passages of a text at most (None: all); boundary phrases with the signs by which each
    counts as nearer; words that tie a passage to the one before it, where it begins with one or that one ends with one; (pattern, descriptor) in order; words that no keyword begins with."""

    markers: Sequence[tuple[str, int]]
    begins: Sequence[str] = ()
    ends: Sequence[str] = ()
    descriptors: Sequence[tuple[str, str]] = ()
    common: Sequence[str] = ()
    least: int = 80
    wanted: int = 220
    most: int = 350
    passages: int | None = None

    @property
    def gap(self) -> int:
        return max(20, self.least // 2)

    @property
    def small(self) -> int:
        return max(20, int(self.least * 0.6))


def plain(text: str) -> str:
    """Lower case; anything but letters, marks and digits is one blank."""
    return " ".join(_WORDS.findall(text.lower()))


try:
    import regex

    _WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
    _VISIBLE = regex.compile(r"[\p{L}\p{M}\p{N}]")
except ImportError:  # letters with combining marks are then cut at the marks
    _WORDS = re.compile(r"[^\W_]+")
    _VISIBLE = re.compile(r"[^\W_]")
_STOPS, _PARAGRAPHS = re.compile("(?<=[!?;:ฯ])[ \n]+"), re.compile("\n{2,}")
_LINK, _NUMBERS, _OPEN_END = re.compile("(?:https?://|www\\.)", re.I), re.compile(r"[0-9 \n.,\-/()]+"), re.compile("[,:;、，]$")


def garbage(text: str) -> bool:
    """Too little to read, a link, figures or signs only, more signs than letters, or one sign over and over."""
    letters = sum(map(str.isalnum, text))  # marks aside, so at least so many
    if letters >= 12 and 2 * (letters + text.count(" ") + text.count("\n")) >= len(text) and len(set(text)) > 5 and text[0] not in "hHwW" and not text[0].isdigit():
        return False
    flat = plain(text).replace(" ", "")
    if len(flat) < 12 or _LINK.match(text) or _NUMBERS.fullmatch(text) or flat == flat[0] * len(flat):
        return True
    signs = len(text) - len(_VISIBLE.findall(text)) - text.count(" ") - text.count("\n")
    return signs > 0.5 * len(text)


class Splitter:
    """Cuts texts by offsets; nothing is copied but the passages themselves."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.spots = automaton([m for m, _ in rules.markers])
        any_of = lambda words: "(?:" + "|".join(map(re.escape, words)) + ")" if words else "(?!)"
        self.begins = re.compile(any_of(rules.begins) + "(?:[ \n]|$)")
        self.ends = re.compile("(?:^|[ \n])" + any_of(rules.ends) + "$")

    def boundaries(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, marker) of each marker's occurrences, those of one marker not overlapping."""
        out, free = [], {}
        for s, e, k in matches(self.spots, text):
            if s >= free.get(k, 0):
                out.append((s, e, k))
                free[k] = e
        return out

    def spans(self, text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """The text between markers that are at least `gap` from the last cut and from the end."""
        gap, cuts = self.rules.gap, [0]
        for s in sorted({s for s, _, _ in found}):
            if s - cuts[-1] >= gap and len(text) - s >= gap and s:
                cuts.append(s)
        cuts.append(len(text))
        return list(zip(cuts[:-1], cuts[1:]))

    def cut(self, text: str, lo: int, hi: int, found: list[tuple[int, int, int]]) -> int | None:
        """Where to cut text[lo:hi]: the boundary nearest to the wanted length, a stronger one counting as nearer; else the nearest blank."""
        r = self.rules
        best = min(((abs(s - lo - r.wanted) - r.markers[k][1], k, s) for s, e, k in found if s >= lo + r.least and s <= hi - r.least and e <= hi), default=None)
        if best:
            return best[2]
        reach = max(24, (r.most - r.least) // 2)
        first, last = max(r.least, r.wanted - reach), min(hi - lo - r.least, r.wanted + reach)
        blanks = [p for p in range(first, last + 1) if text[lo + p] in " \n"]
        return lo + min(blanks, key=lambda p: (abs(p - r.wanted), p)) if blanks else None

    def halves(self, text: str, lo: int, hi: int, found: list[tuple[int, int, int]]) -> Iterator[str]:
        """text[lo:hi] cut in two until no part is too long or a part has no boundary; a stack holds what is still to be cut."""
        stack = [(lo, hi)]
        while stack:
            lo, hi = stack.pop()
            while lo < hi and text[lo] in " \n":
                lo += 1
            while lo < hi and text[hi - 1] in " \n":
                hi -= 1
            at = self.cut(text, lo, hi, found) if hi - lo > self.rules.most else None
            if at is None or not text[lo:at].strip(" \n") or not text[at:hi].strip(" \n"):
                if lo < hi:
                    yield text[lo:hi]
            else:
                stack += [(at, hi), (lo, at)]

    def tied(self, last: str, text: str) -> bool:
        if len(last) + len(text) > self.rules.most:
            return False
        if min(len(last), len(text)) <= self.rules.small or _OPEN_END.search(last):
            return True
        return bool(self.begins.match(text) or self.ends.search(last))

    def passages(self, text: str) -> list[str]:
        pieces: list[str] = []
        for paragraph in _PARAGRAPHS.split(text):
            for piece in _STOPS.split(paragraph):
                piece = piece.strip(" \n")
                if len(piece) <= self.rules.most:
                    pieces.append(piece)
                    continue
                found = self.boundaries(piece)
                for lo, hi in self.spans(piece, found):
                    pieces += self.halves(piece, lo, hi, found)
        out: list[str] = []
        for piece in pieces:
            if not piece or garbage(piece):
                continue
            if out and self.tied(out[-1], piece):
                out[-1] += " " + piece
            else:
                out.append(piece)
        return out[: self.rules.passages]  # passages of pieces that aren't garbage aren't either


class Keywords:
    """A passage's keyword: the anchor that fits best and a descriptor, else its first words. An anchor within the passage beats one of which only some words
    are there; longer ones beat shorter ones, then the order of the anchors decides."""

    def __init__(self, anchors: Sequence[str], rules: Rules, words: int = 6, most: int = 255):
        self.rules, self.words, self.most = rules, words, most
        self.anchors = [a for a in anchors if a]
        self.whole = automaton(list(dict.fromkeys(self.anchors)))
        self.order = list(dict.fromkeys(self.anchors))
        self.by_word: dict[str, list[int]] = {}
        for k, a in enumerate(self.order):
            for w in dict.fromkeys(a.split(" ")):
                self.by_word.setdefault(w, []).append(k)
        self.described = [(re.compile(p), d) for p, d in rules.descriptors]
        self.common = frozenset(rules.common)

    def anchor(self, text: str) -> str:
        found = {k for _, _, k in matches(self.whole, text)}
        if found:
            return self.order[min(found, key=lambda k: (-len(self.order[k]), k))]
        some: dict[int, int] = {}
        for w in set(text.split(" ")):
            for k in self.by_word.get(w, ()):
                some[k] = some.get(k, 0) + 1
        score = lambda k: 100 * some[k] / len(set(self.order[k].split(" "))) + len(self.order[k])
        return self.order[min(some, key=lambda k: (-score(k), k))] if some else ""

    def __call__(self, passage: str) -> str:
        text = plain(passage)
        descriptor = next((d for p, d in self.described if p.search(text)), "")
        out = distinct_parts([self.anchor(text), descriptor])
        if not out:
            out = [w for w in dict.fromkeys(text.split(" ")) if w not in self.common][: self.words]
        return " ".join(out)[: self.most]


def distinct_parts(parts: Sequence[str]) -> list[str]:
    """Parts that, blanks aside, neither contain one before them nor are contained in it."""
    out: list[str] = []
    for p in parts:
        flat = p.replace(" ", "")
        if flat and not any(flat in (o := x.replace(" ", "")) or o in flat for x in out):
            out.append(p)
    return out


def passages(texts: DataFrame, rules: Rules, anchors: DataFrame) -> DataFrame:
    """texts (id, text), anchors (phrase, in plain form; within LIMIT bytes, else an error) -> id, ordinal, chunk, keyword."""
    size = anchors.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    if size > LIMIT:
        raise ValueError(f"{size} bytes of anchors; at most {LIMIT} are shipped to every task")
    sent = texts.sparkSession.sparkContext.broadcast(sorted(r.phrase for r in anchors.where("phrase is not null").distinct().collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, keyword = Splitter(rules), Keywords(sent.value, rules)
        for batch in batches:
            at, place, chunk = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = cut.passages(text or "")
                at += [k] * len(own)
                place += range(len(own))
                chunk += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(place, pa.int32()), pa.array(chunk, pa.string()), pa.array([keyword(c) for c in chunk], pa.string())], ["id", "ordinal", "chunk", "keyword"])

    kind = texts.schema[0].dataType.simpleString()
    return texts.toDF("id", "text").select("id", tidy_lines(F.col("text")).alias("text")).mapInArrow(run, f"id {kind}, ordinal int, chunk string, keyword string")

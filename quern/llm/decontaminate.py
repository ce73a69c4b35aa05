"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers (with the unit after them, joined or spaced) and names (capitalised words that
start no sentence; a run of them is one) become typed placeholders, all else its lower case without marks. Windows of
WINDOW template tokens of texts and benchmark items are hash-joined. On each alignment of an item with a document the
filled slots must fit together: a slot value of the item always stands for the same value in the document,
and other values for others. Alignments that lie within an item's length of each other count together, as words
put in or left out start a new one. A document is contaminated by an item if consistent windows cover at least SHARE
of the item's tokens, so re-parameterised and lightly edited copies are caught as well as verbatim ones.

Placeholders alone say little: template windows of fewer than LITERAL literal tokens aren't joined. So windows of WINDOW plain
words (lower case, without marks, nothing masked) are joined too, and a verbatim copy is found whatever it is made of.

Documents' windows are first tested against a Bloom filter of BLOOM bits over the benchmark's windows; its size is fixed,
and what passes is joined exactly. Items shorter than WINDOW use one window of their own length.

Results for odd input: null and empty texts and items match nothing, nor do rows with a null id; repeated rows (same id and text) count once; items
without LITERAL literal tokens match verbatim copies only, items of one word each text with that word. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mix, named, numbers, run_hash, ship

WINDOW, LITERAL, SHARE = 8, 4, 0.5
BLOOM = 1 << 23
#: Words for units of measure that follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr d kb mb gb tb hz khz mhz ghz w kw v a k c f % $ usd eur gbp "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams "
    "kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons second seconds minute minutes hour hours "
    "day days week weeks month months year years dollar dollars euro euros cent cents degree degrees percent".split()
)
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:e[-+]?\d+)?(?:st|nd|rd|th)?([^\W\d_]*|%)$")
_SAME = {"%": "percent"}
_MARKS = "\"'`()[]{}<>.,;:!?…*_#~|&^$%=+«»“”‘’"
_OPEN = _MARKS.replace("%", "").replace("$", "")
NUM, NAME = np.uint64(0xA100), np.uint64(0xA200)
# Sets windows of plain words apart from those of template tokens.
PLAIN = np.uint64(0x9E3779B97F4A7C15)
_NUM, _CAP, _END, _UNIT, _JOINED = 1, 2, 4, 8, 16


class Words(dict):
    """word -> 56 bits of a hash of its plain form, and flags: number, capitalised, ends a sentence, unit, number with a unit."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        import xxhash

        plain = word.strip(_MARKS) or word.strip(_OPEN)
        flags = _END * word.rstrip("\"')]»”’").endswith((".", "!", "?", ":", "…"))
        m = _NUMBER.match(plain if plain else word)
        if m and (not m[1] or m[1].lower() in UNITS):
            flags |= _NUM | _JOINED * (_unit_at(word) > 0)
        elif plain.lower() in UNITS:
            flags |= _UNIT
        elif plain[:1].isupper():
            flags |= _CAP
        plain = (plain or word).lower()
        out = self[word] = xxhash.xxh3_64_intdigest(_SAME.get(plain, plain).encode()) & ~0xFF | flags
        return out


def _unit_at(word: str) -> int:
    """Where in a number its unit begins, 0 if it has none."""
    plain = word.strip(_MARKS)
    m = _NUMBER.match(plain)
    if not m:
        return 0
    at = word.index(plain) + (m.start(1) if m[1] else len(plain))
    return at if m[1] or word[at : at + 1] == "%" else 0


def _split(words: list[str]) -> list[str]:
    """The words, a unit that is joined to its number as a word of its own."""
    out = []
    for w in words:
        at = _unit_at(w) if _words[w] & _JOINED else 0
        out += [w[:at], w[at:]] if at else [w]
    return out


_words = Words()


def template(text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Template tokens, the word each begins at (one more at the end), and the words."""
    return _parse(text)[:3]


def _parse(text: str) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """As template(), and the hashes of the plain words."""
    words = text.split()
    v = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(v):
        return v, np.zeros(1, np.int64), words, v
    if (v & np.uint64(_JOINED)).any():
        words = _split(words)
        v = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    flags = (v & np.uint64(0xFF)).astype(np.int64)
    num = flags & _NUM > 0
    start = np.concatenate([[True], flags[:-1] & _END > 0])
    name = (flags & _CAP > 0) & ~start
    unit = (flags & _UNIT > 0) & np.concatenate([[False], num[:-1]])
    plain = v & ~np.uint64(0xFF)
    t = plain.copy()
    t[num], t[name] = NUM, NAME
    first = ~unit & (~name | ~np.concatenate([[False], name[:-1]]))
    at = np.flatnonzero(first)
    return t[at], np.append(at, len(words)), words, plain


def _plain_windows(plain: np.ndarray, width: int) -> np.ndarray:
    return mix(run_hash(plain, width) ^ PLAIN)


def _token_at(at: np.ndarray, word: int) -> int:
    """The template token that a word belongs to."""
    return int(np.searchsorted(at, word, "right")) - 1


def _literal(t: np.ndarray, width: int) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum((t != NUM) & (t != NAME))])
    return c[width:] - c[:-width]


def _slots(t: np.ndarray, at: np.ndarray, words: list[str], k: int, width: int) -> list[str]:
    """The values of the placeholders of one window, in order, with their kinds. A number has two: itself, and its unit or nothing."""
    out = []
    for i in range(k, k + width):
        value = [w.strip(_MARKS) or w.strip(_OPEN) for w in words[at[i] : at[i + 1]]]
        if t[i] == NUM:
            unit = "".join(value[1:]).lower()
            out += [f"n:{value[0]}", _NO_UNIT + _SAME.get(unit, unit)]
        elif t[i] == NAME:
            out.append("N:" + " ".join(value))
    return out


_NO_UNIT = "u:"
_ITEM = "window long, item_id long, item_at long, item_word long, item_span long, width long, item_tokens long, item_words long, plain boolean, item_slots array<string>"
_DOC = "window long, doc_id long, doc_at long, doc_word long, doc_width long, doc_plain boolean, doc_slots array<string>"
_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _item_windows(batches):
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            t, at, words, plain = _parse(text or "")
            if item is None or not len(t):
                continue
            width = min(WINDOW, len(t))
            h, lit = run_hash(t, width), _literal(t, width)
            for k in np.flatnonzero(lit >= min(LITERAL, width)):
                rows.append((int(h[k].view(np.int64)), item, int(k), int(at[k]), int(at[k + width] - at[k]), width, len(t), len(words), False, _slots(t, at, words, k, width)))
            width = min(WINDOW, len(words))
            for k, x in enumerate(_plain_windows(plain, width)):
                rows.append((int(x.view(np.int64)), item, _token_at(at, k), k, width, width, len(t), len(words), True, []))
        yield _batch(rows, _ITEM)


def _batch(rows, schema):
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], list(names))


def _spots(h: np.ndarray) -> list[np.ndarray]:
    return [(mix(h + np.uint64(k)) % np.uint64(BLOOM)).astype(np.int64) for k in (1, 2, 3)]


def _bloom(batches):
    """One partial filter for each task, as the numbers of its bytes that aren't zero."""
    bits = np.zeros(BLOOM, bool)
    for batch in batches:
        for s in _spots(numbers(batch.column("window")).view(np.uint64)):
            bits[s] = True
    at = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32))], ["bit"])


def _doc_windows(bits: np.ndarray, widths: list[tuple[bool, int]]):
    packed = bits

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for i, text in zip(ids, batch.column("text")):
                text = text.as_py()
                if i is None or not text:
                    continue
                t, at, words, plain = _parse(text)
                for of_words, width in widths:
                    if len(plain if of_words else t) < width:
                        continue
                    h = _plain_windows(plain, width) if of_words else run_hash(t, width)
                    ok = np.ones(len(h), bool) if of_words else _literal(t, width) >= min(LITERAL, width)
                    for s in _spots(h):
                        ok &= (packed[s >> 3] >> (s & 7)) & 1 == 1
                    for k in np.flatnonzero(ok):
                        where = (_token_at(at, k), int(k)) if of_words else (int(k), int(at[k]))
                        rows.append((int(h[k].view(np.int64)), i, *where, width, of_words, [] if of_words else _slots(t, at, words, k, width)))
                if len(rows) > 5000:
                    yield _batch(rows, _DOC)
                    rows = []
            if rows:
                yield _batch(rows, _DOC)

    return run


def consistent(windows: list[tuple[int, list[str], list[str]]], width: int) -> tuple[int, int]:
    """Windows (place in item, item's slots, document's slots) of one alignment -> item tokens that windows
    cover whose slots fit one mapping both ways, and slots with another value. Windows go in order; one
    that contradicts the earlier ones is left out."""
    slots, covered = Slots(), set()
    for k, a, b in sorted(windows):
        if slots.take(a, b):
            covered.update(range(k, k + width))
    return len(covered), len(slots.changed)


class Slots:
    """A mapping both ways between the slot values of an item and of a document, as far as it is known."""

    def __init__(self):
        self.there, self.back, self.changed = {}, {}, set()

    def take(self, a: list[str], b: list[str]) -> bool:
        """Add the slots of a window if they don't contradict. A unit that one side leaves out says nothing."""
        if len(a) != len(b):
            return False
        pairs = {(x, y) for x, y in zip(a, b) if x != _NO_UNIT and y != _NO_UNIT}
        if any(self.there.get(x, y) != y or self.back.get(y, x) != x for x, y in pairs) or not len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
            return False
        self.there.update(pairs)
        self.back.update((y, x) for x, y in pairs)
        self.changed.update(x for x, y in pairs if x != y)
        return True


def _judge(share: float):
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                best = cover(r["hits"], r["item_tokens"], r["item_words"])
                if best[0] >= share:
                    rows.append((r["doc_id"], r["item_id"], best[0], best[1], -best[2]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64()])], ["doc_id", "item_id", "coverage", "n_changed", "doc_at"])

    return run


def cover(hits: list[dict], tokens: int, words: int) -> tuple[float, int, int]:
    """Coverage, changed slots and minus the place in the document of the best place for an item. Each alignment is
    tried with all hits up to an item's length from it: its own first, then the nearest."""
    by: dict[tuple[bool, int], dict[int, dict]] = {}
    for m in hits:
        m["shift"] = m["doc_word"] - m["item_word"]
        d = m["shift"] if m["plain"] else m["doc_at"] - m["item_at"]
        by.setdefault((m["plain"], d), {})[m["item_word"]] = m
    order = lambda m: (m["item_word"], m["plain"], m["doc_word"])
    places = [sorted(v.values(), key=order) for v in by.values()]
    best = max(_covered(v, v, tokens, words) for v in places)
    most = max(len(_union(hits, "item_at", "width", False)) / tokens, len(_union(hits, "item_word", "item_span")) / words)
    near = sorted(hits, key=lambda m: m["shift"])
    shifts = [m["shift"] for m in near]
    for own in places:
        if best[0] >= most:
            break
        low, high = own[0]["shift"], own[-1]["shift"]
        low, high = min(low, high), max(low, high)
        others = near[bisect_left(shifts, low - words) : bisect_right(shifts, high + words)]
        others.sort(key=lambda m: (max(low - m["shift"], m["shift"] - high, 0), *order(m)))
        best = max(best, _covered(own, own + others, tokens, words))
    return best


def _union(hits: list[dict], at: str, span: str, of_words: bool = True) -> set[int]:
    return {k for m in hits if of_words or not m["plain"] for k in range(m[at], m[at] + m[span])}


def _covered(own: list[dict], hits: list[dict], tokens: int, words: int) -> tuple[float, int, int]:
    """The item's tokens or words that the hits cover, in their order; one that contradicts the earlier ones is left out."""
    slots = Slots()
    fit = [m for m in hits if m["plain"] or slots.take(m["item_slots"], m["doc_slots"])]
    share = max(len(_union(fit, "item_at", "width", False)) / tokens, len(_union(fit, "item_word", "item_span")) / words)
    return share, len(slots.changed), -min(m["doc_at"] - m["item_at"] for m in own)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """doc_id, item_id, coverage (of the item's tokens, or of its words where more of them are copied verbatim), n_changed (slots with another value), doc_at
    (template token where the item begins): a row for each document and item that it contains."""
    ship(spark)
    docs = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(lean(_item_windows), _ITEM).distinct()
    # the filter: at most BLOOM distinct bits, 1 MiB when packed, whatever the benchmark's size
    on = items.select("window").mapInArrow(lean(_bloom), "bit int").distinct().toArrow()["bit"].to_numpy()
    flags = np.zeros(BLOOM, bool)
    flags[on] = True
    bits = np.packbits(flags, bitorder="little")
    widths = sorted(tuple(r) for r in items.select("plain", "width").distinct().collect())
    windows = docs.mapInArrow(lean(_doc_windows(bits, widths)), _DOC)
    hits = windows.join(items, (windows.window == items.window) & (windows.doc_width == items.width) & (windows.doc_plain == items.plain))
    by = hits.groupBy("doc_id", "item_id", "item_tokens", "item_words").agg(F.collect_set(F.struct("plain", "doc_at", "item_at", "doc_word", "item_word", "item_span", "width", "doc_slots", "item_slots")).alias("hits"))
    return by.select("doc_id", "item_id", "item_tokens", "item_words", "hits").mapInArrow(lean(_judge(share)), "doc_id long, item_id long, coverage double, n_changed int, doc_at long")

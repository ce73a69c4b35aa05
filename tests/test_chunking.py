"""Chunking and fuzzy distinct over the tables against plain Python versions."""

import re

import pytest

from quern.operators.chunking import MARKERS
from quern.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
KINDS = ["legal_section", "faq", "process", "numbered"]


def trimmed(items):
    return [x.strip(" ") for x in items if x.strip(" ")]


def sentences(text):
    return trimmed(re.split(r"(?<=[.!?;:])[ \t\n\x0b\f\r]+|\n+", text))


def folded(items, joins):
    out = []
    for x in items:
        if out and joins(out[-1], x):
            out[-1] += " " + x
        else:
            out.append(x)
    return out


def structured(text):
    starts = "(?im)(?=^\\s*(?:" + "|".join(MARKERS) + "))"
    for k, body in enumerate(trimmed(re.split(starts, text))):
        kind = next((n for n, m in zip(KINDS, MARKERS) if re.search(r"^\s*" + m, body.lower())), "text")
        packs = folded(sentences(body), lambda a, b: len(a) + len(b) + 1 <= 350)
        for part, chunk in enumerate(folded(packs, lambda a, b: (len(a) < 80 or len(b) < 80) and len(a) + len(b) < 350)):
            yield k, kind, part, chunk


def test_chunk_structured(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, *row) for d in texts for row in structured(d.text or "")}
    got = QUERIES["chunk_structured"](spark, SF).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def distinct(lines):
    kept = []
    words = lambda x: set(re.split(r"\s+", x.lower()))
    for x in lines:
        for k in kept:
            a, b = k.lower(), x.lower()
            if a == b or min(len(a), len(b)) >= 14 and (a in b or b in a) or len(words(k) & words(x)) >= 0.8 * min(len(words(k)), len(words(x))):
                break
        else:
            kept.append(x)
    return kept


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_distinct_lines(spark, sf):
    want = {r.item_id: (len(sentences(r.text)), distinct(sentences(r.text))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert {r.item_id: (r.n, r.kept) for r in QUERIES["distinct_lines"](spark, sf).collect()} == want

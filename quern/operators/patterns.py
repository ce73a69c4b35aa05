"""Many phrases in one pass over each text: an Aho-Corasick automaton from a rule table, with longest-match suppression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of phrases that one automaton is built from at most; larger rule tables go in rounds.
LIMIT = 16 << 20


def automaton(phrases: Sequence[str], values: Sequence | None = None) -> ahocorasick.Automaton:
    """Of phrases (not empty, each once); a match gives (phrase's length, its value, by default its place)."""
    out = ahocorasick.Automaton()
    for k, p in enumerate(phrases):
        out.add_word(p, (len(p), k if values is None else values[k]))
    if len(phrases):
        out.make_automaton()
    return out


def matches(a: ahocorasick.Automaton, text: str) -> list[tuple[int, int, object]]:
    """(start, end, value) of all occurrences, in the order of their ends."""
    return [(end + 1 - n, end + 1, v) for end, (n, v) in a.iter(text)] if len(a) else []


def uncovered(found: list[tuple[int, int, object]]) -> list[tuple[int, int, object]]:
    """Matches that lie in no longer one, in order of their starts."""
    out, reach, begun = [], -1, -1
    for s, e, v in sorted(found, key=lambda m: (m[0], -m[1])):
        if e > reach or (s, e) == (begun, reach):
            out.append((s, e, v))
            begun, reach = (s, e) if e > reach else (begun, reach)
    return out


def rounds(rules: DataFrame, limit: int = LIMIT) -> list[DataFrame]:
    """Rules (rule_id, phrase) dealt to as many parts as keep each one's phrases within the limit."""
    n = max(1, -(-(rules.agg(F.sum(F.octet_length("phrase") + 16)).first()[0] or 0) // limit))
    return [rules.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == k) for k in range(n)] if n > 1 else [rules]


def occurrences(texts: DataFrame, rules: DataFrame, longest: bool = False, limit: int = LIMIT) -> DataFrame:
    """texts (id, text) and rules (rule_id, phrase; a phrase may stand under several ids) -> id, rule_id, start, end (from 0, in code points) of every
    occurrence; with `longest`, of those that lie in no longer one. Null and empty phrases match nothing. Texts aren't shuffled: each round
    ships one automaton's phrases to all tasks."""
    spark = texts.sparkSession
    rules = rules.where("phrase <> '' and rule_id is not null").select(F.col("rule_id").cast("long").alias("rule_id"), "phrase").distinct()
    parts = rounds(rules, limit)

    def passed(part: DataFrame) -> DataFrame:
        ids: dict[str, list[int]] = {}
        for r in part.collect():  # within the limit
            ids.setdefault(r.phrase, []).append(r.rule_id)
        sent = spark.sparkContext.broadcast(ids)
        alone = longest and len(parts) == 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = automaton(list(sent.value), list(sent.value.values()))
            for batch in batches:
                rows: list[tuple[int, int, int, int]] = []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    found = matches(a, text or "")
                    rows += [(k, own, s, e) for s, e, v in (uncovered(found) if alone else found) for own in v]
                at, own, s, e = zip(*rows) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(own, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["id", "rule_id", "start", "end"])

        return texts.toDF("id", "text").mapInArrow(run, f"id {texts.schema[0].dataType.simpleString()}, rule_id long, start int, end int")

    out = passed(parts[0])
    for part in parts[1:]:
        out = out.union(passed(part))
    if longest and len(parts) > 1:
        before = Window.partitionBy("id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
        reach = F.max(F.struct("end", (-F.col("start")).alias("less"))).over(before)
        out = out.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("end") > F.col("reach.end")) | ((F.col("end") == F.col("reach.end")) & (F.col("start") == -F.col("reach.less")))).drop("reach")
    return out

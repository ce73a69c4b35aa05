"""Words of texts that are written without blanks: the cheapest way through a dictionary's matches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patterns import LIMIT, automaton, matches, uncovered

#: Words of a dictionary at most, the most frequent ones; what a sign outside of all words costs beside the rarest word.
WORDS, OUTSIDE = 200_000, 2.0


def dictionary(tokens: DataFrame, most: int = WORDS, least: int = 2) -> DataFrame:
    """tokens (word) -> word, n: at most `most` words that occur at least `least` times, the most frequent first."""
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), F.asc("word")).limit(most)


class Segmenter:
    """A word costs the logarithm of how rare it is; signs outside of all words cost more than the rarest one, and stand together as one word. Of equally cheap ways
    the one with the shorter last word wins."""

    def __init__(self, counts: Mapping[str, int], concepts: Sequence[tuple[str, str]] = ()):
        total = sum(counts.values()) or 1
        words = [w for w in counts if w]
        self.words = automaton(words, [math.log(total / counts[w]) for w in words])
        self.outside = math.log(total) + OUTSIDE
        self.concepts = automaton([p for p, _ in concepts], [c for _, c in concepts])

    def expanded(self, text: str) -> str:
        """The text with each concept's phrase (the longest where they overlap) replaced by its word."""
        out, at = [], 0
        for s, e, word in uncovered(matches(self.concepts, text)):
            if s >= at:
                out += [text[at:s], word]
                at = e
        return "".join(out) + text[at:]

    def cuts(self, text: str) -> list[int]:
        """Where words end, the text's end included."""
        n = len(text)
        best, back, known = [0.0] + [math.inf] * n, [0] * (n + 1), [True] * (n + 1)
        done = 0
        for end, (size, cost) in self.words.iter(text) if n and len(self.words) else ():
            s, e = end + 1 - size, end + 1
            for k in range(done + 1, e + 1):  # places up to here can still be reached by one sign
                if best[k - 1] + self.outside < best[k]:
                    best[k], back[k], known[k] = best[k - 1] + self.outside, k - 1, False
            done = max(done, e)
            if best[s] + cost < best[e] or (best[s] + cost == best[e] and s > back[e]):
                best[e], back[e], known[e] = best[s] + cost, s, True
        for k in range(done + 1, n + 1):
            best[k], back[k], known[k] = best[k - 1] + self.outside, k - 1, False
        out, k, last = [], n, True
        while k:
            if known[k] or last:
                out.append(k)
            last, k = known[k], back[k]
        return out[::-1]

    def __call__(self, text: str) -> list[str]:
        ends = self.cuts(text)
        return [text[i:j] for i, j in zip([0, *ends], ends)]


def segmented(texts: DataFrame, words: DataFrame, concepts: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """texts (id, text), words (word, n; within LIMIT bytes, else an error) -> id, words. Null text has none."""
    size = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    if size > LIMIT:
        raise ValueError(f"{size} bytes of words; at most {LIMIT} are shipped to every task")
    sent = texts.sparkSession.sparkContext.broadcast({r.word: r.n for r in words.where("word is not null").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Segmenter(sent.value, concepts)
        for batch in batches:
            found = [cut(cut.expanded(t)) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["id", "words"])

    return texts.toDF("id", "text").mapInArrow(run, f"id {texts.schema[0].dataType.simpleString()}, words array<string>")

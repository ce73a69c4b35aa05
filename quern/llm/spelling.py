"""Spelling variants: words one edit apart, met by bands of letter-parity masks.

A word's mask has a bit for each of the 90 letters (a-z and U+00C0 to U+00FF), set if the letter stands in it an odd number of times. One
edit flips at most two bits: exactly two if a letter is replaced, exactly one if it is inserted or deleted. So of three bands of 30 bits
at least one stays as it is. Words are dealt by (band, its bits, length): a bucket of length n holds the words of n and of n + 1 letters
and compares those of n with both. Common letters are dealt evenly to the bands.

Within a bucket the other two bands are compared first, on distinct masks (flips must be two or one, and bands before this one must differ, so that a pair is found
once), then sums of random numbers of the letters (what the flipped letters account for), and last the letters themselves. A bucket with more words than
a block is dealt to blocks, whose pairs are tasks of their own. Of each word only counts and its best partner leave a task, never the pairs.

Words are counted with Spark's own functions before that. Forms of forms are followed by pointer doubling; as n grows tenfold with each step, there are few rounds.

Results for odd input: null and empty texts have no words; a null id leaves runs as they are (nothing is deleted); runs of any length are
whole words; rows that repeat count each time; no words, no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, named, parts, ship

LEAST, OFTEN, TIMES = 7, 2, 10
#: One run in so many loses a letter.
DROPS = 31
#: Buckets of more words than a block are dealt to blocks; a block has this many words, or one in SHARE of all bucket rows if that's more.
BLOCK, SHARE = 8192, 10_000
#: Bucket rows of a partition aimed at, rows that are compared at one go, the largest group compared by shifts.
EACH, STEP, SHIFTS = 1 << 18, 1 << 16, 24
#: Letters by how common they are, dealt to bands there and back; the order only evens out the bands.
_LETTERS = "etaoinsrhdlucmgfpwbyvkxjqz" + "".join(map(chr, range(0xC0, 0x100)))
_WHERE = [((0, 1, 2, 2, 1, 0)[k % 6], k // 3) for k in range(90)]
#: Of each byte of Latin-1: its bit in each band, and a random number.
_BITS = np.zeros((3, 256), np.uint64)
_NUMBER = np.zeros(256, np.uint64)
_rng = np.random.default_rng(11)
#: Of each band: the random numbers of the letters of the other two bands, by their place in the 60 bits of both.
_OTHER = np.zeros((3, 60), np.uint64)
for _c, (_band, _bit) in zip(_LETTERS, _WHERE):
    _BITS[_band, ord(_c)] = 1 << _bit
    _NUMBER[ord(_c)] = _rng.integers(1, 1 << 63, dtype=np.uint64)
    for _b in range(3):
        if _b != _band:
            _OTHER[_b, _bit + (30 if _band == max({0, 1, 2} - {_b}) else 0)] = _NUMBER[ord(_c)]


def words(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, text) -> one row `word` for each counted occurrence."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST},}}"), F.lit(0)))
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    h = F.crc32(F.encode(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "low"), "utf-8"))
    at = (F.col("h") % F.length("low")).cast("int")
    cut = F.concat(F.substring("low", F.lit(1), at), F.substring("low", at + 2, F.length("low")))
    word: Column = F.when(F.col("h") % DROPS == 0, cut).otherwise(F.col("low"))
    return texts.select("doc_id", run.alias("run")).select("doc_id", low.alias("low")).select("low", h.alias("h")).select(word.alias("word")).where(F.length("word") >= LEAST)


def vocabulary(texts: DataFrame) -> DataFrame:
    return words(texts).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)


def letters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as bytes of Latin-1, and their bounds."""
    rows = col.to_pylist()
    return np.frombuffer("".join(rows).encode("latin-1"), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in rows])]).astype(np.int64)


def masks(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The three bands of each word (none is empty); one row a band."""
    return np.stack([np.bitwise_xor.reduceat(b[data], bounds[:-1]) if len(bounds) > 1 else np.zeros(0, np.uint64) for b in _BITS])


def _buckets(batches):
    """word, n -> a row for each band and bucket length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, bounds = letters(batch.column("word"))
        size = np.diff(bounds)
        m = masks(data, bounds)
        n = len(size)
        row = pa.array(np.tile(np.arange(n), 6))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1, 2], 2 * n).astype(np.int8)), pa.array(np.repeat(m, 2, axis=0).ravel().astype(np.int32)),
             pa.array(np.tile(np.concatenate([size, size - 1]), 3).astype(np.int32)), batch.column("word").take(row), batch.column("n").take(row)],
            ["band", "bits", "len", "word", "n"],
        )


def _products(s1: np.ndarray, c1: np.ndarray, s2: np.ndarray, c2: np.ndarray):
    """All pairs of rows of two runs each (start, length), in slices of bounded size."""
    total = c1 * c2
    edge = np.cumsum(total)
    lo = 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(edge, (edge[lo - 1] if lo else 0) + (1 << 20), "right")))
        t = total[lo:hi]
        of = np.repeat(np.arange(lo, hi), t)
        k = np.arange(len(of)) - np.repeat(np.cumsum(t) - t, t)
        yield s1[of] + k // c2[of], s2[of] + k % c2[of]
        lo = hi


class Group:
    """Rows of whole buckets, sorted by bucket and block pair."""

    def __init__(self, t: pa.Table, most: int):
        t, self.most = t.combine_chunks(), most
        word = t["word"].combine_chunks()
        self.data, self.bounds = letters(word)
        self.size = np.diff(self.bounds)
        self.sum = np.add.reduceat(_NUMBER[self.data], self.bounds[:-1])
        self.band, self.len, self.block, b1, b2 = (t[c].to_numpy() for c in ("band", "len", "block", "b1", "b2"))
        self.cross = b1 != b2
        m = masks(self.data, self.bounds)
        first, second = np.where(self.band == 0, 1, 0), np.where(self.band == 2, 1, 2)
        at = np.arange(len(m[0]))
        self.other = m[first, at] | m[second, at] << np.uint64(30)
        key = np.stack([self.band, t["bits"].to_numpy(), self.len, b1, b2])
        self.edge = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def flips(self, x: np.ndarray, band: np.ndarray | int, same: np.ndarray | bool) -> np.ndarray:
        """Whether masks that differ by x can be one edit apart, and no earlier band is equal."""
        ok = np.bitwise_count(x) == np.where(same, 2, 1)
        low, high = (x & np.uint64((1 << 30) - 1)) != 0, x >> np.uint64(30) != 0
        return ok & ((band == 0) | low) & ((band < 2) | high)

    def check(self, i: np.ndarray, j: np.ndarray) -> None:
        """Keep those candidates that are one edit apart. j's words are as long as i's, or one longer."""
        x = self.other[i] ^ self.other[j]
        same = self.size[i] == self.size[j]
        one = x & (~x + np.uint64(1))
        place = lambda bit: np.bitwise_count(bit - np.uint64(1)).astype(np.int64)
        band, last = self.band[i], _OTHER.shape[1] - 1
        r1 = _OTHER[band, np.minimum(place(one), last)]
        r2 = np.where(same, _OTHER[band, np.minimum(place(x ^ one), last)], np.uint64(0))
        gap = self.sum[j] - self.sum[i]
        ok = np.where(same, (gap == r1 - r2) | (gap == r2 - r1), gap == r1)
        i, j = i[ok], j[ok]
        for n in np.unique(self.size[i]).tolist():
            at = np.flatnonzero(self.size[i] == n)
            for lo in range(0, len(at), step := max(1, (1 << 21) // n)):
                a, b = i[at[lo : lo + step]], j[at[lo : lo + step]]
                place_ = np.arange(n)
                left = self.data[self.bounds[a][:, None] + place_]
                head = left == self.data[self.bounds[b][:, None] + place_]
                tail = left == self.data[(self.bounds[b + 1] - n)[:, None] + place_]
                longer = self.size[b] > n
                # equal letters from the left and from the right together cover the shorter word, or all but the replaced letter
                run = np.where(head.all(axis=1), n, head.argmin(axis=1)) + np.where(tail.all(axis=1), n, tail[:, ::-1].argmin(axis=1))
                ok = np.where(longer, run >= n, run == n - 1)
                self.found.append((a[ok], b[ok]))

    def shifts(self) -> None:
        """Small buckets, all at once: each row with the one `d` rows on."""
        sizes = np.diff(self.edge)
        of = np.repeat(np.arange(len(sizes)), sizes)
        small = sizes <= self.most
        for d in range(1, int(sizes[small].max(initial=0))):
            i = np.flatnonzero((of[d:] == of[:-d]) & small[of[d:]])
            j = i + d
            swap = self.size[i] > self.size[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            ok = (self.size[i] == self.len[i]) & (~self.cross[i] | (self.block[i] != self.block[j]))
            i, j = i[ok], j[ok]
            ok = self.flips(self.other[i] ^ self.other[j], self.band[i], self.size[i] == self.size[j])
            self.check(i[ok], j[ok])

    def dense(self, lo: int, hi: int) -> None:
        """One large bucket: its distinct masks first."""
        rows = np.arange(lo, hi)
        band, cross = self.band[lo], self.cross[lo]
        low, high = rows[self.size[rows] == self.len[lo]], rows[self.size[rows] > self.len[lo]]
        if cross:
            b = self.block[lo]
            sides = [(low[self.block[low] == b], low[self.block[low] != b], True), (low[self.block[low] == b], high[self.block[high] != b], False), (low[self.block[low] != b], high[self.block[high] == b], False)]
        else:
            sides = [(low, low, True), (low, high, False)]
        for x, y, same in sides:
            x, y = x[np.argsort(self.other[x], kind="stable")], y[np.argsort(self.other[y], kind="stable")]
            ux, sx, cx = np.unique(self.other[x], return_index=True, return_counts=True)
            uy, sy, cy = np.unique(self.other[y], return_index=True, return_counts=True)
            for k in range(0, len(ux), step := max(1, (1 << 20) // max(len(uy), 1))):
                p, q = np.nonzero(self.flips(ux[k : k + step, None] ^ uy[None, :], band, same))
                p += k
                if same and not cross:
                    p, q = p[p < q], q[p < q]
                for a, b in _products(sx[p], cx[p], sy[q], cy[q]):
                    self.check(x[a], y[b])

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        self.shifts()
        for k in np.flatnonzero(np.diff(self.edge) > self.most).tolist():
            self.dense(int(self.edge[k]), int(self.edge[k + 1]))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(a for a, _ in self.found)]), np.concatenate([none, *(b for _, b in self.found)])


_KEY = ["band", "bits", "len", "b1", "b2"]


def _done(t: pa.Table, most: int) -> pa.RecordBatch:
    a, b = Group(t, most).near()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    n, word = t["n"].to_numpy(), t["word"].combine_chunks()
    name = np.argsort(pc.sort_indices(word).to_numpy())  # the smaller word first among equals
    order = np.lexsort((name[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else a
    many = np.diff(np.append(first, len(a)))
    return pa.RecordBatch.from_arrays([word.take(pa.array(a[first])), pa.array(many), pa.array(n[b[first]]), word.take(pa.array(b[first]))], ["word", "n_near", "best_n", "best"])


def _compare(step: int, most: int):
    """Sorted bucket rows -> of each word that has near ones here: how many, and the most frequent one."""

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.num_rows < step:
                continue
            same = np.logical_and.reduce([rest[c].to_numpy() == rest[c][-1].as_py() for c in _KEY])
            if cut := int(same.argmax()):  # the last bucket may go on
                yield _done(rest.slice(0, cut).combine_chunks(), most)
                rest = rest.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield _done(rest.combine_chunks(), most)

    return run


def near_words(spark: SparkSession, vocab: DataFrame) -> DataFrame:
    """vocab (word, n; words of the 90 letters, each once) -> word, n_near, best_n, best for all words with a near one."""
    ship(spark)
    rows = materialise(spark, vocab.mapInArrow(_buckets, "band byte, bits int, len int, word string, n long"), "buckets")
    total = rows.count()
    block = max(BLOCK, total // SHARE)
    bucket = ["band", "bits", "len"]
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)  # fewer than SHARE rows
    blocks = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    dealt = rows.join(F.broadcast(sizes), bucket, "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("met", met).select(*bucket, F.least("block", "met").alias("b1"), F.greatest("block", "met").alias("b2"), "block", "word", "n")
    dealt = dealt.repartition(parts(spark, total, EACH), *_KEY).sortWithinPartitions(*_KEY)
    some = dealt.mapInArrow(_compare(STEP, SHIFTS), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return some.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """forms (word, form; never null) -> word, root: where following forms ends."""
    at = materialise(spark, forms.toDF("word", "root"), "roots")
    while True:
        onward = at.toDF("root", "onward")
        after = at.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved"))
        after = materialise(spark, after, "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        at = after.select("word", "root")


def variants(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> word, n, form, root, n_near, form_n."""
    ship(spark)
    vocab = materialise(spark, vocabulary(docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))), "vocabulary")
    near = near_words(spark, vocab)
    often = F.col("best_n") >= TIMES * F.col("n")
    out = vocab.join(near, "word", "left").select(
        "word", "n", F.when(often, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best_n")).alias("form_n")
    )
    out = materialise(spark, out, "forms")
    end = roots(spark, out.where("form is not null").select("word", "form"))
    return out.join(end, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")

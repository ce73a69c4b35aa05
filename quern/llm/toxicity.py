"""Toxicity: non-negative positive-unlabelled learning.

A linear numpy classifier over indicators of words and their beginnings (lower case, marks stripped, hashed to 2**18 slots), also of beginnings that a text has
often or densely, learns from confirmed toxic texts and from all other texts. With class prior p and logistic loss l the risk is
p*E_P[l(+)] + max(0, E_U[l(-)] - p*E_P[l(-)]); where the second part falls below zero it counts as zero (with a
rounded corner, so that steps of second order work), and the model doesn't fit the unlabelled toxic texts as clean.
The prior is the share of toxic ones among all usable labels; nothing else is learnt from labels of clean texts. Confirmed texts are at most POSITIVES
rows, those with the smallest hash of their id (a bound on labelled rows); unlabelled ones are all rows that aren't held out.

Three jobs read the texts: one counts slots, one writes the slots that are used, one scores. The risk falls by L-BFGS steps; each is one job over the written
slots, in which tasks sum losses and gradients and groups of tasks add them up, so the driver gets vectors of bounded number and length, never rows. Margins become 0..1 by the growing function that minimises
the same risk (with squared loss) on margins of rows that the margin's model hasn't seen, counted in BINS: each of FOLDS parts is scored by a model of the others; these models
and the final one take their steps in the same jobs.

Results for odd input: null and empty texts score by the bias alone; null or contradicting labels are
not learnt from; without confirmed toxic rows every score is 0. Rows with a null id are scored like others; rows that repeat an id are rows of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, numbers, release, ship, steps
from .features import DIM, fold, ngrams, scored, sums
from .quality import Constant, clean_labels

POSITIVES, FOLDS = 3000, 3
KINDS = "lpmd"
CUT = 0.7
#: A slot counts if so many training texts have it and its shares differ by so many standard errors.
LEAST, CLEAR = 3, 2.5
#: Evaluations at most, what the weights' squares cost, how wide (in priors) the corner of the risk is rounded, bins of margins from -SPAN to SPAN.
STEPS, DECAY, ROUND, BINS, SPAN = 40, 2e-3, 0.02, 1 << 14, 64.0


def chosen(a: np.ndarray, c: np.ndarray, n_pos: int, n_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each slot is used, and how far above its share it is among the confirmed; a and c count confirmed and unlabelled texts with it."""
    n_pos, n_all = max(n_pos, 1), max(n_all, 1)
    q = np.clip((a + c) / (n_pos + n_all), 1e-9, 1 - 1e-9)
    used = (a + c >= LEAST) & (np.abs(a / n_pos - c / n_all) >= CLEAR * np.sqrt(q * (1 - q) * (1 / n_pos + 1 / n_all)))
    lift = np.clip(np.log((a + 0.5) / (n_pos + 1) / ((c + 0.5) / (n_all + 1))), -4, 4)
    return used, np.where(used, lift, 0.0)


class Descent:
    """L-BFGS with halved steps, one evaluation at a time: `at` is the next point, `tell` takes its value and gradient."""

    def __init__(self, start: np.ndarray, memory: int = 8):
        self.x, self.at, self.f, self.g = start, start, np.inf, np.zeros_like(start)
        self.memory, self.pairs, self.step, self.way = memory, [], 1.0, np.zeros_like(start)
        self.left, self.done = 12, False

    def tell(self, f: float, g: np.ndarray) -> None:
        if self.done:
            return
        first = not np.isfinite(self.f)
        if not first and not f <= self.f + 1e-4 * self.step * (self.g @ self.way):
            self.left -= 1
            self.step *= 0.4
            if self.left <= 0:
                if not self.pairs:
                    self.done = True
                self.pairs, self.left = [], 12  # once more along the gradient
                self._turn()
            self.at = self.x + self.step * self.way
            return
        if not first:
            s, y = self.at - self.x, g - self.g
            self.done = self.f - f <= 1e-4 * max(abs(f), 1e-9)
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs, (s, y)][-self.memory :]
        self.x, self.f, self.g, self.left = self.at, f, g, 12
        self._turn()
        self.at = self.x + self.step * self.way
        self.done |= float(np.abs(g).max(initial=0)) < 1e-7

    def _turn(self) -> None:
        q, kept = self.g.copy(), []
        for s, y in reversed(self.pairs):
            k = s @ q / (s @ y)
            kept.append(k)
            q -= k * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= s @ y / (y @ y)
            self.step = 1.0
        else:
            self.step = 1.0 / max(float(np.sqrt(q @ q)), 1e-9)
        for (s, y), k in zip(self.pairs, reversed(kept)):
            q += (k - y @ q / (s @ y)) * s
        self.way = -q


def sums_of(w: np.ndarray, bias: float, pos: np.ndarray, every: np.ndarray, cols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of rows with their used slots: losses of confirmed ones as toxic, of all as clean, of confirmed ones as clean, and these sums' gradients by w and the bias.
    pos: the confirmed rows, every: those that count as unlabelled."""
    z = sums(w, cols, bounds) + bias
    sig = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    up = np.logaddexp(0, z)
    parts = [(np.where(pos, up - z, 0), np.where(pos, sig - 1, 0)), (np.where(every, up, 0), np.where(every, sig, 0)), (np.where(pos, up, 0), np.where(pos, sig, 0))]
    many = np.diff(bounds)
    return np.concatenate([[v.sum() for v, _ in parts], *(np.append(np.bincount(cols, weights=np.repeat(g, many), minlength=len(w)), g.sum()) for _, g in parts)])


class Search:
    """One model's way down the risk: its slots (w is scaled by lift; unused slots have none), its sums turned to risk and gradient."""

    def __init__(self, lift: np.ndarray, n_pos: int, n_all: int, prior: float):
        self.lift, self.n_pos, self.n_all, self.prior = lift, max(n_pos, 1), max(n_all, 1), prior
        self.descent = Descent(np.append(np.zeros(len(lift)), np.log(prior / (1 - prior))))

    def point(self) -> tuple[np.ndarray, float]:
        return self.descent.at[:-1] * self.lift, float(self.descent.at[-1])

    def tell(self, got: np.ndarray) -> None:
        d, p, at = len(self.lift) + 1, self.prior, self.descent.at
        losses, g = got[:3], [got[3 + k * d : 3 + (k + 1) * d] for k in range(3)]
        rest = losses[1] / self.n_all - p * losses[2] / self.n_pos
        root = np.sqrt(rest * rest + (ROUND * p) ** 2)  # the corner of max(0, rest), rounded
        risk = p * losses[0] / self.n_pos + (rest + root) / 2
        slope = p * g[0] / self.n_pos + (1 + rest / root) / 2 * (g[1] / self.n_all - p * g[2] / self.n_pos)
        w = at[:-1]
        self.descent.tell(risk + 0.5 * DECAY * p * (w @ w), slope * np.append(self.lift, 1.0) + np.append(DECAY * p * w, 0.0))

    def end(self) -> tuple[np.ndarray, float]:
        return self.descent.x[:-1] * self.lift, float(self.descent.x[-1])


def walk(searches: list[Search], evaluate: Callable[[list[tuple[np.ndarray, float]]], list[np.ndarray]]) -> None:
    """All searches step by step; `evaluate` gives the sums at one point of each."""
    for _ in range(STEPS):
        if all(s.descent.done for s in searches):
            return
        for s, got in zip(searches, evaluate([s.point() for s in searches])):
            s.tell(got)


def fit_nnpu(y: np.ndarray, slots: np.ndarray, bounds: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """y: 1 confirmed, 0 unlabelled. Weights of all slots, and the bias, from rows at hand."""
    pos = y == 1
    row = np.repeat(pos, np.diff(bounds))
    a, c = np.bincount(slots[row], minlength=DIM), np.bincount(slots[~row], minlength=DIM)
    used, lift = chosen(a, c, pos.sum(), (~pos).sum())
    search = Search(lift[used], int(pos.sum()), int((~pos).sum()), prior)
    kept = np.concatenate([[0], np.cumsum(used[slots])])
    cols = (np.cumsum(used) - 1)[slots[used[slots]]]
    walk([search], lambda points: [sums_of(*points[0], pos, ~pos, cols, kept[bounds])])
    full = np.zeros(DIM)
    full[used], bias = search.end()
    return full, bias


class Model:
    def __init__(self, w, bias):
        self.w, self.bias, self.at, self.value = w.astype(np.float32), bias, None, None

    def margins(self, slots, bounds):
        return sums(self.w.astype(np.float64), slots, bounds) + self.bias

    def __call__(self, data, bounds):
        return self.score(self.margins(*ngrams(data, bounds, KINDS)))

    def score(self, m):
        z = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
        if self.at is None:
            return z
        return 0.999 * np.interp(m, self.at, self.value) + 0.001 * z  # the second part orders what shares a pool


def posterior(margin: np.ndarray, pos: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for single margins, those of confirmed rows and of others."""
    order = np.lexsort((~pos, margin))
    return pooled(margin[order], pos[order].astype(float), (~pos[order]).astype(float), prior)


def pooled(margin: np.ndarray, confirmed: np.ndarray, others: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the growing function g of the margin (ascending, with counts) that minimises the risk with squared loss, E_U[g**2] - 2*p*E_P[g]: in each
    pool of neighbouring margins g is p times the confirmed ones' share of the pool by the unlabelled ones'."""
    wp, wu = confirmed * prior / max(confirmed.sum(), 1), others / max(others.sum(), 1)
    pools: list[tuple[float, float, float, float]] = []  # share of confirmed, of unlabelled, least and greatest margin
    for x, p, u in zip(margin.tolist(), wp.tolist(), wu.tolist()):
        pools.append((p, u, x, x))
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last, before = pools.pop(), pools.pop()
            pools.append((before[0] + last[0], before[1] + last[1], before[2], last[3]))
    knots = [(x, min(p / u, 1.0) if u else 1.0) for p, u, low, high in pools for x in ([low, high] if low < high else [low])]
    return np.array([x for x, _ in knots]), np.array([g for _, g in knots])


def fit(y: np.ndarray, part: np.ndarray, slots: np.ndarray, bounds: np.ndarray, prior: float):
    """A model with its scale. y: 1 confirmed, 0 unlabelled; part: of FOLDS, the same for all rows of an id."""

    def rows(mask):
        keep = np.repeat(mask, np.diff(bounds))
        return y[mask], slots[keep], np.concatenate([[0], np.cumsum(np.diff(bounds)[mask])])

    if not (y == 1).any() or not (y == 0).any():
        return Constant(prior)
    margin, seen = np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(FOLDS):
        own = part == k
        if own.any() and set(y[~own].tolist()) == {0, 1}:
            margin[own] = Model(*fit_nnpu(*rows(~own), prior)).margins(*rows(own)[1:])
            seen |= own
    model = Model(*fit_nnpu(y, slots, bounds, prior))
    if (y[seen] == 1).sum() >= 5 and (y[seen] == 0).sum() >= 5:
        model.at, model.value = posterior(margin[seen], y[seen] == 1, prior)
    return model


def _counted(batches):
    """Training texts -> how many of each part and kind have each slot: key is (slot, part, confirmed)."""
    counts = np.zeros((DIM, FOLDS, 2), np.int64)
    for batch, data, bounds in steps(batches, "text"):
        x, b = ngrams(data, bounds, KINDS)
        part = np.repeat(numbers(batch.column("part")), np.diff(b))
        pos = np.repeat(numbers(batch.column("pos").cast(pa.int8())), np.diff(b)) == 1
        for k in range(FOLDS):
            counts[:, k, 0] += np.bincount(x[part == k], minlength=DIM)
            counts[:, k, 1] += np.bincount(x[(part == k) & pos], minlength=DIM)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["key", "n"])


def _reduced(column_of: np.ndarray):
    """Training texts -> part, pos, the columns of their used slots."""

    def run(batches):
        for batch, data, bounds in steps(batches, "text"):
            x, b = ngrams(data, bounds, KINDS)
            c = column_of[x]
            kept = np.concatenate([[0], np.cumsum(c >= 0)])
            cols = pa.ListArray.from_arrays(pa.array(kept[b].astype(np.int32)), pa.array(c[c >= 0]))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("pos"), cols], ["part", "pos", "cols"])

    return run


def _open(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cols = batch.column("cols")
    o = cols.offsets.to_numpy().astype(np.int64)
    return numbers(batch.column("part")), numbers(batch.column("pos").cast(pa.int8())) == 1, cols.values.to_numpy(zero_copy_only=False)[o[0] : o[-1]], o - o[0]


def _evaluated(points):
    def run(batches):
        from pyspark import TaskContext

        total = [np.zeros(3 + 3 * (len(w) + 1)) for w, _ in points]
        for batch in batches:
            part, pos, cols, bounds = _open(batch)
            for k, (w, bias) in enumerate(points):
                seen = part != k  # the last model sees all parts
                total[k] += sums_of(w, bias, pos & seen, seen, cols, bounds)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([b"".join(t.tobytes() for t in total)], pa.binary())], ["task", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table["sums"])
    return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})


def _binned(models):
    """Rows -> counts of their margins, each by the model that hasn't seen its part."""

    def run(batches):
        counts = np.zeros((BINS, 2), np.int64)
        for batch in batches:
            part, pos, cols, bounds = _open(batch)
            for k, (w, bias) in enumerate(models):
                own = part == k
                z = sums(w, cols, bounds)[own] + bias
                at = np.clip((z + SPAN) / (2 * SPAN) * BINS, 0, BINS - 1).astype(np.int64)
                counts[:, 0] += np.bincount(at, minlength=BINS)
                counts[:, 1] += np.bincount(at[pos[own]], minlength=BINS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["key", "n"])

    return run


def _totals(df: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    t = df.groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most `size` rows
    out[t["key"].to_numpy()] = t["n"].to_numpy()
    return out


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, column: str = "toxic"):
    usable = clean_labels(labels, column).where(fold("doc_id", folds) != held_out)
    share = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share.get(1):
        return Constant(0.0)
    prior = min(max(share[1] / sum(share.values()), 0.001), 0.5)
    confirmed = usable.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES).select("doc_id", F.lit(True).alias("pos"))
    rows = docs.where(F.col("doc_id").isNotNull() & (F.coalesce(fold("doc_id", folds), F.lit(-1)) != held_out)).join(F.broadcast(confirmed), "doc_id", "left")
    part = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(FOLDS)).cast("int")
    rows = rows.select("text", part.alias("part"), F.coalesce("pos", F.lit(False)).alias("pos"))
    counts = _totals(rows.mapInArrow(_counted, "key long, n long"), DIM * FOLDS * 2).reshape(DIM, FOLDS, 2)
    size = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("pos").alias("p")).collect()
    n, p = (np.array([sum(r[c] for r in size if r["part"] == k) for k in range(FOLDS)]) for c in ("n", "p"))
    if not p.sum():
        return Constant(prior)
    seen = [np.arange(FOLDS) != k for k in range(FOLDS)] + [np.ones(FOLDS, bool)]
    choice = [chosen(counts[:, s, 1].sum(axis=1), counts[:, s, 0].sum(axis=1), p[s].sum(), n[s].sum()) for s in seen]
    used = np.flatnonzero(np.any([c[0] for c in choice], axis=0))
    column_of = np.full(DIM, -1, np.int32)
    column_of[used] = np.arange(len(used))
    table = materialise(spark, rows.mapInArrow(_reduced(column_of), "part int, pos boolean, cols array<int>"), "slots")
    groups = max(1, int(np.sqrt(table.rdd.getNumPartitions())))
    searches = [Search(c[1][used], int(p[s].sum()), int(n[s].sum()), prior) for c, s in zip(choice, seen)]

    def evaluate(points):
        got = table.mapInArrow(_evaluated(points), "task long, sums binary")
        total = sum(np.frombuffer(r["sums"]) for r in got.groupBy(F.col("task") % groups).applyInArrow(_added, "sums binary").collect())
        return np.split(total, len(points))

    walk(searches, evaluate)
    models = [s.end() for s in searches]
    bins = _totals(table.mapInArrow(_binned(models[:-1]), "key long, n long"), BINS * 2).reshape(BINS, 2)
    release(spark, table)
    w = np.zeros(DIM)
    w[used] = models[-1][0]
    model = Model(w, models[-1][1])
    there = np.flatnonzero(bins[:, 0])
    if bins[:, 1].sum() >= 5 and bins[:, 0].sum() >= 5:
        middle = (there + 0.5) / BINS * 2 * SPAN - SPAN
        model.at, model.value = pooled(middle, bins[there, 1].astype(float), bins[there, 0].astype(float), prior)
    return model


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, cut: float = CUT) -> DataFrame:
    """docs -> doc_id, held_out, score, predicted for every row."""
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(spark, docs, labels, folds, held_out)
    out = scored(docs, model, [])
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))

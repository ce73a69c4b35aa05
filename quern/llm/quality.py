"""Quality classifier: naive Bayes support vectors.

Indicators of words, word pairs and four-byte runs (hashed to 2**18 slots) are scaled by the classes' log-count
ratios; a linear hinge-loss model on them is fitted by dual coordinate descent. It trains on at most
PER_CLASS labelled rows of each class, those with the smallest hash of their id; a logistic fit on out-of-fold margins,
weighted by the classes' shares among all usable labels, maps margins to 0..1.

Results for odd input: null or empty text is scored by its length features alone, that is by the bias; labels that are null, or
that contradict another label of the same id, are not learnt from; with labels of one class only, or none, every
score is that class's share (0.5 with none). Rows with a null id are scored like others. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_of, ship, whole_row
from .features import DIM, fold, gather, ngrams, platt, scored, sums

#: Training rows of each class at most.
PER_CLASS = 1500
KINDS = "wbc"
CUT = 0.3


def log_count_ratio(y: np.ndarray, slots: np.ndarray, bounds: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    row = np.repeat(y, np.diff(bounds))
    p = alpha + np.bincount(slots[row == 1], minlength=DIM)
    q = alpha + np.bincount(slots[row == 0], minlength=DIM)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(y: np.ndarray, r: np.ndarray, slots: np.ndarray, bounds: np.ndarray, c: float, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights over r-scaled, length-one indicator rows, and a bias, for the L1 hinge loss."""
    n = len(y)
    sign = np.where(y > 0, 1.0, -1.0)
    size = np.sqrt(np.maximum(sums(r * r, slots, bounds), 1e-12))
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            at = slots[bounds[i] : bounds[i + 1]]
            v = r[at] / size[i]
            g = sign[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), c)  # |v|**2 + 1 for the bias
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


class Model:
    def __init__(self, r, w, bias, a, b):
        self.r2, self.wr, self.bias, self.a, self.b = (r * r).astype(np.float32), (w * r).astype(np.float32), bias, a, b

    def margins(self, slots, bounds):
        return sums(self.wr.astype(np.float64), slots, bounds) / np.sqrt(np.maximum(sums(self.r2.astype(np.float64), slots, bounds), 1e-12)) + self.bias

    def __call__(self, data, bounds):
        m = self.margins(*ngrams(data, bounds, KINDS))
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -500, 500)))


class Constant:
    def __init__(self, value):
        self.value = value

    def __call__(self, data, bounds):
        return np.full(len(bounds) - 1, self.value)


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, y: one row an id, without nulls, values other than 0 and 1, and contradictions."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return y.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")


def sample(rows: DataFrame, each: int) -> DataFrame:
    """At most `each` rows of each class: those with the smallest hash of their id."""
    pick = lambda k: rows.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
    return pick(0).unionByName(pick(1))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, column: str = "quality", per_class: int = PER_CLASS):
    """A model learnt from labels outside the held-out fold of ids."""
    usable = clean_labels(labels, column).where(fold("doc_id", folds) != held_out)
    share = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(share) < 2:
        return Constant(float(next(iter(share), 0.5)))
    y, slots, bounds = gather(spark, docs, sample(usable, per_class), KINDS)
    if len(set(y.tolist())) < 2:
        return Constant(share.get(1, 0) / sum(share.values()))
    part = np.random.default_rng(3).permutation(len(y)) % 3
    margin = np.zeros(len(y))

    def rows(mask):
        keep = np.repeat(mask, np.diff(bounds))
        return y[mask], slots[keep], np.concatenate([[0], np.cumsum(np.diff(bounds)[mask])])

    def fit(mask):
        ty, ts, tb = rows(mask)
        r = log_count_ratio(ty, ts, tb)
        w, bias = dual_coordinate_descent(ty, r, ts, tb, 1.0)
        return Model(r, w, bias, 1.0, 0.0)

    for k in range(3):
        if len(set(y[part != k].tolist())) == 2:
            margin[part == k] = fit(part != k).margins(*rows(part == k)[1:])
    count = np.bincount(y, minlength=2)
    weight = np.where(y > 0, share[1] / count[1], share[0] / count[0])
    a, b = platt(margin, y, weight / weight.mean())
    model = fit(np.ones(len(y), bool))
    model.a, model.b = a, b
    return model


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, cut: float = CUT) -> DataFrame:
    """docs -> doc_id, held_out, score, predicted for every row."""
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(spark, docs, labels, folds, held_out)
    out = scored(docs, model, [])
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns as they came, whose score is at least cut."""
    ship(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(spark, plain, labels, folds, held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_of(docs).alias("row"))
    return whole_row(scored(rows, model, ["row"]).where(F.col("score") >= cut))

"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are the words of a text and their prefixes of 4, 5 and 6 bytes, hashed to ``2**HASH_BITS``
places; a feature's value is 1 + log2 of its count, at most ``MAX_VALUE``. The model has one weight vector
for all grades and one threshold per grade: P(grade >= k) = sigmoid(w.x - b_k) with 0 < b_1 < b_2 < b_3, so
that a text without evidence is not toxic. It gives each text its expected severity, the sum of those probabilities; texts with P(grade >= 1) over one half are toxic.

Labels are 0/1; grades above 0 come from them: labelled toxic texts are graded by the thirds of the
number of their features that the labels single out. Fitting uses at most ``MAX_LABELLED`` labelled
texts of each class (those of least hashed id), a fixed bound: their ids are broadcast, their features
(not texts) reach the driver, and the ``MAX_FEATURES`` features with the most evidence (log odds over
their standard error) are fitted, with a ridge penalty; a class counts as much as all its labels do,
however many of them were taken, so the model is alike at every size. Scoring
runs over all rows, one pass, no shuffle, with a weight table of fixed size.

Defined results: null and wordless texts have no features and get the base severity, never toxic;
without labels of both classes all severities are 0;
repeated label rows count once, toxic wins; null labels are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietspan.llm import rolling, textnorm
from quietspan.llm.rows import append_columns

HASH_BITS = 20
PREFIXES = (4, 5, 6)
MAX_LABELLED = 5000
MAX_FEATURES = 16384
GRADES = 3
MAX_VALUE = 4.0


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of a text, ascending, and their values."""
    if not text:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    start, end = textnorm.word_byte_offsets(text)
    if not len(start):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    plain = text.translate(textnorm.TABLE)
    found = [rolling.parts(plain, start, end)]
    for n in PREFIXES:
        some = start[end - start > n]
        found.append(rolling.mix(rolling.parts(plain, some, some + n), n))
    index, counts = np.unique((np.concatenate(found) >> np.uint64(64 - HASH_BITS)).astype(np.int32), return_counts=True)
    return index, np.minimum(1 + np.log2(counts), MAX_VALUE).astype(np.float32)


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    threshold: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(1 << HASH_BITS, np.float32)
        out[self.index] = self.weight
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, steps: int = 400, l2: float = 1e-4, labelled: tuple[int, int] | None = None) -> Model:
    """Fit on feature arrays and 0/1 labels; ``labelled`` are the numbers of clean and toxic labels that the rows stand for."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model(np.empty(0, np.int32), np.empty(0), np.full(GRADES, 40.0))
    flat, values = (np.concatenate([r[c] for r in rows]) for c in (0, 1))
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    size = 1 << HASH_BITS
    pos = np.bincount(flat[toxic[owner]], minlength=size)
    neg = np.bincount(flat[~toxic[owner]], minlength=size)
    odds = np.log((pos + 0.5) / (toxic.sum() + 1)) - np.log((neg + 0.5) / ((~toxic).sum() + 1))
    evidence = np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    best = np.argsort(-evidence, kind="stable")[:MAX_FEATURES]
    index = np.sort(best[evidence[best] > 0]).astype(np.int32)
    strong = np.zeros(size, bool)
    strong[index] = odds[index] > 2
    hits = np.bincount(owner, weights=strong[flat] * values, minlength=len(rows))
    cuts = np.quantile(hits[toxic], [i / GRADES for i in range(1, GRADES)])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, hits, side="right"), 0)

    column = np.full(size, -1, np.int32)
    column[index] = np.arange(len(index))
    use = column[flat] >= 0
    col, row, x = column[flat[use]], owner[use], values[use]
    target = (grade[:, None] > np.arange(GRADES)[None, :]).astype(float)
    all_clean, all_toxic = labelled or ((~toxic).sum(), toxic.sum())
    share = np.where(toxic, all_toxic / toxic.sum(), all_clean / (~toxic).sum())[:, None]
    share = share / share.sum()
    w, gap = np.zeros(len(index)), np.concatenate(([1.0], np.zeros(GRADES - 1)))  # thresholds: first, then logs of the gaps
    mean, square = np.zeros(len(w) + GRADES), np.zeros(len(w) + GRADES)
    for t in range(1, steps + 1):
        b = gap[0] + np.concatenate(([0.0], np.cumsum(np.exp(gap[1:]))))
        score = np.bincount(row, weights=w[col] * x, minlength=len(rows))
        d = (_sigmoid(score[:, None] - b) - target) * share
        db = -d.sum(0)
        after = np.cumsum(db[::-1])[::-1]
        grad = np.concatenate((np.bincount(col, weights=d.sum(1)[row] * x, minlength=len(w)) + l2 * w, [after[0]], after[1:] * np.exp(gap[1:])))
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-10)
        w, gap = w - move[: len(w)], gap - move[len(w) :]
    gap[0] = max(gap[0], 0.01)
    return Model(index, w, gap[0] + np.concatenate(([0.0], np.cumsum(np.exp(gap[1:])))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most ``max_labelled`` labelled texts of each class."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    order = F.xxhash64("__id"), F.col("__id")
    picked = [known.where(F.col("__toxic") == k).orderBy(*order).limit(max_labelled) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    total = {r[0]: r[1] for r in known.groupBy("__toxic").count().collect()}
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "__id").select("__id", "__toxic", "text")
    fields = T.StructType([T.StructField("features", T.BinaryType())])
    made = append_columns(texts, "text", fields, lambda: lambda rows, _: [[_packed(t) for t in rows]], text_too=False).select("__id", "__toxic", "features")
    rows = sorted(((r[0], r[1], bytes(r[2])) for r in made.toLocalIterator()), key=lambda r: r[:2])
    return fit([_unpacked(f) for _, _, f in rows], np.array([t for _, t, _ in rows], int), labelled=(total.get(0, 0), total.get(1, 0)))


def _packed(text: bytes | None) -> bytes:
    index, values = features(text)
    return index.astype("<i4").tobytes() + values.astype("<f4").tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(raw) // 2
    return np.frombuffer(raw, "<i4", half // 4), np.frombuffer(raw, "<f4", half // 4, half)


_FIELDS = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())])


def _make(shared):
    model = shared.value
    weights = model.table()

    def run(texts, _):
        score = np.array([float((weights[index] * values).sum(dtype=np.float64)) for index, values in map(features, texts)])
        p = _sigmoid(score[:, None] - model.threshold[None, :]) if len(score) else np.empty((0, len(model.threshold)))
        return [np.round(p.sum(1), 6).tolist(), (p > 0.5).sum(1).tolist(), np.round(p[:, 0], 6).tolist(), (p[:, 0] > 0.5).tolist()]

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` plus severity (expected grade), grade (last one more likely than not), p_toxic, toxic."""
    return append_columns(docs, text_col, _FIELDS, partial(_make, docs.sparkSession.sparkContext.broadcast(model)))

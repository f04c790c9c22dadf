"""Operator 1: quality classifier by naive Bayes support vectors.

Features say which byte n-grams (one to four bytes) a whole text holds. They are scaled by the class log-count ratios
of naive Bayes, brought to unit length, and a linear hinge-loss model is fitted to them by dual coordinate descent
(Hsieh et al., 2008). Margins become probabilities by a logistic curve fitted on rows that the margin's model never saw.

The model is fitted on at most SAMPLE labelled rows and shared.FEATURES indices of n-grams (the documented bounds);
scoring covers every row and whole texts.

Defined results: a null text is empty and scored like an empty text; every row gives one row, repeated and null ids
too; without labels of both classes every score is the smoothed share of good labels; an empty table gives an empty
table. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import fold, labelled, sampled

BITS, SAMPLE, CHUNK = 18, 8_000, 1 << 20


def ngrams(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Indices of the byte n-grams that a text holds, each once; `seen` is scratch space of 2 ** BITS flags."""
    seen[:] = False
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + 3].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, 5):
            if len(part) < n:
                break
            code = (code[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            seen[((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge loss; the last weight is the bias. y is 1 or -1; rows have unit length and the bias's one."""
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            idx, x = rows[i], values[i]
            slope = y[i] * (w[idx] @ x + w[size]) - 1
            new = min(max(alpha[i] - slope / (x @ x + 1.0), 0.0), cost)
            if step := (new - alpha[i]) * y[i]:
                w[idx] += step * x
                w[size] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a margin + b))) by Newton steps on smoothed targets (Platt, 1999)."""
    good, bad = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, v = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        v = v - np.clip(np.linalg.solve(h, x.T @ (p - t) + 1e-3 * (v - [1.0, 0.0])), -2, 2)
    return float(v[0]), float(v[1])


class Model:
    """Scaled weights, their ratios, bias and curve; `prior` alone if there was nothing to learn."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        self.ok = 0 < y.sum() < len(y) and len(y) >= 10
        if not self.ok:
            return
        size, signs = 1 << BITS, np.where(y > 0, 1, -1)
        held = np.arange(len(y)) % 5 == 0
        for part in (~held, np.ones(len(y), bool)):
            counts = [np.bincount(np.concatenate([r for r, p, s in zip(rows, part, signs) if p and s == k] or [np.zeros(0, np.int32)]), minlength=size) + 1.0 for k in (1, -1)]
            self.ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
            own = [i for i in range(len(y)) if part[i]]
            self.w = dual_descent([rows[i] for i in own], [self._unit(rows[i]) for i in own], signs[own], size)
            if part is not None and not part.all():
                self.curve = logistic_curve(np.array([self.margin(rows[i]) for i in np.flatnonzero(held)]), signs[held])

    def _unit(self, idx: np.ndarray) -> np.ndarray:
        x = self.ratio[idx]
        return x / max(float(np.sqrt(x @ x)), 1e-9)

    def margin(self, idx: np.ndarray) -> float:
        return float(self.w[idx] @ self._unit(idx) + self.w[-1])

    def score(self, idx: np.ndarray) -> float:
        if not self.ok:
            return self.prior
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * self.margin(idx) + b, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled rows outside the hold-out fold; only their features reach the driver."""
    seen = np.zeros(1 << BITS, bool)
    return Model(*sampled(labelled(docs, labels, label, sample), lambda text: ngrams(text, seen), sample))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def run(batches):
        m, seen = sent.value, np.zeros(1 << BITS, bool)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(ngrams(t.as_py(), seen)) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is `least` or more)."""
    scored = score(docs, fit(docs, labels, sample=sample))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))

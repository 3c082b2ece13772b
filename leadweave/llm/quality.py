"""Ordinal quality grades by cumulative-link regression on hashed text.

One weight per hashed feature is shared by all grades, and ordered thresholds part them: P(grade > g) = logistic(score - t_g).
This gives an expected grade and, for selection, the probability of a grade above the lowest. Features are the words of a
text, their shapes, and coarse bins of how much it repeats, shouts and holds signs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadweave.llm.samples import labelled_sample
from leadweave.llm.words import U, Words, mix, slices

SLOTS = 1 << 16
#: sample rows of each grade to fit on
SAMPLE = 3000
#: probability of a grade above the lowest from which a text is selected
LEAST = 0.5
_UPPER, _DIGIT, _LETTER = (np.array([f(b) for b in range(256)]) for f in (
    lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b >= 128 or chr(b).isalpha()))


def features(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct slots of each text's features; a text without words has none."""
    w = Words(texts)
    h = w.hashes()
    share = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[w.data])])[np.stack([w.start, w.end])], axis=0)[0]
    size = w.end - w.start
    upper, digit, letter = share(_UPPER), share(_DIGIT), share(_LETTER)
    sign = size - digit - letter
    shape = np.minimum(size, 12) + 16 * (3 * upper // np.maximum(size, 1)) + 64 * np.minimum(sign, 4) + 512 * (2 * digit // np.maximum(size, 1))
    out = []
    for a, b in zip(w.at[:-1], w.at[1:]):
        n = b - a
        if not n:
            out.append(np.zeros(0, np.int64))
            continue
        total = max(1, size[a:b].sum())
        words = np.unique(h[a:b])
        # shares in tenths; the word repeated most often next to itself
        dense = [len(words) * 10 // n, upper[a:b].sum() * 10 // total, sign[a:b].sum() * 20 // total, digit[a:b].sum() * 10 // total,
                 int((h[a + 1:b] == h[a:b - 1]).sum() * 10 // n), min(12, int(np.log2(n) * 1)), total * 2 // n]
        keys = np.concatenate([words, mix(np.unique(shape[a:b]).astype(U) + U(1 << 20)), mix(np.array([(k + 1) << 40 | int(x) for k, x in enumerate(dense)], U))])
        out.append(np.unique((mix(keys) & U(SLOTS - 1)).astype(np.int64)))
    return out


@dataclass
class QualityModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; grade g + 1 or more lies above the g-th

    def scores(self, slots: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(slots))
        full = [k for k, s in enumerate(slots) if len(s)]
        if full:
            flat = np.concatenate([slots[k] for k in full])
            size = np.array([len(slots[k]) for k in full])
            out[full] = np.add.reduceat(self.weights[flat], np.cumsum(size) - size) / np.sqrt(size)
        return out

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > g) by row and g."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -50, 50)))


def train(slots: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = 12, rate: float = 0.15, ridge: float = 1e-6) -> QualityModel:
    """Stochastic gradients of the cumulative-link likelihood with per-weight steps; grades weigh the same."""
    model = QualityModel(np.zeros(SLOTS), np.linspace(-1, 1, n_grades - 1) if n_grades > 2 else np.zeros(max(0, n_grades - 1)))
    keep = [k for k, s in enumerate(slots) if len(s)]
    if n_grades < 2 or not keep:
        return model
    count = np.bincount(grades, minlength=n_grades)
    weight = len(grades) / (n_grades * np.maximum(count, 1))
    seen, seen_t = np.full(SLOTS, 1e-3), np.full(n_grades - 1, 1e-3)
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(keep):
            s, y = slots[k], grades[k]
            z = model.weights[s].sum() / np.sqrt(len(s))
            above = np.concatenate([[1.0], 1 / (1 + np.exp(-np.clip(z - model.thresholds, -30, 30))), [0.0]])
            p = max(above[y] - above[y + 1], 1e-6)
            slope = above * (1 - above)
            g = -weight[y] * (slope[y] - slope[y + 1]) / p
            step = g / np.sqrt(len(s)) + ridge * model.weights[s]
            seen[s] += step * step
            model.weights[s] -= rate * step / np.sqrt(seen[s])
            for j, sign in ((y - 1, 1), (y, -1)):
                if 0 <= j < n_grades - 1:
                    gt = weight[y] * sign * slope[j + 1] / p
                    seen_t[j] += gt * gt
                    model.thresholds[j] -= rate * gt / np.sqrt(seen_t[j])
            model.thresholds.sort()
    return model


def fit(docs: DataFrame, labels: DataFrame, grade: Column | None = None, n_grades: int = 3, per_grade: int = SAMPLE) -> QualityModel:
    """Learn from at most per_grade rows of each grade 0 .. n_grades - 1; other grades and nulls have no part.

    The usual grade is 0 for poor text, 1 for good text that is toxic, 2 for other good text. Without two grades in the
    sample every text gets the same probabilities.
    """
    if grade is None:
        grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    sample = labelled_sample(docs, labels, F.when(grade.between(0, n_grades - 1), grade), per_grade)

    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(features(batch.column(1)), pa.list_(pa.int64()))], names=["id", "label", "slots"])

    rows = sample.mapInArrow(run, "id long, label int, slots array<long>").collect()
    rows.sort(key=lambda r: (r["id"], r["slots"]))
    return train([np.array(r["slots"], np.int64) for r in rows], np.array([r["label"] for r in rows], np.int64), n_grades)


def grade_texts(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST) -> DataFrame:
    """One row per row of docs: id, expected_grade, tail_probability, selected.

    tail_probability: of a grade above the lowest; selected if it is ``least`` or more. A text that is null or has no word is
    graded 0 with probability 0. Only the id and the text are read; ids may be null or repeated, and repeated rows are graded alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "text"):
            slots = features(batch.column(1))
            tails = shared.value.tails(shared.value.scores(slots))
            tails[[not len(s) for s in slots]] = 0
            first = tails[:, 0] if tails.shape[1] else np.zeros(len(slots))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(first), pa.array(first >= least)],
                                             names=["id", "expected_grade", "tail_probability", "selected"])

    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, expected_grade double, tail_probability double, selected boolean").withColumnRenamed("id", id_column)

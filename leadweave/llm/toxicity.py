"""Insults by a support vector machine on a gapped subsequence kernel, with Nystroem landmarks.

The kernel of two words counts the three-letter subsequences that they share; one that spans n letters counts DECAY ** n, for
spans up to SPAN, in each word. So letters put between those of an insult lower its score a little and don't hide it. Word ends
are letters too, and single letters set apart by blanks are read as one word.

Training: words that are witnesses for toxic sample rows (a greedy cover, each word as good as absent from clean rows) against
words of clean rows. Sentences of clean rows that a first machine finds worst give the hard examples of the second. A row is scored by
its worst word, a sentence being as bad as its worst word, and a logistic curve on the sample turns that into a probability.

A kernel expansion over landmarks is linear in the subsequences, so the machine is one table of their weights, of fixed size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadweave.llm.samples import labelled_sample, training_ids
from leadweave.llm.tables import table
from leadweave.llm.words import U, Words, mix, signed, slices

SPAN, DECAY = 5, 0.7
#: slots of the weight table, landmarks of either kind, rows of the sample of either label, clean words to train on
SLOTS, LANDMARKS, SAMPLE, CLEAN_WORDS = 1 << 18, 150, 4000, 6000
THRESHOLD = 0.3
PEERS = 3
_SIGNS = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def close_up(texts: pa.Array) -> Words:
    """Words in lower case, without ASCII signs, and without the blanks between single letters."""
    w = Words(texts, lower=True)
    text = np.repeat(np.arange(len(w.at) - 1), np.diff(w.at))
    one = w.end - w.start == 1
    k = np.flatnonzero(one[:-1] & one[1:] & (text[:-1] == text[1:])) if len(one) else np.zeros(0, int)
    edge = np.zeros(len(w.data) + 1, np.int32)
    np.add.at(edge, w.end[k], 1)
    np.add.at(edge, w.start[k + 1], -1)
    keep = (np.cumsum(edge[:-1]) == 0) & ~_SIGNS[w.data]
    before = np.concatenate([[0], np.cumsum(keep)])[w.bounds].astype(np.int64)
    return Words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(before), pa.py_buffer(w.data[keep].tobytes())))


class Subsequences:
    """Weighted subsequences of words given as places in data."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start + 2
        first = np.cumsum(size) - size
        letters = np.full(size.sum() + SPAN, 0x20, np.uint8)
        word = np.repeat(np.arange(len(size)), size)
        inner = np.arange(len(word)) - first[word]
        self.left = size[word] - inner  # letters from here to the word's end
        body = (inner > 0) & (self.left > 1)
        letters[:len(word)][body] = data[(start[word] + inner - 1)[body]]
        self.letters, self.first, self.n = letters.astype(U), first, len(word)
        norm = np.zeros(size.max(initial=0) + 1)
        for a, b in _PAIRS:
            norm += DECAY ** (2 * (b + 1)) * np.maximum(np.arange(len(norm)) - b, 0)
        self.scale = 1 / np.sqrt(np.maximum(norm[size], 1e-9))

    def each(self):
        """(slot, weight, valid) of all places, one pair of gaps at a time."""
        c = self.letters
        for a, b in _PAIRS:
            key = c[:self.n] | c[a:a + self.n] << U(8) | c[b:b + self.n] << U(16)
            yield (mix(key) & U(SLOTS - 1)).astype(np.int64), DECAY ** (b + 1), self.left > b

    def dot(self, table: np.ndarray) -> np.ndarray:
        """Each word's normalised features times a table of SLOTS rows."""
        total = np.zeros((self.n, *table.shape[1:]), np.float64)
        for slot, weight, valid in self.each():
            total += np.where(valid.reshape(-1, *[1] * (table.ndim - 1)), weight * table[slot], 0)
        return (np.add.reduceat(total, self.first) if self.n else total).T.__mul__(self.scale).T


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(r) for r in raw])
    return np.frombuffer(b"".join(raw), np.uint8), end - [len(r) for r in raw], end


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    table = np.zeros((SLOTS, len(landmarks)), np.float32)
    of = Subsequences(*_places(landmarks))
    mark = np.repeat(np.arange(len(landmarks)), np.diff(np.append(of.first, of.n)))
    for slot, weight, valid in of.each():
        np.add.at(table, (slot[valid], mark[valid]), weight * of.scale[mark[valid]])
    used = np.unique(np.flatnonzero(table.any(1)))
    out = [Subsequences(*_places(words[k:k + 200])).dot(table) for k in range(0, len(words), 200)]
    assert len(used) <= SLOTS
    return np.concatenate(out) if out else np.zeros((0, len(landmarks)))


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by slot
    bias: float
    slope: float = 4.0
    shift: float = 0.0

    def words(self, data, start, end) -> np.ndarray:
        return Subsequences(data, start, end).dot(self.weights) + self.bias

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """Decision and worst word of each text; -9 without words."""
        w = close_up(texts)
        out, worst = np.full(len(texts), -9.0), [""] * len(texts)
        if len(w.start):
            _, one, of = np.unique(w.hashes(), return_index=True, return_inverse=True)
            each = self.words(w.data, w.start[one], w.end[one])[of]
            full = np.flatnonzero(np.diff(w.at))
            out[full] = np.maximum.reduceat(each, w.at[full])
            for k in full:
                worst[k] = w.text(w.at[k] + int(each[w.at[k]:w.at[k + 1]].argmax())).decode(errors="replace")
        return out, worst

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(self.slope * decision + self.shift), -50, 50)))


def train(bad: list[str], clean: list[str]) -> ToxicityModel:
    """A squared-hinge machine on Nystroem features, by accelerated gradient steps; both kinds weigh the same."""
    marks = list(dict.fromkeys([*bad[:LANDMARKS], *clean[:LANDMARKS]]))
    words, y = [*bad, *clean], np.repeat([1.0, -1.0], [len(bad), len(clean)])
    inner = kernel(marks, marks)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
    x = np.column_stack([kernel(words, marks) @ root, np.ones(len(words))])
    weight = np.where(y > 0, 0.5 / max(1, len(bad)), 0.5 / max(1, len(clean)))
    ridge = 2e-5
    step = 1 / (2 * np.linalg.norm((x.T * weight) @ x, 2) + ridge)
    v = last = np.zeros(x.shape[1])
    for k in range(800):
        ahead = v + k / (k + 3) * (v - last)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        last, v = v, ahead - step * (ridge * ahead - 2 * x.T @ (weight * y * slack))
    # one table of subsequence weights stands for the expansion over landmarks
    beta, table = root @ v[:-1], np.zeros(SLOTS)
    of = Subsequences(*_places(marks))
    mark = np.repeat(np.arange(len(marks)), np.diff(np.append(of.first, of.n)))
    for slot, w, valid in of.each():
        np.add.at(table, slot[valid], w * (of.scale * beta)[mark[valid]])
    return ToxicityModel(table, float(v[-1]))


def witnesses(rows: list[tuple[int, list[str]]], least: int) -> list[str]:
    """Words that cover the toxic rows, the one in most rows not yet covered again and again; then the other suspects.

    The rare words of a row with many near copies all stand in the same rows: a word that PEERS others follow in half of its
    rows is no suspect.
    """
    holders: dict[str, set[int]] = {}
    for i, ws in rows:
        for w in ws:
            holders.setdefault(w, set()).add(i)
    words, place = sorted(holders), {i: k for k, (i, _) in enumerate(rows)}
    held = np.zeros((len(words), len(rows)), np.float32)
    for k, w in enumerate(words):
        held[k, [place[i] for i in holders[w]]] = 1
    both = held @ held.T
    size = held.sum(1)
    peers = (both >= 0.5 * (size[:, None] + size[None, :] - both)).sum(1) - 1
    holders = {w: holders[w] for k, w in enumerate(words) if peers[k] < PEERS}
    left, out = {i for i, _ in rows}, []
    while holders and left:
        word = max(sorted(holders), key=lambda w: len(holders[w] & left))
        got = holders.pop(word) & left
        if len(got) < least:
            holders[word] = got
            break
        out.append(word)
        left -= got
    return (out + sorted(holders, key=lambda w: (-len(holders[w]), w)))[:LANDMARKS]


def _distinct_words(batches):
    """(id, label, family, distinct words) of sample rows; near copies mostly have one family, the smallest hash of their words."""
    for batch in slices(batches, "text"):
        w, out, family = close_up(batch.column(1)), [], []
        h = signed(w.hashes())
        for a, b in zip(w.at[:-1], w.at[1:]):
            family.append(int(h[a:b].min()) if b > a else 0)
            out.append(sorted({w.text(k).decode(errors="replace") for k in range(a, b)}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(family, pa.int64()), pa.array(out, pa.list_(pa.string()))],
                                         names=["key", "label", "family", "words"])


def _decide(model):
    def run(batches):
        for batch in slices(batches, "text"):
            decision, worst = model.value.texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(decision), pa.array(worst, pa.string())], names=["label", "decision", "worst"])
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE) -> ToxicityModel:
    """Learn from at most per_class distinct texts of either label; without both labels all texts score near zero."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, F.col(label), per_class)
    sample = sample.groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("key", "text", "label")
    sample = table(sample, "sample")
    words = sample.mapInArrow(_distinct_words, "key long, label int, family long, words array<string>")
    count = (words.select("label", "family", F.explode("words").alias("word")).groupBy("word")
             .agg(F.countDistinct(F.when(F.col("label") == 1, F.col("family"))).alias("bad"), F.count_if(F.col("label") == 0).alias("clean")))
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return ToxicityModel(np.zeros(SLOTS), -2.0)
    # rows that a word needs so that, of all words, hardly one is in so many toxic rows and no others by chance
    share = totals[1] / (totals[0] + totals[1])
    least = max(4, math.ceil(math.log(20 * max(1, count.count())) / -math.log(share)))
    suspects = (count.where((F.col("bad") >= least) & (F.col("clean") * totals[1] * 20 <= F.col("bad") * totals[0]))
                .orderBy(F.desc("bad"), "word").limit(4 * LANDMARKS))
    rows = (words.where("label = 1").select("key", F.explode("words").alias("word")).join(F.broadcast(suspects.select("word")), "word")
            .groupBy("key").agg(F.collect_set("word").alias("words")).collect())
    bad = witnesses([(r["key"], sorted(r["words"])) for r in rows], least)
    clean = [r["word"] for r in count.where("clean > 0").select("word").orderBy(F.xxhash64("word")).limit(CLEAN_WORDS).collect()]
    clean = [w for w in clean if w not in set(bad)]
    if not bad or not clean:
        return ToxicityModel(np.zeros(SLOTS), -2.0)
    model = train(bad, clean)
    for _ in range(2):
        scored = sample.mapInArrow(_decide(spark.sparkContext.broadcast(model)), "label int, decision double, worst string").collect()
        hard = sorted({r["worst"] for r in scored if r["label"] == 0} - set(bad))
        clean = list(dict.fromkeys([*hard, *clean]))
        model = train(bad, clean)
    scored = sample.mapInArrow(_decide(spark.sparkContext.broadcast(model)), "label int, decision double, worst string").collect()
    x, y = np.array([r["decision"] for r in scored]), np.array([r["label"] for r in scored], float)
    # the sample holds either label in other shares than the labels do
    share = training_ids(labels, F.col(label)).agg(F.avg("label")).first()[0]
    model.slope, model.shift = _curve(np.maximum(x, -3), y, share)
    return model


def _curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by damped Newton steps; ``share``: of rows labelled 1."""
    w, v = np.where(y > 0, share / y.sum(), (1 - share) / (1 - y).sum()), np.array([1.0, 0.0])
    z = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        h = (z.T * (w * p * (1 - p))) @ z + 1e-6 * np.eye(2)
        v = v - np.clip(np.linalg.solve(h, z.T @ (w * (p - y)) + 1e-6 * v), -2, 2)
    return float(max(v[0], 0.1)), float(v[1])


def score(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, score, predicted, worst.

    Only the id and the text are read, the whole of it. A null or empty text, or one of blanks, has no word and scores next to
    zero, like all texts if nothing was learned. Repeated rows score alike; ids may be null or repeated. ``worst``: the first
    of the words with the highest decision.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "text"):
            decision, worst = shared.value.texts(batch.column(1))
            p = shared.value.probability(decision)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(worst, pa.string())],
                                             names=["id", "score", "predicted", "worst"])

    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, score double, predicted int, worst string").withColumnRenamed("id", id_column)

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from leadweave.llm import negatives
from leadweave.llm.vectors import products, whole_matrices

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, label int, embedding array<float>, score long, id string, anchor int"


def mined(rows, is_anchor, positives=5, taken=5, percent=80):
    fine = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, l, v in rows
            if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({r[0] for r in fine if is_anchor(r[0])}):
        _, label, own = min(r for r in fine if r[0] == a)
        scored = sorted({(-sum(x * y for x, y in zip(own, v)), i, l == label) for i, l, v in fine if i != a and len(v) == len(own)})
        for less, p, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and percent * -less <= 100 * -s[0] <= 100 * -less]
            out += [(a, p, k, i, -less, -s) for k, (s, i, _) in enumerate(fit[:taken], 1)]
    return sorted(out)


def run(spark, rows, is_anchor, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    ids = spark.createDataFrame([(r[0],) for r in rows if r[0] is not None and is_anchor(r[0])] or [(-1,)], "vec_id long").distinct()
    return sorted(tuple(r) for r in negatives.hard_negatives(df, df.join(ids, "vec_id", "left_semi"), **more).collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    r = random.Random(seed)
    rows = [(i, r.choice([1, 1, 1, 2, 3]), [r.choice([0.0, 0.25, 0.5, r.random(), -r.random()]) for _ in range(3)]) for i in range(300)]
    rows += [rows[4]] * 50 + [(i, 1, rows[5][2]) for i in range(400, 440)] + [(i, 2, rows[5][2]) for i in range(440, 480)]
    rows += [(500, 1, None), (501, None, [1.0, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (510, 1, [NAN, 1.0, 1.0]), (520, 2, [INF, 1.0, 1.0]),
             (530, 2, [None, 1.0, 1.0]), (540, 1, []), (550, 1, [1.0]), (551, 2, [0.9]), (552, 1, [0.95])]
    monkeypatch.setattr(negatives, "ROWS", 100)
    monkeypatch.setattr(negatives, "ANCHORS", 10)
    assert run(spark, rows, lambda i: i % 10 == 0) == mined(rows, lambda i: i % 10 == 0)
    assert run(spark, rows, lambda i: i % 10 == 0, positives=2, negatives=1, percent=95) == mined(rows, lambda i: i % 10 == 0, 2, 1, 95)


def test_ties_zero_and_negative_scores(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 2, [0.0, 3.0]), (3, 2, [-1.0, 0.0]), (4, 1, [-1.0, 5.0]), (5, 2, [0.5, 0.0]), (6, 1, [0.5, 1.0]), (9, 2, [0.5, 9.0])]
    got = run(spark, rows, lambda i: i == 0)
    assert got == mined(rows, lambda i: i == 0)
    assert [(g[1], g[3]) for g in got] == [(1, 2), (6, 5), (6, 9)]


def test_empty_tables_and_no_anchor(spark):
    rows = [(1, 1, [1.0]), (2, 2, [1.0])]
    assert run(spark, rows, lambda i: False) == []
    df = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(df, df).collect() == []


def test_matrices_and_products_are_exact():
    got = list(whole_matrices(pa.array([[0.5, -0.5], None, [], [1.0, None], [NAN, 1.0], [1.0], [0.001, 3.0]], pa.list_(pa.float32())), 256))
    assert [(r.tolist(), x.tolist()) for r, x in got] == [([2], [[]]), ([5], [[256.0]]), ([0, 6], [[128.0, -128.0], [0.0, 768.0]])]
    big = np.array([[float(2 ** 40), 1.0]])
    assert products(big, big).tolist() == [[2 ** 63 - 1]] and products(np.array([[float(2 ** 30), 1.0]]), np.array([[float(2 ** 30), 1.0]])).tolist() == [[2 ** 60 + 1]]


def test_iterator_holds_windows_across_batches():
    rows = [(1, -100, 0, 7), (1, -100, 1, 3), (1, -90, 0, 8), (1, -85, 1, 4), (1, -75, 1, 5), (1, -60, 1, 6), (2, -50, 1, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k]]) for k in range(4)], names=list("abcd")) for r in rows]
    got = [tuple(r.values()) for b in negatives._mine(5, 5, 80)(iter(batches)) for r in b.to_pylist()]
    assert got == [(1, 7, 1, 3, 100, 100), (1, 7, 2, 4, 100, 85), (1, 8, 1, 4, 90, 85), (1, 8, 2, 5, 90, 75)]

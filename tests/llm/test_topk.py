import math
import random

from leadweave.llm import topk
from leadweave.llm.topk import nearest


def brute(rows, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = list({(i, tuple(v)): (i, v) for i, v in whole}.values())
    out = set()
    for i, q in whole:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))
            out |= {(i, n + 1, j, -p) for n, (p, j) in enumerate(s[:k])}
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 100)
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = random.Random(1)
    rows = [(i, [r.choice([r.gauss(0, 1), 0.0, 0.5]) for _ in range(7)]) for i in range(700)]
    rows += [(i, [0.25] * 7) for i in range(700, 760)] + rows[:5] + [(1000, [1e9, -3e9, 1.0, 0.0, 0.0, 0.0, 0.0]), (1050, [1.0, 2.0]), (1051, [2.0, 1.0])]
    rows += [(1100, None), (1150, [None] * 7), (1200, [math.nan] * 7), (1250, [math.inf] * 7), (None, [1.0] * 7), (1300, [])]
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<double>, part int").repartition(5)
    got = {tuple(x) for x in nearest(df, df.where("vec_id % 50 = 0")).collect()}
    assert got == brute(rows, 5)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 131072)]
    assert nearest(df.where("false"), df.where("false")).collect() == []


def test_a_row_repeated_very_often_leaves_room_for_others(spark):
    rows = [(0, [1.0])] + [(1, [1000.0])] * 3000 + [(2, [999.999])] * 3000 + [(2, [999.9989])] * 9 + [(i, [float(i)]) for i in range(3, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    assert {tuple(x) for x in nearest(df, df.where("vec_id = 0")).collect()} == brute(rows, 5)

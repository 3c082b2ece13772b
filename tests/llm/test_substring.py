import hashlib
import random

import numpy as np
import pytest

import brute
from leadweave.llm.substring import remove_repeats, window_hashes
from leadweave.llm.words import U, _WINDOW as WINDOW_FACTOR


def texts(seed):
    r = random.Random(seed)
    fresh = lambda n: [f"w{r.randrange(10 ** 9)}" for _ in range(n)]
    passages = [fresh(r.choice([30, 34, 35, 36, 50, 90])) for _ in range(8)]
    out = []
    for _ in range(60):
        words = []
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            words += fresh(r.randrange(40)) + p[r.randrange(3):] + fresh(r.randrange(9))
        out.append(r.choice([" ", "\n", "\t "]).join(words))
    out += out[:9] + [None, "", " ", "a " * 34, "a " * 35, "b " * 37, "É " * 36, "c d " * 4000, " ".join(passages[0]) + "!"]
    return out


@pytest.mark.parametrize("n", [35, 6])
def test_equals_brute_force(spark, n):
    t = texts(n)
    df = spark.createDataFrame([(i % 50 or None, x, "z", i) for i, x in enumerate(t)], "doc_id long, text string, key string, place int")
    got = sorted(tuple(r) for r in df.transform(remove_repeats, n).select("n_words", "n_removed", "kept_text", "kept_sha256").collect())
    want = sorted((a, b, c, hashlib.sha256(c.encode()).hexdigest()) for a, b, c in brute.remove_repeats(t, n))
    assert got == want
    assert sum(x[1] for x in want) > 500


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).collect() == []


def test_both_halves_of_a_window_hash_count():
    # words that collide in the plain window hash: the first differs by what the factor makes of the second
    a, b = np.array([5, 7, 11, 13], U), np.array([5, 7, 11, 13], U)
    with np.errstate(over="ignore"):
        b[0] += WINDOW_FACTOR
        b[1] -= U(1)
    one, two = window_hashes(a, 4), window_hashes(b, 4)
    assert one[0][0] == two[0][0] and one[1][0] != two[1][0]

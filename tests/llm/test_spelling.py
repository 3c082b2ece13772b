import random
import re
import zlib
from collections import Counter

import pytest

from leadweave.llm import spelling
from leadweave.llm.queries import QUERIES, with_slips

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_counts(docs):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def brute(n):
    """Rows by comparing words that share all but one code point, found by plain deletion."""
    holes, found = {}, {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            holes.setdefault(w[:k] + w[k + 1:], []).append(w)
    for hole, ws in holes.items():
        for a in ws + ([hole] if hole in n else []):
            found[a] |= {b for b in ws + ([hole] if hole in n else []) if near(a, b)}
    form = {w: min(found[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n[w], len(found[w]), n[form[w]] if form[w] else -1) for w in n)


def rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


@pytest.mark.parametrize("frequent", [0, 2, 10, 10_000])
def test_variants_equal_brute_force(spark, frequent):
    r = random.Random(frequent)
    letters = "abé"
    n = {"".join(r.choice(letters) for _ in range(r.choice([2, 4, 5, 6, 7]))): r.randint(1, 90) for _ in range(600)}
    for w in list(n)[:200]:
        k = r.randrange(len(w))
        n[r.choice([w[:k] + w[k + 1:], w[:k] + "c" + w[k:], w[:k] + "ÿ" + w[k + 1:], w + w])] = r.randint(1, 90)
    n |= {"x" * 3000: 5, "x" * 3001: 50, "x" * 1500 + "y" + "x" * 1500: 500, "ab": 7, "zzzz": 7, "zzzzz": 14, "ZZZZ": 28}
    n.pop("", None)
    df = spark.createDataFrame([(w, c, "k", 1) for w, c in n.items()], "word string, n long, form string, rank int")
    assert rows(spelling.variants(df, frequent=frequent)) == brute({w: c for w, c in n.items() if len(w) >= 4})


def test_bound_counts_the_grams_that_an_edit_touches():
    frequent = {"^a", "ab", "abc", "bc"}
    grams = spelling.decompose("abcd", frequent)
    assert grams == ["^ab", "abcd", "bcd", "cd", "d$"] and spelling.affected(grams) == 4
    assert spelling.affected(spelling.decompose("q", set())) == 2


def test_nulls_repeated_words_and_empty_tables(spark):
    df = spark.createDataFrame([("alpha", 2), ("alpha", 3), ("alpho", 10), (None, 4), ("", 5), ("gamma", None)], "word string, n long")
    assert rows(spelling.variants(df)) == [("alpha", "alpho", "alpho", 5, 1, 10), ("alpho", "", "alpho", 10, 1, -1)]
    assert spelling.variants(df.where("false")).collect() == []


def test_chains_are_followed_to_the_root(spark):
    n = {"a" * 5 + "b" * k: 3 * 2 ** k for k in range(20)}
    assert {x[2] for x in rows(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))} == {"a" * 5 + "b" * 19}


def test_words_of_texts(spark):
    docs = [(None, "Über ÜBER straße"), (1, None), (2, ""), (3, "x1y don't ×÷ naïve NAÏVE")] + [(k, "Wonderful words of wisdom") for k in range(400)]
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in docs], "doc_id long, text string, run string, h int")
    got = {r["word"]: r["n"] for r in spelling.count_words(with_slips(spelling.runs(df))).collect()}
    assert got == brute_counts(docs) and len(got) > 3


def test_query_on_the_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = QUERIES["op12_spelling"](spark, sf)
    assert df.columns[:6] == COLUMNS and dict(df.dtypes)["n_near"] == "bigint"
    assert rows(df) == brute(brute_counts(docs))

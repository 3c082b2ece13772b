"""Learned operators: held-out accuracy on the tables, and odd inputs."""

import pytest
from pyspark.sql import functions as F

from leadweave.llm import langid, quality, toxicity
from leadweave.llm.tables import held_out

ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 456 !!"), (None, "word"), (7, "same text"), (7, "same text"), (8, "İ \U0001F600 ñ ß"), (9, "ab " * 50_000)]


@pytest.fixture(scope="module")
def tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, spark.read.parquet(f"{sf}/labels.parquet"), docs.where(~held_out(F.col("doc_id")))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 5) for r in ODD], "doc_id long, text string, lang string, score int")


def test_language(spark, tables, odd):
    docs, _, learn = tables
    model = langid.fit(learn)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id")))
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 150 and right / n > 0.97
    rows = langid.identify(odd, model).collect()
    assert sorted(r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 4)) == ["und"] * 4 and len(rows) == len(ODD)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(docs.where("false"))).collect()} == {"und"}
    assert langid.identify(odd.where("false"), model).collect() == []


def test_automaton_knows_exactly_the_substrings():
    text = [1, 2, 1, 3, 1, 2, 1, 1]
    go = langid.suffix_automaton(text)
    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    import itertools

    for n in (1, 2, 3, 4):
        for word in itertools.product((1, 2, 3), repeat=n):
            state = 0
            for c in word:
                state = go[state].get(c) if state is not None else None
            assert (state is not None) == (word in subs)


def test_parse_equals_greedy_parse():
    model = langid.LanguageModel.of({"a": "the cat sat on the mat", "b": "le chat est sur la table"})
    for text in ["the mat sat", "zzz cat", "a" * 3000, "le chat the", "x"]:
        plain = "".join(map(chr, langid._plain(text)))
        for k, sample in enumerate(["the cat sat on the mat", "le chat est sur la table"]):
            n = 0
            for at in range(0, len(plain), langid.SEGMENT):
                piece, i = plain[at:at + langid.SEGMENT], 0
                while i < len(piece):
                    j = i + 1
                    while j < len(piece) and piece[i:j + 1] in sample:
                        j += 1
                    n, i = n + 1, j
            assert abs(model.bits([text])[0][0, k] - n * model.weights[k] / len(plain)) < 1e-9


def test_toxicity(spark, tables, odd):
    docs, labels, _ = tables
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    rows = got.select("toxic", "predicted").collect()
    right = sum(r["toxic"] == r["predicted"] for r in rows)
    assert len(rows) > 60 and right / len(rows) > 0.93
    gapped = spark.createDataFrame([(1, "a m.o.r.o.n here"), (2, "you mo-ron"), (3, "i d i o t thing"), (4, "what disgus_ting things"), (5, "the and of that is with")], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score(gapped, model).orderBy("doc_id").collect()] == [1, 1, 1, 1, 0]
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    blank = toxicity.fit(docs, labels.where("false"))
    assert all(r["predicted"] == 0 for r in toxicity.score(odd, blank).collect())
    assert toxicity.score(odd.where("false"), model).collect() == []


def test_toxicity_learns_nothing_from_held_out_labels(spark, tables):
    docs, labels, _ = tables
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift) and (a.weights == b.weights).all()


def test_quality(spark, tables, odd):
    docs, labels, _ = tables
    model = quality.fit(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = quality.grade_texts(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("quality", "selected", "expected_grade").collect()
    good = [r["expected_grade"] for r in rows if r["quality"] == 1]
    poor = [r["expected_grade"] for r in rows if r["quality"] == 0]
    assert sum(a > b for a in good for b in poor) / (len(good) * len(poor)) > 0.9
    assert sum(r["selected"] for r in rows if r["quality"] == 1) / len(good) > 0.95
    rows = quality.grade_texts(odd, model).collect()
    assert len(rows) == len(ODD) and all(r["tail_probability"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert quality.grade_texts(odd, quality.fit(docs, labels.where("false"))).count() == len(ODD)
    assert quality.grade_texts(odd.where("false"), model).collect() == []


def test_kernel_equals_plain_gapped_subsequences():
    import itertools
    import math

    def plain(word):
        letters, out = f" {word} ", {}
        for i, j, k in itertools.combinations(range(len(letters)), 3):
            if k - i < toxicity.SPAN:
                key = letters[i] + letters[j] + letters[k]
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    def norm(word):  # of the places, as if no three letters occurred twice
        letters = f" {word} "
        return math.sqrt(sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, _, k in itertools.combinations(range(len(letters)), 3) if k - i < toxicity.SPAN))

    words, marks = ["moron", "moxron", "m", "ab", "banana", "idiot", "completely"], ["moron", "idiot", "ban"]
    got = toxicity.kernel(words, marks)
    for (a, u), (b, v) in itertools.product(enumerate(words), enumerate(marks)):
        x, y = plain(u), plain(v)
        want = sum(w * y.get(key, 0) for key, w in x.items()) / (norm(u) * norm(v)) if x else 0
        assert abs(got[a, b] - want) < 1e-5, (u, v)


def test_grades_equal_the_plain_cumulative_link():
    import math

    import numpy as np
    import pyarrow as pa

    texts = ["A first text of some words", "", None, "SHOUTING!!! 123 123 123", "one", "the same the same the same"] * 3
    slots = quality.features(pa.array(texts))
    assert all((a == quality.features(pa.array([t]))[0]).all() for a, t in zip(slots, texts))
    model = quality.QualityModel(np.random.default_rng(1).normal(size=quality.SLOTS), np.array([-0.4, 0.7]))
    score, tails = model.scores(slots), model.tails(model.scores(slots))
    for s, z, t in zip(slots, score, tails):
        want = sum(model.weights[k] for k in s) / math.sqrt(len(s)) if len(s) else 0.0
        assert abs(z - want) < 1e-9 and all(abs(t[g] - 1 / (1 + math.exp(model.thresholds[g] - want))) < 1e-9 for g in range(2))
    full = [s for s in slots if len(s)]
    grades = np.array([k % 3 for k in range(4)] * 3)[:len(full)]
    fitted = quality.train(full, grades, 3)

    def likelihood(m):
        above = np.column_stack([np.ones(len(full)), m.tails(m.scores(full)), np.zeros(len(full))])
        return sum(math.log(max(above[k, g] - above[k, g + 1], 1e-12)) for k, g in enumerate(grades))
    assert likelihood(fitted) > likelihood(quality.train([], grades[:0], 3)) and list(fitted.thresholds) == sorted(fitted.thresholds)

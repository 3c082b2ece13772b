"""The registered queries: check SQL where there is any, and the pipeline against plain restatements of its stages."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
import test_line_dedup
import test_packing
from leadweave.llm import langid
from leadweave.llm.queries import ORACLE, QUERIES
from leadweave.session import scratch_dir

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from oracle_check import compare, connect  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_check(spark, sf, name):
    assert compare(spark, connect(sf), sf, QUERIES[name], ORACLE[name]) == ""


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, len(QUERIES) + 1)] and len(QUERIES) >= 10
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "packing"]


def test_substring_and_license_queries_on_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op7_substring"](spark, sf).collect()}
    want = brute.remove_repeats([t for _, t in rows], 35)
    assert [(got[d]["n_words"], got[d]["n_removed"]) for d, _ in rows] == [(a, b) for a, b, _ in want]
    import test_license_scan

    got = {r["doc_id"]: r for r in QUERIES["op1_license_scan"](spark, sf).collect()}
    for d, t in rows:
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == test_license_scan.brute(t)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def small_corpus(spark):
    r = random.Random(9)
    syllables = {"en": "the ing er on and wh".split(), "de": "ung sch ein keit ver zu".split()}
    word = lambda lang: "".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n))
    item = line("en", 30)
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append((i, "\n".join(["shared banner line"] * (i % 2) + [line(lang, 25) for _ in range(3)]), lang, f"src{i % 12}"))
    base = rows[5][1].split(" ")
    for i in range(60, 80):  # copies that drift apart
        base = list(base)
        base[r.randrange(len(base))] = "new"
        rows.append((i, " ".join(base), "en", f"src{i % 12}"))
    rows += [(80, rows[7][1] + " " + item + " end", "en", "src1"), (81, None, None, None), (82, "", "en", "src2"), (83, "12 34 !!", None, "src3")]
    rows += [(84 + k, "shared banner line", "en", f"src{k}") for k in range(10)]
    root = scratch_dir(spark, "corpus")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item), (2, line("de", 30))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, item


def test_pipeline_equals_its_stages_by_brute_force(spark):
    root, rows, item = small_corpus(spark)
    docs = [(d, t, s) for d, t, _, s in rows if t and any(c.isalpha() for c in t)]
    source = {d: s for d, _, s in docs}
    docs = [(d, t) for d, _, gone, t in test_line_dedup.brute(docs, 8) if not gone or t.strip()]
    kept = brute.near_duplicates(docs)
    docs = [(d, t) for d, t in docs if kept[d][2]]
    docs = [(d, t) for d, t in docs if item not in t]
    out = corpus_pipeline.run(spark, root)
    test_packing.check(out.collect(), dict(zip([d for d, _ in docs], test_packing.whole_ids([t for _, t in docs]))))
    assert 40 < len(docs) < 66 and source


def test_stages_keep_columns_and_take_empty_tables(spark):
    root, _, _ = small_corpus(spark)
    docs = spark.read.parquet(f"{root}/documents.parquet").withColumn("extra", F.lit(3)).withColumn("key", F.lit("k"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, root).dtypes == docs.dtypes, name
        assert stage(spark, docs.where("false"), root).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), root).collect() == []
    assert langid.UNKNOWN == "und"


def test_stages_take_null_ids_and_repeated_rows(spark):
    root, rows, item = small_corpus(spark)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    again = docs.where("doc_id in (5, 7, 81, 82, 80)")
    unnamed = docs.where("doc_id in (6, 80, 81)").withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string"))
    odd = docs.unionByName(again).unionByName(unnamed)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, root).groupBy("doc_id").count().collect()
        n = {r["doc_id"]: r["count"] for r in out}
        assert all(n.get(d, 2) == 2 for d in (5, 7, 80, 81, 82)) and n.get(None, 0) <= 3, name
        if name in ("near_duplicates", "benchmark"):
            assert n[None] == 3, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd, root).where("start = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in pieces if r["doc_id"] in (None, 5, 9)} == {None: 3, 5: 2, 9: 1}

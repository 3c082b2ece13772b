import re

from leadweave.llm import license_scan as L

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(L.WORD, text)
    at = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    "Released under the MIT License.", "UNDER\nthe-mit_license, then under the mit license again", "under the mit  licenses", "under the K mit license",
    "Licensed under CC BY-NC 4.0. Apache License, Version 2.0", "cc by nc cc by nc", "apache license version 20", "mit license", "ccé by nc",
    None, "", "...", "mit " * 3000 + "under the mit license", "É under the MIT license Ünder", "This work is licensed under the GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "the GNU General Public License version 2", "license version 2 apache",
]


def test_base_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate([*TEXTS, TEXTS[0]])], "doc_id long, text string, _words int, labels string")
    rows = {r["doc_id"]: r for r in L.scan_licenses(df).collect()}
    for i, t in enumerate([*TEXTS, TEXTS[0]]):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == (r["labels"] != "")
    assert [rows[i]["labels"] for i in (14, 15, 16)] == ["gpl-3", "mit-text", "gpl-2"]


def test_no_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "under the mit license")] * 2, "doc_id long, text string")
    assert [r["labels"] for r in L.scan_licenses(df).collect()] == ["mit"] * 2
    assert L.scan_licenses(df.where("false")).collect() == []


def test_no_python_on_the_main_path(spark, sf):
    plan = L.scan_licenses(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

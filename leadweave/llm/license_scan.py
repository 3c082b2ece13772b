"""Licence notices by a positional index of rare words, with DataFrame functions only.

Templates are short word sequences with a mandatory key phrase. Document frequencies of all template words are counted over the
whole corpus; a template's RARE words of highest IDF are its postings (word, place in the template). In each document the rare
words that occur are looked up with their places; postings that agree on one relative position, place in the document less
place in the template, are intersected, and where they do the key phrase is verified word by word.

All of this happens inside a document's row: the index is a constant map, and no text is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: label: notices; the words of the key phrase stand in capitals and must match; base labels first
BASE = {"mit": ["UNDER THE MIT LICENSE"], "apache-2": ["APACHE LICENSE VERSION 2"], "cc-by-nc": ["CC BY NC"]}
OWN = {
    "gpl-2": ["gnu GENERAL PUBLIC LICENSE VERSION 2", "GNU GPL V2", "GPL 2 0"],
    "gpl-3": ["gnu GENERAL PUBLIC LICENSE VERSION 3", "GNU GPL V3", "GPL 3 0"],
    "lgpl": ["gnu LESSER GENERAL PUBLIC LICENSE"],
    "agpl-3": ["gnu AFFERO GENERAL PUBLIC LICENSE version 3"],
    "mpl-2": ["MOZILLA PUBLIC LICENSE VERSION 2"],
    "bsd": ["REDISTRIBUTION AND USE IN SOURCE AND BINARY FORMS with or without modification are permitted", "BSD 3 CLAUSE LICENSE", "BSD 2 CLAUSE LICENSE"],
    "isc": ["PERMISSION TO USE COPY MODIFY AND OR DISTRIBUTE THIS SOFTWARE for any purpose with or without fee is hereby granted"],
    "mit-text": ["PERMISSION IS HEREBY GRANTED FREE OF CHARGE TO ANY PERSON OBTAINING A COPY of this software and associated documentation files"],
    "cc-by": ["CREATIVE COMMONS ATTRIBUTION"],
    "cc-by-sa": ["CC BY SA", "CREATIVE COMMONS ATTRIBUTION SHAREALIKE"],
    "cc0": ["CC0 1 0 UNIVERSAL", "CREATIVE COMMONS ZERO"],
    "unlicense": ["THIS IS FREE AND UNENCUMBERED SOFTWARE RELEASED INTO THE PUBLIC DOMAIN"],
}
TEMPLATES = [(label, notice.split()) for labels in (BASE, OWN) for label, notices in labels.items() for notice in notices]
#: postings of a template
RARE = 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def vocabulary() -> list[str]:
    return sorted({w.lower() for _, notice in TEMPLATES for w in notice})


def frequencies(docs: DataFrame, text_column: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of them each template word is: as many rows as there are template words."""
    known = F.array(*[F.lit(w) for w in vocabulary()])
    found = docs.select(F.array_intersect(known, _words(F.col(text_column))).alias("w"))
    total = F.count("*").alias("n")
    rows = found.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").agg(total).collect()
    count = {r["w"]: r["n"] for r in rows}
    return count.pop("", 0), count


def rare_index(n_docs: int, count: dict[str, int]) -> tuple[dict[str, list[tuple[int, int]]], list[int], dict[str, float]]:
    """Postings (template, place) by word; how many each template has; IDF by word. Postings are words of the key phrase."""
    idf = {w: math.log((n_docs + 1) / (count.get(w, 0) + 1)) for w in vocabulary()}
    postings: dict[str, list[tuple[int, int]]] = {}
    sizes = []
    for t, (_, notice) in enumerate(TEMPLATES):
        places = sorted((p for p, w in enumerate(notice) if not w.islower()), key=lambda p: (-idf[notice[p].lower()], p))[:RARE]
        sizes.append(len(places))
        for p in places:
            postings.setdefault(notice[p].lower(), []).append((t, p))
    return postings, sizes, idf


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case; a null text is empty. n_base counts the
    places of all base phrases, first_word and last_word are their smallest and largest starts (null without one). Labels
    are distinct, sorted and joined by commas, '' for none. score: the best notice's share of its words' IDF that stands in its
    place (1 for a whole notice), 0 without a label. Ids may be null or repeated; repeated rows give equal rows. Other
    columns are not read. An empty table gives no rows.
    """
    n_docs, count = frequencies(docs, text_column)
    postings, sizes, idf = rare_index(n_docs, count)
    rare = F.array(*[F.lit(w) for w in sorted(postings)])
    posting = lambda t, p: F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"))
    index = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[posting(t, p) for t, p in postings[w]]))])
    notice = lambda words: F.array(*[F.lit(w.lower()) for w in words])
    templates = F.array(*[F.struct(
        F.lit(label).alias("label"), F.lit(label in BASE).alias("base"), F.lit(sizes[t]).alias("size"), notice(words).alias("words"),
        F.array(*[F.lit(not w.islower()) for w in words]).alias("key"), F.array(*[F.lit(idf[w.lower()]) for w in words]).alias("idf"),
        F.lit(sum(idf[w.lower()] for w in words)).alias("whole")) for t, (label, words) in enumerate(TEMPLATES)])
    df = docs.select(F.col(id_column), _words(F.col(text_column)).alias("_words"))
    # the places of rare words with their postings, as (template, start)
    places = F.filter(F.transform("_words", lambda w, i: F.when(F.array_contains(rare, w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    starts = F.flatten(F.transform(places, lambda x: F.transform(F.element_at(index, x["w"]), lambda q: F.struct(q["t"].alias("t"), (x["i"] - q["p"]).alias("s")))))
    df = df.select(id_column, F.size("_words").cast("long").alias("n_words"), F.when(F.arrays_overlap("_words", rare), F.col("_words")).alias("_words"))
    df = df.withColumn("_starts", F.array_sort(F.when(F.col("_words").isNotNull(), starts)))
    # sorted, equal starts stand together: a start is kept if its template's postings all agree on it
    agree = F.filter(F.transform("_starts", lambda x, i: F.struct(
        x["t"].alias("t"), x["s"].alias("s"), F.element_at(templates, x["t"] + 1).alias("m"),
        F.element_at(F.col("_starts"), F.least(i + F.element_at(templates, x["t"] + 1)["size"], F.size("_starts"))).alias("last"),
        (i + F.element_at(templates, x["t"] + 1)["size"]).alias("end"))),
        lambda x: (x["end"] <= F.size("_starts")) & (x["last"]["t"] == x["t"]) & (x["last"]["s"] == x["s"]) & (x["s"] >= 0))
    df = df.withColumn("_agree", agree)
    found = F.transform("_agree", lambda x: F.struct(
        x["s"].alias("s"), x["m"]["label"].alias("label"), x["m"]["base"].alias("base"), x["m"]["whole"].alias("whole"),
        F.transform(x["m"]["words"], lambda w, k: F.struct(
            F.coalesce(F.get("_words", x["s"] + k) == w, F.lit(False)).alias("ok"), F.get(x["m"]["key"], k).alias("key"), F.get(x["m"]["idf"], k).alias("idf"))).alias("each")))
    df = df.withColumn("_found", F.filter(found, lambda x: F.forall(x["each"], lambda e: e["ok"] | ~e["key"])))
    base = F.array_distinct(F.transform(F.filter("_found", lambda x: x["base"]), lambda x: F.struct(x["s"].alias("s"), x["label"].alias("label"))))
    df = df.withColumn("_base", F.coalesce(base, F.array().cast("array<struct<s:int,label:string>>")))
    share = F.transform("_found", lambda x: F.aggregate(x["each"], F.lit(0.0), lambda a, e: a + F.when(e["ok"], e["idf"]).otherwise(0.0)) / F.greatest(x["whole"], F.lit(1e-9)))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return df.select(
        id_column, "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min("_base.s").cast("long").alias("first_word"),
        F.array_max("_base.s").cast("long").alias("last_word"), joined(F.col("_base.label")).alias("base_labels"),
        F.coalesce(joined(F.col("_found.label")), F.lit("")).alias("labels"), F.least(F.coalesce(F.array_max(share), F.lit(0.0)), F.lit(1.0)).alias("score"))

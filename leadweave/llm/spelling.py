"""Spelling variants by a variable-length gram index.

1. Dictionary. Grams of two signs that are in many words are extended by one sign, and again, up to MOST signs, so that
   every gram but those of full length has a short list. Words carry a mark at either end.
2. Decomposition. From each place of a word the shortest dictionary gram that is not frequent, or the longest there is, is
   taken. Which one it is depends on its own signs alone, so one edit affects exactly the grams that it touches; the
   largest number of them over all places is the word's bound. (Grams inside longer ones are kept, which keeps this exact.)
3. Lists. Two near words share all but the affected grams, at the same distance from the start (before the edit) or
   from the end (behind it). So the rarest unaffected gram of both is among the first bound + 1 of either by
   (frequency, gram, place), and lists are merged for those alone.
4. Words that meet in a list are verified by edit distance; forms are followed to their roots by pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadweave.llm.tables import delete_tables, table

WORD = "[A-Za-z\\u00C0-\\u00FF]+"
#: signs of the shortest and the longest gram, and words of a gram above which it is extended
LEAST, MOST, FREQUENT = 2, 4, 200
BEGIN, END = "^", "$"
TOKENS = "word string, length int, letters long, bound int, place int, gram string"


def ascii_lower(c: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(c.rlike("[A-Z]"), F.translate(c, upper, lower)).otherwise(c)


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, run): every run of letters of every text, A-Z in lower case; null and empty texts have none."""
    found = docs.select(F.col(id_column).alias("id"), F.explode(F.regexp_extract_all(F.col(text_column).cast("string"), F.lit(WORD), F.lit(0))).alias("run"))
    return found.select("id", ascii_lower(F.col("run")).alias("run"))


def count_words(found: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): words of at least least_length code points that occur at least least_count times."""
    return found.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _marked(word: str) -> str:
    return f"{BEGIN}{word}{END}"


def frequent_grams(words: DataFrame, frequent: int) -> DataFrame:
    """Grams of LEAST to MOST - 1 signs that stand at more than ``frequent`` places of words."""
    marked = F.concat(F.lit(BEGIN), "word", F.lit(END))
    lengths = F.array(*[F.lit(q) for q in range(LEAST, MOST)])
    cut = F.flatten(F.transform(lengths, lambda q: F.transform(F.sequence(F.lit(1), F.length("marked") - q + 1), lambda p: F.substring(F.col("marked"), p, q))))
    grams = words.select(marked.alias("marked")).select(F.explode(cut).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > frequent).select("gram")


def decompose(word: str, frequent: set[str]) -> list[str]:
    """The gram that begins at each place of the marked word."""
    s, out = _marked(word), []
    for p in range(len(s) - LEAST + 1):
        size = LEAST
        while size < MOST and p + size < len(s) and s[p:p + size] in frequent:
            size += 1
        out.append(s[p:p + size])
    return out


def affected(grams: list[str]) -> int:
    """The most grams that one edit can touch: those that hold one place between the marks."""
    size = np.array([len(g) for g in grams])
    begin = np.arange(len(grams))
    count = np.zeros(len(grams) + LEAST, np.int64)
    np.add.at(count, begin, 1)
    np.add.at(count, begin + size, -1)
    return int(np.cumsum(count)[1:len(grams) + LEAST - 2].max(initial=1))


def letters(word: str) -> int:
    """A bit for each code point (modulo 64) that occurs an odd number of times: an edit turns one of them, a replacement two at most."""
    out = 0
    for c in word:
        out ^= 1 << (ord(c) % 64)
    return out - (out >> 63 << 64)


def _tokens(shared):
    def run(batches):
        frequent = shared.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            for begin in range(0, len(words), 2000):
                out = []
                for w in words[begin:begin + 2000]:
                    grams = decompose(w, frequent)
                    bound = affected(grams)
                    parity = letters(w)
                    out += [(w, len(w), parity, bound, p, g) for p, g in enumerate(grams)]
                columns = list(zip(*out)) or [[]] * 6
                types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in TOKENS.split(", ")])
    return run


def near_pairs(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(a, b), a < b: the words that differ by exactly one inserted, deleted or replaced code point. Words must be distinct, of at least MOST signs.

    The frequent grams are the only thing that is broadcast: grams of at most MOST - 1 signs of an alphabet of at most 92 (letters and
    marks), so under 92 ** 2 + 92 ** 3 short strings, however many words there are. Other alphabets raise an error beyond that number.
    """
    rows = frequent_grams(words, frequent).limit(92 ** 2 + 92 ** 3 + 1).collect()
    if len(rows) > 92 ** 2 + 92 ** 3:
        raise ValueError("more frequent grams than an alphabet of 92 signs has: raise the threshold")
    shared = words.sparkSession.sparkContext.broadcast({r[0] for r in rows})
    tokens = table(words.select("word").mapInArrow(_tokens(shared), TOKENS), "grams")
    lists = tokens.groupBy("gram").agg(F.count("*").alias("frequency"))
    order = W.partitionBy("word").orderBy("frequency", "gram", "place")
    first = tokens.join(lists, "gram").withColumn("rank", F.row_number().over(order))
    # an edit touches at most MOST grams: the constant limit cuts the rows before they are shuffled
    first = first.where((F.col("rank") <= MOST + 1) & (F.col("rank") <= F.col("bound") + 1))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("place").alias("at")), F.struct(F.lit(1).alias("side"), (F.col("length") - F.col("place")).alias("at"))))
    index = table(first.select("word", "length", "letters", "gram", ends.alias("e")).select("word", "length", "letters", "gram", "e.side", "e.at"), "lists")
    a, b = (index.select("gram", "side", "at", F.col("word").alias(x), F.col("length").alias(f"{x}_length"), F.col("letters").alias(f"{x}_letters")) for x in "ab")
    # lengths and letters refuse most pairs of a list before their signs are compared
    likely = "abs(a_length - b_length) <= 1 and bit_count(a_letters ^ b_letters) <= 2 - abs(a_length - b_length)"
    near = a.join(b, ["gram", "side", "at"]).where(f"a < b and {likely} and levenshtein(a, b, 1) = 1")
    return table(near.select("a", "b").distinct(), "near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word reached from each word that has a form. Forms must not run in circles."""
    now = table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = table(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        delete_tables(now)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after


def variants(words: DataFrame, times: int = 2, frequent: int = FREQUENT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of words (word, n).

    Near words differ by exactly one code point; a word's form is its near word of largest n, of equal ones the first in
    code-point order, if it has at least ``times`` (over 1) times the word's n. The root is reached by following forms; a word
    without a form is its own. Nulls and words under MOST signs, of which one edit may touch every gram, have no part; counts of a word that occurs repeatedly are added up. Words of any length
    are compared whole. Other columns are not read. An empty table gives no rows.
    """
    words = table(words.where(F.length("word") >= MOST).where("n is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = near_pairs(words, frequent)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = (both.join(words.withColumnRenamed("word", "b").withColumnRenamed("n", "near_n"), "b")
            .groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b").alias("form"))).alias("best")))
    told = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    high = F.col("best.less") <= -times * F.col("n")
    told = table(told.select("word", F.when(high, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                             F.when(high, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(told.where("form is not null"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

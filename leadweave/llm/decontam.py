"""Benchmark items in documents, also with other numbers, names and units, by template windows.

Numbers, names and units become typed placeholders, so a question with other values has the same template. Windows of WINDOW
template words of documents are joined by hash with those of the benchmark. A window of a document leaves its task only if it
passes a bitmap of fixed size made from the benchmark's windows; the join behind it is exact. Matches of one document and item
on one diagonal are added up, and their slots must agree: equal values of the item stand for equal values in the document, and
different names for different names (numbers and units may fall together). Slots at the ends of the matched words may run on into
the text around and are not judged; windows without slots count in any case. Items of equal template and slot pattern are one class, joined once.

Texts are read three times: as templates in which a capitalised word at the start of a sentence or line is a word, as templates in which
it is a name, and as their words in lower case. Any reading makes a match. A part of an item in lower case is none if the template shows
there that values of the item were changed so that they disagree; a whole one is.

An item without a full window has windows of its own: its whole template if that holds LITERALS plain words, and its words as
they stand, which is all that can be asked of an item of few plain words ("What is 17 * 23 + 4?"). They are joined by hash as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from leadweave.llm.tables import bit_filter, passes, table
from leadweave.llm.words import U, Words, mix, signed, slices, windows

WINDOW = 8
#: words of a window that are no placeholders, at least
LITERALS = 5
#: windows of an item that make a match: half of them, or this many (13 words in a row)
MATCHES = 6
UNITS = """mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce
ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year
years cent cents dollar dollars euro euros usd eur percent degree degrees celsius fahrenheit kelvin mph kmh volt volts watt watts
joule joules newton newtons meter meters metre metres kilometer kilometers kilometre kilometres""".split()
_SPLIT = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
_STOP = np.isin(np.arange(256), list(b".!?:;\n\r\"("))
NUMBER, NAME, UNIT = 1, 2, 3
_PLACE = mix(np.array([0, 11, 12, 13], U))
_BREAK = np.isin(np.arange(256), list(b".!?:;\"("))
#: readings of a text: template words, those with capitalised words at the start of sentences as names, and all words as they stand in lower case
TEMPLATE, STARTS, VERBATIM = 0, 1, 2


def _unit_hashes() -> np.ndarray:
    return np.sort(Words(pa.array([" ".join(UNITS)]), lower=True, separators=_SPLIT).hashes())


class Templates:
    """Template words of each text: ``hashes``, ``kinds`` (0: literal), ``values`` of slots, offsets ``at``."""

    def __init__(self, w: Words, h: np.ndarray, reading: int = TEMPLATE):
        self.reading, n = reading, len(w.start)
        if reading == VERBATIM:
            self.hashes, self.kinds, self.values, self.at = h, np.zeros(n, np.int8), np.zeros(n, np.int64), w.at
            self.raw = np.arange(n) - np.repeat(w.at[:-1], np.diff(w.at))
            return
        first = np.zeros(n + 1, bool)
        first[w.at[:-1]] = True
        first = first[:n]
        stops = np.concatenate([[0], np.cumsum(_STOP[w.data])])
        last_end = np.concatenate([[0], w.end[:-1]])[:n]
        begins = first | (stops[w.start] > stops[np.minimum(last_end, w.start)])
        head = w.original[w.start] if n else np.zeros(0, np.uint8)
        second = w.original[np.minimum(w.start + 1, len(w.original) - 1)] if n else head
        number = (head >= 48) & (head <= 57)
        title = (head >= 65) & (head <= 90) & (w.end - w.start > 1) & ~((second >= 65) & (second <= 90))
        after = np.concatenate([[False], number[:-1]])[:n] & ~begins
        units = _unit_hashes()
        unit = after & (units[np.minimum(np.searchsorted(units, h), len(units) - 1)] == h)
        kinds = np.where(number, NUMBER, np.where(title & (~begins | (reading == STARTS)), NAME, np.where(unit, UNIT, 0))).astype(np.int8)
        # a run of one kind of slot is one slot
        same = (kinds == np.concatenate([[0], kinds[:-1]])[:n]) & (kinds > 0) & ~first
        if reading == STARTS:  # names of two sentences are two, also if nothing stands between
            breaks = np.concatenate([[0], np.cumsum(_BREAK[w.data])])
            same &= (kinds != NAME) | (breaks[w.start] == breaks[np.minimum(last_end, w.start)])
        keep = np.flatnonzero(~same)
        self.kinds = kinds[keep]
        self.values = signed(np.add.reduceat(mix(h + np.arange(n).astype(U) - np.repeat(keep, np.diff(np.append(keep, n))).astype(U)), keep)) if n else np.zeros(0, np.int64)
        self.hashes = np.where(self.kinds > 0, _PLACE[self.kinds], h[keep])
        self.at = np.searchsorted(keep, w.at)
        self.raw = keep - np.repeat(w.at[:-1], np.diff(self.at))

    def windows(self, size: int = WINDOW, literals: int = LITERALS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, text, hash) of the windows with enough literals; the hash depends on the reading and the size."""
        count = np.maximum(np.diff(self.at) - size + 1, 0)
        doc = np.repeat(np.arange(len(count)), count)
        place = self.at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        plain = np.concatenate([[0], np.cumsum(self.kinds == 0)])
        ok = plain[place + size] - plain[place] >= literals
        place, doc = place[ok], doc[ok]
        return place, doc, signed(mix(windows(self.hashes, size)[place] + U(1000 * self.reading + size))) if len(place) else np.zeros(0, np.int64)

    def own(self, d: int) -> list[tuple[int, int, int]]:
        """(place, size, hash) of the windows that cover the whole of a text without full windows; all of them must be found."""
        a, n = int(self.at[d]), int(self.at[d + 1] - self.at[d])
        if n == 0 or self.reading != VERBATIM and (self.kinds[a:a + n] == 0).sum() < LITERALS:
            return []
        # greater lengths as two windows of a power of two, so that documents are read with few lengths
        size = n if n < 2 * WINDOW else 1 << n.bit_length() - 1
        hashed = windows(self.hashes[a:a + n], size)[[*{0, n - size}]] + U(1000 * self.reading + size)
        return [(a + k, size, int(x)) for k, x in zip([*{0, n - size}], signed(mix(hashed)))]

    def slots(self, place: int, size: int) -> list[int]:
        k = np.flatnonzero(self.kinds[place:place + size])
        return self.values[place + k].tolist()

    def class_of(self, d: int) -> tuple[int, dict[int, int]]:
        """Hash of a text's template and slot pattern, and for each slot's place the order in which its value first appears."""
        a, b = self.at[d], self.at[d + 1]
        order: dict[int, int] = {}
        number = {k: order.setdefault(int(self.values[k]), len(order)) for k in range(a, b) if self.kinds[k]}
        whole = windows(mix(self.hashes[a:b] + np.array([number.get(k, -1) + 1 for k in range(a, b)], U)), b - a) + U(self.reading)
        return int(signed(whole)[0]), number


def _readings(texts: pa.Array) -> list[Templates]:
    w = Words(texts, lower=True, separators=_SPLIT)
    try:
        folded = Words(pc.utf8_lower(pc.cast(texts, pa.large_string())), separators=_SPLIT)
    except pa.ArrowInvalid:  # no UTF-8: only A-Z in lower case
        folded = w
    h = w.hashes()
    return [Templates(w, h), Templates(w, h, STARTS), Templates(folded, folded.hashes() if folded is not w else h, VERBATIM)]


INDEX = ("item long, rep long, reading int, class long, w long, size int, item_place int, pattern array<int>, at array<int>, n_windows int, need int")


def _items(batches):
    """One row per item and window, as in INDEX: rep is the item's class in the first reading, class that in its own, pattern the
    order in which the values of the slots first appear (times four, and the kind), at their places; need of n_windows make a match."""
    for batch in slices(batches, "text"):
        readings = _readings(batch.column(1))
        ids, rows, n = batch.column(0).to_pylist(), [], batch.num_rows
        found = [t.windows() for t in readings]
        bounds = [np.searchsorted(doc, np.arange(n + 1)) for _, doc, _ in found]
        for d in range(n):
            if readings[0].at[d] == readings[0].at[d + 1]:
                continue
            rep = readings[0].class_of(d)[0]
            for t, (place, _, hashed), cut in zip(readings, found, bounds):
                a, (lo, hi) = int(t.at[d]), cut[d:d + 2]
                full = [(int(p), WINDOW, int(x)) for p, x in zip(place[lo:hi], hashed[lo:hi])]
                parts = full or t.own(d)
                if not parts:
                    continue
                whole, number = t.class_of(d)
                need = min(-(-len(full) // 2), MATCHES) if full else len(parts)
                for p, size, x in parts:
                    slots = [q for q in range(p, p + size) if t.kinds[q]]
                    rows.append((ids[d], rep, t.reading, whole, x, size, p - a, [4 * number[q] + int(t.kinds[q]) for q in slots], [q - a for q in slots], len(parts), need))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)],
                                         names=[c.split()[0] for c in INDEX.split(", ")])


def _doc_windows(bits, sizes: list[tuple[int, int, int]]):
    """(id, key, window hash, place, place of its first word, slot values) of the windows of some (reading, size, literals) that may be in the benchmark."""
    def run(batches):
        for batch in slices(batches, "text"):
            for t in _readings(batch.column(2)):
                for size, literals in [(s, k) for r, s, k in sizes if r == t.reading]:
                    place, doc, hashed = t.windows(size, literals)
                    ok = np.flatnonzero(passes(bits.value, hashed))
                    if t.reading == VERBATIM and size < WINDOW:  # one place tells as much as all
                        ok = ok[np.sort(np.unique(np.stack([doc[ok], hashed[ok]]), axis=1, return_index=True)[1])]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(doc[ok])), batch.column(1).take(pa.array(doc[ok])), pa.array(hashed[ok]),
                        pa.array((place[ok] - t.at[doc[ok]]).astype(np.int32)),
                        pa.array(t.raw[place[ok]].astype(np.int32)), pa.array([t.slots(p, size) for p in place[ok]], pa.list_(pa.int64()))],
                        names=["id", "key", "w", "place", "word", "slots"])
    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item class that it holds: id, item_id, n_items, n_windows, n_matched, n_slots.

    item_id is the smallest of the n_items items of equal template and slot pattern. n_matched windows of its n_windows lie on one
    diagonal (the first of the best), half of them or MATCHES at least; an item without a full window is found as a whole, one of
    fewer than LITERALS plain words only with the same values. An item without words is in no document. Null texts, ids and items
    match nothing; repeated rows are one.
    Other columns are not read. Empty tables give no rows.
    """
    items = benchmark.select(F.col(item_column).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null")
    parts = table(items.mapInArrow(_items, INDEX), "items")
    classes = parts.groupBy("rep").agg(F.min("item").alias("item"), F.countDistinct("item").alias("n_items"))
    named = table(parts.select("class", "rep").distinct().join(classes, "rep").drop("rep"), "named")
    index = table(parts.drop("item", "rep").distinct(), "index")
    # few rows: sizes are below 2 * WINDOW, or powers of two
    sizes = [(r["reading"], r["size"], LITERALS if r["reading"] != VERBATIM and r["size"] < 2 * WINDOW else 0) for r in index.select("reading", "size").distinct().collect()]
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(index, "w"))
    docs = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("key"), F.col(text_column).cast("string").alias("text")).where("id is not null")
    found = table(docs.mapInArrow(_doc_windows(bits, sizes), f"id {dict(docs.dtypes)['id']}, key long, w long, place int, word int, slots array<long>"), "windows")
    hits = found.distinct().join(index, "w").withColumn("diagonal", F.col("place") - F.col("item_place"))
    # as many rows per group as the item has windows
    pairs = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("at", "pattern", "slots"))))
    lines = (hits.groupBy("id", "key", "reading", "class", "n_windows", "need", "diagonal")
             .agg(F.countDistinct("item_place").alias("n_found"), F.countDistinct(F.when(F.size("slots") == 0, F.col("item_place"))).alias("n_plain"),
                  F.min("word").alias("from"), F.max("word").alias("to"), F.min("item_place").alias("first"), F.max(F.col("item_place") + F.col("size") - 1).alias("last"), pairs.alias("pairs"))
             .where("n_found >= need"))
    # distinct (pattern, slots) of the slots that are judged; a pattern is four times its number, and the kind
    judged = F.array_distinct(F.transform(F.filter("pairs", lambda x: ~x["at"].isin(F.col("first"), F.col("last"))), lambda x: F.struct(x["pattern"], x["slots"])))
    lines = lines.withColumn("judged", judged).withColumn("names", F.filter("judged", lambda x: x["pattern"] % 4 == NAME))
    agree = ((F.size("judged") == F.size(F.array_distinct("judged.pattern"))) & (F.size("names") == F.size(F.array_distinct("names.slots"))))
    lines = (lines.withColumn("n_matched", F.when(agree, F.col("n_found")).otherwise(F.col("n_plain")))
             .withColumn("n_slots", F.when(agree, F.size(F.array_distinct("pairs.pattern"))).otherwise(0)))
    lines = table(lines.drop("pairs", "judged", "names").join(named, "class"), "lines")
    good, part = lines.where("n_matched >= need"), (F.col("reading") == VERBATIM) & (F.col("n_found") < F.col("n_windows"))
    # blocks of words in which values disagree; parts of an item that share one with it are no match
    step = F.lit(4 * WINDOW)
    blocks = F.explode(F.sequence(F.floor(F.col("from") / step), F.floor((F.col("to") + WINDOW - 1) / step))).alias("block")
    where = ["id", "key", "item"]
    bad = lines.where("n_matched < need").select(*where, blocks).distinct()
    changed = good.where(part).select(*where, "class", "diagonal", blocks).join(bad, [*where, "block"], "left_semi").select(*where, "class", "diagonal").distinct()
    lines = good.join(changed, [*where, "class", "diagonal"], "left_anti")
    # the first reading that finds an item tells its figures
    best = lines.groupBy("id", "item", "n_items").agg(
        F.max(F.struct(-F.col("reading"), "n_matched", (-F.col("diagonal")).alias("at"), "n_slots", "n_windows")).alias("b"))
    return best.select(F.col("id").alias(id_column), F.col("item").alias("item_id"), "n_items", "b.n_windows", "b.n_matched", "b.n_slots")

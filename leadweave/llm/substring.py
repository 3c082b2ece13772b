"""Words inside passages that occur more than once, found by windows of doubling length.

A window of n words can only be repeated if each shorter window inside it is. Three levels, n / 4, n / 2 and n:

1. Of the n / 4-word windows inside any n consecutive words the one with the smallest hash is taken, so equal
   passages take equal places and about one place in fourteen moves. Only hashes that occur at two places go on.
2. Around those places the windows of twice that length, to the left and to the right, are counted alone.
3. Around what is left of them all windows of n words are counted, by 128-bit hashes.

Counts are aggregates of fixed size (smallest and largest place), combined before the shuffle, so a passage that a
third of all texts share is no hot group. Texts are told apart by content: copies of a text are one place, and a
text that occurs twice is repeated as a whole.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadweave.llm.tables import bit_filter, passes, table
from leadweave.llm.words import U, Words, mix, signed, slices, window_starts, windows

WINDOW = 35
_TOP = U(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, n: int, of) -> np.ndarray:
    """of.reduce over x[i:i + n], by doubling."""
    width = 1
    while 2 * width <= n:
        x = of(x[:len(x) - width], x[width:])
        width *= 2
    return of(x[:len(x) - (n - width)], x[n - width:]) if n > width else x


def anchors(h: np.ndarray, at: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, text, hash) of the k-word windows that are smallest within some n words of a text."""
    whole = np.where(at[1:] - at[:-1] >= n, at[1:] - at[:-1], 0)
    count = np.where(whole > 0, whole - k + 1, 0)
    if not count.sum() or len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    doc = np.repeat(np.arange(len(count)), count)
    place = at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    short, w = np.full(len(h), _TOP, U), n - k + 1
    short[place] = windows(h, k)[place]
    edge = np.full(w - 1, _TOP, U)
    least = _slide(np.concatenate([short, edge]), w, np.minimum)
    best = _slide(np.concatenate([np.zeros(w - 1, U), least]), w, np.maximum)
    taken = best[place] == short[place]
    return place[taken], doc[taken], short[place[taken]]


def _code(text_key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One number for a place in a text."""
    return signed(mix(mix(text_key.view(U)) + place.astype(U)))


def _first_level(n: int, k: int):
    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            place, doc, hashed = anchors(words.hashes(), words.at, n, k)
            key = batch.column(0).to_numpy(False)
            yield pa.RecordBatch.from_arrays([pa.array(signed(hashed)), pa.array(_code(key[doc], place - words.at[doc]))], names=["h", "code"])
    return run


def _second_level(n: int, k: int, bits):
    """(h, key, place, left, right): places whose hash may be repeated, with the windows of 2 k words around."""
    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            h = words.hashes()
            place, doc, hashed = anchors(h, words.at, n, k)
            ok = passes(bits.value, signed(hashed))
            place, doc, hashed = place[ok], doc[ok], hashed[ok]
            twice = signed(windows(h, 2 * k)) if len(h) >= 2 * k else np.zeros(1, np.int64)
            side = lambda p, fits: pa.array(twice[np.clip(p, 0, len(twice) - 1)], mask=~fits)
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(hashed)), pa.array(batch.column(0).to_numpy(False)[doc]), pa.array((place - words.at[doc]).astype(np.int32)),
                side(place - k, place - k >= words.at[doc]), side(place, place + 2 * k <= words.at[doc + 1])],
                names=["h", "key", "place", "left", "right"])
    return run


def window_hashes(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the n words from each place on; words are mixed anew for the second, as the first is a sum over them."""
    return windows(h, n), windows(mix(h + U(0x51)), n)


def _candidates(n: int, k: int):
    """(h1, h2, key, place) of the n-word windows whose n / 2-word parts are all repeated; sides: 2 * place + (1 if right)."""
    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            h = words.hashes()
            one, two = window_hashes(h, n)
            keys, out = batch.column(0).to_numpy(False), []
            for d, sides in enumerate(batch.column(2)):
                sides = np.asarray(sides.values)
                size, last = words.at[d + 1] - words.at[d], words.at[d + 1] - words.at[d] - n
                # state of a window: an anchor allows it if the sides that lie inside it are repeated
                allowed = np.zeros(last + 1, bool)
                left, right = set((sides[sides % 2 == 0] // 2).tolist()), set((sides[sides % 2 == 1] // 2).tolist())
                for a in left | right:
                    lo, hi = max(0, a - n + k), min(last, a)
                    i = np.arange(lo, hi + 1)
                    allowed[lo:hi + 1] |= ((i > a - k) | (a in left)) & ((i < a + 2 * k - n) | (a in right))
                out.append(np.flatnonzero(allowed))
            doc = np.repeat(np.arange(len(out)), [len(x) for x in out])
            place = np.concatenate(out) if out else np.zeros(0, np.int64)
            g = place + words.at[doc]
            yield pa.RecordBatch.from_arrays([pa.array(signed(one[g])), pa.array(signed(two[g])), pa.array(keys[doc]), pa.array(place.astype(np.int32))],
                                             names=["h1", "h2", "key", "place"])
    return run


def _keep(n: int):
    def run(batches):
        for batch in slices(batches, "text"):
            total, gone, digest, kept = [], [], [], []
            for text, all_, starts in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = (text.as_py() or "").encode().split()  # bytes: splits at ASCII blanks
                total.append(len(words))
                if all_.as_py() and len(words) >= n:
                    words = []
                elif starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    s = np.asarray(starts.values)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n, -1)
                    words = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
                digest.append(hashlib.sha256(kept[-1].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())],
                                             names=["id", "n_words", "n_removed", "kept_text", "kept_sha256"])
    return run


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur at more than one place."""
    return df.groupBy(*keys).agg(F.min("code").alias("lo"), F.max("code").alias("hi")).where("lo <> hi").select(*keys)


def remove_repeats(docs: DataFrame, n: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_text, kept_sha256.

    Words are split at ASCII blanks. A word goes if it lies in a window of n words (4 or more) that also starts at
    another place, in this row or any other; the input decides, not what is left of it. Kept words are joined by one
    blank. A null text has no words. Null and repeated ids are allowed: rows with equal text are each other's copies.
    Other columns are not read. An empty table gives no rows.
    """
    if n < 4:
        raise ValueError("windows have four words or more")
    spark, k = docs.sparkSession, -(-n // 4)
    docs = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    texts = docs.select("key", "text")
    once = table(_repeated(texts.mapInArrow(_first_level(n, k), "h long, code long"), "h"), "windows")
    bits = spark.sparkContext.broadcast(bit_filter(once, "h"))
    near = texts.mapInArrow(_second_level(n, k, bits), "h long, key long, place int, left long, right long")
    # rows of copies stay: to drop them here would keep all rows of a frequent hash in one task
    near = table(near.join(once, "h", "left_semi"), "places")
    sides = near.select("key", F.explode(F.array(
        F.struct(F.col("left").alias("h"), (F.col("place") * 2).alias("side")),
        F.struct(F.col("right").alias("h"), (F.col("place") * 2 + 1).alias("side")))).alias("s")).select("key", "s.h", "s.side").where("h is not null")
    twice = table(_repeated(sides.withColumn("code", F.xxhash64("key", F.shiftright("side", 1))), "h"), "windows")
    # a text's places: as many as it has words at most
    places = sides.join(twice, "h", "left_semi").groupBy("key").agg(F.collect_set("side").alias("sides"))
    classes = table(docs.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "texts")
    places = table(places.join(classes.select("key", "rep"), "key"), "sides")
    first = docs.join(places.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("rep")))
    found = table(first.select("key", "text", "sides").mapInArrow(_candidates(n, k), "h1 long, h2 long, key long, place int"), "candidates")
    whole = table(_repeated(found.withColumn("code", F.xxhash64("key", "place")), "h1", "h2"), "windows")
    starts = found.join(whole, ["h1", "h2"], "left_semi").groupBy("key").agg(F.collect_set("place").alias("starts"))
    flags = table(classes.join(starts, "key", "left").where("n > 1 or starts is not null").select("key", (F.col("n") > 1).alias("twice"), "starts"), "flags")
    return (docs.join(flags, "key", "left").select("id", "text", F.coalesce("twice", F.lit(False)).alias("twice"), "starts")
            .mapInArrow(_keep(n), f"id {dict(docs.dtypes)['id']}, n_words long, n_removed long, kept_text string, kept_sha256 string")
            .withColumnRenamed("id", id_column))

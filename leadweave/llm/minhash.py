"""Near-duplicate documents: universal hash minima, bands, signatures, full sets, components.

1. Each text's set of word shingles gives many minima of universal hash functions. Texts with equal
   sets become one class, stood for by its smallest id; copies cost one row from here on.
2. Bands of minima deal classes into buckets. Every class is compared with the smallest of each
   bucket it is in, by signature, then on full sets. Star rounds join what is linked.
3. Buckets that still hold several components are compared across components, block by block inside
   tasks: by signature, and what has a likely partner is compared again, on full sets. What a task links is
   one component for it from then on, so it gives fewer links than it has texts.

Pairs inside one component can't change the result and are never made, so a group of n copies costs
about n rows. A pair of similarity 0.85 shares no band with probability (1 - 0.85 ** 5) ** 24 < 1e-6,
one of 0.80 none of 35 with (1 - 0.80 ** 5) ** 35 < 1e-6; lower thresholds take more bands, and the signature test leaves out pairs only at over five standard deviations below the threshold, one in thirty million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadweave.llm.components import connected_components
from leadweave.llm.tables import bit_filter, delete_tables, passes, table
from leadweave.llm.words import U, Words, mix, release, slices, window_starts, windows

BANDS, ROWS = 24, 5
#: bands for thresholds below 85 %
MOST_BANDS = 36
SHINGLE = 5
#: classes in a block of step 3, members compared with one leader in a task of step 2
BLOCK = 512
#: shingles in a block of step 3, about, and signatures in one
BLOCK_SHINGLES, BLOCK_SIGNS = 500_000, 4096
_RANDOM = np.random.default_rng(20_071)
_A = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_A = np.concatenate([_A, _RANDOM.integers(1, 1 << 63, (MOST_BANDS - BANDS) * ROWS, dtype=np.uint64) * U(2) + U(1)])
_B = np.concatenate([_B, _RANDOM.integers(0, 1 << 63, (MOST_BANDS - BANDS) * ROWS, dtype=np.uint64)])


def bands_for(percent: int) -> int:
    """Bands that miss a pair at the threshold with a probability below one in a million."""
    bands = BANDS
    while (1 - (percent / 100) ** ROWS) ** bands >= 1e-6:
        bands += 1
    if bands > MOST_BANDS:
        raise ValueError(f"{MOST_BANDS} bands are too few for {percent} %")
    return bands


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text of fewer words has one, of them all."""
    words = Words(texts, lower=True)
    h, out = words.hashes(), []
    shingles = windows(h, n)
    for begin, end in zip(words.at[:-1], words.at[1:]):
        if end - begin >= n:
            out.append(np.unique(shingles[begin:end - n + 1]))
        elif end > begin:
            # its own length is part of the hash: it never equals a full shingle
            out.append(windows(h[begin:end], end - begin, salt=end - begin))
        else:
            out.append(np.zeros(0, U))
    return out


def signature(sets: list[np.ndarray], bands: int = BANDS) -> np.ndarray:
    """Upper quarters of the minima of bands * ROWS hash functions, for each of some non-empty sets."""
    out = np.empty((len(sets), bands * ROWS), np.uint16)
    begin = 0
    while begin < len(sets):  # blocks that stay in the processor's cache
        end, size = begin + 1, len(sets[begin])
        while end < len(sets) and size + len(sets[end]) <= 30_000:
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[begin:end])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[begin:end]])])[:-1]
        for k in range(bands * ROWS):
            out[begin:end, k] = np.minimum.reduceat(x * _A[k] + _B[k], at) >> U(48)
        begin = end
    return out


def _signatures(id_column: str, text_column: str, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, text_column):
            ids, sets = batch.column(batch.schema.get_field_index(id_column)), shingle_sets(batch.column(batch.schema.get_field_index(text_column)))
            full = [k for k, s in enumerate(sets) if len(s)]
            sign = signature([sets[k] for k in full], bands)
            signs: list[bytes | None] = [None] * len(sets)
            for row, k in zip(sign, full):
                signs[k] = row.tobytes()
            one = [int(s.sum(dtype=U).view(np.int64)) if len(s) else None for s in sets]
            two = [int(np.bitwise_xor.reduce(mix(s + U(77))).view(np.int64)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), pa.array(signs, pa.binary())],
                names=["id", "n_shingles", "set1", "set2", "sign"])
    return run


def _bands(classes: DataFrame, bands: int) -> DataFrame:
    """(band, key, rep, sign): one row for each class and band."""
    width = 2 * ROWS
    return classes.select("rep", "sign", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda k: F.xxhash64(F.substring(F.col("sign"), k * width + 1, F.lit(width))))).alias("band", "key"))


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def least_agreement(threshold: float) -> float:
    """Share of equal minima below which a pair can't be a link, but for more than five deviations."""
    return threshold - 5.5 * (threshold * (1 - threshold) / (bands_for(round(100 * threshold)) * ROWS)) ** 0.5


def _likely(threshold: float):
    """Pairs (a, b, sign_a, sign_b) whose signatures allow a link."""
    least = least_agreement(threshold)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
                ok = pa.array(_agree(a, b) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])
    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _likely_partners(rep, size, comp, sign, percent: int, band: int, x: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of other components that may be linked with row x, looked for in a pair's first common band only; and their agreement."""
    y = among[comp[among] != comp[x]]
    y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
    bands = sign.reshape(len(sign), -1, ROWS)
    agree = _agree(sign[y], sign[x])
    first = (bands[y] == bands[x]).all(-1).argmax(-1) == band
    ok = (agree >= least_agreement(percent / 100)) & first
    return y[ok], agree[ok]


def _block_rows(rows: pa.Table, i: int, j: int):
    rep, block, size = (rows.column(c).to_numpy() for c in ("rep", "block", "n_shingles"))
    _, comp = np.unique(rows.column("comp").to_numpy(), return_inverse=True)
    sign = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint16).reshape(len(rep), -1)
    return rep, size, comp, sign, np.flatnonzero(block == i), np.flatnonzero(block == j)


def _block_partners(percent: int):
    """Members of a bucket, or of a pair of its blocks, that have a likely partner in another component there."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        band, at, i, j = (int(k.as_py()) for k in key)
        rep, size, comp, sign, left, right = _block_rows(rows, i, j)
        has = np.zeros(len(rep), bool)
        for x in left:
            y, _ = _likely_partners(rep, size, comp, sign, percent, band, x, right)
            has[y] = True
            has[x] |= len(y) > 0
        found = np.unique(rep[has])
        return pa.table([pa.array(np.full(len(found), band), pa.int32()), pa.array(np.full(len(found), at), pa.int64()), pa.array(found)], names=["band", "key", "rep"])
    return run


def _block_links(percent: int):
    """Links across components within one bucket or pair of its blocks."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        band, _, i, j = (int(k.as_py()) for k in key)
        rep, size, comp, sign, left, right = _block_rows(rows, i, j)
        sets = [np.frombuffer(s, U) for s in rows.column("set").to_pylist()]
        a, b = [], []
        for x in left:
            y, agree = _likely_partners(rep, size, comp, sign, percent, band, x, right[rep[right] > rep[x]] if i == j else right)
            for k in y[np.argsort(-agree, kind="stable")]:
                if comp[k] != comp[x] and _linked(sets[x], sets[k], percent):
                    comp[comp == comp[k]] = comp[x]
                    a.append(rep[x])
                    b.append(rep[k])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _confirm(percent: int):
    """Links from rows (leader, part, role, member, text) sorted by the first three: a leader's own text comes first."""
    def run(batches):
        now, own = None, np.zeros(0, U)
        release()
        for batch in slices(batches, "text"):
            a, b = [], []
            for leader, part, role, member, s in zip(*(batch.column(k).to_pylist() for k in range(4)), shingle_sets(batch.column(4))):
                if role == 0:
                    now, own = (leader, part), s
                elif now == (leader, part) and _linked(own, s, percent):
                    a.append(leader)
                    b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _texts_of(docs: DataFrame, ids: DataFrame, as_sets: bool = False) -> DataFrame:
    """(id, text), or (id, set), of the texts whose id is in ids. A bitmap of bounded size keeps most others from the shuffle; the join is exact.

    Sets are made in the step that reads the texts: a second Python step behind a broadcast join would be in the same stage, which
    then takes two workers for each core, and an executor keeps them all.
    """
    ids = table(ids, "ids")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, "id"))

    def run(batches):
        release()
        for batch in slices(batches, "text"):
            batch = batch.filter(pa.array(passes(bits.value, batch.column(0).to_numpy(False))))
            if as_sets:
                sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
                batch = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])
            yield batch

    return docs.mapInArrow(run, "id long, set binary" if as_sets else "id long, text string").join(ids, "id", "left_semi")


def _links(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on full sets.

    Only texts in a pair are read again. A leader with very many members is dealt out in parts of about
    BLOCK members, each with one copy of its set, so a text's set moves once per pair.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = table(size, "leaders")
    member = (pairs.join(own, "a").select(
        F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"),
        F.lit(1).alias("role"), F.col("b").alias("member")))
    leader = own.select(F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                        F.lit(0).alias("role"), F.col("a").alias("member"))
    roles = member.unionByName(leader)
    texts = _texts_of(docs, roles.select(F.col("member").alias("id")).distinct())
    rows = roles.join(texts, F.col("member") == F.col("id")).select("leader", "part", "role", "member", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, "leader", "part").sortWithinPartitions("leader", "part", "role")
            .mapInArrow(_confirm(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. Words are split at ASCII
    blanks, A-Z in lower case. A text without words, or a null, has an empty set and is linked with nothing, so it
    is kept. Rows that share an id must be equal in text; rows with a null id are not part of the result. Repeated texts
    and ties fall to the smallest id. Other columns are not read. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where("id is not null")
    signs = table(docs.mapInArrow(_signatures("id", "text", bands_for(percent)), "id long, n_shingles long, set1 long, set2 long, sign binary"), "signatures")
    filled = signs.where("sign is not null")
    first = filled.groupBy("set1", "set2").agg(F.min("id").alias("rep"), F.min("sign").alias("sign"), F.min("n_shingles").alias("n_shingles"))
    classes = table(first, "classes")
    links = _class_links(docs, classes.select("rep", "sign", "n_shingles"), percent)
    whole = connected_components(links, "a", "b")
    of = classes.select("set1", "set2", "rep").join(whole.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("set1", "set2", F.coalesce("component", "rep").alias("component"))
    of = table(of, "components")
    joined = signs.select("id", "n_shingles", "set1", "set2").where("set1 is not null").join(of, ["set1", "set2"])
    alone = signs.where("set1 is null").select("id", "n_shingles", F.col("id").alias("component"))
    return (joined.select("id", "n_shingles", "component").unionByName(alone)
            .select(F.col("id").alias(id_column), "n_shingles", F.col("component").alias("component_id"),
                    (F.col("id") == F.col("component")).alias("kept")))


def _class_links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    threshold = percent / 100
    banded = table(_bands(classes, bands_for(percent)).select("band", "key", "rep"), "bands")
    # buckets of one class hold no pair
    leaders = table(banded.groupBy("band", "key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = table(banded.join(leaders.select("band", "key", "a"), ["band", "key"]), "shared")
    delete_tables(banded, leaders)
    star = shared.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    sign = lambda x: classes.select(F.col("rep").alias(x), F.col("sign").alias(f"sign_{x}"))
    star = star.join(sign("b"), "b").join(sign("a"), "a").select("a", "b", "sign_a", "sign_b")
    likely = table(star.mapInArrow(_likely(threshold), "a long, b long"), "pairs")
    links = table(_links(docs, likely, percent), "links")
    part = table(connected_components(links, "a", "b"), "parts")
    delete_tables(likely)
    # buckets that hold several components
    of = (shared.join(part.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
          .join(classes.select("rep", "n_shingles"), "rep"))
    of = table(of.select("band", "key", "rep", "comp", "n_shingles"), "members")
    delete_tables(shared)
    with_sign = lambda df: df.join(classes.select("rep", "sign"), "rep")
    members = _mixed(of, F.ceil(F.count("*") / BLOCK_SIGNS))
    schema = "band int, key long, rep long"
    partners = table(with_sign(_grid(members)).groupBy("band", "key", "i", "j").applyInArrow(_block_partners(percent), schema).distinct(), "partners")
    near = _mixed(of.join(partners, ["band", "key", "rep"], "left_semi"),
                  F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)))
    sets = _texts_of(docs, near.select(F.col("rep").alias("id")).distinct(), as_sets=True)
    sets = table(sets.groupBy(F.col("id").alias("rep")).agg(F.min("set").alias("set")), "sets")
    found = with_sign(_grid(near)).join(sets, "rep").groupBy("band", "key", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    found = table(links.unionByName(found), "links")
    delete_tables(of, members, near, partners, sets, links, part)
    return found


def _mixed(members: DataFrame, blocks: Column) -> DataFrame:
    """Members of the buckets that hold several components, with the number of blocks of each bucket."""
    mixed = (members.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks.cast("int").alias("blocks"))
             .where("lo <> hi").select("band", "key", "blocks"))
    return table(members.join(table(mixed, "mixed"), ["band", "key"]), "members")


def _grid(members: DataFrame) -> DataFrame:
    """One row for each member and pair of blocks (i, j), i <= j, that its own block is in."""
    return (members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("band", "key", "rep", "comp", "n_shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))

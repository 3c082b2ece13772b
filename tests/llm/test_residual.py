import random
import zlib

import numpy as np
import pytest

from leadweave.llm import tokens
from leadweave.llm.queries import QUERIES
from leadweave.llm.residual import END, LENGTH, best_fit, pack_whole
from test_packing import PATH, whole_ids


def check(rows, ids_of, length=LENGTH):
    """Each id in one piece, documents cut only beyond a sequence, gapless sequences, right checksums; returns the number of sequences."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert set(docs) == set(ids_of)
    for d, ps in docs.items():
        ps.sort(key=lambda p: p["piece"])
        assert [(p["piece"], p["start"]) for p in ps] == [(k, k * length) for k in range(-(-len(ids_of[d]) // length))]
        for p in ps:
            part = ids_of[d][p["start"]:p["start"] + length]
            assert p["length"] == len(part) > 0 and p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length
    return len(seqs)


def ends(texts):
    return [ids[:-1] + [END] for ids in whole_ids(texts)]


def plain_best_fit(sizes, length):
    """Largest first, each into the bin that it leaves fullest."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= s
        else:
            room.append(length - s)
    return len(room)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_the_plain_one(seed):
    r = random.Random(seed)
    size = np.array([r.choice([1, 5, r.randint(1, 100), r.randint(30, 60)]) for _ in range(400)])
    number, place = best_fit(size, 100)
    assert number.max() + 1 == plain_best_fit(size.tolist(), 100)
    for k in range(number.max() + 1):
        own = np.flatnonzero(number == k)
        own = own[np.argsort(place[own])]
        assert (place[own] == np.cumsum(size[own]) - size[own]).all() and size[own].sum() <= 100


def test_round_trip_in_levels(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(90)}" for _ in range(r.choice([1, 7, 30, 70]))) for _ in range(400)]
    texts += [None, "", " ", "<|endoftext|> x", "a" * 900, "word " * 5000, "same", "same"]
    df = spark.createDataFrame([(i, t, 7, "b", 1) for i, t in enumerate(texts)], "doc_id long, text string, bin int, piece string, open int").repartition(9)
    ids = dict(enumerate(ends(texts)))
    # 30 items a task: some twenty partitions, merged eight to one twice
    made = check(pack_whole(df, PATH, length=128, slack=3, items=30).collect(), ids, 128)
    rest = [len(v) % 128 for v in ids.values() if len(v) % 128]
    whole = sum(len(v) // 128 for v in ids.values())
    assert whole + -(-sum(rest) // 128) <= made <= (whole + plain_best_fit(rest, 128)) * 1.05
    assert check(pack_whole(df, PATH).collect(), ids) == -(-sum(map(len, ids.values())) // LENGTH)


def test_items_that_do_not_combine_end_the_levels(spark):
    df = spark.createDataFrame([(i, "x " * 70) for i in range(300)], "doc_id int, text string").repartition(5)
    assert check(pack_whole(df, PATH, length=128, items=10).collect(), dict(enumerate(ends(["x " * 70] * 300))), 128) == 300


def test_no_rows_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "one"), (None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = pack_whole(df, PATH).collect()
    assert sum(r["length"] for r in rows) == 9 and len({r["sequence_id"] for r in rows}) == 1 and sorted(r["offset"] for r in rows)[0] == 0
    assert pack_whole(df.where("false"), PATH).collect() == []


def test_words_that_share_a_hash_are_encoded_apart(monkeypatch):
    import pyarrow as pa

    texts = ["alpha beta gamma", None, "beta beta"]
    want = [ids[:-1] for ids in whole_ids(texts)]
    monkeypatch.setattr(tokens.Words, "hashes", lambda self, again=False: np.arange(len(self.start), dtype=np.uint64) * np.uint64(again))
    tokens._tokenizer.cache_clear()
    assert [list(x) for x in tokens.encode(pa.array(texts), PATH)] == want


@pytest.mark.parametrize("seed", range(4))
def test_encode_equals_the_plain_tokenizer(seed):
    import pyarrow as pa

    r = random.Random(seed)
    signs = [*"abcXYZ'’.,;:!?()\"-_/\\<>|$%&09  \n\t", "é", "e\u0301", "\u0301", "Σ", "ς", "İ", "ß", "ﬁ", "中", "\u00a0", "\u200b", "…", "\U0001F600", "'s", "'LL", "don't", "<|endoftext|>",
             "<|startoftext|>", "<|END", "ab.cd", "\u0338", "\x1f"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(600)]
    texts = [t if k % 5 == 0 else t.replace("<|", "<") for k, t in enumerate(texts)]
    want = [ids[:-1] for ids in whole_ids(texts)]
    for begin in range(0, 600, 60):  # some batches hold special tokens, some don't
        part = [k for k in range(begin, begin + 60) if seed % 2 or k % 5]
        assert [x.tolist() for x in tokens.encode(pa.array([texts[k] for k in part]), PATH)] == [want[k] for k in part]


def test_query_packs_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    ids = dict(zip([d for d, _ in rows], ends([t for _, t in rows])))
    made = check(QUERIES["op11_best_fit"](spark, sf).collect(), ids)
    assert made <= plain_best_fit([len(v) % LENGTH for v in ids.values() if len(v) % LENGTH], LENGTH) + sum(len(v) // LENGTH for v in ids.values()) + 1

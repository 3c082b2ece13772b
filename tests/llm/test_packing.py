import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from leadweave.llm.packing import LENGTH, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def check(rows, ids_of):
    """Each id in one piece, gapless sequences, right checksums; returns the padding."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert set(docs) == set(ids_of)
    for d, ps in docs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            part = ids_of[d][at:at + p["length"]]
            assert p["start"] == at and p["length"] == len(part) > 0 and p["doc_tokens"] == len(ids_of[d])
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids_of[d])
    padding = 0
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= LENGTH
        padding += 0 if at & (at - 1) == 0 else LENGTH - at
    return padding


def test_round_trip_of_odd_texts(spark):
    r = random.Random(2)
    texts = [" ".join(f"{r.choice(['Tion', 'it’s', 'é', 'x1'])}{r.randrange(500)}" for _ in range(r.choice([3, 40, 900]))) for _ in range(150)]
    texts += [None, "", " ", "\n\n", "tab\tand no-break", "é ́ end", "<|endoftext|> don't", "x <|endoftext|> y", "a<|startoftext|>B", "<|ENDOFTEXT|>", "a" * 20_000, "x " * 30_000, "same", "same"]
    df = spark.createDataFrame([(i, t, 7, "b") for i, t in enumerate(texts)], "doc_id long, text string, row int, ids string").repartition(9)
    assert check(pack(df, PATH).collect(), dict(enumerate(whole_ids(texts)))) == 0


def test_no_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "one"), (None, "two")], "doc_id long, text string")
    assert sum(r["length"] for r in pack(df, PATH).collect()) == 4
    assert pack(df.where("false"), PATH).collect() == []

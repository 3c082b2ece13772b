import random

import brute
from leadweave.llm.components import connected_components
from leadweave.llm.minhash import near_duplicates


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def drift(r, words, n):
    """Copies of copies: neighbours are links, far ones are not."""
    out = [words]
    for _ in range(n - 1):
        words = list(words)
        words[r.randrange(len(words))] = f"w{r.random()}"
        out.append(words)
    return [" ".join(w) for w in out]


def test_equals_brute_force_on_drifting_groups_and_odd_texts(spark):
    r = random.Random(5)
    texts = [t for k in range(6) for t in drift(r, [f"g{k}x{r.randrange(900)}" for _ in range(120)], 25)]
    texts += texts[:20] + [None, "", " \n", "one", "ONE", "one two three four", "one two three four five", "Ünder ünder"]
    texts += ["same words here"] * 5 + ["x " * 30_000]
    r.shuffle(texts)
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df)) == brute.near_duplicates(rows)


def test_shared_word_clashing_columns_null_ids_and_no_rows(spark):
    rows = [(1, "a b c d e f g", 0, "x"), (2, "a b c d e f g", 1, "y"), (None, "a b c d e f g", 2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep int, component_id string")
    assert result(near_duplicates(df)) == {1: (3, 1, True), 2: (3, 1, False)}
    assert result(near_duplicates(df.where("false"))) == {}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 9), (9, 5), (7, 7), (9, 12), (None, 3)]
    df = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {tuple(r) for r in df.collect()} == {(i, 100) for i in range(100, 141)} | {(5, 5), (9, 5), (12, 5)}


def test_pipeline_stage_drops_what_shares_between_80_and_85_percent(spark):
    import corpus_pipeline
    words = [f"w{k}" for k in range(56)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:20] + ["new"] + words[21:]))]
    same, both = (lambda a, b: (len(a & b), len(a | b)))(*(brute.shingles(t) for _, t in rows))
    assert 80 * both <= 100 * same < 85 * both
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()] == [1]
    assert all(r["kept"] for r in near_duplicates(docs).collect())


def test_no_stage_takes_two_python_steps(spark, monkeypatch):
    from leadweave.llm import minhash

    most = []

    def steps(node, above=0):
        now = 0 if "Exchange" in node.nodeName() else above + ("InArrow" in node.nodeName())
        return max([now] + [steps(node.children().apply(k), now) for k in range(node.children().size())])

    def table(df, label, write=minhash.table):
        most.append(steps(df._jdf.queryExecution().sparkPlan()))
        return write(df, label)

    monkeypatch.setattr(minhash, "table", table)
    r = random.Random(6)
    rows = list(enumerate((t for k in range(3) for t in drift(r, [f"g{k}x{r.randrange(900)}" for _ in range(90)], 9)), 1))
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.near_duplicates(rows)
    assert max(most) == 1

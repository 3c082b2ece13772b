"""Bounded samples of labelled rows to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadweave.llm.tables import held_out


def smallest_hashes(rows: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """Of each label the n rows with the smallest hash of their key, and ``n``: their rank.

    Labels are few and are counted first. Rows far beyond the n-th smallest hash, by twice the share that n has of its label,
    are left out before anything is shuffled, so about 2 n rows of a label meet in a task, however many there are.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return rows.where("false").withColumn("n", F.lit(0))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(1 << 30)
    bound = F.create_map(*[x for k, c in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, (2 * n + 50) / c)))])
    near = rows.where(place <= F.element_at(bound, F.col(label)))
    order = W.partitionBy(label).orderBy(place, key)
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)


def training_ids(labels: DataFrame, label: Column, id_column: str = "doc_id") -> DataFrame:
    """(id, label): the ids that are not held out and have a label; of several labels of an id the smallest counts."""
    ids = labels.select(F.col(id_column).alias("id"), label.cast("int").alias("label")).where("id is not null and label is not null")
    return ids.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, per_class: int,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, label): at most per_class training rows of each label, those with the smallest hash of their id.

    Ids are chosen from the labels alone, so at most per_class * classes ids are broadcast and no text is shuffled. Rows held
    out, and those without an id or label, have no part (see :func:`training_ids`).
    """
    chosen = smallest_hashes(training_ids(labels, label, id_column), "label", "id", per_class).select("id", "label")
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id").where("text is not null")

"""From raw documents to packed training sequences, one table after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadweave.llm import decontam, langid, line_dedup, minhash, packing
from leadweave.llm.queries import TOKENIZER
from leadweave.llm.tables import documents, held_out, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those that none of the learned languages explains, go.

    A null or empty text has no letters. Each row is judged by its text alone, so repeated rows and null ids are like any other;
    ties of languages don't matter here. Very long texts are parsed whole. An empty table stays empty, and other columns are kept as they are.
    """
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    found = langid.identify(docs, model, carry=[c for c in docs.columns if c != "text"])
    known = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("bits") <= langid.MOST_BITS))
    return known.select(*[F.col("text") if c == "text" else F.col(f"carried.{c}").alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; a document of nothing else goes with them. ``n_chars`` follows the text.

    Null texts have no lines and stay. Repeated rows are one site's, as their source says, and share their fate; of documents that tie for a
    line that stays the smallest id has it. Null ids and sources are allowed, an empty table stays empty, other columns are kept as they are.
    """
    cut = line_dedup.remove_boilerplate(docs, carry=[c for c in docs.columns if c != "text"]).where("n_removed = 0 or trim(kept_text) <> ''")
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("carried.n_chars"))}
    return cut.select(*[(new[c] if c in new else F.col(f"carried.{c}")).cast(t).alias(c) for c, t in docs.dtypes])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; documents without an id are in no group.

    Repeated rows of one id stay or go together. Near means 80 % of the shingles of five words; the 85 % of op3 are its own.
    """
    copies = minhash.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also one with other values, go.

    Null texts hold none and stay, as documents without an id do, which are in no result of the operator. Repeated rows share their fate;
    which of several items a document holds doesn't matter. Texts are searched whole. An empty table, or an empty benchmark, drops nothing.
    """
    hit = decontam.benchmark_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences.

    A null or empty text is its end token alone. Null ids and repeated rows are packed like any other row, texts of any length are cut
    over several sequences; ties of open windows go to the first. Other columns are not read. An empty table gives no rows.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [("language", language_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage),
          ("benchmark", benchmark_stage), ("packing", packing_stage)]

#: the stages learn models, hash and tokenise: SQL does not express them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read back."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""JSON documents as files: one per line, or one per file over several lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import strip


def _one_value(text: Column) -> Column:
    """Whether a text is one JSON value with nothing behind it: only then the field after it is read."""
    return F.coalesce(F.from_json(F.concat(F.lit('{"v":'), text, F.lit('\n,"w":1}')), "v string, w int")["w"] == 1, F.lit(False))


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON files, and ``_file``; text that is no JSON is an error when it is read.

    Each file has its own form: it is read by line if all its lines with text are values of their own, else as one value over
    several lines. A file that is neither, such as one of several indented values, is an error. An array gives one row per element.
    A missing path is an error, an empty one gives no rows. Files are told apart by joins on their paths, however many there are; the
    lines of one value are put together again by block and line, so only such a value has to fit in memory.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"),
        F.regexp_replace("value", "^\ufeff", "").alias("_text")).filter(strip(F.col("_text")) != "")
    indented = lines.groupBy("_file").agg(F.bool_and(_one_value(F.col("_text"))).alias("_by_line")).filter(~F.col("_by_line")).select("_file")
    placed = F.sort_array(F.collect_list(F.struct("_block", "_line", "_text")))
    whole = lines.join(indented, "_file", "left_semi").groupBy("_file").agg(F.array_join(F.transform(placed, lambda x: x["_text"]), "\n").alias("_text"))
    error = F.raise_error(F.concat(F.lit("malformed JSON, or more than one value: "), "_file"))
    whole = whole.withColumn("_text", F.when(_one_value(F.col("_text")), F.col("_text")).otherwise(error))
    rows = lines.join(indented, "_file", "left_anti").select("_file", "_text").unionByName(whole)
    parsed = F.from_json("_text", T.ArrayType(schema), {"mode": "FAILFAST"})
    return rows.select("_file", F.explode(parsed).alias("_row")).select("_row.*", "_file")

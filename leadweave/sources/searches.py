"""Saved searches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed_values import DEFAULT_COUNTRY, DEFAULT_SEARCHES, SOURCES
from ..functions.text import filled
from ..schema import SEARCH_SCHEMA, blank_missing
from .documents import read_json


def default_searches(spark: SparkSession) -> DataFrame:
    rows = [(i, s["query"], "", "", s["city"], "", s["country"], None, None, SOURCES)
            for i, s in enumerate(DEFAULT_SEARCHES)]
    return spark.createDataFrame(rows, SEARCH_SCHEMA)


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing values of a saved search, and the place it asks about; without a limit it has none."""
    out = blank_missing(df).withColumns({
        "country": F.coalesce(filled(F.col("country")), F.lit(DEFAULT_COUNTRY)),
        "sources": F.coalesce("sources", F.array(*[F.lit(s) for s in SOURCES])),
    })
    return out.withColumn("place", F.concat_ws(
        ", ", filled(F.col("governorate")), filled(F.col("city"))))


def load_searches(spark: SparkSession, path: str | None) -> DataFrame:
    """Searches stored as JSON: an array, indented or not, or one object per line; the defaults if there is no file.

    A search without an id gets one from what it asks, which stays the same when others are added. Text
    that is no JSON is an error; an object that is no search gives no row.
    """
    if path is None:
        return with_defaults(default_searches(spark))
    try:
        raw = read_json(spark, path, SEARCH_SCHEMA)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return with_defaults(default_searches(spark))
    asked = [c for c in SEARCH_SCHEMA.fieldNames() if c != "search_id"]
    found = raw.filter(F.col("query").isNotNull()).withColumn("search_id", F.coalesce("search_id", F.xxhash64(*asked)))
    return with_defaults(found.select(*SEARCH_SCHEMA.fieldNames()))

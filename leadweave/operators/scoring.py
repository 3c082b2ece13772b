"""Score, tier and key columns of a lead table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scoring as S


def score_leads(df: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    return df.withColumn("confidence_score", S.confidence_score(weights))


def tier_leads(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence_tier", S.confidence_tier(F.col("confidence_score")))


def grade_leads(df: DataFrame) -> DataFrame:
    return tier_leads(score_leads(df))


def key_leads(df: DataFrame) -> DataFrame:
    """Fill a missing dedup_key; an existing one is kept. lead_id follows from the key."""
    key = F.coalesce(F.nullif(F.col("dedup_key"), F.lit("")), S.dedup_key())
    return df.withColumn("dedup_key", key).withColumn("lead_id", S.lead_id(F.col("dedup_key")))

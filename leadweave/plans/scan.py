"""Discovery to upsert, for all saved searches in one plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import DEFAULT_COUNTRY
from ..functions.text import clean_text, first_filled
from ..functions.urls import domain, with_canonical_url
from ..operators.enrich import enrich_sites
from ..operators.resolve import dedup_candidates, upsert_actions, upsert_leads
from ..operators.scoring import grade_leads
from ..operators.topk import top_per_group
from ..session import materialize
from ..sources.registry import union_sources


def cap_candidates(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` candidates of every search; taken before the costly enrichment."""
    return top_per_group(df, ["search_id"], ["ord"], n)


def backfill(df: DataFrame, searches: DataFrame) -> DataFrame:
    """Candidates with empty place, industry and category taken from their search."""
    crit = searches.select("search_id", *[F.col(c).alias(f"_c_{c}") for c in (
        "query", "industry", "category", "city", "governorate", "country")])
    return (df.join(crit, "search_id")
            .withColumns({
                **{c: first_filled(F.col(c), F.col(f"_c_{c}")) for c in ("city", "governorate", "industry")},
                "country": first_filled(F.col("country"), F.col("_c_country"), F.lit(DEFAULT_COUNTRY)),
                "category": first_filled(F.col("category"), F.col("_c_category"), F.col("_c_query")),
            }).drop(*[f"_c_{c}" for c in ("query", "industry", "category", "city", "governorate", "country")]))


def finalize_leads(df: DataFrame, searches: DataFrame) -> DataFrame:
    """Canonical website, back-filled columns, a name in every row, final grade."""
    out = backfill(with_canonical_url(df, "website", "website"), searches)
    out = out.withColumn("company_name", first_filled(
        clean_text(F.col("company_name")), domain(F.col("website")), F.lit("Unknown Business")))
    return grade_leads(out)


def scan(searches: DataFrame, inputs: Mapping[str, DataFrame], cap: int | None = None,
         extra: int | None = None) -> DataFrame:
    """Final candidates of all searches: union, de-dup, enrich, finalise.

    ``cap`` candidates of a search and ``extra`` linked pages of a site; without them all.
    """
    # de-duplication reads its input several times: the sources are mined once, into a table
    candidates = materialize(union_sources(searches, inputs), "candidates")
    found = dedup_candidates(candidates, ["search_id"])
    if cap is not None:
        found = cap_candidates(found, cap)
    if "pages" in inputs:
        found = enrich_sites(found, inputs["pages"], extra)
    else:
        found = found.withColumn("enriched", F.lit(False))
    return finalize_leads(found, searches)


#: searches run one after another, each in candidate order
SCAN_ORDER = ("search_id", "ord")


def store_scan(store: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    return upsert_leads(store, found, now, SCAN_ORDER)


def scan_totals(store: DataFrame, found: DataFrame) -> DataFrame:
    """Per search and (search_id NULL) in total: discovered, enriched, inserted, updated, unchanged."""
    acts = upsert_actions(store, found, SCAN_ORDER)
    rows = acts.join(found.select(*SCAN_ORDER, "enriched"), list(SCAN_ORDER))
    return rows.rollup("search_id").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if("enriched").alias("enriched"),
        F.count_if(F.col("action") == "inserted").alias("inserted"),
        F.count_if(F.col("action") == "updated").alias("updated"),
        F.count_if(F.col("action") == "unchanged").alias("unchanged"))

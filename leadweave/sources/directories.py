"""Stored directory listings and the directory source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fixed_values import (CARD_CLASSES, CARD_NAME_CLASSES, CARD_SITE_CLASSES,
                            DIRECTORY_OFFSITE_FRAGMENTS)
from ..functions.industry import guess_industry
from ..functions.pages import anchors, attribute, element_text, enclosed, opening_pattern
from ..functions.text import any_of, clean_text, first_filled
from ..functions.urls import with_canonical_url
from ..operators.scoring import grade_leads
from ..operators.topk import capped
from ..schema import conform


def _classed(names: list[str]) -> str:
    return (rf"""\sclass\s*=\s*["'](?:[^"']*\s)?(?:{any_of(names)})(?:\s[^"']*)?["']""")


def directory_cards(pages: DataFrame) -> DataFrame:
    """(name, website) of every listing card that has both, in page order."""
    opening = rf"(?i)(?=<[a-z0-9]+\b[^<>]*{_classed(CARD_CLASSES)})"
    cards = F.filter(F.split(F.col("html"), opening), lambda s: F.regexp_like(
        s, F.lit("^" + opening)))
    name_tag = opening_pattern(rf"<([a-z0-9]+)\b[^<>]*{_classed(CARD_NAME_CLASSES)}[^<>]*>")
    named, name = F.col("_card").rlike(name_tag), enclosed(F.col("_card"), F.lit(name_tag))
    # if the first has no anchor or end behind it, no later one has; anchors don't nest
    headed = r"(?is)<h3\b[^<>]*>(?:.*?<a\b[^<>]*>(?:(.*?)</a\s*>|.*+)|.*+)"
    site = rf"(?is)<a\b[^<>]*{_classed(CARD_SITE_CLASSES)}[^<>]*>"
    rows = pages.select("page", F.posexplode(cards).alias("pos", "_card"))
    rows = rows.select(
        "page", "pos",
        F.when(named, element_text(name))
        .otherwise(element_text(F.regexp_extract("_card", headed, 1))).alias("name"),
        attribute(F.regexp_extract("_card", site, 0), "href").alias("_href"))
    return (with_canonical_url(rows, "_href", "url").drop("_href")
            .filter((F.col("name") != "") & (F.col("url") != "")))


def directory_outlinks(pages: DataFrame, base: str) -> DataFrame:
    """(text, url) of anchors that lead away from the directory and from social sites."""
    host = base.replace("https://", "").replace("http://", "").split("/")[0]
    rows = pages.select("page", F.posexplode(anchors(F.col("html"))).alias("pos", "_a"))
    rows = rows.select(
        "page", "pos", element_text(F.regexp_extract("_a", r"(?is)^<a\b[^>]*>(.*)</a\s*>$", 1)).alias("name"),
        attribute(F.regexp_extract("_a", r"(?is)^<a\b[^>]*>", 0), "href").alias("_href"))
    rows = rows.filter(F.length("name") >= 3)
    urls = with_canonical_url(rows, "_href", "url", base).filter(F.col("url") != "")
    away = F.lower(F.regexp_extract("url", r"//([^/]*)", 1))
    return urls.filter(~away.rlike(any_of([host, *DIRECTORY_OFFSITE_FRAGMENTS]))).drop("_href")


def directory_dedup(hits: DataFrame, limit: int | DataFrame, scope: str = "search_id",
                    order: str = "ord") -> DataFrame:
    """First hit per (lower name, lower url) of each search, then the first ``limit``."""
    keep = [c for c in hits.columns if c not in {scope, order}]
    first = (hits.filter(F.col("name") != "")
             .groupBy(scope, F.lower("name").alias("_n"), F.lower("url").alias("_u"))
             .agg(F.min(F.struct(order, *keep)).alias("h")).select(scope, "h.*"))
    return capped(first, limit, scope, order)


def directory_hits_to_leads(hits: DataFrame, searches: DataFrame) -> DataFrame:
    """Listing hits with an industry guessed from the query and the name."""
    crit = searches.select(
        "search_id", "country", first_filled(F.col("query"), F.col("industry")).alias("_q"),
        first_filled(F.col("place"), F.col("city")).alias("_place"))
    joined = hits.select("search_id", "ord", "name", "url").join(crit, "search_id")
    guess = guess_industry(F.concat_ws(" ", "_q", "name"))
    leads = joined.select(
        "search_id", "ord", F.col("name").alias("company_name"), F.col("url").alias("website"),
        F.col("_place").alias("city"), "country",
        first_filled(guess, F.lit("Other")).alias("industry"),
        clean_text(F.col("_q")).alias("category"), F.col("url").alias("source_url"),
        F.concat(F.lit("Found via business directory for '"), "_q", F.lit("' in "), "_place",
                 F.lit(".")).alias("description"))
    return grade_leads(conform(leads))


def directory_candidates(searches: DataFrame, hits: DataFrame) -> DataFrame:
    """Directory source for all searches at once."""
    rows = with_canonical_url(hits, "url", "url").filter(F.col("url") != "")
    return directory_hits_to_leads(directory_dedup(rows, searches), searches)

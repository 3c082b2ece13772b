"""Text mining over document and page tables.

All extraction is row-local (no shuffle, the text never moves); only the small results are
exploded or grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fixed_values import (DISPOSABLE_DOMAINS, FREEMAIL_DOMAINS, HTTP_LINK_PATTERN,
                            NON_PAGE_HREFS, CONTACT_STEMS, ABOUT_STEMS, ROLE_MAILBOXES)
from ..functions import emails as E, pages as P, phones as N
from ..functions.text import any_of
from ..functions.urls import domain, social_platform, with_canonical_url
from .topk import top_per_group


def extract_emails(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, F.posexplode(E.extract_emails(F.col(text))).alias("pos", "email"))


def extract_phones(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, F.posexplode(N.phone_candidates(F.col(text))).alias("pos", "phone"))


def best_emails(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    best = df.select(*keys, E.best_email(E.extract_emails(F.col(text))).alias("email"))
    return best.filter(F.col("email").isNotNull())


def best_phones(df: DataFrame, keys: list[str], text: str, most: int = 5) -> DataFrame:
    numbers = N.best_phones(N.phone_candidates(F.col(text)), most=most)
    return df.select(*keys, F.posexplode(numbers).alias("pos", "e164"))


def with_email_lookups(df: DataFrame, email: str = "email") -> DataFrame:
    """Mark addresses by membership in the domain and mailbox lists (left joins).

    The lists are fixed and have 22 and 25 rows, which is why they may be broadcast.
    """
    spark = df.sparkSession
    hosts = spark.createDataFrame(
        [(d, "personal") for d in FREEMAIL_DOMAINS] + [(d, "disposable") for d in DISPOSABLE_DOMAINS],
        "_host string, host_class string")
    boxes = spark.createDataFrame([(m, True) for m in ROLE_MAILBOXES], "_box string, role_mailbox boolean")
    return (df.withColumn("_host", E.email_domain(F.col(email)))
            .withColumn("_box", E.email_mailbox(F.col(email)))
            .join(F.broadcast(hosts), "_host", "left")
            .join(F.broadcast(boxes), "_box", "left")
            .withColumn("role_mailbox", F.coalesce("role_mailbox", F.lit(False)))
            .fillna({"host_class": "other"}).drop("_host", "_box"))


def business_emails(df: DataFrame, email: str = "email") -> DataFrame:
    """Addresses whose domain is no freemail provider."""
    return df.filter(F.contains(F.col(email), F.lit("@"))
                     & ~E.email_domain(F.col(email)).isin(FREEMAIL_DOMAINS))


def role_emails(df: DataFrame, email: str = "email") -> DataFrame:
    """Addresses of department mailboxes."""
    return df.filter(F.contains(F.col(email), F.lit("@"))
                     & E.email_mailbox(F.col(email)).isin(ROLE_MAILBOXES))


def valid_emails(df: DataFrame, email: str = "email") -> DataFrame:
    return df.filter(E.is_valid_email(F.col(email)))


def extract_social_links(df: DataFrame, keys: list[str], html: str) -> DataFrame:
    """Distinct (keys, platform, url) with the position of the first occurrence in the page."""
    links = F.regexp_extract_all(F.col(html), F.lit(HTTP_LINK_PATTERN), F.lit(0))
    found = df.select(*keys, F.posexplode(links).alias("pos", "_link"))
    found = with_canonical_url(found, "_link", "url").filter(F.col("url") != "")
    found = join_social_hosts(found.withColumn("_link_host", domain(F.col("url"))), "_link_host")
    return found.groupBy(*keys, "platform", "url").agg(F.min("pos").alias("pos"))


def join_social_hosts(df: DataFrame, host: str = "host") -> DataFrame:
    """Inner match of hosts with the social platforms (host or parent domain)."""
    return (df.withColumn("platform", social_platform(F.col(host)))
            .filter(F.col("platform").isNotNull()))


def first_social(links: DataFrame, site: str, order: list[str]) -> DataFrame:
    """First LinkedIn, Facebook and Instagram link of every site, side by side."""
    return links.groupBy(site).agg(*[
        F.coalesce(F.min(F.when(F.col("platform") == p, F.struct(*order, "url")))["url"],
                   F.lit("")).alias(f"{p}_url")
        for p in ("linkedin", "facebook", "instagram")])


def contact_pages(df: DataFrame, keys: list[str], html: str, base: str) -> DataFrame:
    """Links of a page that look like contact or about pages: distinct URLs in order."""
    hrefs = df.select(*keys, base, F.posexplode(P.anchor_hrefs(F.col(html))).alias("pos", "_href"))
    hrefs = hrefs.filter(
        (F.col("_href") != "") & ~F.col("_href").rlike(rf"^(?:{any_of(NON_PAGE_HREFS)})")
        & F.lower("_href").rlike(any_of(CONTACT_STEMS + ABOUT_STEMS)))
    urls = with_canonical_url(hrefs, "_href", "url", F.col(base)).filter(F.col("url") != "")
    return urls.groupBy(*keys, base, "url").agg(F.min("pos").alias("pos"))


def cap_pages_per_site(links: DataFrame, site: str, order: list[str], base: str,
                       extra: int) -> DataFrame:
    """First ``extra`` contact pages of each site; the site's own URL is skipped after the cut."""
    kept = top_per_group(links, [site], order, max(extra, 1), rank="rank")
    return kept.filter(F.col("url") != F.col(base))

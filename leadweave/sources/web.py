"""Stored search-result pages and the search source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import RESULT_BLOCK_CLASS, RESULT_LINK_CLASS
from ..functions.pages import anchors, attribute
from ..functions.text import first_filled
from ..functions.urls import is_business_host, with_canonical_url
from ..operators.scoring import grade_leads
from ..operators.topk import behind, capped, top_per_group
from ..schema import conform


_RESULT_CLASS = rf"""(?is)^<a\b[^<>]*\sclass\s*=\s*["'](?:[^"']*\s)?{RESULT_LINK_CLASS}(?:\s[^"']*)?["']"""
_RESULT_TITLE = (rf"""(?is)(<li\b[^<>]*\sclass\s*=\s*["'](?:[^"']*\s)?{RESULT_BLOCK_CLASS}(?:\s[^"']*)?["'][^<>]*>"""
                 r"""[^<]*+(?:<(?!/li\b|h2\b|li\b[^<>]*\sclass\s*=\s*["'][^"']*RESULT)[^<]*+)*+<h2\b[^<>]*>\s*)<a\b""".replace("RESULT", RESULT_BLOCK_CLASS))


def _query_value(href: Column, name: str) -> Column:
    """Decoded value of a query parameter ('' if absent or undecodable)."""
    raw = F.regexp_extract(href, rf"[?&]{name}=([^&#]*)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def unwrap_link(engine: Column, href: Column) -> Column:
    """Target of a result link: the redirect parameter where the engine wraps its links."""
    wrapped = _query_value(href, "uddg")
    # the wrapped value is encoded twice; '+' is literal the second time
    twice = F.coalesce(F.try_url_decode(F.replace(wrapped, F.lit("+"), F.lit("%2B"))), wrapped)
    duck = (F.when(wrapped != "", twice)
            .when(href.startswith("//duckduckgo.com/l/"), "")
            .when(href.startswith("//"), F.concat(F.lit("https:"), href))
            .otherwise(href))
    google = F.when(href.startswith("/url?"), _query_value(href, "q")).otherwise(href)
    return F.when(engine == "duckduckgo", duck).when(engine == "google", google).otherwise(href)


def unwrap_result_links(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct canonical result URLs of stored result pages (page, engine, html), in order.

    Links with the engine's own result mark-up win; a page without any falls back to all its
    external links.
    """
    bing, google = F.col("engine") == "bing", F.col("engine") == "google"
    # the title link of each result block gets a mark, so that one pass over the anchors is enough
    html = F.when(bing, F.regexp_replace("html", _RESULT_TITLE, "$1<a data-title")).otherwise(F.col("html"))
    links = pages.select("page", "engine", F.posexplode(anchors(html)).alias("pos", "_a"))
    main = F.when(bing, F.col("_a").startswith("<a data-title")).when(google, True).otherwise(
        F.col("_a").rlike(_RESULT_CLASS))
    links = links.select("page", "engine", "pos", main.alias("main"),
                         attribute(F.col("_a"), "href").alias("_href"))
    links = links.withColumn("_real", unwrap_link(F.col("engine"), F.col("_href")))
    real = F.col("_real")
    own = F.when(google, F.contains(real, F.lit("google."))).otherwise(
        bing & ~F.col("main") & real.rlike(r"bing\.|microsoft\."))
    plain = F.col("main") & (F.col("engine") == "duckduckgo")
    kept = links.filter(F.when(plain, real != "").otherwise(real.startswith("http") & ~own))
    urls = with_canonical_url(kept, "_real", "url").filter(F.col("url") != "")
    first = urls.groupBy("page", "engine", "url").agg(
        F.min(F.when(F.col("main"), F.col("pos"))).alias("_main"), F.min("pos").alias("_any"))
    # a group is one stored page here, so its size is that of a document
    page = Window.partitionBy("page")
    used = first.withColumn("_mains", F.count("_main").over(page)).filter(
        (F.col("_mains") == 0) | F.col("_main").isNotNull())
    order = page.orderBy(F.coalesce("_main", "_any"))
    ranked = used.select("page", "engine", "url", F.row_number().over(order).alias("rank"))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def business_hosts(df: DataFrame, url: str = "url") -> DataFrame:
    """Drop URLs without a host and those whose host contains a junk fragment."""
    return df.filter(is_business_host(F.col(url)))


def ordered_distinct_urls(df: DataFrame, limit: int | DataFrame, scope: str = "search_id",
                          order: str = "ord", url: str = "url") -> DataFrame:
    """Distinct business URLs of each search at their first position, then the first ``limit``.

    ``limit`` is a number or a (scope, limit) table.
    """
    first = business_hosts(df.filter(F.col(url) != ""), url).groupBy(scope, url).agg(
        F.min(order).alias(order))
    return capped(first, limit, scope, order)


def source_cascade(df: DataFrame, limits: DataFrame) -> DataFrame:
    """URLs that count, of rows (search_id, engine 0/1/2, ord, url); no host filter or cap yet.

    The second engine is asked only if the first gave fewer than limit/2 URLs, the third only if
    the running distinct list is shorter than limit/4. Each engine itself returns at most
    ``limit`` distinct URLs. A search without a limit asks all and takes all. The new ``ord`` is the engine, then the place in it.
    """
    given = df.groupBy("search_id", "engine", "url").agg(F.min("ord").alias("ord"))
    given = given.join(limits.select("search_id", "limit"), "search_id")
    given = top_per_group(given, ["search_id", "engine"], ["ord"], F.col("limit"))
    urls = given.groupBy("search_id", "limit", "url").agg(
        F.min(F.struct("engine", "ord")).alias("h")).select("search_id", "limit", "url", "h.*")
    sizes = urls.groupBy("search_id").agg(
        F.count_if(F.col("engine") == 0).alias("n1"),
        F.count_if(F.col("engine") <= 1).alias("n12"))
    # by now a search has at most 3 * limit rows
    gated = urls.join(sizes, "search_id")
    second = F.col("limit").isNull() | (F.col("n1") < F.floor(F.col("limit") / 2))
    third = second & (F.col("limit").isNull() | (F.col("n12") < F.floor(F.col("limit") / 4)))
    return gated.filter((F.col("engine") == 0) | ((F.col("engine") == 1) & second) | third).select(
        "search_id", "engine", behind(gated, F.col("engine")).alias("ord"), "url")


def search_hits_to_leads(hits: DataFrame, searches: DataFrame) -> DataFrame:
    """URLs found by the search source, with what the search itself says about them."""
    crit = searches.select("search_id", "query", "industry", "category", "city", "governorate",
                           "country")
    joined = hits.select("search_id", "ord", "url").join(crit, "search_id")
    leads = joined.select(
        "search_id", "ord", F.col("url").alias("website"), F.col("url").alias("source_url"),
        "city", "governorate", "country", "industry",
        first_filled(F.col("category"), F.col("query")).alias("category"),
        F.concat(F.lit("Discovered via search for '"), "query", F.lit("'.")).alias("description"))
    return grade_leads(conform(leads))


def search_candidates(searches: DataFrame, hits: DataFrame) -> DataFrame:
    """Search source for all searches at once: canonical, distinct, capped by the search."""
    urls = ordered_distinct_urls(with_canonical_url(hits, "url", "url"), searches)
    return search_hits_to_leads(urls, searches)

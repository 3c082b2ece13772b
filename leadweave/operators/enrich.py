"""Facts of crawled pages and the enrichment of leads from them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import emails as E, pages as P, phones as N
from ..functions.industry import guess_industry
from ..functions.text import filled, first_filled, html_to_text
from ..functions.urls import canonical_url, with_canonical_url
from ..session import materialize
from ..sources.pagestore import needed_pages, stored
from .scoring import grade_leads


@functools.lru_cache(4)
def _fact_columns(application: str) -> tuple[Column, ...]:
    """The extractors as columns over page_url, html, _text, _social and _metas; building them takes seconds, so once for an application."""
    html, text, social, metas = F.col("html"), F.col("_text"), F.col("_social"), F.col("_metas")
    number = F.get(N.best_phones(N.phone_candidates(F.when(text != "", text).otherwise(html)), most=1), F.lit(0))
    links = F.transform(P.contact_hrefs(html), lambda h: canonical_url(h, base_column="page_url"))
    facts = {
        "email": E.best_ranked_email(E.extract_emails(html)), "phone": number, "whatsapp": P.whatsapp(html),
        **{f"{x}_url": P.first_social(social, x) for x in ("linkedin", "facebook", "instagram")},
        "company_name": P.company_name(html, F.col("page_url"), metas), "meta": P.meta_description(html, metas),
        "sentence": P.first_sentence(text), "node": P.address_node(html), "line": P.address_line(text),
        "employees": P.employees(text), "contact_person": P.ranked_contact_person(text),
        "html_chars": F.length(html), "text_md5": F.md5(text),
        "links": F.array_distinct(F.filter(links, lambda u: (u != "") & (u != F.col("page_url")))),
    }
    return html_to_text(html), P.social_links(html), P.meta_tags(html), *[c.alias(n) for n, c in facts.items()]


def extract_facts(pages: DataFrame) -> DataFrame:
    """What the extractors find on pages (page_url, page_id, html): one small row each, with the contact pages it links to."""
    text, social, metas, *facts = _fact_columns(pages.sparkSession.sparkContext.applicationId)
    return pages.withColumns({"_text": text, "_social": social, "_metas": metas}).select("page_url", "page_id", *facts)


def page_facts(pages: DataFrame) -> DataFrame:
    """Facts of every page of a table (page_id, url, html); of several pages with one URL the lowest id counts."""
    rows = with_canonical_url(pages, "url", "page_url").filter(F.col("page_url") != "")
    facts = extract_facts(rows)
    of = [c for c in facts.columns if c != "page_url"]
    return facts.groupBy("page_url").agg(F.min_by(F.struct(*of), "page_id").alias("f")).select("page_url", "f.*")


def needed_facts(store: DataFrame, sites: DataFrame, extra: int | None = None, facts: list[str] | None = None) -> DataFrame:
    """Facts of the pages that sites (site) need: their own page and those that it links to, ``extra`` of them if given.

    Each needed page is read and mined once, all others not at all. What was found is written, so that later steps read facts alone; as
    nothing is left out of a written table, a caller that reads some of the facts only names them in ``facts``. The links are always there.
    """
    def mined(urls: DataFrame) -> DataFrame:
        found = extract_facts(needed_pages(store, urls))
        return materialize(found if facts is None else found.select("page_url", "page_id", *facts, "links"), "page-facts")

    home = mined(sites.select(F.col("site").alias("page_url")))
    linked = home.select(F.explode(_linked(extra)).alias("page_url")).distinct().join(home.select("page_url"), "page_url", "left_anti")
    return home.unionByName(mined(linked))


def _linked(extra: int | None) -> Column:
    return F.col("links") if extra is None else F.slice("links", 1, extra)


def site_pages(sites: DataFrame, facts: DataFrame, extra: int | None = None) -> DataFrame:
    """Pages that stand for each distinct ``site`` URL: the page of that URL, then those that it links to.

    A site whose own page was not crawled has none. ``extra`` limits the linked URLs of a site; without it all are taken.
    """
    home = sites.select("site").distinct().join(facts, F.col("site") == F.col("page_url"))
    linked = (home.select("site", F.posexplode(_linked(extra)).alias("pos", "_linked"))
              .join(facts, F.col("_linked") == F.col("page_url")).withColumn("page_rank", F.col("pos") + 2))
    return home.withColumn("page_rank", F.lit(1)).unionByName(linked.drop("pos", "_linked"))


def site_fields(selected: DataFrame) -> DataFrame:
    """Per site the first value of each field in page order; minima of small structs, combined in the map tasks."""
    def first(column: str, *rank: Column | str) -> Column:
        c = F.col(column)
        return F.coalesce(F.min(F.when(c != "", F.struct(*rank, "page_rank", c.alias("v"))))["v"], F.lit(""))

    out = selected.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"),
        F.coalesce(F.min(F.when(F.col("email").isNotNull(), F.struct(
            F.col("email.rank").alias("r"), "page_rank", F.col("email.email").alias("v"))))["v"], F.lit("")).alias("s_email"),
        first("phone", (~N.is_mobile(F.col("phone"))).alias("r")).alias("s_phone"),
        *[first(c).alias(f"s_{c}") for c in ("whatsapp", "linkedin_url", "facebook_url", "instagram_url")],
        F.min(F.when(F.col("page_rank") == 1, F.col("company_name"))).alias("s_company_name"),
        F.min(F.when(F.col("page_rank") == 1, F.col("meta"))).alias("_meta"), first("sentence").alias("_sentence"),
        first("node").alias("_node"), first("line").alias("_line"),
        first("employees", F.col("employees").endswith("+ employees").alias("r")).alias("s_employees"),
        F.coalesce(F.min(F.when(F.col("contact_person").isNotNull(), F.struct(
            F.col("contact_person.rank").alias("r"), "page_rank", F.col("contact_person.name").alias("v"))))["v"],
            F.lit("")).alias("s_contact_person"))
    return out.withColumn("s_description", first_filled(F.col("_meta"), F.col("_sentence"))).withColumn(
        "s_address", first_filled(F.col("_node"), F.col("_line"))).drop("_meta", "_sentence", "_node", "_line")


def with_site(leads: DataFrame) -> DataFrame:
    """``site``: the canonical URL of the lead's website, NULL without one."""
    return with_canonical_url(leads, "website", "_site").withColumn("site", filled(F.col("_site"))).drop("_site")


def join_site_pages(leads: DataFrame, selected: DataFrame) -> DataFrame:
    """Leads with the pages of their site; a lead without pages stays, with NULLs."""
    return with_site(leads).join(selected, "site", "left")


_FILLED = ["email", "phone", "whatsapp", "linkedin_url", "facebook_url", "instagram_url",
           "company_name", "description", "address", "employees", "contact_person"]


def enrich_sites(leads: DataFrame, pages: DataFrame, extra: int | None = None) -> DataFrame:
    """Fill the empty fields of leads from their sites and grade them again.

    A site is the page at the lead's own canonical URL with the contact and about pages that it links to, so businesses
    on one host stay apart. Leads without a website, or whose own page was not crawled, pass through unchanged. ``pages`` is a page
    store, or a table (page_id, url, html) of which one is made first. Pages that no lead needs are not mined. What was found is written: both sides of the join with the leads are then plain exchanges, and the adaptive join splits
    a URL that very many leads share.
    """
    cols = leads.columns
    sited = with_site(leads)
    wanted = sited.filter(F.col("site").isNotNull()).select("site").distinct()
    facts = needed_facts(stored(pages), wanted, extra)
    fields = materialize(site_fields(site_pages(wanted, facts, extra)), "site-fields")
    # rows without a site get a key of their own, so that they do not share one task
    key = F.coalesce(F.col("site"), F.concat(F.lit(" "), F.xxhash64(*cols).cast("string")))
    joined = sited.withColumn("_site_url", F.col("site")).withColumn("site", key).join(fields, "site", "left")
    hit = F.col("pages").isNotNull()
    out = joined.withColumns({
        **{c: F.coalesce(filled(F.col(c)), F.col(f"s_{c}"), F.lit("")) for c in _FILLED},
        "source_url": F.when(hit, F.coalesce(filled(F.col("source_url")), F.col("_site_url")))
        .otherwise(F.col("source_url")),
        "_old_score": F.col("confidence_score"), "_old_tier": F.col("confidence_tier")})
    blob = F.concat_ws(" ", *[filled(F.col(c)) for c in
                              ("company_name", "description", "category", "address")])
    out = grade_leads(out.withColumn("industry", F.when(
        hit & (F.col("industry") == ""), guess_industry(blob)).otherwise(F.col("industry"))))
    out = out.withColumns({
        "confidence_score": F.when(hit, F.col("confidence_score")).otherwise(F.col("_old_score")),
        "confidence_tier": F.when(hit, F.col("confidence_tier")).otherwise(F.col("_old_tier"))})
    return out.select(*cols, hit.alias("enriched"))

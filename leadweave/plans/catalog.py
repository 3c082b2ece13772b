"""Every operator as a runnable query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import emails as E, pages as P, phones as N
from ..functions.industry import guess_industry
from ..functions.text import clean_text, html_to_text
from ..functions.urls import domain, with_canonical_url
from ..operators import enrich, mining as M, query as Q, resolve as R, scoring as S
from ..operators.topk import top_per_group
from ..schema import EXPORT_COLUMNS, LEAD_COLUMNS
from ..session import materialize, scratch_dir, spread
from ..sources import directories, osm, sinks, web
from ..sources.pagestore import write_page_store
from ..sources.registry import union_sources
from ..sources.searches import load_searches
from ..streaming import ticks
from ..streaming.upsert import stream_upsert
from . import fixtures as X, report, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _shown(df: DataFrame) -> DataFrame:
    """Lead columns in canonical order, with the two timestamps as ISO text."""
    return df.select(*[
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if c.endswith("_at") else F.col(c)
        for c in LEAD_COLUMNS])


def _as_of():
    return X.moment(X.AS_OF)


def _since(days: int):
    return report.period_start(_as_of(), days)


LOOKUP_KEY = "dom:biz7.example.com"
DIRECTORY = "https://directory.example.org"


# --- scans, sources, sinks -------------------------------------------------------------------
@query
def scan_leads(spark, sf):
    return _shown(Q.rank_leads(X.leads(spark, sf)))


@query
def lookup_lead(spark, sf):
    import hashlib
    root = scratch_dir(spark, "lookup")
    sinks.write_snapshot(X.leads(spark, sf), root, 0)
    return _shown(sinks.read_lead(spark, root, 0, hashlib.md5(LOOKUP_KEY.encode()).hexdigest()))


@query
def scan_osm_elements(spark, sf):
    path = scratch_dir(spark, "elements")
    X.element_documents(spark, sf).write.text(path)
    found = osm.named_elements(osm.read_elements(spark, path))
    return found.select("response_id", "pos", "name", "lat", "lon", F.concat_ws(
        ",", F.array_sort(F.map_keys("tags"))).alias("tag_keys"))


@query
def scan_site_pages(spark, sf):
    return _selected_pages(spark, sf).select("site", "page_rank", "page_id", "html_chars", "text_md5")


def _selected_pages(spark, sf):
    sites = enrich.with_site(X.site_leads(spark, sf)).filter("site is not null")
    store = write_page_store(X.crawled_pages(spark, sf), scratch_dir(spark, "page-store"))
    return enrich.site_pages(sites, enrich.needed_facts(store, sites, facts=["html_chars", "text_md5"]))


@query
def scan_saved_searches(spark, sf):
    path = scratch_dir(spark, "searches")
    X.saved_search_documents(spark, sf).write.text(path)
    found = load_searches(spark, path).fillna({"radius_km": 0, "limit": -1})   # -1: none
    return found.withColumn("sources", F.concat_ws(",", "sources"))


@query
def export_leads_csv(spark, sf):
    path = scratch_dir(spark, "export")
    sinks.export_leads_csv(X.leads(spark, sf), path)
    return sinks.read_leads_csv(spark, path)


@query
def write_report_json(spark, sf):
    path = scratch_dir(spark, "report")
    _, doc = report.write_report(report.period_report(X.leads(spark, sf), _as_of(), 7), _as_of(), 7, path)
    return spark.read.text(doc)


@query
def write_report_text(spark, sf):
    return report.report_lines(report.period_report(X.leads(spark, sf), _as_of(), 1), _as_of(), 1)


@query
def append_scan_history(spark, sf):
    runs = X.scan_history(spark, sf)
    old = F.col("label") < "2024-01-10"
    return sinks.append_scan_history(runs.filter(old), runs.filter(~old))


@query
def delete_leads(spark, sf):
    leads = X.leads(spark, sf)
    ids = leads.filter(F.col("confidence_score") < 40).select("lead_id")
    return _shown(R.delete_leads(leads, ids))


# --- projections -----------------------------------------------------------------------------
@query
def export_projection(spark, sf):
    return Q.export_projection(X.leads(spark, sf))


@query
def browse_projection(spark, sf):
    return Q.browse_run(X.leads(spark, sf))


@query
def osm_to_leads(spark, sf):
    el = X.elements(spark, sf).withColumn("place", F.lit("Cairo")).withColumn("country", F.lit("Egypt"))
    return osm.osm_to_leads(el).select("ord", *EXPORT_COLUMNS)


@query
def search_hits_to_leads(spark, sf):
    hits = with_canonical_url(X.hits(spark, sf), "url", "url").filter(F.col("source") == "search")
    return web.search_hits_to_leads(hits, X.searches(spark, sf)).select("search_id", "ord", *EXPORT_COLUMNS)


@query
def directory_hits_to_leads(spark, sf):
    hits = with_canonical_url(X.hits(spark, sf), "url", "url").filter(F.col("source") == "directories")
    return directories.directory_hits_to_leads(hits, X.searches(spark, sf)).select(
        "search_id", "ord", *EXPORT_COLUMNS)


@query
def finalize_leads(spark, sf):
    return scan.finalize_leads(X.raw_leads(spark, sf), X.searches(spark, sf)).select(
        "ord", *EXPORT_COLUMNS)


@query
def score_leads(spark, sf):
    return S.score_leads(X.raw_leads(spark, sf)).select("ord", "confidence_score")


@query
def tier_leads(spark, sf):
    return S.grade_leads(X.raw_leads(spark, sf)).select("ord", "confidence_score", "confidence_tier")


@query
def dedup_keys(spark, sf):
    return S.key_leads(X.raw_leads(spark, sf)).select("ord", "dedup_key", "lead_id")


# --- filters ---------------------------------------------------------------------------------
@query
def search_leads(spark, sf):
    return _shown(Q.search_leads(X.leads(spark, sf), industry="Machinery", country="asia",
                                 source="BIZ", keyword="descr", min_score=60, limit=50))


@query
def filter_industry(spark, sf):
    return _shown(Q.filter_industry(X.leads(spark, sf), "Building"))


@query
def filter_city(spark, sf):
    root = scratch_dir(spark, "folded")
    sinks.write_snapshot(X.leads(spark, sf), root, 0)
    return _shown(Q.filter_equal(sinks.read_snapshot(spark, root, 0, folded=True), "city", "nation_3"))


@query
def filter_governorate(spark, sf):
    return _shown(Q.filter_equal(X.leads(spark, sf), "governorate", "GOV 4"))


@query
def filter_country(spark, sf):
    return _shown(Q.filter_equal(X.leads(spark, sf), "country", "europe"))


@query
def filter_source(spark, sf):
    return _shown(Q.filter_source(X.leads(spark, sf), "BIZ1_.example"))


@query
def filter_min_score(spark, sf):
    return _shown(Q.filter_min_score(X.leads(spark, sf), 85))


@query
def filter_keyword(spark, sf):
    return _shown(Q.filter_keyword(X.leads(spark, sf), "shared NAME 1"))


@query
def missing_contact(spark, sf):
    return Q.missing_contact(X.leads(spark, sf)).select("ord", "company_name", "email", "phone", "missing")


@query
def leads_since(spark, sf):
    return _shown(Q.leads_since(X.leads(spark, sf), _since(7)))


@query
def business_hosts(spark, sf):
    return web.business_hosts(with_canonical_url(X.hits(spark, sf), "url", "url")).select("ord", "url")


def _addresses(spark, sf):
    """All addresses found in texts and the raw lead addresses (valid or not)."""
    found = M.extract_emails(X.texts(spark, sf), ["src", "id"], "text").select("src", "id", "email")
    raw = X.raw_leads(spark, sf).select(F.lit("raw").alias("src"), F.col("ord").alias("id"), "email")
    return found.unionByName(raw)


@query
def business_emails(spark, sf):
    return M.business_emails(_addresses(spark, sf))


@query
def role_emails(spark, sf):
    return M.role_emails(_addresses(spark, sf))


@query
def valid_emails(spark, sf):
    return M.valid_emails(_addresses(spark, sf))


@query
def osm_tag_filter(spark, sf):
    return osm.osm_tag_filter(X.elements(spark, sf), F.lit("Dental")).select("ord")


@query
def within_radius(spark, sf):
    near = osm.within_radius(X.elements(spark, sf), 30.0444, 31.2357)
    return near.select("ord", F.round("metres").cast("bigint").alias("metres"))


def _contact_links(spark, sf):
    pages = X.site_pages(spark, sf).withColumn("base", F.concat(F.lit("https://"), "host"))
    return M.contact_pages(pages, ["host", "page_id"], "html", "base")


@query
def contact_pages(spark, sf):
    return _contact_links(spark, sf).select("page_id", "url", "pos")


@query
def directory_outlinks(spark, sf):
    return directories.directory_outlinks(X.listing_pages(spark, sf), DIRECTORY)


# --- joins -----------------------------------------------------------------------------------
@query
def join_batch_to_store(spark, sf):
    return R.upsert_actions(*X.store_and_batch(spark, sf))


@query
def join_osm_industry(spark, sf):
    return osm.join_osm_industry(X.elements(spark, sf)).select("ord", "industry")


@query
def join_criteria_backfill(spark, sf):
    out = scan.backfill(X.raw_leads(spark, sf), X.searches(spark, sf))
    return out.select("search_id", "ord", "city", "governorate", "country", "industry", "category")


@query
def join_site_pages(spark, sf):
    joined = enrich.join_site_pages(X.site_leads(spark, sf), _selected_pages(spark, sf))
    return joined.select("ord", "website", "site", "page_rank", "page_id").fillna(
        {"site": "", "page_rank": 0, "page_id": -1})


@query
def geocode_places(spark, sf):
    leads = X.raw_leads(spark, sf).select("ord", F.lower("city").alias("city"))
    return osm.geocode_places(leads, X.gazetteer(spark, sf), "city").select("ord", "place_name", "lat", "lon")


@query
def join_email_domain_class(spark, sf):
    return M.with_email_lookups(_addresses(spark, sf)).select(
        "src", "id", "email", "host_class", "role_mailbox")


@query
def join_social_hosts(spark, sf):
    urls = with_canonical_url(X.hits(spark, sf), "url", "url").withColumn("host", domain(F.col("url")))
    return M.join_social_hosts(urls).select("ord", "host", "platform")


# --- aggregations ----------------------------------------------------------------------------
@query
def count_leads(spark, sf):
    return Q.count_leads(X.leads(spark, sf))


@query
def counts_since(spark, sf):
    return Q.counts_since(X.leads(spark, sf), _since(7))


@query
def facet_industry(spark, sf):
    return Q.facet(X.leads(spark, sf), "industry")


@query
def facet_city(spark, sf):
    return Q.facet(X.leads(spark, sf), "city")


@query
def facet_country(spark, sf):
    return Q.facet(X.leads(spark, sf), "country")


@query
def facet_tier(spark, sf):
    return Q.facet(X.leads(spark, sf), "confidence_tier")


@query
def facets_all(spark, sf):
    return Q.facets_all(X.leads(spark, sf))


@query
def facet_source_host(spark, sf):
    return Q.facet_source_host(X.leads(spark, sf))


@query
def avg_score(spark, sf):
    return Q.avg_score(X.leads(spark, sf))


@query
def facet_cardinality(spark, sf):
    return Q.facet_cardinality(X.leads(spark, sf))


@query
def top_values(spark, sf):
    return Q.top_values(Q.leads_since(X.leads(spark, sf), _since(7)), ["industry", "city"])


@query
def upsert_action_counts(spark, sf):
    return R.upsert_counts(*X.store_and_batch(spark, sf))


@query
def scan_totals(spark, sf):
    store, _ = X.store_and_batch(spark, sf)
    found = materialize(scan.scan(X.searches(spark, sf), X.scan_inputs(spark, sf)), "found")
    return scan.scan_totals(store, found).fillna({"search_id": -1})   # -1: all searches


@query
def period_report(spark, sf):
    return report.period_report(X.leads(spark, sf), _as_of(), 30)


# --- first seen wins -------------------------------------------------------------------------
@query
def dedup_candidates(spark, sf):
    return R.dedup_candidates(X.raw_leads(spark, sf)).select("ord", *EXPORT_COLUMNS)


@query
def merge_leads(spark, sf):
    rows = S.grade_leads(X.raw_leads(spark, sf)).withColumn("domain", domain(F.col("website")))
    merged = R.merge_leads(rows.filter(F.col("domain") != ""), ["domain"])
    return merged.select("domain", "ord", *EXPORT_COLUMNS)


@query
def osm_name_dedup(spark, sf):
    return osm.osm_name_dedup(X.elements(spark, sf), limit=500).select("ord", "name")


@query
def directory_dedup(spark, sf):
    hits = X.hits(spark, sf).select(
        "search_id", "ord", F.regexp_replace("name", "#[0-9]+", "").alias("name"),
        F.regexp_replace("url", "(home/.*|[0-9]+$)", "").alias("url"))
    return directories.directory_dedup(hits, 20)


@query
def best_email(spark, sf):
    return M.best_emails(X.texts(spark, sf), ["src", "id"], "text")


@query
def best_phones(spark, sf):
    return M.best_phones(X.texts(spark, sf), ["src", "id"], "text")


@query
def first_social(spark, sf):
    links = M.extract_social_links(X.site_pages(spark, sf), ["host", "page_id"], "html")
    return M.first_social(links, "host", ["page_id", "pos"])


@query
def cap_pages_per_site(spark, sf):
    return M.cap_pages_per_site(_contact_links(spark, sf), "host", ["page_id", "pos"], "base", 4).select(
        "host", "page_id", "url", "rank")


# --- top-k -----------------------------------------------------------------------------------
@query
def rank_leads(spark, sf):
    return _shown(Q.rank_leads(X.leads(spark, sf), 100))


@query
def topk_new(spark, sf):
    return _shown(Q.topk_new(X.leads(spark, sf), _since(1)))


@query
def topk_missing(spark, sf):
    return _shown(Q.topk_missing(X.leads(spark, sf)))


@query
def cap_candidates(spark, sf):
    return scan.cap_candidates(X.raw_leads(spark, sf), 20).select("search_id", "ord", "company_name")


@query
def cap_per_source(spark, sf):
    hits = X.hits(spark, sf).join(X.searches(spark, sf).select("search_id", "limit"), "search_id")
    return top_per_group(hits, ["search_id", "source"], ["ord"], F.col("limit")).select(
        "search_id", "source", "ord")


# --- set operations --------------------------------------------------------------------------
@query
def union_of_sources(spark, sf):
    return union_sources(X.searches(spark, sf), X.scan_inputs(spark, sf)).select(
        "search_id", _shown_place(), "source", *EXPORT_COLUMNS)


QUERIES["union_sources"] = QUERIES.pop("union_of_sources")


def _shown_place():
    return F.array_join("ord", ".").alias("ord")


def _engine_hits(spark, sf):
    """Hits in the order of pages with very large ids, and of places on them."""
    page = (F.expr(f"ord div 10 * {X.PAGE_STEP}"), F.col("ord") % 10)
    return with_canonical_url(X.hits(spark, sf), "url", "url").select("search_id", "engine", F.array(*page).alias("ord"), "url")


@query
def ordered_distinct_urls(spark, sf):
    return web.ordered_distinct_urls(_engine_hits(spark, sf), X.searches(spark, sf)).select(
        "search_id", _shown_place(), "url")


@query
def source_cascade(spark, sf):
    limits = X.searches(spark, sf)
    used = web.source_cascade(_engine_hits(spark, sf), limits)
    return web.ordered_distinct_urls(used, limits).select("search_id", _shown_place(), "url")


# --- text mining -----------------------------------------------------------------------------
@query
def clean_text_table(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


def _raw_urls(spark, sf):
    pages = X.table(spark, sf, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), "url")
    sites = X.raw_leads(spark, sf).select(F.lit("lead").alias("src"), F.col("ord").alias("id"),
                                          F.col("website").alias("url"))
    return pages.unionByName(sites)


@query
def canonical_urls(spark, sf):
    return with_canonical_url(_raw_urls(spark, sf), "url", "canonical").select("src", "id", "canonical")


@query
def domains(spark, sf):
    return _raw_urls(spark, sf).select("src", "id", domain(F.col("url")).alias("domain"))


@query
def extract_emails(spark, sf):
    return M.extract_emails(X.texts(spark, sf), ["src", "id"], "text")


@query
def classify_emails(spark, sf):
    return _addresses(spark, sf).withColumn("kind", E.classify_email(F.col("email"))).groupBy(
        "src", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("email").alias("addresses"))


@query
def extract_phones(spark, sf):
    return M.extract_phones(X.texts(spark, sf), ["src", "id"], "text")


def _numbers(spark, sf):
    found = M.extract_phones(X.texts(spark, sf), ["src", "id"], "text")
    return found.withColumn("e164", N.normalize_phone(F.col("phone")))


@query
def normalize_phones(spark, sf):
    return _numbers(spark, sf)


@query
def format_phones_intl(spark, sf):
    return _numbers(spark, sf).filter(F.col("e164") != "").select(
        "src", "id", "e164", N.format_international(F.col("e164")).alias("shown"))


@query
def extract_social_links(spark, sf):
    return M.extract_social_links(X.site_pages(spark, sf), ["page_id"], "html")


@query
def classify_industry(spark, sf):
    docs = spread(X.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", guess_industry(F.col("text")).alias("industry"))


@query
def pages_to_text(spark, sf):
    return spread(X.site_pages(spark, sf)).select("page_id", html_to_text(F.col("html")).alias("text"))


@query
def extract_company_name(spark, sf):
    base = F.concat(F.lit("https://"), "host")
    return X.site_pages(spark, sf).select("page_id", P.company_name(F.col("html"), base).alias("company_name"))


def _page_text(spark, sf):
    return X.site_pages(spark, sf).withColumn("text", html_to_text(F.col("html")))


@query
def extract_description(spark, sf):
    return _page_text(spark, sf).select(
        "page_id", P.description(F.col("html"), F.col("text")).alias("description"))


@query
def extract_address(spark, sf):
    return _page_text(spark, sf).select("page_id", P.address(F.col("html"), F.col("text")).alias("address"))


@query
def extract_whatsapp(spark, sf):
    return X.site_pages(spark, sf).select("page_id", P.whatsapp(F.col("html")).alias("whatsapp"))


@query
def extract_employees(spark, sf):
    return _page_text(spark, sf).select("page_id", P.employees(F.col("text")).alias("employees"))


@query
def extract_contact_person(spark, sf):
    return _page_text(spark, sf).select(
        "page_id", P.contact_person(F.col("text")).alias("contact_person"))


@query
def unwrap_result_links(spark, sf):
    return web.unwrap_result_links(X.result_pages(spark, sf))


@query
def directory_cards(spark, sf):
    return directories.directory_cards(X.listing_pages(spark, sf))


@query
def enrich_sites(spark, sf):
    return enrich.enrich_sites(X.site_leads(spark, sf), X.crawled_pages(spark, sf))


# --- incremental -----------------------------------------------------------------------------
@query
def upsert_leads(spark, sf):
    store, batch = X.store_and_batch(spark, sf)
    return _shown(R.upsert_leads(store, batch, X.moment(X.BATCH_NOW)))


TICKS = 5


def run_ticks(spark, sf, root: str, ticks: int = TICKS) -> int:
    """Land the batch tick by tick in a source folder and stream each tick into the store."""
    store, batch = X.store_and_batch(spark, sf)
    sinks.write_snapshot(store, f"{root}/leads", 0)
    version = 0
    for tick in range(ticks):
        (batch.filter(F.col("ord") % ticks == tick)
         .write.mode("append").parquet(f"{root}/landing/tick={tick}"))
        version = stream_upsert(spark, f"{root}/landing/*", batch.schema, f"{root}/leads",
                                f"{root}/checkpoint", X.moment(X.BATCH_NOW))
    return version


@query
def stream_upsert_ticks(spark, sf):
    root = scratch_dir(spark, "stream")
    version = run_ticks(spark, sf, root)
    return _shown(sinks.read_snapshot(spark, f"{root}/leads", version))


QUERIES["stream_upsert"] = QUERIES.pop("stream_upsert_ticks")

SCAN_TICKS = 2


def run_scan_ticks(spark, sf, root: str) -> int:
    """Land the saved searches as requests, tick by tick, and run each tick as it comes."""
    store, _ = X.store_and_batch(spark, sf)
    sinks.write_snapshot(store, f"{root}/leads", 0, buckets=8)
    requests = X.searches(spark, sf).drop("place").withColumn("requested_at", X.moment(X.BATCH_NOW))
    version = 0
    for tick in range(SCAN_TICKS):
        requests.filter(F.col("search_id") % SCAN_TICKS == tick).select(*ticks.REQUEST_SCHEMA.fieldNames()).write.parquet(f"{root}/requests/tick={tick}")
        version = ticks.stream_scans(spark, f"{root}/requests/*", X.scan_inputs(spark, sf), root, f"{root}/checkpoint")
    return version


@query
def stream_tick_report(spark, sf):
    """The report that the last of some scheduled scans leaves behind."""
    root = scratch_dir(spark, "ticks")
    version = run_scan_ticks(spark, sf, root)
    return spark.read.text(f"{ticks.report_path(root, version)}/json")

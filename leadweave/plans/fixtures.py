"""Input views over the test tables: deterministic expressions, so that SQL can restate them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.urls import domain, with_canonical_url
from ..operators.resolve import empty_store, upsert_leads
from ..operators.scoring import grade_leads, key_leads
from ..schema import EXPORT_COLUMNS, conform
from ..session import spread
from ..sources.searches import default_searches, with_defaults

AS_OF = "2024-02-10 00:00:00"
STORE_NOW = "2024-03-01 00:00:00"
BATCH_NOW = "2024-03-02 00:00:00"
#: starts of phone numbers of other countries, one of them without a numbering plan here; four digits follow
FOREIGN = ["+966 50 123 ", "+971 (0)50 123 ", "00965 5012 ", "+962 7 9012 ", "+212 0612 34 ", "+216 20 12 ", "+90 532 123 ",
           "+44 20 7946 ", "+91 98765 4", "+49 1512 345 ", "+47 2212 ", "+966 99 123 ",
           "+44 800 123 ", "+971 800 ", "+966 9200 1", "+49 180 5", "+33 (0)800 12", "+971 800 1"]
#: distance of the ids of stored pages: beyond any room that a number of fixed width would leave
PAGE_STEP = 10 ** 11


def moment(text: str):
    return F.to_timestamp(F.lit(text))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_leads(spark: SparkSession, sf: str) -> DataFrame:
    """customer x nation x region as ungraded lead candidates; ord is the customer key."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    rows = (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .withColumn("k", F.col("c_custkey")))
    exprs = {
        "ord": "k",
        "search_id": "cast(c_nationkey as bigint)",
        "company_name": "case when k % 10 = 0 then concat('Shared Name ', k % 70) "
                        "when k % 10 = 3 then concat('Shared Name ', (k + 7) % 70) else c_name end",
        "industry": "if(k % 8 = 0, '', c_mktsegment)",
        "category": "lower(c_mktsegment)",
        "website": "case when k % 5 = 0 then '' when k % 3 = 0 then "
                   "concat('https://www.biz', k % 400, '.example.com/home/?utm_source=x&id=', k) "
                   "else concat('biz', k % 400, '.example.com') end",
        "email": "case k % 6 when 0 then '' when 1 then concat('info@biz', k % 400, '.example.com') "
                 "when 2 then concat('user', k, '@gmail.com') when 3 then concat('x', k, '@mailinator.com') "
                 "when 4 then 'bad@@mail' else concat('owner.', k, '@biz', k % 400, '.example.com') end",
        "phone": "case k % 4 when 0 then '' when 1 then concat('0100 ', lpad(k % 1000, 3, '0'), ' ', "
                 "lpad(k % 10000, 4, '0')) when 2 then concat('+20 2 2', lpad(k, 7, '0')) else if(k % 8 = 7, concat("
                 f"element_at(array({', '.join(repr(x) for x in FOREIGN)}), cast(k div 8 % {len(FOREIGN)} + 1 as int)), "
                 "lpad(k % 10000, 4, '0')), '123') end",
        "city": "n_name",
        "governorate": "if(k % 3 = 0, '', concat('Gov ', k % 12))",
        "country": "r_name",
        "facebook_url": "if(k % 7 = 0, concat('https://facebook.com/b', k), '')",
        "description": "if(k % 2 = 0, concat('Description of business number ', k, "
                       "' in a long enough sentence.'), 'short')",
        "contact_person": "if(k % 11 = 0, 'Jane Doe', '')",
        "discovered_at": "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(k % 40 as int))",
        "updated_at": "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, "
                      "cast(k % 40 + k % 9 as int))",
    }
    leads = rows.selectExpr(*[f"{e} as {a}" for a, e in exprs.items()])
    return conform(leads.withColumn("source_url", F.col("website")))


def leads(spark: SparkSession, sf: str) -> DataFrame:
    """Graded and keyed lead table."""
    return key_leads(grade_leads(raw_leads(spark, sf)))


def store_and_batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    graded = grade_leads(raw_leads(spark, sf))
    first, rest = graded.filter("ord % 2 = 0"), graded.filter("ord % 2 = 1")
    return upsert_leads(empty_store(first), first, moment(STORE_NOW)), rest


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """Map elements, one per customer."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"))
    return c.select(
        "ord",
        F.expr("round(30.0444D + ((37 * ord) % 200 - 100) * 0.002D, 4)").alias("lat"),
        F.expr("round(31.2357D + ((53 * ord) % 200 - 100) * 0.002D, 4)").alias("lon"),
        F.expr("""map('name', concat('Shop ', ord % 900),
            case ord % 6 when 1 then 'amenity' when 2 then 'office' when 3 then 'healthcare'
                         when 4 then 'craft' else 'shop' end,
            case ord % 6 when 0 then 'car' when 1 then 'dentist' when 2 then 'it' when 3 then 'clinic'
                         when 4 then 'carpenter' else 'unknown_thing' end)""").alias("tags"))


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr(
        "n_name as place", "30 + n_nationkey / 10 as lat", "31 + n_nationkey / 10 as lon")


def searches(spark: SparkSession, sf: str) -> DataFrame:
    """One search per nation, then the defaults."""
    own = table(spark, sf, "nation").selectExpr(
        "cast(n_nationkey as bigint) as search_id",
        "element_at(array('Dental Clinics', 'it', 'restaurant', 'Used Cars', 'beauty'), "
        "cast(n_nationkey % 5 + 1 as int)) as query",
        "if(n_nationkey % 4 = 0, 'MACHINERY', '') as industry", "'' as category",
        "n_name as city", "'' as governorate", "'' as country",
        "if(n_nationkey % 2 = 0, 12, cast(null as int)) as radius_km",
        "element_at(array(20, 60, 200), cast(n_nationkey % 3 + 1 as int)) as limit",
        "if(n_nationkey % 7 = 6, array('search'), "
        "array('openstreetmap', 'search', 'directories')) as sources")
    defaults = default_searches(spark).withColumn("search_id", F.col("search_id") + 25)
    return with_defaults(own.unionByName(defaults))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Search and directory hits, with junk and trap hosts among them."""
    rows = raw_leads(spark, sf).filter(F.col("website") != "")
    return rows.select(
        "search_id", "ord", F.expr("cast(ord % 3 as int)").alias("engine"),
        F.expr("if(ord % 3 = 2, 'directories', 'search')").alias("source"),
        F.col("company_name").alias("name"),
        F.expr("case when ord % 13 = 0 then concat('https://www.facebook.com/b', ord) "
               "when ord % 17 = 0 then concat('https://www.fedex.com/', ord) "
               "else website end").alias("url"))


def scan_inputs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    h = hits(spark, sf)
    return {"elements": elements(spark, sf), "gazetteer": gazetteer(spark, sf),
            "search_hits": h.filter(F.col("source") == "search").select("search_id", "ord", "url"),
            "directory_hits": h.filter(F.col("source") == "directories").select(
                "search_id", "ord", "name", "url"),
            "pages": site_pages(spark, sf)}


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    """pages with contact facts appended to the HTML, and the site's host."""
    p = with_canonical_url(table(spark, sf, "pages").select("page_id", "url", "html"), "url", "_c")
    p = p.withColumn("host", domain(F.col("_c"))).drop("_c").withColumn("p", F.col("page_id"))
    tail = F.expr("""concat(
        if(p % 3 = 0, concat('<a href="mailto:info@', host, '">Mail us</a> owner', p, '@', host, ' '), ''),
        if(p % 4 = 0, concat(' Call 0100 ', lpad(p, 3, '0'), ' 4567 now. '), ''),
        if(p % 5 = 0, concat('<a href="https://www.facebook.com/', p, '">f</a> ',
                             '<a href="https://eg.linkedin.com/company/', p, '">l</a>'), ''),
        if(p % 6 = 0, concat('<a href="https://wa.me/20100', lpad(p, 3, '0'), '4567">chat</a>'), ''),
        if(p % 7 = 0, '<a href="/contact-us">Contact</a> <a href="about/team.html">Team</a>', ''),
        if(p % 8 = 0, concat('<address>', p, ' Nile Street, Cairo</address>'), ''),
        if(p % 9 = 0, '<p>Contact Person: Mona Adel.</p>', ''),
        if(p % 10 = 0, concat('<p>', p, ' employees</p>'), ''))""")
    head = F.expr("""if(p % 2 = 0, replace(html, '</head>', concat(
        '<meta name="description" content="Business number ', p,
        ' serving customers across the city."></head>')), html)""")
    return p.select("page_id", "url", "host", F.concat(head, tail).alias("html"))


def crawled_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The site pages and a contact page of each host that a seventh of them link to."""
    pages = site_pages(spark, sf)
    contact = pages.filter("page_id % 7 = 0 and host <> ''").selectExpr(
        "page_id + 10000000 as page_id", "concat('https://', host, '/contact-us') as url", "host",
        """concat('<html><body><a href="mailto:contact', page_id, '@', host, '">Write</a> Call +20 111 234 ',
            lpad(page_id % 10000, 4, '0'), ' now. <p>Contact Person: Omar Said.</p></body></html>') as html""")
    return pages.unionByName(contact)


def site_leads(spark: SparkSession, sf: str) -> DataFrame:
    """One nearly empty lead per crawled page, so that hosts are shared, and all fixture leads (which have no pages)."""
    p = with_canonical_url(table(spark, sf, "pages").select("page_id", "url"), "url", "_c")
    own = (p.withColumn("host", domain(F.col("_c")))
           .select(F.col("page_id").alias("ord"), F.col("url").alias("website"),
                   F.expr("if(page_id % 3 = 0, concat('kept@', host), '')").alias("email")))
    others = raw_leads(spark, sf).drop("search_id").withColumn("ord", F.col("ord") + 1000000)
    both = conform(own).unionByName(others)
    return grade_leads(both).select("ord", *EXPORT_COLUMNS)


def result_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Stored result pages of three engines, ten hits each."""
    rows = hits(spark, sf).withColumn("page", F.expr("ord div 10")).withColumn(
        "engine", F.expr("element_at(array('duckduckgo', 'google', 'bing'), cast(ord div 10 % 3 + 1 as int))"))
    link = F.expr("""case engine
        when 'duckduckgo' then concat('<a class="result__a" href="//duckduckgo.com/l/?uddg=',
                                      url_encode(url), '&amp;rut=x">', name, '</a>')
        when 'google' then concat('<a href="/url?q=', url_encode(url), '&amp;sa=U">', name, '</a>')
        else concat('<li class="b_algo"><h2><a href="', replace(url, '&', '&amp;'), '">', name, '</a></h2></li>')
        end""")
    links = F.array_sort(F.collect_list(F.struct("ord", link.alias("a"))))
    return rows.groupBy("page", "engine").agg(links.alias("links")).select(
        "page", "engine", F.concat(
            F.lit('<html><body><a href="https://www.google.com/preferences">Settings</a>'),
            F.array_join(F.transform("links", lambda x: x["a"]), "\n"),
            F.lit('<a href="https://help.bing.microsoft.com/x.html">Help</a></body></html>')).alias("html"))


def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Stored directory listings, ten cards each; every fourth card has no website link."""
    rows = hits(spark, sf).withColumn("page", F.expr("ord div 10"))
    card = F.expr("""concat('<div class="', if(ord % 2 = 0, 'listing', 'card search-result'), '">',
        if(ord % 2 = 0, concat('<h3><a href="/biz/', ord, '">', name, '</a></h3>'),
                        concat('<span class="business-name">', name, '</span>')),
        if(ord % 4 = 0, '', concat('<a class="website" href="', replace(url, '&', '&amp;'), '">Visit</a>')),
        '</div>')""")
    cards = F.array_sort(F.collect_list(F.struct("ord", card.alias("a"))))
    return rows.groupBy("page").agg(cards.alias("cards")).select(
        "page", F.concat(F.lit("<html><body>"), F.array_join(F.transform("cards", lambda x: x["a"]), "\n"),
                         F.lit("</body></html>")).alias("html"))


def scan_history(spark: SparkSession, sf: str) -> DataFrame:
    """One run summary per hour of events."""
    ev = table(spark, sf, "events").select(
        "ts", F.date_format("ts", "yyyy-MM-dd HH").alias("label"))
    return ev.groupBy("label").agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"),
        F.count(F.lit(1)).alias("discovered"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that may hold e-mails and phones: documents, page HTML, lead contacts."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select(
        F.lit("document").alias("src"), F.col("doc_id").alias("id"), "text")
    pages = spread(site_pages(spark, sf)).select(F.lit("page").alias("src"), F.col("page_id").alias("id"),
                                         F.col("html").alias("text"))
    contacts = raw_leads(spark, sf).select(F.lit("lead").alias("src"), F.col("ord").alias("id"),
                                           F.concat_ws(" ", "email", "phone").alias("text"))
    return docs.unionByName(pages).unionByName(contacts)


def saved_search_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One saved search per customer as JSON objects; optional members are often absent."""
    return raw_leads(spark, sf).select(F.expr("""to_json(struct(
        ord as search_id, category as query, city, governorate,
        if(ord % 2 = 0, country, null) as country, if(ord % 5 = 0, 3, null) as radius_km,
        if(ord % 3 = 0, cast(ord % 100 as int), null) as limit,
        if(ord % 4 = 0, array('search', 'directories'), null) as sources))""").alias("value"))


def element_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Stored map responses of up to 300 elements each; every seventh element has no name."""
    el = elements(spark, sf).withColumn(
        "tags", F.expr("if(ord % 7 = 0, map_filter(tags, (k, v) -> k <> 'name'), tags)"))
    rows = F.array_sort(F.collect_list(F.struct(
        "ord", "lat", "lon", F.map_entries("tags").alias("t"))))
    grouped = el.groupBy(F.expr("ord div 300").alias("response_id")).agg(rows.alias("r"))
    return grouped.select(F.to_json(F.struct("response_id", F.transform("r", lambda x: F.struct(
        x["lat"].alias("lat"), x["lon"].alias("lon"),
        F.map_from_entries(x["t"]).alias("tags"))).alias("elements"))).alias("value"))

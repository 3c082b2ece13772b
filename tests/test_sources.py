import json
import math

import pytest
from pyspark.sql import functions as F

from helpers import bag, leads
from leadweave.operators import enrich, mining as M
from leadweave.plans import fixtures as X, scan
from leadweave.session import scratch_dir
from leadweave.sources import directories, osm, pagestore, web
from leadweave.sources.registry import union_sources
from leadweave.sources.searches import load_searches, with_defaults

ELEMENT = "ord long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"


def test_osm_projection_rules(spark):
    tags = {"name": " Nile  Dental ", "amenity": "dentist", "office": "it", "contact:website": "www.nile.example/",
            "contact:email": " Info@Nile.example ", "contact:mobile": "0100 123 4567", "contact:whatsapp": "201001234567",
            "addr:housenumber": "5", "addr:street": "Tahrir", "addr:state": "Giza", "description": "Best_in town",
            "contact:facebook": "facebook.com/nile"}
    el = spark.createDataFrame([
        (0, None, None, (30.5, 0.0), tags), (1, 0.0, 31.0, None, {"name": "Zero", "craft": "key_cutter", "email": ""}),
        (2, 1.0, 1.0, None, {"name": "  "}), (3, None, 2.0, None, {"name": "No lat, fast food place"})], ELEMENT)
    out = osm.osm_to_leads(el.withColumn("place", F.lit("Cairo")).withColumn("country", F.lit("Egypt")))
    rows = {r.ord: r for r in out.collect()}
    a, z, n = rows[0], rows[1], rows[3]
    assert 2 not in rows
    assert (a.company_name, a.industry, a.category) == ("Nile Dental", "Dental & Healthcare", "amenity=dentist")
    assert (a.website, a.email, a.phone, a.whatsapp) == (
        "https://nile.example", "info@nile.example", "+201001234567", "+201001234567")
    assert (a.address, a.city, a.governorate) == ("5, Tahrir", "Cairo", "Giza")
    assert a.description == "Best_in town — Amenity: dentist — Office: it"
    assert a.maps_link.endswith("query=30.5,0.0") and a.facebook_url == "https://facebook.com/nile"
    assert a.confidence_score == 100 and z.maps_link.endswith("query=0.0,31.0")
    assert (z.category, z.industry, z.email, n.maps_link, n.industry) == ("craft=key cutter", "Other", "", "", "Food & Beverage")


def test_osm_keyword_tags(spark):
    el = spark.createDataFrame([(i, 0.0, 0.0, None, {"name": "n", k: "v"}) for i, k in enumerate(
        ["shop", "office", "disused:amenity", "craft", "healthcare"])], ELEMENT)
    assert bag(osm.osm_tag_filter(el, F.lit(" Clinic ")), "ord") == [(2,)]
    assert bag(osm.osm_tag_filter(el, F.lit("Dental Clinics")), "ord") == [(0,), (1,), (2,), (4,)]


def test_osm_name_dedup_keeps_first(spark):
    el = spark.createDataFrame([(i, 0.0, 0.0, None, {"name": n}) for i, n in enumerate(
        ["B", "a", "b ", "A", "c"])], ELEMENT)
    assert bag(osm.osm_name_dedup(el, limit=2), "ord") == [(0,), (1,)]


def metres(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * osm.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def test_near_places_equals_brute_force(spark):
    pts = [(i, (i * 37 % 1600) / 10 - 80, (i * 73 % 3600) / 10 - 180) for i in range(1200)]
    pts += [(2000 + i, 30.0 + i / 1000, 31.0) for i in range(400)]          # a crowded cell
    places = [(0, 30.0, 31.0, 9000.0), (1, 10.0, 179.95, 60000.0), (2, -79.9, 0.0, 250000.0), (3, 30.2, 31.1, 20000.0)]
    el = spark.createDataFrame(pts, "ord long, lat double, lon double")
    pl = spark.createDataFrame(places, "pid int, p_lat double, p_lon double, p_radius_m double")
    want = sorted((p[0], e[0]) for p in places for e in pts if metres(p[1], p[2], e[1], e[2]) <= p[3])
    assert len(want) > 300 and bag(osm.near_places(el, pl), "pid", "ord") == want
    wide = [*places, (4, 0.0, -179.0, 1_000_000.0), (5, 85.0, 10.0, 3_000_000.0), (6, 0.0, 0.0, 30_000_000.0), (7, -89.9, 100.0, 500_000.0)]
    want = sorted((p[0], e[0]) for p in wide for e in pts if metres(p[1], p[2], e[1], e[2]) <= p[3])
    pl = spark.createDataFrame(wide, "pid int, p_lat double, p_lon double, p_radius_m double")
    assert bag(osm.near_places(el, pl, crowded=20), "pid", "ord") == want and bag(osm.near_places(el, pl.filter("false")), "pid") == []


def test_within_radius_equals_brute_force(spark, sf):
    el = X.elements(spark, sf)
    for lat, lon, km in ((30.0444, 31.2357, None), (30.1, 31.2, 3)):
        want = sorted((r.ord,) for r in el.collect()
                      if metres(lat, lon, r.lat, r.lon) <= (km or 8) * 1000)
        assert bag(osm.within_radius(el, lat, lon, km), "ord") == want


def test_geocode_falls_back_to_query(spark):
    towns = spark.createDataFrame([("Cairo", 30.0, 31.0, "Greater Cairo"), ("Giza", 1.0, 2.0, "")],
                                  "place string, lat double, lon double, name string")
    asked = spark.createDataFrame([(" cairo",), ("GIZA",), ("Nowhere",)], "q string")
    assert bag(osm.geocode_places(asked, towns, "q"), "place_name") == [("GIZA",), ("Greater Cairo",)]


def hits(spark, rows, limit):
    df = spark.createDataFrame(rows, "search_id long, engine int, ord long, url string")
    return df, df.select("search_id").distinct().withColumn("limit", F.lit(limit))


def test_cascade(spark):
    u = "https://b{}.example".format
    rows = [(0, 0, 0, u(0)), (0, 1, 1, u(1)), (0, 2, 2, u(2)),                      # 1 < 4 // 2 ; 2 >= 4 // 4
            (1, 0, 0, u(0)), (1, 0, 1, u(1)), (1, 1, 2, u(2)), (1, 2, 3, u(3)),     # 2 >= 2: first engine only
            (2, 1, 0, u(1)), (2, 2, 1, u(1)), (2, 2, 2, u(2)), (3, 2, 0, u(9))]     # nothing from the first
    got = bag(web.source_cascade(*hits(spark, rows, 4)), "search_id", "engine", "url")
    assert got == [(0, 0, u(0)), (0, 1, u(1)), (1, 0, u(0)), (1, 0, u(1)), (2, 1, u(1)), (3, 2, u(9))]
    wide = bag(web.source_cascade(*hits(spark, rows, 12)), "search_id", "engine", "url")
    assert (0, 2, u(2)) in wide and (2, 2, u(2)) in wide and (2, 1, u(1)) in wide and len(wide) == 9


def test_ordered_distinct_urls(spark):
    rows = [(0, 0, 3, "https://a.com"), (0, 0, 1, "https://a.com"), (0, 0, 2, "https://fedex.com"), (0, 0, 5, "https://c.com"),
            (0, 0, 4, "https://d.com"), (0, 0, 0, "")]
    assert bag(web.ordered_distinct_urls(*hits(spark, rows, 2)), "ord", "url") == [
        (1, "https://a.com"), (4, "https://d.com")]


def test_unwrap_result_links(spark):
    pages = spark.createDataFrame([
        (0, "duckduckgo", '<a class="x result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com%2Fx%2520y&amp;r=1">A</a>'
                          '<a href="https://other.com">o</a><a class="result__a" href="//b.com/">B</a>'),
        (1, "duckduckgo", '<a href="//duckduckgo.com/l/?q=1">n</a><a href="https://c.com">C</a><a href="/x">x</a>'),
        (2, "google", '<a href="/url?q=https://d.com/a%20b&amp;sa=1">D</a><a href="https://maps.google.com">m</a>'),
        (3, "bing", '<li class="b_algo"><div><h2><a href="https://e.com">E</a></h2></div><a href="https://f.com">F</a></li>'
                    '<li class="b_algo"></li><h2><a href="https://g.com">G</a></h2>'),
        (4, "bing", '<a href="https://www.bing.com/x">b</a><a href="https://h.com">H</a>')],
        "page long, engine string, html string")
    # a target with a blank is no URL once it has a scheme, so it is kept as it is
    assert bag(web.unwrap_result_links(pages), "page", "rank", "url") == [
        (0, 1, "https://a.com/x y"), (0, 2, "https://b.com"), (1, 1, "https://c.com"),
        (2, 1, "https://d.com/a b"), (3, 1, "https://e.com"), (4, 1, "https://h.com")]


def test_directory_cards_and_outlinks(spark):
    pages = spark.createDataFrame([(0, '<div class="listing big"><h3>x <a href="/b">Acme <i>Co</i></a></h3>'
                                       '<a class="website" href="www.acme.com">Visit</a></div>'
                                       '<li class="result"><span class="business-name">Beta</span></li>'
                                       '<p class="result"><b class="business-name">Gamma</b><a href="gamma.com" class="x track-visit-website">w</a></p>'
                                       '<a href="https://twitter.example/x">no</a><a href="https://twitter.com/x">Tweets</a>'
                                       '<a href="/about">About us</a><a href="ok.com">Fine site</a>')], "page long, html string")
    assert bag(directories.directory_cards(pages), "pos", "name", "url") == [
        (0, "Acme Co", "https://acme.com"), (2, "Gamma", "https://gamma.com")]
    got = bag(directories.directory_outlinks(pages, "https://dir.example.org/x"), "name", "url")
    assert got == [("Fine site", "https://ok.com"), ("Visit", "https://acme.com")]


def test_saved_searches(spark):
    assert load_searches(spark, None).count() == 5
    assert load_searches(spark, scratch_dir(spark, "absent")).count() == 5
    two = [{"query": "a", "city": "x"}, {"query": "b", "limit": 7}]
    lines = "\n".join(map(json.dumps, two))
    for text, n in (("[]", 0), (json.dumps(two), 2), (json.dumps(two, indent=2), 2), (lines, 2), ('{"x":1}', 0), ("\n\n", 0)):
        found = load_searches(spark, stored(spark, text)).collect()
        assert len(found) == n, text
        assert len({r.search_id for r in found} - {None}) == n, text
    again = [load_searches(spark, stored(spark, t)).orderBy("query").collect() for t in (json.dumps(two), json.dumps(two[::-1], indent=1))]
    assert again[0] == again[1] and [r["limit"] for r in again[0]] == [None, 7]
    with pytest.raises(Exception, match="(?i)malformed"):
        load_searches(spark, stored(spark, "{oops")).collect()


def stored(spark, text):
    path = scratch_dir(spark, "searches")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def test_map_documents_over_several_lines(spark):
    doc = {"elements": [{"lat": 1.0, "lon": 2.0, "tags": {"name": "A"}}, {"center": {"lat": 3.0, "lon": 4.0}, "tags": {}}]}
    for text in (json.dumps(doc), json.dumps(doc, indent=2), json.dumps(doc | {"response_id": 5}, indent=2)):
        rows = osm.read_elements(spark, stored(spark, text)).collect()
        assert [r.pos for r in rows] == [0, 1] and rows[0].response_id is not None
        assert ("response_id" not in text) or rows[0].response_id == 5


def test_one_hit_per_place_and_many_searches_for_one_city(spark):
    towns = spark.createDataFrame([("Cairo", 30.0, 31.0, "EG", 2), ("cairo ", 37.0, -89.0, "US", 1), ("Cairo", 30.1, 31.1, "EG", 1)],
                                  "place string, lat double, lon double, country string, rank int")
    asked = spark.createDataFrame([("Cairo", "EG")], "p string, country string")
    assert bag(osm.geocode_places(asked, towns, "p"), "lat") == [(30.1,)]
    assert bag(osm.geocode_places(asked.drop("country"), towns, "p"), "lat") == [(30.1,)]
    many = spark.range(1000).selectExpr("id as search_id", "'shop' as query", "'' as industry", "'' as category", "'Cairo' as city",
                                        "'' as governorate", "'EG' as country", "cast(null as int) as radius_km",
                                        "if(id % 2 = 0, 2, cast(null as int)) as limit", "array('openstreetmap') as sources")
    el = spark.range(60).selectExpr("id as ord", "30.1 as lat", "31.1 as lon", "map('name', concat('Shop ', id % 5), 'shop', 'car') as tags")
    found = osm.osm_candidates(with_defaults(many), el, towns).groupBy("search_id").count()
    assert {tuple(r) for r in found.selectExpr("search_id % 2", "count").distinct().collect()} == {(0, 2), (1, 5)}


def test_finalize(spark):
    crit = with_defaults(spark.createDataFrame(
        [(1, "Dental Clinics", "Dental & Healthcare", None, "Asyut", None, None, None, None, None)],
        X.default_searches(spark).schema))
    df = leads(spark, {"website": "www.a.com/", "search_id": 1}, {"company_name": " N ", "city": "Giza", "search_id": 1},
               {"search_id": 1})
    rows = [(r.company_name, r.website, r.city, r.country, r.category, r.industry) for r in
            scan.finalize_leads(df, crit).orderBy("ord").collect()]
    tail = ("Egypt", "Dental Clinics", "Dental & Healthcare")
    assert rows == [("a.com", "https://a.com", "Asyut", *tail), ("N", "", "Giza", *tail),
                    ("Unknown Business", "", "Asyut", *tail)]


PAGES = "page_id long, url string, html string"


def test_a_site_is_its_own_page_and_those_it_links_to(spark):
    link = '<a href="/contact-us">c</a><a href="https://a.com/about">a</a><a href="/contact-us#x">again</a><a href="/gone/team">t</a>'
    rows = [(5, "https://www.a.com/", link), (1, "https://a.com/p1", "x"), (9, "http://www.a.com/contact-us", "c"), (10, "https://a.com/contact-us", "d"),
            (11, "https://a.com/about", "e"), (12, "https://a.com/about/", "later copy")]
    facts = enrich.page_facts(spark.createDataFrame(rows, PAGES))
    sites = spark.createDataFrame([("https://a.com",), ("https://a.com",), ("https://none.com",)], "site string")
    assert bag(enrich.site_pages(sites, facts), "site", "page_rank", "page_id") == [
        ("https://a.com", 1, 5), ("https://a.com", 2, 10), ("https://a.com", 3, 11)]
    assert bag(enrich.site_pages(sites, facts, 1), "page_id") == [(5,), (10,)]
    # a store mines the needed pages alone, and gives the same
    store = pagestore.write_page_store(spark.createDataFrame(rows, PAGES), scratch_dir(spark, "store"), 3)
    needed = enrich.needed_facts(store, sites)
    assert bag(needed, "page_id") == [(5,), (10,), (11,)] and needed.columns == facts.columns
    assert bag(enrich.site_pages(sites, needed), "site", "page_rank", "page_id") == bag(enrich.site_pages(sites, facts), "site", "page_rank", "page_id")
    assert bag(enrich.needed_facts(store, sites, 1), "page_id") == [(5,), (10,)]


def test_needed_pages_are_mined_for_the_facts_that_are_read_alone(spark):
    rows = [(5, "https://a.com/", '<a href="/contact-us">c</a>'), (10, "https://a.com/contact-us", "d")]
    store = pagestore.write_page_store(spark.createDataFrame(rows, PAGES), scratch_dir(spark, "store"), 2)
    sites = spark.createDataFrame([("https://a.com",)], "site string")
    some = enrich.needed_facts(store, sites, facts=["text_md5"])
    assert some.columns == ["page_url", "page_id", "text_md5", "links"]
    assert bag(some, *some.columns[:3]) == bag(enrich.needed_facts(store, sites), *some.columns[:3])


def test_a_page_store_opens_in_another_session(spark):
    root = scratch_dir(spark, "store")
    pages = spark.createDataFrame([(1, "https://www.a.com/", "x"), (2, "a.com", "y"), (3, "b.com/c", "z"), (4, "", "w"), (5, None, "v")], PAGES)
    pagestore.write_page_store(pages, root, 3)
    other = spark.newSession()
    other.sql(f"DROP TABLE {pagestore._name(root)}")
    store = pagestore.open_page_store(other, root)
    assert bag(store, "page_url", "page_id") == [("https://a.com", 1), ("https://a.com", 2), ("https://b.com/c", 3)]
    urls = other.createDataFrame([("https://a.com",), ("https://a.com",), ("https://x.com",), (None,)], "page_url string")
    assert bag(pagestore.needed_pages(store, urls), "page_id", "html") == [(1, "x")]
    assert pagestore.stored(store) is store and pagestore.needed_pages(store, urls.filter("false")).count() == 0


def test_businesses_on_one_host_stay_apart(spark):
    page = '<title>{0}</title><p>mail {1}</p><a href="/{0}/contact">c</a>'
    pages = spark.createDataFrame([(1, "https://shared.com/a", page.format("Alpha", "a@alpha.com")), (2, "https://shared.com/b", page.format("Beta", "b@beta.com")),
                                   (3, "https://shared.com/Beta/contact", "Call 0100 123 4567 now")], PAGES)
    df = leads(spark, {"website": "https://shared.com/a"}, {"website": "shared.com/b/"}, {"website": "https://shared.com"})
    rows = {r.ord: (r.enriched, r.company_name, r.email, r.phone) for r in enrich.enrich_sites(df, pages).collect()}
    assert rows == {0: (True, "Alpha", "a@alpha.com", ""), 1: (True, "Beta", "b@beta.com", "+201001234567"), 2: (False, "", "", "")}


def test_a_url_of_very_many_leads(spark):
    df = leads(spark, {"website": "https://hot.com/x"}).drop("ord").crossJoin(spark.range(5000).withColumnRenamed("id", "ord"))
    pages = spark.createDataFrame([(1, "https://hot.com/x", "<title>Hot</title>")], PAGES)
    assert enrich.enrich_sites(df, pages).filter("company_name = 'Hot' and enriched").count() == 5000


def test_enrich_fills_only_what_is_empty(spark):
    html = ('<title>Acme - Home</title><meta name="description" content="We build software for small clinics in Cairo.">'
            '<p>Call 0100 123 4567. Owner: Ali Hassan, founder</p> joe@acme.com <a href="https://fb.com/acme">f</a>')
    pages = spark.createDataFrame([(1, "https://acme.com", html)], PAGES)
    df = leads(spark, {"website": "www.acme.com", "email": "kept@x.com"}, {"website": "https://none.com"}, {"company_name": "N"})
    rows = {r.ord: r for r in enrich.enrich_sites(df, pages).collect()}
    a = rows[0]
    assert (a.company_name, a.email, a.phone, a.facebook_url) == ("Acme", "kept@x.com", "+201001234567", "https://fb.com/acme")
    assert (a.contact_person, a.source_url, a.industry) == ("Ali Hassan", "https://acme.com", "Dental & Healthcare")
    assert a.enriched and a.confidence_score == 100 and a.confidence_tier == "A (High)"
    assert not rows[1].enriched and rows[1].confidence_score == 0 and rows[1].source_url == ""
    assert rows[2].company_name == "N"


def test_contact_pages(spark):
    html = ('<a href="/Contact">c</a><a href="mailto:contact@x">m</a><a href="/shop">s</a><a class=k href=about.html>a</a>'
            "<a href='/Contact#x'>d</a><a href=\"#team\">t</a>")
    pages = spark.createDataFrame([(1, "https://h.com", html)], "page_id long, base string, html string")
    assert bag(M.contact_pages(pages, ["page_id"], "html", "base"), "pos", "url") == [
        (0, "https://h.com/Contact"), (3, "https://about.html")]


def test_stored_pages_give_what_ready_hits_give(spark):
    asked = with_defaults(spark.createDataFrame([(1, "q", "", "", "Cairo", "", "", None, 3, None)], X.default_searches(spark).schema))
    results = spark.createDataFrame([
        (1, 11, "google", '<a href="/url?q=https%3A%2F%2Fc.com&amp;sa=U">c</a>'),
        (1, 10, "duckduckgo", '<a class="result__a" href="https://a.com">a</a><a class="result__a" href="https://b.com">b</a>')],
        "search_id long, page long, engine string, html string")
    listing = '<div class="listing"><h3><a href="/x">{0}</a></h3><a class="website" href="https://{0}.com">w</a></div>'
    listings = spark.createDataFrame([(1, 20, "hotfrog", listing.format("Zeta")), (1, 21, "yellowpages", listing.format("Eta"))],
                                     "search_id long, page long, directory string, html string")
    ready = {"search_hits": spark.createDataFrame([(1, 1, "https://a.com"), (1, 2, "https://b.com")], "search_id long, ord long, url string"),
             "directory_hits": spark.createDataFrame([(1, 1, "Eta", "https://Eta.com"), (1, 2, "Zeta", "https://Zeta.com")],
                                                     "search_id long, ord long, name string, url string")}
    columns = ("search_id", "source", "company_name", "website", "description")
    both = [union_sources(asked, t, ["search", "directories"]) for t in ({"result_pages": results, "listing_pages": listings}, ready)]
    assert bag(both[0], *columns) == bag(both[1], *columns)
    assert [r.website for r in both[0].orderBy("ord").collect()] == ["https://a.com", "https://b.com", "https://eta.com", "https://zeta.com"]


@pytest.mark.parametrize("step", [1, 10 ** 5, 10 ** 7, 10 ** 12, 10 ** 17])
def test_order_holds_whatever_the_ids_of_stored_pages_are(spark, step):
    asked = with_defaults(spark.createDataFrame([(1, "q", "", "", "Cairo", "", "", None, None, None)], X.default_searches(spark).schema))
    link = '<a class="result__a" href="https://{0}.com">{0}</a>'
    results = spark.createDataFrame([(1, 3 * step, "google", '<a href="/url?q=https%3A%2F%2Fg3.com&amp;sa=U">c</a>'),
                                     (1, 50 * step, "duckduckgo", link.format("d50a") + link.format("d50b")), (1, 7 * step, "duckduckgo", link.format("d7"))],
                                    "search_id long, page long, engine string, html string")
    listing = '<div class="listing"><h3><a href="/x">{0}</a></h3><a class="website" href="https://{0}.com">w</a></div>'
    listings = spark.createDataFrame([(1, 2 * step, "hotfrog", listing.format("h2")), (1, 90 * step, "yellowpages", listing.format("y90") + listing.format("z90")),
                                      (1, 8 * step, "yellowpages", listing.format("y8"))], "search_id long, page long, directory string, html string")
    found = union_sources(asked, {"result_pages": results, "listing_pages": listings}, ["search", "directories"])
    assert [r.website.split("/")[2].split(".")[0] for r in found.orderBy("ord").collect()] == ["d7", "d50a", "d50b", "g3", "y8", "y90", "z90", "h2"]
    assert found.select("ord").distinct().count() == 8


def test_each_json_file_has_its_own_form(spark, tmp_path):
    docs = [{"query": f"q{i}", "city": "x, y"} for i in range(12)]
    (tmp_path / "a b[1].json").write_text(json.dumps(docs[0], indent=2))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, docs[1:4])) + "\n\n")
    (tmp_path / "c.json").write_text("\ufeff" + json.dumps(docs[4:6]) + "\n" + json.dumps(docs[6:8]))
    (tmp_path / "d+%20.json").write_text(json.dumps(docs[8:], indent=1))
    assert sorted(r["query"] for r in load_searches(spark, str(tmp_path)).collect()) == sorted(d["query"] for d in docs)
    for i, text in enumerate(("\n".join(json.dumps(d, indent=2) for d in docs[:2]), json.dumps(docs[0]) + json.dumps(docs[1]), json.dumps(docs[0]) + "\n{")):
        (tmp_path / f"bad{i}").mkdir()
        (tmp_path / f"bad{i}" / "x.json").write_text(text)
        with pytest.raises(Exception, match="(?i)malformed"):
            load_searches(spark, str(tmp_path / f"bad{i}")).collect()


def test_long_elements_are_read_to_their_end_tag(spark):
    import time

    from helpers import evaluate
    from leadweave.functions import pages as P

    svg = '<svg><path d="' + "M0 1 " * 8000 + '"/></svg>' + "<i></i>" * 900
    html = [f"<input id='address'><address>{svg}1 Main Road</address>", f'<p class="address">{svg}2 Main Road</p>', "<p class='address'>3 Main Road <div id='address'>4 Side Road</div>"]
    assert evaluate(spark, P.address_node, html) == ["1 Main Road", "2 Main Road", "4 Side Road"]
    assert evaluate(spark, lambda c: P.element_text(P.anchors(c)[0]), [f"<a href='x'>{svg}go</a>"]) == ["go"]
    cards = [(0, f'<div class="listing"><b class="business-name">{svg}Acme</b><a class="website" href="acme.com">w</a></div>'
                 f'<div class="listing"><h3>{svg}<a href="/b">{svg}Beta</a></h3><a class="website" href="beta.com">w</a></div>')]
    assert bag(directories.directory_cards(spark.createDataFrame(cards, "page long, html string")), "name") == [("Acme",), ("Beta",)]
    begin = time.time()
    assert evaluate(spark, P.address_node, ["<p class='address'>" * 20000, "<address>" * 20000]) == ["", ""]
    assert time.time() - begin < 60

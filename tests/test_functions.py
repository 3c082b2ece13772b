from pyspark.sql import functions as F

from helpers import evaluate, leads
from leadweave.functions import emails as E, pages as P, phones as N
from leadweave.functions.industry import guess_industry
from leadweave.functions.text import clean_text, decode_entities, html_to_text, title_case
from leadweave.functions.urls import canonical_url, domain, is_business_host, social_platform
from leadweave.operators.scoring import grade_leads, key_leads


def test_clean_text(spark):
    got = evaluate(spark, clean_text, ["  Hello   world  \n", "a\x00b\x07c", "a b‏", "ﬁne Ａ①", None,
                                       "x y"])
    assert got == ["Hello world", "abc", "a b", "fine A1", "", "x y"]


def test_entities_are_decoded_once(spark):
    got = evaluate(spark, decode_entities, ["a &amp;lt; b", "&#65;&#x42;&#8212;", "&copy;&nope;&", "&apos;&#0;"])
    assert got == ["a &lt; b", "AB—", "©&nope;&", "'�"]


def test_industry_counts_every_keyword_by_itself(spark):
    import random

    from leadweave.fixed_values import INDUSTRY_KEYWORDS
    from leadweave.functions.industry import guess_industry

    r = random.Random(3)
    words = [w for ws in INDUSTRY_KEYWORDS.values() for w in ws]
    texts = ["".join(r.choice([*words, r.choice(words)[:3], " ", "Xx", "é", "."]) for _ in range(r.randint(1, 30))) for _ in range(300)]
    texts += ["healthealthealth law lawyer", "saasaasaas salon salon", "rent a carent a car bank", "legalegal cafe cafe", None, "", "IT ", "nothing", "kitchen cafe"]

    def plain(text):
        low = (text or "").lower()
        hits = {n: sum(low.count(w) for w in ws) for n, ws in INDUSTRY_KEYWORDS.items()}
        best = max(hits, key=hits.get)
        return best if hits[best] else ""
    assert evaluate(spark, guess_industry, texts) == [plain(t) for t in texts]


def test_hidden_markup_ends_where_it_began(spark):
    from leadweave.functions.text import visible_markup

    pages = {"a<!-- <script> -->b<script>c<!-- </script>d": "a b d", "a<STYLE x>b</style >c<noscript>d</noscript>e": "a c e", "a<!--b--c->d": "a ", "<!---->x<!-->y-->z": " x z",
             "a<script>b</scripture></SCRIPT\n>c": "a c", "<scripture>a</scripture>": "<scripture>a</scripture>", "a<style>b": "a ", "<!- a": "<!- a"}
    assert evaluate(spark, visible_markup, list(pages)) == list(pages.values())


def test_html_to_text(spark):
    html = ("<html><!-- <p>no</p> --><style>p{}</style><SCRIPT>var t='</p>';</SCRIPT><noscript>off</noscript>"
            "<p>one<b>two</b>&nbsp;&amp; 3 < 4</p></html>")
    assert evaluate(spark, html_to_text, [html]) == ["one two & 3 < 4"]


def test_canonical_url(spark):
    cases = {
        "example.com": "https://example.com",
        "https://www.example.com/page?utm_source=x&id=5": "https://example.com/page?id=5",
        "//ex.com/a/": "https://ex.com/a",
        "not a url @ all": "", "": "", "me@x.com": "", "localhost": "",
        "HTTP://WWW.Ex.com/A/?Q=1&fbclid=z#top": "http://ex.com/A?Q=1",
        "/a/../b/./c.html": "https://example.com/b/c.html", "/x/..": "https://example.com",
        "page.html": "https://page.html", "#top": "", "javascript:void(0)": "",
        "https://ex.com/p;v=1?a=1&&b=2": "https://ex.com/p?a=1&&b=2",
        "https://ex.com/?gclid=1": "https://ex.com", "http://u@ex.com:80/x": "http://u@ex.com:80/x",
    }
    assert evaluate(spark, canonical_url, list(cases)) == list(cases.values())


def test_rooted_url_uses_base(spark):
    got = evaluate(spark, lambda c: canonical_url(c, "https://shop.example.org/deep/page"), ["/about-us/", "x.org"])
    assert got == ["https://shop.example.org/about-us", "https://x.org"]


def test_domain_and_host_classes(spark):
    assert evaluate(spark, domain, ["https://www.example.com/x", "example.com", None, "", "a.b/?u=http://c.d"]) == [
        "example.com", "example.com", "", "", ""]
    assert evaluate(spark, is_business_host, [
        "https://acme.com", "https://m.facebook.com/x", "https://fedex.com", "", "https://shop.amazon.de"]) == [
        True, False, False, False, False]
    assert evaluate(spark, social_platform, ["fb.com", "eg.linkedin.com", "notx.com", "x.com", "a.youtu.be"]) == [
        "facebook", "linkedin", None, "twitter", "youtube"]


def test_extract_emails(spark):
    got = evaluate(spark, E.extract_emails, [
        "Contact: sales@acme.com or MAILTO:Info@Acme.com", "a@x.com a@x.com.", None, "mailto:nobody?x"])
    assert got == [["info@acme.com", "sales@acme.com"], ["a@x.com"], [], []]


def test_email_validity_and_class(spark):
    good = ["sales@acme.com", "john.doe+filter@example.co.uk", "info@sub.domain.example.org", "  A@B.co. "]
    bad = ["", "noatsign", "a@b", "@x.com", "a@.com", "a b@x.com", ".a@x.com", "a.@x.com", "a..b@x.com", "a@@x.com",
           "l" * 250 + "@x.com"]
    assert evaluate(spark, E.is_valid_email, good) == [True] * 4
    assert evaluate(spark, E.is_valid_email, bad) == [False] * len(bad)
    kinds = {"sales@acme.com": "role", "john.doe@acme.com": "business", "contact@startup.io": "role",
             "john@gmail.com": "personal", "x@mailinator.com": "disposable", "not an email": "invalid",
             "info@gmail.com": "role", "bob@gmail.com.": "business", None: "invalid"}
    assert evaluate(spark, E.classify_email, list(kinds)) == list(kinds.values())


def test_best_email_prefers_business(spark):
    got = evaluate(spark, E.best_email, [["bad", "info@a.com", "joe@gmail.com", "joe@a.com", "ann@a.com"],
                                         ["joe@gmail.com", "info@a.com"], ["bad"]], "array<string>")
    assert got == ["joe@a.com", "info@a.com", None]


def test_phone_candidates(spark):
    got = evaluate(spark, N.phone_candidates, [
        "Call us at +20 100 123 4567 or tel:+201001234567", "card 4111 1111 1111 1111", "12345",
        "٠١٠٠ ١٢٣ ٤٥٦٧", None])
    assert got == [["+201001234567"], [], [], ["٠١٠٠ ١٢٣ ٤٥٦٧"], []]


def test_normalize_phone(spark):
    cases = {"0100 123 4567": "+201001234567", "1001234567": "+201001234567", "+20 100 123 4567": "+201001234567",
             "0020 100 123 4567": "+201001234567", "201001234567": "+201001234567", "+20 0100 123 4567": "+201001234567",
             "02 25760000": "+20225760000", "03-4201234": "+2034201234", "+1 (212) 555-0147": "+12125550147",
             "001 212 555 0147": "+12125550147", "٠١٠٠ ١٢٣ ٤٥٦٧": "+201001234567", "abc": "", "123": "",
             "+44 20 7946 0958": "+442079460958", "+44 (0)7911 123456": "+447911123456", "+44 999": "", "00966 50 123 4567": "+966501234567",
             "+971 4 123 4567": "+97141234567", "+965 5012 3456": "+96550123456", "+962 79 012 3456": "+962790123456",
             "+961 3 123 456": "+9613123456", "+212 612-345678": "+212612345678", "+216 20 123 456": "+21620123456",
             "+90 532 123 45 67": "+905321234567", "+33 1 23 45 67 89": "+33123456789", "+91 98765 43210": "+919876543210",
             "+47 22 12 34 56": "+4722123456", "+47 1": "", "0100 abc 4567": "", None: ""}
    assert evaluate(spark, N.normalize_phone, list(cases)) == list(cases.values())


def test_service_numbers_have_a_kind_and_are_no_mobiles(spark):
    kinds = {"+44 800 123 4567": ("+448001234567", "toll_free"), "+971 800 1234": ("+9718001234", "toll_free"), "+966 9200 12345": ("+966920012345", "shared_cost"),
             "00971 600 512345": ("+971600512345", "uan"), "+48 800 123 456": ("+48800123456", "toll_free"), "+48 512 345 678": ("+48512345678", "mobile"),
             "+91 1800 123 4567": ("+9118001234567", "toll_free"), "0800 1234567": ("+208001234567", "toll_free"), "+1 800 555 0147": ("+18005550147", "toll_free"),
             "+49 900 1234567": ("+499001234567", "premium"), "+20 2 25760000": ("+20225760000", "fixed"), "+47 2212 3456": ("+4722123456", ""), "+966 9200 1234": ("", "")}
    assert evaluate(spark, lambda c: F.struct(N.normalize_phone(c), N.phone_kind(N.normalize_phone(c))), list(kinds)) == [tuple(v) for v in kinds.values()]
    best = evaluate(spark, lambda c: N.best_phones(N.phone_candidates(c)), ["Call +48 800 123 456 or +48 512 345 678"])
    assert best == [["+48512345678", "+48800123456"]]
    shown = {"+448001234567": "+44 8001234567", "+966920012345": "+966 920012345", "+208001234567": "+20 800 123 4567", "+4722123456": "+4722123456", "+1": "+1"}
    assert evaluate(spark, N.format_international, list(shown)) == list(shown.values())


def test_phone_display_and_preference(spark):
    assert evaluate(spark, N.format_international, ["+201001234567", "+20225760000", "+12125550147", ""]) == [
        "+20 100 123 4567", "+20 2 25760000", "+1 212-555-0147", ""]
    best = evaluate(spark, lambda c: N.best_phones(N.phone_candidates(c)), [
        "Office +20 2 25760000, mobile +20 100 123 4567, again 0100 123 4567"])
    assert best == [["+201001234567", "+20225760000"]]


def test_guess_industry(spark):
    got = evaluate(spark, guess_industry, [
        "Family dental clinic and orthodontics", "Buy used cars and auto repair", "Software development and web design",
        "nothing relevant here", None, "kitchen bank bank", "shop law"])
    assert got == ["Dental & Healthcare", "Automotive", "Software & IT", "", "", "Food & Beverage",
                   "Retail & E-commerce"]


def test_score_and_tier(spark):
    text = "A long enough company description to score full marks."
    df = grade_leads(leads(
        spark, {"company_name": "X"},
        {"website": "https://acme.com", "email": "sales@acme.com", "phone": "+201001234567",
         "linkedin_url": "https://linkedin.com/x", "description": text, "contact_person": "Jo"},
        {"website": "https://acme.com", "email": "sales@acme.com"}, {"email": " ", "description": " " * 50}))
    got = [(r.confidence_score, r.confidence_tier) for r in df.orderBy("ord").collect()]
    assert got == [(0, "D (Minimal)"), (100, "A (High)"), (50, "C (Low)"), (0, "D (Minimal)")]


def test_dedup_key(spark):
    df = key_leads(leads(
        spark, {"website": "https://www.acme.com/"}, {"company_name": " Acme ", "city": "Cairo", "phone": "0 1"},
        {}, {"description": "x"}, {"dedup_key": "given", "website": "a.com"}))
    keys = [r.dedup_key for r in df.orderBy("ord").collect()]
    assert keys[:2] == ["dom:acme.com", "name:acme|cairo|01"]
    assert keys[2].startswith("anon:") and keys[3].startswith("anon:") and keys[2] != keys[3]
    assert keys[4] == "given"


def test_company_name(spark):
    base = F.lit("https://my-shop2go.example.com")
    got = evaluate(spark, lambda c: P.company_name(c, base), [
        '<meta content="Acme &amp; Co" property="og:site_name"><title>T</title>', "<title>Acme | Home - X</title>",
        "<title> </title><h1>Big <b>Shop</b></h1>", "<h1></h1>", "<p>x</p>", f"<title>{'x' * 200}</title>"])
    assert got == ["Acme & Co", "Acme", "Big Shop", "", "My-Shop2Go", "x" * 120]
    assert evaluate(spark, title_case, ["o'neil 3rd"]) == ["O'Neil 3Rd"]


def test_description(spark):
    rows = [("<meta name='description' content='too short'><meta property=og:description content=\"" + "y" * 40 + '">', ""),
            ("", "Short. Cookie " + "z" * 70 + ". Real " + "w" * 70 + ". x"), ("", "none")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, t string")
    got = [r.d for r in df.select("i", P.description(F.col("h"), F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == ["y" * 40, "Real " + "w" * 70, ""]


def test_address(spark):
    rows = [('<div itemtype="http://schema.org/PostalAddress">5 Nile <b>St</b></div><address>no</address>', ""),
            ('<p class="big address">7 Tahrir Sq</p>', ""), ('<p id="address"></p>', "12 Long Street, Cairo"),
            ("<address>" + "x" * 400 + "</address>", "short st.\n" + "y" * 10), ("", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, t string")
    got = [r.d for r in df.select("i", P.address(F.col("h"), F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == ["5 Nile St", "7 Tahrir Sq", "12 Long Street, Cairo", "", ""]


def test_nested_address_nodes(spark):
    long = "<span>" + "<i data-x='" + "y" * 20_000 + "'></i></span>"
    pages = {
        "<div itemtype='http://schema.org/PostalAddress'><div>12 Nile Street</div><div>Cairo</div></div> more</div>": "12 Nile Street Cairo",
        "<DIV class='x address'><div><div>1</div> <Div\n>2</div></div>3</DIV >4": "1 2 3",
        f"<section id=\"address\">{long}<section>7 Main Road</section>{long}Giza</section> end": "7 Main Road Giza",
        "<div class='address'><img class='address'><division>5</division> St</div>": "5 St",
        "<p class='address'>6 Side Road<p>other</p>": "6 Side Road",
        "<address><!-- </address> --><script>'</address>'</script>8 Hill Road</address>": "8 Hill Road",
        "<div class='address'><!-- <b>no</b> --><script>no</script>9 Hill Road</div>": "9 Hill Road",
        "<div class='address'>never closed <div>1</div>": "",
        "<address>" + "z" * 300 + "</address><p id='address'>10 Low Road</p>": "10 Low Road",
        "<li class='address'><ul><li>11</li><li>West</li></ul></li>": "11 West",
    }
    assert evaluate(spark, P.address_node, list(pages)) == list(pages.values())


def test_whatsapp_employees_person(spark):
    assert evaluate(spark, P.whatsapp, [
        "https://wa.me/201001234567", "api.whatsapp.com/send?x=1&phone=447911123456", "wa.me/123", ""]) == [
        "+201001234567", "+447911123456", "", ""]
    assert evaluate(spark, P.employees, [
        "about 050 - Staff", "12000 people, team of 300 professionals", "20000 employees", ""]) == [
        "50 employees", "300+ employees", "", ""]
    assert evaluate(spark, P.contact_person, [
        "Owner: Ali Hassan, Contact - Mona Adel", "contact: mona", "CEO - Jo"]) == ["Mona Adel", "", ""]


def test_social_links(spark):
    html = ('<a href="https://www.facebook.com/acme">fb</a> https://www.linkedin.com/company/acme '
            "https://instagram.com/acme https://example.com/linkedin.com")
    for platform, url in (("facebook", "https://facebook.com/acme"), ("instagram", "https://instagram.com/acme"),
                          ("linkedin", "https://linkedin.com/company/acme"), ("tiktok", "")):
        assert evaluate(spark, lambda c: P.first_social(P.social_links(c), platform), [html]) == [url]


def test_hostile_text_ends_in_seconds(spark):
    import time

    start = time.time()
    host = "a@" + ".".join(["b"] * 20_000) + ".com"
    assert evaluate(spark, E.is_valid_email, [host, "a@b.com"]) == [False, True]
    assert evaluate(spark, lambda c: E.best_email(E.extract_emails(c)), [f"x {host} y@z.com"]) == ["y@z.com"]
    many = " ".join(f"+20 100 {i:07d}," for i in range(100_000))
    assert evaluate(spark, lambda c: F.size(N.phone_candidates(c)), [many, many[:2210]]) == [100_000, 130]
    for piece in ("<!--", "<script>", "<a ", "<a href=x>", "<title>", "<h1>", "<address>", "<style ", "<li class='b_algo'>", "&#"):
        page = piece * (1_000_000 // len(piece))
        got = evaluate(spark, lambda c: F.concat_ws("|", html_to_text(c), P.company_name(c, F.lit("https://x.com")),
                                                    P.address_node(c), F.size(P.anchors(c)).cast("string")), [page])
        assert len(got) == 1
    assert time.time() - start < 300


def test_addresses_and_blanks_as_the_plain_patterns_find_them(spark):
    from leadweave.fixed_values import ADDRESS_PATTERN
    texts = ["a@b.com_x@y.org", "x@y", "a.b+c@d-e.co.uk,z@z.zz", "..@..@a.bc", "a@b.c0m@d.org", "é@b.com a@b.comé1@q.rs", "@a.bc", "a@@b.cd", "q" * 300 + " q@r.st"]
    every = lambda pattern: lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    assert evaluate(spark, every(E._ADDRESS), texts) == evaluate(spark, every(ADDRESS_PATTERN), texts)
    blanks = ["a b", " a  b ", "a\tb", "a \tb\n", "a\n b c", " a　　b", "a‏b ‎ c  d", "a \x01 b", "", "   ", "\u0085 x   "]
    old = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.translate(c, "\u00a0\u200f\u200e", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"(?U)\s+", " "))
    assert evaluate(spark, clean_text, blanks) == evaluate(spark, old, blanks)

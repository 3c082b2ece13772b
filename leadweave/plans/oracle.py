"""Check SQL (DuckDB dialect) for the catalogue, written from the rules and not from the plans."""

from __future__ import annotations

import re

from ..fixed_values import (ABOUT_STEMS, ADDRESS_WORDS, CONTACT_STEMS, DEFAULT_SEARCHES,
                            DIRECTORY_OFFSITE_FRAGMENTS, DISPOSABLE_DOMAINS, FREEMAIL_DOMAINS,
                            INDUSTRY_KEYWORDS, JUNK_HOST_FRAGMENTS, OSM_VALUE_INDUSTRY,
                            PERSON_LABELS, ROLE_MAILBOXES, SOCIAL_HOSTS, TRACKING_PARAMS,
                            VALID_EMAIL_PATTERN)
from ..functions.phones import PLANS
from ..schema import EXPORT_COLUMNS, LEAD_COLUMNS, TEXT_COLUMNS
from .catalog import DIRECTORY, LOOKUP_KEY
from .fixtures import AS_OF, BATCH_NOW, FOREIGN, PAGE_STEP, STORE_NOW


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(items) -> str:
    return ", ".join(lit(x) for x in items)


def listed(items) -> str:
    return f"[{values(items)}]"


# --- scalar rules as SQL text ----------------------------------------------------------------
def sql_clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x{{00A0}}]+', ' ', 'g'))"


def sql_domain(x: str) -> str:
    full = f"CASE WHEN contains({x}, '://') THEN {x} ELSE 'https://' || {x} END"
    return (f"CASE WHEN coalesce({x}, '') = '' THEN '' ELSE regexp_replace(lower(regexp_extract("
            f"{full}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') END")


def sql_netloc(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"


def canon(src: str, column: str, out: str, base: str = "'https://example.com'") -> str:
    """SELECT that adds the canonical form of a URL column to a relation."""
    return f"""SELECT * EXCLUDE (_u, _a, _n, _left, _q, _s, _h, _p, _k) REPLACE () FROM (
      SELECT *, {sql_clean(column)} AS _u,
        CASE WHEN _u = '' THEN '' WHEN starts_with(_u, '//') THEN 'https:' || _u
             WHEN starts_with(_u, '/') THEN regexp_extract({base}, '^https?://[^/?#]+') || _u
             WHEN regexp_matches(_u, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN _u
             WHEN contains(split_part(_u, '/', 1), '@') OR contains(_u, ' ') THEN ''
             ELSE 'https://' || _u END AS _a,
        split_part(_a, '#', 1) AS _n, split_part(_n, '?', 1) AS _left,
        substr(_n, length(_left) + 2) AS _q, lower(split_part(_left, '://', 1)) AS _s,
        lower(split_part(substr(_left, length(_s) + 4), '/', 1)) AS _h,
        rtrim(substr(_left, length(_s) + 4 + length(_h)), '/') AS _p,
        array_to_string(list_filter(string_split(_q, '&'), lambda p:
            lower(split_part(p, '=', 1)) NOT IN ({values(TRACKING_PARAMS)})), '&') AS _k,
        CASE WHEN NOT contains(_h, '.') THEN '' ELSE _s || '://' || regexp_replace(_h, '^www\\.', '')
             || _p || CASE WHEN _k <> '' THEN '?' || _k ELSE '' END END AS {out}
      FROM {src})""".replace(" REPLACE ()", "")


SCORE = """least(100, (CASE WHEN trim(website) <> '' THEN 25 ELSE 0 END)
    + (CASE WHEN trim(email) <> '' THEN 25 ELSE 0 END) + (CASE WHEN trim(phone) <> '' THEN 20 ELSE 0 END)
    + (CASE WHEN linkedin_url || facebook_url || instagram_url <> '' THEN 15 ELSE 0 END)
    + (CASE WHEN length(trim(description)) >= 40 THEN 15 ELSE 0 END)
    + (CASE WHEN trim(contact_person) <> '' THEN 2 ELSE 0 END))"""


def sql_tier(x: str) -> str:
    return (f"CASE WHEN {x} >= 80 THEN 'A (High)' WHEN {x} >= 60 THEN 'B (Medium)' "
            f"WHEN {x} >= 40 THEN 'C (Low)' ELSE 'D (Minimal)' END")


KEY = f"""CASE WHEN {sql_domain('website')} <> '' THEN 'dom:' || {sql_domain('website')}
    WHEN company_name || city || country || phone <> '' THEN 'name:' || array_to_string(list_filter(
        [lower(trim(company_name)), lower(trim(city)), lower(trim(country)), replace(phone, ' ', '')],
        lambda p: p <> ''), '|')
    ELSE 'anon:' || md5(concat_ws(chr(31), {', '.join(TEXT_COLUMNS)})) END"""


def graded(src: str, extra: str = "") -> str:
    """Relation with score and tier replaced."""
    return (f"SELECT * EXCLUDE (confidence_score, confidence_tier), {SCORE} AS confidence_score, "
            f"{sql_tier('confidence_score')} AS confidence_tier {extra} FROM {src}")


# DuckDB's alias reuse would see the old column first, hence the two steps
def graded2(src: str) -> str:
    return (f"SELECT *, {sql_tier('confidence_score')} AS confidence_tier FROM (SELECT * EXCLUDE "
            f"(confidence_score, confidence_tier), CAST({SCORE} AS INTEGER) AS confidence_score FROM {src})")


def sql_valid_email(x: str) -> str:
    e = f"rtrim(lower(trim({x})), '.')"
    pattern = VALID_EMAIL_PATTERN.replace("'", "''")
    return (f"(regexp_matches({e}, '{pattern}') AND length({e}) <= 254 AND NOT starts_with({e}, '.') "
            f"AND NOT contains({e}, '.@') AND NOT contains(split_part({e}, '@', 1), '..'))")


def sql_email_kind(x: str) -> str:
    e = f"lower(trim({x}))"
    host = f"substr({e}, position('@' in {e}) + 1)"
    return (f"CASE WHEN NOT {sql_valid_email(x)} THEN 'invalid' WHEN {host} IN ({values(DISPOSABLE_DOMAINS)}) "
            f"THEN 'disposable' WHEN split_part({e}, '@', 1) IN ({values(ROLE_MAILBOXES)}) THEN 'role' "
            f"WHEN {host} IN ({values(FREEMAIL_DOMAINS)}) THEN 'personal' ELSE 'business' END")


EMAILS = r"""list_filter(list_transform(list_concat(
    regexp_extract_all({t}, '(?i)mailto:([^?"''\s>]+)', 1),
    regexp_extract_all({t}, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}')),
    lambda e: rtrim(lower(trim(e)), '.')), lambda e: contains(e, '@'))"""

PHONES = r"""list_filter(list_concat(
    regexp_extract_all({t}, '(?i)tel:([0-9+().\-\s]+)', 1),
    regexp_extract_all({t}, '\+?\d[\d\-\s().]{{7,}}\d')),
    lambda c: length(regexp_replace(c, '[^0-9+]', '', 'g')) BETWEEN 8 AND 15)"""

_EG = (r"1[0125]\d{8}|2\d{8}|3\d{7}|(?:13|15|4[05678]|5[057]|6[24689]|8[2468]|9[23567])\d{7}"
       r"|800\d{7}|900\d{7}")
_NANP = r"[2-9]\d\d[2-9]\d{6}"


def _foreign(n: str, prefix: str, when: str) -> str:
    """The other plans; a number of a country that has none is taken as it is."""
    whens = []
    for p in PLANS:
        if p.region not in ("EG", "US"):
            form = f"({'|'.join(x for x in (p.mobile, p.fixed, *p.service.values()) if x)})"
            form = f"^{prefix}{p.code}{p.trunk and p.trunk + '?'}{form}$"
            whens.append(f"WHEN {when} AND regexp_matches({n}, '{form}') THEN '+{p.code}' || regexp_extract({n}, '{form}', 1)")
    whens.append(f"WHEN {when} AND regexp_matches({n}, '^{prefix}[1-9][0-9]{{7,14}}$') AND NOT regexp_matches({n}, "
                 f"'^{prefix}(?:{'|'.join(p.code for p in PLANS)})') THEN '+' || regexp_extract({n}, '^{prefix}(.*)$', 1)")
    return " ".join(whens)


def sql_e164(x: str) -> str:
    """E.164 under the plans, home region Egypt."""
    start = f"regexp_extract({x}, '[+0-9](?:.|\\n)*')"
    plus = f"starts_with({start}, '+')"
    n = f"regexp_replace({start}, '[^0-9]', '', 'g')"
    return f"""CASE WHEN regexp_matches({start}, '[a-zA-Z]') THEN ''
      WHEN {plus} AND regexp_matches({n}, '^200?(?:{_EG})$') THEN '+20' || regexp_extract({n}, '^200?({_EG})$', 1)
      WHEN {plus} AND regexp_matches({n}, '^11?{_NANP}$') THEN '+1' || right({n}, 10)
      {_foreign(n, '', plus)}
      WHEN {plus} THEN ''
      WHEN regexp_matches({n}, '^0?(?:{_EG})$') THEN '+20' || regexp_extract({n}, '^0?({_EG})$', 1)
      WHEN regexp_matches({n}, '^(?:00)?200?(?:{_EG})$') THEN '+20' || regexp_extract({n}, '^(?:00)?200?({_EG})$', 1)
      WHEN regexp_matches({n}, '^0011?{_NANP}$') THEN '+1' || right({n}, 10)
      {_foreign(n, '00', 'TRUE')}
      ELSE '' END"""


MOBILE = ("(regexp_matches(e164, '" + "|".join(rf"^\+{p.code}(?:{p.mobile})$" for p in PLANS) + "') AND NOT regexp_matches(e164, '"
          + "|".join(rf"^\+{p.code}(?:{x})$" for p in PLANS for x in p.service.values()) + "'))")


def industry_cte(name: str, src: str, key: str, text: str) -> str:
    """Relation (key, industry) from keyword counts; rows without a hit are absent."""
    rows = ", ".join(f"({i}, {lit(n)}, {lit(w)}, {j})" for i, (n, ws) in enumerate(INDUSTRY_KEYWORDS.items())
                     for j, w in enumerate(ws))
    return f"""{name} AS (
      SELECT {key}, arg_min(industry, (-score, i)) AS industry FROM (
        SELECT t.{key}, k.i, k.industry, sum((length(t.low) - length(replace(t.low, k.word, ''))) // length(k.word)) AS score
        FROM (SELECT {key}, lower({text}) AS low FROM {src}) t,
             (VALUES {rows}) k(i, industry, word, j)
        GROUP BY ALL) WHERE score > 0 GROUP BY {key})"""


# --- shared relations ------------------------------------------------------------------------
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


cte("fx_raw", f"""
  SELECT c_custkey AS ord, CAST(c_nationkey AS BIGINT) AS search_id,
    CASE WHEN c_custkey % 10 = 0 THEN 'Shared Name ' || (c_custkey % 70)
         WHEN c_custkey % 10 = 3 THEN 'Shared Name ' || ((c_custkey + 7) % 70) ELSE c_name END AS company_name,
    CASE WHEN c_custkey % 8 = 0 THEN '' ELSE c_mktsegment END AS industry, lower(c_mktsegment) AS category,
    CASE WHEN c_custkey % 5 = 0 THEN ''
         WHEN c_custkey % 3 = 0 THEN 'https://www.biz' || (c_custkey % 400) || '.example.com/home/?utm_source=x&id=' || c_custkey
         ELSE 'biz' || (c_custkey % 400) || '.example.com' END AS website,
    CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'info@biz' || (c_custkey % 400) || '.example.com'
         WHEN 2 THEN 'user' || c_custkey || '@gmail.com' WHEN 3 THEN 'x' || c_custkey || '@mailinator.com'
         WHEN 4 THEN 'bad@@mail' ELSE 'owner.' || c_custkey || '@biz' || (c_custkey % 400) || '.example.com' END AS email,
    CASE c_custkey % 4 WHEN 0 THEN ''
         WHEN 1 THEN '0100 ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')
         WHEN 2 THEN '+20 2 2' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
         ELSE CASE WHEN c_custkey % 8 = 7 THEN """ + f"{listed(FOREIGN)}[c_custkey // 8 % {len(FOREIGN)} + 1]" + """
              || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') ELSE '123' END END AS phone,
    '' AS whatsapp, '' AS address, n_name AS city,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Gov ' || (c_custkey % 12) END AS governorate, r_name AS country,
    '' AS maps_link, '' AS linkedin_url,
    CASE WHEN c_custkey % 7 = 0 THEN 'https://facebook.com/b' || c_custkey ELSE '' END AS facebook_url,
    '' AS instagram_url, '' AS employees,
    CASE WHEN c_custkey % 2 = 0 THEN 'Description of business number ' || c_custkey || ' in a long enough sentence.' ELSE 'short' END AS description,
    CASE WHEN c_custkey % 11 = 0 THEN 'Jane Doe' ELSE '' END AS contact_person, website AS source_url,
    CAST(0 AS INTEGER) AS confidence_score, '' AS confidence_tier, '' AS dedup_key,
    TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 40) DAY AS discovered_at,
    TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 40 + c_custkey % 9) DAY AS updated_at, '' AS lead_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
cte("fx_graded", graded2("fx_raw"))
cte("fx_leads", f"""
  SELECT *, md5(dedup_key) AS lead_id FROM (SELECT * EXCLUDE (dedup_key, lead_id), {KEY} AS dedup_key FROM fx_graded)""")
cte("fx_osm", """
  SELECT c_custkey AS ord, round(30.0444::DOUBLE + ((37 * c_custkey) % 200 - 100) * 0.002::DOUBLE, 4) AS lat,
    round(31.2357::DOUBLE + ((53 * c_custkey) % 200 - 100) * 0.002::DOUBLE, 4) AS lon, 'Shop ' || (c_custkey % 900) AS name,
    ['shop', 'amenity', 'office', 'healthcare', 'craft', 'shop'][c_custkey % 6 + 1] AS k,
    ['car', 'dentist', 'it', 'clinic', 'carpenter', 'unknown_thing'][c_custkey % 6 + 1] AS v FROM customer""")
cte("osm_values", "SELECT * FROM (VALUES " + ", ".join(
    f"({lit(k)}, {lit(v)})" for k, v in OSM_VALUE_INDUSTRY.items()) + ") t(value, label)")
CTES["osm_guess"] = industry_cte("x", "fx_osm", "ord", "' ' || name").split(" AS (", 1)[1][:-1]
cte("osm_industry", """
  SELECT o.ord, coalesce(m.label, g.industry, 'Other') AS industry
  FROM fx_osm o LEFT JOIN osm_values m ON m.value = o.v LEFT JOIN osm_guess g ON g.ord = o.ord""")
cte("osm_leads", f"""
  SELECT o.ord, o.lat, o.lon, o.k, o.name AS company_name, i.industry, o.k || '=' || replace(o.v, '_', ' ') AS category,
    CASE WHEN o.k = 'craft' THEN '' ELSE upper(o.k[1]) || o.k[2:] || ': ' || replace(o.v, '_', ' ') END AS description,
    'https://www.google.com/maps/search/?api=1&query=' || o.lat || ',' || o.lon AS maps_link,
    'https://www.openstreetmap.org' AS source_url,
    '' AS website, '' AS email, '' AS phone, '' AS whatsapp, '' AS address, '' AS governorate, '' AS linkedin_url,
    '' AS facebook_url, '' AS instagram_url, '' AS employees, '' AS contact_person,
    0 AS confidence_score, 'D (Minimal)' AS confidence_tier
  FROM fx_osm o JOIN osm_industry i USING (ord)""")
cte("fx_gazetteer", """
  SELECT n_name AS place, 30 + n_nationkey / 10 AS lat, 31 + n_nationkey / 10 AS lon FROM nation""")
cte("fx_searches", """
  SELECT *, array_to_string(list_filter([governorate, city], lambda p: p <> ''), ', ') AS place FROM (
    SELECT CAST(n_nationkey AS BIGINT) AS search_id,
      ['Dental Clinics', 'it', 'restaurant', 'Used Cars', 'beauty'][n_nationkey % 5 + 1] AS query,
      CASE WHEN n_nationkey % 4 = 0 THEN 'MACHINERY' ELSE '' END AS industry, '' AS category, n_name AS city,
      '' AS governorate, 'Egypt' AS country, CASE WHEN n_nationkey % 2 = 0 THEN 12 END AS radius_km,
      [20, 60, 200][n_nationkey % 3 + 1] AS lim,
      CASE WHEN n_nationkey % 7 = 6 THEN ['search'] ELSE ['openstreetmap', 'search', 'directories'] END AS sources
    FROM nation UNION ALL SELECT * FROM (VALUES """ + ", ".join(
    f"({25 + i}, {lit(s['query'])}, '', '', {lit(s['city'])}, '', {lit(s['country'])}, NULL, NULL, "
    "['openstreetmap', 'search', 'directories'])" for i, s in enumerate(DEFAULT_SEARCHES)) + "))")
cte("fx_hits_raw", """
  SELECT search_id, ord, CAST(ord % 3 AS INTEGER) AS engine,
    CASE WHEN ord % 3 = 2 THEN 'directories' ELSE 'search' END AS source, company_name AS name,
    CASE WHEN ord % 13 = 0 THEN 'https://www.facebook.com/b' || ord
         WHEN ord % 17 = 0 THEN 'https://www.fedex.com/' || ord ELSE website END AS raw_url
  FROM fx_raw WHERE website <> ''""")
cte("fx_hits", canon("fx_hits_raw", "raw_url", "url"))
cte("fx_business", "SELECT * FROM fx_hits WHERE " + f"{sql_netloc('url')} <> '' AND NOT (" + " OR ".join(
    f"contains({sql_netloc('url')}, {lit(j)})" for j in JUNK_HOST_FRAGMENTS) + ")")
cte("fx_pages_c", canon("pages", "url", "c_url"))
cte("fx_site_pages", f"""
  SELECT page_id, url, c_url, {sql_domain('c_url')} AS host,
    CASE WHEN page_id % 2 = 0 THEN replace(html, '</head>', '<meta name="description" content="Business number '
      || page_id || ' serving customers across the city."></head>') ELSE html END
    || CASE WHEN page_id % 3 = 0 THEN '<a href="mailto:info@' || host || '">Mail us</a> owner' || page_id || '@' || host || ' ' ELSE '' END
    || CASE WHEN page_id % 4 = 0 THEN ' Call 0100 ' || lpad(CAST(page_id AS VARCHAR), 3, '0') || ' 4567 now. ' ELSE '' END
    || CASE WHEN page_id % 5 = 0 THEN '<a href="https://www.facebook.com/' || page_id || '">f</a> <a href="https://eg.linkedin.com/company/' || page_id || '">l</a>' ELSE '' END
    || CASE WHEN page_id % 6 = 0 THEN '<a href="https://wa.me/20100' || lpad(CAST(page_id AS VARCHAR), 3, '0') || '4567">chat</a>' ELSE '' END
    || CASE WHEN page_id % 7 = 0 THEN '<a href="/contact-us">Contact</a> <a href="about/team.html">Team</a>' ELSE '' END
    || CASE WHEN page_id % 8 = 0 THEN '<address>' || page_id || ' Nile Street, Cairo</address>' ELSE '' END
    || CASE WHEN page_id % 9 = 0 THEN '<p>Contact Person: Mona Adel.</p>' ELSE '' END
    || CASE WHEN page_id % 10 = 0 THEN '<p>' || page_id || ' employees</p>' ELSE '' END AS html
  FROM fx_pages_c""")
_ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def sql_decode(x: str) -> str:
    for ref, ch in _ENTITIES:
        x = f"replace({x}, {lit(ref)}, {lit(ch)})"
    return x


def sql_text(x: str) -> str:
    for p in (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>",
              r"(?is)<noscript\b.*?</noscript>", r"</?[a-zA-Z!][^>]*>"):
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return sql_clean(sql_decode(x))


cte("page_texts", f"SELECT *, {sql_text('html')} AS text FROM fx_site_pages")
cte("fx_site_leads", f"""
  WITH own AS (SELECT page_id AS ord, url AS website, CASE WHEN page_id % 3 = 0 THEN 'kept@' || host ELSE '' END AS email FROM fx_site_pages)
  {graded2('''(SELECT ord, ''' + ", ".join(
    {"website": "website", "email": "email", "confidence_score": "0"}.get(c, "''") + f" AS {c}" for c in EXPORT_COLUMNS)
    + ''' FROM own UNION ALL BY NAME SELECT ord + 1000000 AS ord, ''' + ", ".join(EXPORT_COLUMNS)
    + ''' FROM fx_raw)''')}""")
cte("fx_crawled", """
  SELECT page_id, c_url, host, html FROM fx_site_pages
  UNION ALL SELECT page_id + 10000000, 'https://' || host || '/contact-us', host,
    '<html><body><a href="mailto:contact' || page_id || '@' || host || '">Write</a> Call +20 111 234 '
    || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') || ' now. <p>Contact Person: Omar Said.</p></body></html>'
  FROM fx_site_pages WHERE page_id % 7 = 0 AND host <> ''""")
cte("crawled_first", f"""
  SELECT *, {sql_text('html')} AS text FROM fx_crawled WHERE c_url <> ''
  QUALIFY row_number() OVER (PARTITION BY c_url ORDER BY page_id) = 1""")
cte("fx_texts", """
  SELECT 'document' AS src, doc_id AS id, text FROM documents
  UNION ALL SELECT 'page', page_id, html FROM fx_site_pages
  UNION ALL SELECT 'lead', ord, email || ' ' || phone FROM fx_raw""")
cte("found_emails", f"""
  SELECT src, id, email, row_number() OVER (PARTITION BY src, id ORDER BY p) - 1 AS pos FROM (
    SELECT src, id, email, min(p) AS p FROM (
      SELECT src, id, unnest(e) AS email, generate_subscripts(e, 1) AS p
      FROM (SELECT src, id, {EMAILS.format(t='text')} AS e FROM fx_texts)) GROUP BY ALL)""")
cte("addresses", "SELECT src, id, email FROM found_emails UNION ALL SELECT 'raw', ord, email FROM fx_raw")
cte("found_phones", f"""
  SELECT src, id, phone, row_number() OVER (PARTITION BY src, id ORDER BY p) - 1 AS pos FROM (
    SELECT src, id, key, arg_min(phone, p) AS phone, min(p) AS p FROM (
      SELECT src, id, trim(c, E' \\n\\t\\r') AS phone, ltrim(regexp_replace(c, '[^0-9+]', '', 'g'), '+') AS key, p FROM (
        SELECT src, id, unnest(f) AS c, generate_subscripts(f, 1) AS p
        FROM (SELECT src, id, {PHONES.format(t='text')} AS f FROM fx_texts))) GROUP BY src, id, key)""")
cte("numbers", f"SELECT *, {sql_e164('phone')} AS e164 FROM found_phones")
_HREFS = r"""regexp_extract_all({t}, '(?is)<a\b[^>]*?\shref\s*=\s*"([^"]*)"', 1)"""
cte("contact_hrefs", f"""
  SELECT host, page_id, 'https://' || host AS base, {sql_decode('href')} AS href, p - 1 AS p FROM (
    SELECT host, page_id, unnest(h) AS href, generate_subscripts(h, 1) AS p
    FROM (SELECT host, page_id, {_HREFS.format(t='html')} AS h FROM fx_site_pages))
  WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)')
    AND list_bool_or(list_transform({listed(CONTACT_STEMS + ABOUT_STEMS)}, lambda s: contains(lower(href), s)))""")
cte("contact_urls_raw", canon("contact_hrefs", "href", "url", "base"))
cte("contact_urls", """
  SELECT host, page_id, base, url, min(p) AS pos FROM contact_urls_raw WHERE url <> '' GROUP BY ALL""")
cte("crawled_hrefs", f"""
  SELECT c_url AS base, {sql_decode('href')} AS href, p FROM (
    SELECT c_url, unnest(h) AS href, generate_subscripts(h, 1) AS p
    FROM (SELECT c_url, {_HREFS.format(t='html')} AS h FROM crawled_first))
  WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)')
    AND list_bool_or(list_transform({listed(CONTACT_STEMS + ABOUT_STEMS)}, lambda s: contains(lower(href), s)))""")
cte("crawled_links_raw", canon("crawled_hrefs", "href", "url", "base"))
cte("crawled_links", """
  SELECT base, url, row_number() OVER (PARTITION BY base ORDER BY min(p)) AS nth
  FROM crawled_links_raw WHERE url <> '' AND url <> base GROUP BY base, url""")
cte("site_leads_c", canon("fx_site_leads", "website", "site_url"))
cte("site_ranked", """
  WITH sites AS (SELECT DISTINCT site_url AS site FROM site_leads_c WHERE site_url <> '')
  SELECT s.site, 1 AS page_rank, f.* FROM sites s JOIN crawled_first f ON f.c_url = s.site
  UNION ALL SELECT s.site, l.nth + 1, f.* FROM sites s JOIN crawled_first h ON h.c_url = s.site
    JOIN crawled_links l ON l.base = s.site JOIN crawled_first f ON f.c_url = l.url""")
cte("http_links", """
  SELECT host, page_id, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS p FROM (
    SELECT host, page_id, regexp_extract_all(html, '(?i)https?://[a-zA-Z0-9_.\\-:/?#\\[\\]@!$&''()*+,;=%~]+') AS l
    FROM fx_site_pages)""".replace("\\\\", "\\"))
cte("http_canon", canon("http_links", "link", "url"))


def sql_platform(h: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"{h} = {lit(x)} OR ends_with({h}, {lit('.' + x)})" for x in hosts)
        + f" THEN {lit(p)}" for p, hosts in SOCIAL_HOSTS.items())
    return f"CASE {whens} END"


cte("social_links", f"""
  SELECT host, page_id, platform, url, min(p) AS pos FROM (
    SELECT *, {sql_platform(sql_domain('url'))} AS platform FROM http_canon WHERE url <> '')
  WHERE platform IS NOT NULL GROUP BY ALL""")


# --- upsert as SQL ---------------------------------------------------------------------------
def upsert_ctes(prefix: str, store: str | None, batch: str, now: str, order: str = "ord") -> None:
    """<prefix>_rows (row actions) and <prefix>_snap (snapshot) from window rules."""
    stored = (f"SELECT NULL AS ord_, -1 AS side, {', '.join(TEXT_COLUMNS)}, confidence_score, "
              f"confidence_tier, dedup_key, discovered_at, updated_at FROM {store} UNION ALL " if store else "")
    cte(f"{prefix}_all", f"""
      {stored} SELECT {order} AS ord_, 0 AS side, {', '.join(TEXT_COLUMNS)}, confidence_score, confidence_tier,
        {KEY} AS dedup_key, discovered_at, updated_at FROM {batch}""")
    seen = " OR ".join(f"({c} <> '' AND NOT coalesce(bool_or({c} <> '') OVER w, FALSE))" for c in TEXT_COLUMNS)
    cte(f"{prefix}_rows", f"""
      SELECT *, CASE WHEN side = -1 THEN 'stored' WHEN row_number() OVER p = 1 THEN 'inserted'
          WHEN {seen} THEN 'updated' ELSE 'unchanged' END AS action
      FROM {prefix}_all
      WINDOW p AS (PARTITION BY dedup_key ORDER BY side, ord_),
             w AS (PARTITION BY dedup_key ORDER BY side, ord_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
    first = ", ".join(
        f"coalesce(first({c} ORDER BY side, ord_) FILTER (WHERE {c} <> ''), '') AS {c}" for c in TEXT_COLUMNS)
    cte(f"{prefix}_snap", f"""
      SELECT {first}, first(confidence_score ORDER BY side, ord_) AS confidence_score,
        first(confidence_tier ORDER BY side, ord_) AS confidence_tier, dedup_key,
        first(discovered_at ORDER BY side, ord_) AS discovered_at,
        CASE WHEN bool_or(action IN ('inserted', 'updated')) THEN TIMESTAMP '{now}'
             ELSE first(updated_at ORDER BY side, ord_) END AS updated_at, md5(dedup_key) AS lead_id
      FROM {prefix}_rows GROUP BY dedup_key""")


cte("fx_first", "SELECT * FROM fx_graded WHERE ord % 2 = 0")
cte("fx_batch", "SELECT * FROM fx_graded WHERE ord % 2 = 1")
upsert_ctes("st", None, "fx_first", STORE_NOW)
upsert_ctes("up", "st_snap", "fx_batch", BATCH_NOW)
upsert_ctes("tk", "st_snap", "fx_batch", BATCH_NOW, "(ord % 5) * 1000000000 + ord")

# --- scan as SQL -----------------------------------------------------------------------------
_DIST = """2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2)
    + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"""
cte("osm_near", f"""
  SELECT s.search_id, s.city AS place, s.lim, o.* FROM fx_searches s
  JOIN fx_gazetteer g ON lower(g.place) = lower(s.place), osm_leads o
  WHERE list_contains(s.sources, 'openstreetmap') AND s.place <> ''
    AND {_DIST.format(a='g.lat', b='o.lat', c='g.lon', d='o.lon')} <= coalesce(s.radius_km * 1000, 8000)
    AND CASE lower(trim(s.query)) WHEN 'it' THEN o.k = 'office' WHEN 'restaurant' THEN o.k = 'amenity'
             WHEN 'beauty' THEN o.k = 'shop' ELSE o.k IN ('shop', 'office', 'amenity', 'healthcare') END""")
cte("osm_found", """
  SELECT * FROM (SELECT * FROM osm_near QUALIFY row_number() OVER (PARTITION BY search_id, lower(company_name) ORDER BY ord) = 1)
  QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY ord) <= coalesce(lim, 1000000000)""")
cte("web_urls", """
  SELECT * FROM (SELECT b.search_id, b.url, min(b.ord) AS ord, any_value(s.lim) AS lim FROM fx_business b
    JOIN fx_searches s USING (search_id) WHERE b.source = 'search' AND list_contains(s.sources, 'search') GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY ord) <= coalesce(lim, 1000000000)""")
cte("dir_rows", """
  SELECT * FROM (SELECT h.search_id, h.ord, h.name, h.url, s.lim FROM fx_hits h JOIN fx_searches s USING (search_id)
    WHERE h.source = 'directories' AND list_contains(s.sources, 'directories') AND h.url <> '' AND h.name <> ''
    QUALIFY row_number() OVER (PARTITION BY h.search_id, lower(h.name), lower(h.url) ORDER BY h.ord) = 1)
  QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY ord) <= coalesce(lim, 1000000000)""")
_BLANK = {c: "''" for c in EXPORT_COLUMNS} | {"confidence_score": "0"}


def lead_row(**given: str) -> str:
    return ", ".join(f"{given.get(c, _BLANK[c])} AS {c}" for c in EXPORT_COLUMNS)


cte("dir_queries", "SELECT h.ord, s.query || ' ' || h.name AS t FROM fx_hits h JOIN fx_searches s USING (search_id)")
CTES["dir_guess"] = industry_cte("x", "dir_queries", "ord", "t").split(" AS (", 1)[1][:-1]


def web_lead(rel: str) -> str:
    return f"""SELECT u.search_id, u.ord, {lead_row(
        website='u.url', source_url='u.url', city='s.city', governorate='s.governorate', country='s.country',
        industry='s.industry', category="CASE WHEN s.category <> '' THEN s.category ELSE s.query END",
        description="'Discovered via search for ''' || s.query || '''.'")}
      FROM {rel} u JOIN fx_searches s USING (search_id)"""


def dir_lead(rel: str) -> str:
    return f"""SELECT u.search_id, u.ord, {lead_row(
        company_name='u.name', website='u.url', source_url='u.url',
        city="CASE WHEN s.place <> '' THEN s.place ELSE s.city END", country='s.country',
        industry="coalesce(g.industry, 'Other')", category='s.query',
        description="'Found via business directory for ''' || s.query || ''' in ' || s.place || '.'")}
      FROM {rel} u JOIN fx_searches s USING (search_id) LEFT JOIN dir_guess g ON g.ord = u.ord"""


cte("web_leads", graded2(f"({web_lead('web_urls')})"))
cte("dir_leads", graded2(f"({dir_lead('dir_rows')})"))
cte("all_found", f"""
  SELECT search_id, ord, 'openstreetmap' AS source, * EXCLUDE (search_id, ord) FROM (
    SELECT search_id, ord, {", ".join(c if c not in ("city", "country") else
      {"city": "place AS city", "country": "'Egypt' AS country"}[c] for c in EXPORT_COLUMNS)} FROM osm_found)
  UNION ALL BY NAME SELECT search_id, ord + 1000000000000 AS ord, 'search' AS source, * EXCLUDE (search_id, ord) FROM web_leads
  UNION ALL BY NAME SELECT search_id, ord + 2000000000000 AS ord, 'directories' AS source, * EXCLUDE (search_id, ord) FROM dir_leads""")


def dedup_ctes(prefix: str, src: str, scope: str = "") -> None:
    """<prefix>_kept: candidates after de-duplication, merged columns included."""
    part = f"{scope}, " if scope else ""
    cte(f"{prefix}_in", f"SELECT *, {sql_domain('website')} AS dom, lower({sql_clean('company_name')}) AS nm FROM {src}")
    merged = ", ".join(f"first({c} ORDER BY ord) FILTER (WHERE {c} <> {0 if c == 'confidence_score' else chr(39) * 2}) AS {c}"
                       for c in EXPORT_COLUMNS)
    cte(f"{prefix}_dom", f"""
      SELECT {part} min(ord) AS ord, first(nm ORDER BY ord) AS nm, {merged} FROM {prefix}_in WHERE dom <> '' GROUP BY {part} dom""")
    cte(f"{prefix}_names", f"""
      SELECT * FROM (SELECT {part} ord, nm, TRUE AS sited FROM {prefix}_dom UNION ALL
                     SELECT {part} ord, nm, FALSE FROM {prefix}_in WHERE dom = '')
      WHERE nm <> '' QUALIFY row_number() OVER (PARTITION BY {part} nm ORDER BY ord) = 1""")
    cols = ", ".join(EXPORT_COLUMNS)
    filled = ", ".join(f"coalesce({c}, {0 if c == 'confidence_score' else chr(39) * 2}) AS {c}" for c in EXPORT_COLUMNS)
    cte(f"{prefix}_kept", f"""
      SELECT {part} ord, {filled} FROM {prefix}_dom
      UNION ALL BY NAME SELECT {part} ord, {cols} FROM {prefix}_in WHERE dom = '' AND (nm = '' OR ({part} ord) IN (
          SELECT {'(' + scope + ', ord)' if scope else 'ord'} FROM {prefix}_names WHERE NOT sited))""")


dedup_ctes("dd", "fx_raw")
dedup_ctes("sd", "all_found", "search_id")
cte("sd_capped", "SELECT * FROM sd_kept")


def finalize(src: str, keep: str) -> str:
    """Back-fill from the search, name, canonical website and grade."""
    fill = {c: f"CASE WHEN l.{c} <> '' THEN l.{c} ELSE s.{c} END" for c in ("city", "governorate", "industry", "country")}
    fill["category"] = ("CASE WHEN l.category <> '' THEN l.category WHEN s.category <> '' THEN s.category ELSE s.query END")
    cols = ", ".join(f"{fill.get(c, 'l.' + c)} AS {c}" for c in EXPORT_COLUMNS)
    named = canon(f"(SELECT {keep}, {cols} FROM {src} l JOIN fx_searches s USING (search_id))", "website", "site_url")
    return graded2(f"""(SELECT * EXCLUDE (site_url, website, company_name), site_url AS website,
        CASE WHEN trim(company_name) <> '' THEN {sql_clean('company_name')} WHEN site_url <> '' THEN {sql_domain('site_url')}
             ELSE 'Unknown Business' END AS company_name FROM ({named}))""")


cte("scan_final", f"""SELECT *, TIMESTAMP '{BATCH_NOW}' AS discovered_at, TIMESTAMP '{BATCH_NOW}' AS updated_at
  FROM ({finalize('sd_capped', 'search_id, l.ord')})""")
upsert_ctes("sc", "st_snap", "scan_final", BATCH_NOW, "{'s': search_id, 'o': ord}")
CTES["sc_all"] = CTES["sc_all"].replace("SELECT NULL AS ord_", "SELECT CAST(NULL AS STRUCT(s BIGINT, o BIGINT)) AS ord_")

upsert_ctes("rt", "st_snap", "scan_final", BATCH_NOW, "{'t': search_id % 2, 's': search_id, 'o': ord}")
CTES["rt_all"] = CTES["rt_all"].replace("SELECT NULL AS ord_", "SELECT CAST(NULL AS STRUCT(t BIGINT, s BIGINT, o BIGINT)) AS ord_")

# --- result and listing pages ----------------------------------------------------------------
cte("result_pages", """
  SELECT page, engine, '<html><body><a href="https://www.google.com/preferences">Settings</a>' || string_agg(
    CASE engine WHEN 'duckduckgo' THEN '<a class="result__a" href="//duckduckgo.com/l/?uddg=' || url_encode(raw_url) || '&amp;rut=x">' || name || '</a>'
      WHEN 'google' THEN '<a href="/url?q=' || url_encode(raw_url) || '&amp;sa=U">' || name || '</a>'
      ELSE '<li class="b_algo"><h2><a href="' || replace(raw_url, '&', '&amp;') || '">' || name || '</a></h2></li>' END, chr(10) ORDER BY ord)
    || '<a href="https://help.bing.microsoft.com/x.html">Help</a></body></html>' AS html
  FROM (SELECT * EXCLUDE (engine), ord // 10 AS page, ['duckduckgo', 'google', 'bing'][ord // 10 % 3 + 1] AS engine FROM fx_hits_raw) GROUP BY page, engine""")
cte("result_links", f"""
  SELECT page, engine, p, CASE engine
      WHEN 'duckduckgo' THEN url_decode(replace(url_decode(regexp_extract(href, '[?&]uddg=([^&#]*)', 1)), '+', '%2B'))
      WHEN 'google' THEN CASE WHEN starts_with(href, '/url?') THEN url_decode(regexp_extract(href, '[?&]q=([^&#]*)', 1)) ELSE href END
      ELSE href END AS target
  FROM (SELECT page, engine, {sql_decode('unnest(h)')} AS href, generate_subscripts(h, 1) AS p FROM (
    SELECT page, engine, CASE engine
        WHEN 'duckduckgo' THEN regexp_extract_all(html, '<a class="result__a" href="([^"]*)"', 1)
        WHEN 'bing' THEN regexp_extract_all(html, '<li class="b_algo"><h2><a href="([^"]*)"', 1)
        ELSE regexp_extract_all(html, '<a href="([^"]*)"', 1) END AS h FROM result_pages))""")
cte("result_canon", canon("(SELECT * FROM result_links WHERE (starts_with(target, 'http') OR engine = 'duckduckgo') "
                          "AND NOT (engine = 'google' AND contains(target, 'google.')))", "target", "url"))
cte("listing_cards", """
  SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY ord) - 1 AS card, name, raw_url, ord % 2 = 0 AS headed, ord % 4 <> 0 AS sited
  FROM (SELECT *, ord // 10 AS page FROM fx_hits_raw)""")
cte("listing_canon", canon("listing_cards", "raw_url", "url"))

# --- site fields -----------------------------------------------------------------------------
_WA = r"(?:wa\.me/\d+|whatsapp\.com/\d+|api\.whatsapp\.com.*?phone=\d+)"


def sql_name(home: str, host: str) -> str:
    return f"""CASE WHEN trim(regexp_extract({home}, '(?is)<title[^>]*>(.*?)</title', 1)) <> ''
      THEN left(trim(split_part(split_part(split_part(split_part({sql_clean(sql_decode(
          f"regexp_extract({home}, '(?is)<title[^>]*>(.*?)</title', 1)"))}, ' | ', 1), ' - ', 1), ' — ', 1), ' :: ', 1)), 120)
      ELSE split_part({host}, '.', 1) END"""


def sql_description(home: str, text: str) -> str:
    meta = f"regexp_extract({home}, '<meta name=\"description\" content=\"([^\"]*)\"', 1)"
    chunks = (f"list_filter(list_transform(string_split({text}, '. '), lambda c: {sql_clean('c')}), lambda c: "
              "length(c) >= 60 AND NOT regexp_matches(lower(c), '^(cookie|we use|skip to)'))")
    return f"CASE WHEN length({meta}) >= 30 THEN left({meta}, 500) ELSE left(coalesce({chunks}[1], ''), 500) END"


def sql_address(html: str, text: str) -> str:
    node = sql_clean(sql_decode(f"regexp_replace(regexp_extract({html}, '(?is)<address[^>]*>(.*?)</address', 1), '<[^>]*>', ' ', 'g')"))
    lines = (f"list_filter(string_split({text}, chr(10)), lambda s: length(s) BETWEEN 15 AND 200 AND list_bool_or("
             f"list_transform({listed(ADDRESS_WORDS)}, lambda w: contains(lower(s), w))))")
    return f"CASE WHEN length({node}) BETWEEN 1 AND 299 THEN {node} ELSE coalesce({lines}[1], '') END"


def sql_whatsapp(html: str) -> str:
    digits = f"regexp_extract(regexp_extract({html}, '(?i){_WA}'), '(\\d+)$', 1)"
    form = sql_e164(f"('+' || {digits})")
    return f"CASE WHEN length({digits}) < 8 THEN '' WHEN ({form}) <> '' THEN ({form}) ELSE '+' || {digits} END"


def sql_employees(text: str) -> str:
    one = rf"regexp_extract({text}, '(?i)(\d{{1,5}})\s*[-+–]?\s*(?:employees|staff|workers|people)', 1)"
    two = rf"regexp_extract({text}, '(?i)(?:team of|over|more than)\s+(\d{{1,5}})\s+(?:employees|staff|professionals)', 1)"
    return (f"CASE WHEN TRY_CAST({one} AS INTEGER) < 10000 THEN CAST({one} AS INTEGER) || ' employees' "
            f"WHEN {two} <> '' THEN {two} || '+ employees' ELSE '' END")


def sql_person(text: str) -> str:
    whens = [rf"nullif(trim(regexp_extract({text}, '{label}\s*[:\-]\s*([A-Z][a-zA-Z.''\- ]{{3,40}})', 1)), '')"
             for label in PERSON_LABELS]
    return f"coalesce({', '.join(whens)}, '')"


cte("doc_emails", f"""
  SELECT site, arg_min(email, (rank, page_rank, p)) AS s_email FROM (
    SELECT site, email, page_rank, p, CASE {sql_email_kind('email')} WHEN 'business' THEN 0 WHEN 'role' THEN 1 ELSE 2 END AS rank FROM (
      SELECT site, page_rank, unnest(e) AS email, generate_subscripts(e, 1) AS p
      FROM (SELECT site, page_rank, {EMAILS.format(t='html')} AS e FROM site_ranked))
    WHERE {sql_valid_email('email')}) GROUP BY site""")
cte("doc_phones", f"""
  SELECT site, arg_min(e164, (CASE WHEN {MOBILE} THEN 0 ELSE 1 END, page_rank, p)) AS s_phone FROM (
    SELECT site, {sql_e164('c')} AS e164, page_rank, p FROM (
      SELECT site, page_rank, unnest(f) AS c, generate_subscripts(f, 1) AS p
      FROM (SELECT site, page_rank, {PHONES.format(t='text')} AS f FROM site_ranked)))
  WHERE e164 <> '' GROUP BY site""")
cte("doc_social", """
  SELECT r.site, """ + ", ".join(
    f"coalesce(first(l.url ORDER BY r.page_rank, l.pos) FILTER (WHERE l.platform = '{p}'), '') AS s_{p}_url"
    for p in ("linkedin", "facebook", "instagram")) + """
  FROM site_ranked r JOIN social_links l USING (page_id) GROUP BY r.site""")
cte("doc_values", f"""
  SELECT site, page_rank, {sql_name('html', 'host')} AS company_name, {sql_description('html', 'text')} AS described,
    {sql_description("''", 'text')} AS sentence, {sql_address('html', "''")} AS node, {sql_address("''", 'text')} AS line,
    {sql_whatsapp('html')} AS whatsapp, {sql_employees('text')} AS employees, {sql_person('text')} AS person FROM site_ranked""")


def _first(c: str, order: str = "page_rank") -> str:
    return f"coalesce(first({c} ORDER BY {order}) FILTER (WHERE {c} <> ''), '')"


cte("doc_fields", f"""
  SELECT d.*, coalesce(e.s_email, '') AS s_email, coalesce(p.s_phone, '') AS s_phone, coalesce(s.s_linkedin_url, '') AS s_linkedin_url,
    coalesce(s.s_facebook_url, '') AS s_facebook_url, coalesce(s.s_instagram_url, '') AS s_instagram_url
  FROM (SELECT site, first(company_name ORDER BY page_rank) AS s_company_name,
      {_first("CASE WHEN page_rank = 1 THEN described ELSE sentence END")} AS s_description,
      CASE WHEN {_first('node')} <> '' THEN {_first('node')} ELSE {_first('line')} END AS s_address, {_first('whatsapp')} AS s_whatsapp,
      {_first('employees', "ends_with(employees, '+ employees'), page_rank")} AS s_employees, {_first('person')} AS s_contact_person
    FROM doc_values GROUP BY site) d
  LEFT JOIN doc_emails e USING (site) LEFT JOIN doc_phones p USING (site) LEFT JOIN doc_social s USING (site)""")
_FILL = ["email", "phone", "whatsapp", "linkedin_url", "facebook_url", "instagram_url", "company_name",
         "description", "address", "employees", "contact_person"]
cte("enr_filled", f"""
  SELECT l.ord, f.site IS NOT NULL AS enriched, l.site_url, l.industry AS old_industry, l.confidence_score AS old_score,
    l.confidence_tier AS old_tier, {", ".join(
    f"CASE WHEN l.{c} <> '' THEN l.{c} ELSE coalesce(f.s_{c}, '') END AS {c}" if c in _FILL else
    ("CASE WHEN l.source_url = '' AND f.site IS NOT NULL THEN l.site_url ELSE l.source_url END AS source_url"
     if c == 'source_url' else f"l.{c}") for c in EXPORT_COLUMNS if c != "industry")}
  FROM site_leads_c l LEFT JOIN doc_fields f ON f.site = l.site_url""")
cte("enr_blobs", """
  SELECT ord, array_to_string(list_filter([company_name, description, category, address], lambda x: x <> ''), ' ') AS t
  FROM enr_filled WHERE enriched AND old_industry = ''""")
CTES["enr_guess"] = industry_cte("x", "enr_blobs", "ord", "t").split(" AS (", 1)[1][:-1]
cte("enr_graded", graded2("(SELECT e.*, CASE WHEN old_industry <> '' THEN old_industry ELSE coalesce(g.industry, '') END AS industry "
                          "FROM enr_filled e LEFT JOIN enr_guess g USING (ord))"))


# --- assembling ------------------------------------------------------------------------------
def _needs(text: str) -> set[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return {n for n in CTES if n in words}


def with_ctes(sql: str) -> str:
    wanted, todo = set(), _needs(sql)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo |= _needs(CTES[name]) - {name}
    if not wanted:
        return sql
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in wanted]
    return "WITH " + ",\n".join(parts) + "\n" + sql


SHOWN = ", ".join(f"strftime({c}, '%Y-%m-%dT%H:%M:%S') AS {c}" if c.endswith("_at") else c for c in LEAD_COLUMNS)
EXPORT = ", ".join(EXPORT_COLUMNS)
RANK = "ORDER BY confidence_score DESC, company_name, dedup_key"
SINCE = {d: f"TIMESTAMP '{AS_OF}' - INTERVAL {d} DAY" for d in (1, 7, 30)}


def _facet(c: str) -> str:
    return f"SELECT {c} AS value, count(*) AS n FROM fx_leads WHERE {c} <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 25"


def _tops(days: int) -> str:
    one = """SELECT '{c}' AS attr, trim({c}) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC,
        min((-confidence_score, company_name, dedup_key))) AS pos FROM fx_leads
        WHERE discovered_at >= {s} AND trim({c}) <> '' GROUP BY 2 QUALIFY pos <= 5"""
    return " UNION ALL ".join(f"({one.format(c=c, s=SINCE[days])})" for c in ("industry", "city"))


def _counts(days: int) -> str:
    s = SINCE[days]
    return f"""SELECT count(*) AS total, count(*) FILTER (WHERE discovered_at >= {s}) AS new,
      count(*) FILTER (WHERE updated_at >= {s} AND discovered_at < {s}) AS updated,
      count(*) FILTER (WHERE email = '') AS missing_email, count(*) FILTER (WHERE phone = '') AS missing_phone,
      count(*) FILTER (WHERE email = '' AND phone = '') AS missing_contact FROM fx_leads"""


def _report(days: int) -> str:
    totals = ["total", "new", "updated", "missing_email", "missing_phone", "missing_contact"]
    counters = " UNION ALL ".join(
        f"SELECT 'totals' AS section, {i} AS pos, '{t}' AS name, '' AS city, '' AS website, {t} AS n FROM ({_counts(days)})"
        for i, t in enumerate(totals, start=1))

    def sample(section: str, cond: str) -> str:
        return (f"SELECT '{section}' AS section, row_number() OVER ({RANK}) AS pos, company_name AS name, city, website, "
                f"confidence_score AS n FROM fx_leads WHERE {cond} QUALIFY pos <= 10")
    return f"""{counters} UNION ALL SELECT CASE attr WHEN 'industry' THEN 'top_industries' ELSE 'top_cities' END, pos, value,
      '', '', n FROM ({_tops(days)}) UNION ALL ({sample('sample_new', f'discovered_at >= {SINCE[days]}')})
      UNION ALL ({sample('sample_missing_contact', "email = '' AND phone = ''")})"""


def _report_lines(days: int) -> str:
    heads = ["Totals", "Top Industries (new)", "Top Cities (new)", "Sample New Leads", "Sample — Missing Contact Info"]
    labels = {"total": "Total leads in DB", "new": "New leads this period", "updated": "Updated this period",
              "missing_email": "Missing email", "missing_phone": "Missing phone", "missing_contact": "Missing any contact"}
    name = "CASE name " + " ".join(f"WHEN '{k}' THEN '{v.ljust(25)}'" for k, v in labels.items()) + " END"
    fixed = [f"(0, 1, 'Leads — Daily Report'), (0, 2, 'Period start : ' || strftime({SINCE[days]}, '%Y-%m-%dT%H:%M:%S+00:00')), "
             f"(0, 3, 'Generated at : ' || strftime(TIMESTAMP '{AS_OF}', '%Y-%m-%dT%H:%M:%S+00:00')), (0, 4, repeat('=', 50)), (6, 0, '')"]
    fixed += [f"({i}, -2, ''), ({i}, -1, '{h}'), ({i}, 0, repeat('-', 50))" for i, h in enumerate(heads, start=1)]
    return f"""SELECT list_position(['totals', 'top_industries', 'top_cities', 'sample_new', 'sample_missing_contact'], section) AS section,
      pos, CASE section WHEN 'totals' THEN '  ' || {name} || ': ' || n
        WHEN 'sample_new' THEN '  - ' || name || '  [' || city || ']  score=' || n
        WHEN 'sample_missing_contact' THEN '  - ' || name || '  [' || city || ']  ' || website
        ELSE '  ' || name || ': ' || n END AS line FROM ({_report(days)})
      UNION ALL SELECT * FROM (VALUES {', '.join(fixed)})"""


def _report_json(days: int) -> str:
    def obj(section: str) -> str:
        return (f"(SELECT '{{' || string_agg('\"' || name || '\":' || n, ',' ORDER BY pos) || '}}' FROM r WHERE section = '{section}')")

    def arr(section: str, third: str) -> str:
        return (f"(SELECT '[' || string_agg('{{\"company\":\"' || name || '\",\"city\":\"' || city || '\",' || {third} || '}}', ',' ORDER BY pos) "
                f"|| ']' FROM r WHERE section = '{section}')")
    return f"""SELECT '{{"period_label":"Weekly","period_start":"' || strftime({SINCE[days]}, '%Y-%m-%dT%H:%M:%S+00:00')
      || '","generated_at":"' || strftime(TIMESTAMP '{AS_OF}', '%Y-%m-%dT%H:%M:%S+00:00') || '","totals":' || {obj('totals')}
      || ',"top_industries":' || {obj('top_industries')} || ',"top_cities":' || {obj('top_cities')}
      || ',"sample_new":' || {arr('sample_new', "'\"score\":' || n")}
      || ',"sample_missing_contact":' || {arr('sample_missing_contact', "'\"website\":\"' || website || '\"'")} || '}}' AS value
      FROM (SELECT 1) one"""


def _like(c: str, v: str) -> str:
    return f"{c} ILIKE '%{v}%'"


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    leads = f"SELECT {SHOWN} FROM fx_leads"
    q["scan_leads"] = f"{leads} {RANK}"
    q["lookup_lead"] = f"{leads} WHERE lead_id = md5({lit(LOOKUP_KEY)})"
    q["scan_osm_elements"] = """SELECT ord // 300 AS response_id, ord % 300 AS pos, name, lat, lon,
        array_to_string(list_sort(['name', k]), ',') AS tag_keys FROM fx_osm WHERE ord % 7 <> 0"""
    q["scan_site_pages"] = "SELECT site, page_rank, page_id, length(html) AS html_chars, md5(text) AS text_md5 FROM site_ranked"
    q["scan_saved_searches"] = """SELECT ord AS search_id, category AS query, '' AS industry, '' AS category, city, governorate,
        CASE WHEN ord % 2 = 0 THEN country ELSE 'Egypt' END AS country, CASE WHEN ord % 5 = 0 THEN 3 ELSE 0 END AS radius_km,
        CASE WHEN ord % 3 = 0 THEN ord % 100 ELSE -1 END AS "limit",
        CASE WHEN ord % 4 = 0 THEN 'search,directories' ELSE 'openstreetmap,search,directories' END AS sources,
        CASE WHEN governorate = '' THEN city ELSE governorate || ', ' || city END AS place FROM fx_raw"""
    q["export_leads_csv"] = q["export_projection"] = f"SELECT {EXPORT} FROM fx_leads"
    q["write_report_json"] = f"WITH r AS ({_report(7)}) {_report_json(7)}"
    q["write_report_text"] = _report_lines(1)
    q["append_scan_history"] = """SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS started_at, count(*) AS discovered,
        strftime(ts, '%Y-%m-%d %H') AS label FROM events GROUP BY label ORDER BY started_at DESC LIMIT 200"""
    q["delete_leads"] = f"{leads} WHERE lead_id NOT IN (SELECT lead_id FROM fx_leads WHERE confidence_score < 40)"
    q["browse_projection"] = """SELECT company_name AS company, city, email, phone, website, confidence_score AS score,
        confidence_tier AS tier FROM fx_leads"""
    q["osm_to_leads"] = f"SELECT ord, {EXPORT} FROM (SELECT *, 'Cairo' AS city, 'Egypt' AS country FROM osm_leads)"
    q["search_hits_to_leads"] = f"""SELECT search_id, ord, {EXPORT} FROM ({graded2(
        '(' + web_lead("(SELECT * FROM fx_hits WHERE source = 'search')") + ')')})"""
    q["directory_hits_to_leads"] = f"""SELECT search_id, ord, {EXPORT} FROM ({graded2(
        '(' + dir_lead("(SELECT * FROM fx_hits WHERE source = 'directories')") + ')')})"""
    q["finalize_leads"] = f"SELECT ord, {EXPORT} FROM ({finalize('fx_raw', 'l.ord')})"
    q["score_leads"] = "SELECT ord, confidence_score FROM fx_graded"
    q["tier_leads"] = "SELECT ord, confidence_score, confidence_tier FROM fx_graded"
    q["dedup_keys"] = "SELECT ord, dedup_key, lead_id FROM fx_leads"

    q["search_leads"] = f"""{leads} WHERE confidence_score >= 60 AND (lower(industry) = 'machinery' OR lower(category) = 'machinery')
        AND lower(country) = 'asia' AND {_like('source_url', 'biz')} AND ({_like('company_name', 'descr')}
        OR {_like('description', 'descr')} OR {_like('category', 'descr')}) {RANK} LIMIT 50"""
    q["filter_industry"] = f"{leads} WHERE lower(industry) = 'building' OR lower(category) = 'building'"
    q["filter_city"] = f"{leads} WHERE lower(city) = 'nation_3'"
    q["filter_governorate"] = f"{leads} WHERE lower(governorate) = 'gov 4'"
    q["filter_country"] = f"{leads} WHERE lower(country) = 'europe'"
    q["filter_source"] = f"{leads} WHERE {_like('source_url', 'BIZ1_.example')}"
    q["filter_min_score"] = f"{leads} WHERE confidence_score >= 85"
    q["filter_keyword"] = f"""{leads} WHERE {_like('company_name', 'shared NAME 1')} OR {_like('description', 'shared NAME 1')}
        OR {_like('category', 'shared NAME 1')}"""
    q["missing_contact"] = """SELECT ord, company_name, email, phone, CASE WHEN email = '' AND phone = '' THEN 'both'
        WHEN email = '' THEN 'email' ELSE 'phone' END AS missing FROM fx_leads WHERE email = '' OR phone = ''"""
    q["leads_since"] = f"{leads} WHERE discovered_at >= {SINCE[7]}"
    q["business_hosts"] = "SELECT ord, url FROM fx_business"
    q["business_emails"] = f"""SELECT src, id, email FROM addresses WHERE contains(email, '@')
        AND lower(string_split(email, '@')[-1]) NOT IN ({values(FREEMAIL_DOMAINS)})"""
    q["role_emails"] = f"""SELECT src, id, email FROM addresses WHERE contains(email, '@')
        AND trim(lower(split_part(email, '@', 1)), '.') IN ({values(ROLE_MAILBOXES)})"""
    q["valid_emails"] = f"SELECT src, id, email FROM addresses WHERE {sql_valid_email('email')}"
    q["osm_tag_filter"] = "SELECT ord FROM fx_osm WHERE k IN ('healthcare', 'amenity')"
    dist = _DIST.format(a="30.0444", b="lat", c="31.2357", d="lon")
    q["within_radius"] = f"SELECT ord, CAST(round({dist}) AS BIGINT) AS metres FROM fx_osm WHERE {dist} <= 8000"
    q["contact_pages"] = "SELECT page_id, url, pos FROM contact_urls"
    host = DIRECTORY.split("//")[1]
    off = " OR ".join(f"contains({sql_netloc('url')}, {lit(s)})" for s in [host, *DIRECTORY_OFFSITE_FRAGMENTS])
    # anchors per card: the heading link back into the directory, then the website link
    q["directory_outlinks"] = f"""SELECT page, pos, 'Visit' AS name, url FROM (
        SELECT *, CAST(sum(CAST(headed AS INTEGER) + CAST(sited AS INTEGER)) OVER (PARTITION BY page ORDER BY ord) - 1 AS INTEGER) AS pos
        FROM listing_canon) WHERE sited AND NOT ({off})"""

    q["join_batch_to_store"] = "SELECT ord_ AS ord, dedup_key, action FROM up_rows WHERE side = 0"
    q["join_osm_industry"] = "SELECT ord, industry FROM osm_industry"
    q["join_criteria_backfill"] = """SELECT l.search_id, l.ord, CASE WHEN l.city <> '' THEN l.city ELSE s.city END AS city,
        CASE WHEN l.governorate <> '' THEN l.governorate ELSE s.governorate END AS governorate, l.country,
        CASE WHEN l.industry <> '' THEN l.industry ELSE s.industry END AS industry,
        CASE WHEN l.category <> '' THEN l.category ELSE s.query END AS category FROM fx_raw l JOIN fx_searches s USING (search_id)"""
    q["join_site_pages"] = """SELECT l.ord, l.website, l.site_url AS site, coalesce(r.page_rank, 0) AS page_rank,
        coalesce(r.page_id, -1) AS page_id FROM site_leads_c l LEFT JOIN site_ranked r ON r.site = l.site_url"""
    q["geocode_places"] = """SELECT l.ord, lower(l.city) AS place_name, g.lat, g.lon FROM fx_raw l
        JOIN fx_gazetteer g ON lower(g.place) = lower(l.city)"""
    q["join_email_domain_class"] = f"""SELECT src, id, email, CASE WHEN lower(string_split(email, '@')[-1]) IN ({values(FREEMAIL_DOMAINS)})
        THEN 'personal' WHEN lower(string_split(email, '@')[-1]) IN ({values(DISPOSABLE_DOMAINS)}) THEN 'disposable' ELSE 'other' END AS host_class,
        trim(lower(split_part(email, '@', 1)), '.') IN ({values(ROLE_MAILBOXES)}) AS role_mailbox FROM addresses"""
    q["join_social_hosts"] = f"""SELECT ord, host, platform FROM (SELECT ord, {sql_domain('url')} AS host,
        {sql_platform(sql_domain('url'))} AS platform FROM fx_hits) WHERE platform IS NOT NULL"""

    q["count_leads"] = "SELECT count(*) AS total FROM fx_leads"
    q["counts_since"] = _counts(7)
    for name, c in (("industry", "industry"), ("city", "city"), ("country", "country"), ("tier", "confidence_tier")):
        q[f"facet_{name}"] = _facet(c)
    q["facets_all"] = " UNION ALL ".join(
        f"(SELECT '{n}' AS facet, value, n FROM ({_facet(c)}))" for n, c in
        (("industry", "industry"), ("city", "city"), ("country", "country"), ("tier", "confidence_tier")))
    q["facet_source_host"] = f"""SELECT regexp_replace(CASE WHEN contains(source_url, '://') THEN {sql_netloc('source_url')}
        ELSE lower(source_url) END, '^www\\.', '') AS value, count(*) AS n FROM fx_leads WHERE source_url <> ''
        GROUP BY 1 ORDER BY n DESC, value LIMIT 25"""
    q["avg_score"] = "SELECT round(coalesce(avg(confidence_score), 0), 1) AS avg_score FROM fx_leads"
    pairs = (("industry", "industry"), ("city", "city"), ("country", "country"), ("tier", "confidence_tier"))
    q["facet_cardinality"] = "SELECT " + ", ".join(
        [f"count(DISTINCT nullif({c}, '')) AS {n}_values" for n, c in pairs]
        + [f"least(count(DISTINCT nullif({c}, '')), 25) AS {n}_shown" for n, c in pairs]) + " FROM fx_leads"
    q["top_values"] = _tops(7)
    q["upsert_action_counts"] = """SELECT count(*) FILTER (WHERE action = 'inserted') AS inserted,
        count(*) FILTER (WHERE action = 'updated') AS updated, count(*) FILTER (WHERE action = 'unchanged') AS unchanged,
        CAST(0 AS BIGINT) AS failed FROM up_rows WHERE side = 0"""
    q["scan_totals"] = """SELECT coalesce(ord_.s, -1) AS search_id, count(*) AS discovered, CAST(0 AS BIGINT) AS enriched,
        count(*) FILTER (WHERE action = 'inserted') AS inserted, count(*) FILTER (WHERE action = 'updated') AS updated,
        count(*) FILTER (WHERE action = 'unchanged') AS unchanged FROM sc_rows WHERE side = 0 GROUP BY ROLLUP (ord_.s)"""
    q["period_report"] = _report(30)

    q["dedup_candidates"] = f"SELECT ord, {EXPORT} FROM dd_kept"
    merged = ", ".join(f"coalesce(first({c} ORDER BY ord) FILTER (WHERE {c} <> {0 if c == 'confidence_score' else chr(39) * 2}), "
                       f"{0 if c == 'confidence_score' else chr(39) * 2}) AS {c}" for c in EXPORT_COLUMNS)
    q["merge_leads"] = f"""SELECT domain, min(ord) AS ord, {merged} FROM (SELECT *, {sql_domain('website')} AS domain FROM fx_graded)
        WHERE domain <> '' GROUP BY domain"""
    q["osm_name_dedup"] = "SELECT min(ord) AS ord, name FROM fx_osm GROUP BY name ORDER BY ord LIMIT 500"
    q["directory_dedup"] = """SELECT search_id, ord, name, url FROM (SELECT * FROM (SELECT search_id, ord,
        regexp_replace(name, '#[0-9]+', '', 'g') AS name, regexp_replace(raw_url, '(home/.*|[0-9]+$)', '', 'g') AS url FROM fx_hits_raw)
        QUALIFY row_number() OVER (PARTITION BY search_id, lower(name), lower(url) ORDER BY ord) = 1)
        QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY ord) <= 20"""
    q["best_email"] = f"""SELECT src, id, arg_min(email, (CASE {sql_email_kind('email')} WHEN 'business' THEN 0 WHEN 'role' THEN 1 ELSE 2 END, pos)) AS email
        FROM found_emails WHERE {sql_valid_email('email')} GROUP BY src, id"""
    q["best_phones"] = f"""SELECT src, id, e164, pos FROM (
        SELECT src, id, e164, row_number() OVER (PARTITION BY src, id ORDER BY CASE WHEN {MOBILE} THEN 0 ELSE 1 END, min(pos)) - 1 AS pos
        FROM numbers WHERE e164 <> '' GROUP BY src, id, e164) WHERE pos < 5"""
    q["first_social"] = "SELECT host, " + ", ".join(
        f"coalesce(first(url ORDER BY page_id, pos) FILTER (WHERE platform = '{p}'), '') AS {p}_url"
        for p in ("linkedin", "facebook", "instagram")) + " FROM social_links GROUP BY host"
    q["cap_pages_per_site"] = """SELECT host, page_id, url, rank FROM (SELECT *, row_number() OVER (PARTITION BY host
        ORDER BY page_id, pos) AS rank FROM contact_urls) WHERE rank <= 4 AND url <> base"""

    q["rank_leads"] = f"{leads} {RANK} LIMIT 100"
    q["topk_new"] = f"{leads} WHERE discovered_at >= {SINCE[1]} {RANK} LIMIT 10"
    q["topk_missing"] = f"{leads} WHERE email = '' AND phone = '' {RANK} LIMIT 10"
    q["cap_candidates"] = """SELECT search_id, ord, company_name FROM fx_raw
        QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY ord) <= 20"""
    q["cap_per_source"] = """SELECT search_id, source, ord FROM (SELECT h.search_id, h.source, h.ord, s.lim FROM fx_hits_raw h
        JOIN fx_searches s USING (search_id)) QUALIFY row_number() OVER (PARTITION BY search_id, source ORDER BY ord) <= coalesce(lim, 1000000000)"""

    q["union_sources"] = f"SELECT search_id, (ord // 1000000000000) || '.' || (ord % 1000000000000) AS ord, source, {EXPORT} FROM all_found"
    place = f"(ord // 10 * {PAGE_STEP}) || '.' || (ord % 10)"
    q["ordered_distinct_urls"] = f"""SELECT search_id, {place} AS ord, url FROM (SELECT b.search_id, b.url, min(b.ord) AS ord, min(b.ord) AS first_ord, any_value(s.lim) AS lim
        FROM fx_business b JOIN fx_searches s USING (search_id) GROUP BY b.search_id, b.url)
        QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY first_ord) <= coalesce(lim, 1000000000)"""
    junk = " OR ".join(f"contains({sql_netloc('url')}, {lit(j)})" for j in JUNK_HOST_FRAGMENTS)
    q["source_cascade"] = f"""WITH given AS (SELECT * FROM (SELECT h.search_id, h.engine, h.url, s.lim, min(h.ord) AS ord FROM fx_hits h
          JOIN fx_searches s USING (search_id) GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY search_id, engine ORDER BY ord) <= coalesce(lim, 1000000000)),
        sizes AS (SELECT search_id, any_value(lim) AS lim, count(DISTINCT url) FILTER (WHERE engine = 0) AS n1,
          count(DISTINCT url) FILTER (WHERE engine <= 1) AS n12 FROM given GROUP BY search_id),
        used AS (SELECT g.search_id, g.lim, g.url, min((g.engine, g.ord)) AS o FROM given g JOIN sizes z USING (search_id)
          WHERE g.engine = 0 OR (g.engine = 1 AND z.n1 < z.lim // 2)
             OR (g.engine = 2 AND (CASE WHEN z.n1 < z.lim // 2 THEN z.n12 ELSE z.n1 END) < z.lim // 4) GROUP BY ALL)
        SELECT search_id, engine || '.' || {place} AS ord, url FROM (SELECT search_id, lim, url, o[1] AS engine, o[2] AS ord, o[2] AS used_ord FROM used) WHERE NOT ({junk})
        QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY (engine, used_ord)) <= coalesce(lim, 1000000000)"""

    q["clean_text_table"] = f"SELECT doc_id, {sql_clean('text')} AS text FROM documents"
    urls = "(SELECT 'page' AS src, page_id AS id, url AS raw FROM pages UNION ALL SELECT 'lead', ord, website FROM fx_raw)"
    q["canonical_urls"] = f"SELECT src, id, canonical FROM ({canon(urls, 'raw', 'canonical')})"
    q["domains"] = f"SELECT src, id, {sql_domain('raw')} AS domain FROM {urls}"
    q["extract_emails"] = "SELECT src, id, pos, email FROM found_emails"
    q["classify_emails"] = f"""SELECT src, {sql_email_kind('email')} AS kind, count(*) AS n, count(DISTINCT email) AS addresses
        FROM addresses GROUP BY 1, 2"""
    q["extract_phones"] = "SELECT src, id, pos, phone FROM found_phones"
    q["normalize_phones"] = "SELECT src, id, pos, phone, e164 FROM numbers"
    q["format_phones_intl"] = r"""SELECT src, id, e164, CASE
        WHEN regexp_matches(e164, '^\+1\d{10}$') THEN regexp_replace(e164, '^\+1(\d{3})(\d{3})(\d{4})$', '+1 \1-\2-\3')
        WHEN regexp_matches(e164, '^\+201\d{9}$') THEN regexp_replace(e164, '^\+20(\d{3})(\d{3})(\d{4})$', '+20 \1 \2 \3')
        WHEN regexp_matches(e164, '^\+20[89]00\d{7}$') THEN regexp_replace(e164, '^\+20(\d{3})(\d{3})(\d{4})$', '+20 \1 \2 \3')
        WHEN regexp_matches(e164, '^\+20[23]') THEN regexp_replace(e164, '^\+20(\d)(\d+)$', '+20 \1 \2')
        WHEN regexp_matches(e164, '^\+20') THEN regexp_replace(e164, '^\+20(\d\d)(\d{7})$', '+20 \1 \2')
        ELSE regexp_replace(e164, '^\+(' || ?codes || ')(\d+)$', '+\1 \2') END AS shown FROM numbers WHERE e164 <> ''""".replace("?codes", lit("|".join(p.code for p in PLANS if p.region not in ("EG", "US"))))
    q["extract_social_links"] = "SELECT page_id, platform, url, pos FROM social_links"
    q["classify_industry"] = (f"WITH {industry_cte('guess', 'documents', 'doc_id', 'text')} "
                              "SELECT d.doc_id, coalesce(g.industry, '') AS industry FROM documents d LEFT JOIN guess g USING (doc_id)")
    q["pages_to_text"] = "SELECT page_id, text FROM page_texts"
    q["extract_company_name"] = f"SELECT page_id, {sql_name('html', 'host')} AS company_name FROM fx_site_pages"
    q["extract_description"] = f"SELECT page_id, {sql_description('html', 'text')} AS description FROM page_texts"
    q["extract_address"] = f"SELECT page_id, {sql_address('html', 'text')} AS address FROM page_texts"
    q["extract_whatsapp"] = f"SELECT page_id, {sql_whatsapp('html')} AS whatsapp FROM fx_site_pages"
    q["extract_employees"] = f"SELECT page_id, {sql_employees('text')} AS employees FROM page_texts"
    q["extract_contact_person"] = f"SELECT page_id, {sql_person('text')} AS contact_person FROM page_texts"
    q["unwrap_result_links"] = """SELECT page, engine, url, row_number() OVER (PARTITION BY page ORDER BY min(p)) AS rank
        FROM result_canon WHERE url <> '' GROUP BY page, engine, url"""
    q["directory_cards"] = "SELECT page, card AS pos, name, url FROM listing_canon WHERE sited AND url <> ''"
    q["enrich_sites"] = f"""SELECT ord, enriched, {", ".join(
        {"confidence_score": "CASE WHEN enriched THEN confidence_score ELSE old_score END AS confidence_score",
         "confidence_tier": "CASE WHEN enriched THEN confidence_tier ELSE old_tier END AS confidence_tier"}.get(c, c)
        for c in EXPORT_COLUMNS)} FROM enr_graded"""
    q["upsert_leads"] = f"SELECT {SHOWN} FROM up_snap"
    q["stream_upsert"] = f"SELECT {SHOWN} FROM tk_snap"
    after = f"WITH r AS ({_report(1)}) {_report_json(1)}".replace("Weekly", "Daily").replace("fx_leads", "rt_snap")
    q["stream_tick_report"] = after.replace(f"TIMESTAMP '{AS_OF}'", f"TIMESTAMP '{BATCH_NOW}'")
    return {k: _merge_with(v) for k, v in q.items()}


def _merge_with(text: str) -> str:
    """Put the shared relations in front of a query that may bring WITH items of its own."""
    if text.startswith("WITH "):
        head = with_ctes(text)
        shared = head[:-len(text)].rstrip()
        return f"{shared},\n{text[5:]}" if shared else text
    return with_ctes(text)

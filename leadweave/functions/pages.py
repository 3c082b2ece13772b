"""Field extraction from page HTML and page text."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from ..fixed_values import (ABOUT_STEMS, ADDRESS_WORDS, BOILERPLATE_STARTS, CONTACT_STEMS,
                            EMPLOYEES_OVER_PATTERN, EMPLOYEES_PATTERN, HTTP_LINK_PATTERN,
                            NON_PAGE_HREFS, PERSON_LABELS,
                            PERSON_NAME_PATTERN, SOCIAL_HOSTS, TITLE_SEPARATORS,
                            WHATSAPP_PATTERN)
from .phones import normalize_phone
from .text import (any_of, bind, clean_text, collapse, decode_entities, first_filled, strip,
                   strip_tags, title_case, visible_markup)
from .urls import canonical_url, domain, netloc, social_platform

_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
# Tags end before the next one begins, and an element before the next of its kind: a pattern that fails at one place has not
# read on to the end of the page. Possessive loops need no stack.
_VOID = "(?!(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\\b)"


def _element(tag: str) -> str:
    return rf"<{tag}\b[^<>]*>([^<]*+(?:<(?!/?{tag}\b)[^<]*+)*+)</{tag}"


def opening_pattern(opening: str) -> str:
    """Pattern of an opening tag, whose name is its first group, of an element that can have content."""
    return f"(?is)<{_VOID}{opening[1:]}"


def enclosed(html: Column, opening: Column) -> Column:
    """Content of the first element whose opening tag matches, '' if there is none; elements of its name inside it belong to it.

    From that tag on the text is split at the tags of its name, once, and the element ends where as many have been closed as
    opened; a paragraph also where the next begins. Empty elements such as <img> are none, nor is one that is never closed.
    """
    def balanced(rest: Column) -> Column:
        name = F.lower(F.regexp_extract(rest, "^<([a-zA-Z0-9]+)", 1))

        def walk(tags: Column, paragraph: Column) -> Column:
            # depth behind the tags so far; the tags up to the one that brings it back to 0
            start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))

            def step(s: Column, tag: Column) -> Column:
                depth = s["depth"] + F.when(tag.startswith("</") | (paragraph & (s["n"] > 0)), -1).otherwise(1)
                return F.when((s["depth"] == 0) & (s["n"] > 0), s).otherwise(F.struct(depth.alias("depth"), (s["n"] + 1).alias("n")))

            inner = lambda s: F.when(s["depth"] == 0, F.regexp_replace(
                F.array_join(F.slice(tags, F.lit(1), s["n"] - 1), ""), "^<[^<>]*>", "")).otherwise("")
            return bind(F.aggregate(tags, start, step), inner)

        split = lambda name: bind(F.split(rest, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s/>])"))), lambda tags: walk(tags, name == "p"))
        return bind(name, split)

    at = F.regexp_instr(html, opening)
    return bind(at, lambda at: F.when(at > 0, bind(F.substring(html, at, F.length(html)), balanced)).otherwise(""))


def attribute(tag: Column, name: str) -> Column:
    """Decoded attribute value of one tag, '' if absent."""
    raw = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{_VALUE}", 1)
    return decode_entities(F.regexp_replace(raw, r"""^["']|["']$""", ""))


def anchor_hrefs(html: Column) -> Column:
    """href values of all anchors, in order."""
    raw = F.regexp_extract_all(html, F.lit(rf"(?is)<a\b[^<>]*?\shref\s*=\s*{_VALUE}"), F.lit(1))
    return F.transform(raw, lambda h: strip(decode_entities(
        F.regexp_replace(h, r"""^["']|["']$""", ""))))


def anchors(html: Column) -> Column:
    """Whole anchor elements, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is){_element('a')}\s*>"), F.lit(0))


def element_text(html: Column, by: str = "") -> Column:
    return clean_text(decode_entities(strip_tags(html, by)))


def meta_tags(html: Column) -> Column:
    """All <meta> tags, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^<>]*>"), F.lit(0))


def meta_content(metas: Column, key: str, value: str) -> Column:
    """content of the first of some <meta> tags whose ``key`` attribute equals ``value``."""
    wanted = F.filter(metas, lambda m: m.rlike(
        rf"""(?s)(?i:\s{key}\s*=\s*)(?:"{any_of([value])}"|'{any_of([value])}'|{any_of([value])}(?=[\s/>]))"""))
    return attribute(F.coalesce(F.get(wanted, F.lit(0)), F.lit("")), "content")


def company_name(home: Column, base: Column, metas: Column | None = None) -> Column:
    """Site name: og:site_name, else title up to a separator, else h1, else the domain label. ``metas`` are the page's <meta> tags if known."""
    site_name = meta_content(meta_tags(home) if metas is None else metas, "property", "og:site_name")
    title = clean_text(decode_entities(F.regexp_extract(home, f"(?is){_element('title')}", 1)))
    for sep in TITLE_SEPARATORS:
        title = F.trim(F.substring_index(title, sep, 1))
    heading = element_text(F.regexp_extract(home, f"(?is){_element('h1')}", 1))
    label = title_case(F.substring_index(F.replace(netloc(base), F.lit("www."), F.lit("")), ".", 1))
    plain = F.coalesce(
        bind(F.substring(title, 1, 120), lambda t: F.when(t != "", t)),
        F.when(home.rlike(r"(?i)<h1\b"), F.substring(heading, 1, 120)),
        label)
    return bind(site_name, lambda s: F.when(s != "", clean_text(s)).otherwise(plain))


def meta_description(html: Column, metas: Column | None = None) -> Column:
    """Meta description of 30+ characters, at most 500; '' if there is none. ``metas`` are the page's <meta> tags if known."""
    def first_long(metas: Column) -> Column:
        return F.coalesce(*[bind(clean_text(meta_content(metas, *of)), lambda c: F.when(F.length(c) >= 30, F.substring(c, 1, 500)))
                            for of in (("name", "description"), ("property", "og:description"))], F.lit(""))

    return bind(meta_tags(html) if metas is None else metas, first_long)


def first_sentence(text: Column) -> Column:
    """First long sentence that is no boilerplate, at most 500 characters; '' if there is none."""
    chunks = F.transform(F.split(text, r"\. "), lambda c: collapse(c))
    sentence = F.get(F.filter(chunks, lambda c: (F.length(c) >= 60) & ~c.rlike(
        rf"(?i)^(?:{any_of(BOILERPLATE_STARTS)})")), F.lit(0))
    return F.coalesce(F.substring(sentence, 1, 500), F.lit(""))


def description(home: Column, text: Column) -> Column:
    """Meta description of 30+ characters, else the first long sentence; at most 500."""
    return first_filled(meta_description(home), first_sentence(text))


#: a word without which there is no such node, and its opening tag
_ADDRESS_NODES = [
    ("postaladdress", r"<([a-z0-9]+)\b[^<>]*\sitemtype\s*=\s*[\"'][^\"']*PostalAddress[^<>]*>"),
    ("localbusiness", r"<([a-z0-9]+)\b[^<>]*\sitemtype\s*=\s*[\"'][^\"']*LocalBusiness[^<>]*>"),
    ("<address", r"<(address)\b[^<>]*>"),
    ("address", r"<([a-z0-9]+)\b[^<>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?address(?:\s[^\"']*)?[\"'][^<>]*>"),
    ("address", r"<([a-z0-9]+)\b[^<>]*\sid\s*=\s*[\"']address[\"'][^<>]*>"),
]


_ADDRESS_TABLE = json.dumps([{"word": w, "opening": opening_pattern(o)} for w, o in _ADDRESS_NODES])


def _mentions(text: Column, *words: str) -> Column:
    """Whether one of some lower-case words is in the text in any case: a search for literals, before a pattern that can't match without them."""
    def any_word(lower: Column) -> Column:
        out = F.contains(lower, F.lit(words[0]))
        for word in words[1:]:
            out = out | F.contains(lower, F.lit(word))
        return out

    return bind(F.lower(text), any_word)


def address_node(html: Column) -> Column:
    """Text of the first address node, '' if there is none; what is hidden, comments and scripts, has no part."""
    table = F.from_json(F.lit(_ADDRESS_TABLE), "array<struct<word:string,opening:string>>")

    def found(seen: Column) -> Column:
        present = F.filter(table, lambda n: F.contains(F.lower(seen), n["word"]))
        texts = F.transform(present, lambda n: element_text(enclosed(seen, n["opening"]), " "))
        return F.coalesce(F.get(F.filter(texts, lambda t: F.length(t).between(1, 299)), F.lit(0)), F.lit(""))

    return F.when(_mentions(html, "address", "localbusiness"), bind(visible_markup(html), found)).otherwise("")


def address_line(text: Column) -> Column:
    """First text line with an address word, '' if there is none."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(s).between(15, 200) & F.lower(
        s).rlike(any_of(ADDRESS_WORDS)))
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def address(html: Column, text: Column) -> Column:
    """Text of the first address node, else a text line with an address word."""
    return first_filled(address_node(html), address_line(text))


def whatsapp(html: Column) -> Column:
    """Number of the first click-to-chat link; E.164 where a plan knows it."""
    link = F.regexp_extract(html, WHATSAPP_PATTERN, 0)
    digits = F.when(_mentions(html, "wa.me/", "whatsapp.com"), F.regexp_extract(link, r"(\d+)$", 1)).otherwise("")

    def form(d: Column) -> Column:
        plus = F.concat(F.lit("+"), d)
        return F.when(F.length(d) >= 8, first_filled(normalize_phone(plus), plus)).otherwise("")

    return bind(digits, form)


def employees(text: Column) -> Column:
    count = F.regexp_extract(text, EMPLOYEES_PATTERN, 1).try_cast("int")
    over = F.regexp_extract(text, EMPLOYEES_OVER_PATTERN, 1)
    found = (F.when(count < 10000, F.concat(count.cast("string"), F.lit(" employees")))
             .when(over != "", F.concat(over, F.lit("+ employees"))).otherwise(""))
    # the patterns take a long s for an s
    named = _mentions(text, "employee", "staff", "worker", "people", "professional") | F.contains(text, F.lit("\u017f"))
    return F.when(named, found).otherwise("")


def ranked_contact_person(text: Column) -> Column:
    """(rank, name): the first known label that a name stands behind, by label order; NULL if there is none."""
    found = F.array(*[F.struct(F.lit(i).alias("rank"), F.when(F.contains(text, F.lit(label)), F.trim(F.regexp_extract(
        text, rf"{label}(?U:\s*[:\-]\s*){PERSON_NAME_PATTERN}", 1))).otherwise("").alias("name")) for i, label in enumerate(PERSON_LABELS)])
    return F.get(F.filter(found, lambda x: x["name"] != ""), F.lit(0))


def contact_person(text: Column) -> Column:
    """Name behind the first of the known labels (label order, not text order)."""
    return F.coalesce(ranked_contact_person(text)["name"], F.lit(""))


def contact_hrefs(html: Column) -> Column:
    """Link targets of a page that look like contact or about pages, in order."""
    return F.filter(anchor_hrefs(html), lambda h: (h != "") & ~h.rlike(rf"^(?:{any_of(NON_PAGE_HREFS)})")
                    & F.lower(h).rlike(any_of(CONTACT_STEMS + ABOUT_STEMS)))


_SOCIAL_TOKEN = "(?i)" + any_of([h for hosts in SOCIAL_HOSTS.values() for h in hosts])


def http_links(html: Column) -> Column:
    """Link-like strings that can lead to a social platform, in order."""
    links = F.regexp_extract_all(html, F.lit(HTTP_LINK_PATTERN), F.lit(0))
    return F.filter(links, lambda u: u.rlike(_SOCIAL_TOKEN))


def social_links(html: Column) -> Column:
    """Canonical links to social platforms as (platform, url), in order."""
    urls = F.transform(http_links(html), lambda u: canonical_url(u))
    marked = F.transform(urls, lambda u: F.struct(
        social_platform(domain(u)).alias("platform"), u.alias("url")))
    return F.filter(marked, lambda m: m["platform"].isNotNull())


def first_social(links: Column, platform: str) -> Column:
    """First link of a platform among (platform, url) links, '' if none."""
    ours = F.filter(links, lambda m: m["platform"] == platform)
    return F.coalesce(F.get(ours, F.lit(0))["url"], F.lit(""))

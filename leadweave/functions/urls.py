"""URL canonicalisation, hosts and host classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import JUNK_HOST_FRAGMENTS, SOCIAL_HOSTS, TRACKING_PARAMS
from .text import any_of, apply, clean_text

SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*://"
SCHEMELESS = r"(?s)^(?!.*://)(?=.)"
NETLOC = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
DEFAULT_BASE = "https://example.com"
# scheme, a host with a dot and without brackets
WELL_FORMED = r"^[^:/?#]+://[^/?#\[\]]*\.[^/?#\[\]]*(?:[/?#]|$)"


# SQL templates: ?u stands for cleaned text, ?base for the URL rooted references belong to
_PATH_OF_REFERENCE = r"regexp_extract(?u, r'^[^?#]*', 0)"
_DOTS_RESOLVED = r"""concat(
    array_join(aggregate(split(?path, '/'), cast(array() as array<string>),
        (kept, s) -> case when s = '..' then slice(kept, 1, greatest(size(kept) - 1, 0))
                          when s = '.' then kept else array_append(kept, s) end), '/'),
    if(?path rlike r'/\.{1,2}$', '/', ''), regexp_extract(?u, r'^[^?#]*(.*)$', 1))"""
_ABSOLUTE = r"""case when ?u = '' then '' when startswith(?u, '//') then concat('https:', ?u)
    when startswith(?u, '/') then concat(regexp_extract(?base, r'^([^:/?#]+://[^/?#]*)', 1),
        if(?path rlike r'/\.{1,2}(?:/|$)', ?resolved, ?u))
    when ?u rlike r'^?scheme' then ?u when ?u rlike r'^[^/]*@| ' then ''
    else concat('https://', ?u) end"""
# ?a stands for an absolute URL or ''
_ASSEMBLED = r"""if(?a rlike r'?form', concat(
    regexp_replace(lower(regexp_extract(?a, r'^[^:/?#]+://[^/?#]*', 0)), r'^([^:]+://)www\.', '$1'),
    regexp_replace(regexp_replace(regexp_extract(?a, r'^[^:/?#]+://[^/?#]*([^?#]*)', 1), r';[^/]*$', ''), r'/+$', ''),
    regexp_replace(regexp_replace(regexp_replace(
        concat('&', regexp_extract(?a, r'^[^?#]*\?([^#]*)', 1)),
        r'(?i)&(?:?tracking)(?:=[^&]*)?(?=&|$)', ''), r'^&', '?'), r'^\?$', '')), '')"""


def _absolute(u: str, base: str) -> str:
    text = _ABSOLUTE.replace("?resolved", _DOTS_RESOLVED).replace("?path", _PATH_OF_REFERENCE)
    return text.replace("?scheme", SCHEME).replace("?base", base).replace("?u", u)


def _assembled(a: str) -> str:
    text = _ASSEMBLED.replace("?form", WELL_FORMED).replace("?tracking", any_of(TRACKING_PARAMS))
    return text.replace("?a", a)


def canonical_url(url: Column, base: str = DEFAULT_BASE, base_column: str | None = None) -> Column:
    """Canonical form as one expression; use ``with_canonical_url`` on whole tables.

    Relative forms are completed from ``base``, or from a column of the row.
    """
    return apply(apply(clean_text(url), _absolute("x", base_column or f"'{base}'")), _assembled("x"))


def with_canonical_url(df: DataFrame, source: str, target: str,
                       base: Column | str = DEFAULT_BASE) -> DataFrame:
    """Canonical form in steps, so that each one runs once and stays in generated code."""
    base = F.lit(base) if isinstance(base, str) else base
    return (df.withColumns({"_u": clean_text(F.col(source)), "_base": base})
            .withColumn("_u", F.expr(_absolute("_u", "_base")))
            .withColumn(target, F.expr(_assembled("_u")))
            .drop("_u", "_base"))


def netloc(url: Column) -> Column:
    """Lower-case network location; '' where the text has no '//' part."""
    return F.lower(F.regexp_extract(url, NETLOC, 1))


def domain_sql(column: str) -> str:
    """SQL text of ``domain`` for a column given by name."""
    return (rf"regexp_replace(lower(regexp_extract(regexp_replace(coalesce({column}, ''), "
            rf"r'{SCHEMELESS}', 'https://'), r'{NETLOC}', 1)), r'^www\.', '')")


def domain(url: Column) -> Column:
    """Host (port and user info kept) without 'www.'; NULL and '' give ''."""
    with_scheme = F.regexp_replace(F.coalesce(url, F.lit("")), SCHEMELESS, "https://")
    return F.regexp_replace(netloc(with_scheme), r"^www\.", "")


def is_business_host(url: Column) -> Column:
    host = netloc(url)
    return (host != "") & ~host.rlike(any_of(JUNK_HOST_FRAGMENTS))


def social_platform(host: Column) -> Column:
    """Platform whose host equals the given one or is a parent of it; NULL if none."""
    out = None
    for platform, hosts in SOCIAL_HOSTS.items():
        hit = host.rlike(rf"(?:^|\.)(?:{any_of(hosts)})$")
        out = F.when(hit, F.lit(platform)) if out is None else out.when(hit, F.lit(platform))
    return out

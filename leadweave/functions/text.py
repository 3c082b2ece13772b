"""Text cleaning and HTML-to-text, as Catalyst expressions."""

from __future__ import annotations

import html.entities
from collections.abc import Callable

from pyspark.sql import Column, functions as F

NON_ASCII = r"[^\x00-\x7F]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: runs of white space but for a single blank, which stays as it is
SPACES = r"(?U)\s(?:(?<! )\s*|\s+)"
#: control characters and direction marks
UNSEEN = CONTROL[:-1] + r"\u200e\u200f]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; for use inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfkc(c: Column) -> Column:
    """Unicode NFKC. The ICU class ships with Spark; ASCII text never reaches it."""
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"),
                               F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike(NON_ASCII), composed).otherwise(c)


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def clean_text(c: Column) -> Column:
    """NFKC, no control or direction marks, single spaces, trimmed; NULL becomes ''."""
    return collapse(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), UNSEEN, ""))


def filled(c: Column) -> Column:
    """NULL for '' so that coalesce() means "first non-empty"."""
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cols], F.lit(""))


def apply(c: Column, body: str) -> Column:
    """Evaluate ``c`` once and run a SQL expression over it as ``x``.

    One parsed string instead of dozens of Column objects, which keeps plan building fast.
    """
    return F.get(F.call_function("transform", F.array(c), F.expr(f"x -> {body}")), F.lit(0))


def constant_map(pairs: dict[str, str]) -> Column:
    """A fixed string map as one foldable expression (a literal per entry would be slow to build)."""
    return F.str_to_map(F.lit(_joined(pairs)), F.lit("\x02"), F.lit("\x01"))


def _joined(pairs: dict[str, str]) -> str:
    return "\x02".join(f"{k}\x01{v}" for k, v in pairs.items())


_NAMES = _joined({n: chr(p) for n, p in html.entities.name2codepoint.items()} | {"apos": "'"})
_NUMBER = r"""case when ref rlike r'^#[0-9]{1,7}$' then try_cast(substr(ref, 2) as bigint)
    when ref rlike r'^#[xX][0-9a-fA-F]{1,6}$' then try_cast(conv(substr(ref, 3), 16, 10) as bigint) end"""
_CHARACTER = f"""transform(array({_NUMBER}), n -> case when n is null then null
    when n > 0 and n < 1114112 and not n between 55296 and 57343
    then decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') else '\ufffd' end)[0]"""
_NAMED = "try_element_at(str_to_map('" + _NAMES.replace("'", "\\'") + "', '\x02', '\x01'), ref)"
_DECODE = f"""if(contains(x, '&'), array_join(transform(split(x, '&'), (s, i) -> if(i = 0, s,
    transform(array(regexp_extract(s, r'^(#?[0-9a-zA-Z]+);', 1)), ref -> coalesce(
        concat(coalesce({_CHARACTER}, {_NAMED}), substr(s, length(ref) + 2)), concat('&', s)))[0])), ''), x)"""


def decode_entities(c: Column) -> Column:
    """Named and numeric character references, each decoded once."""
    return apply(c, _DECODE)


def strip_tags(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, r"<[a-zA-Z/!?][^>]*+(?:>|\z)", by)


#: a comment, or a script, style or noscript element; possessive runs reach its end, or that of the text, without a step back
_HIDDEN = (r"(?is)<(?:!--[^-]*+(?:-(?!->)[^-]*+)*+(?:-->|\z)"
           r"|(script|style|noscript)\b[^<]*+(?:<(?!/\1\s*>)[^<]*+)*+(?:</\1\s*>|\z))")


def visible_markup(c: Column) -> Column:
    """HTML without comments, scripts and styles, in one pass.

    What begins first hides what is in it; what is never closed goes on to the end of the text.
    """
    return F.regexp_replace(c, _HIDDEN, " ")


def html_to_text(c: Column) -> Column:
    return clean_text(decode_entities(strip_tags(visible_markup(c))))


def any_of(words: list[str]) -> str:
    """A regular expression that matches any of the given literal words."""
    special = set(r".^$*+?()[]{}|\-")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in w) for w in words)


def title_case(c: Column) -> Column:
    """Capitalise every run of letters."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")

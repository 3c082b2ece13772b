"""Industry from keyword counts."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from ..fixed_values import INDUSTRY_KEYWORDS
from .text import any_of, bind

_NAMES = list(INDUSTRY_KEYWORDS)
_WORDS = sorted({w for words in INDUSTRY_KEYWORDS.values() for w in words})


def _any_sign(signs) -> str:
    return "[" + "".join("\\" + c if c in "-]^\\" else c for c in sorted(set(signs))) + "]"


def _branches(words: list[str], signs: list[str]) -> str:
    """Alternatives by first sign, halved by look-ahead until two are left: a sign that begins no word is refused in a few tests."""
    if len(signs) <= 2:
        return "|".join(any_of([c]) + _trie([w[1:] for w in words if w[:1] == c]) for c in signs)
    half = len(signs) // 2
    return "|".join(f"(?={_any_sign(part)})(?:{_branches(words, part)})" for part in (signs[:half], signs[half:]))


def _trie(words: list[str]) -> str:
    """A pattern of the longest of the words that begins at a place; words with one beginning share its test."""
    signs = sorted({w[0] for w in words if w})
    if len(signs) > 1 or "" in words:
        return f"(?:{_branches(words, signs)}){'?' if '' in words else ''}" if signs else ""
    return _branches(words, signs)


#: at every place the longest keyword that begins there: the look-ahead takes no sign, so none hides another
_LONGEST = f"(?={''.join(_any_sign(w[k] for w in _WORDS) for k in range(min(map(len, _WORDS))))})(?=({_trie(_WORDS)}))"
#: industry -> how often its list holds a word that the matched one begins with (itself included)
_COUNTS = json.dumps({w: [sum(w.startswith(x) for x in words) for words in INDUSTRY_KEYWORDS.values()] for w in _WORDS})
#: a word whose end is its beginning, twice with that part shared: only then are there fewer occurrences than places
_SHARED = any_of([w + w[k:] for w in _WORDS for k in range(1, len(w)) if w.endswith(w[:k])])
_TABLE = json.dumps([list(words) for words in INDUSTRY_KEYWORDS.values()])


def _by_places(low: Column) -> Column:
    """Hits of each industry from one pass over the text."""
    counts = F.from_json(F.lit(_COUNTS), "map<string,array<int>>")
    hits = F.regexp_extract_all(low, F.lit(_LONGEST), F.lit(1))
    none = F.array(*[F.lit(0)] * len(_NAMES))
    return F.aggregate(hits, none, lambda total, w: F.zip_with(total, F.element_at(counts, w), lambda a, b: a + b))


def _by_words(low: Column) -> Column:
    """Hits of each industry word by word, occurrences that overlap counted once."""
    words = F.from_json(F.lit(_TABLE), "array<array<string>>")
    size = F.octet_length(low)
    count = lambda w: ((size - F.octet_length(F.replace(low, w, F.lit("")))) / F.octet_length(w)).cast("int")
    return F.transform(words, lambda ws: F.aggregate(ws, F.lit(0), lambda total, w: total + count(w)))


def guess_industry(text: Column) -> Column:
    """Industry with the most keyword hits (earlier one on a tie), '' without any hit.

    Row-local, one pass over the text: there is no join with the keywords and the text is not shuffled.
    """
    def best(hits: Column) -> Column:
        at = F.array_position(hits, F.array_max(hits)).cast("int")
        return F.when(F.array_max(hits) > 0, F.element_at(F.array(*[F.lit(n) for n in _NAMES]), at)).otherwise("")

    def score(low: Column) -> Column:
        return F.when(low.rlike(_SHARED), _by_words(low)).otherwise(_by_places(low))

    return bind(bind(F.lower(F.coalesce(text, F.lit(""))), score), best)

"""Sources by name. A new source is one more function in the registry."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import SOURCES
from ..operators.topk import behind
from ..schema import LEAD_SCHEMA
from .directories import directory_candidates, directory_cards
from .osm import osm_candidates
from .web import search_candidates, source_cascade, unwrap_result_links

#: engines and directories in the order in which they are asked
ENGINES = ["duckduckgo", "google", "bing"]
DIRECTORIES = ["yellowpages", "hotfrog"]


def _asked(order: list[str], name: str) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.col(name)).cast("int") - 1


def _place(*columns: str) -> Column:
    return F.array(*[F.col(c).cast("bigint") for c in columns])


def result_page_hits(searches: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits (search_id, ord, url) of stored result pages (search_id, page, engine, html).

    Pages have ids of their own that rise with their place; the engines are asked in turn, as far as a search still wants URLs.
    ``ord`` is (engine, page, rank).
    """
    of = pages.select("page", "search_id").distinct()
    links = unwrap_result_links(pages.select("page", "engine", "html")).join(of, "page")
    return source_cascade(links.select("search_id", _asked(ENGINES, "engine").alias("engine"),
                                       _place("page", "rank").alias("ord"), "url"), searches).drop("engine")


def listing_page_hits(pages: DataFrame) -> DataFrame:
    """Hits (search_id, ord, name, url) of stored listing pages (search_id, page, directory, html); ``ord`` is (directory, page, position)."""
    of = pages.select("page", "search_id", _asked(DIRECTORIES, "directory").alias("_d")).distinct()
    return directory_cards(pages.select("page", "html")).join(of, "page").select(
        "search_id", _place("_d", "page", "pos").alias("ord"), "name", "url")


def _search(searches: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    hits = inputs["search_hits"] if "search_hits" in inputs else result_page_hits(searches, inputs["result_pages"])
    return search_candidates(searches, hits)


def _directories(searches: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    hits = inputs["directory_hits"] if "directory_hits" in inputs else listing_page_hits(inputs["listing_pages"])
    return directory_candidates(searches, hits)


#: name -> function(searches, inputs) giving search_id, ord and the lead columns; web and directory hits come ready or as stored pages
Source = Callable[[DataFrame, Mapping[str, DataFrame]], DataFrame]
REGISTRY: dict[str, Source] = {
    "openstreetmap": lambda s, t: osm_candidates(s, t["elements"], t["gazetteer"]),
    "search": _search,
    "directories": _directories,
}


def union_sources(searches: DataFrame, inputs: Mapping[str, DataFrame],
                  enabled: list[str] | None = None) -> DataFrame:
    """Candidates of all searches from all sources they ask for, in source priority order.

    ``ord`` is an array: the source's priority, then the place in the source, of one number or of several.
    """
    order = [*SOURCES, *[n for n in REGISTRY if n not in SOURCES]]
    out = None
    for prio, name in enumerate(order):
        if enabled is not None and name not in enabled:
            continue
        asking = searches.filter(F.array_contains("sources", name))
        rows = REGISTRY[name](asking, inputs)
        found = rows.select(
            "search_id", behind(rows, F.lit(prio)).alias("ord"), F.lit(name).alias("source"), *LEAD_SCHEMA.fieldNames())
        out = found if out is None else out.unionByName(found)
    return out

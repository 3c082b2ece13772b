"""Map elements: reading, selection by tag and distance, projection to leads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..fixed_values import (DEFAULT_COUNTRY, MAPS_LINK_PREFIX, OSM_ADDRESS_TAGS,
                            OSM_CATEGORY_TAGS, OSM_DEFAULT_RADIUS_M, OSM_DEFAULT_TAGS,
                            OSM_DESCRIPTION_TAGS, OSM_INDUSTRY_TAGS, OSM_KEYWORD_TAGS,
                            OSM_SOURCE_URL, OSM_VALUE_INDUSTRY)
from ..functions.industry import guess_industry
from ..functions.phones import normalize_phone
from ..functions.text import clean_text, constant_map, filled, first_filled, strip
from ..functions.urls import canonical_url
from ..operators.scoring import grade_leads
from ..operators.topk import capped
from ..schema import ELEMENTS_DOCUMENT_SCHEMA, conform
from ..session import materialize
from .documents import read_json

EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180


def tag(name: str) -> Column:
    return F.coalesce(F.col("tags")[name], F.lit(""))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of stored map responses, in document order: a document per line, or per file over several lines.

    A response without an id gets one from its file.
    """
    docs = read_json(spark, path, ELEMENTS_DOCUMENT_SCHEMA)
    docs = docs.withColumn("response_id", F.coalesce("response_id", F.xxhash64("_file")))
    return docs.select("response_id", F.posexplode("elements").alias("pos", "el")).select(
        "response_id", "pos", "el.*")


def named_elements(df: DataFrame) -> DataFrame:
    return df.withColumn("name", clean_text(F.col("tags")["name"])).filter(F.col("name") != "")


def osm_name_dedup(df: DataFrame, scope: list[str] = (), order: str = "ord",
                   limit: int | DataFrame | None = None) -> DataFrame:
    """First element per lower-case name; then the first ``limit`` of each scope.

    ``limit`` is a number or, with one scope column, a (scope, limit) table.
    """
    scope = list(scope)
    named = named_elements(df)
    kept = F.struct(*[c for c in named.columns if c not in scope])
    first = (named.withColumn("_low", F.lower("name"))
             .groupBy(*scope, "_low").agg(F.min_by(kept, order).alias("e"))
             .select(*scope, "e.*"))
    if limit is None:
        return first
    if not scope:
        return first.orderBy(order).limit(limit)
    return capped(first, limit, *scope, order)


def keyword_tags(keyword: Column) -> Column:
    """Pattern of the tag keys that a search keyword asks for (exact keyword, else defaults)."""
    table = constant_map({k: "|".join(v) for k, v in OSM_KEYWORD_TAGS.items()})
    return F.coalesce(F.try_element_at(table, F.lower(strip(keyword))),
                      F.lit("|".join(OSM_DEFAULT_TAGS)))


def osm_tag_filter(df: DataFrame, keyword: Column) -> DataFrame:
    """Elements with a name and a tag whose key matches (anywhere in the key)."""
    wanted = keyword_tags(keyword)
    return df.filter(F.col("tags")["name"].isNotNull()
                     & F.exists(F.map_keys("tags"), lambda k: F.rlike(k, wanted)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def located(df: DataFrame) -> DataFrame:
    """Point of an element: its own, else its centre. NULL means absent; zero is a coordinate."""
    if "center" not in df.columns:
        return df
    return df.withColumn("lat", F.coalesce("lat", "center.lat")).withColumn(
        "lon", F.coalesce("lon", "center.lon"))


def within_radius(df: DataFrame, lat: float, lon: float, radius_km: float | None = None) -> DataFrame:
    """Elements within the radius of a point (8 km when none is given), with the distance.

    A box in degrees comes first: it is a plain range filter that the parquet scan can use.
    """
    radius = (radius_km or 0) * 1000 or OSM_DEFAULT_RADIUS_M
    dlat = radius / METRES_PER_DEGREE * 1.001
    out = df.filter(F.col("lat").between(lat - dlat, lat + dlat))
    widest = max(abs(lat - dlat), abs(lat + dlat))
    if widest < 89:
        dlon = dlat / math.cos(math.radians(widest))
        if -180 <= lon - dlon and lon + dlon <= 180:
            out = out.filter(F.col("lon").between(lon - dlon, lon + dlon))
    metres = haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return out.withColumn("metres", metres).filter(F.col("metres") <= radius)


def geocode_places(df: DataFrame, gazetteer: DataFrame, place: str) -> DataFrame:
    """Look places up in a gazetteer (place, lat, lon[, name, country, rank]) by normalised name; inner.

    A place has one hit, the gazetteer row of lowest rank (then coordinates). Where both tables have a country it
    is part of the key. The named place falls back to the query text. The gazetteer is not assumed to be small, so
    the join strategy is left to the optimizer.
    """
    name = F.col("name") if "name" in gazetteer.columns else F.lit("")
    rank = F.col("rank") if "rank" in gazetteer.columns else F.lit(0)
    both = "country" in gazetteer.columns and "country" in df.columns
    key = lambda place: [F.lower(clean_text(F.col(place))).alias("_place"),
                         (F.lower(clean_text(F.col("country"))) if both else F.lit("")).alias("_country")]
    hit = F.struct(rank.alias("rank"), "lat", "lon", name.alias("_name"))
    towns = (gazetteer.select(*key("place"), hit.alias("h")).groupBy("_place", "_country").agg(F.min("h").alias("h"))
             .select("_place", "_country", "h.lat", "h.lon", "h._name"))
    return (df.select("*", *key(place)).join(towns, ["_place", "_country"])
            .withColumn("place_name", first_filled(strip(F.col("_name")), F.col(place)))
            .drop("_place", "_country", "_name"))


#: widths of grid cells in degrees; each goes round the globe a whole number of times
CELLS = [0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 22.5, 45.0, 90.0, 180.0, 360.0]
#: elements of a cell beyond which it is split
CROWDED = 50_000


def _cell(c: Column, width: Column) -> Column:
    return F.floor(c / width).cast("int")


def near_places(elements: DataFrame, places: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs of (place, element) within the place's own radius, without a cross join.

    ``places`` has lat, lon and radius_m as p_lat, p_lon, p_radius_m. Cells of a grid come in several widths. A place takes the smallest
    that its circle is no wider than half of, so it touches at most nine cells whatever its radius; an element has one cell of each width
    that some place takes (eleven at most, read from the places first). So it is an equi-join on the cell. Only a crowded cell is
    split, by its count: its elements take one of its parts and its places are copied to all of them.
    """
    dlat = F.col("p_radius_m") / METRES_PER_DEGREE * 1.001
    widest = F.least(F.abs("p_lat") + dlat, F.lit(89.0))
    dlon = F.least(dlat / F.cos(F.radians(widest)), F.lit(180.0))
    across = 2 * F.greatest(dlat, dlon)
    width = F.coalesce(*[F.when(across <= w, F.lit(w)) for w in CELLS], F.lit(CELLS[-1]))
    placed = places.withColumns({"_dlat": dlat, "_dlon": dlon, "_w": width})
    used = sorted(r["_w"] for r in placed.select("_w").distinct().collect())
    w = F.col("_w")
    spread = (placed
              .withColumn("_y", F.explode(F.sequence(_cell(F.col("p_lat") - F.col("_dlat"), w), _cell(F.col("p_lat") + F.col("_dlat"), w))))
              .withColumn("_x", F.explode(F.array_distinct(F.transform(
                  F.sequence(_cell(F.col("p_lon") - F.col("_dlon"), w), _cell(F.col("p_lon") + F.col("_dlon"), w)),
                  lambda x: F.pmod(x, (F.lit(360.0) / w).cast("int")))))).drop("_dlat", "_dlon"))
    widths = F.array(*[F.lit(u) for u in used]) if used else F.array().cast("array<double>")
    celled = (elements.withColumn("_w", F.explode(widths)).withColumn("_y", _cell(F.col("lat"), w))
              .withColumn("_x", F.pmod(_cell(F.col("lon"), w), (F.lit(360.0) / w).cast("int"))))
    cell = ["_w", "_y", "_x"]
    full = celled.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(crowded)).cast("int").alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    celled = celled.join(full, cell, "left").withColumn("_s", F.pmod(F.xxhash64("lat", "lon", "ord"), parts).cast("int")).drop("_parts")
    spread = spread.join(full, cell, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    near = celled.join(spread, [*cell, "_s"]).drop(*cell, "_s")
    metres = haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    return near.withColumn("metres", metres).filter(F.col("metres") <= F.col("p_radius_m"))


def industry_of_tags(name: Column) -> Column:
    """Industry of the first known tag value, else a guess from description and name."""
    table = constant_map(OSM_VALUE_INDUSTRY)
    known = [F.try_element_at(table, F.lower(tag(k))) for k in OSM_INDUSTRY_TAGS]
    guess = guess_industry(F.concat_ws(" ", tag("description"), name))
    return F.coalesce(*known, F.nullif(guess, F.lit("")), F.lit("Other"))


def join_osm_industry(df: DataFrame) -> DataFrame:
    """Tag values looked up in the fixed value table, held as a map literal: no join, no shuffle."""
    return df.withColumn("industry", industry_of_tags(tag("name")))


def _coordinate(c: Column) -> Column:
    """Plain decimal text, also for tiny values."""
    tiny = F.regexp_replace(c.cast("decimal(20,12)").cast("string"), r"0+$", "")
    return F.when((F.abs(c) < 0.001) & (c != 0), tiny).otherwise(c.cast("string"))


def osm_to_leads(df: DataFrame) -> DataFrame:
    """Project elements (with place and country columns) to graded leads."""
    el = located(named_elements(df))
    present = [F.when(F.col("tags")[k].isNotNull(),
                      F.concat(F.lit(f"{k}="), tag(k))) for k in OSM_CATEGORY_TAGS]
    primary = F.replace(F.coalesce(*present, F.lit("")), F.lit("_"), F.lit(" "))
    details = [F.when(F.col("tags")[k].isNotNull(), F.concat(
        F.lit(f"{k.title()}: "), F.replace(tag(k), F.lit("_"), F.lit(" "))))
        for k in OSM_DESCRIPTION_TAGS]
    chat = tag("contact:whatsapp")
    point = F.concat_ws(",", _coordinate(F.col("lat")), _coordinate(F.col("lon")))
    fields = {
        "company_name": F.col("name"),
        "industry": industry_of_tags(tag("name")),
        "category": clean_text(first_filled(tag("category"), primary)),
        "website": canonical_url(first_filled(tag("website"), tag("contact:website"), tag("url"))),
        "email": F.lower(strip(first_filled(tag("email"), tag("contact:email")))),
        "phone": normalize_phone(first_filled(tag("phone"), tag("contact:phone"),
                                              tag("contact:mobile"))),
        "whatsapp": F.when(chat != "", normalize_phone(F.concat(F.lit("+"), chat))).otherwise(""),
        "address": clean_text(F.concat_ws(", ", *[filled(tag(k)) for k in OSM_ADDRESS_TAGS])),
        "city": clean_text(first_filled(tag("addr:city"), F.col("place"))),
        "governorate": clean_text(tag("addr:state")),
        "country": F.coalesce(F.col("country"), F.lit(DEFAULT_COUNTRY)),
        "maps_link": F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(),
                            F.concat(F.lit(MAPS_LINK_PREFIX), point)).otherwise(""),
        "linkedin_url": canonical_url(tag("contact:linkedin")),
        "facebook_url": canonical_url(tag("contact:facebook")),
        "instagram_url": canonical_url(tag("contact:instagram")),
        "description": F.substring(clean_text(F.concat_ws(
            " — ", filled(tag("description")), *details)), 1, 500),
        "source_url": F.lit(OSM_SOURCE_URL),
    }
    kept = [c for c in ("search_id", "ord") if c in df.columns]
    leads = el.select(*kept, *[v.alias(k) for k, v in fields.items()])
    return grade_leads(conform(leads))


def osm_candidates(searches: DataFrame, elements: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """What the map source finds for every search: near its place, matching its keyword.

    Searches that ask for the same circle and tags share one selection, which is freed of repeated names and cut
    at the largest of their limits; only then it is dealt out to them.
    """
    request = ["p_lat", "p_lon", "p_radius_m", "wanted"]
    asked = geocode_places(searches.filter(F.col("place") != ""), gazetteer, "place").select(
        "search_id", "place", "country", "limit",
        keyword_tags(first_filled(F.col("query"), F.col("industry"), F.col("category"))).alias("wanted"),
        F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"),
        F.coalesce(F.nullif(F.col("radius_km") * 1000, F.lit(0)),
                   F.lit(OSM_DEFAULT_RADIUS_M)).cast("double").alias("p_radius_m"))
    asked = materialize(asked, "map-requests")  # read by the selection, by the choice of cells and when results are dealt out
    most = asked.groupBy(*request).agg(F.when(F.count("limit") == F.count(F.lit(1)), F.max("limit")).alias("limit"))
    most = most.withColumn("request", F.xxhash64(*request))
    near = near_places(located(elements), most.select("request", *request))
    near = near.filter(F.col("tags")["name"].isNotNull() & F.exists(F.map_keys("tags"), lambda k: F.rlike(k, F.col("wanted"))))
    found = osm_name_dedup(near.select("request", "ord", "lat", "lon", "tags"), ["request"], "ord", most.select("request", "limit"))
    dealt = found.join(asked.withColumn("request", F.xxhash64(*request)).drop("limit", *request), "request").drop("request")
    return osm_to_leads(capped(dealt, searches, "search_id", "ord"))

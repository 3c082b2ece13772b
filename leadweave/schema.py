"""Column sets and explicit schemas. Missing text is '' everywhere; it is never NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from .fixed_values import LEAD_COLUMNS

BOOKKEEPING = ["dedup_key", "discovered_at", "updated_at", "lead_id"]
SCORING = ["confidence_score", "confidence_tier"]
#: the 21 columns that leave the system
EXPORT_COLUMNS = [c for c in LEAD_COLUMNS if c not in BOOKKEEPING]
#: the 19 descriptive text columns that a later record may fill
TEXT_COLUMNS = [c for c in EXPORT_COLUMNS if c not in SCORING]

_TYPES = {"confidence_score": T.IntegerType(), "discovered_at": T.TimestampType(),
          "updated_at": T.TimestampType()}
LEAD_SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in LEAD_COLUMNS])

SEARCH_SCHEMA = T.StructType([
    T.StructField("search_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("governorate", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("radius_km", T.IntegerType()),
    T.StructField("limit", T.IntegerType()),
    T.StructField("sources", T.ArrayType(T.StringType())),
])

POINT = [T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]
ELEMENT_SCHEMA = T.StructType([
    *POINT,
    T.StructField("center", T.StructType(POINT)),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])
ELEMENTS_DOCUMENT_SCHEMA = T.StructType([
    T.StructField("response_id", T.LongType()),
    T.StructField("elements", T.ArrayType(ELEMENT_SCHEMA)),
])


def blank_missing(df: DataFrame) -> DataFrame:
    """Turn NULL text into '' and a NULL score into 0, once, on read."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    fills = {c: "" for c in texts}
    if "confidence_score" in df.columns:
        fills["confidence_score"] = 0
    return df.fillna(fills)


def conform(df: DataFrame) -> DataFrame:
    """Give a frame every lead column, in canonical order; other columns stay behind them."""
    types = {f.name: f.dataType.simpleString() for f in LEAD_SCHEMA.fields}
    blank = {"string": "''", "int": "0"}
    return df.selectExpr(
        *[c if c in df.columns else f"cast({blank.get(types[c], 'null')} as {types[c]}) as {c}"
          for c in LEAD_COLUMNS],
        *[f"`{c}`" for c in df.columns if c not in LEAD_COLUMNS])

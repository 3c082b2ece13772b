"""Filters, facets, counters and top-k over the lead table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import FACET_SIZE
from ..functions.text import strip
from ..functions.urls import netloc
from ..schema import BOOKKEEPING, EXPORT_COLUMNS
from .topk import top_per_group

FACETS = {"industry": "industry", "city": "city", "country": "country", "tier": "confidence_tier"}


def canonical_order() -> list[Column]:
    """Best score first, then name; the key makes the order total."""
    return [F.desc("confidence_score"), F.asc("company_name"), F.asc("dedup_key")]


def rank_leads(df: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(*canonical_order())
    return ordered.limit(limit) if limit else ordered


def lookup_lead(df: DataFrame, lead_id: str) -> DataFrame:
    return df.filter(F.col("lead_id") == lead_id)


# --- predicates ------------------------------------------------------------------------------
def same_text(df: DataFrame, c: str, value: str) -> Column:
    """Equality in any case; on the stored lower-case column if the table brings it, which the scan can filter by."""
    folded = f"{c}_folded"
    return (F.col(folded) if folded in df.columns else F.lower(c)) == value.lower()


def contains_text(c: str, value: str) -> Column:
    """Case-insensitive LIKE; '%' and '_' in the value stay wildcards."""
    return F.col(c).ilike("%" + value.replace("\\", "\\\\") + "%")


def filter_industry(df: DataFrame, value: str) -> DataFrame:
    return df.filter(same_text(df, "industry", value) | same_text(df, "category", value)) if value else df


def filter_equal(df: DataFrame, c: str, value: str) -> DataFrame:
    return df.filter(same_text(df, c, value)) if value else df


def filter_source(df: DataFrame, value: str) -> DataFrame:
    return df.filter(contains_text("source_url", value)) if value else df


def filter_min_score(df: DataFrame, score: int) -> DataFrame:
    return df.filter(F.col("confidence_score") >= score) if score else df


def filter_keyword(df: DataFrame, value: str) -> DataFrame:
    if not value:
        return df
    return df.filter(contains_text("company_name", value) | contains_text("description", value)
                     | contains_text("category", value))


def search_leads(df: DataFrame, *, industry: str = "", city: str = "", governorate: str = "",
                 country: str = "", keyword: str = "", source: str = "", min_score: int = 0,
                 limit: int | None = None) -> DataFrame:
    """All given predicates ANDed, in canonical order."""
    out = filter_min_score(df, min_score)
    out = filter_industry(out, industry)
    for c, value in (("city", city), ("governorate", governorate), ("country", country)):
        out = filter_equal(out, c, value)
    out = filter_keyword(filter_source(out, source), keyword)
    return rank_leads(out.drop(*[c for c in out.columns if c.endswith("_folded")]), limit)


def no_email() -> Column:
    return F.col("email") == ""


def no_phone() -> Column:
    return F.col("phone") == ""


def missing_contact(df: DataFrame) -> DataFrame:
    """Leads without e-mail or without phone, with a label that says which."""
    what = (F.when(no_email() & no_phone(), "both").when(no_email(), "email").otherwise("phone"))
    return df.filter(no_email() | no_phone()).withColumn("missing", what)


def leads_since(df: DataFrame, since: Column, field: str = "discovered_at") -> DataFrame:
    return df.filter(F.col(field) >= since)


# --- projections -----------------------------------------------------------------------------
def export_projection(df: DataFrame) -> DataFrame:
    return df.select(*EXPORT_COLUMNS)


def browse_run(df: DataFrame) -> DataFrame:
    """The seven columns shown for the leads of a run."""
    shown = {"company_name": "company", "city": "city", "email": "email", "phone": "phone",
             "website": "website", "confidence_score": "score", "confidence_tier": "tier"}
    return df.select(*[F.col(c).alias(name) for c, name in shown.items()])


def browse_all(df: DataFrame) -> DataFrame:
    return df.drop(*BOOKKEEPING)


# --- counters and facets ---------------------------------------------------------------------
def count_leads(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def counts_since(df: DataFrame, since: Column) -> DataFrame:
    """All six report counters in one pass."""
    fresh = F.col("discovered_at") >= since
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(fresh).alias("new"),
        F.count_if((F.col("updated_at") >= since) & ~fresh).alias("updated"),
        F.count_if(no_email()).alias("missing_email"),
        F.count_if(no_phone()).alias("missing_phone"),
        F.count_if(no_email() & no_phone()).alias("missing_contact"))


def facet(df: DataFrame, c: str, size: int = FACET_SIZE) -> DataFrame:
    """Most frequent non-empty values; ties by value."""
    return (df.filter(F.col(c) != "").groupBy(F.col(c).alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "value").limit(size))


def facets_all(df: DataFrame, size: int = FACET_SIZE) -> DataFrame:
    """Every facet in one pass over the table (grouping sets)."""
    cols = list(FACETS.values())
    sets = df.groupingSets([[F.col(c)] for c in cols], *cols).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(*cols).alias("_gid"))
    whole = (1 << len(cols)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (label, c) in enumerate(FACETS.items()):
        gid = whole - (1 << (len(cols) - 1 - i))
        name = F.when(F.col("_gid") == gid, F.lit(label)).otherwise(name)
        value = F.when(F.col("_gid") == gid, F.col(c)).otherwise(value)
    long = sets.select(name.alias("facet"), value.alias("value"), "n").filter(F.col("value") != "")
    return top_per_group(long, ["facet"], [F.desc("n"), "value"], size)


def source_host() -> Column:
    """Host of the source URL without 'www.'; a value without scheme is kept whole."""
    whole = F.coalesce(F.nullif(netloc(F.col("source_url")), F.lit("")), F.lower("source_url"))
    return F.regexp_replace(whole, r"^www\.", "")


def facet_source_host(df: DataFrame, size: int = FACET_SIZE, fold_top_urls: bool = False) -> DataFrame:
    """Leads per source host. ``fold_top_urls`` counts only the most frequent raw URLs."""
    rows = df.filter(F.col("source_url") != "")
    if fold_top_urls:
        rows = facet(rows, "source_url", size).select(F.col("value").alias("source_url"), "n")
    else:
        rows = rows.select("source_url", F.lit(1).alias("n"))
    return (rows.groupBy(source_host().alias("value")).agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "value").limit(size))


def avg_score(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.coalesce(F.avg("confidence_score"), F.lit(0.0)), 1).alias("avg_score"))


def facet_cardinality(df: DataFrame, cap: int = FACET_SIZE) -> DataFrame:
    """Number of values per facet, as shown (capped) and in full."""
    counts = df.agg(*[F.countDistinct(F.nullif(F.col(c), F.lit(""))).alias(name)
                      for name, c in FACETS.items()])
    return counts.select(*[F.col(n).alias(f"{n}_values") for n in FACETS],
                         *[F.least(F.col(n), F.lit(cap)).alias(f"{n}_shown") for n in FACETS])


def top_values(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """Most frequent trimmed values of several columns in one pass.

    Ties go to the value that comes first in canonical order.
    """
    rank = F.struct((-F.col("confidence_score")).alias("s"), F.col("company_name"),
                    F.col("dedup_key"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attr"), strip(F.col(c)).alias("value"))
                                for c in columns]))
    counted = (df.select(rank.alias("rank"), pairs.alias("p")).select("rank", "p.*")
               .filter(F.col("value") != "").groupBy("attr", "value")
               .agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank")))
    return top_per_group(counted, ["attr"], [F.desc("n"), "rank"], n, rank="pos").drop("rank")


def topk_new(df: DataFrame, since: Column, n: int = 10) -> DataFrame:
    return rank_leads(leads_since(df, since), n)


def topk_missing(df: DataFrame, n: int = 10) -> DataFrame:
    return rank_leads(df.filter(no_email() & no_phone()), n)

"""Confidence score, tier and identity key of a lead (over the lead columns, by name)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import LOWEST_TIER, MIN_DESCRIPTION, PERSON_BONUS, TIERS, WEIGHTS
from ..schema import TEXT_COLUMNS
from .urls import domain_sql

_BLANKS = r"r'(?U)^\s+|\s+$'"


def _stripped(c: str) -> str:
    return f"regexp_replace({c}, {_BLANKS}, '')"


def confidence_score(weights: dict[str, int] | None = None) -> Column:
    """Sum of the weights of what is known about a lead, clamped to 0..100."""
    w = {**WEIGHTS, **(weights or {})}
    rules = {c: f"{c} rlike r'(?U)\\S'" for c in ("website", "email", "phone")}
    rules["social"] = "linkedin_url <> '' or facebook_url <> '' or instagram_url <> ''"
    rules["description"] = f"length({_stripped('description')}) >= {MIN_DESCRIPTION}"
    total = " + ".join(f"if({rule}, {w[name]}, 0)" for name, rule in rules.items())
    person = r"contact_person rlike r'(?U)\S'"
    return F.expr(f"cast(greatest(0, least(100, if({person}, least(100, {total} + {PERSON_BONUS}), "
                  f"{total}))) as int)")


def confidence_tier(score: Column) -> Column:
    (floor, name), *rest = TIERS
    out = F.when(score >= floor, name)
    for floor, name in rest:
        out = out.when(score >= floor, name)
    return out.otherwise(LOWEST_TIER)


def dedup_key() -> Column:
    """'dom:' + domain, else 'name:' + name|city|country|phone, else 'anon:' + row hash."""
    low = ", ".join(f"lower({_stripped(c)})" for c in ("company_name", "city", "country"))
    named = f"array_join(filter(array({low}, replace(phone, ' ', '')), p -> p <> ''), '|')"
    return F.expr(f"""case when {domain_sql('website')} <> '' then concat('dom:', {domain_sql('website')})
        when {named} <> '' then concat('name:', {named})
        else concat('anon:', md5(concat_ws('\x1f', {', '.join(TEXT_COLUMNS)}))) end""")


def lead_id(key: Column) -> Column:
    return F.md5(key)

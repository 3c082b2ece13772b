"""E-mail extraction and classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import (ADDRESS_PATTERN, DISPOSABLE_DOMAINS, FREEMAIL_DOMAINS,
                            MAILTO_PATTERN, ROLE_MAILBOXES, VALID_EMAIL_PATTERN)
from .text import strip

#: ADDRESS_PATTERN, tried once for each run of signs of a mailbox: what stands behind the run decides, wherever in it the match begins
_ADDRESS = r"(?:(?<![a-zA-Z0-9._%+\-])|\G)" + ADDRESS_PATTERN.replace("+@", "++@", 1)


def extract_emails(text: Column) -> Column:
    """Distinct addresses: mailto targets first, then addresses in the text, in order."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(F.regexp_extract_all(text, F.lit(MAILTO_PATTERN), F.lit(1)),
                     F.regexp_extract_all(text, F.lit(_ADDRESS), F.lit(0)))
    tidy = F.transform(found, lambda e: F.regexp_replace(F.lower(strip(e)), r"\.+$", ""))
    kept = F.array_distinct(F.filter(tidy, lambda e: F.contains(e, F.lit("@"))))
    return F.when(F.contains(text, F.lit("@")), kept).otherwise(F.array().cast("array<string>"))


def is_valid_email(email: Column) -> Column:
    e = F.regexp_replace(F.lower(strip(F.coalesce(email, F.lit("")))), r"\.+$", "")
    # the pattern repeats a group, which costs stack for each label: only text of a possible length meets it
    return F.when(F.length(e) <= 254, e.rlike(VALID_EMAIL_PATTERN) & ~e.rlike(r"^\.|\.@|\.\.[^@]*@")).otherwise(False)


def classify_email(email: Column) -> Column:
    """invalid, disposable, role, personal or business, in this order of precedence."""
    e = F.lower(strip(email))
    local, host = F.substring_index(e, "@", 1), F.regexp_replace(e, r"^[^@]*@?", "")
    return (F.when(~is_valid_email(email), "invalid")
            .when(host.isin(DISPOSABLE_DOMAINS), "disposable")
            .when(local.isin(ROLE_MAILBOXES), "role")
            .when(host.isin(FREEMAIL_DOMAINS), "personal")
            .otherwise("business"))


def email_rank(email: Column) -> Column:
    """Preference when one address is wanted: business, then role, then the rest."""
    kind = classify_email(email)
    return F.when(kind == "business", 0).when(kind == "role", 1).otherwise(2)


def email_domain(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", -1))


def email_mailbox(email: Column) -> Column:
    return F.regexp_replace(F.lower(F.substring_index(email, "@", 1)), r"^\.+|\.+$", "")


def best_email(emails: Column) -> Column:
    """First valid address of the best rank in an ordered array; NULL if there is none."""
    return best_ranked_email(emails)["email"]


def best_ranked_email(emails: Column) -> Column:
    """The best address as (rank, pos, email), so that the best of several arrays is their minimum."""
    valid = F.filter(emails, lambda e: is_valid_email(e))
    ranked = F.transform(valid, lambda e, i: F.struct(
        email_rank(e).alias("rank"), i.alias("pos"), e.alias("email")))
    return F.array_min(ranked)

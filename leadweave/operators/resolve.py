"""Entity resolution: first-seen-wins merge, candidate de-duplication, upsert, delete.

Everything here is a hash-partitioned aggregate with map-side combine, never a window over a whole
group: "first non-empty value" is ``min(struct(order, value))`` over the non-empty rows, so a key
that holds a third of all rows is reduced inside every map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_text
from ..functions.urls import domain
from ..schema import BOOKKEEPING, EXPORT_COLUMNS, TEXT_COLUMNS
from .scoring import grade_leads, key_leads


def _missing(c: str) -> str:
    return "0" if c == "confidence_score" else "''"


def _first_fill(c: str, order: Sequence[str]) -> str:
    """(order, value) of the first row that has a value in ``c``; NULL if none has."""
    return (f"min(case when {c} <> {_missing(c)} then struct({', '.join(order)}, {c} as value) end)")


def merge_leads(df: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """One row per key: each column from the first row that has it, the rest from the first row."""
    carried = [c for c in df.columns if c not in {*keys, *EXPORT_COLUMNS, order}]
    grouped = df.groupBy(*keys).agg(
        F.min(F.struct(order, *carried)).alias("_head"),
        *[F.expr(f"{_first_fill(c, [order])} as {c}") for c in EXPORT_COLUMNS])
    return grouped.selectExpr(
        *keys, f"_head.{order}",
        *[f"coalesce({c}.value, {_missing(c)}) as {c}" for c in EXPORT_COLUMNS],
        *[f"_head.{c}" for c in carried])


def dedup_candidates(df: DataFrame, scope: Sequence[str] = (), order: str = "ord") -> DataFrame:
    """Collapse duplicates among candidates (per ``scope``, e.g. one search).

    Rows with a domain merge into the first row of that domain. Rows without a domain survive
    only as the first holder of their name, where a domain counts under the name of its first
    row. Rows with neither always survive.
    """
    scope = list(scope)
    cols = df.columns
    rows = df.withColumn("_dom", domain(F.col("website"))).withColumn(
        "_name", F.lower(clean_text(F.col("company_name"))))
    sited = rows.filter(F.col("_dom") != "")
    siteless = rows.filter(F.col("_dom") == "")

    # the name of a domain's first row comes along with the merge
    merged = merge_leads(sited, [*scope, "_dom"], order)
    claimed = (merged.filter(F.col("_name") != "")
               .groupBy(*scope, "_name").agg(F.min(order).alias("_taken")))
    holders = (siteless.filter(F.col("_name") != "")
               .groupBy(*scope, "_name")
               .agg(F.min(F.struct(order, *[c for c in cols if c not in {*scope, order}])).alias("h"))
               .select(*scope, "_name", "h.*")
               .join(claimed, [*scope, "_name"], "left")
               .filter(F.col("_taken").isNull() | (F.col(order) < F.col("_taken")))
               .select(*cols))
    anonymous = siteless.filter(F.col("_name") == "").select(*cols)
    return merged.select(*cols).unionByName(holders).unionByName(anonymous)


def _incoming(batch: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per key of a batch: row count, first row's own facts, first fill per column."""
    head = [*order, "confidence_score", "confidence_tier", "discovered_at"]
    return key_leads(batch).groupBy("dedup_key").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*head)).alias("_head"),
        *[F.expr(f"{_first_fill(c, order)} as _in_{c}") for c in TEXT_COLUMNS])


def _matched(store: DataFrame, batch: DataFrame, order: Sequence[str], how: str) -> DataFrame:
    """Store and batch side by side; both are unique on the key, so no key can be hot here.

    ``_changing`` holds the order of the batch rows that bring a value nobody before them had:
    at most one per column, the row that creates the lead not among them.
    """
    kept = store.selectExpr("dedup_key", "true as _has", *[f"{c} as _st_{c}" for c in (
        *TEXT_COLUMNS, "confidence_score", "confidence_tier", "discovered_at", "updated_at")])

    def place(of: str) -> str:
        return "struct(" + ", ".join(f"{of}.{o} as {o}" for o in order) + ")"

    fills = ", ".join(f"if(coalesce(_st_{c}, '') = '' and _in_{c} is not null, {place('_in_' + c)}, null)"
                      for c in TEXT_COLUMNS)
    return (_incoming(batch, order).join(kept, "dedup_key", how)
            .selectExpr("*", "coalesce(_has, false) as _stored", f"{place('_head')} as _first",
                        f"array_compact(array({fills})) as _fills")
            .selectExpr("* except (_has, _fills)",
                        "array_distinct(filter(_fills, p -> _stored or p <> _first)) as _changing"))


def upsert_leads(store: DataFrame, batch: DataFrame, now: Column, order: Sequence[str] = ("ord",),
                 rescore: bool = False) -> DataFrame:
    """New snapshot: stored values never change, empty ones are filled by the first that has one.

    Score and tier stay those of the record that created the lead; ``rescore`` grades them anew.
    ``updated_at`` moves to ``now`` for new and filled leads only.
    """
    both = _matched(store, batch, order, "full_outer").withColumn("_now", now)
    out = both.selectExpr(
        *[f"coalesce(nullif(_st_{c}, ''), _in_{c}.value, '') as {c}" for c in TEXT_COLUMNS],
        *[f"coalesce(_st_{c}, _head.{c}) as {c}" for c in ("confidence_score", "confidence_tier")],
        "dedup_key", "coalesce(_st_discovered_at, _head.discovered_at, _now) as discovered_at",
        "if(not _stored or size(_changing) > 0, _now, _st_updated_at) as updated_at",
        "md5(dedup_key) as lead_id")
    return grade_leads(out) if rescore else out


def upsert_actions(store: DataFrame, batch: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """What the upsert does with every batch row: inserted, updated or unchanged.

    The few acting rows of each key come from the key-level aggregate; the rest of the batch is
    joined to them on its unique order columns, so a hot key spreads over all tasks.
    """
    order = list(order)
    acts = ", ".join(f"p.{o} as {o}" for o in order)
    acting = _matched(store, batch, order, "left").selectExpr(f"""inline(concat(
        if(_stored, array(), transform(array(_first), p -> struct({acts}, 'inserted' as action))),
        transform(_changing, p -> struct({acts}, 'updated' as action))))""")
    return (key_leads(batch).select(*order, "dedup_key")
            .join(acting, order, "left")
            .fillna({"action": "unchanged"}))


def upsert_counts(store: DataFrame, batch: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """One row of counters, from the key-level aggregate alone (no join back to the rows)."""
    keyed = _matched(store, batch, order, "left")
    return keyed.selectExpr("_n", "if(_stored, 0, 1) as _new", "size(_changing) as _chg").selectExpr(
        "coalesce(sum(_new), 0) as inserted", "coalesce(sum(_chg), 0) as updated",
        "coalesce(sum(_n - _new - _chg), 0) as unchanged", "cast(0 as bigint) as failed")


def empty_store(batch: DataFrame) -> DataFrame:
    """A store with the batch's columns and no rows."""
    return batch.select(*EXPORT_COLUMNS, *BOOKKEEPING).filter(F.lit(False))


def delete_leads(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Snapshot without the given lead_ids."""
    return store.join(ids.select("lead_id").distinct(), "lead_id", "left_anti")
